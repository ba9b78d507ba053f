"""Phrase mining, source audit and substring removal against plain Python over awkward rows."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from panelforge.llm import collocations, fm_dedup, sketch, source_audit

SCHEMA = "doc_id long, text string, lang string, source string"


def low(text):
    return (text or "").encode().lower().decode()


def sets(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.fixture(scope="module")
def crowd(spark, rows):
    """Awkward rows, and many short texts over few words."""
    rng = random.Random(5)
    vocab = ["new", "york", "city", "the", "Of", "ça", "是", "a", "a", "b,c", "x.y", "\tq", "UP"]
    extra = [(100 + i, " ".join(rng.choice(vocab) for _ in range(rng.randrange(60))) + rng.choice(["", ".\n", " new york city"]), rng.choice(["en", "fr", None, "und"]), rng.choice(["s0", "s1", None])) for i in range(300)]
    return [r[:4] for r in rows] + extra


@pytest.fixture(scope="module")
def crowd_df(spark, crowd):
    return spark.createDataFrame(crowd, SCHEMA).repartition(3)


@pytest.mark.parametrize("run", [lambda d: collocations.mine(d, least=3), lambda d: source_audit.audit(d, least_docs=3), lambda d: fm_dedup.remove(d, window=5, gram=2)])
def test_empty_table_and_clashing_columns(run, empty, docs, odd):
    assert run(empty).count() == 0
    assert sets(run(docs)) == sets(run(odd))


# ---- 11 --------------------------------------------------------------------------------------
def mined(rows, least, longest=5, percent=100, top=10**9):
    f, n = defaultdict(Counter), Counter()
    for _, text, lang, *_ in rows:
        lang = "und" if lang is None else lang
        f[lang], n[lang]
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low(text)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for i in range(len(w)):
                for m in range(1, min(longest, len(w) - i) + 1):
                    f[lang][tuple(w[i : i + m])] += 1
    out = []
    for lang, counts in f.items():
        often = {p: a for p, a in counts.items() if a >= least}
        found = []
        for p, a in often.items():
            if len(p) < 2:
                continue
            inside = any(len(q) > len(p) and 100 * b >= percent * a and any(q[i : i + len(p)] == p for i in range(len(q))) for q, b in often.items())
            if not inside:
                s, k = min((1000 * a * n[lang] // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p)))
                found.append((-s, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        out += [(lang, i, p.decode(), -a, x, y, n[lang], -s) for i, (s, a, p, x, y) in enumerate(sorted(found), 1) if i <= top]
    return sorted(out, key=repr)


@pytest.mark.parametrize(("bits", "patterns", "percent"), [(None, 50_000, 100), (14, 7, 60)])
def test_phrases(crowd, crowd_df, bits, patterns, percent):
    """Also with a sketch so small that it lets too much through, many small automata, ties."""
    want = mined(crowd, 8, percent=percent)
    assert len(want) > 20
    assert sets(collocations.mine(crowd_df, least=8, percent=percent, bits=bits, patterns=patterns)) == want
    assert sets(collocations.mine(crowd_df, least=8, percent=percent, top=3)) == mined(crowd, 8, percent=percent, top=3)


def test_phrase_scores_pass_64_bits(spark):
    a, x, y, n = 7 * 10**12, 9 * 10**12, 8 * 10**12, 4 * 10**15
    counts = spark.createDataFrame([("en", "p q", a), ("en", "p", x), ("en", "q", y), ("en", "", n)], "lang string, phrase string, n long")
    assert collocations.score(counts).first().score == 1000 * a * n // (x * y)


def test_sketch_never_undercounts(spark):
    rng = random.Random(1)
    words = [str(int(rng.paretovariate(0.7))) for _ in range(20_000)]
    d = spark.createDataFrame([(i, " ".join(words[i : i + 50])) for i in range(0, len(words), 50)], "id long, text string").repartition(4)

    def hashes(b):
        return np.array([int.from_bytes(hashlib.md5(w.encode()).digest()[:8], "big") for t in b.column("text").to_pylist() for w in t.split()], np.uint64)

    at_least = [np.frombuffer(m, np.uint8) for m in sketch.heavy_buckets(d, lambda x: sketch.gathered(x, "text"), hashes, 16, 2, 300)]
    for k, m in zip((2, 300), at_least, strict=True):
        often = [w for w, n in Counter(words).items() if n >= k]
        h = np.array([int.from_bytes(hashlib.md5(w.encode()).digest()[:8], "big") for w in often], np.uint64)
        assert sketch.passes(m, h, 16).all()
    assert 0 < np.unpackbits(at_least[1]).sum() < 40


# ---- 12 --------------------------------------------------------------------------------------
def audited(rows, least, top):
    term = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
    held, count, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for _, text, lang, source in rows:
        lang, source = lang or "", source or ""
        words = term.findall(low(text))
        groups[lang].add(source)
        held[lang].update(set(words))
        count[lang, source].update(words)
    out = []
    for lang, sources in groups.items():
        kept = [t for t, n in held[lang].items() if n >= least]

        def share(c, kept=kept):
            n = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 5) // (n + 5 * len(kept)) for t in kept}

        p = {s: share(count[lang, s]) for s in sources}
        q = share(sum((count[lang, s] for s in sources), Counter()))
        for s in sources:
            pairs = sorted((-sum(abs(p[s][t] - p[o][t]) for t in kept), o.encode()) for o in sources if o != s)
            terms = sorted((q[t] - p[s][t], t.encode()) for t in kept if count[lang, s][t] and p[s][t] > q[t])[:top]
            out += [(lang, s, part, i.decode(), -v, r) for part, x in (("pair", pairs), ("term", terms)) for r, (v, i) in enumerate(x, 1)]
    return sorted(out, key=repr)


@pytest.mark.parametrize("chunk", [4096, 3])
def test_source_audit(crowd, crowd_df, chunk, monkeypatch):
    """Also with chunks of three terms and dense blocks of two."""
    monkeypatch.setattr(source_audit, "CHUNK", chunk)
    if chunk == 3:
        monkeypatch.setattr(source_audit, "CELLS", 8)
        monkeypatch.setattr(source_audit, "SENT_GROUPS", 0)
        monkeypatch.setattr(source_audit, "HELD", 10)
    want = audited(crowd, 6, 4)
    assert {x[2] for x in want} == {"pair", "term"}
    assert sets(source_audit.audit(crowd_df, least_docs=6, top=4)) == want


@given(st.lists(st.integers(0, 10**14), min_size=1, max_size=5), st.integers(1, 10**9))
def test_shares_are_exact(counts, v):
    total = sum(counts)
    assert source_audit.shares(np.array(counts), total, v).tolist() == [1 + 10**9 * (c + 5) // (total + 5 * v) for c in counts]
    assert source_audit.add_up(np.zeros(len(counts), int), np.array(counts), 1)[0] == total


# ---- 13 --------------------------------------------------------------------------------------
def removed(rows, window):
    docs = sorted({(i is None, i or 0, t or "") for i, t, *_ in rows})
    seen, out = set(), {}
    for key in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", key[2])
        gone = set()
        for i in range(len(w) - window + 1):
            x = tuple(w[i : i + window])
            if x in seen:
                gone.update(range(i, i + window))
            seen.add(x)
        out[key] = (len(w), len(gone), hashlib.sha256(" ".join(x for i, x in enumerate(w) if i not in gone).encode()).hexdigest())
    return sorted(((i, *out[i is None, i or 0, t or ""]) for i, t, *_ in rows), key=repr)


@pytest.mark.parametrize(("window", "gram", "often"), [(20, 6, 2000), (5, 2, 2000), (5, 2, 4), (7, 7, 3)])
def test_removed_words(crowd, crowd_df, window, gram, often):
    """Also where anchors count as frequent at once, so that windows stand for themselves."""
    want = removed(crowd, window)
    assert sum(x[2] for x in want) > 100
    assert sets(fm_dedup.remove(crowd_df, window=window, gram=gram, often=often)) == want


def test_shared_passages(spark):
    """Passages in many contexts, repeats within a document, copies; several index shards."""
    rng = random.Random(8)
    word = lambda: f"w{rng.randrange(3000)}"
    passage = [[word() for _ in range(rng.randrange(20, 70))] for _ in range(6)]
    rows = []
    for i in range(250):
        w = [word() for _ in range(rng.randrange(5, 80))]
        for _ in range(rng.randrange(3)):
            k = rng.randrange(len(w))
            w[k:k] = rng.choice(passage)
        rows.append((i, rng.choice([" ", "\n", " \t"]).join(w)))
    rows += [(300 + i, rows[7][1]) for i in range(30)] + [(400, "z " * 90), (401, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    want = removed(rows, 20)
    for often, size in ((2000, 6000), (2000, 50), (10, 50)):
        fm_dedup.SHARD_SEGMENTS, was = size, fm_dedup.SHARD_SEGMENTS
        try:
            got = fm_dedup.remove(df, often=often, with_text=True).collect()
        finally:
            fm_dedup.SHARD_SEGMENTS = was
        assert sorted((tuple(r)[:4] for r in got), key=repr) == want
        assert all(hashlib.sha256(r.kept_text.encode()).hexdigest() == r.kept_sha256 for r in got)


@settings(deadline=None)
@given(st.lists(st.integers(1, 4), min_size=1, max_size=200), st.integers(1, 7))
def test_index_against_plain_search(text, longest):
    t = np.array(text)
    index = fm_dedup.FMIndex(t, 8)
    end = np.arange(longest, len(t) + 1)
    if not len(end):
        return
    length, lo, hi = index.search(t, end, longest, alone=0)
    assert (length == longest).all()
    for e, a, b in zip(end, lo, hi, strict=True):
        want = [i for i in range(len(text)) if text[i : i + longest] == text[e - longest : e]]
        assert sorted(index.sa[a:b].tolist()) == want
    short, *_ = index.search(t, end, longest)
    for e, n in zip(end, short, strict=True):
        times = [sum(text[i : i + k] == text[e - k : e] for i in range(len(text))) for k in range(1, longest + 1)]
        assert n == next((k for k, x in enumerate(times) if x == 1), longest)


@given(st.lists(st.integers(0, 300), min_size=1, max_size=300))
def test_wavelet_rank(seq):
    s = np.array(seq)
    w = fm_dedup.WaveletMatrix(s, int(s.max()) + 1)
    at = np.arange(len(s) + 1)
    for c in set(seq[:5]):
        assert w.rank(np.full(len(at), c), at)[1].tolist() == [seq[:i].count(c) for i in at]
