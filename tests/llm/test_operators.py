"""Each operator against a brute-force version over awkward rows, an empty table and clashing
column names."""

import gzip
import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelforge.llm import arc_convert, byte_cnn, chunk_cache, graph, lattice_lm, license_scan, line_rules, merge_prefix, minhash_forest, rare_digest, token_store, window_packing
from panelforge.llm.common import shared_dir, tokenizer_bytes


def sets(df):
    return sorted(map(tuple, df.collect()), key=repr)


def low(text):
    return (text or "").encode().lower().decode()


@pytest.mark.parametrize(
    "run",
    [
        license_scan.scan,
        minhash_forest.near_duplicates,
        rare_digest.fingerprints,
        lattice_lm.score,
        window_packing.pack,
        line_rules.judge,
        merge_prefix.encode_table,
    ],
)
def test_empty_table_and_clashing_columns(run, empty, docs, odd):
    assert run(empty).count() == 0
    cols = [c for c in run(docs).columns if c not in ("row", "sequence_id")]
    assert sets(run(docs).select(cols)) == sets(run(odd).select(cols))


# ---- 1 ---------------------------------------------------------------------------------------
def test_license_scan(docs, rows):
    got = {(r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels): r for r in license_scan.scan(docs).collect()}
    want = []
    for i, t, *_ in rows:
        w = re.findall(license_scan.WORD, low(t))
        hits = [(k, label) for label, p in license_scan.BASE for k in range(len(w)) if w[k : k + len(p.split())] == p.split()]
        at = [k for k, _ in hits]
        want.append((i, len(w), len(hits), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in hits}))))
    assert sorted(got, key=repr) == sorted(set(want), key=repr)
    assert license_scan.scan(docs).count() == len(rows)


def test_license_spans_survive_edits(spark):
    text = "x " * 30 + "Permission is hereby granted, free of charge, to every single person obtaining a copy of this software and documentation files, to deal in the Software without restriction"
    r = license_scan.scan(spark.createDataFrame([(1, text)], "doc_id long, text string"), with_spans=True).first()
    assert r.labels == "mit" and r.n_base == 0 and 0.75 <= r.score <= 1 and r.spans[0].first_word == 30


# ---- 2 ---------------------------------------------------------------------------------------
def shingles(text):
    w = low(text).encode().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def components(items):
    parent = {k: k for k in items}

    def find(k):
        while parent[k] != k:
            k = parent[k]
        return k

    keys = [k for k in items if items[k]]
    for x in keys:
        for y in keys:
            both = len(items[x] & items[y])
            if x < y and 100 * both >= 75 * len(items[x] | items[y]):
                a, b = find(x), find(y)
                parent[max(a, b)] = min(a, b)
    return {k: find(k) for k in items}


def test_near_duplicates(docs, rows):
    items = {i: shingles(t) for i, t, *_ in rows if i is not None}
    comp = components(items)
    got = minhash_forest.near_duplicates(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id is None:
            assert r.kept and r.component_id is None
        else:
            assert (r.n_shingles, r.component_id, r.kept) == (len(items[r.doc_id]), comp[r.doc_id], comp[r.doc_id] == r.doc_id)


def test_large_group_of_near_copies(spark):
    rng = random.Random(3)
    words = [f"w{rng.randrange(10**6)}" for _ in range(150)]
    texts = []
    for k in range(400):
        w = list(words)
        for _ in range(rng.randrange(5)):
            w[rng.randrange(150)] = f"e{k}-{rng.randrange(99)}"
        texts.append((k, " ".join(w)))
    items = {k: shingles(t) for k, t in texts}
    comp = components(items)
    got = {r.doc_id: r.component_id for r in minhash_forest.near_duplicates(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    assert got == comp


def exact_components(texts):
    """Components of an exact join, by an inverted index over the rarest shingles of each set."""
    sets_ = {i: shingles(t) for i, t in texts}
    often = Counter(x for v in sets_.values() for x in v)
    index, links = {}, []
    for i, v in sets_.items():
        order = sorted(v, key=lambda x: (often[x], x))
        near = {j for x in order[: len(v) - math.ceil(0.75 * len(v)) + 1] for j in index.get(x, ())}
        links += [(i, j) for j in near if 100 * len(v & sets_[j]) >= 75 * len(v | sets_[j])]
        for x in order[: len(v) - math.ceil(0.75 * len(v)) + 1]:
            index.setdefault(x, []).append(i)
    parent = {i: i for i in sets_}

    def find(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for i, j in links:
        a, b = find(i), find(j)
        parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in sets_}


def test_no_link_is_lost_on_the_documents(spark, sf_dir):
    big = sf_dir.replace("0.001", "0.01")
    d = spark.read.parquet(f"{big}/documents.parquet").select("doc_id", "text")
    got = {r.doc_id: r.component_id for r in minhash_forest.near_duplicates(d).collect()}
    assert got == exact_components([(r.doc_id, r.text) for r in d.collect()])


def test_crowded_regions_lose_no_link(spark):
    """Pages of one template, alike to 65 %, among them pairs at 75 % and more; and stragglers that
    are alike to one member of a large group only."""
    rng = random.Random(9)
    word = lambda: f"w{rng.randrange(10**9)}"
    frame, texts = [word() for _ in range(160)], []
    for _ in range(300):
        own = [word() for _ in range(40)]
        texts.append(frame + own)
        if len(texts) % 7 == 0:
            texts.append(frame + own[:32] + [word() for _ in range(8)])
    base = [word() for _ in range(200)]
    for k in range(300):
        w = list(base)
        w[k % 200] = word()
        texts.append(w)
    for k in range(20):
        w = list(texts[-1 - k])
        w[10 + k] = w[60 + k] = w[110 + k] = w[150 + k // 2] = word()
        texts.append(w + [word() for _ in range(rng.randrange(10, 30))])
    rows = [(k, " ".join(w)) for k, w in enumerate(texts)]
    rng.shuffle(rows)
    got = {r.doc_id: r.component_id for r in minhash_forest.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == exact_components(rows)


def test_one_of_each_keeps_columns(odd, rows):
    out = minhash_forest.one_of_each(odd)
    comp = components({i: shingles(t) for i, t, *_ in rows if i is not None})
    assert out.columns == odd.columns
    assert sorted((r.doc_id for r in out.collect()), key=repr) == sorted([*{v for v in comp.values()}, None], key=repr)


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, k) for k in range(101, 140)] + [(7, 7)]
    got = {r.node: r.label for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(1, 61)}, **{k: 100 for k in range(101, 140)}}


# ---- 3 ---------------------------------------------------------------------------------------
def test_fingerprints(docs, rows):
    got = rare_digest.fingerprints(docs).collect()
    assert len(got) == len(rows)
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1] or ""))
    want = Counter()
    for k, r in enumerate(order):
        nxt = order[(k + 1) % len(order)][1] or ""
        t = r[1] or ""
        n = len(t) // 3
        want[r[0], len(t), hashlib.sha256((t[: len(t) - n] + nxt[:n]).encode()).hexdigest()] += 1
    assert Counter((r.doc_id, r.n_chars, r.edited_sha256) for r in got) == want
    by_text = {}
    for r in got:
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        by_text.setdefault(r.doc_id, set()).add(r.fingerprint)
    assert len(by_text[3]) == 1 and by_text[0] == by_text[7]


def test_entropies_are_those_of_the_windows():
    rng = np.random.default_rng(2)
    data = rng.integers(97, 110, 400).astype(np.uint8)
    got = rare_digest.entropies(data)
    for i in (0, 1, 57, 300, len(got) - 1):
        c = Counter(data[i : i + rare_digest.WINDOW].tolist()).values()
        h = -sum(x / 32 * math.log2(x / 32) for x in c)
        assert abs(got[i] - 1000 * h / 5) <= 1


def test_likeness_falls_with_edits():
    rng = random.Random(5)
    a = " ".join(str(rng.random()) for _ in range(300))
    rank = np.arange(rare_digest.LEVELS)
    parts = [a, a[: len(a) * 2 // 3] + a[: len(a) // 3][::-1], " ".join(str(rng.random()) for _ in range(300))]
    x = rare_digest.digests([p.encode() for p in parts], rank)
    assert rare_digest.likeness(x[0], x[0]) == 1 and rare_digest.likeness(x[0], x[1]) > 0.4 > 0.1 > rare_digest.likeness(x[0], x[2])


# ---- 4 ---------------------------------------------------------------------------------------
def test_arc_versions_round_trip():
    blocks = [("http://a/ b", arc_convert.http_block("1", b"WARC/1.1\r\n\r\nx\n")), ("u", arc_convert.http_block(None, b""))]
    for v in (1, 2):
        info, *got = arc_convert.parse_arc(arc_convert.arc_file("f.arc", v, blocks))
        assert info["type"] == "version" and info["url"] == "filedesc://f.arc"
        assert [(g["url"], g["block"]) for g in got] == [("http://a/%20b", blocks[0][1]), ("u", blocks[1][1])]
    with pytest.raises(ValueError):
        list(arc_convert.parse_arc(arc_convert.arc_file("f.arc", 1, blocks)[:-3]))


def test_warc_of_pages(spark):
    pages = [(5, "http://e/5", "same"), (2, "http://e/2", "same"), (9, None, None), (1, "http://e/1", ""), (7, "http://e/7", "A\r\n\r\nWARC/1.1\r\n" * 400), (None, "http://e/n", "same"), (8, "http://e/8", "ñ" * 9), (4, "http://e/4", "twin"), (4, "http://e/4", "twin"), (None, None, "alone"), (None, None, "alone")]
    path = shared_dir(spark, "warc-test")
    arc_convert.convert(arc_convert.pages_to_arc(spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("key", F.lit(3)).repartition(3)), path)
    read = arc_convert.read_warc(spark, path)
    got = Counter((r.key, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in read.where("record_type <> 'warcinfo'").collect())
    first, done, want = {}, set(), Counter()
    for k, _, h in sorted(pages, key=lambda p: (p[0] is None, p[0] or 0)):
        first.setdefault(h or "", k)
    for k, _, h in pages:
        raw, f = (h or "").encode(), first[h or ""]
        mine = k == f and (h or "") not in done
        if mine:
            done.add(h or "")
        want[None if k is None else str(k), len(raw), arc_convert.sha1_base32(raw), "response" if mine else "revisit", None if mine else str(f or "")] += 1
    assert got == want
    payload = {r.key: bytes(r.payload) for r in arc_convert.read_warc(spark, path, True).where("record_type = 'response'").collect()}
    assert payload["7"] == pages[4][2].encode() and payload["2"] == b"same"
    assert read.where("record_type = 'warcinfo'").count() >= 1


def test_binary_payloads_and_blocks_without_header(spark):
    image = bytes(range(256)) * 3
    http = b"HTTP/1.0 200 OK\r\nX-Name: \xe9\r\nContent-Type: image/png\r\n\r\n" + image
    blocks = [("http://e/i", http), ("http://e/j", http), ("dns:e", b"20240102030405\ne. 1 IN A 0.0.0.0\n\xff"), ("http://e/old", b"<html>0.9</html>"), ("http://e/none", b"")]
    arcs = spark.createDataFrame([("a", arc_convert.arc_file("a.arc", 1, blocks[:3])), ("b", gzip.compress(arc_convert.arc_file("b.arc", 2, blocks[3:])))], "archive string, content binary")
    path = shared_dir(spark, "warc-binary")
    arc_convert.convert(arcs, path)
    got = {r.url: r for r in arc_convert.read_warc(spark, path, True).where("record_type <> 'warcinfo'").collect()}
    assert {u: r.record_type for u, r in got.items()} == {"http://e/i": "response", "http://e/j": "revisit", "dns:e": "resource", "http://e/old": "resource", "http://e/none": "resource"}
    assert bytes(got["http://e/i"].payload) == image and bytes(got["dns:e"].payload) == blocks[2][1] and got["http://e/j"].payload_bytes == len(image)
    assert got["http://e/j"].refers_to_id == got["http://e/i"].record_id and got["http://e/none"].payload_bytes == 0


def test_every_gzip_member_is_read(spark, tmp_path):
    block = arc_convert.http_block("1", b"x" * 3000)
    records = [arc_convert.to_warc({"url": f"u{k}", "date": arc_convert.ARC_DATE, "ip": "-", "type": "text/html", "block": block}) for k in range(3)]
    members = b"".join(gzip.compress(r) for r in records)
    assert b"".join(arc_convert.inflate(members, 100)) == b"".join(records)
    assert [f["WARC-Target-URI"] for f, _ in arc_convert.parse_warc(arc_convert.inflate(members))] == ["u0", "u1", "u2"]
    with pytest.raises(ValueError):
        list(arc_convert.inflate(members[:-9]))
    (tmp_path / "part-0.warc.gz").write_bytes(members)
    assert arc_convert.read_warc(spark, f"file://{tmp_path}").count() == 3
    big = b"\0" * (17 << 20)
    assert zlib.decompress(arc_convert.member(big) + b"\0", 31) == big


def test_pages_of_an_empty_table(spark):
    path = shared_dir(spark, "warc-empty")
    arc_convert.convert(arc_convert.pages_to_arc(spark.createDataFrame([], "page_id long, url string, html string")), path)
    assert arc_convert.read_warc(spark, path).count() == 0


# ---- 5 ---------------------------------------------------------------------------------------
def brute_word(v, word):
    s = "▁" + word

    def rec(i):
        if i == len(s):
            return 1.0
        t = math.exp(sum(v.by_byte[b] for b in s[i].encode())) * rec(i + 1)
        return t + sum(math.exp(v.by_piece[s[i:j]]) * rec(j) for j in range(i + 1, len(s) + 1) if s[i:j] in v.by_piece)

    return math.log10(rec(0))


def test_lattice_is_the_sum_over_all_segmentations():
    v = lattice_lm.Vocabulary(tokenizer_bytes(None, "piece_bpe_32k.model")).fit(np.arange(32000) % 50)
    for w in ("the", "a", "anouble.", "ça9🙂", "zzzz"):
        assert abs(v.word_log10(w) - brute_word(v, w)) < 1e-9


@pytest.mark.parametrize("head", [1, 20, 1 << 16])
def test_lm_scores(docs, rows, head):
    got = Counter()
    for r in lattice_lm.score(docs, head=head).collect():
        got[r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5), round(r.score, 4)] += 1
    words = [(i, low(t).encode().split()) for i, t, *_ in rows]
    train = Counter()
    for i, w in words:
        if not lattice_lm.held_out(i):
            train.update([*w, None])
    total, distinct = sum(train.values()), len(train)
    v = lattice_lm.Vocabulary(tokenizer_bytes(None, "piece_bpe_32k.model"))
    counts = v.counts([(w.decode(), c) for w, c in train.items() if w])
    counts[v.end] = train[None]
    v.fit(counts)
    want = Counter()
    for i, w in words:
        b = sum(math.log10((train[t] + 0.1) / (total + 0.1 * (distinct + 1))) for t in [*w, None])
        s = sum(v.word_log10(t.decode()) for t in w) + v.log_p[v.end] / math.log(10)
        want[i, lattice_lm.held_out(i), len(w) + 1, sum(train[t] > 0 for t in [*w, None]), total, round(b, 5), round(s, 4)] += 1
    assert got == want


# ---- 6 ---------------------------------------------------------------------------------------
def test_cuts_are_optimal():
    rng = np.random.default_rng(4)
    for _ in range(30):
        pos = np.concatenate([[0], np.cumsum(rng.integers(1, 7, 25))])
        pen = rng.integers(0, 4, len(pos)).astype(float)
        best = {0: 0.0}
        for j in range(1, len(pos)):
            best[j] = min(best[i] + 12 - (pos[j] - pos[i]) + pen[j] for i in range(j) if pos[j] - pos[i] <= 12)
        c = window_packing.cuts(pos, pen, 12)
        assert abs(sum(12 - (pos[b] - pos[a]) + pen[b] for a, b in zip(c, c[1:], strict=False)) - best[len(pos) - 1]) < 1e-9


def test_packing(docs, rows):
    from tokenizers import Tokenizer

    t = Tokenizer.from_str(tokenizer_bytes(None, "word_bpe_49k.json").decode())
    got = window_packing.pack(docs, with_ids=True).collect()
    by_seq, by_doc = {}, {}
    for r in got:
        assert zlib.crc32(bytes(r.ids)) == r.ids_crc32 and len(r.ids) == 4 * r.length
        by_seq.setdefault(r.sequence_id, []).append((r.offset, r.length))
        by_doc.setdefault(r.doc_id, []).append((r.start, bytes(r.ids), r.doc_tokens))
    for v in by_seq.values():
        end = 0
        for o, n in sorted(v):
            assert o == end
            end += n
        assert end <= 2048
    for i in {r[0] for r in rows} - {3}:
        want = b"".join(np.array([*t.encode(x or "", add_special_tokens=False).ids, 1], "<u4").tobytes() for k, x, *_ in rows if k == i)
        assert b"".join(x for _, x, _ in sorted(by_doc[i])) == want
    assert sum(r.length for r in got) == sum(len(t.encode(x or "", add_special_tokens=False).ids) + 1 for _, x, *_ in rows)


def test_packing_wastes_little(spark):
    rng = random.Random(8)
    texts = [(k, ". ".join(" ".join(rng.choice(["cat", "dog", "house"]) for _ in range(9)) for _ in range(rng.randrange(1, 60)))) for k in range(400)]
    p = window_packing.pack(spark.createDataFrame(texts, "doc_id long, text string").coalesce(1))
    s = p.groupBy("sequence_id").agg(F.sum("length").alias("n"))
    n, total = s.agg(F.count("*"), F.sum("n")).first()
    assert total / (2048 * n) > 0.97


# ---- 7 ---------------------------------------------------------------------------------------
def test_gradient_of_the_network():
    rng = np.random.default_rng(1)
    x = rng.integers(32, 120, (6, byte_cnn.CHUNK)).astype(np.uint8)
    of, y = np.array([0, 0, 1, 1, 1, 2]), np.array([1, 0, 1], np.float32)
    net = byte_cnn.Network()
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    rep = byte_cnn.repeats(x).astype(np.float64)

    def loss():
        h = np.maximum(net.conv(x, rep).max(axis=1), 0)
        pooled = np.stack([h[of == k].mean(axis=0) for k in range(3)])
        z = pooled @ net.p["v"] + net.p["c"]
        return float(np.mean(np.log1p(np.exp(-np.where(y == 1, z, -z)))) + 5e-5 * (net.p["v"] ** 2).sum())

    g = net.gradient(x, rep, of, y)
    for k, at in (("v", (3,)), ("b", (2,)), ("u", (1,)), ("w", (2, 3, 4)), ("emb", (int(x[0, 10]), 1))):
        keep = net.p[k][at]
        net.p[k][at] = keep + 1e-4
        up = loss()
        net.p[k][at] = keep - 1e-4
        down = loss()
        net.p[k][at] = keep
        assert abs((up - down) / 2e-4 - g[k][at]) < 2e-3 * max(1, abs(g[k][at]))


def test_tables_score_like_the_network():
    rng = np.random.default_rng(9)
    texts = [rng.integers(32, 126, n).astype(np.uint8) for n in (0, 3, 255, 256, 257, 2000)]
    off = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    net, tables = byte_cnn.unpacked(byte_cnn.packed(byte_cnn.Network()))
    got = byte_cnn.probabilities(np.concatenate(texts), off, net, tables)
    for t, g in zip(texts, got, strict=True):
        n, inner = byte_cnn.chunk_starts(np.array([len(t)]))
        assert int(n[0]) == 1 or inner[-1] + byte_cnn.CHUNK >= len(t)
        x = byte_cnn.gather(t, inner, np.full(len(inner), len(t)))
        h = np.maximum(net.conv(x, byte_cnn.repeats(x).astype(np.float32)).max(axis=1), 0).mean(axis=0)
        assert abs(1 / (1 + np.exp(-(h @ net.p["v"] + net.p["c"])[0])) - g) < 1e-4


def test_classifier_on_held_out_labels(spark, sf_dir):
    big = sf_dir.replace("0.001", "0.01")
    s = byte_cnn.op7_byte_cnn(spark, big).where("held_out").join(spark.read.parquet(f"{big}/labels.parquet"), "doc_id")
    n, right = s.agg(F.count("*"), F.sum((F.col("predicted") == F.col("quality")).cast("int"))).first()
    assert n > 50 and right / n > 0.93


def test_classifier_without_labels(docs, spark, rows):
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert byte_cnn.train(docs, none) == 0.5
    assert {r.score for r in byte_cnn.score(docs, 0.5).collect()} == {0.5}
    net = byte_cnn.packed(byte_cnn.Network())
    got = byte_cnn.score(docs, net).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    assert byte_cnn.score(docs.where("1 = 0"), net).count() == 0


# ---- 8 ---------------------------------------------------------------------------------------
def test_line_rules_counts(docs, rows):
    got = Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in line_rules.judge(docs).collect())
    want = Counter()
    for i, t, *_ in rows:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        tri = Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
        cover = {k + d for k in range(len(w) - 2) if tri[tuple(w[k : k + 3])] > 1 for d in range(3)}
        want[i, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(cover), len(w) < 50 or 100 * len(cover) > 50 * len(w)] += 1
    assert got == want


def brute_rules(rows):
    """doc_id -> (words removed, kept), by plain counting of documents and lines."""
    text = {i: (h, t or "") for i, t, h in rows}
    norm = lambda x: b" ".join(low(x).encode().split())
    lines = {i: Counter(norm(x) for x in t.split("\n") if norm(x)) for i, (_, t) in text.items()}
    holders = {}
    for i, c in lines.items():
        for x in c:
            holders.setdefault((text[i][0], x), set()).add(frozenset(c))
    out = {}
    for i, c in lines.items():
        n = sum(len(x.split()) * k for x, k in c.items())
        gone = sum(len(x.split()) * k for x, k in c.items() if len(holders[text[i][0], x]) >= line_rules.LEAST_DOCS)
        w = text[i][1].encode().split()
        tri = Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
        cover = {k + d for k in range(len(w) - 2) if tri[tuple(w[k : k + 3])] > 1 for d in range(3)}
        base = n < 50 or 100 * len(cover) > 50 * n
        out[i] = (gone, not base and not (gone and (n - gone < 50 or 100 * gone >= line_rules.DEPLETED_SHARE * n)))
    return out


def test_method_verdicts_against_plain_counting(spark, sf_dir):
    big = sf_dir.replace("0.001", "0.01")
    d = spark.read.parquet(f"{big}/documents.parquet")
    got = {r.doc_id: (r.n_removed_words, r.kept, r.base_failed) for r in line_rules.op8_line_rules(spark, big).collect()}
    want = brute_rules([(r.doc_id, r.text, r.source) for r in d.collect()])
    assert {k: v[:2] for k, v in got.items()} == want
    assert any(not kept and not base for _, kept, base in got.values())  # by the method alone


def test_common_lines_go_and_copies_stay(spark):
    rng = random.Random(2)
    uniq = lambda n: " ".join(f"w{rng.randrange(10**9)}" for _ in range(n))
    boiler = [uniq(40) for _ in range(3)]
    rows = [(k, "\n".join([*boiler, uniq(4)]), "a") for k in range(30)] + [(100 + k, uniq(70), "a") for k in range(20)]
    copy = "\n".join(uniq(12) for _ in range(8))
    rows += [(200 + k, copy, "a") for k in range(50)]
    got = {r.doc_id: r.kept for r in line_rules.judge(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert not any(got[k] for k in range(30)) and all(got[k] for k in got if k >= 100)


def test_lines_are_counted_by_document(spark):
    """Different short documents that share a line with a low hash are not one document."""
    rng = random.Random(5)
    uniq = lambda n: " ".join(f"w{rng.randrange(10**9)}" for _ in range(n))
    common = min((uniq(8) for _ in range(3000)), key=lambda x: hashlib.md5(x.encode()).digest())
    rows = [(k, "\n".join([common, *(uniq(12) for _ in range(5))]), "a") for k in range(40)]
    got = line_rules.judge(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert [r.n_removed_words for r in got] == [8] * 40


def test_repeated_lines_go_in_hosts_of_every_size(spark):
    rng = random.Random(6)
    uniq = lambda n: " ".join(f"w{rng.randrange(10**9)}" for _ in range(n))
    rows, want = [], {}
    for host in (15, 150, 1500):
        line = uniq(9)
        for k in range(host):
            want[len(rows)] = 9 if k < 12 else 0
            rows.append((len(rows), "\n".join([*([line] if k < 12 else []), *(uniq(12) for _ in range(5))]), f"h{host}"))
    got = line_rules.judge(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert {r.doc_id: r.n_removed_words for r in got} == want


def test_lines_above_the_limit_leave_the_text(spark):
    rng = random.Random(8)
    uniq = lambda n: " ".join(f"w{rng.randrange(10**9)}" for _ in range(n))
    rows, want = [], {}
    for k in range(24):
        a, b, c = uniq(30), uniq(30), uniq(30)
        copies = 1 if k % 2 else 2
        text = "\n".join([f"{a}  é", *["\t All  Rights RÉserved \r"] * copies, "", b, "all rights rÉserved", c]) if k < 20 else f"{a}\n{b}\n\n{c}\n"
        want[k] = f"{a}  é\n\n{b}\n{c}" if k < 20 else text
        rows.append((k, text, "a" if k < 23 else None, len(text), k))
    got = {r.doc_id: r for r in line_rules.filter_documents(spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long, removed_keys long")).collect()}
    assert {k: r.text for k, r in got.items()} == want
    assert all(r.n_chars == len(r.text) and r.removed_keys == k for k, r in got.items())


# ---- 9 ---------------------------------------------------------------------------------------
def test_encoding_equals_the_library(docs, rows):
    enc = merge_prefix.MergePrefixEncoder(tokenizer_bytes(None, "piece_bpe_32k.model"))
    rng = random.Random(6)
    letters = "ab the in ▁ \n\t éñß中\x00<>0x0A19 ingtion😀"
    for t in [*((r[1] or "") for r in rows), *("".join(rng.choice(letters) for _ in range(rng.randrange(50))) for _ in range(3000))]:
        ids, s = enc.encode(t)
        assert ids == enc.sp.encode(t, add_eos=True) and s == " ".join(map(str, ids))
    got = Counter(map(tuple, merge_prefix.encode_table(docs).collect()))
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    want = Counter()
    for i, t, *_ in rows:
        ids = enc.sp.encode(t or "", add_eos=True)
        want[i, len(ids), sha(" ".join(map(str, ids))), sha(enc.sp.decode(ids))] += 1
    assert got == want


# ---- 10 --------------------------------------------------------------------------------------
def test_cached_ids_equal_the_library(rows):
    many = chunk_cache.ByteIds(tokenizer_bytes(None, "byte_bpe_50k.json"), 500)
    word = chunk_cache.WordIds(tokenizer_bytes(None, "word_bpe_49k.json"), 500)
    rng = random.Random(7)
    letters = [*"ab the's  \n\n\t\r éñÉßªµ中12.,!\x1c\x85\xa0İſǅ\u0301\u3000\u200b", "<|endoftext|>", " the", "'ll", "s. A"]
    texts = [*((r[1] or "") for r in rows), *("".join(rng.choice(letters) for _ in range(rng.randrange(40))) for _ in range(4000))]
    ids = lambda t, x: np.array(t.encode(x, add_special_tokens=False).ids)
    for a in range(0, len(texts), 50):
        part = texts[a : a + 50]
        assert many(part) == [ids(many.t, x).astype("<u2").tobytes() for x in part]
        assert word([x.encode() for x in part]) == [ids(word.t, x).astype("<u4").tobytes() for x in part]


def test_short_pieces_are_found_without_a_step_each(monkeypatch):
    """No dictionary is asked for short pieces; at, below and above the longest; NULs; a full table."""
    many = chunk_cache.ByteIds(tokenizer_bytes(None, "byte_bpe_50k.json"), 100)
    rng = random.Random(11)
    word = lambda n: "".join(rng.choice("abcdeéß中\x00'.9") for _ in range(n))
    texts = ["", " ", "\n", "a" * 23, "a" * 24, " " + "a" * 23, " " + "a" * 24, "a" * 25 + ".", " a\x00", " a", " a\x00\x00", "\x00", ""]
    texts += [rng.choice([" ", "\n", "  ", "\n\n", ""]).join(word(rng.randrange(1, 30)) for _ in range(rng.randrange(40))) for _ in range(300)]
    for part in (texts, texts[::-1], texts[:3], [], [""]):
        assert many(part) == [np.array(many.t.encode(x, add_special_tokens=False).ids, "<u2").tobytes() for x in part]
    few = [" ".join(word(rng.randrange(1, 5)) for _ in range(50)) for _ in range(20)]
    monkeypatch.setattr(many.known, "join", None)
    for _ in range(2):
        assert many(few) == [np.array(many.t.encode(x, add_special_tokens=False).ids, "<u2").tobytes() for x in few]
    assert 0 < many.short.n


def test_crc_of_parts():
    rng = np.random.default_rng(3)
    parts = [[rng.bytes(int(n)) for n in rng.integers(0, 90, 5)] for _ in range(8)]
    got = token_store.combined_crc([np.array([zlib.crc32(p) for p in x]) for x in parts], [np.array([len(p) for p in x]) for x in parts])
    assert got == [zlib.crc32(b"".join(x)) for x in parts]


def test_chunks_move_with_their_content():
    rng = np.random.default_rng(5)
    ids = rng.integers(0, 50000, 20000)
    a = token_store.chunk_ends(ids)
    b = token_store.chunk_ends(np.concatenate([rng.integers(0, 50000, 777), ids]))
    assert a[-1] == 20000 and all(token_store.LEAST <= y - x <= token_store.MOST for x, y in zip([0, *a], a[:-1], strict=False))
    assert len(set(a) & {x - 777 for x in b}) > 0.8 * len(a)


def test_token_store(spark, docs, rows):
    path = shared_dir(spark, "store-test")
    token_store.write_store(docs, path)
    t = chunk_cache.plain_tokenizer(tokenizer_bytes(None, "byte_bpe_50k.json"))
    exact = lambda x: np.array(t.encode(x, add_special_tokens=False).ids).astype("<u4").tobytes()
    got = {r.start: r for r in token_store.read_documents(spark, path).collect()}
    ids = {r.start: bytes(r.ids) for r in token_store.restore(spark, path).collect()}
    assert len(got) == len(rows) and token_store.verify_manifest(spark, path).count() == 0
    want = {}
    for i, x, *_ in rows:
        want.setdefault(i, []).append(exact(x or "") + (2).to_bytes(4, "little"))
    at = 0
    for start in sorted(got):
        r = got[start]
        x = ids[start]
        assert start == at and x in want[r.doc_id] and (r.n_tokens, r.ids_crc32) == (len(x) // 4, zlib.crc32(x))
        want[r.doc_id].remove(x)
        at += r.n_tokens
    order = [got[s].doc_id for s in sorted(got)]
    assert order == sorted(order, key=lambda k: (k is not None, k or 0))


def test_a_lost_or_swapped_recipe_is_noticed(spark, docs):
    path = shared_dir(spark, "store-lost")
    token_store.write_store(docs, path)
    whole = token_store.recipes(spark, path).collect()
    some = spark.createDataFrame([r for r in whole if r.doc_id != 5], token_store.recipes(spark, path).schema)
    some.write.mode("overwrite").parquet(f"{path}/recipes")
    with pytest.raises(ValueError):
        token_store.read_documents(spark, path)


def test_the_manifest_is_a_tree_over_all_roots(spark, docs, monkeypatch):
    monkeypatch.setattr(token_store, "RUN", 1)
    path = shared_dir(spark, "store-tree")
    token_store.write_store(docs, path)
    r = sorted(token_store.recipes(spark, path).collect(), key=lambda x: x.start)
    m = spark.read.parquet(f"{path}/manifest").collect()
    by = {}
    for x in r:
        by.setdefault(x.bucket, {}).setdefault(x.run, []).append(bytes(x.root))
    runs = {b: [token_store.merkle(by[b][k]) for k in sorted(by[b])] for b in sorted(by)}
    assert all(len(v) <= 1 for b in by.values() for v in b.values()) and max(map(len, runs.values())) > 1
    top = token_store.merkle([token_store.merkle(v) for v in runs.values()])
    (all_,) = [x for x in m if x.level == 2]
    assert bytes(all_.root) == top and all_.n_docs == len(r) and all_.n_tokens == sum(x.n_tokens for x in r)
    assert {(x.bucket, x.run): bytes(x.root) for x in m if x.level == 0} == {(b, k): token_store.merkle(v) for b in by for k, v in by[b].items()}


def test_empty_store(spark, empty):
    path = shared_dir(spark, "store-empty")
    token_store.write_store(empty, path)
    assert token_store.read_documents(spark, path).count() == 0


def test_added_tokens_in_texts(spark):
    """The library's own call decides, for marks in any case, alone, doubled or inside words."""
    from public_tokenizers import path
    from tokenizers import Tokenizer

    marks = ["<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "<|endoftext", "<unk>", "</s>"]
    texts = [x for m in marks for x in (m, f"hello {m} world", f"a{m}b {m}{m}.", f"\n {m}\tÉa {m} ", f"x  y\n\n{m}")]
    for name, kind in (("word_bpe_49k.json", chunk_cache.WordIds), ("byte_bpe_50k.json", chunk_cache.ByteIds)):
        fresh = Tokenizer.from_file(str(path(name)))
        with open(path(name), "rb") as f:
            mine = kind(f.read())
        got = mine([x.encode() for x in texts] if kind is chunk_cache.WordIds else texts)
        for x, ids in zip(texts, got, strict=True):
            assert np.frombuffer(ids, "<u4" if kind is chunk_cache.WordIds or mine.kind == "I" else "<u2").tolist() == fresh.encode(x, add_special_tokens=False).ids, x
