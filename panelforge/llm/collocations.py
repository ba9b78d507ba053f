"""Phrase collocation mining: phrases of several words that occur together far more often than
their parts would by chance.

A first pass puts the hashes of all runs of one to ``LONGEST`` words, per language, into a sketch;
its counts are upper bounds.  A second pass takes, in each shard of texts, the runs whose bucket
and whose shorter runs reach the threshold, compiles them into Aho-Corasick automata over words
guarded by delimiters, and counts all overlapping matches.  The counts of a task's
shards, packed by bucket of phrases, are summed in the task that a bucket is dealt to, and held
against the threshold, so hash collisions change nothing.  An automaton holds at most
``PATTERNS`` phrases of one shard: neither the number of candidates nor the table's size enters a
task's memory.

Defined results: a null text is empty; a null language counts with ``und``; ids play no part, and
repeated rows count each; an empty table gives no rows; other columns are ignored.  A shard is cut
between documents only, so memory grows with the longest document.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from operator import itemgetter

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import LOWER, map_batches, mix, partitions, span_hash, text_bytes, word_spans, written
from .sketch import bits_for, gathered, heavy_buckets, passes

LEAST = 100
LONGEST = 5
COVERED_PERCENT = 100
UNIT = 1000
TOP = 2000
SHARD = 4 << 20
PATTERNS = 50_000
#: Phrases that a task holds before it sends their counts; buckets of phrases a partition.
HELD, BUCKETS = 400_000, 16
#: Languages whose totals are broadcast.
SENT_LANGUAGES = 100_000
#: What ends a piece, what parts words.
ENDS, GAPS = b".,;:!?\n\x0b\x0c\r", b" \t"
_END = np.zeros(256, bool)
_END[list(ENDS)] = True
_OUTSIDE = _END.copy()
_OUTSIDE[list(GAPS)] = True
_TO_LINE = bytes(10 if _END[c] else 32 if _OUTSIDE[c] else int(LOWER[c]) for c in range(256))
_STEP = np.uint64(0x9E3779B97F4A7C15)
Batches = Iterator[pa.RecordBatch]


def _runs(b: pa.RecordBatch, longest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
    """Starts and ends of a block's words, and per length the hash of the run that starts at each
    word (0 where a run leaves its piece)."""
    data, off = text_bytes(b.column("text"))
    low = LOWER[data]
    start, end, first = word_spans(low, off, _OUTSIDE)
    doc = np.repeat(np.arange(len(off) - 1), np.diff(first))
    piece = np.cumsum(_END[low], dtype=np.int64)[start] + doc if len(start) else doc
    names = {x: int.from_bytes(hashlib.md5(x.encode()).digest()[:8], "big") for x in set(b.column("lang").to_pylist())}
    seed = np.array([names[x] for x in b.column("lang").to_pylist()], np.uint64)
    word = span_hash(low, start, end)
    g = mix(word ^ seed[doc]) if len(doc) else word
    out = [np.where(g == 0, np.uint64(1), g)]
    for m in range(2, longest + 1):
        g = np.zeros_like(word)
        n = len(word) - m + 1
        if n > 0:
            h = mix(out[-1][:n] * _STEP + word[m - 1 :])
            g[:n] = np.where((piece[:n] == piece[m - 1 :]) & (h != 0), h, np.uint64(0))
        out.append(g)
    return low, start, end, out


def automata(phrases: list[str], size: int = PATTERNS) -> Iterator[tuple[list[str], ahocorasick.Automaton]]:
    """Automata of at most ``size`` phrases each, guarded by a space on both sides."""
    phrases.sort()  # neighbours share their beginnings
    for x in range(0, len(phrases), size):
        part = phrases[x : x + size]
        a = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for i, p in enumerate(part):
            a.add_word(f" {p} ", i)
        a.make_automaton()
        yield part, a


def guarded(raw: bytes) -> str:
    """Lower-cased words with single spaces around them; a line break between pieces."""
    text = re.sub(rb" *\n[ \n]*", b" \n ", raw.translate(_TO_LINE))
    return " " + re.sub(rb" +", b" ", text).decode() + " "


def count_in(raw: bytes, phrases: list[str], size: int = PATTERNS) -> Iterator[tuple[list[str], np.ndarray]]:
    """Phrases with how often each occurs, overlaps included."""
    text = guarded(raw)
    for part, a in automata(phrases, size):
        yield part, np.bincount(np.fromiter(map(itemgetter(1), a.iter(text)), np.int64), minlength=len(part))


def phrase_counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = LEAST, longest: int = LONGEST, bits: int | None = None, patterns: int = PATTERNS) -> DataFrame:
    """(lang, phrase, n) of all phrases of up to ``longest`` words that occur ``least`` times in a
    language; phrase '' has the number of its words."""
    d = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    bits = bits or bits_for(d, "text")

    def hashes(b: pa.RecordBatch) -> np.ndarray:
        g = np.concatenate(_runs(b, longest)[-1])
        return g[g != 0]

    bitmap = d.sparkSession.sparkContext.broadcast(heavy_buckets(d, lambda x: gathered(x, "text"), hashes, bits, least)[0])

    def candidates(b: pa.RecordBatch, often: np.ndarray) -> list[str]:
        """The distinct runs of a shard, of one language, that may be frequent."""
        low, start, end, runs = _runs(b, longest)
        raw, out = low.tobytes(), []
        shorter = np.zeros(0, bool)
        for m, g in enumerate(runs, 1):
            ok = (g != 0) & passes(often, g, bits)
            if m > 1:  # both shorter runs in it must be frequent
                ok[:-1] &= shorter[:-1] & shorter[1:]
                ok[-1:] = False
            shorter = ok
            at = np.flatnonzero(ok)
            at = at[np.unique(g[at], return_index=True)[1]]
            for x, y in zip(start[at].tolist(), end[at + m - 1].tolist(), strict=True):
                out.append(re.sub(rb"[ \t]+", b" ", raw[x:y]).decode())
        return out

    n_buckets = BUCKETS * partitions(d.sparkSession)

    def packed(held: dict[str, dict[str, int]]) -> Batches:
        """The counts so far, a row per bucket of phrases and language."""
        rows = []
        for lang, counts in held.items():
            phrases, n = list(counts), np.array(list(counts.values()), np.int64)
            to = np.array([zlib.crc32(p.encode()) % n_buckets for p in phrases])
            order = np.argsort(to, kind="stable")
            for part in np.split(order, np.flatnonzero(np.diff(to[order])) + 1):
                rows.append((int(to[part[0]]), lang, "\n".join([phrases[i] for i in part.tolist()]), n[part].tobytes()))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.string(), pa.string(), pa.binary()), strict=True)], ["bucket", "lang", "phrases", "n"])

    def run(batches: Batches) -> Batches:
        often, held, size = np.frombuffer(bitmap.value, np.uint8), {}, 0
        for whole in gathered(batches, "text", SHARD):
            langs = np.array(whole.column("lang").to_pylist(), object)
            for lang in dict.fromkeys(langs.tolist()):
                b = whole.filter(pa.array(langs == lang))
                data, off = text_bytes(b.column("text"))
                counts = held.setdefault(lang, {"": 0})
                counts[""] += len(word_spans(data, off, _OUTSIDE)[0])
                phrases = candidates(b, often)
                if not phrases:
                    continue
                before = len(counts)
                raw = data.tobytes()
                texts = b"\n".join(raw[x:y] for x, y in zip(off.tolist(), off[1:].tolist(), strict=False))
                for part, n in count_in(texts, phrases, patterns):
                    for p, k in zip(part, n.tolist(), strict=True):
                        counts[p] = counts.get(p, 0) + k
                size += len(counts) - before
            if size > HELD:
                yield from packed(held)
                held, size = {}, 0
        yield from packed(held)

    def add(batches: Batches) -> Batches:
        """Sums of one bucket after the other; phrases that reach the threshold go on."""
        at, held = None, {}

        def out() -> Batches:
            for lang, counts in held.items():
                some = [(p, n) for p, n in counts.items() if n >= least or not p]
                if some:
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(some), pa.string()), pa.array([p for p, _ in some], pa.string()), pa.array([n for _, n in some], pa.int64())], ["lang", "phrase", "n"])

        for b in batches:
            for bucket, lang, phrases, n in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if bucket != at:
                    yield from out()
                    at, held = bucket, {}
                counts = held.setdefault(lang, {})
                for p, k in zip(phrases.split("\n"), np.frombuffer(n, np.int64).tolist(), strict=True):
                    counts[p] = counts.get(p, 0) + k
        yield from out()

    rows = map_batches(d, run, "bucket int, lang string, phrases string, n binary")
    return map_batches(rows.repartition(partitions(d.sparkSession), "bucket").sortWithinPartitions("bucket"), add, "lang string, phrase string, n long")


def score(counts: DataFrame, percent: int = COVERED_PERCENT) -> DataFrame:
    """(lang, phrase, a, l, r, n, score) of the phrases of two words or more at their weakest cut,
    without those that a longer phrase covers.  Products are decimals of 38 digits."""
    words = F.split("phrase", " ")
    total = counts.where("phrase = ''").select("lang", F.col("n").alias("total"))
    known = counts.where("phrase <> ''").select("lang", "phrase", F.col("n").alias("a"))
    c = known.withColumn("w", words).where(F.size("w") > 1)
    cut = F.explode(F.sequence(F.lit(1), F.size("w") - 1)).alias("k")
    each = c.select("lang", "phrase", "a", "w", cut)
    each = each.select("lang", "phrase", "a", "k", F.array_join(F.slice("w", F.lit(1), F.col("k")), " ").alias("head"), F.array_join(F.slice("w", F.col("k") + 1, F.size("w")), " ").alias("tail"))
    each = each.join(known.select("lang", F.col("phrase").alias("head"), F.col("a").alias("l")), ["lang", "head"])
    each = each.join(known.select("lang", F.col("phrase").alias("tail"), F.col("a").alias("r")), ["lang", "tail"])
    each = each.join(F.broadcast(total) if total.count() <= SENT_LANGUAGES else total, "lang")
    wide = lambda x: F.col(x).cast("decimal(19,0)")
    each = each.withColumn("top", (wide("a") * wide("total")).cast("decimal(34,0)") * F.lit(UNIT).cast("decimal(4,0)")).withColumn("base", (wide("l") * wide("r")).cast("decimal(38,0)"))
    each = each.withColumn("score", F.expr("cast(top as decimal(38,0)) div base"))
    weakest = each.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r", "total")).alias("x"))
    # of the longer phrases, those with one word more decide: their parts are frequent as well
    inner = F.explode(F.array(F.slice("w", F.lit(1), F.size("w") - 1), F.slice("w", F.lit(2), F.size("w") - 1))).alias("part")
    longer = c.where(F.size("w") > 2).select("lang", "a", inner).groupBy("lang", F.array_join("part", " ").alias("phrase")).agg(F.max("a").alias("longer"))
    out = weakest.join(longer, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (100 * F.col("longer") < percent * F.col("a")))
    return out.select("lang", "phrase", "a", "x.l", "x.r", F.col("x.total").alias("n"), "x.score")


def mine(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = LEAST, longest: int = LONGEST, percent: int = COVERED_PERCENT, top: int | None = None, **how) -> DataFrame:
    """Scored phrases, ranked per language; ``top``: only the first ones."""
    counts = written(phrase_counts(docs, text_col, lang_col, least, longest, **how), "collocations")
    w = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    out = score(counts, percent).withColumn("rank", F.row_number().over(w).cast("long"))
    out = out if top is None else out.where(F.col("rank") <= top)
    return out.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mine(spark.read.parquet(f"{sf_dir}/documents.parquet"), top=TOP)


ORACLE_OP11 = rf"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, 'und') AS lang, string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]') AS pieces FROM documents),
p AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM (SELECT lang, unnest(pieces) AS piece FROM d)),
total AS (SELECT lang, sum(len(w))::BIGINT AS n FROM p GROUP BY lang),
g AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM p),
f AS (SELECT lang, phrase, m, count(*) AS a FROM (SELECT lang, m, array_to_string(w[i:i + m - 1], ' ') AS phrase FROM g CROSS JOIN range(1, {LONGEST + 1}) t(m) WHERE i + m - 1 <= len(w)) GROUP BY ALL HAVING count(*) >= {LEAST}),
c AS (SELECT lang, phrase, m, a, string_split(phrase, ' ') AS w FROM f WHERE m > 1),
k AS (SELECT lang, phrase, m, a, w, unnest(range(1, m)) AS k FROM c),
s AS (SELECT k.lang, k.phrase, k.m, k.a, k.k, x.a AS l, y.a AS r, n, (({UNIT}::HUGEINT * k.a * n) // (x.a::HUGEINT * y.a))::BIGINT AS score
      FROM k JOIN f x ON x.lang = k.lang AND x.phrase = array_to_string(k.w[1:k.k], ' ') JOIN f y ON y.lang = k.lang AND y.phrase = array_to_string(k.w[k.k + 1:], ' ') JOIN total ON total.lang = k.lang),
best AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
sub AS (SELECT lang, a, array_to_string(w[i:i + q - 1], ' ') AS phrase FROM (SELECT lang, a, w, m, q, unnest(range(1, m - q + 2)) AS i FROM c CROSS JOIN range(2, {LONGEST}) t(q) WHERE q < m)),
cover AS (SELECT lang, phrase, max(a) AS longer FROM sub GROUP BY ALL)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM best LEFT JOIN cover USING (lang, phrase) WHERE longer IS NULL OR 100 * longer < {COVERED_PERCENT} * a
QUALIFY row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) <= {TOP}"""

QUERIES = {"op11_collocations": op11_collocations}
ORACLE = {"op11_collocations": ORACLE_OP11}
