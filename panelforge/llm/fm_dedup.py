"""Substring removal: words inside a window of ``WINDOW`` words that occurs earlier in the corpus,
found by backward search in compressed FM-indexes.

A window's anchor is its smallest ``GRAM``-word hash; neighbouring windows with one anchor form a
segment.  Equal windows have equal anchors, at equal places, so segments are dealt to index shards
by their anchors, and a window's copies meet in one shard.  A sketch of anchor counts first drops
the segments whose anchor is unique.  Equal segments are made one before they are dealt, with the
place of the first; an anchor with one segment left has no further windows to look for, so only
segments of the others, by a second sketch, travel with their words.  A shard puts its segments, in order of those places, into one word sequence,
builds its FM-index (a wavelet matrix over the Burrows-Wheeler transform, bits packed 64 to a word
with running counts), and streams the segments against it: backward search gives every window's
matching statistic, capped at the window's length, and its interval of suffixes; a window that
reaches the threshold with an earlier suffix in its interval is reported.

An anchor that occurs ``OFTEN`` times (a passage in a third of all documents) is not a shard's
group: its windows stand each for themselves, with their own hash as the anchor, so equal ones
become one before any shard sees them.  No group of rows is then larger than ``OFTEN``.

Order: smaller id first, null ids last, equal ids by a hash of the text.  Defined results: rows
equal in id and text are one document and get the same result; a null or empty text has no words;
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import blocks, dropped, map_batches, mix, release, span_hash, text_bytes, tune, word_spans, written
from .sketch import bits_for, gathered, heavy_buckets, many_rows, passes

WINDOW = 20
GRAM = 6
OFTEN = 2000
#: Segments of an index shard, about.
SHARD_SEGMENTS = 6000
BLOCK = 4 << 20
_STEP = np.uint64(0xD6E8FEB86659FD93)
KEY = ("nul", "did", "tag")
Batches = Iterator[pa.RecordBatch]


# ---- the index -------------------------------------------------------------------------------
class WaveletMatrix:
    """Rank of symbols in a sequence: one packed bit vector per bit of a symbol."""

    def __init__(self, seq: np.ndarray, sigma: int):
        self.n = len(seq)
        self.depth = max(1, int(sigma - 1).bit_length())
        self.bits, self.ones, self.zeros = [], [], []
        for k in range(self.depth - 1, -1, -1):
            b = (seq >> k & 1).astype(bool)
            packed = np.zeros((self.n >> 6) + 1, np.uint64)
            packed.view(np.uint8)[: (self.n + 7) >> 3] = np.packbits(b, bitorder="little")
            count = np.zeros(len(packed) + 1, np.int32)
            np.cumsum(np.bitwise_count(packed), out=count[1:])
            self.bits.append(packed)
            self.ones.append(count)
            self.zeros.append(self.n - int(count[-1]))
            seq = np.concatenate([seq[~b], seq[b]])

    def _ones(self, level: int, at: np.ndarray) -> np.ndarray:
        """Set bits before each place."""
        w = at >> 6
        below = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.ones[level][w] + np.bitwise_count(self.bits[level][w] & below)

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(start of the symbol's run, occurrences before each place)."""
        first = np.zeros_like(at)
        for level in range(self.depth):
            one = (symbol >> (self.depth - 1 - level) & 1).astype(bool)
            a, f = self._ones(level, at), self._ones(level, first)
            at = np.where(one, self.zeros[level] + a, at - a)
            first = np.where(one, self.zeros[level] + f, first - f)
        return first, at - first


def suffixes(text: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes sorted by their first ``depth`` symbols (or more), by doubling."""
    rank, k = text.astype(np.int64), 1
    n = len(rank)
    while True:
        key = rank * (n + 2)
        key[: n - k] += rank[k:] + 1
        order = np.argsort(key, kind="stable")
        new = np.concatenate([[0], np.cumsum(key[order][1:] != key[order][:-1])])
        rank = np.empty(n, np.int64)
        rank[order] = new
        k *= 2
        if k >= depth or new[-1] == n - 1:
            return order


class FMIndex:
    """Backward search over a sequence of symbols from 1; ``depth`` bounds the patterns' length."""

    def __init__(self, text: np.ndarray, depth: int):
        text = np.append(text, 0)
        self.sa = suffixes(text, depth)
        self.bwt = WaveletMatrix(text[self.sa - 1], int(text.max()) + 1)
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text))])

    def search(self, text: np.ndarray, end: np.ndarray, longest: int, alone: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Matching statistics of the patterns that end before ``end`` in ``text``: how many symbols
        match backwards, ``longest`` at most, with the interval of suffixes.  A pattern whose
        interval is no larger than ``alone`` (its own occurrence) is not followed further."""
        m = len(end)
        lo, hi, length = np.zeros(m, np.int64), np.full(m, len(self.sa), np.int64), np.zeros(m, np.int64)
        live = np.arange(m)
        for step in range(1, longest + 1):
            c = text[end[live] - step]
            _, a = self.bwt.rank(c, lo[live])
            _, b = self.bwt.rank(c, hi[live])
            a, b = self.first[c] + a, self.first[c] + b
            more = b - a > alone
            live = live[more]
            lo[live], hi[live], length[live] = a[more], b[more], step
            if not len(live):
                break
        return length, lo, hi


def earlier(words: list[list[bytes]], window: int) -> list[np.ndarray]:
    """For segments in corpus order, which of their windows occur in an earlier place."""
    flat = [w for s in words for w in [*s, None]]
    ids = {w: i for i, w in enumerate(dict.fromkeys(w for w in flat if w is not None), 2)}
    text = np.array([1 if w is None else ids[w] for w in flat], np.int64)  # 1 ends a segment
    sizes = np.array([len(s) for s in words])
    base = np.concatenate([[0], np.cumsum(sizes + 1)])[:-1]
    runs = sizes - window + 1
    start = np.repeat(base - np.concatenate([[0], np.cumsum(runs)[:-1]]), runs) + np.arange(runs.sum())
    index = FMIndex(text, window)
    length, lo, _ = index.search(text, start + window, window)
    found = np.flatnonzero(length >= window)
    seen = np.zeros(len(start), bool)
    if len(found):
        # equal windows share an interval: the smallest of their places is the first
        u, which = np.unique(lo[found], return_inverse=True)
        first = np.full(len(u), len(text), np.int64)
        np.minimum.at(first, which, start[found])
        seen[found] = start[found] > first[which]
    return np.split(seen, np.cumsum(runs)[:-1])


# ---- segments --------------------------------------------------------------------------------
def _segments(data: np.ndarray, off: np.ndarray, window: int, gram: int) -> tuple:
    """Word spans of a block, their hashes, and its segments: document, first window, windows, anchor."""
    start, end, first = word_spans(data, off)
    h = span_hash(data, start, end)
    n = len(h) - window + 1
    none = np.zeros(0, np.int64)
    if n < 1:
        return start, end, first, h, none, none, none, np.zeros(0, np.uint64)
    doc = np.repeat(np.arange(len(off) - 1), np.diff(first))
    g = h
    for k in range(1, gram):
        g = mix(g[:-1] * _STEP + h[k:])
    at = np.lib.stride_tricks.sliding_window_view(g, window - gram + 1).argmin(1) + np.arange(n)
    whole = doc[:n] == doc[window - 1 :]
    i = np.flatnonzero(whole)
    if not len(i):
        return start, end, first, h, none, none, none, np.zeros(0, np.uint64)
    new = np.flatnonzero(np.concatenate([[True], (at[i[1:]] != at[i[:-1]]) | (i[1:] != i[:-1] + 1)]))
    head = i[new]
    return start, end, first, h, doc[head], head, np.diff(np.append(new, len(i))), mix(g[at[head]])  # mixed: smallest hashes crowd


def _double_hash(h: np.ndarray, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of the word hashes h[x:y]: two sums with powers of different bases."""
    out = []
    for base in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F):
        base |= 1
        power, back = (np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(len(h), b, np.uint64)])) for b in (base, pow(base, -1, 1 << 64)))
        c = np.concatenate([[np.uint64(0)], np.cumsum(mix(h + np.uint64(base)) * power[:-1])])
        out.append(mix((c[y] - c[x]) * back[x] + (y - x).astype(np.uint64)).view(np.int64))
    return out[0], out[1]


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    t = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    i = F.col(id_col).cast("long")
    return docs.select(i.isNull().alias("nul"), F.coalesce(i, F.lit(0)).alias("did"), F.xxhash64(t).alias("tag"), t.alias("text"))


def segments(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, often: int = OFTEN, bits: int | None = None) -> DataFrame:
    """Segments whose anchor may occur twice: 128-bit hash, anchor, words (once a block for equal
    ones), place and windows; ``docs`` as made by ``_keyed``."""
    bits = bits or bits_for(docs, "text")

    def anchors(b: pa.RecordBatch) -> np.ndarray:
        return _segments(*text_bytes(b.column("text")), window, gram)[-1]

    maps = [docs.sparkSession.sparkContext.broadcast(m) for m in heavy_buckets(docs, lambda x: gathered(x, "text"), anchors, bits, 2, often)]

    def run(batches: Batches) -> Batches:
        twice, many = (np.frombuffer(m.value, np.uint8) for m in maps)
        for b in gathered(batches, "text", BLOCK):
            data, off = text_bytes(b.column("text"))
            start, end, first, h, doc, head, runs, anchor = _segments(data, off, window, gram)
            keep = passes(twice, anchor, bits)
            doc, head, runs, anchor = doc[keep], head[keep], runs[keep], anchor[keep]
            if not len(head):
                continue
            alone = passes(many, anchor, bits)
            if alone.any():  # windows of very frequent anchors stand for themselves
                times = np.where(alone, runs, 1)
                step = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
                doc, head, anchor, alone = (np.repeat(x, times) for x in (doc, head + 0, anchor, alone))
                head, runs = head + step, np.where(alone, 1, np.repeat(runs, times))
            stop = head + runs + window - 1
            h1, h2 = _double_hash(h, head, stop)
            anchor = np.where(alone, h1, anchor.view(np.int64))
            once = np.zeros(len(head), bool)
            once[np.unique(h1, return_index=True)[1]] = True
            raw = data.tobytes()
            text = [b" ".join(raw[x:y].split()) if o else None for x, y, o in zip(start[head].tolist(), end[stop - 1].tolist(), once.tolist(), strict=True)]
            key = [b.column(c).take(pa.array(doc)) for c in KEY]
            yield pa.RecordBatch.from_arrays([pa.array(h1), pa.array(h2), pa.array(anchor), pa.array(text, pa.binary()), *key, pa.array((head - first[doc]).astype(np.int32)), pa.array(runs.astype(np.int32))], ["h1", "h2", "anchor", "words", *KEY, "start", "runs"])

    return map_batches(docs, run, "h1 long, h2 long, anchor long, words binary, nul boolean, did long, tag long, start int, runs int")


def _distinct(segs: DataFrame, *more) -> DataFrame:
    """Equal segments as one: the first place, the number of copies, the anchor."""
    place = F.struct(*KEY, "start")
    one = segs.groupBy("h1", "h2").agg(F.min(place).alias("place"), F.count("*").alias("copies"), F.first("anchor").alias("anchor"), *more)
    return one.select("h1", "h2", "place.*", "copies", "anchor", *[c for c in one.columns if c == "words"])


def _where(df: DataFrame, bitmap, bits: int, inside: bool) -> DataFrame:
    """Rows whose anchor's bit is set, or is not."""

    def run(batches: Batches) -> Batches:
        often = np.frombuffer(bitmap.value, np.uint8)
        for b in batches:
            yield b.filter(pa.array(passes(often, b.column("anchor").to_numpy().view(np.uint64), bits) == inside))

    return map_batches(df, run, ", ".join(f"{c} {t}" for c, t in df.dtypes))


def _by_shard(segs: DataFrame, n_shards: int, window: int) -> DataFrame:
    """(h1, h2, place of the first copy, which of its windows occur earlier) of every segment that
    has a copy or such a window."""
    one = _distinct(segs, F.first("words", ignorenulls=True).alias("words")).withColumn("shard", F.pmod(F.xxhash64("anchor"), F.lit(n_shards)).cast("int"))
    tune(segs.sparkSession)

    def run(t: pa.Table) -> pa.Table:
        anchor = t.column("anchor").to_numpy()
        _, which, n = np.unique(anchor, return_inverse=True, return_counts=True)
        mask = np.zeros(t.num_rows, np.int64)
        order = np.lexsort([t.column(c).to_numpy() for c in ("start", "tag", "did", "nul")])
        order = order[n[which[order]] > 1]  # an anchor with one segment has no other windows
        if len(order):
            words = [x.split(b" ") for x in t.column("words").take(pa.array(order)).to_pylist()]
            mask[order] = [int((s << np.arange(len(s))).sum()) for s in (x.astype(np.int64) for x in earlier(words, window))]
        keep = (mask != 0) | (t.column("copies").to_numpy() > 1)
        out = t.select(["h1", "h2", *KEY, "start"]).append_column("mask", pa.array(mask)).filter(pa.array(keep))
        release()
        return out

    return one.groupBy("shard").applyInArrow(run, "h1 long, h2 long, nul boolean, did long, tag long, start int, mask long")


def repeated(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, often: int = OFTEN, bits: int | None = None) -> DataFrame:
    """(key of the document, spans): spans are (first window, mask of its windows) that occur earlier."""
    bits = bits or bits_for(docs, "text")
    segs = written(segments(docs, window, gram, often, bits), "fm-segments", "zstd")
    one = written(_distinct(segs), "fm-distinct")
    several = heavy_buckets(one.select("anchor"), lambda x: many_rows(x), lambda b: b.column("anchor").to_numpy().view(np.uint64), bits, 2)[0]
    several = docs.sparkSession.sparkContext.broadcast(several)
    n_shards = max(1, _where(one.select("anchor"), several, bits, True).count() // SHARD_SEGMENTS)
    copies = _where(one.where("copies > 1"), several, bits, False).select("h1", "h2", *KEY, "start", F.lit(0).cast("long").alias("mask"))
    first = written(_by_shard(_where(segs.drop("runs"), several, bits, True), n_shards, window).union(copies), "fm-windows")
    dropped(one)
    own = [F.col(c) == F.col(f"f_{c}") for c in (*KEY, "start")]
    is_first = own[0] & own[1] & own[2] & own[3]
    f = first.select("h1", "h2", "mask", *[F.col(c).alias(f"f_{c}") for c in (*KEY, "start")])
    hits = segs.select("h1", "h2", *KEY, "start", "runs").join(f, ["h1", "h2"])
    hits = hits.select(*KEY, "start", F.when(is_first, F.col("mask")).otherwise(F.expr("shiftleft(1L, runs) - 1")).alias("mask")).where("mask <> 0")
    out = written(hits.groupBy(*KEY).agg(F.collect_set(F.struct("start", "mask")).alias("spans")), "fm-spans")
    dropped(segs, first)
    return out


def remove(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, gram: int = GRAM, often: int = OFTEN, bits: int | None = None, with_text: bool = False) -> DataFrame:
    """Per row: its words, the removed ones, and the hash of what is left (``with_text``: and that)."""
    d = _keyed(docs, id_col, text_col)
    spans = repeated(d, window, gram, often, bits)

    def run(batches: Batches) -> Batches:
        for batch in batches:
            for b in blocks([batch], "text"):
                data, off = text_bytes(b.column("text"))
                raw, rows = data.tobytes(), []
                for x, y, marks in zip(off.tolist(), off[1:].tolist(), b.column("spans").to_pylist(), strict=False):
                    words = raw[x:y].split()
                    gone = np.zeros(len(words) + 1, np.int64)
                    for m in marks or ():
                        at = m["start"] + np.flatnonzero(m["mask"] >> np.arange(window) & 1)
                        np.add.at(gone, at, 1)
                        np.add.at(gone, at + window, -1)
                    stays = np.flatnonzero(np.cumsum(gone)[:-1] == 0).tolist()
                    kept = b" ".join(words if len(stays) == len(words) else [words[i] for i in stays])
                    rows.append((len(words), len(words) - len(stays), hashlib.sha256(kept).hexdigest(), kept.decode() if with_text else None))
                cols = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True))], ["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"])

    joined = d.join(spans, list(KEY), "left").select(F.when(~F.col("nul"), F.col("did")).alias("doc_id"), "text", "spans")
    out = map_batches(joined, run, "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string")
    return out if with_text else out.drop("kept_text")


def op13_fm_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE_OP13 = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT r, doc_id, w, unnest(range(1, len(w) - {WINDOW - 2})) AS i FROM d WHERE len(w) >= {WINDOW}),
win AS (SELECT r, i, row_number() OVER (PARTITION BY array_to_string(w[i:i + {WINDOW - 1}], ' ') ORDER BY doc_id, i) AS nth FROM s),
gone AS (SELECT DISTINCT r, j FROM (SELECT r, unnest(range(i, i + {WINDOW})) AS j FROM win WHERE nth > 1)),
lost AS (SELECT r, list(j) AS js FROM gone GROUP BY r),
k AS (SELECT r, string_agg(word, ' ' ORDER BY i) AS kept FROM (SELECT r, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM d) x
      WHERE NOT EXISTS (SELECT 1 FROM gone WHERE gone.r = x.r AND gone.j = x.i) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(len(js), 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN lost USING (r) LEFT JOIN k USING (r)"""

QUERIES = {"op13_fm_dedup": op13_fm_dedup}
ORACLE = {"op13_fm_dedup": ORACLE_OP13}
