"""Document fingerprints: an improbable-feature digest.

Every 32-byte window of a text gets its entropy (0 to 1000).  How rare each entropy is over the
whole corpus ranks the windows; the windows that most often have the lowest rank among 31
consecutive ones are the text's features.  Their hashes fill chained Bloom filters, and two
digests are compared by bit overlap, normalised between the overlap that chance gives and the
largest possible one.

Defined results: a null text is an empty one; an empty text has the fingerprint ``""``, equal to
itself (1.0) and unlike any other (0.0); a text under 32 bytes is one feature; rows with equal
ids keep both rows, in order of their texts; null ids come after all others.  Other columns of
the input are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BLOCK, blocks, map_batches, partitions, span_hash, text_bytes
from .ordered import bucket_of

WINDOW = 32
POPULAR = WINDOW - 1  # so that no popularity window touches two texts
LEVELS = 1001
BITS = 2048
PER_FILTER = 160
HASHES = 5
MIN_POPULARITY = 8
LOWEST_ENTROPY = 100
_G = np.array([c * np.log2(c) if c else 0.0 for c in range(WINDOW + 1)])
_STEP = np.rint((_G[1:] - _G[:-1]) * (1 << 20)).astype(np.int64)
_FULL = WINDOW * np.log2(WINDOW) * (1 << 20)
_STEP_AT = np.concatenate([_STEP, np.zeros(256 - len(_STEP), np.int64)])


def entropies(data: np.ndarray) -> np.ndarray:
    """Entropy level of the window that starts at each byte; O(window) byte comparisons."""
    n = len(data) - WINDOW + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    after, before = np.zeros(len(data), np.uint8), np.zeros(len(data), np.uint8)
    for d in range(1, WINDOW):
        same = (data[:-d] == data[d:]).view(np.uint8)
        after[:-d] += same
        before[d:] += same
    counts = np.bincount(data[:WINDOW], minlength=1)
    s = np.empty(n, np.int64)
    s[0] = sum(int(_STEP[:c].sum()) for c in counts)  # in the same integers, so that a window's value does not depend on its place
    s[1:] = _STEP_AT[before[WINDOW:]] - _STEP_AT[after[: n - 1]]
    np.cumsum(s, out=s)
    return np.clip(np.rint(1000 - 1000 * s / _FULL).astype(np.int64), 0, 1000)


def _inside(off: np.ndarray, n: int) -> np.ndarray:
    """Which windows lie within one text."""
    ok = np.ones(n, bool)
    for x in off[1:-1]:
        ok[max(0, x - WINDOW + 1) : x] = False
    return ok


def rarity(docs: DataFrame, text: str = "text") -> np.ndarray:
    """Ranks of the entropy levels, rarest first, counted over all windows of all texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(LEVELS, np.int64)
        for b in blocks(batches, "text"):
            data, off = text_bytes(b.column("text"))
            e = entropies(data)
            total += np.bincount(e[_inside(off, len(e))] if len(e) else e, minlength=LEVELS)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["level", "n"])

    rows = map_batches(docs.select(F.col(text).alias("text")), count, "level int, n long").groupBy("level").agg(F.sum("n").alias("n")).collect()
    n = np.zeros(LEVELS, np.int64)
    for r in rows:  # at most 1001
        n[r.level] = r.n
    rank = np.empty(LEVELS, np.int64)
    rank[np.lexsort((np.arange(LEVELS), n))] = np.arange(LEVELS)
    rank[:LOWEST_ENTROPY] = LEVELS
    return rank


def digests(texts: list[bytes], rank: np.ndarray) -> list[str]:
    """Fingerprints of some texts, computed over their concatenation."""
    data = np.frombuffer(b"".join(texts), np.uint8)
    off = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    size = np.diff(off)
    e = entropies(data)
    feature, of = np.zeros(0, np.int64), np.zeros(0, np.int64)
    if len(e):
        ok = _inside(off, len(e))
        wide = np.uint64 if len(e) >= 1 << 22 else np.uint32
        shift = wide(40 if wide is np.uint64 else 22)
        none = np.iinfo(wide).max
        key = np.where(ok & (rank[e] < LEVELS), (rank[e].astype(wide) << shift) | np.arange(len(e), dtype=wide), none)
        low = key
        for step in (1, 2, 4, 8):
            pad = np.full(step, none, wide)
            low = np.minimum(low, np.concatenate([low[step:], pad]))
        low = np.minimum(low, np.concatenate([low[15:], np.full(min(15, len(low)), none, wide)])[: len(low)])  # 31 positions
        won = low[ok]
        won = (won[won != none] & ((wide(1) << shift) - wide(1))).astype(np.int64)
        votes = np.bincount(won, minlength=len(e))
        feature = np.flatnonzero(votes)
        of = np.searchsorted(off, feature, "right") - 1
        strong = votes[feature] >= MIN_POPULARITY
        has = np.zeros(len(texts), bool)
        has[of[strong]] = True
        keep = strong | ~has[of]
        feature, of = feature[keep], of[keep]
    seen = np.zeros(len(texts), bool)
    seen[of] = True
    rest = np.flatnonzero(~seen & (size > 0))  # short or monotonous texts: one feature, the whole text
    start = np.concatenate([feature, off[rest]])
    end = np.concatenate([feature + WINDOW, off[rest + 1]])
    of = np.concatenate([of, rest])
    h = span_hash(data, start, end)
    order = np.lexsort((start, h, of))  # first of equal features within a text
    h, of, start = h[order], of[order], start[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (of[1:] != of[:-1])
    h, of, start = h[new], of[new], start[new]
    order = np.lexsort((start, of))
    h, of = h[order], of[order]
    first = np.searchsorted(of, np.arange(len(texts) + 1))
    nth = np.arange(len(h)) - first[of]
    chain = -(-np.diff(first) // PER_FILTER)
    base = np.concatenate([[0], np.cumsum(chain)])
    at = base[of] + nth // PER_FILTER
    bits = np.zeros((int(base[-1]), BITS), np.uint8)
    for k in range(HASHES):
        bits[at, ((h >> np.uint64(11 * k)) & np.uint64(BITS - 1)).astype(np.int64)] = 1
    packed = np.packbits(bits, axis=1).tobytes().hex()
    w = BITS // 4
    hexes = [packed[i * w : (i + 1) * w] for i in range(int(base[-1]))]
    return [".".join(hexes[base[i] : base[i + 1]]) for i in range(len(texts))]


def likeness(a: str, b: str) -> float:
    """0 to 1: mean over the shorter chain of the best normalised overlap in the other."""
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    x, y = ([(v, v.bit_count()) for v in (int(f, 16) for f in s.split("."))] for s in (a, b))
    if len(x) > len(y):
        x, y = y, x
    total = 0.0
    for v, n in x:
        best = 0.0
        for u, m in y:
            most, chance = min(n, m), n * m / BITS
            if most > chance:
                best = max(best, ((v & u).bit_count() - chance) / (most - chance))
        total += best
    return min(1.0, max(0.0, total / len(x)))


def edited_text(text: str, following: str) -> str:
    """The last third of the code points replaced by the first as many of the next text."""
    k = len(text) // 3
    return text[: len(text) - k] + following[:k]


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rank: np.ndarray | None = None) -> DataFrame:
    """Digest of each text, of its edited text, and their likeness to it and to the next text
    in descending id order.  Texts are dealt once, by ordered buckets of the id; the first row
    of each bucket is also sent, as a guest, to the bucket before it."""
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rank = rarity(d) if rank is None else rank
    bucket, _ = bucket_of(d, "doc_id")
    d = d.withColumn("bucket", bucket)
    firsts = d.groupBy("bucket").agg(F.max("doc_id").alias("first_id")).orderBy(F.desc("bucket")).collect()  # one row a bucket
    guests = [(firsts[(i + 1) % len(firsts)].first_id, r.bucket) for i, r in enumerate(firsts)]
    g = d.sparkSession.createDataFrame(guests or [(None, None)], "first_id long, to int")
    g = g.groupBy("first_id").agg(F.collect_list("to").alias("to"))
    j = d.join(F.broadcast(g), F.col("doc_id").eqNullSafe(F.col("first_id")), "left")
    own = F.array(F.struct(F.col("bucket").alias("b"), F.lit(False).alias("guest")))
    also = F.transform(F.coalesce(F.col("to"), F.array().cast("array<int>")), lambda x: F.struct(x.alias("b"), F.lit(True).alias("guest")))
    rows = j.select(F.explode(F.concat(own, also)).alias("x"), "doc_id", "text").select("x.b", "x.guest", "doc_id", "text")
    n = partitions(d.sparkSession)
    rows = rows.repartition(n, "b").sortWithinPartitions("b", "guest", F.desc_nulls_last("doc_id"), "text")
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []  # (bucket, guest, id, text)
        size = 0

        def flush(rows: list[tuple]) -> pa.RecordBatch | None:
            use = [i for i in range(len(rows) - 1) if rows[i][0] == rows[i + 1][0] and not rows[i][1]]
            if not use:
                return None
            edited = [edited_text(rows[i][3], rows[i + 1][3]).encode() for i in use]
            need = sorted({*use, *(i + 1 for i in use)})
            fp = digests([rows[i][3].encode() for i in need] + edited, rank)
            own, ed = dict(zip(need, fp, strict=False)), fp[len(need) :]
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([rows[i][2] for i in use], pa.int64()),
                    pa.array([len(rows[i][3]) for i in use], pa.int64()),
                    pa.array([hashlib.sha256(t).hexdigest() for t in edited]),
                    pa.array([own[i] for i in use]),
                    pa.array(ed),
                    pa.array([likeness(own[i], x) for i, x in zip(use, ed, strict=True)], pa.float64()),
                    pa.array([likeness(own[i], own[i + 1]) for i in use], pa.float64()),
                ],
                ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
            )

        for b in batches:
            for row in zip(*(b.column(c).to_pylist() for c in ("b", "guest", "doc_id", "text")), strict=True):
                held.append(row)
                size += len(row[3])
                if size >= BLOCK // 4:
                    if out := flush(held):
                        yield out
                    held, size = held[-1:], len(held[-1][3])
        if out := flush(held):
            yield out

    return map_batches(rows, run, schema)


def op3_rare_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op3_rare_digest": op3_rare_digest}
