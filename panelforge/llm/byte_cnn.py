"""Quality classifier: a byte-level convolutional network in numpy.

A text is cut into overlapping chunks that cover all of its bytes.  In each chunk learned filters
six bytes wide pass over the bytes (and over one channel that says where the last four bytes
repeat ones shortly before), and each filter's maximum is kept.  The chunks' maxima are averaged
and one logistic unit gives the probability.

The network is fitted on the driver, on all chunks of at most ``TRAIN_ROWS`` labelled rows of each
class; rows are taken in order of a hash of their id, and no further ones once those of a class
hold ``TRAIN_BYTES``: a fixed bound on rows, never on a text.  Scoring reads every chunk of every
text, in one pass without a shuffle.

Defined results: a null or empty text is one blank chunk; rows with equal ids are scored each; a
null id counts as the empty text for the training rule; unlabelled rows and null labels teach
nothing; where a class is missing from the labels every score is (ones + 1) / (rows + 2); an
empty table gives no rows; other columns are ignored and never inputs.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import blocks, crc_of_id, fresh, map_batches, text_bytes

CHUNK = 256
STEP = 224
WIDTH = 6
DIM = 6
FILTERS = 24
TRAIN_ROWS = 1500
TRAIN_BYTES = 32 << 20
STEPS = 400
BATCH = 32
RATE = 0.01
THRESHOLD = 0.7
REPEAT_REACH = 24
PLACES = CHUNK - WIDTH + 1
ROWS = 512  # chunks that are convolved at once


def chunk_starts(size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(chunks of each text, start of each chunk within its text); at least one a text."""
    n = np.maximum(1, -(-(size - (CHUNK - STEP)) // STEP))
    first = np.concatenate([[0], np.cumsum(n)])
    return n, (np.arange(first[-1]) - np.repeat(first[:-1], n)) * STEP


def gather(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Chunks as rows; bytes after a text's end are 0."""
    at = begin[:, None] + np.arange(CHUNK)
    inside = at < end[:, None]
    if not len(data):
        return np.zeros(at.shape, np.uint8)
    return np.where(inside, data[np.minimum(at, len(data) - 1)], 0).astype(np.uint8)


def repeats(x: np.ndarray) -> np.ndarray:
    """Whether the last four bytes equal the four that lie 2 to ``REPEAT_REACH`` bytes before."""
    r = np.zeros(x.shape, bool)
    for d in range(2, REPEAT_REACH + 1):
        e = (x[:, d:] == x[:, :-d]) & (x[:, d:] != 0)
        r[:, d + 3 :] |= e[:, 3:] & e[:, 2:-1] & e[:, 1:-2] & e[:, :-3]
    return r[:, 3 : 3 + PLACES]


class Network:
    """``emb`` (256, DIM), ``w`` (WIDTH, DIM, FILTERS), ``u`` (FILTERS) for repeats, ``b``; then
    the logistic unit ``v``, ``c``."""

    def __init__(self, seed: int = 5):
        r = np.random.default_rng(seed)
        self.p = {
            "emb": r.normal(0, 0.5, (256, DIM)),
            "w": r.normal(0, 0.4, (WIDTH, DIM, FILTERS)),
            "u": r.normal(0, 0.4, FILTERS),
            "b": np.zeros(FILTERS),
            "v": r.normal(0, 0.3, FILTERS),
            "c": np.zeros(1),
        }
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}

    def conv(self, x: np.ndarray, rep: np.ndarray) -> np.ndarray:
        p = self.p
        e = p["emb"][x]
        h = np.zeros((len(x), PLACES, FILTERS), np.float32)
        for k in range(WIDTH):
            h += e[:, k : k + PLACES] @ p["w"][k]
        return h + rep[:, :, None] * p["u"] + p["b"]

    def fit(self, x: np.ndarray, doc: np.ndarray, y: np.ndarray, seed: int = 6) -> Network:
        """x: chunks; doc: ascending text number of each chunk; y: label of each text."""
        rng = np.random.default_rng(seed)
        m = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in self.p.items()}
        edge = np.searchsorted(doc, np.arange(len(y) + 1))
        rep = np.concatenate([repeats(x[a : a + ROWS]) for a in range(0, len(x), ROWS)])
        weight = (len(y) / (2 * np.bincount(y.astype(int), minlength=2)))[y.astype(int)].astype(np.float32)  # classes count alike
        epochs = -(-STEPS // -(-len(y) // BATCH))
        t = 0
        for epoch in range(epochs):
            order = rng.permutation(len(y))
            for a in range(0, len(y), BATCH):
                texts = order[a : a + BATCH]
                rows = np.concatenate([np.arange(edge[i], edge[i + 1]) for i in texts])
                of = np.repeat(np.arange(len(texts)), edge[texts + 1] - edge[texts])
                g = self.gradient(x[rows], rep[rows], of, y[texts], weight[texts])
                t += 1
                rate = RATE * (1 - 0.8 * epoch / epochs)
                for k, d in g.items():
                    m1, m2 = m[k]
                    m1 += 0.1 * (d - m1)
                    m2 += 0.01 * (d * d - m2)
                    self.p[k] -= rate * (m1 / (1 - 0.9**t)) / (np.sqrt(m2 / (1 - 0.99**t)) + 1e-7)
        return self

    def gradient(self, x: np.ndarray, rep: np.ndarray, of: np.ndarray, y: np.ndarray, weight: np.ndarray | float = 1.0) -> dict[str, np.ndarray]:
        p = self.p
        at, top = np.empty((len(x), FILTERS), np.int64), np.empty((len(x), FILTERS), p["v"].dtype)
        for a in range(0, len(x), ROWS):
            h = self.conv(x[a : a + ROWS], rep[a : a + ROWS])
            at[a : a + ROWS] = h.argmax(axis=1)
            top[a : a + ROWS] = np.take_along_axis(h, at[a : a + ROWS, None], axis=1)[:, 0]
        share = (1 / np.bincount(of))[of].astype(np.float32)
        pooled = np.zeros((len(y), FILTERS), np.float32)
        np.add.at(pooled, of, np.maximum(top, 0) * share[:, None])
        z = pooled @ p["v"] + p["c"]
        d = ((1 / (1 + np.exp(-z)) - y) * weight / len(y)).astype(np.float32)
        dtop = (d[of] * share)[:, None] * p["v"] * (top > 0)
        g = {"v": pooled.T @ d + 1e-4 * p["v"], "c": d.sum(keepdims=True), "b": dtop.sum(axis=0), "u": (dtop * np.take_along_axis(rep, at, axis=1)).sum(axis=0)}
        g["w"], g["emb"] = np.zeros_like(p["w"]), np.zeros_like(p["emb"])
        row = np.arange(len(x))[:, None]
        for k in range(WIDTH):
            byte = x[row, at + k]
            g["w"][k] = np.einsum("nfd,nf->df", p["emb"][byte], dtop)
            for d in range(DIM):
                g["emb"][:, d] += np.bincount(byte.ravel(), (dtop * p["w"][k][d]).ravel(), 256)
        return g

    def tables(self) -> list[np.ndarray]:
        """What each pair of bytes adds, for the three pairs that a filter covers."""
        t = np.einsum("bd,kdf->kbf", self.p["emb"], self.p["w"])
        return [np.ascontiguousarray((t[2 * k][None, :, :] + t[2 * k + 1][:, None, :]).reshape(-1, FILTERS)) for k in range(WIDTH // 2)]


def packed(net: Network) -> bytes:
    return b"".join(net.p[k].tobytes() for k in sorted(net.p))


@lru_cache(1)
def unpacked(raw: bytes) -> tuple[Network, list[np.ndarray]]:
    net, at = Network(), 0
    for k in sorted(net.p):
        n = net.p[k].nbytes
        net.p[k] = np.frombuffer(raw[at : at + n], np.float32).reshape(net.p[k].shape)
        at += n
    return net, net.tables()


def probabilities(data: np.ndarray, off: np.ndarray, net: Network, tables: list[np.ndarray]) -> np.ndarray:
    size = np.diff(off)
    n, inner = chunk_starts(size)
    begin, end = np.repeat(off[:-1], n) + inner, np.repeat(off[1:], n)
    pooled = np.empty((len(begin), FILTERS), np.float32)
    p = net.p
    for a in range(0, len(begin), 128):
        x = gather(data, begin[a : a + 128], end[a : a + 128])
        pair = x[:, :-1] + x[:, 1:].astype(np.uint16) * np.uint16(256)
        h = tables[0][pair[:, :PLACES]]
        h += tables[1][pair[:, 2 : 2 + PLACES]]
        h += tables[2][pair[:, 4 : 4 + PLACES]]
        i, j = np.nonzero(repeats(x))
        h[i, j] += p["u"]
        pooled[a : a + 128] = h.max(axis=1)
    pooled = np.maximum(pooled + p["b"], 0)
    mean = np.add.reduceat(pooled, np.concatenate([[0], np.cumsum(n)[:-1]]), axis=0) / n[:, None]
    return 1 / (1 + np.exp(-(mean @ p["v"] + p["c"]).astype(np.float64)))


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> bytes | float:
    """Packed weights, or a constant score where there is nothing to learn from."""
    lab = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & (crc_of_id() % 4 != 2))
    few = [lab.where(F.col("quality") == q).dropDuplicates(["doc_id"]).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows) for q in (0, 1)]
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text"))
    size = F.octet_length("text")
    before = F.sum(size).over(Window.partitionBy("quality").orderBy(F.xxhash64("doc_id"), "doc_id", "text").rowsBetween(Window.unboundedPreceding, -1))  # over at most ``rows`` labelled ids
    got = d.join(F.broadcast(few[0].unionByName(few[1])), "doc_id").withColumn("before", F.coalesce(before, F.lit(0))).where(F.col("before") < TRAIN_BYTES).drop("before").collect()  # bounded by TRAIN_BYTES
    got = sorted(got, key=lambda r: (r.doc_id, r.quality, bytes(r.text)))
    ones = sum(r.quality for r in got)
    if ones in (0, len(got)):
        return (ones + 1) / (len(got) + 2)
    data = np.frombuffer(b"".join(bytes(r.text) for r in got), np.uint8)
    off = np.concatenate([[0], np.cumsum([len(r.text) for r in got])])
    n, inner = chunk_starts(np.diff(off))
    x = gather(data, np.repeat(off[:-1], n) + inner, np.repeat(off[1:], n))
    return packed(Network().fit(x, np.repeat(np.arange(len(got)), n), np.array([r.quality for r in got], np.float32)))


def score(docs: DataFrame, model: bytes | float, id_col: str = "doc_id", text_col: str = "text", id_type: str = "long") -> DataFrame:
    """doc_id and score of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches, "text", 1 << 20):
            if isinstance(model, float):
                s = np.full(b.num_rows, model)
            else:
                s = probabilities(*text_bytes(b.column("text")), *unpacked(model))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(s)], ["doc_id", "score"])

    d = docs.select(F.col(id_col).cast(id_type).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return map_batches(d, run, f"doc_id {id_type}, score double")


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents with a score of at least ``THRESHOLD``, with all their columns.  A score
    depends on the text alone, so verdicts are joined by a 128-bit hash of the text."""
    model = train(docs, labels)
    tag = fresh(docs, "_tag")
    tagged = docs.withColumn(tag, F.md5(F.coalesce(F.col("text").cast("string"), F.lit(""))))
    bad = score(tagged, model, tag, id_type="string").where(F.col("score") < THRESHOLD).groupBy(F.col("doc_id").alias(tag)).agg(F.lit(1).alias("x")).select(tag)
    return tagged.join(bad, tag, "left_anti").select(*docs.columns)


def op7_byte_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    s = score(docs, model)
    return s.select("doc_id", (crc_of_id() % 4 == 2).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


QUERIES = {"op7_byte_cnn": op7_byte_cnn}
