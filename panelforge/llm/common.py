"""Shared pieces of the training-data operators: session settings, shared folders,
Arrow plumbing and vectorised byte kernels.

Every kernel works on the buffers of an Arrow string column: all texts of a block lie in one
byte array, and documents are offset ranges in it.  Blocks hold about ``BLOCK`` bytes, so the
memory of a Python worker does not depend on how many rows a batch has.
"""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BLOCK = 2 << 20
ASCII_SPACE = np.zeros(256, bool)
ASCII_SPACE[[32, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def tune(spark: SparkSession) -> None:
    """Small Arrow batches: rows are whole documents, some of them very long."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "512")


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new path in the folder that the driver and all executors share.  Where the session names
    none, a local session uses a temporary one; a cluster is asked for the setting."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = f"file://{tempfile.gettempdir()}/panelforge"
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, codec: str = "snappy") -> DataFrame:
    """Write a table to the shared folder and read it back: lineage ends here."""
    spark = df.sparkSession
    path = shared_dir(spark, name)
    df.write.option("compression", codec).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._shared_path = path
    return out


def dropped(*tables: DataFrame) -> None:
    """Delete tables that ``written`` made and nothing will read again."""
    for t in tables:
        path = getattr(t, "_shared_path", None)
        if path:
            delete(t.sparkSession, path)


def delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that the table does not have."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name += "_"
    return name


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def tokenizer_bytes(path: str | None, name: str) -> bytes:
    """The tokenizer file's content, read on the driver and sent with the task."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(name)
    with open(path, "rb") as f:
        return f.read()


def release() -> None:
    """Give freed memory back to the system: a worker process lives on between tasks."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # another C library
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def map_batches(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from fn(batches)
        finally:
            release()

    tune(df.sparkSession)
    return df.mapInArrow(run, schema)


def blocks(batches: Iterator[pa.RecordBatch], text: str, size: int = BLOCK) -> Iterator[pa.RecordBatch]:
    """Batches cut so that each holds about ``size`` bytes of text (or one longer row)."""
    for b in batches:
        if not b.num_rows:
            continue
        off = offsets(b.column(text))[0]
        at = 0
        while at < b.num_rows:
            to = int(np.searchsorted(off, off[at] + size, "right")) - 1
            to = min(max(to, at + 1), b.num_rows)
            yield b.slice(at, to - at)
            at = to


def offsets(col: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Offsets (int64, one more than rows) into the column's data; the column without nulls."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null("" if pa.types.is_string(col.type) or pa.types.is_large_string(col.type) else b"")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    raw = col.buffers()[1]
    if raw is None or not len(col):
        return np.zeros(len(col) + 1, np.int64), col
    off = np.frombuffer(raw, np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    return off, col


def text_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(all bytes of a block, offsets from 0); a null text is empty."""
    off, col = offsets(col)
    raw = col.buffers()[2]
    if raw is None or off[-1] == off[0]:
        return np.zeros(0, np.uint8), off - off[0]
    return np.frombuffer(raw, np.uint8)[off[0] : off[-1]], off - off[0]


# ---- hashing -------------------------------------------------------------------------------
_RND = np.random.default_rng(20240607)
_BYTE = _RND.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_INV = pow(_BASE, -1, 1 << 64)
_POW: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "p" not in _POW or len(_POW["p"]) < n:
        m = max(n, 1 << 16)
        for k, base in (("p", _BASE), ("i", _INV)):
            a = np.ones(m, np.uint64)
            have, mul = 1, base
            while have < m:  # doubling: a[have:2*have] = a[:have] * base**have
                take = min(have, m - have)
                a[have : have + take] = a[:take] * np.uint64(mul)
                have, mul = have * 2, mul * mul % (1 << 64)
            _POW[k] = a
    return _POW["p"][:n], _POW["i"][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (published splitmix constants)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def span_hash(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of data[start:end] for many spans in one go."""
    if not len(start):
        return np.zeros(0, np.uint64)
    p, inv = _powers(len(data) + 1)
    c = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * p[:-1], out=c[1:])
    return mix((c[end] - c[start]) * inv[start] + (end - start).astype(np.uint64))


def word_spans(data: np.ndarray, off: np.ndarray, space: np.ndarray = ASCII_SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of a block, and per document the index of its first word
    (one more than documents).  Words do not cross documents."""
    n = len(data)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(off), np.int64)
    word = ~space[data]
    cut = np.zeros(n + 1, bool)
    cut[off] = True
    first = word.copy()
    first[1:] &= ~word[:-1] | cut[1:n]
    last = word.copy()
    last[:-1] &= ~word[1:] | cut[1:n]
    start = np.flatnonzero(first)
    return start, np.flatnonzero(last) + 1, np.searchsorted(start, off)


def table(schema: pa.Schema, **cols) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type, from_pandas=False) for f, c in zip(schema, cols.values(), strict=True)], schema=schema)


def crc_of_id(col: str = "doc_id"):
    """crc32 of an id as text; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(col).cast("string"), F.lit("")))
