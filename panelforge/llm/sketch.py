"""A sketch of counts over all rows, built as a Spark job: upper bounds for how often a hashed
item occurs, read back as one bit per bucket ("at least so often").

A task counts the buckets of each block of texts and sends, per slice of ``1 << SLICE_BITS``
buckets, the buckets that occur and their counts up to 255.  Slices are added up in the tasks they
are dealt to.  What travels grows with the input; what the driver gathers and broadcasts is a bit a
bucket, at most ``1 << MOST_BITS`` of them (128 MB).  A bucket's count is never below that of an
item in it, so nothing frequent is missed; beyond the widest sketch more items pass, which costs
time and changes no result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks, map_batches, partitions

SLICE_BITS = 14
LEAST_BITS, MOST_BITS = 20, 30
BYTES_PER_BUCKET = 8
BLOCK = 8 << 20
Batches = Iterator[pa.RecordBatch]


def gathered(batches: Batches, text: str, size: int = BLOCK) -> Batches:
    """Batches of about ``size`` bytes of text, however many rows that takes."""
    held, n = [], 0
    for b in batches:
        for x in blocks([b], text, size):
            held.append(x)
            n += x.column(text).nbytes
            if n >= size:
                yield _joined(held)
                held, n = [], 0
    if held:
        yield _joined(held)


def _joined(held: list[pa.RecordBatch]) -> pa.RecordBatch:
    return held[0] if len(held) == 1 else pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def bits_for(docs: DataFrame, text: str) -> int:
    """Width of the sketch: a bucket for some bytes of text, within fixed limits."""
    n = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    return min(MOST_BITS, max(LEAST_BITS, int(n // BYTES_PER_BUCKET).bit_length()))


def bucket(h: np.ndarray, bits: int) -> np.ndarray:
    return (h >> np.uint64(64 - bits)).astype(np.uint32)


def binary_rows(data: np.ndarray, cuts: np.ndarray) -> pa.Array:
    """A column of the packed parts of an array between neighbouring cuts."""
    data = np.ascontiguousarray(data)
    off = (cuts * data.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(cuts) - 1, [None, pa.py_buffer(off), pa.py_buffer(data)])


def _counts(hashes: np.ndarray, bits: int) -> pa.RecordBatch:
    """The buckets of a block with their counts, a row per slice."""
    b = np.sort(bucket(hashes, bits))
    first = np.flatnonzero(np.concatenate([[True], b[1:] != b[:-1]]))
    n = np.minimum(np.diff(np.append(first, len(b))), 255).astype(np.uint8)
    b = b[first]
    part = b >> np.uint32(SLICE_BITS)
    cuts = np.append(np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]])), len(b))
    at = (b & np.uint32((1 << SLICE_BITS) - 1)).astype(np.uint16)
    return pa.RecordBatch.from_arrays([pa.array(part[cuts[:-1]].astype(np.int32)), binary_rows(at, cuts), binary_rows(n, cuts)], ["slice", "at", "n"])


def many_rows(batches: Batches, rows: int = 500_000) -> Batches:
    """Batches of about so many rows, for narrow tables."""
    held, n = [], 0
    for b in batches:
        held.append(b)
        n += b.num_rows
        if n >= rows:
            yield _joined(held)
            held, n = [], 0
    if held:
        yield _joined(held)


def heavy_buckets(docs: DataFrame, blocked: Callable[[Batches], Batches], hashes: Callable[[pa.RecordBatch], np.ndarray], bits: int, *least: int) -> list[bytes]:
    """For each of ``least`` a bit per bucket: does it count at least so many?  ``blocked``
    makes blocks of the batches, ``hashes`` gives the 64-bit hashes of all items of a block."""

    def count(batches: Batches) -> Batches:
        for b in blocked(batches):
            h = hashes(b)
            if len(h):
                yield _counts(h, bits)

    def add(batches: Batches) -> Batches:
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for part, at, n in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                if part not in total:
                    total[part] = np.zeros(1 << SLICE_BITS, np.uint32)
                total[part][np.frombuffer(at, np.uint16)] += np.frombuffer(n, np.uint8)
        for part, t in total.items():
            if (t >= min(least)).any():
                cols = [pa.array([np.packbits(t >= k, bitorder="little").tobytes()], pa.binary()) for k in least]
                yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), *cols], ["slice", *(f"b{i}" for i in range(len(least)))])

    rows = map_batches(docs, count, "slice int, at binary, n binary").repartition(partitions(docs.sparkSession), "slice")
    out = [np.zeros(1 << bits >> 3, np.uint8) for _ in least]
    step = 1 << SLICE_BITS >> 3
    for r in map_batches(rows, add, "slice int, " + ", ".join(f"b{i} binary" for i in range(len(least)))).collect():
        for o, x in zip(out, r[1:], strict=True):
            o[r[0] * step : (r[0] + 1) * step] = np.frombuffer(x, np.uint8)
    return [o.tobytes() for o in out]


def passes(bitmap: np.ndarray, h: np.ndarray, bits: int) -> np.ndarray:
    """Whether each hash's bucket has its bit set."""
    b = bucket(h, bits)
    return (bitmap[b >> np.uint32(3)] >> (b & np.uint32(7)).astype(np.uint8) & 1).astype(bool)
