"""Order-preserving packing by dynamic programming.

Each input partition's documents keep their order and form one stream of token ids.  Windows of
at most 2048 ids are cut at document ends (no penalty), sentence ends, or, inside sentences
longer than half a window, at forced places; the cuts minimise padding plus truncation
penalties.  With ``cost(i, j) = size - (pos_j - pos_i) + penalty_j`` the transition is
``best_j = min(best_i + pos_i) + size - pos_j + penalty_j`` over a sliding range, which a
monotone queue gives in constant amortised time.

No shuffle: a partition of the scan is packed where it is read, in segments of about
``SEGMENT`` ids, and the window that a segment leaves open goes on in the next one.

Defined results: a null or empty text is its end id alone; repeated rows are packed each; a
null doc_id stays null; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .chunk_cache import LIMIT, word_ids
from .common import blocks, map_batches, tokenizer_bytes

SIZE = 2048
END_ID = 1
SEGMENT = 1 << 20
SENTENCE_PENALTY = 2.0
FORCED_PENALTY = 256.0


def cuts(pos: np.ndarray, penalty: np.ndarray, size: int = SIZE) -> list[int]:
    """Indices into ``pos`` (ascending, from 0) where windows begin or end; first and last
    included.  Neighbouring positions may be at most ``size`` apart."""
    p, pen = pos.tolist(), penalty.tolist()
    n = len(p)
    best, back = [0.0] * n, [0] * n
    queue: deque[int] = deque([0])
    value = [0.0] * n
    pop, popleft, push = queue.pop, queue.popleft, queue.append
    for j in range(1, n):
        x = p[j]
        while p[queue[0]] < x - size:
            popleft()
        i = queue[0]
        back[j] = i
        best[j] = b = value[i] + size - x + pen[j]
        value[j] = v = b + x
        while queue and value[queue[-1]] >= v:
            pop()
        push(j)
    out = [n - 1]
    while out[-1]:
        out.append(back[out[-1]])
    return out[::-1]


def boundaries(ids: np.ndarray, doc_end: np.ndarray, enders: np.ndarray, size: int, sentence: float, forced: float) -> tuple[np.ndarray, np.ndarray]:
    """Places where a window may end, with their penalties."""
    at = np.flatnonzero(np.isin(ids, enders)) + 1
    pos = np.union1d(at, np.concatenate([[0], doc_end]))
    gap = np.diff(pos)
    wide = np.flatnonzero(gap > size // 2)
    if len(wide):
        more = [np.arange(pos[i] + size // 2, pos[i + 1], size // 2) for i in wide]
        extra = np.concatenate(more)
        both = np.union1d(pos, extra)
    else:
        extra, both = np.zeros(0, np.int64), pos
    pen = np.full(len(both), sentence)
    pen[np.searchsorted(both, extra)] = forced
    pen[np.searchsorted(both, doc_end)] = 0.0
    pen[0] = 0.0
    return both, pen


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, size: int = SIZE, with_ids: bool = False, sentence: float = SENTENCE_PENALTY, forced: float = FORCED_PENALTY, known: int = LIMIT) -> DataFrame:
    """One row per piece; with ``with_ids`` also its ids (little-endian unsigned 32-bit).
    ``known`` bounds how many words a worker remembers: memory against time."""
    content = tokenizer_bytes(tokenizer, "word_bpe_49k.json")
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    schema = ", ".join(f"{c} long" for c in names) + (", ids binary" if with_ids else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = word_ids(content, known)
        enders = np.unique([np.frombuffer(x, "<u4")[-1] for x in enc([b"x" + c for c in (b".", b"!", b"?", b"!!", b"...")])])
        end = np.array([END_ID], "<u4").tobytes()
        base = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 32
        seq = 0
        buf: list[bytes] = []
        held: list[tuple] = []  # (doc_id, ids before the buffer's part, ids in the buffer, all ids)
        total = 0

        def cut(last: bool) -> pa.RecordBatch | None:
            nonlocal seq, buf, held, total
            if not held:
                return None
            raw = b"".join(buf)
            ids = np.frombuffer(raw, "<u4")
            part = np.array([h[2] for h in held], np.int64)
            doc_end = np.cumsum(part)
            pos, pen = boundaries(ids, doc_end, enders, size, sentence, forced)
            at = pos[cuts(pos, pen, size)]
            if not last:
                at = at[:-1]  # the open window goes on in the next segment
            stop = int(at[-1])
            begin = doc_end - part
            marks = np.union1d(at, begin[begin < stop])
            a, b = marks[:-1], marks[1:]
            d = np.searchsorted(begin, a, "right") - 1
            w = np.searchsorted(at, a, "right") - 1
            view = memoryview(raw)
            cols = [
                pa.array([held[i][0] for i in d.tolist()], pa.int64()),
                pa.array(a - begin[d] + np.array([h[1] for h in held], np.int64)[d]),
                pa.array(b - a),
                pa.array([zlib.crc32(view[4 * x : 4 * y]) for x, y in zip(a.tolist(), b.tolist(), strict=True)], pa.int64()),
                pa.array([held[i][3] for i in d.tolist()], pa.int64()),
                pa.array(base + seq + w),
                pa.array(a - at[w]),
            ]
            if with_ids:
                cols.append(pa.array([raw[4 * x : 4 * y] for x, y in zip(a.tolist(), b.tolist(), strict=True)], pa.binary()))
            seq += len(at) - 1
            rest = []
            for h, s, e in zip(held, begin.tolist(), doc_end.tolist(), strict=True):
                if e > stop:
                    rest.append((h[0], h[1] + max(0, stop - s), e - max(s, stop), h[3]))
            buf, held, total = [raw[4 * stop :]], rest, len(ids) - stop
            return pa.RecordBatch.from_arrays(cols, names + ["ids"] * with_ids) if len(a) else None

        for b in blocks(batches, "text"):
            texts = b.column("text").cast(pa.binary()).to_pylist()
            for doc_id, x in zip(b.column("doc_id").to_pylist(), enc([t or b"" for t in texts]), strict=True):
                buf += (x, end)
                n = len(x) // 4 + 1
                held.append((doc_id, 0, n, n))
                total += n
                if total >= SEGMENT and (out := cut(False)):
                    yield out
        if out := cut(True):
            yield out

    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).sortWithinPartitions("doc_id")
    return map_batches(d, run, schema)


def op6_window_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op6_window_packing": op6_window_packing}
