"""Content-addressed store of token ids.

A rolling hash over the ids cuts each document's id stream into chunks; each distinct chunk is
stored once, under its digest.  A recipe per document lists the digests of its chunks, and a
Merkle root over them; recipes lie in ascending doc_id order with the running start of each
document.  The manifest is a Merkle tree over the recipes' roots: a node for every run of at most
``RUN`` recipes, one for every bucket over its runs, and one over all buckets.

Layout of a store (a folder; Parquet throughout):

* ``chunks``   digest binary(16: BLAKE2b of body), n long, body binary (unsigned ids,
  little-endian, 2 bytes each where all vocabulary ids fit, else 4);
* ``recipes``  bucket int, run long, doc_id long, start long, n_tokens long, root binary, digests
  binary (16 bytes each), uid binary; files and rows ascend by doc_id;
* ``manifest/of=<level>`` level int (0 runs, 1 buckets, 2 all), bucket int, run long, first_start long,
  n_docs long, n_tokens long, root binary.

Reading builds each level of the tree anew from the level below it and compares it with the manifest,
both ways; it checks every stored chunk against its digest and every recipe against its root.  The crc32 of a
document is combined from those of its chunks, so that no chunk is moved again.

Defined results: a null or empty text is its end id alone; equal rows get a recipe each and
share all chunks; rows with equal ids follow each other in order of their roots; null ids come
first; an empty table gives an empty store.  Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .chunk_cache import byte_ids
from .common import blocks, delete, map_batches, mix, partitions, shared_dir, tokenizer_bytes
from .ordered import bucket_of

END_ID = 2
MASK_BITS = 9
LEAST, MOST = 64, 4096
REACH = 16
RUN = 1024
#: Fixed value: the polynomial of crc32, bits reversed.
CRC_POLY = 0xEDB88320


def chunk_ends(ids: np.ndarray) -> list[int]:
    """Ends of the content-defined chunks: where the top bits of a hash of the last 16 ids are
    0, at least ``LEAST`` and at most ``MOST`` ids after the one before."""
    h = mix(ids.astype(np.uint64) + np.uint64(1))
    step = 1
    while step < REACH:
        h[step:] = h[step:] + (h[:-step] << np.uint64(step))
        step *= 2
    out, last, n = [], 0, len(ids)
    for e in (np.flatnonzero((h >> np.uint64(64 - MASK_BITS)) == 0) + 1).tolist():
        while e - last > MOST:
            last += MOST
            out.append(last)
        if e - last >= LEAST:
            out.append(e)
            last = e
    while n - last > MOST:
        last += MOST
        out.append(last)
    if last < n:
        out.append(n)
    return out


def merkle(digests: list[bytes]) -> bytes:
    """Root over leaves; an odd one is carried up as it is."""
    level = [hashlib.blake2b(b"\0" + d, digest_size=16).digest() for d in digests] or [bytes(16)]
    while len(level) > 1:
        up = [hashlib.blake2b(b"\1" + a + b, digest_size=16).digest() for a, b in zip(level[::2], level[1::2], strict=False)]
        level = up + level[len(up) * 2 :]
    return level[0]


def _times(a: int, b: int) -> int:
    """Product of two polynomials modulo the crc32 polynomial (reflected bits)."""
    p = 0
    m = 1 << 31
    while m:
        if a & m:
            p ^= b
        b = (b >> 1) ^ CRC_POLY if b & 1 else b >> 1
        m >>= 1
    return p


def shifts(n_bytes: np.ndarray) -> np.ndarray:
    """x to the power 8 * n modulo the polynomial, for many n."""
    todo, at = n_bytes.astype(np.int64).copy(), np.full(len(n_bytes), 1 << 31, np.uint64)
    x = 1 << 23  # x ** 8
    while todo.any():
        odd = (todo & 1) == 1
        at[odd] = times_many(at[odd], np.full(int(odd.sum()), x, np.uint64))
        x = _times(x, x)
        todo >>= 1
    return at


def times_many(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    p, b = np.zeros(len(a), np.uint64), b.copy()
    for k in range(31, -1, -1):
        p ^= np.where((a >> np.uint64(k)) & np.uint64(1) == 1, b, np.uint64(0))
        b = np.where(b & np.uint64(1) == 1, (b >> np.uint64(1)) ^ np.uint64(CRC_POLY), b >> np.uint64(1))
    return p


def combined_crc(crcs: list[np.ndarray], sizes: list[np.ndarray]) -> list[int]:
    """crc32 of each list's concatenation, from the crc32 and byte size of its parts: the crc of
    part k is multiplied by x ** (8 * bytes after it), and all are added."""
    if not crcs:
        return []
    after = [np.concatenate([np.cumsum(s[::-1])[::-1][1:], [0]]) for s in sizes]
    flat = times_many(np.concatenate(crcs).astype(np.uint64), shifts(np.concatenate(after)))
    at = np.cumsum([0] + [len(c) for c in crcs[:-1]])
    return [int(x) for x in np.bitwise_xor.reduceat(flat, at)]


def write_store(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None) -> None:
    """Tokenise, chunk and store all texts."""
    content = tokenizer_bytes(tokenizer, "byte_bpe_50k.json")

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = byte_ids(content)
        wide = enc.width
        dtype = f"<u{wide}"
        end = np.array([END_ID], dtype).tobytes()
        part = TaskContext.get().partitionId() if TaskContext.get() else 0
        seen: set[bytes] = set()
        row = 0
        for b in blocks(batches, "text"):
            kind, ids, n, uid, key, body = [], [], [], [], [], []
            for doc_id, x in zip(b.column("doc_id").to_pylist(), enc([t or "" for t in b.column("text").to_pylist()]), strict=True):
                raw = x + end
                a, ds = 0, []
                for e in chunk_ends(np.frombuffer(raw, dtype)):
                    c = raw[wide * a : wide * e]
                    d = hashlib.blake2b(c, digest_size=16).digest()
                    ds.append(d)
                    if d not in seen:  # what this task has sent need not be sent again
                        if len(seen) >= 1_000_000:
                            seen.clear()
                        seen.add(d)
                        kind.append(False)
                        ids.append(None)
                        n.append(e - a)
                        uid.append(None)
                        key.append(d)
                        body.append(c)
                    a = e
                kind.append(True)
                ids.append(doc_id)
                n.append(a)
                uid.append(part.to_bytes(4, "big") + row.to_bytes(8, "big"))
                key.append(merkle(ds))
                body.append(b"".join(ds))
                row += 1
            yield pa.RecordBatch.from_arrays(
                [pa.array(kind), pa.array(ids, pa.int64()), pa.array(n, pa.int64()), pa.array(uid, pa.binary()), pa.array(key, pa.binary()), pa.array(body, pa.binary())],
                ["is_doc", "doc_id", "n", "uid", "key", "body"],
            )

    spark = docs.sparkSession
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    map_batches(d, chunks, "is_doc boolean, doc_id long, n long, uid binary, key binary, body binary").write.option("compression", "zstd").partitionBy("is_doc").parquet(f"{path}/spool")
    spool = spark.read.schema("doc_id long, n long, uid binary, key binary, body binary, is_doc boolean").parquet(f"{path}/spool")
    one = spool.where(~F.col("is_doc")).groupBy(F.col("key").alias("digest")).agg(F.first("n").alias("n"), F.first("body").alias("body"))
    one.write.option("compression", "zstd").parquet(f"{path}/chunks")

    rec = spool.where("is_doc").select("doc_id", F.col("n").alias("n_tokens"), F.col("key").alias("root"), F.col("body").alias("digests"), "uid")
    bucket, _ = bucket_of(rec, "doc_id", 2)
    rec = rec.withColumn("bucket", bucket)
    sums = rec.groupBy("bucket").agg(F.sum("n_tokens").alias("n_tokens"), F.count("*").alias("n_docs")).orderBy("bucket").collect()  # one row a bucket
    base, at = [], 0
    for r in sums:
        base.append((r.bucket, at))
        at += r.n_tokens
    bases = spark.createDataFrame(base, "bucket int, base long")
    order = Window.partitionBy("bucket").orderBy(F.asc_nulls_first("doc_id"), "root", "uid")
    before = F.sum("n_tokens").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("n_tokens")
    run = F.floor((F.row_number().over(order) - 1) / RUN)
    rec = rec.repartitionByRange(partitions(spark), "bucket").join(F.broadcast(bases), "bucket").withColumn("start", F.col("base") + before).withColumn("run", run.cast("long"))
    rec.select("bucket", "run", "doc_id", "start", "n_tokens", "root", "digests", "uid").sortWithinPartitions("bucket", "start").write.option("compression", "zstd").parquet(f"{path}/recipes")
    for level in range(3):
        _level(spark, path, level).write.parquet(f"{path}/manifest/of={level}")
    delete(spark, f"{path}/spool")


MANIFEST = "level int, bucket int, run long, first_start long, n_docs long, n_tokens long, root binary"


def _nodes(rows: DataFrame, level: int, *by: str) -> DataFrame:
    """A Merkle node over the roots of each group, in order of their starts.  Groups are small: at
    most ``RUN`` recipes of a run, a bucket's rows / ``RUN`` runs, or two buckets a partition."""
    leaves = F.transform(F.array_sort(F.collect_list(F.struct("first_start", "root"))), lambda x: x["root"])
    groups = rows.groupBy(*by).agg(F.min("first_start").alias("first_start"), F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"), leaves.alias("leaves")).where("n_docs is not null")
    groups = groups.select(F.lit(level).alias("level"), *(F.col(c) if c in by else F.lit(-2).cast(t).alias(c) for c, t in (("bucket", "int"), ("run", "long"))), "first_start", "n_docs", "n_tokens", "leaves")

    def roots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            root = pa.array([merkle(x) for x in b.column("leaves").to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], root], [*b.schema.names[:-1], "root"])

    return map_batches(groups, roots, MANIFEST)


def _level(spark: SparkSession, path: str, level: int) -> DataFrame:
    """The manifest's nodes of a level, built from what lies below it on disk: the recipes, or the
    nodes of the level before."""
    if level:
        return _nodes(_kept(spark, path, level - 1), level, *["bucket"] * (level == 1))
    leaves = recipes(spark, path).select("bucket", "run", F.col("start").alias("first_start"), F.lit(1).cast("long").alias("n_docs"), "n_tokens", "root")
    return _nodes(leaves, 0, "bucket", "run")


def _kept(spark: SparkSession, path: str, level: int) -> DataFrame:
    return spark.read.schema(MANIFEST).parquet(f"{path}/manifest/of={level}")


def recipes(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("bucket int, run long, doc_id long, start long, n_tokens long, root binary, digests binary, uid binary").parquet(f"{path}/recipes")


def verify_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Nodes that only the manifest has, or only what lies below them on disk gives: none in a sound
    store.  Each level is compared with the one below it, so the root vouches for all recipes."""
    sides = [x.withColumn("side", F.lit(n)) for level in range(3) for x, n in ((_kept(spark, path, level), 1), (_level(spark, path, level), -1))]
    names = [c.split(" ")[0] for c in MANIFEST.split(", ")]
    return reduce(DataFrame.unionByName, sides).groupBy(*names).agg(F.sum("side").alias("side")).where("side <> 0")


def read_chunks(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """digest, n, crc32 (of the ids as unsigned 32-bit) of each stored chunk, each checked."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            crc, wide = [], []
            for d, n, body in zip(b.column("digest").to_pylist(), b.column("n").to_pylist(), b.column("body").to_pylist(), strict=True):
                if hashlib.blake2b(body, digest_size=16).digest() != d or len(body) not in (2 * n, 4 * n):
                    raise ValueError(f"chunk {d.hex()} is damaged")
                w = np.frombuffer(body, f"<u{len(body) // n}").astype("<u4").tobytes()
                crc.append(zlib.crc32(w))
                wide.append(w)
            cols = [b.column("digest"), b.column("n"), pa.array(crc, pa.int64())] + ([pa.array(wide, pa.binary())] if with_ids else [])
            yield pa.RecordBatch.from_arrays(cols, ["digest", "n", "crc"] + ["ids"] * with_ids)

    chunks = spark.read.schema("digest binary, n long, body binary").parquet(f"{path}/chunks")
    return map_batches(chunks, check, "digest binary, n long, crc long" + (", ids binary" if with_ids else ""))


def _entries(spark: SparkSession, path: str) -> DataFrame:
    """A row for each chunk of each recipe; a document's row key is its start."""
    r = recipes(spark, path)
    k = F.explode(F.sequence(F.lit(0), (F.octet_length("digests") / 16).cast("int") - 1)).alias("k")
    return r.select("doc_id", "start", "n_tokens", "root", "digests", k).select("doc_id", "start", "n_tokens", "root", "k", F.expr("substring(digests, 16 * k + 1, 16)").alias("digest"))


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of each document, from the store's files."""
    if not verify_manifest(spark, path).isEmpty():
        raise ValueError("recipes and manifest differ")
    parts = _entries(spark, path).join(read_chunks(spark, path), "digest", "left")
    docs = parts.groupBy("start").agg(F.first("doc_id").alias("doc_id"), F.first("n_tokens").alias("n_tokens"), F.first("root").alias("root"), F.array_sort(F.collect_list(F.struct("k", "digest", "n", "crc"))).alias("parts"))

    def crc(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column("parts")
            flat = lists.flatten()
            digest = flat.field("digest").to_pylist()
            if flat.field("n").null_count:
                raise ValueError("a recipe names a chunk that is not stored")
            n, c = flat.field("n").to_numpy(), flat.field("crc").to_numpy()
            off = (lists.offsets.to_numpy() - lists.offsets[0].as_py()).tolist()
            spans = list(zip(off, off[1:], strict=False))
            for (x, y), root, total in zip(spans, b.column("root").to_pylist(), b.column("n_tokens").to_pylist(), strict=True):
                if merkle(digest[x:y]) != root or int(n[x:y].sum()) != total:
                    raise ValueError("a recipe is damaged")
            out = combined_crc([c[x:y] for x, y in spans], [4 * n[x:y] for x, y in spans])
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("start"), b.column("n_tokens"), pa.array(out, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return map_batches(docs, crc, "doc_id long, start long, n_tokens long, ids_crc32 long")


def restore(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start and the ids (little-endian unsigned 32-bit) of every document."""
    parts = _entries(spark, path).join(read_chunks(spark, path, True), "digest")
    whole = F.array_sort(F.collect_list(F.struct("k", "ids")))
    joined = F.aggregate(whole, F.lit(b""), lambda a, x: F.concat(a, x["ids"]))
    return parts.groupBy("start").agg(F.first("doc_id").alias("doc_id"), joined.alias("ids"))


def op10_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_dir(spark, "token-store")
    write_store(spark.read.parquet(f"{sf_dir}/documents.parquet"), path)
    return read_documents(spark, path)


QUERIES = {"op10_token_store": op10_token_store}
