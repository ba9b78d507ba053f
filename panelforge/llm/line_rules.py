"""Quality rules: cross-document line frequency.

Each line is normalised (A-Z lowered, white space to single spaces) and hashed.  Per host, the
documents that hold a line are counted; lines above the limit are removed, and a document that
this depletes is rejected, as is one that fails the base rules.

Documents count as different when their sets of lines differ: copies of one document count once,
so a text that was copied a thousand times is not taken for boilerplate; near copies count each.
A line is above the limit when at least ``LEAST_DOCS`` different documents of a host hold it,
however large the host is.  A document is depleted when it loses ``DEPLETED_SHARE`` percent of its
words, or when fewer than ``MIN_WORDS`` are left of it.

Defined results: a null or empty text has no words or lines and fails the base rules; a null
host is a host of its own; rows with equal ids are judged each by its own text; null ids stay;
an empty table gives no rows; other columns are ignored (``filter_documents`` keeps them).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import blocks, fresh, map_batches, mix, span_hash, text_bytes, word_spans, written

LEAST_DOCS = 10
DEPLETED_SHARE = 20
MIN_WORDS = 50
REPEAT_SHARE = 50
#: Fixed value: the symbols that count.
SYMBOLS = b"#*$%&|<>"
_IS_SYMBOL = np.zeros(256, bool)
_IS_SYMBOL[list(SYMBOLS)] = True
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _per_doc(at: np.ndarray, off: np.ndarray) -> np.ndarray:
    """How many of the ascending places lie in each document."""
    return np.diff(np.searchsorted(at, off))


def base_counts(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, ...]:
    """n_words, word_chars, n_symbols and n_repeat_words of the documents of a block."""
    start, end, first = word_spans(data, off)
    n_words = np.diff(first)
    lead = np.flatnonzero((data & 0xC0) != 0x80)  # one per code point
    chars = _per_doc(lead, off) - _per_doc(np.flatnonzero((data == 32) | ((data >= 9) & (data <= 13))), off)
    symbols = _per_doc(np.flatnonzero(_IS_SYMBOL[data]), off)
    h = span_hash(data, start, end)
    repeat = np.zeros(len(n_words), np.int64)
    if len(h) >= 3:
        doc = np.repeat(np.arange(len(n_words)), n_words)
        ok = np.flatnonzero(doc[:-2] == doc[2:])
        g = mix(h[ok] * np.uint64(3) + mix(h[ok + 1] + np.uint64(7)) * np.uint64(5) + mix(h[ok + 2] + np.uint64(11)) * np.uint64(9) + mix(doc[ok].astype(np.uint64)))
        order = np.argsort(g)
        same = g[order][1:] == g[order][:-1]
        twice = np.zeros(len(ok), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        covered = np.zeros(len(h), bool)
        for k in range(3):
            covered[ok[twice] + k] = True
        repeat = _per_doc(np.flatnonzero(covered), first)
    return n_words, chars, symbols, repeat


def line_keys(text: bytes) -> tuple[int, list[tuple[int, int, int]], int | None]:
    """(repeated lines, (key, words, times) of each distinct normalised line, key of the whole set
    of lines)."""
    lines: dict[bytes, int] = {}
    for raw in text.split(b"\n"):
        if raw and not raw.isspace():
            lines[raw] = lines.get(raw, 0) + 1
    dup = sum(lines.values()) - len(lines)
    keys: dict[bytes, list[int]] = {}
    for raw, n in lines.items():
        words = raw.lower().split()
        k = hashlib.md5(b" ".join(words)).digest()[:8]
        if k in keys:
            keys[k][1] += n
        else:
            keys[k] = [len(words), n]
    out = [(int.from_bytes(k, "big", signed=True), w, n) for k, (w, n) in keys.items()]
    return dup, out, int.from_bytes(hashlib.md5(b"".join(sorted(keys))).digest()[:8], "big", signed=True) if keys else None


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", id_type: str = "long") -> DataFrame:
    """Base counts and lines of every document, written to the shared folder once."""
    schema = f"doc_id {id_type}, host string, " + ", ".join(f"{c} long" for c in COUNTS) + ", line_set long, lines array<struct<key:long,words:int,times:int>>"
    kind = pa.list_(pa.struct([("key", pa.int64()), ("words", pa.int32()), ("times", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches, "text", 1 << 20):
            data, off = text_bytes(b.column("text"))
            n_words, chars, symbols, repeat = base_counts(data, off)
            dup, lines, line_set = [], [], []
            raw = data.tobytes()
            for x, y in zip(off.tolist(), off[1:].tolist(), strict=False):
                d, rows, whole = line_keys(raw[x:y])
                dup.append(d)
                lines.append([{"key": k, "words": w, "times": n} for k, w, n in rows])
                line_set.append(whole)
            cols = [b.column("doc_id"), b.column("host")] + [pa.array(c, pa.int64()) for c in (n_words, chars, symbols, dup, repeat, line_set)] + [pa.array(lines, kind)]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "host", *COUNTS, "line_set", "lines"])

    d = docs.select(F.col(id_col).cast(id_type).alias("doc_id"), F.coalesce(F.concat(F.lit("="), F.col(host_col).cast("string")), F.lit("")).alias("host"), F.col(text_col).cast("string").alias("text"))
    return written(map_batches(d, run, schema).withColumn("row", F.monotonically_increasing_id()), "line-rules")


def common_lines(rows: DataFrame, least_docs: int = LEAST_DOCS) -> DataFrame:
    """(host, key) of the lines above the limit; documents with equal sets of lines are one.  Both
    steps count on the map side first, so a line or host that a third of the documents have is no
    hot key."""
    each = rows.select("host", "line_set", F.explode("lines").alias("l")).groupBy("host", F.col("l.key").alias("key"), "line_set").agg(F.lit(1).alias("x"))
    return each.groupBy("host", "key").agg(F.count("*").alias("docs")).where(F.col("docs") >= least_docs).select("host", "key")


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", least_docs: int = LEAST_DOCS, depleted_share: int = DEPLETED_SHARE, with_keys: bool = False, id_type: str = "long") -> DataFrame:
    """Counts and verdict of every document; ``row`` tells rows with equal ids apart.  ``with_keys``
    adds the keys of its lines above the limit, in hexadecimal."""
    rows = measure(docs, id_col, text_col, host_col, id_type)
    lines = rows.select("row", "host", F.explode("lines").alias("l")).select("row", "host", F.col("l.key").alias("key"), (F.col("l.words") * F.col("l.times")).alias("words"))
    keys = [F.collect_list(F.lpad(F.hex("key"), 16, "0")).alias("removed_keys")] if with_keys else []  # of one document
    lost = lines.join(common_lines(rows, least_docs), ["host", "key"], "left_semi").groupBy("row").agg(F.sum("words").alias("n_removed_words"), *keys)
    out = rows.drop("lines", "line_set", "host").join(lost, "row", "left").withColumn("n_removed_words", F.coalesce("n_removed_words", F.lit(0)))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_SHARE * F.col("n_words"))
    left = F.col("n_words") - F.col("n_removed_words")
    depleted = (F.col("n_removed_words") > 0) & ((left < MIN_WORDS) | (100 * F.col("n_removed_words") >= depleted_share * F.col("n_words")))
    return out.withColumn("base_failed", failed).withColumn("kept", ~failed & ~depleted)


def without_lines(text: Column, keys: Column) -> Column:
    """The text without the lines that have one of the keys; all other lines stay as they are."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    norm = lambda x: F.trim(F.regexp_replace(F.translate(x, upper, upper.lower()), r"[\x20\x09-\x0D]+", " "))
    stays = lambda x: ~F.array_contains(keys, F.upper(F.substring(F.md5(norm(x).cast("binary")), 1, 16)))
    return F.array_join(F.filter(F.split(text, "\n", -1), stays), "\n")


def filter_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", chars_col: str = "n_chars") -> DataFrame:
    """The documents that stay, with all their columns, without their lines above the limit;
    ``chars_col``, where there is one, is that of the text that is left.  Verdicts depend on text
    and host alone, and are joined by a 128-bit hash of both."""
    tag, kept, keys = (fresh(docs, c) for c in ("_tag", "_kept", "_keys"))
    host = F.coalesce(F.concat(F.lit("="), F.col(host_col).cast("string")), F.lit(""))
    tagged = docs.withColumn(tag, F.md5(F.concat(host, F.lit("\0"), F.coalesce(F.col(text_col).cast("string"), F.lit("")))))
    v = judge(tagged.select(F.col(tag).alias("doc_id"), F.col(text_col).alias("text"), F.col(host_col).alias("host")), "doc_id", "text", "host", with_keys=True, id_type="string")
    fate = v.where("not kept or n_removed_words > 0").groupBy(F.col("doc_id").alias(tag)).agg(F.first("kept").alias(kept), F.first("removed_keys").alias(keys))
    out = tagged.join(fate, tag, "left").where(F.col(kept).isNull() | F.col(kept))
    out = out.withColumn(text_col, F.when(F.col(keys).isNull(), F.col(text_col)).otherwise(without_lines(F.col(text_col), F.col(keys))))
    if chars_col in docs.columns:
        out = out.withColumn(chars_col, F.when(F.col(keys).isNull(), F.col(chars_col)).otherwise(F.length(text_col).cast(docs.schema[chars_col].dataType)))
    return out.select(*docs.columns)


def op8_line_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", *COUNTS, "n_removed_words", "base_failed", "kept")


ORACLE_OP8 = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(source, chr(1)) AS host, coalesce(text, '') AS text,
        regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
l AS (SELECT r, host, line, trim(regexp_replace(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+', ' ', 'g'), ' ') AS norm
      FROM (SELECT r, host, unnest(string_split(text, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
k AS (SELECT r, host, norm, substr(md5(norm), 1, 16) AS key, len(string_split(norm, ' ')) AS words FROM l),
s AS (SELECT r, string_agg(DISTINCT key, '' ORDER BY key) AS line_set FROM k GROUP BY r),
often AS (SELECT host, key FROM k JOIN s USING (r) GROUP BY host, key HAVING count(DISTINCT line_set) >= {LEAST_DOCS}),
lost AS (SELECT r, sum(words) AS n FROM k JOIN often USING (host, key) GROUP BY r),
dup AS (SELECT r, count(*) - count(DISTINCT line) AS n FROM l GROUP BY r),
g AS (SELECT r, i, count(*) OVER (PARTITION BY r, w[i], w[i + 1], w[i + 2]) AS n FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM d)),
rep AS (SELECT r, count(DISTINCT i) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS i FROM g WHERE n > 1) GROUP BY r),
o AS (SELECT doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
        length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols, coalesce(dup.n, 0)::BIGINT AS n_dup_lines,
        coalesce(rep.n, 0)::BIGINT AS n_repeat_words, coalesce(lost.n, 0)::BIGINT AS n_removed_words
      FROM d LEFT JOIN dup USING (r) LEFT JOIN rep USING (r) LEFT JOIN lost USING (r))
SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {REPEAT_SHARE} * n_words AS base_failed,
       NOT (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {REPEAT_SHARE} * n_words)
       AND (n_removed_words = 0 OR (100 * n_removed_words < {DEPLETED_SHARE} * n_words AND n_words - n_removed_words >= {MIN_WORDS})) AS kept
FROM o"""

QUERIES = {"op8_line_rules": op8_line_rules}
ORACLE = {"op8_line_rules": ORACLE_OP8}
