"""Source divergence audit: which terms a source uses more than its language, and how far sources
are apart, as exact sums of absolute differences of smoothed shares.

A sketch of all terms' counts, which are upper bounds, first tells which terms may be in enough
documents.  A task then counts such terms and the documents that hold them per (language, source): spans and hashes of
all words of a block at once, integer ids for its terms, bincounts per group and id.  It sends
them packed, a row per bucket of terms; where a bucket is dealt they are added, and terms in enough
documents are kept.  These are range-partitioned by (language, term), so every task has a run of
terms in UTF-8 order, and go into sorted arrays of at most ``CHUNK`` terms; a row's term is found by ``searchsorted``.  An id in a
chunk follows UTF-8 order, so ties need no strings.  Each chunk, with the totals of its language,
becomes dense vectors of groups, from which differences are summed; sums of chunks are added by
Spark.

Defined results: null text, language and source are empty strings; rows count each as a document,
repeated or not; a language without kept terms has pairs of value 0 and no terms; an empty table
gives no rows; other columns are ignored.  Groups travel as 64-bit hashes of their names; should
two names ever share one, the audit stops with an error.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import dropped, map_batches, mix, partitions, span_hash, text_bytes, word_spans, written
from .sketch import binary_rows, bits_for, gathered, heavy_buckets, passes

LEAST_DOCS = 30
UNIT = 1_000_000_000
SMOOTH = 5
TOP = 50
#: Terms and counts of a chunk, and groups times terms of a dense matrix, at most.
CHUNK = 4096
ENTRIES = 1 << 18
CELLS = 1 << 22
#: Groups whose totals are broadcast; beyond it they are joined by a salt.
SENT_GROUPS = 200_000
SALTS = 64
#: Counts and bytes of terms that a task holds before it sends them.
HELD, HELD_BYTES = 1_000_000, 24 << 20
#: Buckets of terms a partition.
BUCKETS = 16
#: Letters and all that is not ASCII stay, A-Z in lower case; everything else is a space.
_TERM = np.array([c if c >= 128 or 97 <= c <= 122 else c + 32 if 65 <= c <= 90 else 32 for c in range(256)], np.uint8)
_GAP = _TERM == 32
Batches = Iterator[pa.RecordBatch]


def keyed(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    return docs.select(part(lang_col).alias("lang"), part(source_col).alias("source"), F.xxhash64(part(lang_col), part(source_col)).alias("g"), part(text_col).alias("text"))


def _terms(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes of a block, its terms' starts, ends and documents, and their hashes with
    the language's."""
    data, off = text_bytes(b.column("text"))
    low = _TERM[data]
    start, end, first = word_spans(low, off, _GAP)
    doc = np.repeat(np.arange(b.num_rows), np.diff(first))
    langs = b.column("lang").to_pylist()
    seeds = {x: int.from_bytes(hashlib.md5(x.encode()).digest()[:8], "big") for x in set(langs)}
    seed = np.array([seeds[x] for x in langs], np.uint64)
    return low, start, end, doc, mix(span_hash(low, start, end) ^ seed[doc]) if len(doc) else np.zeros(0, np.uint64)


def _block(b: pa.RecordBatch, held: dict[int, tuple[str, bytes]], often: np.ndarray, bits: int) -> list[np.ndarray]:
    """(term, group, documents, occurrences) of a block; terms are hashes, their names go to ``held``."""
    low, start, end, doc, h = _terms(b)
    keep = passes(often, h, bits)
    start, end, doc, h = start[keep], end[keep], doc[keep], h[keep]
    if not len(h):
        return [np.zeros(0, t) for t in (np.uint64, np.int64, np.int64, np.int64)]
    langs = b.column("lang").to_pylist()
    groups, group = np.unique(b.column("g").to_numpy(), return_inverse=True)
    terms, at, ids = np.unique(h, return_index=True, return_inverse=True)
    raw = low.tobytes()
    for t, i in zip(terms.tolist(), at.tolist(), strict=True):
        if t not in held:
            held[t] = (langs[doc[i]], raw[start[i] : end[i]])
    size = len(terms)
    pair, n = np.unique(group[doc] * size + ids, return_counts=True)
    of_doc = np.unique(doc * size + ids)  # once a document
    docs = np.bincount(np.searchsorted(pair, group[of_doc // size] * size + of_doc % size), minlength=len(pair))
    return [terms[pair % size], groups[pair // size], docs, n]


def _summed(parts: list[list[np.ndarray]]) -> list[np.ndarray]:
    """The same, added up and in order of term and group."""
    term, g, docs, n = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.lexsort([g, term])
    term, g = term[order], g[order]
    new = np.flatnonzero(np.concatenate([[True], (term[1:] != term[:-1]) | (g[1:] != g[:-1])]))
    return [term[new], g[new], np.add.reduceat(docs[order], new), np.add.reduceat(n[order], new)]


def count_terms(docs: DataFrame, least_docs: int = LEAST_DOCS, bits: int | None = None) -> DataFrame:
    """(lang, term, and packed: groups, occurrences) of all terms in ``least_docs`` documents;
    ``docs`` as made by ``keyed``."""
    docs = docs.select("lang", "g", "text")
    bits = bits or bits_for(docs, "text")
    bitmap = docs.sparkSession.sparkContext.broadcast(heavy_buckets(docs, lambda x: gathered(x, "text"), lambda b: _terms(b)[-1], bits, least_docs)[0])
    n_parts = partitions(docs.sparkSession)
    n_buckets = np.uint64(BUCKETS * n_parts)

    def send(parts: list, held: dict) -> Batches:
        """A row per bucket: its terms, the number of groups of each, and their counts."""
        term, g, n_docs, n = _summed(parts)
        if not len(term):
            return
        to = term % n_buckets
        order = np.argsort(to, kind="stable")
        term, g, n_docs, n, to = term[order], g[order], n_docs[order], n[order], to[order]
        new = np.flatnonzero(np.concatenate([[True], term[1:] != term[:-1]]))
        names, groups = [held[t] for t in term[new].tolist()], np.diff(np.append(new, len(term)))
        cuts = np.append(np.flatnonzero(np.concatenate([[True], to[1:] != to[:-1]])), len(to))
        of_term = np.searchsorted(new, cuts)
        text = [[names[i] for i in range(x, y)] for x, y in zip(of_term[:-1].tolist(), of_term[1:].tolist(), strict=True)]
        cols = [pa.array(to[cuts[:-1]].astype(np.int32)), pa.array([[x[0] for x in t] for t in text], pa.list_(pa.string())), pa.array([b" ".join(x[1] for x in t) for t in text], pa.binary()), binary_rows(groups.astype(np.int64), of_term)]
        yield pa.RecordBatch.from_arrays([*cols, *(binary_rows(x.astype(np.int64), cuts) for x in (g, n_docs, n))], ["bucket", "langs", "terms", "groups", "g", "docs", "n"])

    def run(batches: Batches) -> Batches:
        parts, held, size = [], {}, 0
        often = np.frombuffer(bitmap.value, np.uint8)
        for b in gathered(batches, "text"):
            parts.append(_block(b, held, often, bits))
            size += len(parts[-1][0])
            if size > HELD or sum(len(x[1]) for x in held.values()) > HELD_BYTES:
                yield from send(parts, held)
                parts, held, size = [], {}, 0
        if parts:
            yield from send(parts, held)

    def kept(rows: list[tuple]) -> Batches:
        """The terms of one bucket that are in enough documents."""
        if not rows:
            return
        ids: dict[tuple[str, bytes], int] = {}
        term = np.array([ids.setdefault(x, len(ids)) for langs, terms, *_ in rows for x in zip(langs, terms.split(), strict=True)])
        groups, g, docs, n = (np.frombuffer(b"".join(r[i] for r in rows), np.int64) for i in range(2, 6))
        term = np.repeat(term, groups)
        some = (add_up(term, docs, len(ids)) >= least_docs)[term]
        if some.any():
            term, g, _, n = _summed([[term[some], g[some], docs[some], n[some]]])
            cuts = np.append(np.flatnonzero(np.concatenate([[True], term[1:] != term[:-1]])), len(term))
            names = list(ids)
            names = [names[t] for t in term[cuts[:-1]].tolist()]
            cols = [pa.array([x[0] for x in names], pa.string()), pa.array([x[1] for x in names], pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays([*cols, binary_rows(g, cuts), binary_rows(n, cuts)], ["lang", "term", "g", "n"])

    def add(batches: Batches) -> Batches:
        at, rows = None, []
        for b in batches:
            for bucket, *row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if bucket != at:
                    yield from kept(rows)
                    at, rows = bucket, []
                rows.append(row)
        yield from kept(rows)

    packed = map_batches(docs, run, "bucket int, langs array<string>, terms binary, groups binary, g binary, docs binary, n binary")
    return map_batches(packed.repartition(n_parts, "bucket").sortWithinPartitions("bucket"), add, "lang string, term string, g binary, n binary")


def add_up(at: np.ndarray, n: np.ndarray, size: int) -> np.ndarray:
    """``bincount`` of whole numbers: two halves, as its sums are floats."""
    low, high = n & 0x3FFFFFF, n >> 26
    return np.bincount(at, low, size).astype(np.int64) + (np.bincount(at, high, size).astype(np.int64) << 26)


CHUNKS = pa.schema([("lang", pa.string()), ("terms", pa.list_(pa.string())), ("g", pa.list_(pa.int64())), ("sums", pa.list_(pa.int64())), ("cell", pa.list_(pa.int64())), ("n", pa.list_(pa.int64()))])


def _chunk(lang: str, terms: np.ndarray, g: np.ndarray, n: np.ndarray) -> dict:
    """Sorted kept terms of a chunk, its groups with their sums, and the counts as (cell, count),
    where a cell is group * terms + id."""
    kept = np.unique(terms)  # bytes: UTF-8 order
    names, group = np.unique(g, return_inverse=True)
    cell = group * len(kept) + np.searchsorted(kept, terms)
    return {"lang": lang, "terms": list(kept), "g": names.tolist(), "sums": add_up(group, n, len(names)).tolist(), "cell": cell.tolist(), "n": n.tolist()}


def chunks(counts: DataFrame) -> DataFrame:
    """Rows of at most ``CHUNK`` neighbouring kept terms of a language with their counts."""

    def run(batches: Batches) -> Batches:
        lang, held, entries = None, [], 0

        def out() -> Batches:
            if held:
                terms = np.repeat(np.array([x[0] for x in held], object), [len(x[1]) for x in held])
                yield pa.RecordBatch.from_pylist([_chunk(lang, terms, *(np.concatenate([x[i] for x in held]) for i in (1, 2)))], CHUNKS)

        for b in batches:
            for la, term, g, n in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if la != lang or len(held) >= CHUNK or entries >= ENTRIES:
                    yield from out()
                    lang, held, entries = la, [], 0
                held.append((term.encode(), np.frombuffer(g, np.int64), np.frombuffer(n, np.int64)))
                entries += len(g) >> 3
        yield from out()

    rows = counts.repartitionByRange(partitions(counts.sparkSession), "lang", "term").sortWithinPartitions("lang", "term")
    return map_batches(rows, run, "lang string, terms array<string>, g array<long>, sums array<long>, cell array<long>, n array<long>")


def totals(docs: DataFrame, parts: DataFrame) -> DataFrame:
    """(lang, source, g, n, v): the groups that occur with their sums over kept terms, and the
    number of kept terms of the language."""
    sums = parts.select(F.explode(F.arrays_zip("g", "sums")).alias("x")).groupBy(F.col("x.g").alias("g")).agg(F.sum("x.sums").alias("n"))
    v = parts.groupBy("lang").agg(F.sum(F.size("terms")).alias("v"))
    return docs.select("lang", "source", "g").distinct().join(sums, "g", "left").join(v, "lang", "left").fillna(0, ["n", "v"])


def shares(count: np.ndarray, total: int, v: int) -> np.ndarray:
    """1 + floor(UNIT * (count + SMOOTH) / (total + SMOOTH * v)) by long division, a decimal digit
    at a time: exact below 9e17 occurrences."""
    d = total + SMOOTH * v
    rest = count.astype(np.int64) + SMOOTH
    out, rest = rest // d, rest % d
    for _ in range(len(str(UNIT)) - 1):
        rest *= 10
        out, rest = out * 10 + rest // d, rest % d
    return out + 1


def _measure(chunk: dict, groups: list[dict], top: int) -> tuple[np.ndarray, list[tuple]]:
    """(differences of every two groups, (group, term, value) above the language) of one chunk."""
    terms = chunk["terms"]
    width = len(terms)
    names = [g["source"] for g in groups]
    at = {g["g"]: i for i, g in enumerate(groups)}
    v = groups[0]["v"]
    cell = np.array(chunk["cell"], np.int64)
    row = np.array([at[s] for s in chunk["g"]], np.int64)[cell // width]
    col, n = cell % width, np.array(chunk["n"], np.int64)
    q = shares(add_up(col, n, width), sum(g["n"] for g in groups), v)
    pairs = np.zeros((len(names), len(names)), np.int64)
    found = []
    step = max(1, CELLS // len(names))
    for x in range(0, width, step):  # dense in blocks of terms, so memory has a bound
        y = min(x + step, width)
        inside = (col >= x) & (col < y)
        c = np.zeros((len(names), y - x), np.int64)
        c[row[inside], col[inside] - x] = n[inside]
        p = np.stack([shares(c[i], g["n"], v) for i, g in enumerate(groups)])
        for i in range(len(names) - 1):
            pairs[i, i + 1 :] += np.abs(p[i + 1 :] - p[i]).sum(1)
        for i in range(len(names)):
            f = p[i] - q[x:y]
            j = np.flatnonzero((c[i] > 0) & (f > 0))
            best = j[np.lexsort((j, -f[j]))][:top]
            found += [(i, terms[x + k], int(f[k])) for k in best]
    return pairs, found


def audit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", least_docs: int = LEAST_DOCS, top: int = TOP) -> DataFrame:
    """(lang, source, part, item, value, rank): ``pair`` has the differences to the other sources of
    the language, ``term`` the terms furthest above the language."""
    d = keyed(docs, text_col, lang_col, source_col)
    counts = written(count_terms(d, least_docs), "audit-counts")
    parts = written(chunks(counts), "audit-chunks", "zstd")
    groups = written(totals(d, parts), "audit-groups")
    n_groups, n_hashes = groups.agg(F.count("*"), F.countDistinct("g")).first()
    if n_groups != n_hashes:
        raise ValueError("two groups share a hash")
    by_lang = groups.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("source", "g", "n", "v"))).alias("groups"))
    if n_groups <= SENT_GROUPS:
        joined = parts.join(F.broadcast(by_lang), "lang")
    else:
        salted = by_lang.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = parts.withColumn("salt", F.pmod(F.xxhash64(F.element_at("terms", 1)), F.lit(SALTS)).cast("int")).join(salted, ["lang", "salt"])

    def run(batches: Batches) -> Batches:
        """Sums and best terms of all chunks that a task sees, so far as they fit."""
        names: dict[str, list[str]] = {}
        pairs: dict[str, np.ndarray] = {}
        best: dict[tuple[str, str], list[tuple[int, str]]] = {}

        def out() -> Batches:
            rows = []
            for lang, total in pairs.items():
                a, b = np.triu_indices(len(total), 1)
                rows += [(lang, "pair", names[lang][i], names[lang][j], v) for i, j, v in zip(a.tolist(), b.tolist(), total[a, b].tolist(), strict=True)]
            rows += [(lang, "term", source, t, -f) for (lang, source), x in best.items() for f, t in x]
            if rows:
                cols = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if k == 4 else pa.string()) for k, c in enumerate(cols)], ["lang", "part", "source", "item", "value"])

        for b in batches:
            for i in range(b.num_rows):
                r = b.slice(i, 1).to_pylist()[0]
                lang, groups = r["lang"], r["groups"]
                total, found = _measure(r, groups, top)
                names[lang] = [g["source"] for g in groups]
                pairs[lang] = pairs[lang] + total if lang in pairs else total
                new: dict[tuple[str, str], list[tuple[int, str]]] = {}
                for g, t, f in found:
                    new.setdefault((lang, names[lang][g]), []).append((-f, t))
                for k, x in new.items():
                    best[k] = sorted(best.get(k, []) + x)[:top]
                if sum(x.size for x in pairs.values()) + top * len(best) > CELLS:
                    yield from out()
                    pairs, best = {}, {}
        yield from out()

    found = written(map_batches(joined.select("lang", "terms", "g", "cell", "n", "groups"), run, "lang string, part string, source string, item string, value long"), "audit-found")
    one = found.where("part = 'pair'").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    both = one.union(one.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value"))
    # every other source of the language, found or not
    others = by_lang.select("lang", F.explode("groups.source").alias("source"), F.col("groups.source").alias("all")).select("lang", "source", F.explode("all").alias("item")).where("source <> item")
    pair = others.join(both, ["lang", "source", "item"], "left").select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0)).cast("long").alias("value"))
    w = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    term = found.where("part = 'term'").select("lang", "source", "part", "item", "value").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)
    dropped(counts, parts)
    return pair.withColumn("rank", F.row_number().over(w)).union(term).select("lang", "source", "part", "item", "value", F.col("rank").cast("int").alias("rank"))


def op12_source_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(spark.read.parquet(f"{sf_dir}/documents.parquet"))


_P = f"(1 + ({UNIT}::HUGEINT * (coalesce({{c}}, 0) + {SMOOTH})) // ({{n}} + {SMOOTH} * v))"
ORACLE_OP12 = rf"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
        regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
t AS (SELECT r, lang, source, unnest(w) AS term FROM d),
kept AS (SELECT lang, term FROM t GROUP BY lang, term HAVING count(DISTINCT r) >= {LEAST_DOCS}),
g AS (SELECT DISTINCT lang, source FROM d),
gc AS (SELECT lang, source, term, count(*) AS c FROM t JOIN kept USING (lang, term) GROUP BY ALL),
lc AS (SELECT lang, term, sum(c)::BIGINT AS c FROM gc GROUP BY ALL),
v AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
gn AS (SELECT g.lang, g.source, coalesce(sum(c), 0)::BIGINT AS n FROM g LEFT JOIN gc USING (lang, source) GROUP BY ALL),
ln AS (SELECT lang, sum(c)::BIGINT AS n FROM lc GROUP BY lang),
p AS (SELECT gn.lang, gn.source, term, coalesce(gc.c, 0) AS c, {_P.format(c='gc.c', n='gn.n')} AS p, {_P.format(c='lc.c', n='ln.n')} AS q
      FROM gn JOIN kept USING (lang) JOIN v USING (lang) JOIN ln USING (lang) JOIN lc USING (lang, term) LEFT JOIN gc USING (lang, source, term)),
pd AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pair AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0)::BIGINT AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
      LEFT JOIN pd ON pd.lang = a.lang AND pd.source = a.source AND pd.item = b.source),
term AS (SELECT lang, source, 'term' AS part, term AS item, (p - q)::BIGINT AS value FROM p WHERE c > 0 AND p > q)
SELECT lang, source, part, item, value, rank::INT AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM (SELECT * FROM pair UNION ALL SELECT * FROM term))
WHERE part = 'pair' OR rank <= {TOP}"""

QUERIES = {"op12_source_audit": op12_source_audit}
ORACLE = {"op12_source_audit": ORACLE_OP12}
