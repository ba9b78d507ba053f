"""Near duplicates by an LSH forest over MinHash signatures.

A text's set is that of its distinct five-word shingles (the whole sequence where it has fewer
words).  Texts with equal sets are one class.  Each class gets 64 minima; the forest has eight
trees, each of which reads the signature from another place, so sorting by a tree's order brings
the longest common prefixes together.  The table of all trees is range-partitioned by the order
itself, so no prefix, however common, is one task's.

The depth adapts to the region: a row's region is the widest run of rows around it with a common
prefix that has at most ``REACH + 1`` rows.  Where few classes share a first minimum, that is all of
them; in a crowded place the prefix gets longer until the run is small enough.  All pairs within a
region are candidates, and so are the next ``BESIDE`` rows on either side with any common prefix.
Three rounds:

1. in every tree each class proposes the candidate with the longest common prefix (ties: the more
   alike by a sketch); proposals are confirmed on the full sets and give components;
2. the trees are read again with the components as labels: all candidates in different components
   are confirmed;
3. the exact way for crowded places, where pairs with a short common prefix lie in different
   regions: classes that share a first minimum with more than ``REACH`` others, not all of one
   component, are grouped anew by three minima each, in 21 orders that use all 64.  In every
   group with several components all classes outside the largest one are compared with all of the
   group, block by block: first by sketches, which leaves the classes that have a candidate in
   another component; then, among these, on the full sets.  Tasks give out such classes and
   links, never pairs of candidates.

Only pairs whose sketches estimate them more than ``DEVIATIONS`` standard deviations below 75 % are
never confirmed.  A pair at 75 % is missed by all eight trees with probability 0.25 ** 8, and in a
crowded place by all 21 orders with 0.58 ** 21, about one in 100,000 either way.

A group of thousands of near copies costs a few confirmations per member.  Confirming deals the
texts by pair: a text that many pairs need is sent once for each ``FAN`` of them, so no text's pairs
are one task's.

Defined results: a null or empty text has an empty set and is linked with nothing; rows with
equal ids are one node; a row without id gets its class's component, or none; an empty table
gives no rows; other columns are ignored (``one_of_each`` keeps them).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, blocks, dropped, fresh, map_batches, mix, partitions, span_hash, text_bytes, word_spans, written
from .graph import components

WORDS = 5
HASHES = 64
TREES = 8
DEPTH = 16
REACH = 16
BESIDE = 4
DEEP, ORDERS = 3, 21  # of the third round
SIDE = 512  # rows of a block there
FAN = 64
SIMILAR = 75  # percent
BINS = 256  # of the sketch by which likeness is estimated
DEVIATIONS = 4.5  # below 75 % that an estimate may fall for the pair still to be confirmed
SEND_AT_MOST = 4_000_000  # ids that are broadcast; more are joined
_RND = np.random.default_rng(77)
_MUL = _RND.integers(1, 1 << 63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLACE = _RND.integers(1, 1 << 63, WORDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
ROW = np.dtype([("key", ">u4", DEPTH)])


def shingles(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hashes of the distinct shingles, ascending within each document; offsets)."""
    low = LOWER[data]
    start, end, first = word_spans(low, off)
    h = span_hash(low, start, end)
    n = np.diff(first)
    count = np.where(n >= WORDS, n - WORDS + 1, np.minimum(n, 1))
    at = np.concatenate([[0], np.cumsum(count)])
    doc = np.repeat(np.arange(len(n)), count)
    begin = first[doc] + np.arange(at[-1]) - at[doc]
    s = np.zeros(int(at[-1]), np.uint64)
    short = n[doc] < WORDS
    for j in range(WORDS):
        use = ~short | (j < n[doc])
        s[use] += h[(begin + j)[use]] * _PLACE[j]
    s = mix(s + np.where(short, n[doc], 0).astype(np.uint64) * np.uint64(0xA24BAED4963EE407))
    keep = np.ones(len(s), bool)
    for x, y in zip(at.tolist(), at[1:].tolist(), strict=False):
        part = s[x:y]
        part.sort()
        keep[x + 1 : y] = part[1:] != part[:-1]
    return s[keep], np.searchsorted(np.flatnonzero(keep), at)


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, set_key (of the whole set), minima, and a sketch: shingles are dealt to
    bins, and a byte of each bin's least one is kept (0: the bin is empty)."""
    schema = "doc_id long, n_shingles long, set_key binary, minima binary, sketch binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches, "text", 1 << 20):
            s, at = shingles(*text_bytes(b.column("text")))
            n = np.diff(at)
            has = np.flatnonzero(n)
            cols: list[list] = [[None] * len(n) for _ in range(3)]
            if len(has):
                begin = at[has]
                keys = np.stack([np.add.reduceat(mix(s ^ np.uint64(k)), begin) for k in (3, 5)] + [n[has].astype(np.uint64)], axis=1).astype(">u8")
                minima = np.empty((len(has), HASHES), np.uint32)
                for j in range(HASHES):
                    minima[:, j] = np.minimum.reduceat(((s * _MUL[j]) >> np.uint64(32)).astype(np.uint32), begin)
                minima = minima.astype(">u4")
                m = mix(s + np.uint64(99))
                least = np.full(len(n) * BINS, 0xFFFFFFFF, np.uint32)
                at_bin = np.repeat(np.arange(len(n)), n) * BINS + (m >> np.uint64(56)).astype(np.int64)
                np.minimum.at(least, at_bin, (m & np.uint64(0xFFFFFFFE)).astype(np.uint32))
                sketch = np.where(least == 0xFFFFFFFF, 0, 1 + least // 2 % 255).astype(np.uint8).reshape(-1, BINS)
                for i, d in enumerate(has.tolist()):
                    cols[0][d], cols[1][d], cols[2][d] = keys[i].tobytes(), minima[i].tobytes(), sketch[d].tobytes()
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), *(pa.array(c, pa.binary()) for c in cols)], ["doc_id", "n_shingles", "set_key", "minima", "sketch"])

    return map_batches(docs, run, schema)


def _orders(classes: DataFrame, n_rows: int) -> DataFrame:
    """A row per class and tree, in the trees' orders."""
    twice = F.concat("minima", "minima")
    trees = F.explode(F.array(*[F.struct(F.lit(t).alias("tree"), F.substring(twice, 4 * t * (HASHES // TREES) + 1, 4 * DEPTH).alias("key")) for t in range(TREES)]))
    rows = classes.select(trees.alias("o"), "rep", "label", "sketch", "n").select("o.tree", "o.key", "rep", "label", "sketch", "n")
    n = max(1, min(partitions(classes.sparkSession), n_rows * TREES // 2000))
    return rows.repartitionByRange(n, "tree", "key", "rep").sortWithinPartitions("tree", "key", "rep")


def _alike(sketch: np.ndarray, size: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Estimated likeness in thousandths; -1 where it is too far below 75 %.  The bins are a sample
    without replacement of the union, which has at most (size_i + size_j) / 1.75 shingles."""
    out = np.empty(len(i), np.int64)
    for a in range(0, len(i), 1 << 13):
        x, y = sketch[i[a : a + (1 << 13)]], sketch[j[a : a + (1 << 13)]]
        either = ((x | y) != 0).sum(axis=1)
        same = ((x == y) & (x != 0)).sum(axis=1) / np.maximum(either, 1)
        union = (size[i[a : a + (1 << 13)]] + size[j[a : a + (1 << 13)]]) / 1.75
        seen = np.minimum(either / np.maximum(union, 1), 0.95)
        ok = same >= SIMILAR / 100 - DEVIATIONS * np.sqrt(0.1875 / np.maximum(either, 1) * (1 - seen)) - 1 / np.maximum(either, 1)
        out[a : a + (1 << 13)] = np.where(ok, (1000 * same).astype(np.int64), -1)
    return out


def _depths(prefix: np.ndarray) -> np.ndarray:
    """For rows in order, whose neighbours share prefixes of these lengths: the least depth (1 at
    least) at which a row's run has no more than ``REACH + 1`` rows; ``DEPTH`` where none has."""
    n = len(prefix) + 1
    depth = np.zeros(n, np.int64)
    for d in range(1, DEPTH):
        start = np.concatenate([[0], np.flatnonzero(prefix < d) + 1])
        size = np.diff(np.concatenate([start, [n]]))
        depth[(depth == 0) & np.repeat(size <= REACH + 1, size)] = d
        if depth.all():
            break
    depth[depth == 0] = DEPTH
    return depth


def _near(tree: np.ndarray, key: np.ndarray, sketch: np.ndarray, size: np.ndarray, label: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Candidates (i, j, estimated likeness) among rows in order.  Without labels: each row's
    neighbour with the longest common prefix; with labels: all neighbours of another label."""
    n = len(tree)
    none = np.zeros(0, np.int64)
    if n < 2:
        return none, none, none
    same = (tree[1:] == tree[:-1])[:, None] & (key[1:] == key[:-1])
    prefix = np.logical_and.accumulate(same, axis=1).sum(axis=1)
    depth = _depths(prefix)
    best, partner = np.full(n, -1), np.full(n, -1)
    found: list[tuple] = []
    common = prefix.copy()  # of the rows i and i + o
    for o in range(1, min(REACH, n - 1) + 1):
        least = np.maximum(depth[: n - o], depth[o:]) if o > BESIDE else 1
        i = np.flatnonzero(common >= least)
        j = i + o
        if label is not None:
            other = label[i] != label[j]
            i, j = i[other], j[other]
        e = _alike(sketch, size, i, j)
        ok = e >= 0
        i, j, e = i[ok], j[ok], e[ok]
        if label is not None:
            found.append((i, j, e))
        else:
            rank = common[i] * 1001 + e
            for x, y in ((i, j), (j, i)):
                up = rank > best[x]
                best[x[up]], partner[x[up]] = rank[up], y[up]
        common = np.minimum(common[: n - o - 1], prefix[o:])
    if label is None:
        i = np.flatnonzero(partner >= 0)
        return i, partner[i], best[i] % 1001
    return tuple(np.concatenate(c) for c in zip(*found, strict=True))


def _candidates(classes: DataFrame, n_rows: int, labelled: bool) -> DataFrame:
    """(a, b, label_a, label_b, equal): what the trees propose.  Runs that a partition's border
    cuts are joined in a second step, over ``REACH`` rows from either side of each border."""
    schema = "a long, b long, label_a long, label_b long, equal int, border int, tree int, key binary, sketch binary, n int"
    names = [x.split(" ")[0] for x in schema.split(", ")]
    kinds = [pa.int64()] * 4 + [pa.int32()] * 3 + [pa.binary()] * 2 + [pa.int32()]

    def arrays(rows: list[tuple]) -> tuple:
        t, k, r, lab, sketch, n = zip(*rows, strict=True)
        return (
            np.array(t),
            np.frombuffer(b"".join(k), ">u4").reshape(-1, DEPTH),
            np.array(r, np.int64),
            np.array(lab, np.int64) if labelled else None,
            np.frombuffer(b"".join(sketch), np.uint8).reshape(-1, BINS),
            np.array(n, np.int64),
        )

    def pairs(rows: list[tuple], skip: int = 0) -> pa.RecordBatch | None:
        """skip: of the first rows all pairs have been seen."""
        t, k, r, lab, sketch, n = arrays(rows)
        i, j, e = _near(t, k, sketch, n, lab)
        new = np.maximum(i, j) >= skip
        i, j, e = i[new], j[new], e[new]
        if not len(i):
            return None
        la, lb = (lab[i], lab[j]) if labelled else (r[i], r[j])
        empty = [pa.nulls(len(i), x) for x in kinds[5:]]
        return pa.RecordBatch.from_arrays([pa.array(r[i]), pa.array(r[j]), pa.array(la), pa.array(lb), pa.array(e.astype(np.int32)), *empty], names)

    def edges(rows: list[tuple], border: int) -> pa.RecordBatch:
        t, k, r, lab, sketch, size = zip(*rows, strict=True)
        n = len(rows)
        nul = pa.nulls(n, pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(r, pa.int64()), nul, pa.array(lab, pa.int64()), nul, pa.nulls(n, pa.int32()), pa.array([border] * n, pa.int32()), pa.array(t, pa.int32()), pa.array(k, pa.binary()), pa.array(sketch, pa.binary()), pa.array(size, pa.int32())], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        held: list[tuple] = []
        first: list[tuple] = []
        skip = 0
        for b in batches:
            rows = list(zip(*(b.column(c).to_pylist() for c in ("tree", "key", "rep", "label", "sketch", "n")), strict=True))
            first += rows[: max(0, REACH - len(first))]
            held += rows
            if len(held) >= 60_000:
                if out := pairs(held, skip):
                    yield out
                held = held[-4 * REACH :]
                skip = len(held)
        if len(held) > skip and (out := pairs(held, skip)):
            yield out
        if first:
            yield edges(first, part - 1)
            yield edges(held[-REACH:], part)

    raw = written(map_batches(_orders(classes, n_rows), run, schema), "forest")

    def across(key: tuple, t: pa.Table) -> pa.Table:
        rows = sorted(zip(*(t.column(c).to_pylist() for c in ("tree", "key", "a", "label_a", "sketch", "n")), strict=True), key=lambda x: x[:3])
        out = pairs(rows)
        return pa.Table.from_batches([out] if out else [], pa.schema(list(zip(names, kinds, strict=True))))

    over = raw.where("border is not null").groupBy("border").applyInArrow(across, schema)
    cols = ["a", "b", "label_a", "label_b", "equal"]
    return raw.where("border is null").select(*cols).unionByName(over.select(*cols))


def _blocks(classes: DataFrame, *more: str) -> DataFrame:
    """The third round's groups, dealt in blocks: all of a group's classes (``few`` false) against
    those outside its largest component (``few`` true)."""
    trees = F.explode(F.array(*[F.struct(F.lit(t).alias("tree"), F.substring("minima", 4 * t * (HASHES // TREES) + 1, 4).alias("key")) for t in range(TREES)]))
    first = classes.select("rep", "label", trees.alias("o")).select("rep", "label", "o.tree", "o.key")
    wide = first.groupBy("tree", "key").agg(F.count("*").alias("n"), F.min("label").alias("x"), F.max("label").alias("y")).where(F.col("x") != F.col("y"))
    if not more:
        wide = wide.where(F.col("n") > REACH + 1)
    reps = first.join(wide.select("tree", "key"), ["tree", "key"], "left_semi").groupBy("rep").agg(F.lit(1).alias("x")).select("rep")

    orders = F.explode(F.array(*[F.struct(F.lit(t).alias("tree"), F.substring("minima", 4 * t * DEEP + 1, 4 * DEEP).alias("key")) for t in range(ORDERS)]))
    deep = classes.select("rep", "label", "minima").join(reps, "rep", "left_semi").select("rep", "label", orders.alias("o")).select("rep", "label", "o.tree", "o.key")
    deep = written(deep, "deep")
    parts = deep.groupBy("tree", "key", "label").agg(F.count("*").alias("n"))
    groups = parts.groupBy("tree", "key").agg(F.count("*").alias("labels"), F.sum("n").alias("n"), F.max("n").alias("top"), F.max_by("label", F.struct("n", "label")).alias("main")).where("labels > 1")
    groups = groups.select("tree", "key", "main", F.ceil(F.col("n") / SIDE).cast("int").alias("of_all"), F.ceil((F.col("n") - F.col("top")) / SIDE).cast("int").alias("of_few"))
    members = deep.join(groups, ["tree", "key"]).join(classes.select("rep", "minima", "sketch", "n", *more), "rep")
    each = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    cols = ["tree", "key", "rep", "label", "minima", "sketch", "n", *more]
    every = members.select(*cols, F.pmod(F.xxhash64("rep"), F.col("of_all")).cast("int").alias("block"), each("of_few").alias("part"), F.lit(False).alias("few"))
    few = members.where(F.col("label") != F.col("main")).select(*cols, F.pmod(F.xxhash64("rep"), F.col("of_few")).cast("int").alias("part"), each("of_all").alias("block"), F.lit(True).alias("few")).select(*every.columns)
    at = ["tree", "key", "block", "part"]
    return every.unionByName(few).repartition(partitions(classes.sparkSession), *at).sortWithinPartitions(*at)


def _alike_in_blocks(dealt: DataFrame, exact: bool) -> DataFrame:
    """Of the blocks' pairs in different components that the sketches do not rule out: the classes
    (rep), or, where ``exact``, those alike on the full sets, one for a class and a component.  A
    pair is taken in the first order that brings it together."""
    schema = "a long, b long, label_a long, label_b long" if exact else "rep long"
    names = ["tree", "key", "block", "part", "few", "rep", "label", "n", "minima", "sketch"] + ["shingles"] * exact

    def compare(rows: list[tuple]) -> pa.RecordBatch | None:
        cols = list(zip(*rows, strict=True))
        few = np.array(cols[4])
        rep, lab, size = (np.array(c, np.int64) for c in cols[5:8])
        minima = np.frombuffer(b"".join(cols[8]), ">u4").reshape(len(rows), HASHES)[:, : DEEP * ORDERS].reshape(-1, ORDERS, DEEP)
        sketch = np.frombuffer(b"".join(cols[9]), np.uint8).reshape(-1, BINS)
        right = np.flatnonzero(~few)
        found: list[tuple] = []
        seen = np.zeros(len(rows), bool)
        for k in np.flatnonzero(few):
            j = right[(lab[right] != lab[k]) & (100 * np.minimum(size[right], size[k]) >= SIMILAR * np.maximum(size[right], size[k]))]
            j = j[(minima[j] == minima[k]).all(axis=2).argmax(axis=1) == rows[0][0]]
            j = j[_alike(sketch, size, np.full(len(j), k), j) >= 0]
            if not exact:
                seen[j] = True
                seen[k] |= len(j) > 0
                continue
            mine, done = np.frombuffer(cols[10][k], np.uint64), set()
            for x in j.tolist():
                if int(lab[x]) not in done:
                    other = np.frombuffer(cols[10][x], np.uint64)
                    both = len(np.intersect1d(mine, other, assume_unique=True))
                    if both and 100 * both >= SIMILAR * (len(mine) + len(other) - both):
                        done.add(int(lab[x]))
                        found.append((int(rep[k]), int(rep[x]), int(lab[k]), int(lab[x])))
        if not exact:
            return pa.RecordBatch.from_arrays([pa.array(np.unique(rep[seen]))], ["rep"]) if seen.any() else None
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], ["a", "b", "label_a", "label_b"]) if found else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for b in batches:
            for r in zip(*(b.column(c).to_pylist() for c in names), strict=True):
                if held and r[:4] != held[0][:4]:
                    if x := compare(held):
                        yield x
                    held = []
                held.append(r)
        if held and (x := compare(held)):
            yield x

    return map_batches(dealt.select(*names), run, schema)


def shingle_sets(docs: DataFrame) -> DataFrame:
    """doc_id, shingles: the hashes of the set, 8 bytes each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches, "text", 1 << 20):
            s, at = shingles(*text_bytes(b.column("text")))
            sets = [s[x:y].tobytes() for x, y in zip(at.tolist(), at[1:].tolist(), strict=False)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(sets, pa.binary())], ["doc_id", "shingles"])

    return map_batches(docs, run, "doc_id long, shingles binary")


def _crowded_links(classes: DataFrame, labels: DataFrame, docs: DataFrame) -> DataFrame | None:
    """The third round."""
    state = classes.join(labels, "rep").select("rep", "minima", "sketch", "n", "label")
    some = written(_alike_in_blocks(_blocks(state), False).distinct(), "crowded")
    if some.isEmpty():
        return None
    sets = shingle_sets(docs.join(some.withColumnRenamed("rep", "doc_id"), "doc_id", "left_semi"))
    again = written(state.join(sets.withColumnRenamed("doc_id", "rep"), "rep"), "crowded")
    links = written(_alike_in_blocks(_blocks(again, "shingles"), True), "crowded")
    dropped(some, again)
    return links


def confirmed(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """The pairs (a, b, label_a, label_b) of a written table whose full sets are alike enough.  Only
    texts that occur in a pair are dealt, one copy for each ``FAN`` pairs that need it."""
    uses = written(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).groupBy("doc_id").agg(F.ceil(F.count("*") / FAN).cast("int").alias("copies")), "uses")
    few = uses.count() <= SEND_AT_MOST
    texts = docs.join(F.broadcast(uses) if few else uses, "doc_id").select("doc_id", "text", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("salt"))
    hubs = written(uses.where("copies > 1"), "hubs")  # at most one for each FAN / 2 pairs

    def dealt(df: DataFrame, me: str, other: str) -> DataFrame:
        h = hubs.select(F.col("doc_id").alias(me), "copies")
        salt = F.pmod(F.xxhash64(other), F.coalesce("copies", F.lit(1))).cast("int")
        return df.join(h, me, "left").withColumn(f"salt_{me}", salt).drop("copies")

    p = dealt(dealt(pairs.select("a", "b", "label_a", "label_b"), "a", "b"), "b", "a")
    side = lambda c: texts.select(F.col("doc_id").alias(c), F.col("salt").alias(f"salt_{c}"), F.col("text").alias(f"text_{c}"))
    two = p.join(side("a"), ["a", "salt_a"]).join(side("b"), ["b", "salt_b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in blocks(batches, "text_a", 1 << 20):
            for b in blocks(iter([whole]), "text_b", 1 << 20):
                s, at = shingles(*text_bytes(b.column("text_a")))
                u, to = shingles(*text_bytes(b.column("text_b")))
                keep = []
                for i in range(b.num_rows):
                    x, y = s[at[i] : at[i + 1]], u[to[i] : to[i + 1]]
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    keep.append(both > 0 and 100 * both >= SIMILAR * (len(x) + len(y) - both))
                yield pa.RecordBatch.from_arrays([b.column(c) for c in ("a", "b", "label_a", "label_b")], ["a", "b", "label_a", "label_b"]).filter(pa.array(keep, pa.bool_()))

    out = written(map_batches(two.select("a", "b", "label_a", "label_b", "text_a", "text_b"), run, "a long, b long, label_a long, label_b long"), "confirmed")
    dropped(uses, hubs)
    return out


def _relabelled(classes: DataFrame, links: DataFrame) -> DataFrame:
    """(rep, label) of all classes, after links (label_a, label_b) between components."""
    top = components(links.select(F.col("label_a").alias("a"), F.col("label_b").alias("b"))).select(F.col("node").alias("label"), F.col("label").alias("top"))
    return written(classes.select("rep", "label").join(top, "label", "left").select("rep", F.coalesce("top", "label").alias("label")), "labels")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row."""
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    sig = written(signatures(d), "signatures")
    classes = sig.where("set_key is not null").groupBy("set_key").agg(F.min("doc_id").alias("rep"), F.first("minima").alias("minima"), F.first("sketch").alias("sketch"), F.first("n_shingles").cast("int").alias("n")).where("rep is not null")
    classes = written(classes, "classes")
    n = classes.count()
    ordered = [F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")]

    def swapped(df: DataFrame) -> DataFrame:
        """The smaller id first, with its label."""
        up = F.col("a") < F.col("b")
        return df.select(*ordered, F.when(up, F.col("label_a")).otherwise(F.col("label_b")).alias("label_a"), F.when(up, F.col("label_b")).otherwise(F.col("label_a")).alias("label_b")).where("a <> b").dropDuplicates(["a", "b"])

    cand = _candidates(classes.withColumn("label", F.lit(None).cast("long")), n, False)
    seen = written(cand.select(*ordered).where("a <> b").distinct(), "proposals")
    links = confirmed(seen.select("a", "b", F.col("a").alias("label_a"), F.col("b").alias("label_b")), d)
    labels = _relabelled(classes.select("rep", F.col("rep").alias("label")), links)

    #: A class that the sketches kept from every proposal has no candidate in its regions.
    nodes = seen.select(F.explode(F.array("a", "b")).alias("rep")).distinct()
    again = written(classes.join(nodes, "rep", "left_semi").join(labels, "rep").select("rep", "minima", "sketch", "n", "label"), "labelled")
    more = written(swapped(_candidates(again, again.count(), True)).join(seen, ["a", "b"], "left_anti"), "proposals")
    dropped(again, links)
    if not more.isEmpty():
        labels = _relabelled(labels, confirmed(more, d))

    links = _crowded_links(classes, labels, d)
    if links is not None and not links.isEmpty():
        labels = _relabelled(labels, links)

    by_class = classes.select("set_key", "rep").join(labels, "rep").select("set_key", F.col("label").alias("component_id"))
    out = sig.select("doc_id", "n_shingles", "set_key").join(by_class, "set_key", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull()))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each group, with all columns."""
    v = written(near_duplicates(docs, id_col, text_col), "verdicts")
    mark = fresh(docs, "_gone")
    gone = v.where("not kept and doc_id is not null").groupBy(F.col("doc_id").alias(mark)).agg(F.lit(1).alias("x")).select(mark)
    out = docs.join(gone, docs[id_col] == gone[mark], "left_anti")
    twice = v.where("doc_id is not null").groupBy("doc_id").count().where("count > 1")
    if twice.isEmpty():
        return out
    cols = out.columns
    rest = out.where(F.col(id_col).isNull())
    return out.where(F.col(id_col).isNotNull()).dropDuplicates([id_col]).select(*cols).unionByName(rest)


def op2_minhash_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op2_minhash_forest": op2_minhash_forest}
