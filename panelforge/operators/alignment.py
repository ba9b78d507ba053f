"""Joins and alignments: as-of, nearest, full-outer differences, ranges, graphs and histories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DateType

from .near_texts import cut


def asof(left: DataFrame, right: DataFrame, on: str, value: str, by: tuple[str, ...] = (), direction: str = "backward") -> DataFrame:
    """Each left row with the right value of the latest earlier-or-equal time (``backward``), the
    next (``forward``) or the nearer of both (``nearest``, ties to the earlier).  Null times and keys
    match nothing.  Both sides are stacked and a window in each order of time carries the values: no
    row is compared with another, and no frame is gone through anew for each row."""
    keys = [*by]
    l = left.select(*keys, on, F.lit(1).alias("_side"), F.struct(*left.columns).alias("_row"), F.lit(None).cast(right.schema[value].dataType).alias("_v"))
    r = right.select(*keys, on, F.lit(0).alias("_side"), F.lit(None).cast(l.schema["_row"].dataType).alias("_row"), F.col(value).alias("_v"))
    u = l.unionByName(r.dropna(subset=[*keys, on]))
    found = F.when(F.col("_side") == 0, F.struct(F.col(on).alias("t"), F.col("_v").alias("v")))
    carried = lambda time: F.last(found, ignorenulls=True).over(Window.partitionBy(*keys).orderBy(time, "_side").rowsBetween(Window.unboundedPreceding, 0))
    x = u.select("_side", "_row", on, carried(F.asc(on)).alias("_b"), carried(F.desc(on)).alias("_a")).where("_side = 1")
    at = F.unix_date if isinstance(left.schema[on].dataType, DateType) else lambda c: F.unix_micros(c.cast("timestamp"))
    gap = lambda c: F.abs(at(F.col(on)) - at(F.col(f"{c}.t")))
    pick = {"backward": F.col("_b.v"), "forward": F.col("_a.v"), "nearest": F.when(F.col("_a").isNull() | (gap("_b") <= gap("_a")), F.col("_b.v")).otherwise(F.col("_a.v"))}[direction]
    return x.select("_row.*", F.when(F.col(on).isNotNull(), pick).alias(value))


def difference(a: DataFrame, b: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Change of a value over the union of both tables' keys; what is missing counts 0."""
    j = a.select(*keys, F.col(value).alias("_a")).join(b.select(*keys, F.col(value).alias("_b")), keys, "full_outer")
    return j.select(*keys, (F.coalesce("_b", F.lit(0.0)) - F.coalesce("_a", F.lit(0.0))).alias("change"))


def last_n(df: DataFrame, by: str, order: str, n: int) -> DataFrame:
    """The last ``n`` rows of each key."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(by).orderBy(F.desc(order)))).where(F.col("_n") <= n).drop("_n")


def softmax(x: Column, *by: str, temperature: float = 1.0) -> Column:
    w = Window.partitionBy(*by)
    e = F.exp(temperature * (x - F.max(x).over(w)))
    return e / F.sum(e).over(w)


def cosine_pairs(vectors: DataFrame, unit: str, items: str) -> DataFrame:
    """Cosine of every two units from long (unit, index, value) rows, for few units."""
    n = vectors.groupBy(unit).agg(F.sqrt(F.sum(F.col("value") * F.col("value"))).alias("norm"))
    v = vectors.join(n, unit)
    a, b = (v.select(F.col(unit).alias(x), items, F.col("value").alias(f"v{x}"), F.col("norm").alias(f"n{x}")) for x in "ab")
    return a.join(b, items).where("a < b").groupBy("a", "b").agg(F.try_divide(F.sum(F.col("va") * F.col("vb")), F.first("na") * F.first("nb")).alias("cosine"))


def trigram_similarity(a: Column, b: Column) -> Column:
    """Jaccard similarity of the sets of three-letter pieces."""
    tri = lambda s: F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(s) - 2, F.lit(1))), lambda i: F.substring(s, i, F.lit(3))))
    x, y = tri(F.lower(a)), tri(F.lower(b))
    return F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y))


def ancestors(spark, edges: DataFrame) -> DataFrame:
    """(node, ancestor, depth) of a forest of parent links (child, parent), as recursive SQL: a row
    for each path up, however long.  Known paths are put end to end, so the reach doubles with each
    round, ended by a checkpoint: 20 rounds for a depth of a million.  A circle, whose paths have no
    end, is an error."""
    found = new = cut(edges.select(F.col("child").alias("node"), F.col("parent").alias("ancestor"), F.lit(1).alias("depth")))
    reach = 1
    while True:
        deepest, circle = new.agg(F.max("depth"), F.bool_or(F.col("node") == F.col("ancestor"))).first()
        if circle:
            raise ValueError("parent links form a circle")
        if deepest is None or deepest < reach:
            return found
        jump = new.where(F.col("depth") == reach).select("node", F.col("ancestor").alias("via"))
        up = found.select(F.col("node").alias("via"), "ancestor", "depth")
        new = cut(jump.join(up, "via").select("node", "ancestor", (F.col("depth") + reach).alias("depth")))
        found = found.unionByName(new)
        reach *= 2
