"""Near texts: which of them to keep, best first, so that no two kept ones are alike.

Two texts are alike when the Jaccard similarity of their sets of three-letter pieces is above
``OVER[0] / OVER[1]``.  Links come from a join on rare pieces, never from all pairs, and the choice
is made in rounds over links alone, so neither step needs one task or the driver to see all rows.
"""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Alike above this share: 0.85, as a fraction, so that comparisons are exact.
OVER = (17, 20)


def cut(df: DataFrame) -> DataFrame:
    """End the lineage in the session's shared folder; only a local session may go without one."""
    spark = df.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            base = tempfile.gettempdir()
        spark.sparkContext.setCheckpointDir(base)
    return df.checkpoint()


def trigrams(text: Column) -> Column:
    """Sorted distinct three-letter pieces without regard to case and spaces; the letters of texts
    that have fewer than three, nothing of empty and null ones."""
    s = F.lower(F.regexp_replace(F.coalesce(text, F.lit("")), " ", ""))
    c = F.when(s == "", F.array().cast("array<string>")).otherwise(F.split(s, ""))
    three = F.transform(F.slice(c, F.lit(1), F.greatest(F.size(c) - 2, F.lit(0))), lambda x, i: F.concat(x, F.get(c, i + 1), F.get(c, i + 2)))
    return F.array_sort(F.array_distinct(F.when(F.size(c) < 3, c).otherwise(three)))


def links(sets: DataFrame, over: tuple[int, int] = OVER) -> DataFrame:
    """Every two rows of ``sets`` (id, pieces), all sets different, that are alike: (a, b).

    A piece's order is its rarity.  Two alike sets share a piece among each one's rarest
    ``n - floor(n * over)``, at places that leave room for the overlap, and their sizes are near.
    Rows meet on (piece, smaller size), so a common piece's rows are dealt by size; what is found
    is confirmed on the full sets."""
    num, den = over
    flat = sets.select("id", F.explode("pieces").alias("piece"))
    freq = flat.groupBy("piece").agg(F.count("*").alias("f"))
    ordered = flat.join(freq, "piece").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("f", "piece"))).alias("p"))
    n = F.size("p")
    floor = F.floor(n * num / den).cast("int")
    rare = ordered.select("id", n.alias("n"), floor.alias("least"), F.posexplode(F.slice("p", F.lit(1), n - floor)).alias("at", "x"))
    small = rare.select(F.col("x.piece").alias("piece"), F.col("n").alias("size"), F.col("id").alias("a"), "n", "at")
    large = rare.select(F.col("x.piece").alias("piece"), F.explode(F.sequence(F.col("least") + 1, F.col("n"))).alias("size"), F.col("id").alias("b"), F.col("n").alias("m"), F.col("at").alias("bt"))
    room = F.least(F.col("n") - F.col("at"), F.col("m") - F.col("bt"))  # the most they can share from here on
    met = small.join(large, ["piece", "size"]).where((F.col("n") < F.col("m")) | (F.col("a") < F.col("b"))).where(room * (num + den) > num * (F.col("n") + F.col("m")))
    pairs = met.select("a", "b").distinct()
    full = pairs.join(sets.select(F.col("id").alias("a"), F.col("pieces").alias("x")), "a").join(sets.select(F.col("id").alias("b"), F.col("pieces").alias("y")), "b")
    both = F.size(F.array_intersect("x", "y"))
    return full.where(both * den > num * (F.size("x") + F.size("y") - both)).select("a", "b")


def first_independent(edges: DataFrame) -> DataFrame:
    """(node) that are dropped when nodes are taken in order and a node goes if it is linked with
    an earlier one that stays.  ``edges`` has (first, then), ``first`` earlier in that order.

    A round keeps every node that no link points at, drops what those point at, and forgets the
    links of both; what is left are links between the undecided.  There are as many rounds as the
    longest chain of decisions that wait for each other, few unless links form long ladders."""
    left = cut(edges.select("first", "then").distinct())
    gone = left.select(F.col("then").alias("node")).limit(0)
    while not left.isEmpty():
        waiting = left.select(F.col("then").alias("first")).distinct()
        heads = left.join(waiting, "first", "left_anti")
        lost = cut(heads.select(F.col("then").alias("node")).distinct())
        gone = gone.unionByName(lost)
        open_ = left.join(heads.select("first").distinct(), "first", "left_anti")
        for end in ("first", "then"):
            open_ = open_.join(lost.select(F.col("node").alias(end)), end, "left_anti")
        left = cut(open_.select("first", "then"))
    return gone


def keep_best(items: DataFrame, id: str, text: str, score: str, max_keep: int | None = None, over: tuple[int, int] = OVER) -> DataFrame:
    """Items (id, score) in falling score, ties to the smaller id, without those alike a better one
    that is kept; at most ``max_keep`` of them, the best.  Null and NaN scores come last; empty and null
    texts are alike each other and nothing else; an empty table gives an empty one.  ``id`` is unique.

    Equal sets are grouped first, with partial sums, so copies never meet each other."""
    order = F.struct(F.col(score).isNull().alias("none"), (-F.col(score)).alias("low"), F.col(id).alias("id"))
    best = items.select(trigrams(F.col(text)).alias("pieces"), order.alias("o"), F.col(score).alias("s")).groupBy("pieces").agg(F.min(F.struct("o", "s")).alias("m"))
    best = cut(best.select(F.col("m.o.id").alias("id"), F.col("m.o").alias("o"), F.col("m.s").alias("s"), "pieces"))
    place = best.select("id", "o")
    met = links(best.select("id", "pieces"), over)
    met = met.join(place.select(F.col("id").alias("a"), F.col("o").alias("oa")), "a").join(place.select(F.col("id").alias("b"), F.col("o").alias("ob")), "b")
    ahead = F.col("oa") < F.col("ob")
    edges = met.select(F.when(ahead, F.col("a")).otherwise(F.col("b")).alias("first"), F.when(ahead, F.col("b")).otherwise(F.col("a")).alias("then"))
    kept = best.join(first_independent(edges).select(F.col("node").alias("id")), "id", "left_anti")
    if max_keep is not None:
        kept = kept.orderBy("o").limit(max_keep)
    return kept.select(F.col("id").alias(id), F.col("s").alias(score))
