"""Connected components over an edge table, without collecting any of it.

Each task first reduces its edges to a forest of stars.  Then large-star and small-star steps
alternate: each takes a grouped minimum (combined on the map side) and a join on the same key,
where a hub's rows can be split.  Every round is written to the shared folder, so a lost
executor costs one round.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, map_batches, written


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Union-find over the edges of one task: each node with the smallest of its part."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        root = x
        while (up := parent.get(root, root)) != root:
            root = up
        while x != root:
            parent[x], x = root, parent.get(x, x)
        return root

    for b in batches:
        for x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            p, q = find(x), find(y)
            if p != q:
                parent[max(p, q)] = min(p, q)
                parent.setdefault(min(p, q), min(p, q))
    nodes = [(x, r) for x in parent if (r := find(x)) != x]
    for a in range(0, len(nodes), 50_000):
        u, v = zip(*nodes[a : a + 50_000], strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])


def _stars(e: DataFrame) -> bool:
    """Whether every node has one parent, which has none."""
    twice = e.groupBy("u").count().where("count > 1")
    chain = e.select("u").join(e.select(F.col("v").alias("u")).distinct(), "u", "left_semi")
    return twice.isEmpty() and chain.isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """edges(a, b), any order, repeated or not -> (node, label): the smallest node reachable.
    Nodes that are their own label are left out."""
    spark = edges.sparkSession
    e = edges.select(F.col("a").cast("long"), F.col("b").cast("long")).where("a <> b").coalesce(max(1, spark.sparkContext.defaultParallelism))
    e = written(map_batches(e, _forest, "u long, v long"), "edges")
    while not _stars(e):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        last, e = e, written(small.unionByName(least.withColumnRenamed("m", "v")).distinct(), "edges")
        dropped(last)
    return e.select(F.col("u").alias("node"), F.col("v").alias("label"))
