"""Order-preserving buckets over an id column, for operators that need the neighbour of a row
or a running total in global order without sorting everything into one partition."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import partitions

COARSE = 64


def _tree(col: Column, cuts: list[float], lo: int, hi: int, leaf) -> Column:
    """A balanced CASE tree: log2(hi - lo) comparisons a row."""
    if hi - lo == 1:
        return leaf(lo)
    mid = (lo + hi) // 2
    return F.when(col < F.lit(cuts[mid]), _tree(col, cuts, lo, mid, leaf)).otherwise(_tree(col, cuts, mid, hi, leaf))


def bucket_of(df: DataFrame, col: str, per_partition: int = 4) -> tuple[Column, int]:
    """(a monotone bucket expression of ``col``, number of buckets).

    At most ``COARSE`` quantiles are taken on the driver; inside each, buckets are of equal
    width.  Null ids go to bucket -1.
    """
    fine = max(1, per_partition * partitions(df.sparkSession) // COARSE)
    probs = [i / COARSE for i in range(COARSE + 1)]
    cuts = df.agg(F.percentile_approx(col, probs, 2000).alias("q")).first().q or [0, 1]
    cuts = sorted({int(x) for x in cuts})
    if len(cuts) == 1:
        cuts.append(cuts[0] + 1)
    n = len(cuts) - 1
    c = F.col(col)

    def leaf(i: int) -> Column:
        part = F.floor((c - F.lit(cuts[i])).cast("double") * F.lit(fine / (cuts[i + 1] - cuts[i])))
        return F.lit(i * fine) + F.greatest(F.lit(0), F.least(F.lit(fine - 1), part))

    return F.when(c.isNull(), -1).otherwise(_tree(c, cuts, 0, n, leaf)).cast("int"), n * fine
