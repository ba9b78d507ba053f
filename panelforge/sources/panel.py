"""Price panels in long form: (dt, asset, asset_ord, px), complete on dates x assets.

A panel is built once from events or bars: aggregated per (date, asset) with a map-side
combine, put on the spine of its dates and assets, and filled forward, then backward.  All later
windows over an asset use the same partitioning and order, so one exchange and one sort serve
them all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The seven assets of the derived panel, in column order.
TICKERS = ("SPY", "TLT", "HYG", "EEM", "GLD", "DBC", "IWM")


def by_asset(n: int | None = None) -> Window:
    """The last ``n`` rows of an asset, or all up to now."""
    w = Window.partitionBy("asset").orderBy("dt")
    return w.rowsBetween(Window.unboundedPreceding if n is None else -(n - 1), 0)


def own_rows() -> Window:
    return Window.partitionBy("asset").orderBy("dt")


def cross_section() -> Window:
    return Window.partitionBy("dt")


def date_order() -> Window:
    """Unpartitioned: only over tables with one row per date."""
    return Window.orderBy("dt")


def dates(n: int | None = None) -> Window:
    return date_order().rowsBetween(Window.unboundedPreceding if n is None else -(n - 1), 0)


def gated(value: Column, over: Column, frame: Window, n: int) -> Column:
    """``value`` over the frame, null unless the frame holds ``n`` values."""
    return F.when(F.count(over).over(frame) == n, value.over(frame))


def complete(bars: DataFrame) -> DataFrame:
    """bars(dt, asset, asset_ord, px) on the full spine, filled forward then backward.  Assets are
    few, so their list is sent to the dates."""
    spine = bars.select("dt").distinct().crossJoin(F.broadcast(bars.select("asset", "asset_ord").distinct()))
    p = spine.join(bars.select("dt", "asset", "px"), ["dt", "asset"], "left")
    ahead = own_rows().rowsBetween(0, Window.unboundedFollowing)
    p = p.withColumn("px", F.last("px", ignorenulls=True).over(by_asset()))
    return p.withColumn("px", F.coalesce("px", F.first("px", ignorenulls=True).over(ahead)))


def with_returns(panel: DataFrame) -> DataFrame:
    """Adds rn (from 1), ret, lret and diff."""
    before = F.lag("px").over(own_rows())
    return panel.select(
        "*",
        F.row_number().over(own_rows()).alias("rn"),
        (F.try_divide("px", before) - 1).alias("ret"),
        F.ln(F.try_divide("px", before)).alias("lret"),
        (F.col("px") - before).alias("diff"),
    )


def _total(col: str):
    """A sum in decimals, which no order of rows changes, as a double."""
    return F.sum(F.col(col).cast("decimal(18,2)")).cast("double")


def lineitem_panel(spark: SparkSession, sf_dir: str, unit: str = "week") -> DataFrame:
    """Average price per unit of the seven line numbers, by week or day."""
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    tick = F.element_at(F.array(*map(F.lit, TICKERS)), F.col("l_linenumber").cast("int"))
    px = _total("l_extendedprice") / _total("l_quantity")
    bars = li.groupBy(F.date_trunc(unit, "l_shipdate").cast("date").alias("dt"), tick.alias("asset"), F.col("l_linenumber").cast("int").alias("asset_ord")).agg(px.alias("px"))
    return complete(bars)


def orders_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean order price per week and priority: a sparse panel of five assets."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    bars = o.groupBy(F.date_trunc("week", "o_orderdate").cast("date").alias("dt"), F.col("o_orderpriority").alias("asset")).agg(F.round(F.avg("o_totalprice"), 4).alias("px"))
    return complete(bars.withColumn("asset_ord", F.substring("asset", 1, 1).cast("int")))


def events_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean event value per day and type."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    bars = e.groupBy(F.to_date("ts").alias("dt"), F.col("event_type").alias("asset")).agg(F.round(F.avg("value"), 4).alias("px"))
    return complete(bars.withColumn("asset_ord", F.lit(0)))


#: The same panels for DuckDB, as common table expressions that end in ``p`` (with returns).
def _sql(bars: str) -> str:
    return f"""bars AS ({bars}),
spine AS (SELECT * FROM (SELECT DISTINCT dt FROM bars) CROSS JOIN (SELECT DISTINCT asset, asset_ord FROM bars)),
filled AS (SELECT s.dt, s.asset, s.asset_ord, last_value(px IGNORE NULLS) OVER (PARTITION BY s.asset ORDER BY s.dt ROWS UNBOUNDED PRECEDING) AS px
        FROM spine s LEFT JOIN bars b ON b.dt = s.dt AND b.asset = s.asset),
full_ AS (SELECT dt, asset, asset_ord, coalesce(px, first_value(px IGNORE NULLS) OVER (PARTITION BY asset ORDER BY dt ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS px FROM filled),
p AS (SELECT *, row_number() OVER w AS rn, px / lag(px) OVER w - 1 AS ret, ln(px / lag(px) OVER w) AS lret, px - lag(px) OVER w AS diff
      FROM full_ WINDOW w AS (PARTITION BY asset ORDER BY dt))"""


def lineitem_sql(unit: str = "week") -> str:
    ticks = ", ".join(f"'{t}'" for t in TICKERS)
    return _sql(
        f"""SELECT date_trunc('{unit}', l_shipdate)::DATE AS dt, ([{ticks}])[l_linenumber] AS asset, l_linenumber::INT AS asset_ord,
  sum(l_extendedprice::DECIMAL(18, 2))::DOUBLE / sum(l_quantity::DECIMAL(18, 2))::DOUBLE AS px FROM lineitem GROUP BY 1, 2, 3"""
    )


def orders_sql() -> str:
    return _sql("SELECT date_trunc('week', o_orderdate)::DATE AS dt, o_orderpriority AS asset, substr(o_orderpriority, 1, 1)::INT AS asset_ord, round(avg(o_totalprice), 4) AS px FROM orders GROUP BY 1, 2, 3")


def events_sql() -> str:
    return _sql("SELECT ts::DATE AS dt, event_type AS asset, 0 AS asset_ord, round(avg(value), 4) AS px FROM events GROUP BY 1, 2, 3")
