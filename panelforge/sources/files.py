"""File sources and sinks: CSV price files, Parquet cache, JSON state, and quality checks."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_wide_csv(panel: DataFrame, path: str, tickers: Iterable[str]) -> None:
    """One column per ticker, one row per date."""
    wide = panel.groupBy("dt").pivot("asset", list(tickers)).agg(F.first("px"))
    wide.orderBy("dt").coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def read_wide_csv(spark: SparkSession, path: str, tickers: Iterable[str]) -> DataFrame:
    """A wide price file as bars(dt, asset, asset_ord, px), read with a given schema."""
    tickers = list(tickers)
    schema = "dt date, " + ", ".join(f"`{t}` double" for t in tickers)
    wide = spark.read.schema(schema).option("header", True).csv(path)
    long = wide.unpivot(["dt"], tickers, "asset", "px").where("px is not null")
    order = F.array_position(F.array(*map(F.lit, tickers)), F.col("asset")).cast("int")
    return long.select("dt", "asset", order.alias("asset_ord"), "px")


def cache_key(tickers: Iterable[str], start: str) -> str:
    return hashlib.md5(("".join(sorted(tickers)) + start).encode()).hexdigest()[:8]


def cached(spark: SparkSession, folder: str, tickers: Iterable[str], start: str, sources: Iterable[Callable[[], DataFrame]]) -> DataFrame:
    """The cached panel, or the first source that works, written to the cache."""
    path = f"{folder}/{cache_key(tickers, start)}"
    try:
        return spark.read.parquet(path)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
    failures = []
    for make in sources:
        try:
            make().write.parquet(path)
            return spark.read.parquet(path)
        except (OSError, ValueError, ConnectionError) as e:
            failures.append(e)
    raise RuntimeError(f"no source worked: {failures}")


def quality_report(bars: DataFrame, required: Iterable[str], most_missing: float = 0.05) -> DataFrame:
    """Per required asset: share of missing dates, lowest price, last date, and what is wrong."""
    spark = bars.sparkSession
    need = spark.createDataFrame([(t,) for t in required], "asset string")
    dates = bars.agg(F.countDistinct("dt").alias("dates"), F.max("dt").alias("latest"))
    g = bars.groupBy("asset").agg(F.count("px").alias("n"), F.min("px").alias("lowest"), F.max("dt").alias("last"))
    x = need.join(g, "asset", "left").crossJoin(F.broadcast(dates))
    missing = 1 - F.coalesce("n", F.lit(0)) / F.col("dates")
    why = F.array_compact(F.array(F.when(F.col("n").isNull(), F.lit("absent")), F.when(missing > most_missing, F.lit("gaps")), F.when(F.col("lowest") <= 0, F.lit("price")), F.when(F.datediff("latest", "last") > 5, F.lit("stale"))))
    return x.select("asset", missing.alias("missing"), "lowest", "last", F.array_join(why, ",").alias("problems"))


def write_state(df: DataFrame, path: str) -> None:
    """Append rows as JSON lines: the log of a run."""
    df.write.mode("append").json(path)


def read_state(spark: SparkSession, path: str, schema: str, keep: int, order: str) -> DataFrame:
    """The newest rows of a log."""
    return spark.read.schema(schema).json(path).orderBy(F.desc(order)).limit(keep)
