"""Streaming: bars from ticks with watermarks, sessions, and keyed state per tick.

Batch and stream share the same transformations; a stream adds its watermark and sink.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def events(spark: SparkSession, path: str, files_per_trigger: int = 1) -> DataFrame:
    """A folder (or glob) of Parquet ticks as a stream."""
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def bars(ticks: DataFrame, size: str = "1 hour", slide: str | None = None, late: str | None = None) -> DataFrame:
    """Open-to-close bars per type in tumbling or sliding windows."""
    t = ticks.withWatermark("ts", late) if late else ticks
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    g = t.groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.min_by("value", F.struct("ts", "event_id")).alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", F.struct("ts", "event_id")).alias("close"), F.sum("value").alias("volume"))
    return g.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "event_type", "n", "open", "high", "low", "close", "volume")


def sessions(ticks: DataFrame, gap: str = "30 minutes", late: str | None = None) -> DataFrame:
    """Sessions of a user: runs of events with no longer gap."""
    t = ticks.withWatermark("ts", late) if late else ticks
    g = t.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return g.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "total")


def trust_stream(ticks: DataFrame, keep: float = 0.9, late: str = "1 day") -> DataFrame:
    """Exponential mean of the values of each user, kept as state from batch to batch."""

    def step(key: tuple, pdfs: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        trust, n = state.get if state.exists else (None, 0)
        for pdf in pdfs:
            for x in pdf.sort_values(["ts", "event_id"]).value:
                trust = float(x) if trust is None else keep * trust + (1 - keep) * float(x)
                n += 1
        state.update((trust, n))
        yield pd.DataFrame({"user_id": [key[0]], "trust": [trust], "n": [n]})

    return ticks.withWatermark("ts", late).groupBy("user_id").applyInPandasWithState(step, "user_id long, trust double, n long", "trust double, n long", "update", "NoTimeout")


def run_to_table(stream: DataFrame, name: str, mode: str, checkpoint: str) -> DataFrame:
    """Drive a stream over what is there, into an in-memory table (for tests and small jobs)."""
    q = stream.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.table(name)
