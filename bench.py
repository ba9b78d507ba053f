"""Headline queries, timed: one JSON line.  BENCH_SF_DIR and BENCH_CPUS set data and cores."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from panelforge import queries as registry

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
HEADLINE = ("panel_daily", "feature_volatility_60d", "feature_vol_regime", "op_rank", "formula_linear", "ic_daily", "ic_summary", "ic_horizons", "port_metrics", "rebalance_sim", "score_grid", "composite", "net_of_costs", "bench_ic_100", "bench_linear_100")


def main() -> None:
    spark = SparkSession.builder.master(f"local[{CPUS}]").config("spark.sql.shuffle.partitions", CPUS).config("spark.driver.memory", "8g").config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    every = registry.queries()
    names = [n for n in HEADLINE if n in every]
    every["panel_weekly"](spark, SF_DIR).count()  # starts the session
    took = {}
    for n in names:
        t = time.perf_counter()
        every[n](spark, SF_DIR).write.format("noop").mode("overwrite").save()
        took[n] = round(time.perf_counter() - t, 3)
        spark.catalog.clearCache()
    print(json.dumps({"metric": "headline panel queries, total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": SF_DIR.rsplit("sf", 1)[-1].strip("/")}))
    spark.stop()


if __name__ == "__main__":
    main()
