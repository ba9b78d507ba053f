"""Ranks and softmax over nulls and ties; the entry points import without a session."""

import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from panelforge import functions as C


def test_ranks(spark):
    rows = [(1, "A", 1, 2.0), (1, "B", 2, 2.0), (1, "C", 3, None), (1, "D", 4, -1.0), (2, "A", 1, None)]
    df = spark.createDataFrame(rows, "dt int, asset string, asset_ord int, x double")
    got = df.select("dt", "asset", C.average_rank(F.col("x")).alias("r"), C.ordinal_rank(F.col("x")).alias("o")).collect()
    r = {(x.dt, x.asset): (x.r, x.o) for x in got}
    assert r[1, "A"] == (2.5, 1) and r[1, "B"] == (2.5, 2) and r[1, "C"][0] is None and r[1, "D"] == (1.0, 0) and r[2, "A"][0] is None


def test_softmax_and_weights(spark):
    df = spark.createDataFrame([("a", 1000.0), ("b", 1000.0), ("c", 0.0)], "k string, v double")
    assert [x.s for x in df.select("k", C.softmax(F.col("v")).alias("s")).orderBy("k").collect()] == pytest.approx([0.5, 0.5, 0.0])
    m = spark.createDataFrame([({"x": 0.6, "y": 0.4},), ({"x": 1.4, "y": -0.4},), ({"x": 0.5},), ({},)], "w map<string,double>")
    assert [x[0] for x in m.select(C.valid_weights("w")).collect()] == [True, False, False, False]


def test_entry_imports_without_a_session():
    root = Path(__file__).resolve().parents[1]
    code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert len(q) > 150 and set(o) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=root, check=True, timeout=120)
