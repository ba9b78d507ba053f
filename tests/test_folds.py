"""Recurrences against plain loops, streams against batches, files against what was written."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelforge.operators import alignment as A
from panelforge.operators import execution as E
from panelforge.operators import ledger as L
from panelforge.sources import files, synthetic
from panelforge.sources.panel import TICKERS, lineitem_panel
from panelforge.streaming import bars as B


def test_guard(spark):
    pnl = [0.001] * 5 + [-0.004] * 10 + [0.002] * 12
    df = spark.createDataFrame([("f", f"2020-01-{i + 1:02d}", x) for i, x in enumerate(pnl)], "formula_id string, dt string, pnl double")
    got = [r.scale for r in E.drawdown_guard(df, limit=-0.02).orderBy("dt").collect()]
    for i, g in enumerate(got):
        cum = np.cumsum(pnl[max(0, i - 19) : i + 1])
        dd = min(0.0, (cum - np.maximum.accumulate(cum)).min())
        assert g == pytest.approx(1.0 if dd >= -0.02 else max(0.25, 1 - 0.5 * min(abs(dd) / 0.02, 2)))
    assert got[0] == 1.0 and min(got) < 0.3


def test_trust_and_lifecycle(spark):
    rows = [("a", e, 0.05) for e in range(8)] + [("b", e, -0.05) for e in range(8)]
    states = {(r.formula_id, r.epoch): r.state for r in L.lifecycle(spark.createDataFrame(rows, "formula_id string, epoch long, ic double")).collect()}
    assert states["a", 1] == "EXPERIMENTAL" and states["a", 2] == "VALIDATED" and states["a", 3] == "PRODUCTION" and states["b", 1] == "EXPERIMENTAL" and states["b", 2] == "RETIRED"
    t = L.trust(spark.createDataFrame([(1, 1, 1.0), (1, 2, 0.0), (1, 3, 0.0)], "uid int, epoch int, score double")).orderBy("epoch").collect()
    assert [r.trust for r in t] == pytest.approx([1.0, 0.9, 0.81])


def test_beta_interval(spark):
    r = L.beta_interval(spark.createDataFrame([("h", 0, 0), ("g", 10, 9)], "hypothesis string, n long, successes long")).collect()
    by = {x.hypothesis: x for x in r}
    assert by["h"].low == pytest.approx(0.025, abs=1e-6) and by["h"].high == pytest.approx(0.975, abs=1e-6)
    assert 0.58 < by["g"].low < 0.60 and 0.97 < by["g"].high < 0.98


def test_capital_is_kept_when_dealt(spark):
    rows = [("s", f"2020-01-{d:02d}", h, 0.0 if h != "1d" else 0.01) for d in range(1, 21) for h in E.HORIZONS]
    df = spark.createDataFrame(rows, "signal string, dt string, horizon string, ret double").withColumn("dt", F.to_date("dt"))
    x = E.capital_engine(df).groupBy("dt").agg(F.sum("capital").alias("c"), F.sum("weight").alias("w"), F.min("weight").alias("least")).orderBy("dt").collect()
    assert all(abs(r.w - 1) < 1e-9 for r in x) and x[-1].c > x[0].c and min(r.least for r in x) > 0.04


def test_stream_bars_equal_batch_bars(spark, sf_dir, tmp_path):
    one = spark.read.parquet(f"{sf_dir}/events.parquet")
    one.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = B.bars(B.events(spark, str(tmp_path / "in")), "1 hour", late="60 days")
    got = B.run_to_table(stream, "bars_out", "complete", str(tmp_path / "ck"))
    plain = lambda df: sorted(tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in df.collect())
    assert plain(got) == plain(B.bars(one, "1 hour"))


def test_stream_state(spark, sf_dir, tmp_path):
    spark.read.parquet(f"{sf_dir}/events.parquet").coalesce(1).write.parquet(str(tmp_path / "in"))
    got = B.run_to_table(B.trust_stream(B.events(spark, str(tmp_path / "in"))), "trust_out", "update", str(tmp_path / "ck")).collect()
    want = {}
    for r in spark.read.parquet(f"{sf_dir}/events.parquet").orderBy("ts", "event_id").collect():
        want[r.user_id] = r.value if r.user_id not in want else 0.9 * want[r.user_id] + 0.1 * r.value
    assert {r.user_id: pytest.approx(r.trust) for r in got} == want


def test_csv_round_trip_and_cache(spark, sf_dir, tmp_path):
    p = lineitem_panel(spark, sf_dir)
    files.write_wide_csv(p, str(tmp_path / "csv"), TICKERS)
    back = files.read_wide_csv(spark, str(tmp_path / "csv"), TICKERS)
    assert sorted(map(tuple, back.collect())) == sorted((r.dt, r.asset, r.asset_ord, r.px) for r in p.collect())

    def offline():
        raise ConnectionError

    calls = []
    made = lambda: calls.append(1) or p
    for _ in range(2):
        assert files.cached(spark, str(tmp_path), TICKERS, "2020", [offline, made]).count() == p.count()
    assert len(calls) == 1
    with pytest.raises(RuntimeError):
        files.cached(spark, str(tmp_path), TICKERS, "1999", [offline])


@pytest.mark.parametrize("model", synthetic.MODELS)
def test_synthetic_markets_repeat(spark, model):
    a, b = (synthetic.market(spark, model, ["SPY", "TLT"], "2020-01-01", 60, seed=3).orderBy("asset", "dt").toPandas() for _ in range(2))
    assert a.equals(b) and len(a) == 120 and (a.px > 0).all() and a.px.std() > 0


def test_asof_directions(spark):
    left = spark.createDataFrame([(1, "2020-01-05"), (2, "2020-01-01"), (3, "2020-02-01")], "k int, t string").withColumn("t", F.to_date("t"))
    right = spark.createDataFrame([("2020-01-04", 1.0), ("2020-01-07", 2.0)], "t string, v double").withColumn("t", F.to_date("t"))
    for how, want in (("backward", [1.0, None, 2.0]), ("forward", [2.0, 1.0, None]), ("nearest", [1.0, 1.0, 2.0])):
        assert [r.v for r in A.asof(left, right, "t", "v", (), how).orderBy("k").collect()] == want
