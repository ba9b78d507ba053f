"""Positions that are carried from date to date: batch, stream and restart; weights of the pools."""

import datetime
import random

import numpy as np
import pytest

from panelforge.operators import ensemble as E
from panelforge.queries import ensemble as Q
from panelforge.streaming.bars import run_to_table


def walked(rows):
    """Plain loop over one portfolio's (dt, assets, target)."""
    out, assets, at = [], None, None
    for dt, names, target in sorted(rows):
        if assets != names:
            at = list(target)
        elif sum(abs(t - x) for t, x in zip(target, at, strict=True)) > 0.02:
            x = [0.7 * a + 0.3 * t for a, t in zip(at, target, strict=True)]
            m = sum(x) / len(x)
            size = sum(abs(v - m) for v in x)
            at = [(v - m) / size for v in x] if size > 1e-8 else list(target)
        assets = names
        out.append((dt, names, [round(v, 12) for v in at]))
    return out


@pytest.fixture(scope="module")
def targets():
    rng = random.Random(4)
    rows = []
    for p in range(5):
        names, t = ["A", "B", "C"], None
        for k in range(40):
            if rng.random() < 0.1:
                names = rng.choice([["A", "B", "C"], ["A", "B", "D"], ["A", "B"]])
            if t is None or len(t) != len(names) or rng.random() < 0.7:
                x = np.array([rng.gauss(0, 1) for _ in names])
                x -= x.mean()
                t = (x / np.abs(x).sum()).tolist()
            else:
                t = [v + 1e-3 * rng.random() for v in t]
            rows.append((f"p{p}", datetime.date(2024, 1, 1) + datetime.timedelta(days=k), names, t))
    return rows


SCHEMA = "portfolio string, dt date, assets array<string>, target array<double>"


def tidy(rows):
    return sorted((r.portfolio, r.dt, r.assets, [round(v, 12) for v in r.position]) for r in rows)


def test_positions_equal_a_plain_loop(spark, targets):
    got = tidy(E.positions(spark.createDataFrame(targets, SCHEMA).repartition(3)).collect())
    want = sorted((p, *r) for p in {t[0] for t in targets} for r in walked([t[1:] for t in targets if t[0] == p]))
    assert got == want
    moved = [np.abs(np.subtract(a[3], b[3])).sum() for a, b in zip(got, got[1:], strict=False) if a[0] == b[0] and a[2] == b[2]]
    assert min(moved) == 0 < max(moved)


def test_stream_goes_on_after_a_restart(spark, targets, tmp_path):
    """Two runs over a growing folder with one checkpoint give what one batch gives, each row once."""
    df = spark.createDataFrame(targets, SCHEMA)
    day = datetime.date(2024, 1, 20)
    got = []
    for k, part in enumerate((df.where(df.dt < day), df.where(df.dt >= day))):
        part.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in")
        q = E.positions_stream(stream).writeStream.outputMode("append").format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
        q.awaitTermination()
        got.append(spark.read.parquet(f"{tmp_path}/out").count())
    assert got == [5 * 19, 5 * 40]
    assert tidy(spark.read.parquet(f"{tmp_path}/out").collect()) == tidy(E.positions(df).collect())


def test_stream_into_memory(spark, targets, tmp_path):
    spark.createDataFrame(targets, SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/in")
    out = run_to_table(E.positions_stream(spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in")), "held_positions", "append", f"{tmp_path}/state")
    assert out.count() == len(targets)


def test_pools_and_weights(spark, sf_dir):
    rows = Q._fit(spark, sf_dir).collect()
    reps = [r for r in rows if r.representative]
    assert len(reps) == E.REPRESENTATIVES and {r.pool for r in reps} == {"calm"}
    assert sum(r.specialist for r in rows) == 1
    assert max(r.place for r in rows if r.pool == "calm") <= E.CALM_POOL
    for w in ("w_calm", "w_normal", "w_stress", "w_forecast"):
        v = [r[w] for r in reps]
        assert None in v or abs(sum(v) - 1) < 1e-9
    assert all(r.w_calm is None for r in rows if not r.representative)


def test_positions_have_no_market_part(spark, sf_dir):
    rows = Q._positions(spark, sf_dir).collect()
    by = {}
    for r in rows:
        by.setdefault(r.dt, []).append(r.position)
    assert all(abs(sum(v)) < 1e-9 and abs(sum(map(abs, v)) - 1) < 1e-9 for v in by.values())
