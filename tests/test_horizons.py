"""Horizon scores and the long-short portfolio against a plain pandas walk, gaps and ties included."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest

from panelforge.operators import horizons as H

ASSETS, DAYS = ["A", "B", "C", "D", "E", "F"], 90
DATES = [dt.date(2024, 1, 1) + dt.timedelta(days=k) for k in range(DAYS)]


@pytest.fixture(scope="module")
def wide():
    r = np.random.default_rng(5)
    px = pd.DataFrame(100 * np.exp(np.cumsum(r.normal(0, 0.02, (DAYS, 6)), 0)), DATES, ASSETS)
    a = pd.DataFrame(np.round(r.normal(0, 1, (DAYS, 6)), 1), DATES, ASSETS)  # ties
    a.iloc[3:9, 2] = np.nan
    a.iloc[20] = np.nan
    a.iloc[30] = 1.0
    return px, {"noise": a, "ahead": np.log(px).diff().shift(-1), "flat": a * 0 + 1}


@pytest.fixture(scope="module")
def long(spark, wide):
    px, sigs = wide
    none = lambda v: None if pd.isna(v) else float(v)
    panel = [(d, x, k, float(px.loc[d, x])) for d in DATES for k, x in enumerate(ASSETS)]
    sig = [(f, d, x, k, none(s.loc[d, x])) for f, s in sigs.items() for d in DATES for k, x in enumerate(ASSETS)]
    return spark.createDataFrame(sig, "formula_id string, dt date, asset string, asset_ord int, val double"), spark.createDataFrame(panel, "dt date, asset string, asset_ord int, px double")


def correlation(sig, px, h):
    s, f = sig.rank(axis=1), np.log(px.shift(-h) / px).rank(axis=1)
    out = []
    for d in DATES:
        ok = s.loc[d].notna() & f.loc[d].notna()
        x, y = s.loc[d][ok], f.loc[d][ok]
        if len(x) > 1 and x.std() > 1e-8 and y.std() > 1e-8:
            out.append(np.corrcoef(x, y)[0, 1])
    return (np.mean(out), np.mean(out) / (np.std(out) + 1e-8) if np.std(out) > 0 else 0.0) if len(out) >= 5 else (0.0, 0.0)


def test_scores(wide, long):
    px, sigs = wide
    got = {r.formula_id: r for r in H.horizon_scores(*long).collect()}
    assert set(got) == set(sigs)
    for f, sig in sigs.items():
        r = got[f]
        ics = {h: correlation(sig, px, h) for h in H.LOG_HORIZONS}
        for h, (ic, ir) in ics.items():
            assert r[f"ic_{h}"] == pytest.approx(ic, abs=1e-9)
            if abs(ir) < 1e6:  # a correlation that never varies has an unbounded ratio
                assert r[f"ir_{h}"] == pytest.approx(ir, rel=1e-6, abs=1e-9)
        turn = sig.rank(axis=1, pct=True).diff().abs().mean().mean()
        mean = sum(w * ics[h][0] for h, w in H.LOG_HORIZONS.items())
        assert r.turnover == pytest.approx(turn, abs=1e-9)
        assert r.tc_adj == pytest.approx(mean / (1 + 2 * turn), abs=1e-9)
        assert r.best_horizon == max(ics, key=lambda h: (abs(ics[h][0]), -h))
    assert [f for f, _ in sorted(got.items(), key=lambda x: x[1].place)][0] == "ahead"
    assert got["flat"].mh_ic == 0 and got["noise"].n_obs == DAYS - 2


def walk(sig, px, every):
    share, held, rows = sig.rank(axis=1, pct=True), None, []
    nxt = np.log(px).diff().shift(-1)
    for i, d in enumerate(DATES):
        new = (1.0 * (share.loc[d] > 0.8) - (share.loc[d] < 0.2)) / 6 if i % every == 0 else held
        gross, turn = (0.0, 0.0) if held is None else ((held * nxt.loc[d]).sum(), (new - held).abs().sum())
        rows.append((gross - turn * 0.001, turn))
        held = new
    net, turn = (pd.Series(x) for x in zip(*rows, strict=True))
    value = (1 + net).cumprod()
    year, vol, loss = net.mean() * 252, net.std() * np.sqrt(252), (value / value.cummax() - 1).min()
    return {"sharpe": year / vol if vol > 1e-8 else 0.0, "annual_return": year, "max_drawdown": loss, "calmar": year / abs(loss) if abs(loss) > 1e-8 else 0.0, "turnover": turn.mean() * 252, "n": len(net)}


def test_portfolio(wide, long):
    px, sigs = wide
    got = {r.formula_id: r for r in H.long_short(*long).collect()}
    for f, sig in sigs.items():
        runs = {e: walk(sig, px, e) for e in (1, 5, 21, 63)}
        best = max(runs, key=lambda e: (runs[e]["sharpe"], -e))
        assert got[f].every == best
        for k, v in runs[best].items():
            assert got[f][k] == pytest.approx(v, abs=1e-8), (f, k)
    few = long[0].where("dt < '2024-02-15'")
    assert H.long_short(few, long[1]).count() == 0
