"""The Gram matrix and what is read off it, against numpy on the whole table."""

import numpy as np
import pytest

from panelforge.operators import attribution as A


@pytest.fixture(scope="module")
def profits(spark):
    """60 formulas over 300 dates, some of them copies or constant; a date with a gap."""
    rng = np.random.default_rng(2)
    x = rng.normal(0, 0.01, (300, 60)) + rng.normal(0, 0.01, (300, 1))
    x[:, 7], x[:, 8] = x[:, 3], 0.0
    rows = [(f"f{j:02d}", i, None if (i, j) == (5, 2) else float(x[i, j])) for i in range(300) for j in range(60)]
    return np.delete(x, 5, 0), spark.createDataFrame(rows, "formula_id string, dt int, pnl double").repartition(7)


def test_gram_is_that_of_the_complete_rows(profits):
    x, df = profits
    names, g = A.gram(df, "formula_id", ["dt"], "pnl")
    assert names == [f"f{j:02d}" for j in range(60)]
    n, mean, cov = A.mean_and_covariance(g)
    assert n == len(x)
    assert np.allclose(mean, x.mean(0)) and np.allclose(cov, np.cov(x.T), atol=1e-12)
    c = A.correlations(g)
    vary = [j for j in range(60) if j != 8]
    assert np.allclose(c[np.ix_(vary, vary)], np.corrcoef(x[:, vary].T), atol=1e-9)
    assert c[8, 8] == 1 and not c[8, :8].any()


def test_attribution_of_many_formulas(profits):
    """Also for a singular covariance: the pseudo-inverse."""
    x, df = profits
    weights = {f"f{j:02d}": (j + 1) / 100 for j in range(0, 60, 2)} | {"f07": 0.2, "f03": 0.1, "absent": 1.0}
    scores = {"f00": 0.02, "f02": 0.06}
    got = {r.formula_id: r for r in A.report(df, weights, scores).collect()}
    names = [n for n in sorted(weights) if n != "absent"]
    assert sorted(got) == names
    at = [int(n[1:]) for n in names]
    w, mu = np.array([weights[n] for n in names]), x[:, at].mean(0) * 252
    c = np.cov(x[:, at].T) * 252
    total = w @ mu / np.sqrt(w @ c @ w)
    raw = w * (np.linalg.pinv(c) @ mu)
    for k, n in enumerate(names):
        r = got[n]
        assert r.msc == pytest.approx(raw[k] * total / raw.sum(), rel=1e-6, abs=1e-9) and r.drags == (r.msc < 0)
        assert r.variance_share == pytest.approx(w[k] * (c @ w)[k] / (w @ c @ w))
        assert r.return_share == pytest.approx(w[k] * mu[k] / (w @ mu))
        assert r.score_share == pytest.approx(scores.get(n, 0) / 0.08)
        keep = [j for j in range(len(w)) if j != k]
        u = w[keep] / w[keep].sum()
        assert r.sharpe_without == pytest.approx(u @ mu[keep] / np.sqrt(u @ c[np.ix_(keep, keep)] @ u))
        assert r.portfolio_sharpe == pytest.approx(total)
        assert r.diversification == pytest.approx(w @ np.sqrt(np.diag(c)) / np.sqrt(w @ c @ w))
    assert sum(r.msc for r in got.values()) == pytest.approx(total)


def test_a_thousand_formulas_in_one_pass(spark):
    df = spark.range(50).selectExpr("cast(id as int) dt", "explode(transform(sequence(0, 999), j -> struct(concat('f', lpad(j, 4, '0')) as f, sin(id * (j + 1)) / 100 as x))) s").select("dt", "s.f", "s.x")
    names, g = A.gram(df, "f", ["dt"], "x")
    x = np.sin(np.outer(np.arange(50), np.arange(1, 1001))) / 100
    assert len(names) == 1000 and np.allclose(g[1:, 1:], x.T @ x, atol=1e-12)


def test_few_rows_and_too_many_units(spark, monkeypatch):
    df = spark.createDataFrame([("a", i, 0.1 * i) for i in range(4)], "formula_id string, dt int, pnl double")
    assert A.report(df, {"a": 1.0}).count() == 0
    assert A.report(df.where("1 = 0"), {"a": 1.0}).count() == 0
    monkeypatch.setattr(A, "MOST_UNITS", 0)
    with pytest.raises(ValueError):
        A.gram(df, "formula_id", ["dt"], "pnl")
