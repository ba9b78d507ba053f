"""Search, ensemble and model queries: no SQL oracle, checked by their properties."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelforge.operators import regimes as R
from panelforge.operators import scoring as S
from panelforge.operators import search as X
from panelforge.operators.features import NAMES, features
from panelforge.plans.formula import linear_signals
from panelforge.queries.ledger import facts
from panelforge.queries.scoring import LINEAR, PRE, SHARPE, W_SQL, PNL_SQL, LINEAR_SQL, exact, linear, rounded
from panelforge.sources.panel import TICKERS, lineitem_panel, with_returns

SOME = ["momentum_20d", "momentum_5d", "volatility_20d", "reversal_5d", "zscore_20d", "rsi_14", "cross_momentum"]


def _table(s, d):
    p = lineitem_panel(s, d).cache()
    return p, features(p, SOME, TICKERS).cache()


def _pnl(s, d):
    p, sig = linear(s, d)
    return S.pnl(S.weights(sig), p)


def _metrics(s, d):
    return _pnl(s, d).groupBy("formula_id").agg(S.sharpe(F.avg("pnl"), F.stddev_pop("pnl")).alias("sharpe"), F.stddev_pop("pnl").alias("std"))


def _search(s, d):
    p, t = _table(s, d)
    return X.evolve(t, p, SOME)


def _orthogonal(s, d):
    p, sig = linear(s, d)
    names, m = X.correlation_matrix(sig, "formula_id", ["dt", "asset"], "val")
    score = {r.formula_id: r.sharpe for r in _metrics(s, d).collect()}
    kept = X.orthogonal(names, m, score)
    return s.createDataFrame([(n, n in kept) for n in names], "formula_id string, kept boolean")


def _forecast(s, d):
    p = lineitem_panel(s, d)
    return X.regime_forecast(R.policy(p, TICKERS), R.regime_labels(p, TICKERS), ["rate_env", "inflation", "liquidity", "dollar", "breadth"])


def _bench(n: int, whole: bool):
    """``n`` generated formulas scored at once on the daily panel."""

    def run(s, d):
        p = lineitem_panel(s, d, "day")
        g = X.Generator(SOME, seed=n, max_depth=3)
        ids = {f"b{i}": f for i, f in enumerate(X.distinct_formulas([g.formula() for _ in range(n * 20)], SOME)[:n])}
        sig = linear_signals(features(p, SOME, TICKERS), ids, SOME)
        if whole:
            return rounded(S.ic_summary(S.ic_daily(sig, S.forward(p))))
        return rounded(S.pnl(S.weights(sig), p).groupBy("formula_id").agg(S.sharpe(F.avg("pnl"), F.stddev_pop("pnl")).alias("sharpe")))

    return run


QUERIES = {
    "evolution_search": _search,
    "orthogonal_selection": _orthogonal,
    "signal_clusters": lambda s, d: rounded(X.clusters(linear(s, d)[1], _metrics(s, d), 2)),
    "ensemble_weights": lambda s, d: rounded(X.ensemble_weights(_metrics(s, d))),
    "optimised_weights": lambda s, d: rounded(X.optimised(_pnl(s, d))),
    "attribution": lambda s, d: rounded(X.attribution(_pnl(s, d))),
    "covariance_accuracy": lambda s, d: rounded(X.covariance_accuracy(with_returns(lineitem_panel(s, d)), list(TICKERS))),
    "latent_features": lambda s, d: rounded(X.latent_features(_table(s, d)[1], SOME)),
    "regime_forecast": lambda s, d: rounded(_forecast(s, d)),
    "meta_model": lambda s, d: rounded(X.meta_model(facts(s, d))),
    "bench_linear_100": _bench(100, False),
    "bench_ic_100": _bench(100, True),
}
ORACLE = {
    "ensemble_weights": f"""{PRE}, {LINEAR_SQL}, {W_SQL}, {PNL_SQL}, em AS (SELECT formula_id, {SHARPE('pnl')} AS sharpe, stddev_pop(pnl) AS std FROM pnl GROUP BY 1), ee AS (SELECT *, exp(sharpe - max(sharpe) OVER ()) AS e, 1 / (std + 1e-8) AS inv FROM em)
SELECT formula_id, round(1.0 / count(*) OVER (), 6)::DOUBLE AS equal, round(inv / sum(inv) OVER (), 6) AS risk_parity, round(e / sum(e) OVER (), 6) AS sharpe FROM ee""",
}
