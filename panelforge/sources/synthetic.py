"""Synthetic markets: seeded generators whose paths are built on the executors.

Models without memory are window sums of seeded noise; models with memory (regimes, volatility
clustering, mean reversion) are one fold per path.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelforge.sources.panel import by_asset

MODELS = ("gbm", "jump", "mean_revert", "regime", "corr_shock", "inflation", "garch")


def business_days(spark: SparkSession, start: str, n: int) -> DataFrame:
    """(i, dt): the first ``n`` weekdays from ``start``."""
    days = spark.range(n + n // 5 * 2 + 10).select(F.date_add(F.lit(start).cast("date"), F.col("id").cast("int")).alias("dt")).where(F.dayofweek("dt").between(2, 6))
    return days.orderBy("dt").limit(n)


def gbm(spark: SparkSession, assets: list[str], start: str, n: int, mu: float = 0.0003, sigma: float = 0.01, seed: int = 1) -> DataFrame:
    """Geometric Brownian motion in SQL: exp of the running sum of seeded normal steps."""
    a = F.explode(F.array(*[F.struct(F.lit(t).alias("asset"), F.lit(i + 1).alias("asset_ord")) for i, t in enumerate(assets)])).alias("a")
    x = business_days(spark, start, n).select("dt", a).select("dt", "a.*")
    # normal steps from hashes of (seed, asset, date): the same on every run and partitioning
    u = lambda k: (F.pmod(F.xxhash64(F.lit(seed * 10 + k), "asset", "dt"), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    z = F.sqrt(-2 * F.ln(u(1))) * F.cos(2 * 3.141592653589793 * u(2))
    x = x.withColumn("r", mu + sigma * z)
    return x.select("dt", "asset", "asset_ord", (100 * F.exp(F.sum("r").over(by_asset()))).alias("px"))


def market(spark: SparkSession, model: str, assets: list[str], start: str, n: int, seed: int = 1) -> DataFrame:
    """A panel of one of the models; one fold per (model, asset) with a shared regime path."""
    if model not in MODELS:
        raise ValueError(model)
    if model == "gbm":
        return gbm(spark, assets, start, n, seed=seed)
    keys = spark.createDataFrame([(i + 1, t) for i, t in enumerate(assets)], "asset_ord int, asset string")
    dates = business_days(spark, start, n)

    def path(left: pd.DataFrame) -> pd.DataFrame:
        import numpy as np

        dt = left.dt.sort_values().to_numpy()
        n, common = len(dt), np.random.default_rng(seed)
        own = np.random.default_rng(seed * 1000 + int(left.asset_ord.iloc[0]))
        z, m = own.standard_normal(n), common.standard_normal(n)
        r = 0.0003 + 0.01 * z
        if model == "jump":
            r = r + (own.random(n) < 0.02) * own.normal(-0.02, 0.03, n)
        elif model == "mean_revert":
            x, out = 0.0, np.empty(n)
            for i in range(n):
                step = -0.05 * x + 0.01 * z[i]
                x, out[i] = x + step, step
            r = out
        elif model in ("regime", "garch"):
            state, states, jump = 1, np.empty(n, int), common.random(n)
            for i in range(n):
                state = (state + 1) % 3 if jump[i] < 0.02 else state
                states[i] = state
            vol = np.array([0.006, 0.010, 0.022])[states]
            if model == "garch":
                v, heavy = 1e-4, own.standard_t(5, n) / np.sqrt(5 / 3)
                for i in range(n):
                    vol[i] *= np.sqrt(v / 1e-4)
                    v = 1e-6 + 0.92 * v + 0.07 * v * heavy[i] ** 2
                z = heavy
            r = np.array([0.0006, 0.0003, -0.0010])[states] + vol * z
        elif model == "corr_shock":
            rho = np.where(np.arange(n) > n // 2, 0.8, 0.2)
            r = 0.0003 + 0.01 * (np.sqrt(rho) * m + np.sqrt(1 - rho) * z)
        elif model == "inflation":
            r = r + np.linspace(0, 0.0005, n)
        return pd.DataFrame({"dt": pd.Series(dt), "asset": left.asset.iloc[0], "asset_ord": left.asset_ord.iloc[0], "px": 100 * np.exp(np.cumsum(r))})

    rows = dates.crossJoin(F.broadcast(keys))
    return rows.groupBy("asset").applyInPandas(path, "dt date, asset string, asset_ord int, px double")


#: Volatility factor, days, and total moves of the named shocks.
SHOCKS = {
    "rates_up_200bps": (1.6, 126, {"TLT": -0.26, "IEF": -0.15, "HYG": -0.12, "QQQ": -0.18, "VNQ": -0.22, "GLD": -0.03}),
    "rates_down_100bps": (0.85, 126, {"TLT": 0.12, "IEF": 0.07, "HYG": 0.06, "QQQ": 0.10, "SPY": 0.08, "GLD": 0.05}),
    "equity_crash_30pct": (3.5, 63, {"SPY": -0.30, "QQQ": -0.35, "IWM": -0.38, "EEM": -0.40, "VNQ": -0.44, "FXI": -0.42, "HYG": -0.22, "DBC": -0.25, "TLT": 0.18, "GLD": 0.10}),
    "oil_spike_50pct": (2.0, 42, {"DBC": 0.35, "GLD": 0.12, "TLT": -0.10, "QQQ": -0.14, "EEM": -0.12, "SPY": -0.08}),
    "china_crisis": (2.2, 45, {"FXI": -0.38, "EEM": -0.27, "DBC": -0.18, "TLT": 0.10, "GLD": 0.14, "SPY": -0.10, "QQQ": -0.08}),
    "soft_landing": (0.7, 252, {"SPY": 0.12, "QQQ": 0.18, "IWM": 0.14, "TLT": 0.05, "HYG": 0.06, "EEM": 0.10}),
    "stagflation": (2.0, 252, {"SPY": -0.20, "QQQ": -0.28, "TLT": -0.18, "GLD": 0.28, "DBC": 0.22, "HYG": -0.14, "IWM": -0.24}),
    "ai_boom": (0.85, 252, {"QQQ": 0.35, "SPY": 0.22, "IWM": 0.14, "GLD": -0.03, "TLT": -0.04, "DBC": -0.08}),
}


def shocked(panel: DataFrame, scenario: str, seed: int = 1) -> DataFrame:
    """The panel with the returns of its first days replaced, and the rest rebased on them: a
    running sum of new log returns.  Assets that the scenario moves drift by an equal part of the
    move a day, with noise of the widened volatility; all others keep their own returns, with
    noise of the volatility's widening alone."""
    from panelforge.sources.panel import own_rows, with_returns

    factor, days, moves = SHOCKS[scenario]
    move = F.coalesce(*[F.when(F.col("asset") == t, F.lit(v)) for t, v in moves.items()])
    x = with_returns(panel)
    sigma = F.stddev_pop(F.coalesce("lret", F.lit(0.0))).over(own_rows().rowsBetween(-(1 << 30), 1 << 30)) + 1e-8
    u = lambda k: (F.pmod(F.xxhash64(F.lit(seed * 10 + k), F.lit(scenario), "asset", "dt"), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    z = F.sqrt(-2 * F.ln(u(1))) * F.cos(2 * 3.141592653589793 * u(2))
    new = F.when(move.isNotNull(), move / days + sigma * factor * z).otherwise(F.col("lret") + sigma * max(0.0, factor - 1) * z)
    x = x.withColumn("new", F.when(F.col("rn") == 1, 0.0).when(F.col("rn") <= days + 1, new).otherwise(F.col("lret")))
    first = F.first("px").over(by_asset())
    return x.select("dt", "asset", "asset_ord", (first * F.exp(F.sum("new").over(by_asset()))).alias("px"))


def statistics(panel: DataFrame) -> DataFrame:
    """Annual return and volatility, drawdown and Sharpe of the equal-weight portfolio."""
    from pyspark.sql import Window

    from panelforge.sources.panel import with_returns

    m = with_returns(panel).groupBy("dt").agg(F.avg("ret").alias("m")).where("m is not null")
    run = Window.orderBy("dt").rowsBetween(Window.unboundedPreceding, 0)
    m = m.withColumn("v", F.exp(F.sum(F.ln(1 + F.col("m"))).over(run))).withColumn("dd", F.col("v") / F.max("v").over(run) - 1)
    vol = F.stddev_samp("m") * F.sqrt(F.lit(252.0))
    return m.agg((F.avg("m") * 252).alias("annual_return"), vol.alias("annual_vol"), F.min("dd").alias("max_drawdown"), F.try_divide(F.avg("m") * 252, F.nullif(vol, F.lit(0.0))).alias("sharpe"), F.count("*").alias("n"))
