"""Scoring of signals: information coefficients, portfolio simulation, costs and the grid.

All functions take long signals (formula_id, dt, asset, asset_ord, val) and the panel, and score
all formulas in one job.  The next return is aligned by a parameter: ``lead=1`` is the return
that follows the date, ``lead=2`` the one after it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelforge.plans.formula import average_rank, ordinal_rank
from panelforge.sources.panel import own_rows, with_returns

YEAR = 252
KEY = ("formula_id", "dt")
#: Horizons in rows with their weights, rows between rebalancings, capital tiers with their weights.
HORIZON_WEIGHTS = {1: 0.4, 7: 0.3, 30: 0.2, 90: 0.1}
REBALANCE = {1: 1, 7: 5, 30: 21, 90: 63}
LOG_HORIZONS = {1: 0.4, 5: 0.3, 21: 0.2, 63: 0.1}
CAPITAL_WEIGHTS = {1_000: 0.1, 10_000: 0.2, 100_000: 0.3, 1_000_000: 0.4}
REFERENCE_SHARPE = 0.5
TURNOVER_SCALE = 10.0


def per_date() -> Window:
    return Window.partitionBy(*KEY)


def per_asset() -> Window:
    return Window.partitionBy("formula_id", "asset").orderBy("dt")


def per_formula() -> Window:
    return Window.partitionBy("formula_id").orderBy("dt")


def forward(panel: DataFrame, lead: int = 1) -> DataFrame:
    return with_returns(panel).select("dt", "asset", F.lead("ret", lead).over(own_rows()).alias("fwd"))


def ahead(panel: DataFrame, rows: int, log: bool = False) -> DataFrame:
    """Return over the next rows."""
    r = F.try_divide(F.lead("px", rows).over(own_rows()), "px")
    return panel.select("dt", "asset", (F.ln(r) if log else r - 1).alias("fwd"))


def _pearson(x: str, y: str, least: float) -> Column:
    """Grouped correlation from moments, null where a side hardly varies."""
    cov = F.avg(F.col(x) * F.col(y)) - F.avg(x) * F.avg(y)
    var = [F.greatest(F.avg(F.col(c) * F.col(c)) - F.avg(c) * F.avg(c), F.lit(0.0)) for c in (x, y)]
    d = F.sqrt(var[0] * var[1])
    return F.when(d > least, F.try_divide(cov, d))


def ic_daily(sig: DataFrame, fwd: DataFrame, least: int = 3, complete: int | None = None, mode: str = "average") -> DataFrame:
    """Rank correlation of signal and next return per formula and date, over the assets with both;
    ``complete``: only dates with so many assets; ``mode``: average or ordinal ties."""
    j = sig.join(fwd, ["dt", "asset"]).where("val is not null and fwd is not null")
    rank = average_rank if mode == "average" else ordinal_rank
    r = j.select(*KEY, rank(F.col("val"), KEY).cast("double").alias("rv"), rank(F.col("fwd"), KEY).cast("double").alias("rf"))
    n = F.count("*").alias("n")
    out = r.groupBy(*KEY).agg(n, _pearson("rv", "rf", 1e-10).alias("ic")).where(F.col("n") >= (complete or least))
    return out


def ic_summary(ic: DataFrame, sample: bool = True) -> DataFrame:
    """Mean, deviation, ratio and share of positive dates."""
    std = F.stddev_samp("ic") if sample else F.stddev_pop("ic")
    s = ic.where("ic is not null").groupBy("formula_id").agg(F.avg("ic").alias("mean_ic"), std.alias("std_ic"), F.avg((F.col("ic") > 0).cast("double")).alias("positive"), F.count("*").alias("n"))
    return s.withColumn("ic_ir", F.coalesce(F.try_divide("mean_ic", F.nullif("std_ic", F.lit(0.0))), F.lit(0.0)))


def ic_decay(sig: DataFrame, panel: DataFrame, lags: int = 5) -> DataFrame:
    """Mean IC by lag, from one table with all lags."""
    p = with_returns(panel)
    f = p.select("dt", "asset", *[F.lead("ret", k).over(own_rows()).alias(f"f{k}") for k in range(1, lags + 1)])
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("lag"), F.col(f"f{k}").alias("fwd")) for k in range(1, lags + 1)]))
    f = f.select("dt", "asset", each.alias("x")).select("dt", "asset", "x.lag", "x.fwd")
    j = sig.join(f, ["dt", "asset"]).where("val is not null and fwd is not null")
    key = ("formula_id", "lag", "dt")
    r = j.select(*key, average_rank(F.col("val"), key).alias("rv"), average_rank(F.col("fwd"), key).alias("rf"))
    d = r.groupBy(*key).agg(F.count("*").alias("n"), _pearson("rv", "rf", 1e-10).alias("ic")).where("n >= 3 and ic is not null")
    return d.groupBy("formula_id", "lag").agg(F.avg("ic").alias("mean_ic"), F.count("*").alias("n"))


def ic_horizons(sig: DataFrame, panel: DataFrame, horizons: dict[int, float], log: bool = False) -> DataFrame:
    """Mean IC by horizon, dates without variation counting 0, in long form with the weight."""
    f = panel.select("dt", "asset", *[F.try_divide(F.lead("px", h).over(own_rows()), "px").alias(f"f{h}") for h in horizons])
    each = F.explode(F.array(*[F.struct(F.lit(h).alias("horizon"), F.lit(w).alias("weight"), (F.ln(f"f{h}") if log else F.col(f"f{h}") - 1).alias("fwd")) for h, w in horizons.items()]))
    f = f.select("dt", "asset", each.alias("x")).select("dt", "asset", "x.*")
    j = sig.join(f, ["dt", "asset"]).where("val is not null and fwd is not null")
    key = ("formula_id", "horizon", "weight", "dt")
    r = j.select(*key, average_rank(F.col("val"), key).alias("rv"), average_rank(F.col("fwd"), key).alias("rf"))
    d = r.groupBy(*key).agg(F.coalesce(_pearson("rv", "rf", 1e-10), F.lit(0.0)).alias("ic"))
    return d.groupBy("formula_id", "horizon", "weight").agg(F.avg("ic").alias("mean_ic"))


def weighted_ic(horizon_ics: DataFrame) -> DataFrame:
    return horizon_ics.groupBy("formula_id").agg(F.sum(F.col("weight") * F.col("mean_ic")).alias("weighted_ic"))


# ---- portfolios ------------------------------------------------------------------------------
def weights(sig: DataFrame) -> DataFrame:
    """Demeaned ranks over their absolute sum."""
    r = sig.withColumn("r", average_rank(F.col("val"), KEY))
    r = r.withColumn("r", F.col("r") - F.avg("r").over(per_date()))
    return r.withColumn("w", F.col("r") / (F.sum(F.abs("r")).over(per_date()) + 1e-8)).select("formula_id", "dt", "asset", "asset_ord", "w")


def pnl(w: DataFrame, panel: DataFrame, lead: int = 2) -> DataFrame:
    j = w.join(forward(panel, lead), ["dt", "asset"]).where("fwd is not null")
    return j.groupBy(*KEY).agg(F.sum(F.col("w") * F.col("fwd")).alias("pnl"))


def sharpe(mean: Column, std: Column) -> Column:
    return mean / (std + 1e-8) * F.sqrt(F.lit(float(YEAR)))


def drawdowns(p: DataFrame) -> DataFrame:
    """Three forms: on the sum of profits, on the compounded value, and on the sum of the last 20."""
    run = per_formula().rowsBetween(Window.unboundedPreceding, 0)
    grown = F.ln(F.greatest(1 + F.col("pnl"), F.lit(1e-12)))  # a loss of everything stays one
    c = p.withColumn("cum", F.sum("pnl").over(run)).withColumn("value", F.exp(F.sum(grown).over(run)))
    c = c.withColumn("rev", F.row_number().over(Window.partitionBy("formula_id").orderBy(F.desc("dt"))))
    c = c.withColumn("cum20", F.sum(F.when(F.col("rev") <= 20, F.col("pnl"))).over(run))
    c = c.select("formula_id", (F.col("cum") - F.max("cum").over(run)).alias("a"), F.try_divide("value", F.max("value").over(run)).alias("b"), (F.col("cum20") - F.greatest(F.max("cum20").over(run), F.lit(0.0))).alias("c"))
    return c.groupBy("formula_id").agg(F.min("a").alias("additive"), (F.min("b") - 1).alias("relative"), F.coalesce(F.min("c"), F.lit(0.0)).alias("recent"))


def turnovers(w: DataFrame, panel: DataFrame) -> DataFrame:
    """Four forms: mean change of a weight over dates and assets, mean sum of changes per date,
    half of that, and mean change of the rank."""
    step = F.col("w") - F.lag("w").over(per_asset())
    pos = F.percent_rank().over(per_date().orderBy(F.round("w", 10), "asset_ord"))
    s = w.withColumn("step", F.abs(step)).withColumn("pos", pos)
    s = s.withColumn("rank_step", F.abs(F.col("pos") - F.lag("pos").over(per_asset()))).where("step is not null")
    d = s.groupBy(*KEY).agg(F.avg("step").alias("mean"), F.sum("step").alias("total"), F.avg("rank_step").alias("ranks"))
    return d.groupBy("formula_id").agg(F.avg("mean").alias("mean_change"), F.avg("total").alias("per_date"), (F.avg("total") / 2).alias("half"), F.avg("ranks").alias("rank_change"))


def portfolio(sig: DataFrame, panel: DataFrame, lead: int = 2) -> DataFrame:
    """Metrics of the daily rank portfolio."""
    w = weights(sig)
    p = pnl(w, panel, lead)
    loss = F.sqrt(F.avg(F.pow(F.least("pnl", F.lit(0.0)), F.lit(2)))) + 1e-8
    years = F.greatest(F.count("*") / float(YEAR), F.lit(0.1))
    total = F.sum("pnl")
    m = p.groupBy("formula_id").agg(
        sharpe(F.avg("pnl"), F.stddev_pop("pnl")).alias("sharpe"),
        sharpe(F.avg("pnl"), loss - 1e-8).alias("sortino"),
        (F.signum(total) * (F.pow(F.abs(1 + total), 1 / years) - 1)).alias("annual_return"),
        F.avg((F.col("pnl") > 0).cast("double")).alias("win_rate"),
        F.count("*").alias("n"),
    )
    # weights up to the last but one date count for the turnover
    seen = w.join(forward(panel, 1), ["dt", "asset"]).where("fwd is not null").withColumn("step", F.abs(F.col("w") - F.lag("w").over(per_asset())))
    t = seen.groupBy("formula_id").agg(F.avg("step").alias("turnover"))
    return m.join(t, "formula_id").join(drawdowns(p).select("formula_id", F.col("additive").alias("max_drawdown")), "formula_id")


def rebalanced(sig: DataFrame, panel: DataFrame, every: dict[int, int] | None = None) -> DataFrame:
    """Sharpe and turnover per horizon when weights are renewed every so many rows and held
    between.  One table holds all horizons."""
    every = every or REBALANCE
    w = weights(sig).join(forward(panel, 2), ["dt", "asset"]).where("fwd is not null")
    w = w.withColumn("i", F.row_number().over(per_asset()) - 1)
    each = F.explode(F.array(*[F.struct(F.lit(h).alias("horizon"), F.lit(n).alias("every")) for h, n in every.items()]))
    x = w.select("*", each.alias("x")).select("formula_id", "dt", "asset", "w", "fwd", "i", "x.*")
    order = Window.partitionBy("formula_id", "horizon", "asset").orderBy("dt")
    fresh = F.when(F.col("i") % F.col("every") == 0, F.col("w"))
    x = x.withColumn("held", F.last(fresh, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    x = x.withColumn("step", F.abs(F.col("held") - F.coalesce(F.lag("held").over(order), F.lit(0.0))))
    d = x.groupBy("formula_id", "horizon", "dt").agg(F.sum(F.col("held") * F.col("fwd")).alias("pnl"), F.sum("step").alias("turn"))
    return d.groupBy("formula_id", "horizon").agg(sharpe(F.avg("pnl"), F.stddev_pop("pnl")).alias("sharpe"), F.avg("turn").alias("turnover"))


def saturated(x: Column, ref: float = REFERENCE_SHARPE) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - F.exp(-F.greatest(x, F.lit(0.0)) / ref)))


def capital_scores(metrics: DataFrame) -> DataFrame:
    """Sharpe less a penalty for turnover that grows with capital."""
    each = F.explode(F.array(*[F.lit(c) for c in CAPITAL_WEIGHTS])).alias("capital")
    m = metrics.select("formula_id", "sharpe", "turnover", each)
    return m.select("formula_id", "capital", (F.col("sharpe") - F.col("turnover") * F.col("capital") / 1e6 * TURNOVER_SCALE).alias("score"))


def grid(by_horizon: DataFrame) -> DataFrame:
    """One row per formula, horizon and capital tier: the cell's score and weight."""
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("capital"), F.lit(w).alias("w_c")) for c, w in CAPITAL_WEIGHTS.items()]))
    w_h = F.coalesce(*[F.when(F.col("horizon") == h, F.lit(w)) for h, w in HORIZON_WEIGHTS.items()])
    g = by_horizon.select("formula_id", "horizon", "sharpe", "turnover", w_h.alias("w_h"), each.alias("x")).select("*", "x.*")
    net = F.col("sharpe") - F.col("turnover") * F.col("capital") / 1e6 * TURNOVER_SCALE
    return g.select("formula_id", "horizon", "capital", "sharpe", (saturated(F.col("sharpe")) * saturated(net)).alias("cell"), (F.col("w_h") * F.col("w_c")).alias("weight"))


def composite(by_horizon: DataFrame) -> DataFrame:
    """Weighted mean of the grid with a tenth of the softmax-weighted Sharpe; robustness is the
    share of cells above 0.01."""
    c = grid(by_horizon).groupBy("formula_id").agg((F.sum(F.col("weight") * F.col("cell")) / F.sum("weight")).alias("cells"), F.avg((F.col("cell") > 0.01).cast("double")).alias("robustness"))
    top = F.max("sharpe").over(Window.partitionBy("formula_id"))
    s = by_horizon.withColumn("e", F.exp(F.col("sharpe") - top)).groupBy("formula_id").agg((F.sum(F.col("e") * F.col("sharpe")) / (F.sum("e") + 1e-8)).alias("soft"))
    return c.join(s, "formula_id").select("formula_id", (0.9 * F.col("cells") + 0.1 * saturated(F.col("soft"))).alias("composite"), "robustness")


def threshold_long_short(sig: DataFrame, panel: DataFrame, bps: float = 2.0, least: int = 60) -> DataFrame:
    """Long above rank 0.8, short below 0.2, at each rebalancing interval; the best by Sharpe."""
    r = sig.where("val is not null").withColumn("r", average_rank(F.col("val"), KEY) / F.count("val").over(per_date()))
    side = F.when(F.col("r") > 0.8, 1.0).when(F.col("r") < 0.2, -1.0).otherwise(0.0)
    r = r.withColumn("side", side)
    n = F.greatest(F.sum(F.abs("side")).over(per_date()), F.lit(1.0))
    w = r.select("formula_id", "dt", "asset", (F.col("side") / n).alias("w")).join(forward(panel, 2), ["dt", "asset"]).where("fwd is not null")
    w = w.withColumn("i", F.row_number().over(per_asset()) - 1)
    x = w.select("*", F.explode(F.array(*map(F.lit, REBALANCE.values()))).alias("every"))
    order = Window.partitionBy("formula_id", "every", "asset").orderBy("dt")
    x = x.withColumn("held", F.last(F.when(F.col("i") % F.col("every") == 0, F.col("w")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    x = x.withColumn("step", F.abs(F.col("held") - F.coalesce(F.lag("held").over(order), F.lit(0.0))))
    d = x.groupBy("formula_id", "every", "dt").agg((F.sum(F.col("held") * F.col("fwd")) - F.sum("step") * (bps / 1e4)).alias("pnl"))
    s = d.groupBy("formula_id", "every").agg(sharpe(F.avg("pnl"), F.stddev_pop("pnl")).alias("sharpe"), F.count("*").alias("n")).where(F.col("n") >= least)
    return s.groupBy("formula_id").agg(F.max_by("every", F.struct("sharpe", -F.col("every"))).alias("best_every"), F.max("sharpe").alias("sharpe"))


def signal_stability(sig: DataFrame, lag: int = 5, least: int = 15) -> DataFrame:
    """Mean over assets of the correlation of the signal's rank with that of ``lag`` rows before."""
    r = sig.where("val is not null").withColumn("r", average_rank(F.col("val"), KEY) / F.count("val").over(per_date()))
    r = r.select("formula_id", "asset", "r", F.lag("r", lag).over(per_asset()).alias("b")).where("b is not null")
    a = r.groupBy("formula_id", "asset").agg(_pearson("r", "b", 1e-12).alias("c"), F.count("*").alias("n")).where((F.col("n") + lag > least) & F.col("c").isNotNull())
    return a.groupBy("formula_id").agg(F.avg("c").alias("stability"))


# ---- costs -----------------------------------------------------------------------------------
#: Half-spread table in basis points, impact coefficient, daily volume in $bn.
COSTS = {
    "SPY": (0.32, 0.05, 25.0),
    "QQQ": (0.5, 0.07, 12.0),
    "IWM": (0.6, 0.1, 3.5),
    "TLT": (4.0, 0.08, 1.5),
    "HYG": (5.5, 0.2, 0.6),
    "LQD": (3.5, 0.1, 0.5),
    "GLD": (5.0, 0.12, 1.2),
    "DBC": (8.0, 0.18, 0.15),
    "USO": (9.0, 0.25, 0.1),
    "EEM": (2.5, 0.15, 0.8),
    "FXI": (3.5, 0.2, 0.3),
    "EWZ": (6.0, 0.15, 0.2),
    "VNQ": (3.0, 0.12, 0.4),
    "_DEFAULT": (5.0, 0.15, 0.2),
}


def cost_table(spark) -> DataFrame:
    return spark.createDataFrame([(k, *v) for k, v in COSTS.items()], "asset string, spread_bps double, eta double, adv_bn double")


def unit_costs(panel: DataFrame, capital: float) -> DataFrame:
    """Cost of trading one unit of weight: half the spread plus volatility times the root of the
    traded share of the daily volume."""
    vol = with_returns(panel).groupBy("asset").agg(F.stddev_samp("ret").alias("sigma"))
    c, default = F.broadcast(cost_table(panel.sparkSession)), COSTS["_DEFAULT"]
    v = vol.join(c, "asset", "left").fillna(dict(zip(("spread_bps", "eta", "adv_bn"), default, strict=True)))
    share = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.lit(capital) / (F.col("adv_bn") * 1e9)))
    return v.select("asset", (F.col("spread_bps") / 2e4 + F.col("eta") * F.col("sigma") * F.sqrt(share)).alias("unit"), "spread_bps", "eta", "adv_bn", "sigma")


def net_of_costs(w: DataFrame, panel: DataFrame, capital: float) -> DataFrame:
    """Gross and net mean profit and Sharpe after trading costs."""
    u = unit_costs(panel, capital).select("asset", "unit")
    x = w.withColumn("step", F.abs(F.col("w") - F.lag("w").over(per_asset()))).join(F.broadcast(u), "asset").join(forward(panel, 2), ["dt", "asset"]).where("fwd is not null")
    d = x.groupBy(*KEY).agg(F.sum(F.col("w") * F.col("fwd")).alias("gross"), F.sum(F.coalesce(F.col("step") * F.col("unit"), F.lit(0.0))).alias("cost"))
    d = d.withColumn("net", F.col("gross") - F.col("cost"))
    return d.groupBy("formula_id").agg(F.avg("gross").alias("gross"), F.avg("net").alias("net"), F.sum("cost").alias("cost"), sharpe(F.avg("gross"), F.stddev_pop("gross")).alias("gross_sharpe"), sharpe(F.avg("net"), F.stddev_pop("net")).alias("net_sharpe"))


def simple_costs(w: DataFrame, panel: DataFrame, bps: float = 10.0) -> DataFrame:
    """Flat cost on half the change of the weights."""
    x = w.withColumn("step", F.abs(F.col("w") - F.coalesce(F.lag("w").over(per_asset()), F.lit(0.0)))).join(forward(panel, 1), ["dt", "asset"]).where("fwd is not null")
    d = x.groupBy(*KEY).agg(F.sum(F.col("w") * F.col("fwd")).alias("gross"), (F.sum("step") / 2).alias("turnover"))
    d = d.withColumn("net", F.col("gross") - F.col("turnover") * (bps / 1e4))
    s = F.try_divide(F.avg("net"), F.nullif(F.stddev_samp("net"), F.lit(0.0))) * F.sqrt(F.lit(float(YEAR)))
    return d.groupBy("formula_id").agg(F.sum("gross").alias("gross_return"), F.sum("net").alias("net_return"), F.avg("turnover").alias("turnover"), s.alias("net_sharpe"))


# ---- aggregates over IC facts ----------------------------------------------------------------
def decay_fit(facts: DataFrame, key: str) -> DataFrame:
    """Least squares of ln |ic| on time: rate, half-life and fit."""
    f = facts.withColumn("y", F.ln(F.greatest(F.abs("ic"), F.lit(1e-6))))
    g = f.groupBy(key).agg(F.regr_slope("y", "t").alias("slope"), F.regr_intercept("y", "t").alias("intercept"), F.regr_r2("y", "t").alias("r2"), F.count("*").alias("n"))
    return g.withColumn("half_life", F.when(F.col("slope") < 0, F.ln(F.lit(2.0)) / -F.col("slope")))


def pairwise_correlation(x: DataFrame, unit: str, obs: list[str], value: str) -> DataFrame:
    """Correlation of every two units over shared observations, for few units: a join on the
    observation, where both sides have one row per unit."""
    a = x.select(*obs, F.col(unit).alias("a"), F.col(value).alias("va"))
    b = x.select(*obs, F.col(unit).alias("b"), F.col(value).alias("vb"))
    return a.join(b, obs).where("a < b").groupBy("a", "b").agg(_pearson("va", "vb", 1e-15).alias("corr"), F.count("*").alias("n"))
