"""Scores of signals over several horizons, net of turnover, and a long-short portfolio beside them.

Ranks are taken once a date, of signals and of each horizon's return apart, and correlated where
both are present.  All formulas and horizons share one join and one aggregation by date; what
follows works on a row per formula and date, or per formula and asset."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelforge.operators.scoring import KEY, LOG_HORIZONS, YEAR, _pearson, per_asset, per_date, signal_stability
from panelforge.plans.formula import average_rank
from panelforge.sources.panel import own_rows

#: Weight of turnover, least dates (also as a share) and correlations, cost and least days.
TURNOVER_WEIGHT, LEAST_DATES, LEAST_SHARE, LEAST_ICS = 2.0, 10, 0.15, 5
COST_BPS, LEAST_DAYS = 10.0, 60


def ranked(sig: DataFrame) -> DataFrame:
    """Average rank of each value on its date, and as a share of the values of that date."""
    r = sig.select(*KEY, "asset", average_rank(F.col("val"), KEY).alias("rank"), F.count("val").over(per_date()).alias("n"), F.count("*").over(per_date()).alias("width"))
    return r.withColumn("share", F.col("rank") / F.nullif("n", F.lit(0)))


def log_returns(panel: DataFrame, horizons) -> DataFrame:
    """Log return of the next ``h`` rows for each horizon, in columns f<h>."""
    return panel.select("dt", "asset", *[F.ln(F.try_divide(F.lead("px", h).over(own_rows()), "px")).alias(f"f{h}") for h in horizons])


def horizon_scores(sig: DataFrame, panel: DataFrame, weights: dict[int, float] = LOG_HORIZONS) -> DataFrame:
    """One row per formula: ic_<h> and ir_<h> by horizon, their weighted mean ``mh_ic``, turnover,
    stability, ``tc_adj`` (the mean after turnover), the horizon of the largest absolute
    correlation (ties to the shorter), dates with signal and next return, and the place by ``tc_adj``.

    A horizon with fewer than five dates on which both sides vary, or a signal with too few dates,
    scores 0.  Turnover and stability are 0 where no row has one before it."""
    r = ranked(sig)
    f = log_returns(panel, weights)
    f = f.select("dt", "asset", *[average_rank(F.col(f"f{h}"), ("dt",)).alias(f"f{h}") for h in weights])
    j = r.join(f, ["dt", "asset"])
    both = [F.col("rank").isNotNull() & F.col(f"f{h}").isNotNull() for h in weights]
    j = j.select(*KEY, "rank", "f1" if 1 in weights else F.lit(None).cast("double").alias("f1"), *[F.when(b, F.col("rank")).alias(f"x{h}") for h, b in zip(weights, both, strict=True)], *[F.when(b, F.col(f"f{h}")).alias(f"y{h}") for h, b in zip(weights, both, strict=True)])
    seen = (F.count("rank") > 0) & (F.count("f1") > 0)
    d = j.groupBy(*KEY).agg(seen.cast("long").alias("seen"), *[_pearson(f"x{h}", f"y{h}", 1e-10).alias(f"c{h}") for h in weights])

    def of(h: int, value: Column) -> Column:
        enough = (F.count("*") >= F.greatest(F.lit(LEAST_DATES), F.floor(F.count("*") * LEAST_SHARE))) & (F.count(f"c{h}") >= LEAST_ICS)
        return F.when(enough, value).otherwise(0.0)

    ratio = lambda h: F.when(F.stddev_pop(f"c{h}") > 0, F.avg(f"c{h}") / (F.stddev_pop(f"c{h}") + 1e-8)).otherwise(0.0)
    s = d.groupBy("formula_id").agg(F.sum("seen").alias("n_obs"), *[of(h, F.avg(f"c{h}")).alias(f"ic_{h}") for h in weights], *[of(h, ratio(h)).alias(f"ir_{h}") for h in weights])
    steps = r.select("formula_id", "asset", F.abs(F.col("share") - F.lag("share").over(per_asset())).alias("step"))
    turn = steps.groupBy("formula_id", "asset").agg(F.avg("step").alias("step")).groupBy("formula_id").agg(F.avg("step").alias("turnover"))
    s = s.join(turn, "formula_id", "left").join(signal_stability(sig), "formula_id", "left")
    s = s.withColumns({c: F.coalesce(c, F.lit(0.0)) for c in ("turnover", "stability")})
    s = s.withColumn("mh_ic", sum((F.col(f"ic_{h}") * (w / sum(weights.values())) for h, w in weights.items()), F.lit(0.0)))
    s = s.withColumn("tc_adj", F.col("mh_ic") / (1 + TURNOVER_WEIGHT * F.col("turnover")))
    best = F.array_max(F.array(*[F.struct(F.abs(f"ic_{h}"), F.lit(-h).alias("h")) for h in weights]))
    s = s.withColumn("best_horizon", (-best["h"]).cast("int"))
    return s.withColumn("place", F.row_number().over(Window.orderBy(F.desc(F.round("tc_adj", 10)), "formula_id")))  # one row per formula


def long_short(sig: DataFrame, panel: DataFrame, every: tuple[int, ...] = (1, 5, 21, 63), bps: float = COST_BPS) -> DataFrame:
    """One row per formula: the best interval between rebalancings by Sharpe ratio (ties to the
    shorter) with its yearly return, volatility, largest loss from a peak, return over that loss,
    turnover a year and days.

    Long assets above 0.8 of the date's ranks, short below 0.2, one over the number of assets each.
    Positions of a row earn the return that starts one row later, and changes cost ``bps``.  Formulas with
    fewer than 60 days give no row.  Values are plain products, so one that loses more than all
    turns negative and its loss goes beyond -1.  All intervals are columns of one window over an asset's rows."""
    r = ranked(sig)
    side = F.when(F.col("share") > 0.8, 1.0).when(F.col("share") < 0.2, -1.0).otherwise(0.0)
    i = F.row_number().over(per_asset()) - 1
    w = r.select(*KEY, "asset", (side / F.col("width")).alias("w"), i.alias("i")).join(log_returns(panel, (1,)), ["dt", "asset"])
    run = per_asset().rowsBetween(Window.unboundedPreceding, 0)
    w = w.select("*", *[F.last(F.when(F.col("i") % e == 0, F.col("w")), ignorenulls=True).over(run).alias(f"h{e}") for e in every])
    w = w.select("*", *[F.lag(f"h{e}").over(per_asset()).alias(f"b{e}") for e in every])
    total = lambda x: F.coalesce(F.sum(x), F.lit(0.0))
    each = F.array(*[F.struct(F.lit(e).alias("every"), total(F.col(f"b{e}") * F.col("f1")).alias("gross"), total(F.abs(F.col(f"h{e}") - F.col(f"b{e}"))).alias("turn")) for e in every])
    d = w.groupBy(*KEY).agg(each.alias("x")).select(*KEY, F.inline("x"))
    d = d.withColumn("net", F.col("gross") - F.col("turn") * (bps / 1e4))
    order = Window.partitionBy("formula_id", "every").orderBy("dt").rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumn("value", F.product(1 + F.col("net")).over(order))
    d = d.withColumn("loss", F.try_divide("value", F.max("value").over(order)) - 1)
    g = d.groupBy("formula_id", "every").agg((F.avg("net") * YEAR).alias("annual_return"), (F.stddev_samp("net") * F.sqrt(F.lit(float(YEAR)))).alias("annual_vol"), F.min("loss").alias("max_drawdown"), (F.avg("turn") * YEAR).alias("turnover"), F.count("*").alias("n")).where(F.col("n") >= LEAST_DAYS)
    over = lambda x, least: F.when(least > 1e-8, F.try_divide(x, least)).otherwise(0.0)
    g = g.withColumn("sharpe", over(F.col("annual_return"), F.col("annual_vol"))).withColumn("calmar", over(F.col("annual_return"), F.abs("max_drawdown")))
    row = F.struct(*[c for c in g.columns if c != "formula_id"])
    return g.groupBy("formula_id").agg(F.max_by(row, F.struct("sharpe", -F.col("every"))).alias("r")).select("formula_id", "r.*")
