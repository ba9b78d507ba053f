"""Scores and views over the ledger's facts: component scores, rewards, costs in closed form,
matches, combinations and filters by regime."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelforge.operators.ledger import judged
from panelforge.operators.scoring import COSTS, _pearson, cost_table
from panelforge.plans.formula import average_rank
from panelforge.sources.panel import with_returns

#: Component weights and references.
COMPONENTS = {"ic": 0.40, "stability": 0.20, "decay": 0.15, "novelty": 0.15, "capacity": 0.10}
IC_REFERENCE, STABILITY_REFERENCE, FULL_HALF_LIFE, SHORT_HALF_LIFE = 0.05, 1.0, 30.0, 10.0


def _unit(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def component_scores(facts: DataFrame, novelty: DataFrame) -> DataFrame:
    """Five components in [0, 1] per formula and their weighted sum.  ``novelty`` has each
    formula's largest correlation with others; formulas without one are new."""
    w = Window.partitionBy("formula_id").orderBy("epoch")
    f = facts.withColumn("t", (F.row_number().over(w) - 1).cast("double")).withColumn("y", F.ln(F.greatest(F.abs("ic"), F.lit(1e-6))))
    g = f.groupBy("formula_id").agg(F.avg("ic").alias("m"), F.stddev_samp("ic").alias("s"), F.count("*").alias("n"), F.avg((F.col("ic") > 0).cast("double")).alias("pos"), F.regr_slope("y", "t").alias("slope"))
    g = g.join(novelty, "formula_id", "left")
    life = F.ln(F.lit(2.0)) / -F.col("slope")
    parts = {
        "ic": _unit(1 - F.exp(-F.greatest("m", F.lit(0.0)) / IC_REFERENCE)),
        "stability": _unit(1 - F.exp(-F.greatest(F.coalesce(F.try_divide("m", F.nullif("s", F.lit(0.0))), F.lit(0.0)), F.lit(0.0)) / STABILITY_REFERENCE)),
        "decay": F.when(F.col("n") < 4, 0.5).when(F.coalesce(F.col("slope") >= 0, F.lit(True)), 1.0).otherwise(_unit(life / FULL_HALF_LIFE)),
        "novelty": _unit(1 - F.abs(F.coalesce("max_corr", F.lit(0.0)))),
        "capacity": _unit(0.5 * F.col("pos") + 0.25 * F.least(F.col("n") / 20, F.lit(1.0)) + 0.1),
    }
    g = g.select("formula_id", *[v.alias(k) for k, v in parts.items()])
    return g.withColumn("total", sum((F.col(k) * v for k, v in COMPONENTS.items()), F.lit(0.0)))


def signal_rewards(facts: DataFrame, novelty: DataFrame, alpha: float = 0.20) -> DataFrame:
    """Per formula after its last epoch: the five components, their weighted sum, the state and
    multiplier, the reward (their product) and the reward smoothed over all its epochs.

    At each epoch a formula is judged on its ICs so far with their mean as one more value, unless
    that is 0; the stability ratio alone is of the ICs as they are, over their deviation.  Formulas without
    ``novelty`` are new.  The sums that a fit needs are windows, so no history is ever copied."""
    order = Window.partitionBy("formula_id").orderBy("epoch")
    w = order.rowsBetween(Window.unboundedPreceding, 0)
    x = facts.select("formula_id", "epoch", "ic", (F.row_number().over(order) - 1).cast("double").alias("t"))

    def fit(ic: Column, t: Column) -> list[Column]:
        """Terms of the fit of ln |ic| on t, 0 for values that take no part."""
        y = F.ln(F.abs(ic))
        return [F.when(F.abs(ic) > 1e-8, v).otherwise(0.0) for v in (F.lit(1.0), t, y, t * t, t * y)]

    sums = [F.sum(v).over(w).alias(f"s{i}") for i, v in enumerate(fit(F.col("ic"), F.col("t")))]
    x = x.select("formula_id", "epoch", "t", F.avg("ic").over(w).alias("mean"), F.stddev_pop("ic").over(w).alias("std"), F.sum((F.col("ic") > 0).cast("long")).over(w).alias("up"), *sums)
    added = (F.col("mean") != 0).cast("long")
    x = x.withColumns({f"s{i}": F.col(f"s{i}") + v for i, v in enumerate(fit(F.col("mean"), F.col("t") + 1))})
    x = x.withColumn("n", (F.col("t") + 1 + added).cast("long"))
    fall = -F.try_divide(F.col("s0") * F.col("s4") - F.col("s1") * F.col("s2"), F.nullif(F.col("s0") * F.col("s3") - F.col("s1") * F.col("s1"), F.lit(0.0)))
    x = x.select("formula_id", "epoch", "mean", "std", "n", ((F.col("up") + (F.col("mean") > 0).cast("long")) / F.col("n")).alias("stable"), F.lit(0.0).alias("msc"), F.when(F.col("s0") >= 4, fall).alias("rate"))
    x = x.withColumn("falling", F.coalesce(F.col("rate") > F.ln(F.lit(2.0)) / SHORT_HALF_LIFE, F.lit(False)))
    x = x.join(judged(x), ["formula_id", "epoch"]).join(novelty, "formula_id", "left")
    ratio = F.when(F.col("std") > 0, F.col("mean") / (F.col("std") + 1e-6)).otherwise(0.0)
    parts = {
        "ic": _unit(1 - F.exp(-F.greatest("mean", F.lit(0.0)) / IC_REFERENCE)),
        "stability": _unit(1 - F.exp(-F.greatest(ratio, F.lit(0.0)) / STABILITY_REFERENCE)),
        "decay": F.when(F.col("n") < 4, 0.5).when(F.coalesce(F.col("rate") <= 0, F.lit(True)), 1.0).otherwise(_unit(F.ln(F.lit(2.0)) / F.col("rate") / FULL_HALF_LIFE)),
        "novelty": _unit(1 - F.abs(F.coalesce("max_corr", F.lit(0.0)))),
        "capacity": _unit((0.5 * F.col("stable") + 0.25 * F.least(F.col("n") / 20, F.lit(1.0)) + 0.175) * F.col("multiplier")),
    }
    x = x.select("formula_id", "epoch", "state", "multiplier", *[v.alias(k) for k, v in parts.items()])
    x = x.withColumn("composite", _unit(sum((F.col(k) * v for k, v in COMPONENTS.items()), F.lit(0.0)))).withColumn("reward", _unit(F.col("composite") * F.col("multiplier")))
    last = [c for c in x.columns if c not in ("formula_id", "epoch")]
    g = x.groupBy("formula_id").agg(F.max(F.struct("epoch", *last)).alias("x"), F.array_sort(F.collect_list(F.struct("epoch", "reward"))).alias("all"))
    smooth = F.aggregate(F.slice("all", F.lit(2), F.greatest(F.size("all") - 1, F.lit(0))), F.element_at("all", 1)["reward"], lambda a, v: alpha * v["reward"] + (1 - alpha) * a)
    return g.select("formula_id", "x.*", smooth.alias("smoothed"))


def regime_component(ics: DataFrame) -> DataFrame:
    """(formula_id, regime, ic) to the worst mean IC over the regimes with three values or more and
    its score; with fewer than two such regimes there is no worst and the score is neutral."""
    r = ics.where("ic is not null").groupBy("formula_id", "regime").agg(F.avg("ic").alias("m"), F.count("*").alias("n"))
    r = r.groupBy("formula_id").agg(F.min(F.when(F.col("n") >= 3, F.col("m"))).alias("worst"), F.count(F.when(F.col("n") >= 3, 1)).alias("regimes"))
    worst = F.when(F.col("regimes") >= 2, F.col("worst"))
    return r.select("formula_id", "regimes", worst.alias("worst"), F.when(worst.isNull(), 0.5).otherwise(_unit(1 - F.exp(-F.greatest(worst, F.lit(0.0)) / IC_REFERENCE))).alias("score"))


def recent_slope(facts: DataFrame, n: int = 8) -> DataFrame:
    """Slope of the last ``n`` ICs of each formula."""
    last = facts.withColumn("k", F.row_number().over(Window.partitionBy("formula_id").orderBy(F.desc("epoch")))).where(F.col("k") <= n)
    return last.groupBy("formula_id").agg(F.regr_slope("ic", -F.col("k").cast("double")).alias("slope"), F.count("*").alias("n"))


def rewards(facts: DataFrame) -> DataFrame:
    """0.6 of the positive IC and 0.4 of the positive contribution, normalised and ranked."""
    g = facts.groupBy("uid").agg(F.greatest(F.avg("ic"), F.lit(0.0)).alias("ic"), F.greatest(F.avg("msc"), F.lit(0.0)).alias("msc"))
    every = Window.partitionBy()
    score = 0.6 * F.col("ic") + 0.4 * F.col("msc")
    total = F.sum(score).over(every)
    g = g.select("uid", "ic", "msc", F.when(total > 1e-8, score / total).otherwise(1.0 / F.count("*").over(every)).alias("reward"))
    return g.withColumn("place", F.row_number().over(Window.orderBy(F.desc(F.round("reward", 10)), "uid")))


def meta_scores(pred: DataFrame) -> DataFrame:
    """Per predictor (uid): Spearman correlation of predicted and actual, and direction accuracy."""
    r = pred.select("uid", "predicted", "actual", average_rank(F.col("predicted"), ("uid",)).alias("rp"), average_rank(F.col("actual"), ("uid",)).alias("ra"))
    return r.groupBy("uid").agg(_pearson("rp", "ra", 1e-12).alias("rank_corr"), F.avg((F.signum("predicted") == F.signum("actual")).cast("double")).alias("direction"), F.count("*").alias("n"))


def round_trips(spark, capital: float) -> DataFrame:
    """Round-trip cost per ticker at a daily turnover of a twentieth of the capital."""
    share = F.lit(capital * 0.05) / (F.col("adv_bn") * 1e9)
    return cost_table(spark).select("asset", (F.col("spread_bps") + 2 * F.col("eta") * 0.01 * F.sqrt(share) * 1e4).alias("bps"))


def annual_drag(universe: DataFrame, turnover: float, capitals: list[float]) -> DataFrame:
    """Yearly cost of a daily turnover over a universe, by capital."""
    c = universe.join(F.broadcast(cost_table(universe.sparkSession)), "asset", "left").fillna(dict(zip(("spread_bps", "eta", "adv_bn"), COSTS["_DEFAULT"], strict=True)))
    m = c.agg(F.avg("spread_bps").alias("s"), F.avg("eta").alias("e"), F.avg("adv_bn").alias("a"), F.count("*").alias("n"))
    each = F.explode(F.array(*map(F.lit, capitals))).alias("capital")
    impact = F.col("e") * 0.01 * F.sqrt(F.col("capital") * turnover / F.col("n") / (F.col("a") * 1e9))
    return m.select("*", each).select("capital", (turnover * (F.col("s") / 2e4 + impact) * 252).alias("drag"))


def category(formula: Column) -> Column:
    """The hypothesis category that a formula's words point to, in fixed order."""
    f = F.lower(formula)
    has = lambda *w: F.greatest(*[F.contains(f, F.lit(x)).cast("int") for x in w], F.lit(0)) == 1
    return F.when(has("momentum"), "momentum").when(has("vol", "rsi"), "volatility").when(has("regime"), "regime").when(has("zscore"), "mean_reversion").when(has("relative"), "cross_asset")


def matched(formulas: DataFrame, hypotheses: DataFrame) -> DataFrame:
    """Each formula with the most trusted hypothesis of its category."""
    best = hypotheses.groupBy("category").agg(F.max_by("hypothesis", F.struct("confidence", "hypothesis")).alias("hypothesis"))
    return formulas.select("formula", category(F.col("formula")).alias("category")).join(F.broadcast(best), "category", "left")


def combined(sig: DataFrame, weights: DataFrame) -> DataFrame:
    """Weighted sum of signals where all are present."""
    w = F.broadcast(weights)
    need = weights.count()
    return sig.where("val is not null").join(w, "formula_id").groupBy("dt", "asset").agg(F.sum(F.col("weight") * F.col("val")).alias("val"), F.count("*").alias("n")).where(F.col("n") == need).select("dt", "asset", "val")


def in_regime(panel: DataFrame, labels: DataFrame, regime: str) -> DataFrame:
    """Returns between the dates of one regime, also across the gaps between them."""
    return with_returns(panel.join(F.broadcast(labels.where(F.col("regime") == regime)), "dt", "left_semi")).select("dt", "asset", "ret")


def position_table(w: DataFrame) -> DataFrame:
    """Positions of the last date, largest first."""
    last = w.agg(F.max("dt").alias("dt"))
    side = F.when(F.col("w") > 0, "LONG").when(F.col("w") < 0, "SHORT").otherwise("FLAT")
    return w.join(F.broadcast(last), "dt", "left_semi").select("asset", "w", side.alias("side"), F.row_number().over(Window.orderBy(F.desc(F.round(F.abs("w"), 10)), "asset")).alias("place"))


def library_capacity(facts: DataFrame) -> DataFrame:
    """Capacity of a library entry from its IC, ratio, stability and decay."""
    g = facts.groupBy("formula_id").agg(F.avg("ic").alias("m"), F.stddev_samp("ic").alias("s"), F.avg((F.col("ic") > 0).cast("double")).alias("pos"))
    ir = F.coalesce(F.try_divide("m", F.nullif("s", F.lit(0.0))), F.lit(0.0))
    v = F.greatest(F.lit(0.0), F.least(F.col("m") / 0.1, F.lit(1.0))) * F.greatest(F.lit(0.0), F.least(ir, F.lit(1.0))) * F.col("pos")
    return g.select("formula_id", F.greatest(F.lit(0.05), F.least(F.lit(1.0), v)).alias("capacity"))


def cluster_statistics(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """Mean |corr| within and between clusters, and the Herfindahl index of their sizes."""
    a, b = labels.select(F.col("formula_id").alias("a"), F.col("cluster").alias("ca")), labels.select(F.col("formula_id").alias("b"), F.col("cluster").alias("cb"))
    j = pairs.join(F.broadcast(a), "a").join(F.broadcast(b), "b")
    m = j.agg(F.avg(F.when(F.col("ca") == F.col("cb"), F.abs("corr"))).alias("within"), F.avg(F.when(F.col("ca") != F.col("cb"), F.abs("corr"))).alias("between"))
    n = labels.groupBy("cluster").count().agg((F.sum(F.col("count") * F.col("count")) / F.pow(F.sum("count"), F.lit(2))).alias("hhi"))
    return m.crossJoin(n)


def scenario_report(panel: DataFrame, shocked: DataFrame, pnl_of) -> DataFrame:
    """Sharpe of each formula on the panel and under a shock, and whether it survives."""
    s = lambda p, n: pnl_of(p).groupBy("formula_id").agg((F.avg("pnl") / (F.stddev_pop("pnl") + 1e-8) * F.sqrt(F.lit(252.0))).alias(n))
    return s(panel, "base").join(s(shocked, "under_shock"), "formula_id").withColumn("survived", F.col("under_shock") > 0)
