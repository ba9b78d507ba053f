"""Ledger operators: submissions, lifecycle, hypotheses, graph, market, consensus, rewards, trust.

Facts are append-only tables keyed by participant or formula and epoch.  Everything that is a
sum, a rank or a last value is relational; recurrences per key (trust, credibility, lifecycle)
are folds over the key's ordered history.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelforge.operators.alignment import softmax

#: Role budgets and lifecycle multipliers.
ROLE_BUDGETS = {"signal": 0.30, "strategy": 0.25, "risk": 0.20, "portfolio": 0.15, "meta": 0.10}
MULTIPLIERS = {"EXPERIMENTAL": 0.3, "VALIDATED": 0.7, "PRODUCTION": 1.0, "DECAYING": 0.3, "RETIRED": 0.0}


def formula_id(c: str) -> Column:
    return F.substring(F.sha2(F.trim(c), 256), 1, 12)


def hypothesis_id(c: str) -> Column:
    return F.substring(F.sha2(F.lower(F.trim(c)), 256), 1, 12)


def sanitised(submissions: DataFrame, cap: int = 32) -> DataFrame:
    """(uid, epoch, formula): at most ``cap`` formulas of each, safe by length and characters.
    The syntax check of single formulas is the language's."""
    f = submissions.select("uid", "epoch", F.explode(F.slice("formulas", 1, cap)).alias("formula")).withColumn("formula", F.trim("formula"))
    return f.where((F.length("formula") > 0) & (F.length("formula") <= 200) & F.lower("formula").rlike(r"^[a-z0-9_()+\-*/.,=% ]+$") & ~F.col("formula").contains("__"))


def first_submitters(f: DataFrame) -> DataFrame:
    """One row per formula and epoch: the smallest uid keeps it."""
    return f.groupBy("epoch", formula_id("formula").alias("id")).agg(F.min("uid").alias("uid"), F.min_by("formula", "uid").alias("formula"), F.count("*").alias("copies"))


def valid_weights(c: str, tolerance: float = 0.02) -> Column:
    """A map of weights: not empty, none negative, sum 1 within the tolerance."""
    v = F.map_values(c)
    total = F.aggregate(v, F.lit(0.0), lambda a, x: a + x)
    return (F.size(v) > 0) & ~F.exists(v, lambda x: x < 0) & (F.abs(total - 1) <= tolerance)


# ---- scores ----------------------------------------------------------------------------------
def role_rewards(scores: DataFrame, budgets: dict[str, float] | None = None) -> DataFrame:
    """(role, uid, reward): softmax of the scores within a role times its share of the budget
    among the active roles."""
    budgets = budgets or ROLE_BUDGETS
    b = F.coalesce(*[F.when(F.col("role") == k, F.lit(v)) for k, v in budgets.items()])
    active = scores.select("role").distinct().select("role", b.alias("b"))
    active = active.select("role", (F.col("b") / F.sum("b").over(Window.partitionBy())).alias("budget"))
    x = scores.withColumn("share", softmax(F.col("score"), "role"))
    return x.join(F.broadcast(active), "role").select("role", "uid", (F.col("share") * F.col("budget")).alias("reward"))


def aligned_weights(rewards: DataFrame, universe: DataFrame) -> DataFrame:
    """A weight for every uid: zero where there is no reward; equal where all are zero."""
    r = rewards.groupBy("uid").agg(F.sum("reward").alias("r"))
    x = universe.select("uid").distinct().join(r, "uid", "left").withColumn("r", F.greatest(F.coalesce("r", F.lit(0.0)), F.lit(0.0)))
    every = Window.partitionBy()
    total = F.sum("r").over(every)
    return x.select("uid", F.when(total > 0, F.col("r") / total).otherwise(1.0 / F.count("*").over(every)).alias("weight"))


def leaderboard(facts: DataFrame) -> DataFrame:
    """Per formula the best and last values and counts."""
    return facts.groupBy("formula_id").agg(
        F.max("ic").alias("best_ic"),
        F.avg("ic").alias("mean_ic"),
        F.max_by("ic", F.struct("epoch", "uid", "ic")).alias("last_ic"),
        F.count("*").alias("n"),
        F.countDistinct("uid").alias("n_uids"),
        (F.max("epoch") - F.min("epoch") + 1).alias("longevity"),
    )


def concentration(facts: DataFrame) -> DataFrame:
    """Counts and the Herfindahl index of formulas per participant."""
    per = facts.groupBy("uid").agg(F.countDistinct("formula_id").alias("n"))
    return per.agg(F.sum("n").alias("n_formulas"), F.count("*").alias("n_uids"), (F.sum(F.col("n") * F.col("n")) / F.pow(F.sum("n"), F.lit(2))).alias("hhi"))


def evict(entries: DataFrame, cap: int) -> DataFrame:
    """Entries (formula_id, last_epoch, state) that stay when there are more than ``cap``: the
    retired ones last seen longest ago go, ties by id, and no others, so more than ``cap`` may stay.
    Only the number to remove reaches the driver; what goes is a sort with a limit."""
    over = entries.count() - cap
    if over <= 0:
        return entries
    gone = entries.where("state = 'RETIRED'").orderBy("last_epoch", "formula_id").limit(over)
    return entries.join(gone.select("formula_id"), "formula_id", "left_anti")


# ---- trust -----------------------------------------------------------------------------------
def trust(scores: DataFrame, keep: float = 0.9) -> DataFrame:
    """Exponential mean of a participant's scores by epoch, from the first score on."""
    w = Window.partitionBy("uid").orderBy("epoch").rowsBetween(Window.unboundedPreceding, 0)
    v = F.collect_list("score").over(w)
    return scores.select("uid", "epoch", "score", F.aggregate(F.slice(v, 2, F.size(v)), F.element_at(v, 1), lambda a, x: a * keep + x * (1 - keep)).alias("trust"))


def spike_penalty(t: DataFrame, floor: float = 2.0, cap: float = 0.5, least: int = 5, window: int = 60) -> DataFrame:
    """Trust less a penalty for a score far above the participant's own history."""
    w = Window.partitionBy("uid").orderBy("epoch").rowsBetween(-(window - 1), -1)
    n = F.count("score").over(w)
    sigma = (F.col("score") - F.avg("score").over(w)) / (F.stddev_pop("score").over(w) + 1e-9)
    p = F.when((n + 1 >= least) & (sigma > floor), F.least(F.lit(cap), (sigma - floor) / (2 * floor) * cap)).otherwise(0.0)
    return t.select("uid", "epoch", "score", "trust", p.alias("penalty"), (F.col("trust") * (1 - p)).alias("adjusted"))


def diversity_penalty(cosines: DataFrame, units: DataFrame, threshold: float = 0.85, most: float = 0.4) -> DataFrame:
    """(uid, penalty) from the pairwise cosines of participants' mean weight vectors."""
    both = cosines.select(F.col("a").alias("uid"), "cosine").unionByName(cosines.select(F.col("b").alias("uid"), "cosine"))
    over = F.greatest(F.lit(0.0), F.abs("cosine") - threshold)
    g = both.groupBy("uid").agg(F.avg(over).alias("excess"))
    return units.select("uid").distinct().join(g, "uid", "left").select("uid", F.coalesce(F.least(F.lit(most), F.col("excess") / 0.15 * most), F.lit(0.0)).alias("penalty"))


def capital_feedback(trusted: DataFrame, positions: DataFrame, returns: DataFrame, weight: float = 0.2, scale: float = 0.3) -> DataFrame:
    """Trust blended with tanh of the annual return of the participant's unit positions."""
    norm = F.sum(F.abs("w")).over(Window.partitionBy("uid"))
    p = positions.withColumn("w", F.try_divide("w", F.nullif(norm, F.lit(0.0)))).where("w is not null")
    days = returns.select("dt").distinct().count()
    g = p.join(returns, "asset").groupBy("uid").agg((F.sum(F.col("w") * F.col("lret")) / days * 252).alias("annual"))
    blend = F.greatest(F.lit(0.0), (1 - weight) * F.col("trust") + weight * F.tanh(F.col("annual") / scale))
    return trusted.join(g, "uid", "left").select("uid", "trust", "annual", F.when(F.col("annual").isNull(), F.col("trust")).otherwise(blend).alias("adjusted"))


# ---- lifecycle -------------------------------------------------------------------------------
#: State (None: any), guard, next state; the first rule that applies is taken.
TRANSITIONS = (
    (None, "spent", "RETIRED"),
    ("DECAYING", "overdue", "RETIRED"),
    ("EXPERIMENTAL", "proven", "VALIDATED"),
    ("VALIDATED", "weak", "DECAYING"),
    ("VALIDATED", "steady", "PRODUCTION"),
    ("PRODUCTION", "weak", "DECAYING"),
    ("DECAYING", "recovered", "VALIDATED"),
)


def lifecycle(facts: DataFrame, min_epochs: int = 3, min_ic: float = 0.01, retire_ic: float = 0.005, min_stability: float = 0.60, retire_after: int = 5, half_life: float = 10.0) -> DataFrame:
    """State of each formula after every epoch: running statistics are windows over its history,
    then ``TRANSITIONS`` are folded over them, one group per formula (a row per epoch it lives).
    An optional column ``msc`` must have a mean of at least 0 for production.  A formula decays
    when the fit of ``ln |ic|``, over at least four values beyond 1e-8, has a shorter half-life."""
    w = Window.partitionBy("formula_id").orderBy("epoch").rowsBetween(Window.unboundedPreceding, 0)
    msc = F.col("msc") if "msc" in facts.columns else F.lit(0.0)
    x = facts.select("formula_id", "epoch", "ic", msc.alias("msc"), (F.row_number().over(Window.partitionBy("formula_id").orderBy("epoch")) - 1).cast("double").alias("t"))
    y = F.when(F.abs("ic") > 1e-8, F.ln(F.abs("ic")))
    rate = -F.regr_slope(y, F.col("t")).over(w)
    h = x.select("formula_id", "epoch", F.count("*").over(w).alias("n"), F.avg("ic").over(w).alias("mean"), F.avg((F.col("ic") > 0).cast("double")).over(w).alias("stable"), F.avg("msc").over(w).alias("msc"), ((F.count(y).over(w) >= 4) & (rate > math.log(2) / half_life)).alias("falling"))
    return judged(h, min_epochs, min_ic, retire_ic, min_stability, retire_after)


def judged(h: DataFrame, min_epochs: int = 3, min_ic: float = 0.01, retire_ic: float = 0.005, min_stability: float = 0.60, retire_after: int = 5) -> DataFrame:
    """States from running statistics: ``h`` has formula_id, epoch, n, mean, stable, msc, falling."""
    falling = F.coalesce("falling", F.lit(False))
    h = h.select(
        "formula_id",
        "epoch",
        ((F.col("n") >= min_epochs) & (F.col("mean") < retire_ic)).alias("spent"),
        ((F.col("n") >= min_epochs) & (F.col("mean") >= min_ic)).alias("proven"),
        (falling | (F.col("stable") < 0.35)).alias("weak"),
        ((F.col("stable") >= min_stability) & (F.coalesce("msc", F.lit(0.0)) >= 0)).alias("steady"),
        ((F.col("stable") >= 0.5) & ~falling).alias("recovered"),
    )

    def fold(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        state, spent_in, out = "EXPERIMENTAL", 0, []
        for row in pdf.sort_values("epoch").itertuples():
            guard = row._asdict() | {"overdue": spent_in >= retire_after}
            state = next((to for at, name, to in TRANSITIONS if at in (None, state) and guard[name]), state)
            spent_in = spent_in + 1 if state == "DECAYING" else 0
            out.append((key[0], row.epoch, state, MULTIPLIERS[state]))
        return pd.DataFrame(out, columns=["formula_id", "epoch", "state", "multiplier"])

    return h.groupBy("formula_id").applyInPandas(fold, "formula_id string, epoch long, state string, multiplier double")


def capacity(stability: Column, n: Column, msc: Column, crowding: Column, multiplier: Column) -> Column:
    return (0.5 * stability + 0.25 * F.least(n / 20, F.lit(1.0)) + 0.15 * msc + 0.10 * (1 - crowding)) * multiplier


def retire_rule(facts: DataFrame) -> DataFrame:
    """Retire after five observations with a low mean and little stability."""
    g = facts.groupBy("formula_id").agg(F.count("*").alias("n"), F.avg("ic").alias("mean_ic"), F.avg((F.col("ic") > 0).cast("double")).alias("stability"))
    return g.withColumn("retire", (F.col("n") >= 5) & (F.col("mean_ic") < 0.01) & (F.col("stability") < 0.3))


# ---- hypotheses and graph --------------------------------------------------------------------
def hypotheses(evidence: DataFrame, least_ic: float = 0.02) -> DataFrame:
    """Beta-Bernoulli posterior per hypothesis from its ICs (a success is one above ``least_ic``),
    with its status."""
    g = evidence.groupBy("hypothesis").agg(F.count("*").alias("n"), F.sum((F.col("ic") > least_ic).cast("long")).alias("successes"), F.avg("ic").alias("mean_ic"))
    g = g.withColumn("confidence", (1 + F.col("successes")) / (2 + F.col("n")))
    return g.withColumn("status", F.when(F.col("n") < 3, "pending").when(F.col("confidence") < 0.30, "retired").when(F.col("confidence") > 0.50, "active").otherwise("pending"))


def beta_interval(posteriors: DataFrame, level: float = 0.95) -> DataFrame:
    """Equal-tailed interval of Beta(1 + successes, 1 + failures), batch-wise: the distribution
    function of integer parameters is a binomial tail, inverted by bisection."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from math import lgamma

        def cdf(a: int, b: int, x: np.ndarray) -> np.ndarray:
            n = a + b - 1
            k = np.arange(a, n + 1)
            c = np.array([lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) for i in k])
            with np.errstate(divide="ignore"):
                return np.exp(c + k * np.log(x) + (n - k) * np.log1p(-x)).sum()

        def ppf(a: int, b: int, q: float) -> float:
            lo, hi = 0.0, 1.0
            for _ in range(60):
                mid = (lo + hi) / 2
                lo, hi = (mid, hi) if cdf(a, b, mid) < q else (lo, mid)
            return (lo + hi) / 2

        for pdf in batches:
            ab = list(zip(pdf.successes + 1, pdf.n - pdf.successes + 1, strict=True))
            yield pdf.assign(low=[ppf(int(a), int(b), (1 - level) / 2) for a, b in ab], high=[ppf(int(a), int(b), (1 + level) / 2) for a, b in ab])

    p = posteriors.select("hypothesis", "n", "successes")
    return p.mapInPandas(run, "hypothesis string, n long, successes long, low double, high double")


def propagate(links: DataFrame, facts: DataFrame) -> DataFrame:
    """Evidence of each hypothesis: the ICs of all formulas linked to it."""
    return links.join(facts, "formula_id").select("hypothesis", "formula_id", "epoch", "ic")


def knowledge(links: DataFrame, formulas: DataFrame, hyps: DataFrame) -> DataFrame:
    """Degree of every node; isolated nodes have 0."""
    f = formulas.select("formula_id").distinct().join(links, "formula_id", "left").groupBy(F.col("formula_id").alias("node")).agg(F.count("hypothesis").alias("degree")).withColumn("kind", F.lit("formula"))
    h = hyps.select("hypothesis").distinct().join(links, "hypothesis", "left").groupBy(F.col("hypothesis").alias("node")).agg(F.count("formula_id").alias("degree")).withColumn("kind", F.lit("hypothesis"))
    return f.unionByName(h)


def shared_formulas(links: DataFrame) -> DataFrame:
    """Formulas that two hypotheses share, for every such two."""
    a, b = links.select("formula_id", F.col("hypothesis").alias("a")), links.select("formula_id", F.col("hypothesis").alias("b"))
    return a.join(b, "formula_id").where("a < b").groupBy("a", "b").agg(F.count("*").alias("shared"))


# ---- market ----------------------------------------------------------------------------------
def open_positions(raw: DataFrame) -> DataFrame:
    """Positions with a stake, stake and confidence put into their ranges."""
    return raw.where("stake >= 1e-6").withColumn("stake", F.least(F.greatest("stake", F.lit(0.0)), F.lit(1.0))).withColumn("confidence", F.least(F.greatest("confidence", F.lit(0.5)), F.lit(1.0)))


def market_price(pos: DataFrame) -> DataFrame:
    """Stake-weighted signed confidence per signal."""
    sign = F.when(F.col("direction") == "LONG", 1.0).otherwise(-1.0)
    return pos.groupBy("signal").agg(F.try_divide(F.sum(F.col("stake") * F.col("confidence") * sign), F.sum("stake")).alias("price"), F.avg((F.col("direction") == "LONG").cast("double")).alias("bullish"), F.sum("stake").alias("stake"))


def settle(pos: DataFrame, actual: DataFrame) -> DataFrame:
    """Profit of +-(2c - 1) by whether the direction was right."""
    right = (F.col("actual_ic") > 0) == (F.col("direction") == "LONG")
    edge = 2 * F.col("confidence") - 1
    return pos.join(F.broadcast(actual), "signal").select("uid", "signal", right.alias("correct"), F.when(right, edge).otherwise(-edge).alias("pnl"))


def market_rewards(settled: DataFrame) -> DataFrame:
    g = settled.groupBy("uid").agg(F.sum("pnl").alias("pnl"), F.avg(F.col("correct").cast("double")).alias("accuracy"))
    return g.withColumn("weight", softmax(F.col("pnl")))


def market_blend(ic: DataFrame, price: DataFrame) -> DataFrame:
    """0.7 of the min-max scaled IC and 0.3 of the positive price."""
    every = Window.partitionBy()
    lo, hi = F.min("ic").over(every), F.max("ic").over(every)
    scaled = F.coalesce(F.try_divide(F.col("ic") - lo, F.nullif(hi - lo, F.lit(0.0))), F.lit(0.5))
    return ic.join(price.select("signal", "price"), "signal", "left").select("signal", (0.7 * scaled + 0.3 * F.greatest(F.coalesce("price", F.lit(0.0)), F.lit(0.0))).alias("blended"))


# ---- consensus -------------------------------------------------------------------------------
def consensus(proposals: DataFrame, credibility: DataFrame) -> DataFrame:
    """(role, uid, weight): stake- and credibility-weighted mean over the union of uids."""
    p = proposals.join(F.broadcast(credibility), "validator", "left").withColumn("s", F.col("stake") * F.coalesce("credibility", F.lit(1.0)))
    each = p.select("role", "s", F.explode("weights").alias("uid", "w"))
    g = each.groupBy("role", "uid").agg(F.sum(F.col("w") * F.col("s")).alias("v"))
    total = F.sum("v").over(Window.partitionBy("role"))
    return g.select("role", "uid", F.try_divide("v", total).alias("weight"))


def divergence(proposals: DataFrame, agreed: DataFrame, threshold: float = 0.05) -> DataFrame:
    """Mean squared distance of each proposal to the consensus over all uids, its penalty, and the
    validator's next credibility from 1."""
    full = proposals.select("role", "validator", "weights").join(agreed, "role")
    w = F.coalesce(F.try_element_at("weights", F.col("uid")), F.lit(0.0))
    g = full.groupBy("role", "validator").agg(F.avg(F.pow(w - F.col("weight"), F.lit(2))).alias("divergence"))
    pen = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("divergence") - threshold) / (1 - threshold)))
    return g.select("role", "validator", "divergence", pen.alias("penalty"), F.greatest(F.lit(0.1), F.least(F.lit(1.0), 0.7 + 0.3 * (1 - pen))).alias("credibility"))
