"""Adaptive ensemble: two pools of formulas, weights per regime, profits of the blend, and positions
that move only part of the way to a new target.

A formula's profit at a date is that of its rank weights over the log return of the step after
next; the regime that judges it is that of the date between.  Everything that is fitted is a table
with a row per formula; profits and positions are per date, so nothing grows with assets times
formulas beyond the signals themselves.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelforge.operators.scoring import KEY, per_date, per_formula, sharpe, weights
from panelforge.plans.formula import average_rank
from panelforge.sources.panel import date_order, own_rows, with_returns

REGIMES = ("calm", "normal", "stress")
#: Formulas that every ensemble has, in order; those that may represent the calm pool.
ANCHORS = ("momentum_20d - volatility_20d", "momentum_60d", "cross_momentum", "market_corr_20d", "vol_ratio")
CALM_REPRESENTATIVES = ("momentum_20d - volatility_20d", "momentum_60d", "vol_ratio")
#: Parts of names that point to a pool, with their points.
STRESS_NAMES = {"market_corr": 1, "corr_60d": 1, "corr_20d": 1, "equity_bond_corr": 1}
CALM_NAMES = {"zscore": 1, "reversal": 1, "mean_rev": 1, "rsi": 1, "cross_momentum": 1, "vol_ratio": 2}
#: Worst Sharpe kept, sizes of the pools, dates a Sharpe and a regime's weights need.
REJECT, CALM_POOL, STRESS_POOL, LEAST_SHARPE, LEAST_WEIGHTS = -0.20, 6, 4, 10, 60
#: Representatives, share of the regime's weights in a profit, dates of a risk parity.
REPRESENTATIVES, REGIME_SHARE, PARITY = 2, 0.70, 61
#: The volatility formula that joins in calm markets, from which share on, and at most.
NORMAL_FORMULA, NORMAL_FROM, NORMAL_MOST = "vol_ratio", 0.60, 0.15
#: Share of the old positions kept, and the change that is not worth a trade.
INERTIA, NO_TRADE = 0.70, 0.02


def log_pnl(sig: DataFrame, panel: DataFrame, lead: int = 2) -> DataFrame:
    """(formula_id, dt, pnl) of rank weights over log returns."""
    ahead = with_returns(panel).select("dt", "asset", F.lead("lret", lead).over(own_rows()).alias("fwd"))
    j = weights(sig).join(ahead, ["dt", "asset"]).where("fwd is not null")
    return j.groupBy(*KEY).agg(F.sum(F.col("w") * F.col("fwd")).alias("pnl"))


def between(by_date: DataFrame) -> DataFrame:
    """A table with a row per date, moved so that a profit meets the date after its weights."""
    cols = [c for c in by_date.columns if c != "dt"]
    return by_date.select("dt", *[F.lead(c).over(date_order()).alias(c) for c in cols])


def split(pnl: DataFrame, share: float) -> DataFrame:
    """``pnl`` with whether a date is among the first ``share`` of all."""
    i, n = F.row_number().over(date_order()), F.count("*").over(Window.partitionBy())
    d = pnl.select("dt").distinct()  # one row a date
    return pnl.join(d.select("dt", (i <= F.floor(n * share)).alias("train")), "dt")


def _points(names: dict[str, int]) -> Column:
    return sum((F.when(F.contains(F.col("formula_id"), F.lit(k)), v).otherwise(0) for k, v in names.items()), F.lit(0))


def _softmax(x: Column, over: Window) -> Column:
    """Equal shares where nothing is positive; else softmax of the positive parts over their largest."""
    pos = F.greatest(x, F.lit(0.0))
    scaled = pos / (F.max(pos).over(over) + 1e-8)
    e = F.exp(scaled - F.max(scaled).over(over))
    return F.when(F.sum(pos).over(over) < 1e-8, 1.0 / F.count("*").over(over)).otherwise(e / F.sum(e).over(over))


def fit(pnl: DataFrame, labels: DataFrame, formulas: Iterable[str]) -> DataFrame:
    """A row per formula of the two pools: Sharpe by regime, place in its pool, role, and for the
    representatives of the calm pool their weights by regime (null where a regime has too few
    dates).  ``formulas`` gives the order.  Where fewer than two of the usual representatives are in
    the pool, the two with the highest mean Sharpe over regimes stand in."""
    order = pnl.sparkSession.createDataFrame([(f, i) for i, f in enumerate(dict.fromkeys([*ANCHORS, *formulas]))], "formula_id string, ord int")
    s = pnl.join(between(labels), "dt").groupBy("formula_id", "regime").agg(F.count("*").alias("n"), sharpe(F.avg("pnl"), F.stddev_pop("pnl")).alias("s"))
    s = s.groupBy("formula_id").pivot("regime", list(REGIMES)).agg(F.first("n").alias("n"), F.first("s").alias("s"))
    own = [F.when(F.col(f"{r}_n") > LEAST_SHARPE, F.col(f"{r}_s")).otherwise(0.0).alias(r) for r in REGIMES]
    s = s.select("formula_id", *own, *[F.coalesce(f"{r}_n", F.lit(0)).alias(f"n_{r}") for r in REGIMES]).join(F.broadcast(order), "formula_id")
    s = s.where(F.greatest(*REGIMES) >= REJECT)
    anchor = F.col("formula_id").isin(*ANCHORS)
    stress, calm = _points(STRESS_NAMES), _points(CALM_NAMES)
    pool = F.when(anchor, "calm").when(stress > calm, "stress").when((calm > 0) | (F.col("calm") >= F.col("stress")), "calm").otherwise("stress")
    s = s.withColumn("pool", pool).withColumn("place", F.row_number().over(Window.partitionBy("pool").orderBy("ord")))
    s = s.where(F.col("place") <= F.when(F.col("pool") == "calm", CALM_POOL).otherwise(STRESS_POOL))
    by_pool = Window.partitionBy("pool")
    usual = F.array_position(F.array(*map(F.lit, CALM_REPRESENTATIVES)), F.col("formula_id"))
    usual = F.when((F.col("pool") == "calm") & (usual > 0), usual)
    enough = F.count(usual).over(by_pool) >= REPRESENTATIVES
    mean = (F.col("calm") + F.col("normal") + F.col("stress")) / 3
    s = s.withColumn("usual", usual).withColumn("enough", enough)
    s = s.withColumn("turn", F.row_number().over(by_pool.orderBy(F.when(F.col("enough"), F.col("usual")).asc_nulls_last(), F.desc(mean), "place")))
    s = s.withColumn("best", F.row_number().over(by_pool.orderBy(F.desc("stress"), "place")))
    s = s.withColumn("pools", F.size(F.collect_set("pool").over(Window.partitionBy())))  # ten rows at most
    representative = (F.col("pool") == "calm") & (F.col("turn") <= REPRESENTATIVES)
    # without a stress pool the first calm formula stands in
    specialist = F.when(F.col("pool") == "stress", F.col("best") == 1).otherwise((F.col("pools") == 1) & (F.col("place") == 1))
    s = s.withColumn("representative", representative).withColumn("specialist", specialist)
    mine = Window.partitionBy("representative")
    w = [F.when(F.col("representative") & (F.col(f"n_{r}") >= LEAST_WEIGHTS), _softmax(F.col(r), mine)).alias(f"w_{r}") for r in REGIMES]
    # weights under a forecast: by the calm Sharpe; equal where that regime was too short
    short = F.col("n_calm") < LEAST_WEIGHTS
    w.append(F.when(F.col("representative"), F.when(short, 1.0 / F.count("*").over(mine)).otherwise(_softmax(F.col("calm"), mine))).alias("w_forecast"))
    return s.select("formula_id", "pool", "place", *REGIMES, "representative", "specialist", *w)


def _parts(pnl: DataFrame, fitted: DataFrame) -> DataFrame:
    """Per date: sums over the representatives under each weighting, the specialist's profit, the
    mean of all of these, and that of the volatility formula.  ``fitted`` has at most ten rows."""
    f = fitted.where("representative or specialist").drop("pool", "place", *REGIMES)
    x = pnl.join(F.broadcast(f), "formula_id")
    inv = 1 / (F.stddev_pop("pnl").over(per_formula().rowsBetween(1 - PARITY, 0)) + 1e-8)
    x = x.withColumn("inv", inv)
    total = lambda w: F.sum(F.when(F.col("representative"), F.col("pnl") * w))
    parity = total(F.col("inv")) / F.sum(F.when(F.col("representative"), F.col("inv")))
    n = F.sum(F.col("representative").cast("int") + F.col("specialist").cast("int"))
    d = x.groupBy("dt").agg(
        *[F.coalesce(total(F.col(f"w_{r}")), parity).alias(r) for r in REGIMES],
        total(F.col("w_forecast")).alias("forecast"),
        F.sum(F.when(F.col("specialist"), F.col("pnl"))).alias("specialist"),
        (F.sum(F.col("pnl") * (F.col("representative").cast("int") + F.col("specialist").cast("int"))) / n).alias("every"),
    )
    v = pnl.where(F.col("formula_id") == NORMAL_FORMULA).select("dt", F.col("pnl").alias("vol"))
    return d.join(v, "dt", "left")


def ensemble_pnl(pnl: DataFrame, labels: DataFrame, fitted: DataFrame) -> DataFrame:
    """(dt, regime, pnl): the regime's weights, or the specialist under stress, blended with the
    mean of all.  A regime without weights takes a risk parity of the last dates."""
    d = _parts(pnl, fitted).join(between(labels), "dt")
    raw = F.when((F.col("regime") == "stress") & F.col("specialist").isNotNull(), F.col("specialist")).when(F.col("regime") == "calm", F.col("calm")).when(F.col("regime") == "stress", F.col("stress")).otherwise(F.col("normal"))
    return d.select("dt", "regime", (REGIME_SHARE * raw + (1 - REGIME_SHARE) * F.col("every")).alias("pnl"))


def forecast_pnl(pnl: DataFrame, probabilities: DataFrame, fitted: DataFrame) -> DataFrame:
    """(dt, pnl): the pools blended by regime probabilities (dt, calm, normal, stress), with some of
    the volatility formula where a normal regime is likely."""
    p = between(probabilities).select("dt", *[F.coalesce(r, F.lit(1.0 if r == "normal" else 0.0)).alias(f"p_{r}") for r in REGIMES])
    d = _parts(pnl, fitted).join(p, "dt")
    total = F.col("p_calm") + F.col("p_normal") + F.col("p_stress") + 1e-8
    stress = F.col("p_stress") / total
    vol = F.least(F.lit(NORMAL_MOST), F.greatest(F.lit(0.0), (F.col("p_normal") / (total + 1e-8) - NORMAL_FROM) / (1 - NORMAL_FROM)))
    other = F.when(F.col("specialist").isNotNull(), F.col("specialist")).when(stress > 0.1, F.col("forecast")).otherwise(0.0)
    raw = F.col("forecast") * (F.col("p_calm") + F.col("p_normal")) / total + other * stress + F.coalesce(F.col("vol") * vol, F.lit(0.0))
    return d.select("dt", (REGIME_SHARE * raw + (1 - REGIME_SHARE) * F.col("every")).alias("pnl"))


# ---- positions -------------------------------------------------------------------------------
def combine(sig: DataFrame, shares: DataFrame, by: str) -> DataFrame:
    """(portfolio, dt, assets, target): signals of the formulas in ``shares`` (``by``, formula_id, w)
    combined by weight, without a market part, of absolute sum 1; no row where nothing is left.
    Arrays are in the order of the assets' names.  ``shares`` has a fixed number of rows, or ``by``
    may name columns (as ``portfolio, dt``) that it shares with the signals."""
    r = sig.withColumn("r", average_rank(F.col("val"), KEY))
    r = r.withColumn("r", F.col("r") - F.avg("r").over(per_date()))
    size = F.sum(F.abs("r")).over(per_date())
    r = r.withColumn("r", F.when(size < 1e-8, 0.0).otherwise(F.col("r") / size)).select("formula_id", "dt", "asset", "r")
    on = ["formula_id", *[c for c in shares.columns if c == "dt"]]
    x = r.join(shares, on).groupBy(by, "dt", "asset").agg(F.sum(F.col("w") * F.col("r")).alias("x"))
    every = Window.partitionBy(by, "dt")
    x = x.withColumn("x", F.col("x") - F.avg("x").over(every)).withColumn("size", F.sum(F.abs("x")).over(every)).where("size >= 1e-8")
    g = x.groupBy(F.col(by).alias("portfolio"), "dt").agg(F.array_sort(F.collect_list(F.struct("asset", (F.col("x") / F.col("size")).alias("x")))).alias("a"))
    return g.select("portfolio", "dt", F.col("a.asset").alias("assets"), F.col("a.x").alias("target"))


def held(before: np.ndarray | None, target: np.ndarray) -> np.ndarray:
    """Positions after a date: the old ones if the target is near, else most of the old and some of
    the new, without a market part, of absolute sum 1."""
    if before is None or len(before) != len(target):
        return target
    if np.abs(target - before).sum() <= NO_TRADE:
        return before
    x = INERTIA * before + (1 - INERTIA) * target
    x = x - x.mean()
    size = np.abs(x).sum()
    return x / size if size > 1e-8 else target


def _walk(pdf: pd.DataFrame, assets: list | None, at: np.ndarray | None) -> tuple[list[np.ndarray], list | None, np.ndarray | None]:
    out = []
    for names, target in zip(pdf.assets, pdf.target, strict=True):
        at = held(at if assets == list(names) else None, np.asarray(target, float))
        assets = list(names)
        out.append(at)
    return out, assets, at


SCHEMA = "portfolio string, dt date, assets array<string>, position array<double>"


def positions(targets: DataFrame) -> DataFrame:
    """Positions of each portfolio, date after date; portfolios are independent of each other."""

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("dt")
        return pdf[["portfolio", "dt", "assets"]].assign(position=_walk(pdf, None, None)[0])

    return targets.groupBy("portfolio").applyInPandas(fold, SCHEMA)


def positions_stream(targets: DataFrame) -> DataFrame:
    """The same over a stream: a portfolio's last assets and positions are its state, so a restart
    goes on where it stopped.  Dates arrive in order, and each once."""

    def step(key: tuple, pdfs: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        assets, at = state.get if state.exists else (None, None)
        assets, at = (list(assets), np.asarray(at, float)) if at is not None else (None, None)
        pdf = pd.concat(list(pdfs)).sort_values("dt")
        moved, assets, at = _walk(pdf, assets, at)
        state.update((assets, at.tolist()))
        yield pdf[["portfolio", "dt", "assets"]].assign(position=moved)

    return targets.groupBy("portfolio").applyInPandasWithState(step, SCHEMA, "assets array<string>, position array<double>", "append", "NoTimeout")


def exploded(held_positions: DataFrame) -> DataFrame:
    """(portfolio, dt, asset, position)."""
    x = held_positions.select("portfolio", "dt", F.explode(F.arrays_zip("assets", "position")).alias("x"))
    return x.select("portfolio", "dt", F.col("x.assets").alias("asset"), F.col("x.position").alias("position"))


def regime_shares_by_date(labels: DataFrame, fitted: DataFrame, recent: DataFrame) -> DataFrame:
    """(portfolio, dt, formula_id, w) of the representatives: weights of the date's regime, or a risk
    parity (``recent``: formula_id, inv) where the regime has none."""
    f = fitted.where("representative").select("formula_id", *[f"w_{r}" for r in REGIMES]).join(recent, "formula_id")
    f = f.withColumn("parity", F.col("inv") / F.sum("inv").over(Window.partitionBy()))  # two rows
    own = F.coalesce(*[F.when(F.col("regime") == r, F.col(f"w_{r}")) for r in REGIMES])
    return labels.crossJoin(F.broadcast(f)).select(F.lit("regime").alias("portfolio"), "dt", "formula_id", F.coalesce(own, F.col("parity")).alias("w"))


def pools(fitted: DataFrame) -> DataFrame:
    """(portfolio, formula_id, w): the calm representatives by their calm weights, and the specialist."""
    calm = fitted.where("representative").select(F.lit("calm").alias("portfolio"), "formula_id", F.coalesce("w_calm", F.lit(1.0 / REPRESENTATIVES)).alias("w"))
    return calm.union(fitted.where("specialist").select(F.lit("stress").alias("portfolio"), "formula_id", F.lit(1.0).alias("w")))


def blended(each: DataFrame, probabilities: DataFrame) -> DataFrame:
    """(dt, asset, position): positions of the two pools, each with a memory of its own, blended by
    the regimes' probabilities, of absolute sum 1."""
    total = F.col("calm") + F.col("normal") + F.col("stress")
    total = F.when(total < 1e-8, 1.0).otherwise(total)
    p = probabilities.select("dt", ((F.col("calm") + F.col("normal")) / total).alias("p_calm"), (F.col("stress") / total).alias("p_stress"))
    x = each.join(p, "dt").groupBy("dt", "asset").agg(F.sum(F.col("position") * F.when(F.col("portfolio") == "calm", F.col("p_calm")).otherwise(F.col("p_stress"))).alias("x"))
    size = F.sum(F.abs("x")).over(Window.partitionBy("dt"))
    return x.withColumn("size", size).where("size >= 1e-8").select("dt", "asset", (F.col("x") / F.col("size")).alias("position"))
