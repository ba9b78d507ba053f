"""Execution operators: constraints, trades, fills, guards, capital and the daily loop.

Everything that a date's rows decide is relational.  What depends on the day before is a fold
over one ordered, date-level history per portfolio or signal.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelforge.operators.alignment import difference

#: Sectors and half the limits of the constraint solver.
SECTORS = {"SPY": "equity_us", "QQQ": "equity_us", "IWM": "equity_us", "TLT": "rates", "HYG": "credit", "GLD": "commodities", "DBC": "commodities", "EEM": "equity_em", "FXI": "equity_em", "VNQ": "real_estate"}
SPREADS = {"SPY": 0.32, "QQQ": 0.5, "IWM": 0.6, "TLT": 4.0, "HYG": 5.5, "GLD": 5.0, "DBC": 8.0, "EEM": 2.5, "FXI": 3.5, "VNQ": 3.0}
LIMITS = {"max_weight": 0.40, "sector": 0.60, "net": 0.20, "least": 0.01, "delever": 0.25, "kill": 0.65, "kill_exposure": 0.30}
HORIZONS = ("1d", "7d", "30d", "90d")


def _lookup(c: str, table: dict, default) -> Column:
    return F.coalesce(*[F.when(F.col(c) == k, F.lit(v)) for k, v in table.items()], F.lit(default))


def constrain(positions: DataFrame, scale: float = 1.0, limits: dict[str, float] | None = None) -> DataFrame:
    """positions(dt, asset, w, p_stress) after, in this order: the cap per asset (lower under
    stress), dropping small weights, the sector cap, the net cap, the kill switch and the L1
    scale.  Windows per date, and per date and sector; nothing is clipped again after scaling."""
    c = LIMITS | (limits or {})
    cap = c["max_weight"] * (1 - c["delever"] * F.col("p_stress"))
    x = positions.withColumn("w", F.greatest(-cap, F.least(cap, F.col("w")))).where(F.abs("w") >= c["least"])
    sector = _lookup("asset", SECTORS, "other")
    gross = F.sum(F.abs("w")).over(Window.partitionBy("dt", "sector"))
    x = x.withColumn("sector", sector).withColumn("w", F.when((F.col("sector") != "other") & (gross > c["sector"]), F.col("w") * c["sector"] / gross).otherwise(F.col("w")))
    day = Window.partitionBy("dt")
    x = x.withColumn("net", F.sum("w").over(day))
    side = F.signum("w") == F.signum("net")
    total = F.sum(F.when(side, F.abs("w")).otherwise(0.0)).over(day)
    over = (F.abs("net") > c["net"]) & side & (total > 1e-6)
    x = x.withColumn("w", F.when(over, F.col("w") * (1 - (F.abs("net") - c["net"]) / total)).otherwise(F.col("w")))
    severity = (F.col("p_stress") - c["kill"]) / (1 - c["kill"] + 1e-8)
    target = F.when(F.col("p_stress") > c["kill"], F.least(F.lit(scale), c["kill_exposure"] * (1 - 0.5 * severity))).otherwise(F.lit(scale))
    l1 = F.sum(F.abs("w")).over(day)
    return x.select("dt", "asset", F.when(l1 > 1e-6, F.col("w") / l1 * target).otherwise(F.col("w")).alias("w"))


def trades(held: DataFrame, target: DataFrame, p_stress: Column, least: float = 0.005, capital: float = 100_000.0) -> DataFrame:
    """Orders from held to target weights (dt, asset, w) over the union of their assets."""
    d = difference(held, target, ["dt", "asset"], "w").where(F.abs("change") >= least)
    cost = _lookup("asset", SPREADS, 5.0) / 2 * (1 + 2 * p_stress)
    fill = F.col("change") * F.when(F.col("change") > 0, 1 - _lookup("asset", SPREADS, 5.0) / 2e4).otherwise(1 + _lookup("asset", SPREADS, 5.0) / 2e4)
    return d.select("dt", "asset", F.when(F.col("change") > 0, "BUY").otherwise("SELL").alias("side"), "change", (F.abs("change") * capital).alias("notional"), cost.alias("cost_bps"), fill.alias("fill"))


def plans(orders: DataFrame) -> DataFrame:
    """Turnover, weighted cost and counts per date."""
    return orders.groupBy("dt").agg(
        F.sum(F.abs("change")).alias("turnover"),
        (F.sum(F.col("cost_bps") * F.abs("change")) / (F.sum(F.abs("change")) + 1e-8)).alias("cost_bps"),
        F.count(F.when(F.col("side") == "BUY", 1)).alias("n_buys"),
        F.count(F.when(F.col("side") == "SELL", 1)).alias("n_sells"),
    )


def drawdown_guard(pnl: DataFrame, limit: float = -0.05, floor: float = 0.25, window: int = 20) -> DataFrame:
    """Position scale per date from the drawdown inside the last ``window`` profits.  The peak is
    taken within the frame, so the frame's rows are folded in order."""
    w = Window.partitionBy("formula_id").orderBy("dt").rowsBetween(-(window - 1), 0)
    zero = F.struct(F.lit(0.0).alias("cum"), F.lit(-1e300).alias("peak"), F.lit(0.0).alias("dd"))

    def step(a, x):
        cum = a["cum"] + x
        peak = F.greatest(a["peak"], cum)
        return F.struct(cum.alias("cum"), peak.alias("peak"), F.least(a["dd"], cum - peak).alias("dd"))

    d = pnl.select("formula_id", "dt", "pnl", F.aggregate(F.collect_list("pnl").over(w), zero, step)["dd"].alias("drawdown"))
    severity = F.least(F.abs("drawdown") / abs(limit), F.lit(2.0))
    return d.withColumn("scale", F.when(F.col("drawdown") >= limit, 1.0).otherwise(F.greatest(F.lit(floor), 1 - 0.5 * severity)))


def tracker(pnl: DataFrame, window: int = 20) -> DataFrame:
    """Rolling Sharpe, mean and hit rate over the last rows, and the retrain latch: it fires
    once when the Sharpe of a full window falls below -0.5, and again only after a recovery."""
    w = Window.partitionBy("formula_id").orderBy("dt").rowsBetween(-(window - 1), 0)
    s = F.avg("pnl").over(w) / (F.stddev_pop("pnl").over(w) + 1e-8) * F.sqrt(F.lit(252.0))
    x = pnl.select("formula_id", "dt", "pnl", s.alias("sharpe"), F.avg((F.col("pnl") > 0).cast("double")).over(w).alias("hit_rate"), F.count("pnl").over(w).alias("n"))
    bad = (F.col("n") == window) & (F.col("sharpe") < -0.5)
    return x.withColumn("retrain", bad & ~F.coalesce(F.lag(bad).over(Window.partitionBy("formula_id").orderBy("dt")), F.lit(False)))


def late_labels(labels: DataFrame, steps: int = 5) -> DataFrame:
    """The label that comes true ``steps`` dates later, and the share of dates on which the label
    did not change."""
    return labels.select("dt", "regime", F.lead("regime", steps).over(Window.orderBy("dt")).alias("actual"))


def brier(predictions: DataFrame) -> DataFrame:
    """Calibration of probabilities against outcomes, per decile of the prediction."""
    b = F.least(F.floor(F.col("p") * 10), F.lit(9)).cast("int")
    return predictions.groupBy(b.alias("decile")).agg(F.avg(F.pow(F.col("p") - F.col("outcome"), F.lit(2))).alias("brier"), F.avg("p").alias("p"), F.avg("outcome").alias("outcome"), F.count("*").alias("n"))


def capital_engine(pnl: DataFrame, capital: float = 100_000.0, every: int = 5, window: int = 60, alpha: float = 0.2, least: float = 0.05) -> DataFrame:
    """pnl(signal, dt, horizon, ret) -> the capital of each horizon's bucket per signal and date.
    Buckets compound; every few days softmax of their Sharpe, an exponential mean with the weights
    before, and a floor deal the capital anew.  One fold per signal over its dates."""

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        import numpy as np

        t = pdf.pivot_table(index="dt", columns="horizon", values="ret", aggfunc="sum").reindex(columns=HORIZONS).fillna(0.0).sort_index()
        bucket, weight = np.full(len(HORIZONS), capital / len(HORIZONS)), np.full(len(HORIZONS), 1 / len(HORIZONS))
        out = []
        for day, (dt, r) in enumerate(zip(t.index, t.to_numpy(), strict=True), 1):
            bucket = bucket * (1 + r)
            if day % every == 0:
                h = t.to_numpy()[max(0, day - window) : day]
                s = h.mean(axis=0) / (h.std(axis=0) + 1e-9) * np.sqrt(252) if day >= 5 else np.zeros(len(HORIZONS))
                e = np.exp(s - s.max())
                weight = np.maximum(alpha * e / e.sum() + (1 - alpha) * weight, least)
                weight = weight / weight.sum()
                bucket = bucket.sum() * weight
            out += [(pdf.signal.iloc[0], dt, h, float(b), float(b / bucket.sum())) for h, b in zip(HORIZONS, bucket, strict=True)]
        return pd.DataFrame(out, columns=["signal", "dt", "horizon", "capital", "weight"])

    return pnl.groupBy("signal").applyInPandas(fold, "signal string, dt date, horizon string, capital double, weight double")


def backtest(positions: DataFrame, returns: DataFrame, pnl_limit: float = -0.05) -> DataFrame:
    """The daily loop over constrained positions: yesterday's holdings earn today's return; the
    guard scales tomorrow's holdings.  Portfolio-level: the cross-section is summed before the
    fold, which sees one row per date."""
    order = Window.partitionBy("asset").orderBy("dt")
    held = positions.withColumn("held", F.lag("w").over(order))
    d = held.join(returns, ["dt", "asset"]).groupBy("dt").agg(F.sum(F.coalesce(F.col("held") * F.col("ret"), F.lit(0.0))).alias("raw"), F.sum(F.abs(F.col("w") - F.coalesce("held", F.lit(0.0)))).alias("turnover"))

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, scale, recent, out = pdf.sort_values("dt"), 1.0, [], []
        for dt, raw, turn in zip(pdf.dt, pdf.raw, pdf.turnover, strict=True):
            pnl = raw * scale
            recent = [*recent, pnl][-20:]
            cum = peak = dd = 0.0
            for i, x in enumerate(recent):
                cum += x
                peak = cum if i == 0 else max(peak, cum)
                dd = min(dd, cum - peak)
            out.append((dt, pnl, scale, turn))
            scale = 1.0 if dd >= pnl_limit else max(0.25, 1 - 0.5 * min(abs(dd) / abs(pnl_limit), 2.0))
        return pd.DataFrame(out, columns=["dt", "pnl", "scale", "turnover"])

    return d.groupBy(F.lit(1).alias("portfolio")).applyInPandas(lambda pdf: fold(pdf.drop(columns="portfolio", errors="ignore")), "dt date, pnl double, scale double, turnover double")
