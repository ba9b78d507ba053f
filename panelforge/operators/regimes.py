"""Regime labels, policy readings and scenario probabilities: series with one row per date."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelforge.operators.features import date_level
from panelforge.sources.panel import date_order, dates, with_returns

#: The scenario mapping (factor weights).
SCENARIOS = {
    "equity_crash_30pct": {"p_stress": 0.5, "credit_tightening": 0.3, "breadth_narrowing": 0.2},
    "rates_up_200bps": {"rate_rising": 0.6, "p_not_calm": 0.25, "inflation_rising": 0.15},
    "rates_down_100bps": {"rate_falling": 0.55, "p_calm_normal": 0.3, "credit_easing": 0.15},
    "oil_spike_50pct": {"inflation_rising": 0.5, "p_stress_normal": 0.3, "dollar_weak": 0.2},
    "china_crisis": {"p_stress": 0.4, "dollar_strong": 0.35, "breadth_narrowing": 0.25},
    "soft_landing": {"p_calm": 0.4, "breadth_broadening": 0.3, "credit_easing": 0.2, "rate_falling": 0.1},
    "stagflation": {"p_stress": 0.4, "inflation_rising": 0.35, "rate_rising": 0.25},
    "ai_boom": {"p_calm": 0.4, "breadth_broadening": 0.3, "rate_falling": 0.2, "dollar_weak": 0.1},
}


def wide(panel: DataFrame, tickers: Iterable[str]) -> DataFrame:
    """One row per date with px_<ticker>."""
    return panel.groupBy("dt").agg(*[F.max(F.when(F.col("asset") == t, F.col("px"))).alias(f"px_{t}") for t in tickers])


def regime_labels(panel: DataFrame, tickers: Iterable[str]) -> DataFrame:
    """calm, normal or stress; stress wins where both would hold."""
    d = date_level(panel, ["vol_regime", "risk_on_off", "trend_strength"], tickers)
    stress = (F.col("vol_regime") > 0.5) | (F.col("risk_on_off") < -0.3)
    calm = (F.col("vol_regime") < -0.5) & (F.col("trend_strength") > 0.6)
    return d.select("dt", F.when(stress, "stress").when(calm, "calm").otherwise("normal").alias("regime"))


def event_labels(panel: DataFrame, window: int = 252, backfill: bool = False) -> DataFrame:
    """Five event regimes from rolling percentiles; later rules win.  ``backfill`` lets the first
    percentiles also judge the dates before them (it looks ahead; off by default)."""
    w = wide(panel, ("SPY", "TLT", "HYG", "EEM", "DBC", "IWM"))
    change = lambda c, n: c - F.lag(c, n).over(date_order())
    log = lambda t: F.ln(f"px_{t}")
    w = w.select("dt", change(log("DBC") - log("TLT"), 20).alias("dbc"), change(log("HYG") - log("TLT"), 10).alias("hyg"), change(log("IWM") - log("SPY"), 20).alias("iwm"), change(log("EEM") - log("SPY"), 20).alias("eem"), change(log("TLT"), 20).alias("tlt"))
    cuts = (("dbc", 0.75), ("dbc", 0.80), ("hyg", 0.25), ("iwm", 0.15), ("eem", 0.25))
    q = {(c, p): F.when(F.count(c).over(dates(window)) == window, F.percentile(c, F.lit(p)).over(dates(window))) for c, p in cuts}
    w = w.select("*", *[v.alias(f"{c}_{int(p * 100)}") for (c, p), v in q.items()])
    if backfill:
        ahead = date_order().rowsBetween(0, Window.unboundedFollowing)
        w = w.select("dt", "dbc", "hyg", "iwm", "eem", "tlt", *[F.coalesce(F.col(f"{c}_{int(p * 100)}"), F.first(f"{c}_{int(p * 100)}", ignorenulls=True).over(ahead)).alias(f"{c}_{int(p * 100)}") for c, p in cuts])
    c = F.col
    label = (
        F.when((c("dbc") > c("dbc_80")) & (c("eem") < c("eem_25")), "geopolitical")
        .when((c("iwm") < c("iwm_15")) & (c("tlt") > 0.03), "growth_collapse")
        .when((c("hyg") < c("hyg_25")) & (c("iwm") < -0.03), "liquidity_crisis")
        .when(c("dbc") > c("dbc_75"), "inflation_shock")
        .otherwise("normal")
    )
    return w.select("dt", label.alias("event"))


def market_labels(panel: DataFrame, window: int = 252) -> DataFrame:
    """bull, bear or crisis by the trailing year of the mean return."""
    m = with_returns(panel).groupBy("dt").agg(F.avg("ret").alias("m"))
    full = F.count("m").over(dates(window)) == window
    mean, std = F.when(full, F.avg("m").over(dates(window))) * 252, F.when(full, F.stddev_samp("m").over(dates(window))) * F.sqrt(F.lit(252.0))
    return m.select("dt", F.when(std > 0.30, "crisis").when(mean < -0.05, "bear").otherwise("bull").alias("market"))


def policy(panel: DataFrame, tickers: Iterable[str]) -> DataFrame:
    """Five macro readings per date, filled forward."""
    w = wide(panel, ("TLT", "DBC", "GLD", "HYG", "EEM")).join(date_level(panel, ["trend_strength"], tickers), "dt")
    change = lambda x, n: x - F.lag(x, n).over(date_order())
    r = lambda a, b: F.ln(F.try_divide(f"px_{a}", f"px_{b}"))
    cols = {
        "rate_env": change(F.ln("px_TLT"), 20),
        "inflation": change(r("DBC", "GLD"), 20),
        "liquidity": change(r("HYG", "TLT"), 20),
        "dollar": -change(r("EEM", "GLD"), 20),
        "breadth": change(F.col("trend_strength"), 10),
    }
    p = w.select("dt", *[v.alias(k) for k, v in cols.items()])
    return p.select("dt", *[F.last(k, ignorenulls=True).over(dates()).alias(k) for k in cols])


def policy_states(p: DataFrame) -> DataFrame:
    """One word per reading, at thresholds of one per cent."""
    word = lambda c, up, down: F.when(F.col(c) > 0.01, up).when(F.col(c) < -0.01, down).otherwise("flat").alias(c)
    return p.select("dt", word("rate_env", "falling", "rising"), word("inflation", "rising", "falling"), word("liquidity", "easing", "tightening"), word("dollar", "strong", "weak"), word("breadth", "broadening", "narrowing"))


def regime_shares(labels: DataFrame, window: int = 20) -> DataFrame:
    """Share of each label among the last dates: a simple estimate of regime probabilities."""
    share = lambda x: F.avg((F.col("regime") == x).cast("double")).over(dates(window)).alias(x)
    return labels.select("dt", share("calm"), share("normal"), share("stress"))


def scenario_probabilities(p: DataFrame, shares: DataFrame) -> DataFrame:
    """(dt, scenario, p): weighted factors, floored at 0.01 and normalised.  The mapping is a
    table of literals, exploded per date."""
    x = p.join(shares, "dt")
    pos = lambda c: F.least(F.greatest(F.coalesce(c, F.lit(0.0)), F.lit(0.0)), F.lit(1.0))
    c = F.col
    factors = {
        "p_stress": c("stress"),
        "p_calm": c("calm"),
        "p_not_calm": 1 - c("calm"),
        "p_calm_normal": c("calm") + c("normal"),
        "p_stress_normal": c("stress") + c("normal"),
        "rate_rising": -c("rate_env") / 0.05,
        "rate_falling": c("rate_env") / 0.05,
        "inflation_rising": c("inflation") / 0.05,
        "credit_tightening": -c("liquidity") / 0.03,
        "credit_easing": c("liquidity") / 0.03,
        "dollar_strong": c("dollar") / 0.05,
        "dollar_weak": -c("dollar") / 0.05,
        "breadth_broadening": c("breadth") / 0.05,
        "breadth_narrowing": -c("breadth") / 0.05,
    }
    raw = [F.struct(F.lit(s).alias("scenario"), (sum((F.lit(w) * pos(factors[k]) for k, w in m.items()), F.lit(0.0)) + 0.01).alias("v")) for s, m in SCENARIOS.items()]
    x = x.select("dt", F.array(*raw).alias("raw"))
    total = F.aggregate("raw", F.lit(0.0), lambda a, y: a + y["v"])
    return x.select("dt", total.alias("total"), F.explode("raw").alias("r")).select("dt", "r.scenario", F.round(F.col("r.v") / F.col("total"), 4).alias("p"))


def confidence(shares: DataFrame, scenarios: DataFrame) -> DataFrame:
    """Certainty of the regime (1 - entropy), neutral stability, and spread of the scenarios;
    with the position scale that belongs to it."""
    ent = -sum((F.when(F.col(k) > 0, F.col(k) * F.ln(k)).otherwise(0.0) for k in ("calm", "normal", "stress")), F.lit(0.0)) / F.ln(F.lit(3.0))
    hhi = scenarios.groupBy("dt").agg(F.sum(F.col("p") * F.col("p")).alias("hhi"))
    x = shares.join(hhi, "dt")
    spread = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (1 - F.col("hhi")) / 0.875))
    x = x.select("dt", (0.5 * (1 - ent) + 0.3 * 0.5 + 0.2 * spread).alias("confidence"))
    level = F.when(F.col("confidence") > 0.70, "HIGH").when(F.col("confidence") > 0.45, "MEDIUM").otherwise("LOW")
    return x.withColumn("level", level).withColumn("scale", F.when(F.col("level") == "HIGH", 1.0).when(F.col("level") == "MEDIUM", 0.75).otherwise(0.5))


def by_regime(ic: DataFrame, labels: DataFrame) -> DataFrame:
    """Mean IC of each formula in each regime, and its lowest."""
    g = ic.join(F.broadcast(labels), "dt").groupBy("formula_id").pivot("regime", ["calm", "normal", "stress"]).agg(F.avg("ic"))
    return g.withColumn("worst", F.least("calm", "normal", "stress"))


def walk_forward(ic: DataFrame, n_train: int, n_test: int, step: int) -> DataFrame:
    """Mean IC of each formula in the train and test part of every window; windows are ranges of
    date numbers, joined as ranges to the (date-level) facts in one job."""
    d = ic.select("dt").distinct().withColumn("i", F.row_number().over(date_order()) - 1)
    total = d.agg(F.max("i").alias("m"))
    starts = total.select(F.explode(F.sequence(F.lit(0), F.greatest(F.col("m") + 1 - n_train - n_test, F.lit(0)), F.lit(step))).alias("t0"))
    x = ic.join(F.broadcast(d), "dt").where("ic is not null")
    j = x.join(F.broadcast(starts), (F.col("i") >= F.col("t0")) & (F.col("i") < F.col("t0") + n_train + n_test))
    train = F.col("i") < F.col("t0") + n_train
    return j.groupBy("formula_id", (F.col("t0") / step).cast("int").alias("window")).agg(F.avg(F.when(train, F.col("ic"))).alias("train_ic"), F.avg(F.when(~train, F.col("ic"))).alias("test_ic"), F.count(F.when(~train, 1)).alias("n_test"))


def verdicts(windows: DataFrame, least_ic: float = 0.01, least_pass: float = 0.5, most_std: float = 0.2) -> DataFrame:
    """Per formula whether its windows pass, with the reasons where not."""
    g = windows.groupBy("formula_id").agg(F.avg("test_ic").alias("mean_ic"), F.avg((F.col("test_ic") > 0).cast("double")).alias("pass_rate"), F.coalesce(F.stddev_pop("test_ic"), F.lit(0.0)).alias("spread"))
    why = F.array_compact(F.array(F.when(F.col("mean_ic") < least_ic, F.lit("ic")), F.when(F.col("pass_rate") < least_pass, F.lit("pass_rate")), F.when(F.col("spread") > most_std, F.lit("stability"))))
    return g.select("formula_id", "mean_ic", "pass_rate", "spread", F.array_join(why, ",").alias("reasons"), (F.size(why) == 0).alias("passes"))

