"""The 38 features of a panel, by name.

A feature is a column builder over the panel, of one of three kinds: over an asset's own rows,
over the cross-section of a date, or a series with one value per date.  ``features`` puts all
own-row windows of the wanted names into one select (one sort, one exchange), then the
cross-section, and joins the date-level series by broadcast; what is not asked for is pruned.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelforge.sources.panel import own_rows, cross_section, date_order, by_asset, dates, gated, with_returns

YEAR = 252


def momentum(w: int) -> Column:
    return F.try_divide("px", F.lag("px", w).over(own_rows())) - 1


def volatility(w: int) -> Column:
    return gated(F.stddev_samp("ret"), F.col("ret"), by_asset(w), w) * F.sqrt(F.lit(float(YEAR)))


def zscore(w: int) -> Column:
    mean, std = (gated(f("ret"), F.col("ret"), by_asset(w), w) for f in (F.avg, F.stddev_samp))
    return F.try_divide(F.col("ret") - mean, F.nullif(std, F.lit(0.0)))


def skew(w: int) -> Column:
    """Sample skewness: the population's, corrected for bias."""
    return gated(F.skewness("ret"), F.col("ret"), by_asset(w), w) * ((w * (w - 1)) ** 0.5 / (w - 2))


def moment_corr(x: Column, y: Column, frame, w: int) -> Column:
    """Pearson correlation from moments; null where a side does not vary."""
    both = F.when(x.isNotNull() & y.isNotNull(), F.lit(1))
    mean = lambda c: F.avg(F.when(both.isNotNull(), c)).over(frame)
    cov = mean(x * y) - mean(x) * mean(y)
    var = lambda c: mean(c * c) - mean(c) * mean(c)
    r = F.try_divide(cov, F.nullif(F.sqrt(F.greatest(var(x), F.lit(0.0)) * F.greatest(var(y), F.lit(0.0))), F.lit(0.0)))
    return F.when(F.count(both).over(frame) == w, r)


def rsi(w: int) -> Column:
    up, down = (gated(F.avg(F.when(F.col("diff").isNotNull(), F.greatest(s * F.col("diff"), F.lit(0.0)))), F.col("diff"), by_asset(w), w) for s in (1, -1))
    return 100 - F.try_divide(F.lit(100.0), 1 + F.try_divide(up, F.nullif(down, F.lit(0.0))))


#: Features over an asset's own rows.  ``mkt`` is the mean return of the date.
OWN: dict[str, Callable[[], Column]] = {
    **{f"momentum_{w}d": lambda w=w: momentum(w) for w in (5, 10, 20, 60)},
    **{f"volatility_{w}d": lambda w=w: volatility(w) for w in (10, 20, 60)},
    **{f"zscore_{w}d": lambda w=w: zscore(w) for w in (20, 60)},
    **{f"reversal_{w}d": lambda w=w: -momentum(w) for w in (3, 5, 10)},
    **{f"skew_{w}d": lambda w=w: skew(w) for w in (20, 60)},
    **{f"market_corr_{w}d": lambda w=w: moment_corr(F.col("ret"), F.col("mkt"), by_asset(w), w) for w in (20, 60)},
    **{f"rsi_{w}": lambda w=w: rsi(w) for w in (14, 7)},
    "price_accel": lambda: momentum(5) - momentum(20),
    "vol_ratio": lambda: F.try_divide(volatility(10), F.nullif(volatility(60), F.lit(0.0))),
    "mean_rev_score": lambda: ((rsi(14) - 50) / 50 + zscore(20)) / 2,
    "above_ma200": lambda: F.coalesce((F.col("px") > gated(F.avg("px"), F.col("px"), by_asset(200), 200)).cast("double"), F.lit(0.0)),
}

#: Features of the cross-section of a date, with the own-row columns that they need.
ACROSS: dict[str, tuple[tuple[str, ...], Callable[[], Column]]] = {
    "cross_momentum": (("momentum_20d",), lambda: F.col("momentum_20d") - F.avg("momentum_20d").over(cross_section())),
    "relative_vol": (("volatility_20d",), lambda: F.try_divide("volatility_20d", F.nullif(F.avg("volatility_20d").over(cross_section()), F.lit(0.0)))),
    "regime_signal": (("momentum_10d",), lambda: F.avg("momentum_10d").over(cross_section())),
}


def log_ratio_change(a: str, b: str, n: int = 20, sign: int = 1) -> Column:
    """Change over ``n`` dates of ln(px_a / px_b), 0 where there is none."""
    r = F.ln(F.try_divide(f"px_{a}", f"px_{b}"))
    return sign * F.coalesce(r - F.lag(r, n).over(date_order()), F.lit(0.0))


def _vol_regime() -> Column:
    mean, std = (gated(f("avg_vol"), F.col("avg_vol"), dates(YEAR), YEAR) for f in (F.avg, F.stddev_samp))
    return F.coalesce(F.try_divide(F.col("avg_vol") - mean, F.nullif(std, F.lit(0.0))), F.lit(0.0))


def _change(name: str, n: int) -> Column:
    return F.coalesce(F.col(name) - F.lag(name, n).over(date_order()), F.lit(0.0))


#: Date-level features, with the tickers that they need.
SERIES: dict[str, tuple[tuple[str, ...], Callable[[], Column]]] = {
    "risk_on_off": (("SPY", "TLT"), lambda: log_ratio_change("SPY", "TLT")),
    "commodity_inflation": (("DBC", "GLD"), lambda: log_ratio_change("DBC", "GLD")),
    "em_vs_dm": (("EEM", "SPY"), lambda: log_ratio_change("EEM", "SPY")),
    "eem_spy_20d": (("EEM", "SPY"), lambda: log_ratio_change("EEM", "SPY")),
    "credit_stress": (("HYG", "TLT"), lambda: log_ratio_change("HYG", "TLT")),
    "dollar_proxy": (("EEM", "GLD"), lambda: log_ratio_change("EEM", "GLD", sign=-1)),
    "iwm_spy_20d": (("IWM", "SPY"), lambda: log_ratio_change("IWM", "SPY")),
    "equity_bond_corr": (("SPY", "TLT"), lambda: F.coalesce(moment_corr(F.col("ret_SPY"), F.col("ret_TLT"), dates(60), 60), F.lit(0.0))),
    "cross_asset_vol": ((), lambda: F.coalesce("avg_vol", F.lit(0.0))),
    "vol_regime": ((), _vol_regime),
    "trend_strength": ((), lambda: F.col("breadth")),
    "carry_proxy": (("HYG",), lambda: F.coalesce(F.try_divide("px_HYG", F.lag("px_HYG", 20).over(date_order())) - 1, F.lit(0.0))),
    "stress_accel_5d": ((), lambda: _change("vol_regime", 5)),
    "stress_accel_20d": ((), lambda: _change("vol_regime", 20)),
}

NAMES = tuple(n for n in (*OWN, *ACROSS, *SERIES) if n != "above_ma200")
_CUSTOM: dict[str, Callable[[], Column]] = {}


def register_feature(name: str, build: Callable[[], Column]) -> None:
    """A further feature over an asset's own rows."""
    _CUSTOM[name] = build


def base(panel: DataFrame) -> DataFrame:
    """The panel with returns and the date's mean return."""
    return with_returns(panel).withColumn("mkt", F.avg("ret").over(cross_section()))


def date_level(panel: DataFrame, names: Iterable[str], tickers: Iterable[str]) -> DataFrame:
    """One row per date with the wanted series; those whose tickers are missing are left out."""
    have = set(tickers)
    want = [n for n in names if n in SERIES and set(SERIES[n][0]) <= have]
    need = sorted({t for n in want for t in SERIES[n][0]})
    own = base(panel).select("dt", "asset", "px", "ret", volatility(20).alias("vol"), OWN["above_ma200"]().alias("up"))
    aggs = [F.avg("vol").alias("avg_vol"), F.avg("up").alias("breadth")]
    for t in need:
        aggs += [F.max(F.when(F.col("asset") == t, F.col(c))).alias(f"{c}_{t}") for c in ("px", "ret")]
    d = own.groupBy("dt").agg(*aggs)
    first = [n for n in want if not n.startswith("stress_accel")]
    d = d.select("*", *[SERIES[n][1]().alias(n) for n in dict.fromkeys([*first, *(["vol_regime"] if len(first) < len(want) else [])])])
    return d.select("dt", *[F.col(n) if n in first else SERIES[n][1]().alias(n) for n in want])


def features(panel: DataFrame, names: Iterable[str], tickers: Iterable[str]) -> DataFrame:
    """The panel's rows with dt, asset, asset_ord, px, ret, rn and the wanted features; unknown
    names, and those whose tickers are missing, are left out."""
    names = list(dict.fromkeys(names))
    own = [n for n in names if n in OWN or n in _CUSTOM]
    across = [n for n in names if n in ACROSS]
    need = dict.fromkeys([*own, *(c for n in across for c in ACROSS[n][0])])
    f = base(panel).select("dt", "asset", "asset_ord", "px", "ret", "rn", "mkt", *[(OWN.get(n) or _CUSTOM[n])().alias(n) for n in need])
    f = f.select("dt", "asset", "asset_ord", "px", "ret", "rn", *own, *[ACROSS[n][1]().alias(n) for n in across])
    series = [n for n in names if n in SERIES and set(SERIES[n][0]) <= set(tickers)]
    if series:
        f = f.join(F.broadcast(date_level(panel, series, tickers)), "dt")
    return f.select("dt", "asset", "asset_ord", "px", "ret", "rn", *[n for n in names if n in own or n in across or n in series])


def _feature_sql() -> str:
    """DuckDB: ``f`` has all features, after the panel's expressions."""
    w = lambda n: f"(PARTITION BY asset ORDER BY dt ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    d = lambda n: f"(ORDER BY dt ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    gate = lambda agg, c, n, o: f"CASE WHEN count({c}) OVER {o} = {n} THEN {agg} OVER {o} END"
    mom = lambda n: f"px / lag(px, {n}) OVER (PARTITION BY asset ORDER BY dt) - 1"

    def corr(x: str, y: str, n: int, o: str) -> str:
        a = lambda e: f"avg({e}) OVER {o}"
        return (
            f"CASE WHEN count({x} * {y}) OVER {o} = {n} THEN ({a(f'{x} * {y}')} - {a(x)} * {a(y)}) / nullif(sqrt(greatest({a(f'{x} * {x}')} - {a(x)} * {a(x)}, 0)"
            f" * greatest({a(f'{y} * {y}')} - {a(y)} * {a(y)}, 0)), 0) END"
        )

    own = [f"{mom(n)} AS momentum_{n}d" for n in (5, 10, 20, 60)] + [f"-({mom(n)}) AS reversal_{n}d" for n in (3, 5, 10)]
    own += [f"({gate('stddev_samp(ret)', 'ret', n, w(n))}) * sqrt(252.0) AS volatility_{n}d" for n in (10, 20, 60)]
    own += [f"(ret - {gate('avg(ret)', 'ret', n, w(n))}) / nullif({gate('stddev_samp(ret)', 'ret', n, w(n))}, 0) AS zscore_{n}d" for n in (20, 60)]
    own += [f"{gate('skewness(ret)', 'ret', n, w(n))} AS skew_{n}d" for n in (20, 60)]
    own += [f"{corr('ret', 'mkt', n, w(n))} AS market_corr_{n}d" for n in (20, 60)]
    for n in (14, 7):
        up, dn = (gate(f"avg(CASE WHEN diff IS NOT NULL THEN greatest({s}diff, 0) END)", "diff", n, w(n)) for s in ("", "-"))
        own.append(f"100 - 100 / (1 + ({up}) / nullif({dn}, 0)) AS rsi_{n}")
    own.append(f"coalesce((px > {gate('avg(px)', 'px', 200, w(200))})::INT::DOUBLE, 0) AS above_ma200")
    pick = ", ".join(f"max(px) FILTER (asset = '{t}') AS px_{t}, max(ret) FILTER (asset = '{t}') AS ret_{t}" for t in ("SPY", "TLT", "HYG", "EEM", "GLD", "DBC", "IWM"))

    def ratio(a: str, b: str, s: str = "") -> str:
        return f"{s}coalesce(ln(px_{a} / px_{b}) - lag(ln(px_{a} / px_{b}), 20) OVER (ORDER BY dt), 0)"

    series = [f"{ratio(a, b, s)} AS {n}" for n, a, b, s in (("risk_on_off", "SPY", "TLT", ""), ("commodity_inflation", "DBC", "GLD", ""), ("em_vs_dm", "EEM", "SPY", ""), ("eem_spy_20d", "EEM", "SPY", ""), ("credit_stress", "HYG", "TLT", ""), ("dollar_proxy", "EEM", "GLD", "-"), ("iwm_spy_20d", "IWM", "SPY", ""))]
    series += [f"coalesce({corr('ret_SPY', 'ret_TLT', 60, d(60))}, 0) AS equity_bond_corr", "coalesce(avg_vol, 0) AS cross_asset_vol", "breadth AS trend_strength", "coalesce(px_HYG / lag(px_HYG, 20) OVER (ORDER BY dt) - 1, 0) AS carry_proxy"]
    series += [f"coalesce((avg_vol - {gate('avg(avg_vol)', 'avg_vol', 252, d(252))}) / nullif({gate('stddev_samp(avg_vol)', 'avg_vol', 252, d(252))}, 0), 0) AS vol_regime"]
    acc = ", ".join(f"coalesce(vol_regime - lag(vol_regime, {n}) OVER (ORDER BY dt), 0) AS stress_accel_{n}d" for n in (5, 20))
    return f"""m AS (SELECT *, avg(ret) OVER (PARTITION BY dt) AS mkt FROM p),
o AS (SELECT dt, asset, asset_ord, px, ret, rn, diff, {', '.join(own)} FROM m),
dl AS (SELECT dt, avg(volatility_20d) AS avg_vol, avg(above_ma200) AS breadth, {pick} FROM o GROUP BY dt),
fs1 AS (SELECT dt, {', '.join(series)} FROM dl),
s AS (SELECT *, {acc} FROM fs1),
f AS (SELECT o.*, momentum_5d - momentum_20d AS price_accel, volatility_10d / nullif(volatility_60d, 0) AS vol_ratio, ((rsi_14 - 50) / 50 + zscore_20d) / 2 AS mean_rev_score,
  momentum_20d - avg(momentum_20d) OVER (PARTITION BY dt) AS cross_momentum, volatility_20d / nullif(avg(volatility_20d) OVER (PARTITION BY dt), 0) AS relative_vol,
  avg(momentum_10d) OVER (PARTITION BY dt) AS regime_signal, s.* EXCLUDE (dt) FROM o JOIN s USING (dt))"""


FEATURE_SQL = _feature_sql()
