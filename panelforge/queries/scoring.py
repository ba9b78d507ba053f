"""Queries over formulas and their scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelforge.operators import scoring as S
from panelforge.operators.features import FEATURE_SQL, NAMES, features
from panelforge.plans.formula import encode, evaluate, linear_signals, parse, signals
from panelforge.sources.panel import TICKERS, lineitem_panel, lineitem_sql

PRE = f"WITH {lineitem_sql()}, {FEATURE_SQL}"
LINEAR = {"mom": "momentum_20d", "rev": "reversal_5d", "spread": "momentum_20d - volatility_20d", "mix": "zscore_20d + price_accel - rsi_14"}
EXACT = {"flagship": "rank(momentum_20d) - rank(volatility_20d)", "trend": "rank(decay(momentum_5d, halflife=5))", "cross": "zscore(cross_momentum)"}


def panel(spark, d):
    return lineitem_panel(spark, d).cache()


def _features(spark, d, formulas):
    p = lineitem_panel(spark, d)
    names = sorted(set().union(*(parse(f).features() for f in formulas.values())))
    return p, features(p, names, TICKERS)


def linear(spark, d):
    p, f = _features(spark, d, LINEAR)
    return p, linear_signals(f, LINEAR, NAMES)


def exact(spark, d):
    p, f = _features(spark, d, EXACT)
    return p, signals(f, EXACT)


def rounded(df, digits=6):
    """Doubles to so many digits by way of the product, as the oracle rounds them: halves that only
    the decimal text has would go the other way."""
    return df.select(*[(F.round(F.col(c) * 10.0**digits) / 10.0**digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


# ---- DuckDB pieces ---------------------------------------------------------------------------
def _rank_sql(x: str, keys: str) -> str:
    """Average rank of the rounded value."""
    return f"(rank() OVER (PARTITION BY {keys} ORDER BY round({x}, 10) NULLS LAST) + (count({x}) OVER (PARTITION BY {keys}, round({x}, 10)) - 1) / 2.0)"


def _linear_sql() -> str:
    parts = []
    for k, f in LINEAR.items():
        e = " + ".join(f"({v!r}) * coalesce({n}, 0)" for n, v in encode(f, NAMES).items())
        parts.append(f"SELECT '{k}' AS formula_id, dt, asset, asset_ord, {e} AS val FROM f")
    return "sig AS (" + " UNION ALL ".join(parts) + ")"


PCT = lambda x: f"CASE WHEN {x} IS NOT NULL THEN {_rank_sql(x, 'dt')} / count({x}) OVER (PARTITION BY dt) END"
EMA = lambda x, h, part="asset": f"list_reduce(list({x}) FILTER ({x} IS NOT NULL) OVER (PARTITION BY {part} ORDER BY dt ROWS UNBOUNDED PRECEDING), lambda a, v: a * {2.0 ** (-1 / h)!r} + v * {1 - 2.0 ** (-1 / h)!r})"
EXACT_SQL = f"""e1 AS (SELECT dt, asset, asset_ord, {PCT('momentum_20d')} AS r1, {PCT('volatility_20d')} AS r2, {EMA('momentum_5d', 5)} AS d1,
  (cross_momentum - avg(cross_momentum) OVER (PARTITION BY dt)) / nullif(stddev_samp(cross_momentum) OVER (PARTITION BY dt), 0) AS z FROM f),
sig AS (SELECT 'flagship' AS formula_id, dt, asset, asset_ord, r1 - r2 AS val FROM e1 UNION ALL SELECT 'trend', dt, asset, asset_ord, {PCT('d1')} FROM e1
  UNION ALL SELECT 'cross', dt, asset, asset_ord, z FROM e1)"""
LINEAR_SQL = _linear_sql()


def _fwd(lead: int) -> str:
    return f"fwd AS (SELECT dt, asset, lead(ret, {lead}) OVER (PARTITION BY asset ORDER BY dt) AS fwd FROM p)"


def _pearson_sql(x: str, y: str, least: str = "1e-10") -> str:
    d = f"sqrt(greatest(avg({x} * {x}) - avg({x}) * avg({x}), 0) * greatest(avg({y} * {y}) - avg({y}) * avg({y}), 0))"
    return f"CASE WHEN {d} > {least} THEN (avg({x} * {y}) - avg({x}) * avg({y})) / {d} END"


def _ic_sql(lead: int = 1, least: int = 3) -> str:
    return f"""{_fwd(lead)},
j AS (SELECT formula_id, dt, {_rank_sql('val', 'formula_id, dt')} AS rv, {_rank_sql('fwd', 'formula_id, dt')} AS rf FROM sig JOIN fwd USING (dt, asset) WHERE val IS NOT NULL AND fwd IS NOT NULL),
ic AS (SELECT formula_id, dt, count(*) AS n, {_pearson_sql('rv', 'rf')} AS ic FROM j GROUP BY ALL HAVING count(*) >= {least})"""


SUMMARY_SQL = """SELECT formula_id, round(avg(ic), 6) AS mean_ic, round({std}(ic), 6) AS std_ic, round(avg((ic > 0)::INT), 6) AS positive, count(*) AS n,
  round(coalesce(avg(ic) / nullif({std}(ic), 0), 0), 6) AS ic_ir FROM ic WHERE ic IS NOT NULL GROUP BY formula_id"""
ORDINAL_SQL = f"""{_fwd(2)},
j AS (SELECT formula_id, dt, row_number() OVER (PARTITION BY formula_id, dt ORDER BY round(val, 10), asset_ord) AS rv, row_number() OVER (PARTITION BY formula_id, dt ORDER BY round(fwd, 10), asset_ord) AS rf
  FROM sig JOIN fwd USING (dt, asset) WHERE val IS NOT NULL AND fwd IS NOT NULL),
ic AS (SELECT formula_id, dt, count(*) AS n, {_pearson_sql('rv', 'rf')} AS ic FROM j GROUP BY ALL)"""


def _horizon_sql(horizons: dict[int, float], log: bool) -> str:
    rows = ", ".join(f"({h}, {w})" for h, w in horizons.items())
    leads = " ".join(f"WHEN {h} THEN lead(px, {h}) OVER (PARTITION BY horizon, asset ORDER BY dt)" for h in horizons)
    r = f"CASE horizon {leads} END / px"
    return f"""hz(horizon, weight) AS (VALUES {rows}), pf AS (SELECT dt, asset, horizon, weight, {f'ln({r})' if log else f'{r} - 1'} AS fwd FROM p CROSS JOIN hz),
j AS (SELECT formula_id, horizon, weight, dt, {_rank_sql('val', 'formula_id, horizon, dt')} AS rv, {_rank_sql('fwd', 'formula_id, horizon, dt')} AS rf FROM sig JOIN pf USING (dt, asset) WHERE val IS NOT NULL AND fwd IS NOT NULL),
ic AS (SELECT formula_id, horizon, weight, dt, coalesce({_pearson_sql('rv', 'rf')}, 0) AS ic FROM j GROUP BY ALL),
h AS (SELECT formula_id, horizon, any_value(weight) AS weight, avg(ic) AS mean_ic FROM ic GROUP BY formula_id, horizon)"""


W_SQL = f"""r0 AS (SELECT *, {_rank_sql('val', 'formula_id, dt')} AS r FROM sig), r1 AS (SELECT *, r - avg(r) OVER (PARTITION BY formula_id, dt) AS c FROM r0),
w AS (SELECT formula_id, dt, asset, asset_ord, c / (sum(abs(c)) OVER (PARTITION BY formula_id, dt) + 1e-8) AS w FROM r1)"""
PNL_SQL = f"{_fwd(2)}, pnl AS (SELECT formula_id, dt, sum(w * fwd) AS pnl FROM w JOIN fwd USING (dt, asset) WHERE fwd IS NOT NULL GROUP BY ALL)"
DD_SQL = """c1 AS (SELECT *, sum(pnl) OVER o AS cum, exp(sum(ln(greatest(1 + pnl, 1e-12))) OVER o) AS val, row_number() OVER (PARTITION BY formula_id ORDER BY dt DESC) AS rev FROM pnl WINDOW o AS (PARTITION BY formula_id ORDER BY dt ROWS UNBOUNDED PRECEDING)),
c2 AS (SELECT *, sum(pnl) FILTER (rev <= 20) OVER (PARTITION BY formula_id ORDER BY dt ROWS UNBOUNDED PRECEDING) AS cum20 FROM c1),
c3 AS (SELECT formula_id, cum - max(cum) OVER o AS a, val / max(val) OVER o AS b, cum20 - greatest(max(cum20) OVER o, 0) AS c FROM c2 WINDOW o AS (PARTITION BY formula_id ORDER BY dt ROWS UNBOUNDED PRECEDING)),
dd AS (SELECT formula_id, min(a) AS additive, min(b) - 1 AS relative, coalesce(min(c), 0) AS recent FROM c3 GROUP BY formula_id)"""
SHARPE = lambda x, s="stddev_pop": f"avg({x}) / ({s}({x}) + 1e-8) * sqrt(252.0)"


def _held_sql(weights: str, every: str) -> str:
    return f"""hw AS (SELECT formula_id, dt, asset, w, fwd, row_number() OVER (PARTITION BY formula_id, asset ORDER BY dt) - 1 AS i FROM {weights} JOIN fwd USING (dt, asset) WHERE fwd IS NOT NULL),
ev(horizon, every) AS (VALUES {every}),
hx AS (SELECT formula_id, horizon, dt, asset, fwd, last_value(CASE WHEN i % every = 0 THEN w END IGNORE NULLS) OVER (PARTITION BY formula_id, horizon, asset ORDER BY dt ROWS UNBOUNDED PRECEDING) AS held FROM hw CROSS JOIN ev),
hs AS (SELECT *, abs(held - coalesce(lag(held) OVER (PARTITION BY formula_id, horizon, asset ORDER BY dt), 0)) AS step FROM hx)"""


EVERY = ", ".join(f"({h}, {n})" for h, n in S.REBALANCE.items())
REB_SQL = f"""{_held_sql('w', EVERY)},
hd AS (SELECT formula_id, horizon, dt, sum(held * fwd) AS pnl, sum(step) AS turn FROM hs GROUP BY ALL),
reb AS (SELECT formula_id, horizon, {SHARPE('pnl')} AS sharpe, avg(turn) AS turnover FROM hd GROUP BY ALL)"""
SAT = lambda x: f"greatest(0, least(1, 1 - exp(-greatest({x}, 0) / {S.REFERENCE_SHARPE})))"
CAPS = ", ".join(f"({c}, {w})" for c, w in S.CAPITAL_WEIGHTS.items())
HW = " ".join(f"WHEN {h} THEN {w}" for h, w in S.HORIZON_WEIGHTS.items())
GRID_SQL = f"""cp(capital, w_c) AS (VALUES {CAPS}),
grid AS (SELECT formula_id, horizon, capital, sharpe, {SAT('sharpe')} * {SAT(f'sharpe - turnover * capital / 1e6 * {S.TURNOVER_SCALE}')} AS cell, ((CASE horizon {HW} END) * w_c)::DOUBLE AS weight FROM reb CROSS JOIN cp)"""
UNIT_SQL = lambda cap: f"""ct(asset, spread_bps, eta, adv_bn) AS (VALUES {', '.join(f"('{k}', {a}, {b}, {c})" for k, (a, b, c) in S.COSTS.items())}),
vol AS (SELECT asset, stddev_samp(ret) AS sigma FROM p GROUP BY asset),
unit AS (SELECT asset, spread_bps / 2e4 + eta * sigma * sqrt(greatest(0, least(1, {cap} / (adv_bn * 1e9)))) AS unit, spread_bps, eta, adv_bn, sigma
  FROM (SELECT v.asset, sigma, coalesce(spread_bps, 5.0) AS spread_bps, coalesce(eta, 0.15) AS eta, coalesce(adv_bn, 0.2) AS adv_bn FROM vol v LEFT JOIN ct ON ct.asset = v.asset))"""  # noqa: E731

QUERIES, ORACLE = {}, {}


def add(name: str, fn, sql: str | None = None) -> None:
    QUERIES[name] = lambda spark, d: rounded(fn(spark, d))
    if sql:
        ORACLE[name] = sql


# language operators
OPS_SQL = {
    "rank": ("rank(momentum_20d)", PCT("momentum_20d")),
    "zscore": ("zscore(rsi_14)", "(rsi_14 - avg(rsi_14) OVER (PARTITION BY dt)) / nullif(stddev_samp(rsi_14) OVER (PARTITION BY dt), 0)"),
    "pzscore": ("pzscore(rsi_14)", "CASE WHEN stddev_pop(rsi_14) OVER (PARTITION BY dt) >= 1e-8 THEN (rsi_14 - avg(rsi_14) OVER (PARTITION BY dt)) / stddev_pop(rsi_14) OVER (PARTITION BY dt) END"),
    "orank": ("orank(momentum_20d)", "CASE WHEN momentum_20d IS NOT NULL AND count(momentum_20d) OVER (PARTITION BY dt) >= 2 THEN (row_number() OVER (PARTITION BY dt ORDER BY round(momentum_20d, 10) NULLS LAST, asset_ord) - 1)::DOUBLE / (count(momentum_20d) OVER (PARTITION BY dt) - 1) END"),
    "neutralize": ("neutralize(momentum_5d)", "momentum_5d - avg(momentum_5d) OVER (PARTITION BY dt)"),
    "decay": ("decay(momentum_5d, halflife=10)", EMA("momentum_5d", 10)),
    "clip": ("clip(zscore_20d, lo=-1, hi=1)", "CASE WHEN zscore_20d < -1 THEN -1 WHEN zscore_20d > 1 THEN 1 ELSE zscore_20d END"),
    "lag": ("lag(momentum_5d, n=3)", "lag(momentum_5d, 3) OVER (PARTITION BY asset ORDER BY dt)"),
    "sign": ("sign(momentum_5d)", "sign(momentum_5d)::DOUBLE"),
    "abs": ("abs(momentum_5d)", "abs(momentum_5d)"),
    "arithmetic": ("momentum_5d * 2 + reversal_5d / volatility_20d - 0.5", "momentum_5d * 2 + reversal_5d / nullif(volatility_20d, 0) - 0.5"),
    "negate": ("-momentum_5d", "-momentum_5d"),
}


def _op(formula: str):
    def run(spark, d):
        _, f = _features(spark, d, {"value": formula})
        return evaluate(f, {"value": formula}).select("dt", "asset", "value")

    return run


for _k, (_f, _sql) in OPS_SQL.items():
    add(f"op_{_k}", _op(_f), f"{PRE} SELECT dt, asset, round({_sql}, 6) AS value FROM f")
DECAY_ADJ_SQL = "list_reduce(list_transform(list(momentum_5d) FILTER (momentum_5d IS NOT NULL) OVER (PARTITION BY asset ORDER BY dt ROWS UNBOUNDED PRECEDING), lambda v: [v, 1.0]), lambda a, v: [a[1] * {q} + v[1], a[2] * {q} + 1.0])".format(q=repr(2.0 ** (-1 / 10)))
add("op_decay_adj", _op("decay_adj(momentum_5d)"), f"{PRE}, x AS (SELECT dt, asset, {DECAY_ADJ_SQL} AS s FROM f) SELECT dt, asset, round(s[1] / s[2], 6) AS value FROM x")
add("formula_spread", lambda s, d: exact(s, d)[1].where("formula_id = 'flagship'").select("dt", "asset", "val"), f"{PRE}, {EXACT_SQL} SELECT dt, asset, round(val, 6) AS val FROM sig WHERE formula_id = 'flagship'")
add("formula_linear", lambda s, d: linear(s, d)[1].select("formula_id", "dt", "asset", "val"), f"{PRE}, {LINEAR_SQL} SELECT formula_id, dt, asset, round(val, 6) AS val FROM sig")

# information coefficients
add("ic_daily", lambda s, d: S.ic_daily(exact(s, d)[1], S.forward(lineitem_panel(s, d))), f"{PRE}, {EXACT_SQL}, {_ic_sql()} SELECT formula_id, dt, n, round(ic, 6) AS ic FROM ic")
add("ic_summary", lambda s, d: S.ic_summary(S.ic_daily(exact(s, d)[1], S.forward(lineitem_panel(s, d)))), f"{PRE}, {EXACT_SQL}, {_ic_sql()} {SUMMARY_SQL.format(std='stddev_samp')}")
add("ic_summary_population", lambda s, d: S.ic_summary(S.ic_daily(exact(s, d)[1], S.forward(lineitem_panel(s, d))), False), f"{PRE}, {EXACT_SQL}, {_ic_sql()} {SUMMARY_SQL.format(std='stddev_pop')}")
add("ic_complete_dates", lambda s, d: S.ic_daily(exact(s, d)[1], S.forward(lineitem_panel(s, d)), complete=7), f"{PRE}, {EXACT_SQL}, {_ic_sql(1, 7)} SELECT formula_id, dt, n, round(ic, 6) AS ic FROM ic")
add("ic_ordinal", lambda s, d: S.ic_daily(linear(s, d)[1], S.forward(lineitem_panel(s, d), 2), 1, mode="ordinal").groupBy("formula_id").agg(F.avg(F.coalesce("ic", F.lit(0.0))).alias("mean_ic"), F.stddev_pop(F.coalesce("ic", F.lit(0.0))).alias("std_ic")), f"{PRE}, {LINEAR_SQL}, {ORDINAL_SQL} SELECT formula_id, round(avg(coalesce(ic, 0)), 6) AS mean_ic, round(stddev_pop(coalesce(ic, 0)), 6) AS std_ic FROM ic GROUP BY formula_id")
DECAY_UNION = " UNION ALL ".join(f"SELECT dt, asset, {k} AS lag, lead(ret, {k}) OVER (PARTITION BY asset ORDER BY dt) AS fwd FROM p" for k in range(1, 6))
add(
    "ic_decay",
    lambda s, d: S.ic_decay(exact(s, d)[1], lineitem_panel(s, d)),
    f"""{PRE}, {EXACT_SQL}, lf AS ({DECAY_UNION}), j AS (SELECT formula_id, lag, dt, {_rank_sql('val', 'formula_id, lag, dt')} AS rv, {_rank_sql('fwd', 'formula_id, lag, dt')} AS rf FROM sig JOIN lf USING (dt, asset) WHERE val IS NOT NULL AND fwd IS NOT NULL),
ic AS (SELECT formula_id, lag, dt, {_pearson_sql('rv', 'rf')} AS ic FROM j GROUP BY ALL HAVING count(*) >= 3) SELECT formula_id, lag, round(avg(ic), 6) AS mean_ic, count(*) AS n FROM ic WHERE ic IS NOT NULL GROUP BY ALL""",
)
add("ic_horizons", lambda s, d: S.ic_horizons(linear(s, d)[1], lineitem_panel(s, d), S.HORIZON_WEIGHTS), f"{PRE}, {LINEAR_SQL}, {_horizon_sql(S.HORIZON_WEIGHTS, False)} SELECT formula_id, horizon, weight::DOUBLE AS weight, round(mean_ic, 6) AS mean_ic FROM h")
add("ic_horizons_weighted", lambda s, d: S.weighted_ic(S.ic_horizons(linear(s, d)[1], lineitem_panel(s, d), S.HORIZON_WEIGHTS)), f"{PRE}, {LINEAR_SQL}, {_horizon_sql(S.HORIZON_WEIGHTS, False)} SELECT formula_id, round(sum(weight * mean_ic), 6) AS weighted_ic FROM h GROUP BY formula_id")
add("ic_log_horizons", lambda s, d: S.ic_horizons(exact(s, d)[1], lineitem_panel(s, d), S.LOG_HORIZONS, True), f"{PRE}, {EXACT_SQL}, {_horizon_sql(S.LOG_HORIZONS, True)} SELECT formula_id, horizon, weight::DOUBLE AS weight, round(mean_ic, 6) AS mean_ic FROM h")

# portfolios
WPRE = f"{PRE}, {LINEAR_SQL}, {W_SQL}"
add("port_weights", lambda s, d: S.weights(linear(s, d)[1]), f"{WPRE} SELECT formula_id, dt, asset, asset_ord, round(w, 6) AS w FROM w")
add("port_pnl", lambda s, d: S.pnl(S.weights(linear(s, d)[1]), lineitem_panel(s, d)), f"{WPRE}, {PNL_SQL} SELECT formula_id, dt, round(pnl, 6) AS pnl FROM pnl")
METRICS = f"""met0 AS (SELECT formula_id, {SHARPE('pnl')} AS sharpe, avg(pnl) / (sqrt(avg(least(pnl, 0) ** 2)) + 1e-8) * sqrt(252.0) AS sortino,
  sign(sum(pnl)) * (abs(1 + sum(pnl)) ** (1 / greatest(count(*) / 252.0, 0.1)) - 1) AS annual_return, avg((pnl > 0)::INT) AS win_rate, count(*) AS n FROM pnl GROUP BY formula_id),
f1 AS (SELECT dt, asset, lead(ret, 1) OVER (PARTITION BY asset ORDER BY dt) AS f1 FROM p),
t AS (SELECT formula_id, avg(step) AS turnover FROM (SELECT formula_id, abs(w - lag(w) OVER (PARTITION BY formula_id, asset ORDER BY dt)) AS step FROM w JOIN f1 USING (dt, asset) WHERE f1 IS NOT NULL) GROUP BY formula_id),
met AS (SELECT met0.*, turnover, additive AS max_drawdown FROM met0 JOIN t USING (formula_id) JOIN dd USING (formula_id))"""


def _cols(*names: str) -> str:
    return ", ".join(f"round({n}, 6) AS {n}" for n in names)


def _metrics(s, d):
    p, sig = linear(s, d)
    return S.portfolio(sig, p)


MPRE = f"{WPRE}, {PNL_SQL}, {DD_SQL}, {METRICS}"
add("port_metrics", _metrics, f"{MPRE} SELECT formula_id, n, {_cols('sharpe', 'sortino', 'annual_return', 'win_rate', 'turnover', 'max_drawdown')} FROM met")
add("drawdown_forms", lambda s, d: S.drawdowns(S.pnl(S.weights(linear(s, d)[1]), lineitem_panel(s, d))), f"{WPRE}, {PNL_SQL}, {DD_SQL} SELECT formula_id, {_cols('additive', 'relative', 'recent')} FROM dd")
add(
    "turnover_forms",
    lambda s, d: S.turnovers(S.weights(linear(s, d)[1]), None),
    f"""{WPRE}, s1 AS (SELECT *, abs(w - lag(w) OVER (PARTITION BY formula_id, asset ORDER BY dt)) AS step, percent_rank() OVER (PARTITION BY formula_id, dt ORDER BY round(w, 10), asset_ord) AS pos FROM w),
s2 AS (SELECT *, abs(pos - lag(pos) OVER (PARTITION BY formula_id, asset ORDER BY dt)) AS rs FROM s1), s3 AS (SELECT formula_id, dt, avg(step) AS a, sum(step) AS b, avg(rs) AS c FROM s2 WHERE step IS NOT NULL GROUP BY ALL)
SELECT formula_id, round(avg(a), 6) AS mean_change, round(avg(b), 6) AS per_date, round(avg(b) / 2, 6) AS half, round(avg(c), 6) AS rank_change FROM s3 GROUP BY formula_id""",
)


def _reb(s, d):
    p, sig = linear(s, d)
    return S.rebalanced(sig, p)


RPRE = f"{WPRE}, {_fwd(2)}, {REB_SQL}"
add("rebalance_sim", _reb, f"{RPRE} SELECT formula_id, horizon, {_cols('sharpe', 'turnover')} FROM reb")
add("capital_scores", lambda s, d: S.capital_scores(_metrics(s, d)), f"{MPRE}, cp(capital, w_c) AS (VALUES {CAPS}) SELECT formula_id, capital, round(sharpe - turnover * capital / 1e6 * {S.TURNOVER_SCALE}, 6) AS score FROM met CROSS JOIN cp")
add("score_grid", lambda s, d: S.grid(_reb(s, d)), f"{RPRE}, {GRID_SQL} SELECT formula_id, horizon, capital, {_cols('sharpe', 'cell', 'weight')} FROM grid")
add(
    "composite",
    lambda s, d: S.composite(_reb(s, d)),
    f"""{RPRE}, {GRID_SQL}, c AS (SELECT formula_id, sum(weight * cell) / sum(weight) AS cells, avg((cell > 0.01)::INT) AS robustness FROM grid GROUP BY formula_id),
e AS (SELECT *, exp(sharpe - max(sharpe) OVER (PARTITION BY formula_id)) AS e FROM reb), so AS (SELECT formula_id, sum(e * sharpe) / (sum(e) + 1e-8) AS soft FROM e GROUP BY formula_id)
SELECT formula_id, round(0.9 * cells + 0.1 * {SAT('soft')}, 6) AS composite, round(robustness, 6) AS robustness FROM c JOIN so USING (formula_id)""",
)
LS_EVERY = ", ".join(f"({n}, {n})" for n in S.REBALANCE.values())
add(
    "threshold_long_short",
    lambda s, d: S.threshold_long_short(exact(s, d)[1], lineitem_panel(s, d)),
    f"""{PRE}, {EXACT_SQL}, {_fwd(2)}, l1 AS (SELECT formula_id, dt, asset, {_rank_sql('val', 'formula_id, dt')} / count(val) OVER (PARTITION BY formula_id, dt) AS r FROM sig WHERE val IS NOT NULL),
l2 AS (SELECT *, CASE WHEN r > 0.8 THEN 1.0 WHEN r < 0.2 THEN -1.0 ELSE 0 END AS side FROM l1), lw AS (SELECT formula_id, dt, asset, side / greatest(sum(abs(side)) OVER (PARTITION BY formula_id, dt), 1) AS w FROM l2),
{_held_sql('lw', LS_EVERY)}, ld AS (SELECT formula_id, horizon AS every, dt, sum(held * fwd) - sum(step) * 0.0002 AS pnl FROM hs GROUP BY ALL),
ls AS (SELECT formula_id, every, {SHARPE('pnl')} AS sharpe FROM ld GROUP BY ALL HAVING count(*) >= 60) SELECT formula_id, arg_max(every, sharpe) AS best_every, round(max(sharpe), 6) AS sharpe FROM ls GROUP BY formula_id""",
)
add(
    "signal_stability",
    lambda s, d: S.signal_stability(exact(s, d)[1]),
    f"""{PRE}, {EXACT_SQL}, l1 AS (SELECT formula_id, dt, asset, {_rank_sql('val', 'formula_id, dt')} / count(val) OVER (PARTITION BY formula_id, dt) AS r FROM sig WHERE val IS NOT NULL),
l2 AS (SELECT *, lag(r, 5) OVER (PARTITION BY formula_id, asset ORDER BY dt) AS b FROM l1), l3 AS (SELECT formula_id, asset, {_pearson_sql('r', 'b', '1e-12')} AS c FROM l2 WHERE b IS NOT NULL GROUP BY ALL HAVING count(*) + 5 > 15)
SELECT formula_id, round(avg(c), 6) AS stability FROM l3 WHERE c IS NOT NULL GROUP BY formula_id""",
)

# costs
add("unit_costs", lambda s, d: S.unit_costs(lineitem_panel(s, d), 1e6), f"{PRE}, {UNIT_SQL('1e6')} SELECT asset, round(unit, 6) AS unit, spread_bps::DOUBLE AS spread_bps, eta::DOUBLE AS eta, adv_bn::DOUBLE AS adv_bn, round(sigma, 6) AS sigma FROM unit")
add(
    "net_of_costs",
    lambda s, d: S.net_of_costs(S.weights(linear(s, d)[1]), lineitem_panel(s, d), 1e6),
    f"""{WPRE}, {_fwd(2)}, {UNIT_SQL('1e6')}, x AS (SELECT *, abs(w - lag(w) OVER (PARTITION BY formula_id, asset ORDER BY dt)) AS step FROM w),
n AS (SELECT formula_id, dt, sum(w * fwd) AS gross, sum(coalesce(step * unit, 0)) AS cost FROM x JOIN unit USING (asset) JOIN fwd USING (dt, asset) WHERE fwd IS NOT NULL GROUP BY ALL)
SELECT formula_id, round(avg(gross), 6) AS gross, round(avg(gross - cost), 6) AS net, round(sum(cost), 6) AS cost, round({SHARPE('gross')}, 6) AS gross_sharpe, round({SHARPE('(gross - cost)')}, 6) AS net_sharpe FROM n GROUP BY formula_id""",
)
add(
    "simple_costs",
    lambda s, d: S.simple_costs(S.weights(linear(s, d)[1]), lineitem_panel(s, d)),
    f"""{WPRE}, {_fwd(1)}, x AS (SELECT *, abs(w - coalesce(lag(w) OVER (PARTITION BY formula_id, asset ORDER BY dt), 0)) AS step FROM w),
n AS (SELECT formula_id, dt, sum(w * fwd) AS gross, sum(step) / 2 AS turnover FROM x JOIN fwd USING (dt, asset) WHERE fwd IS NOT NULL GROUP BY ALL), n2 AS (SELECT *, gross - turnover * 0.001 AS net FROM n)
SELECT formula_id, round(sum(gross), 6) AS gross_return, round(sum(net), 6) AS net_return, round(avg(turnover), 6) AS turnover, round(avg(net) / nullif(stddev_samp(net), 0) * sqrt(252.0), 6) AS net_sharpe FROM n2 GROUP BY formula_id""",
)
add(
    "pairwise_corr",
    lambda s, d: S.pairwise_correlation(linear(s, d)[1], "formula_id", ["dt", "asset"], "val"),
    f"{PRE}, {LINEAR_SQL} SELECT a.formula_id AS a, b.formula_id AS b, round({_pearson_sql('a.val', 'b.val', '1e-15')}, 6) AS corr, count(*) AS n FROM sig a JOIN sig b ON a.dt = b.dt AND a.asset = b.asset AND a.formula_id < b.formula_id GROUP BY 1, 2",
)
add(
    "topk_formulas",
    lambda s, d: S.ic_summary(S.ic_daily(exact(s, d)[1], S.forward(lineitem_panel(s, d)))).orderBy(F.desc("mean_ic"), "formula_id").limit(2).select("formula_id", "mean_ic"),
    f"{PRE}, {EXACT_SQL}, {_ic_sql()} SELECT formula_id, round(avg(ic), 6) AS mean_ic FROM ic WHERE ic IS NOT NULL GROUP BY formula_id ORDER BY avg(ic) DESC, formula_id LIMIT 2",
)
