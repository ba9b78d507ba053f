"""Regime, policy, scenario and validation queries."""

from __future__ import annotations

from panelforge.operators import regimes as R
from panelforge.operators import scoring as S
from panelforge.queries.scoring import EXACT_SQL, PRE, _ic_sql, exact, rounded
from panelforge.sources.panel import TICKERS, lineitem_panel

REG = "CASE WHEN vol_regime > 0.5 OR risk_on_off < -0.3 THEN 'stress' WHEN vol_regime < -0.5 AND trend_strength > 0.6 THEN 'calm' ELSE 'normal' END"
LABELS = f"lab AS (SELECT dt, {REG} AS regime FROM s)"
EVENT = """ev0 AS (SELECT dt, ln(px_DBC) - ln(px_TLT) AS a, ln(px_HYG) - ln(px_TLT) AS b, ln(px_IWM) - ln(px_SPY) AS c, ln(px_EEM) - ln(px_SPY) AS e, ln(px_TLT) AS t FROM dl),
ev1 AS (SELECT dt, a - lag(a, 20) OVER o AS dbc, b - lag(b, 10) OVER o AS hyg, c - lag(c, 20) OVER o AS iwm, e - lag(e, 20) OVER o AS eem, t - lag(t, 20) OVER o AS tlt FROM ev0 WINDOW o AS (ORDER BY dt)),
ev2 AS (SELECT *, CASE WHEN count(dbc) OVER w = 252 THEN quantile_cont(dbc, 0.75) OVER w END AS q75, CASE WHEN count(dbc) OVER w = 252 THEN quantile_cont(dbc, 0.8) OVER w END AS q80,
  CASE WHEN count(hyg) OVER w = 252 THEN quantile_cont(hyg, 0.25) OVER w END AS qh, CASE WHEN count(iwm) OVER w = 252 THEN quantile_cont(iwm, 0.15) OVER w END AS qi,
  CASE WHEN count(eem) OVER w = 252 THEN quantile_cont(eem, 0.25) OVER w END AS qe FROM ev1 WINDOW w AS (ORDER BY dt ROWS BETWEEN 251 PRECEDING AND CURRENT ROW))"""
MARKET = """mk AS (SELECT dt, avg(ret) AS m FROM p GROUP BY dt), mk2 AS (SELECT dt, CASE WHEN count(m) OVER w = 252 THEN avg(m) OVER w END * 252 AS mean, CASE WHEN count(m) OVER w = 252 THEN stddev_samp(m) OVER w END * sqrt(252.0) AS std
  FROM mk WINDOW w AS (ORDER BY dt ROWS BETWEEN 251 PRECEDING AND CURRENT ROW))"""
POLICY = """po0 AS (SELECT dl.dt, ln(px_TLT) AS a, ln(px_DBC / px_GLD) AS b, ln(px_HYG / px_TLT) AS c, ln(px_EEM / px_GLD) AS e, trend_strength AS f FROM dl JOIN s USING (dt)),
po1 AS (SELECT dt, a - lag(a, 20) OVER o AS rate_env, b - lag(b, 20) OVER o AS inflation, c - lag(c, 20) OVER o AS liquidity, -(e - lag(e, 20) OVER o) AS dollar, f - lag(f, 10) OVER o AS breadth FROM po0 WINDOW o AS (ORDER BY dt)),
po AS (SELECT dt, last_value(rate_env IGNORE NULLS) OVER o AS rate_env, last_value(inflation IGNORE NULLS) OVER o AS inflation, last_value(liquidity IGNORE NULLS) OVER o AS liquidity,
  last_value(dollar IGNORE NULLS) OVER o AS dollar, last_value(breadth IGNORE NULLS) OVER o AS breadth FROM po1 WINDOW o AS (ORDER BY dt ROWS UNBOUNDED PRECEDING))"""
SHARES = """sh AS (SELECT dt, avg((regime = 'calm')::INT) OVER w AS calm, avg((regime = 'normal')::INT) OVER w AS normal, avg((regime = 'stress')::INT) OVER w AS stress FROM lab WINDOW w AS (ORDER BY dt ROWS BETWEEN 19 PRECEDING AND CURRENT ROW))"""
FACTORS = {
    "p_stress": "stress",
    "p_calm": "calm",
    "p_not_calm": "1 - calm",
    "p_calm_normal": "calm + normal",
    "p_stress_normal": "stress + normal",
    "rate_rising": "-rate_env / 0.05",
    "rate_falling": "rate_env / 0.05",
    "inflation_rising": "inflation / 0.05",
    "credit_tightening": "-liquidity / 0.03",
    "credit_easing": "liquidity / 0.03",
    "dollar_strong": "dollar / 0.05",
    "dollar_weak": "-dollar / 0.05",
    "breadth_broadening": "breadth / 0.05",
    "breadth_narrowing": "-breadth / 0.05",
}
RAW = " UNION ALL ".join(
    f"SELECT dt, '{s}' AS scenario, 0.01 + " + " + ".join(f"{w} * least(greatest(coalesce({FACTORS[k]}, 0), 0), 1)" for k, w in m.items()) + " AS v FROM po JOIN sh USING (dt)" for s, m in R.SCENARIOS.items()
)
SCEN = f"raw AS ({RAW}), scen AS (SELECT dt, scenario, round((v / sum(v) OVER (PARTITION BY dt))::DOUBLE, 4) AS p FROM raw)"
BASE = f"{PRE}, {LABELS}, {POLICY}, {SHARES}"


def word(c: str, up: str, down: str) -> str:
    return f"CASE WHEN {c} > 0.01 THEN '{up}' WHEN {c} < -0.01 THEN '{down}' ELSE 'flat' END AS {c}"


def _ic(s, d):
    return S.ic_daily(exact(s, d)[1], S.forward(lineitem_panel(s, d)))


def _scen(s, d):
    p = lineitem_panel(s, d)
    shares = R.regime_shares(R.regime_labels(p, TICKERS))
    return shares, R.scenario_probabilities(R.policy(p, TICKERS), shares)


WF = f"""{PRE}, {EXACT_SQL}, {_ic_sql()}, dd AS (SELECT dt, row_number() OVER (ORDER BY dt) - 1 AS i FROM (SELECT DISTINCT dt FROM ic)),
st AS (SELECT unnest(range(0, greatest(max(i) + 1 - 147, 0) + 1, 21)) AS t0 FROM dd),
wf AS (SELECT formula_id, (t0 // 21)::INT AS "window", avg(ic) FILTER (i < t0 + 126) AS train_ic, avg(ic) FILTER (i >= t0 + 126) AS test_ic, count(*) FILTER (i >= t0 + 126) AS n_test
  FROM ic JOIN dd USING (dt) JOIN st ON i >= t0 AND i < t0 + 147 WHERE ic IS NOT NULL GROUP BY ALL)"""

QUERIES = {
    "regime_labels": lambda s, d: R.regime_labels(lineitem_panel(s, d), TICKERS),
    "event_labels": lambda s, d: R.event_labels(lineitem_panel(s, d)),
    "event_labels_backfilled": lambda s, d: R.event_labels(lineitem_panel(s, d), backfill=True),
    "market_labels": lambda s, d: R.market_labels(lineitem_panel(s, d)),
    "policy_series": lambda s, d: rounded(R.policy(lineitem_panel(s, d), TICKERS)),
    "policy_states": lambda s, d: R.policy_states(rounded(R.policy(lineitem_panel(s, d), TICKERS))),
    "regime_shares": lambda s, d: rounded(R.regime_shares(R.regime_labels(lineitem_panel(s, d), TICKERS))),
    "scenario_probabilities": lambda s, d: _scen(s, d)[1],
    "confidence": lambda s, d: rounded(R.confidence(*_scen(s, d))),
    "ic_by_regime": lambda s, d: rounded(R.by_regime(_ic(s, d), R.regime_labels(lineitem_panel(s, d), TICKERS))),
    "walk_forward": lambda s, d: rounded(R.walk_forward(_ic(s, d), 126, 21, 21)),
    "walk_forward_verdicts": lambda s, d: rounded(R.verdicts(R.walk_forward(_ic(s, d), 126, 21, 21))),
}
_EV = "CASE WHEN dbc > q80 AND eem < qe THEN 'geopolitical' WHEN iwm < qi AND tlt > 0.03 THEN 'growth_collapse' WHEN hyg < qh AND iwm < -0.03 THEN 'liquidity_crisis' WHEN dbc > q75 THEN 'inflation_shock' ELSE 'normal' END"
_FILL = ", ".join(f"coalesce({q}, first_value({q} IGNORE NULLS) OVER (ORDER BY dt ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS {q}" for q in ("q75", "q80", "qh", "qi", "qe"))
ORACLE = {
    "regime_labels": f"{PRE}, {LABELS} SELECT * FROM lab",
    "event_labels": f"{PRE}, {EVENT} SELECT dt, {_EV} AS event FROM ev2",
    "event_labels_backfilled": f"{PRE}, {EVENT}, ev3 AS (SELECT dt, dbc, hyg, iwm, eem, tlt, {_FILL} FROM ev2) SELECT dt, {_EV} AS event FROM ev3",
    "market_labels": f"{PRE}, {MARKET} SELECT dt, CASE WHEN std > 0.3 THEN 'crisis' WHEN mean < -0.05 THEN 'bear' ELSE 'bull' END AS market FROM mk2",
    "policy_series": f"{PRE}, {POLICY} SELECT dt, round(rate_env, 6) AS rate_env, round(inflation, 6) AS inflation, round(liquidity, 6) AS liquidity, round(dollar, 6) AS dollar, round(breadth, 6) AS breadth FROM po",
    "policy_states": f"{PRE}, {POLICY}, pr AS (SELECT dt, round(rate_env, 6) AS rate_env, round(inflation, 6) AS inflation, round(liquidity, 6) AS liquidity, round(dollar, 6) AS dollar, round(breadth, 6) AS breadth FROM po) SELECT dt, {word('rate_env', 'falling', 'rising')}, {word('inflation', 'rising', 'falling')}, {word('liquidity', 'easing', 'tightening')}, {word('dollar', 'strong', 'weak')}, {word('breadth', 'broadening', 'narrowing')} FROM pr",
    "regime_shares": f"{PRE}, {LABELS}, {SHARES} SELECT dt, round(calm, 6) AS calm, round(normal, 6) AS normal, round(stress, 6) AS stress FROM sh",
    "scenario_probabilities": f"{BASE}, {SCEN} SELECT * FROM scen",
    "confidence": f"""{BASE}, {SCEN}, hh AS (SELECT dt, sum(p * p) AS hhi FROM scen GROUP BY dt),
cf AS (SELECT dt, 0.5 * (1 + ((CASE WHEN calm > 0 THEN calm * ln(calm) ELSE 0 END) + (CASE WHEN normal > 0 THEN normal * ln(normal) ELSE 0 END) + (CASE WHEN stress > 0 THEN stress * ln(stress) ELSE 0 END)) / ln(3.0)) + 0.15
  + 0.2 * greatest(0, least(1, (1 - hhi) / 0.875)) AS c FROM sh JOIN hh USING (dt))
SELECT dt, round(c, 6) AS confidence, CASE WHEN c > 0.7 THEN 'HIGH' WHEN c > 0.45 THEN 'MEDIUM' ELSE 'LOW' END AS level, CASE WHEN c > 0.7 THEN 1.0 WHEN c > 0.45 THEN 0.75 ELSE 0.5 END::DOUBLE AS scale FROM cf""",
    "ic_by_regime": f"""{PRE}, {EXACT_SQL}, {_ic_sql()}, {LABELS}, g AS (SELECT formula_id, avg(ic) FILTER (regime = 'calm') AS calm, avg(ic) FILTER (regime = 'normal') AS normal, avg(ic) FILTER (regime = 'stress') AS stress FROM ic JOIN lab USING (dt) GROUP BY formula_id)
SELECT formula_id, round(calm, 6) AS calm, round(normal, 6) AS normal, round(stress, 6) AS stress, round(least(calm, normal, stress), 6) AS worst FROM g""",
    "walk_forward": f'{WF} SELECT formula_id, "window", round(train_ic, 6) AS train_ic, round(test_ic, 6) AS test_ic, n_test FROM wf',
    "walk_forward_verdicts": f"""{WF}, v AS (SELECT formula_id, avg(test_ic) AS m, avg((test_ic > 0)::INT) AS pr, coalesce(stddev_pop(test_ic), 0) AS sp FROM wf GROUP BY formula_id),
v2 AS (SELECT *, list_filter([CASE WHEN m < 0.01 THEN 'ic' END, CASE WHEN pr < 0.5 THEN 'pass_rate' END, CASE WHEN sp > 0.2 THEN 'stability' END], lambda x: x IS NOT NULL) AS why FROM v)
SELECT formula_id, round(m, 6) AS mean_ic, round(pr, 6) AS pass_rate, round(sp, 6) AS spread, array_to_string(why, ',') AS reasons, len(why) = 0 AS passes FROM v2""",
}
