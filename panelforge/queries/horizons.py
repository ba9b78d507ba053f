"""Queries over several horizons: scores net of turnover, and the long-short portfolio."""

from __future__ import annotations

from panelforge.operators import horizons as H
from panelforge.operators.scoring import LOG_HORIZONS
from panelforge.queries.scoring import EXACT_SQL, PRE, _pearson_sql, _rank_sql, exact, rounded
from panelforge.sources.panel import lineitem_panel

HS = list(LOG_HORIZONS)


def _cols(*names: str) -> str:
    return ", ".join(f"round({n}, 6) AS {n}" for n in names)


RANKED = f"""rk AS (SELECT formula_id, dt, asset, CASE WHEN val IS NOT NULL THEN {_rank_sql('val', 'formula_id, dt')} END AS rv, count(val) OVER (PARTITION BY formula_id, dt) AS n, count(*) OVER (PARTITION BY formula_id, dt) AS width FROM sig),
rs AS (SELECT *, rv / nullif(n, 0) AS share FROM rk)"""
SCORES = f"""{PRE}, {EXACT_SQL}, {RANKED},
hz(h, weight) AS (VALUES {', '.join(f'({h}, {w})' for h, w in LOG_HORIZONS.items())}),
fw AS (SELECT dt, asset, h, weight::DOUBLE AS weight, ln(CASE h {' '.join(f'WHEN {h} THEN lead(px, {h}) OVER (PARTITION BY h, asset ORDER BY dt)' for h in HS)} END / px) AS fwd FROM p CROSS JOIN hz),
fr AS (SELECT dt, asset, h, weight, CASE WHEN fwd IS NOT NULL THEN {_rank_sql('fwd', 'h, dt')} END AS rf FROM fw),
c AS (SELECT formula_id, h, weight, dt, {_pearson_sql('x', 'y')} AS ic, count(rv) > 0 AND count(rf) > 0 AS seen
  FROM (SELECT *, CASE WHEN rv IS NOT NULL AND rf IS NOT NULL THEN rv END AS x, CASE WHEN rv IS NOT NULL AND rf IS NOT NULL THEN rf END AS y FROM rs JOIN fr USING (dt, asset)) GROUP BY ALL),
by_h AS (SELECT formula_id, h, weight, count(*) FILTER (seen) AS n_seen, CASE WHEN count(ic) >= 5 AND count(*) >= 10 THEN avg(ic) ELSE 0 END AS ic,
  CASE WHEN count(ic) >= 5 AND count(*) >= 10 AND stddev_pop(ic) > 0 THEN avg(ic) / (stddev_pop(ic) + 1e-8) ELSE 0 END AS ir FROM c GROUP BY ALL),
t AS (SELECT formula_id, avg(a) AS turnover FROM (SELECT formula_id, asset, avg(step) AS a FROM (SELECT formula_id, asset, abs(share - lag(share) OVER (PARTITION BY formula_id, asset ORDER BY dt)) AS step FROM rs) GROUP BY ALL) GROUP BY ALL),
s5 AS (SELECT formula_id, asset, share, lag(share, 5) OVER (PARTITION BY formula_id, asset ORDER BY dt) AS b FROM rs WHERE share IS NOT NULL),
st AS (SELECT formula_id, avg(ac) AS stability FROM (SELECT formula_id, asset, {_pearson_sql('share', 'b', '1e-12')} AS ac FROM s5 WHERE b IS NOT NULL GROUP BY ALL HAVING count(*) > 10) GROUP BY ALL),
g AS (SELECT formula_id, max(n_seen) FILTER (h = 1) AS n_obs, {', '.join(f'max({x}) FILTER (h = {h}) AS {x}_{h}' for x in ('ic', 'ir') for h in HS)}, sum(ic * weight) / sum(weight) AS mh_ic, arg_max(h, (abs(ic), -h)) AS best_horizon FROM by_h GROUP BY formula_id),
a AS (SELECT g.*, coalesce(turnover, 0) AS turnover, coalesce(stability, 0) AS stability, mh_ic / (1 + 2 * coalesce(turnover, 0)) AS tc_adj FROM g LEFT JOIN t USING (formula_id) LEFT JOIN st USING (formula_id))
SELECT formula_id, n_obs, {_cols(*[f'{x}_{h}' for x in ('ic', 'ir') for h in HS], 'turnover', 'stability', 'mh_ic', 'tc_adj')}, best_horizon, row_number() OVER (ORDER BY round(tc_adj, 10) DESC, formula_id) AS place FROM a"""
PORTFOLIO = f"""{PRE}, {EXACT_SQL}, {RANKED},
w AS (SELECT formula_id, dt, asset, (CASE WHEN share > 0.8 THEN 1.0 WHEN share < 0.2 THEN -1.0 ELSE 0 END) / width AS w, row_number() OVER (PARTITION BY formula_id, asset ORDER BY dt) - 1 AS i FROM rs),
held AS (SELECT x.formula_id, every, x.dt, x.asset, y.w AS h FROM w x CROSS JOIN (VALUES (1), (5), (21), (63)) ev(every) JOIN w y ON y.formula_id = x.formula_id AND y.asset = x.asset AND y.i = x.i - x.i % every),
lagged AS (SELECT *, lag(h) OVER (PARTITION BY formula_id, every, asset ORDER BY dt) AS b FROM held),
nx AS (SELECT dt, asset, lead(lret) OVER (PARTITION BY asset ORDER BY dt) AS l1 FROM p),
d AS (SELECT formula_id, every, dt, coalesce(sum(abs(h - b)), 0) AS turn, coalesce(sum(b * l1), 0) - coalesce(sum(abs(h - b)), 0) * 0.001 AS net FROM lagged JOIN nx USING (dt, asset) GROUP BY ALL),
v AS (SELECT *, product(1 + net) OVER (PARTITION BY formula_id, every ORDER BY dt) AS value FROM d),
l AS (SELECT *, value / nullif(max(value) OVER (PARTITION BY formula_id, every ORDER BY dt), 0) - 1 AS loss FROM v),
g AS (SELECT formula_id, every, avg(net) * 252 AS annual_return, stddev_samp(net) * sqrt(252.0) AS annual_vol, min(loss) AS max_drawdown, avg(turn) * 252 AS turnover, count(*) AS n FROM l GROUP BY ALL HAVING count(*) >= 60),
q AS (SELECT *, CASE WHEN annual_vol > 1e-8 THEN annual_return / annual_vol ELSE 0 END AS sharpe, CASE WHEN abs(max_drawdown) > 1e-8 THEN annual_return / abs(max_drawdown) ELSE 0 END AS calmar FROM g)
SELECT formula_id, every, n, {_cols('annual_return', 'annual_vol', 'max_drawdown', 'turnover', 'sharpe', 'calmar')} FROM q QUALIFY row_number() OVER (PARTITION BY formula_id ORDER BY sharpe DESC, every) = 1"""

QUERIES = {
    "horizon_scores": lambda s, d: rounded(H.horizon_scores(exact(s, d)[1], lineitem_panel(s, d))),
    "horizon_portfolio": lambda s, d: rounded(H.long_short(exact(s, d)[1], lineitem_panel(s, d))),
}
ORACLE = {"horizon_scores": SCORES, "horizon_portfolio": PORTFOLIO}
