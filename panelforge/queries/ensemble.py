"""Queries of the adaptive ensemble: fitted on the first 70 % of the dates, judged on the others."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelforge.operators import attribution as A
from panelforge.operators import ensemble as E
from panelforge.operators import regimes as R
from panelforge.operators import scoring as S
from panelforge.operators.features import NAMES, features
from panelforge.operators.scoring import per_formula
from panelforge.plans.formula import encode, linear_signals
from panelforge.queries.regimes import BASE
from panelforge.queries.scoring import LINEAR, LINEAR_SQL, PNL_SQL, PRE, SHARPE, W_SQL, _ic_sql, _rank_sql, linear, rounded
from panelforge.sources.panel import TICKERS, lineitem_panel

TRAIN = 0.7
GIVEN = ("reversal_5d", "zscore_20d + price_accel - rsi_14", "market_corr_60d - rsi_14", "market_corr_60d", "momentum_5d", "credit_stress", "mean_rev_score")
FORMULAS = tuple(dict.fromkeys([*E.ANCHORS, *GIVEN]))


def _inputs(s, d):
    p = lineitem_panel(s, d)
    used = sorted({n for f in FORMULAS for n in encode(f, NAMES)})
    sig = linear_signals(features(p, used, TICKERS), {f: f for f in FORMULAS}, NAMES)
    labels = R.regime_labels(p, TICKERS)
    return p, sig, labels, E.split(E.log_pnl(sig, p), TRAIN)


def _fit(s, d):
    _, _, labels, pnl = _inputs(s, d)
    return E.fit(pnl.where("train"), labels, GIVEN)


def _pnl(s, d):
    _, _, labels, pnl = _inputs(s, d)
    return E.ensemble_pnl(pnl.where("not train"), labels, E.fit(pnl.where("train"), labels, GIVEN))


def _forecast(s, d):
    _, _, labels, pnl = _inputs(s, d)
    return E.forecast_pnl(pnl.where("not train"), R.regime_shares(labels), E.fit(pnl.where("train"), labels, GIVEN))


def _recent(pnl):
    """Inverse deviations over the last 60 training dates."""
    last = F.row_number().over(per_formula().orderBy(F.desc("dt")))
    return pnl.where("train").withColumn("k", last).where("k <= 60").groupBy("formula_id").agg((1 / (F.stddev_pop("pnl") + 1e-8)).alias("inv"))


def _positions(s, d):
    _, sig, labels, pnl = _inputs(s, d)
    fitted = E.fit(pnl.where("train"), labels, GIVEN)
    return E.exploded(E.positions(E.combine(sig, E.regime_shares_by_date(labels, fitted, _recent(pnl)), "portfolio")))


def _formula_positions(s, d):
    """Each formula as a portfolio of its own."""
    _, sig, _, _ = _inputs(s, d)
    shares = s.createDataFrame([(f, f, 1.0) for f in FORMULAS], "portfolio string, formula_id string, w double")
    return E.exploded(E.positions(E.combine(sig, shares, "portfolio")))


def _blended(s, d):
    _, sig, labels, pnl = _inputs(s, d)
    fitted = E.fit(pnl.where("train"), labels, GIVEN)
    return E.blended(E.exploded(E.positions(E.combine(sig, E.pools(fitted), "portfolio"))), R.regime_shares(labels))


#: Weights of the attributed portfolio.
PORTFOLIO = dict(zip(LINEAR, (0.4, 0.3, 0.2, 0.1), strict=True))


def _attribution(s, d):
    p, sig = linear(s, d)
    ic = S.ic_summary(S.ic_daily(sig, S.forward(p)))  # a row a formula
    return A.report(S.pnl(S.weights(sig), p), PORTFOLIO, {r.formula_id: r.mean_ic for r in ic.collect()})


# ---- DuckDB ----------------------------------------------------------------------------------
def _sig_sql() -> str:
    parts = []
    for f in FORMULAS:
        e = " + ".join(f"({v!r}) * coalesce({n}, 0)" for n, v in encode(f, NAMES).items())
        parts.append(f"SELECT '{f}' AS formula_id, dt, asset, asset_ord, {e} AS val FROM f")
    return "sig AS (" + " UNION ALL ".join(parts) + ")"


ORDER = ", ".join(f"('{f}', {i})" for i, f in enumerate(FORMULAS))
_IN = lambda xs: "(" + ", ".join(f"'{x}'" for x in xs) + ")"
_PTS = lambda names: " + ".join(f"{v} * contains(formula_id, '{k}')::INT" for k, v in names.items())
PNL = f"""{BASE}, {_sig_sql()}, {W_SQL},
lf AS (SELECT dt, asset, lead(lret, 2) OVER (PARTITION BY asset ORDER BY dt) AS fwd FROM p),
ep0 AS (SELECT formula_id, dt, sum(w * fwd) AS pnl FROM w JOIN lf USING (dt, asset) WHERE fwd IS NOT NULL GROUP BY ALL),
ed AS (SELECT dt, row_number() OVER (ORDER BY dt) <= floor(count(*) OVER () * {TRAIN}::DOUBLE) AS train FROM (SELECT DISTINCT dt FROM ep0)),
ep AS (SELECT * FROM ep0 JOIN ed USING (dt)), nx AS (SELECT dt, lead(regime) OVER (ORDER BY dt) AS regime FROM lab)"""
_SOFT = lambda r, part: f"CASE WHEN sum(greatest({r}, 0)) OVER {part} < 1e-8 THEN 1.0 / count(*) OVER {part} ELSE exp(greatest({r}, 0) / (max(greatest({r}, 0)) OVER {part} + 1e-8)) / sum(exp(greatest({r}, 0) / (mx_{r} + 1e-8))) OVER {part} END"
FIT = f"""{PNL}, ord(formula_id, ord) AS (VALUES {ORDER}),
st AS (SELECT formula_id, regime, count(*) AS n, {SHARPE('pnl')} AS s FROM ep JOIN nx USING (dt) WHERE train GROUP BY ALL),
f0 AS (SELECT ord.formula_id, ord, {', '.join(f"coalesce(max(CASE WHEN n > {E.LEAST_SHARPE} THEN s END) FILTER (regime = '{r}'), 0) AS {r}, coalesce(max(n) FILTER (regime = '{r}'), 0) AS n_{r}" for r in E.REGIMES)} FROM ord JOIN st USING (formula_id) GROUP BY ALL),
f1 AS (SELECT *, CASE WHEN formula_id IN {_IN(E.ANCHORS)} THEN 'calm' WHEN {_PTS(E.STRESS_NAMES)} > {_PTS(E.CALM_NAMES)} THEN 'stress' WHEN {_PTS(E.CALM_NAMES)} > 0 OR calm >= stress THEN 'calm' ELSE 'stress' END AS pool FROM f0 WHERE greatest(calm, normal, stress) >= {E.REJECT}),
f2 AS (SELECT *, row_number() OVER (PARTITION BY pool ORDER BY ord) AS place FROM f1 QUALIFY place <= CASE pool WHEN 'calm' THEN {E.CALM_POOL} ELSE {E.STRESS_POOL} END),
f3 AS (SELECT *, CASE WHEN pool = 'calm' THEN nullif(list_position({list(E.CALM_REPRESENTATIVES)}, formula_id), 0) END AS usual FROM f2),
f4 AS (SELECT *, count(usual) OVER (PARTITION BY pool) >= {E.REPRESENTATIVES} AS enough, count(*) FILTER (pool = 'stress') OVER () AS n_pool FROM f3),
f5 AS (SELECT *, pool = 'calm' AND row_number() OVER (PARTITION BY pool ORDER BY CASE WHEN enough THEN usual END NULLS LAST, (calm + normal + stress) / 3 DESC, place) <= {E.REPRESENTATIVES} AS representative,
  CASE WHEN pool = 'stress' THEN row_number() OVER (PARTITION BY pool ORDER BY stress DESC, place) = 1 ELSE n_pool = 0 AND place = 1 END AS specialist FROM f4),
f6 AS (SELECT *, {', '.join(f'max(greatest({r}, 0)) OVER g AS mx_{r}' for r in E.REGIMES)} FROM f5 WINDOW g AS (PARTITION BY representative)),
fit AS (SELECT formula_id, pool, place::INT AS place, calm, normal, stress, representative, specialist,
  {', '.join(f"CASE WHEN representative AND n_{r} >= {E.LEAST_WEIGHTS} THEN {_SOFT(r, '(PARTITION BY representative)')} END AS w_{r}" for r in E.REGIMES)},
  CASE WHEN representative THEN CASE WHEN n_calm < {E.LEAST_WEIGHTS} THEN 1.0 / count(*) OVER (PARTITION BY representative) ELSE {_SOFT('calm', '(PARTITION BY representative)')} END END AS w_forecast FROM f6)"""
_TOTAL = lambda w: f"sum(pnl * {w}) FILTER (representative)"
PARTS = f"""{FIT}, px0 AS (SELECT dt, pnl, fit.*, 1 / (stddev_pop(pnl) OVER (PARTITION BY formula_id ORDER BY dt ROWS {E.PARITY - 1} PRECEDING) + 1e-8) AS inv FROM ep JOIN fit USING (formula_id) WHERE NOT train AND (representative OR specialist)),
pt AS (SELECT dt, {', '.join(f"coalesce({_TOTAL(f'w_{r}')}, {_TOTAL('inv')} / sum(inv) FILTER (representative)) AS {r}" for r in E.REGIMES)}, {_TOTAL('w_forecast')} AS forecast,
  max(pnl) FILTER (specialist) AS specialist, sum(pnl * (representative::INT + specialist::INT)) / sum(representative::INT + specialist::INT) AS every FROM px0 GROUP BY dt)"""
FIT_COLS = ", ".join(f"round({c}, 6) AS {c}" for c in (*E.REGIMES, *(f"w_{r}" for r in E.REGIMES), "w_forecast"))
FORECAST = f"""{PARTS}, np AS (SELECT dt, coalesce(lead(calm) OVER o, 0) AS c, coalesce(lead(normal) OVER o, 1) AS n, coalesce(lead(stress) OVER o, 0) AS s FROM sh WINDOW o AS (ORDER BY dt)),
fx AS (SELECT pt.*, v.pnl AS vol, c, n, s, c + n + s + 1e-8 AS t FROM pt JOIN np USING (dt) LEFT JOIN (SELECT dt, pnl FROM ep WHERE formula_id = '{E.NORMAL_FORMULA}') v USING (dt))
SELECT dt, round({E.REGIME_SHARE} * (forecast * (c + n) / t + CASE WHEN specialist IS NOT NULL THEN specialist WHEN s / t > 0.1 THEN forecast ELSE 0 END * s / t
  + coalesce(vol * least({E.NORMAL_MOST}, greatest(0, (n / (t + 1e-8) - {E.NORMAL_FROM}) / {1 - E.NORMAL_FROM})), 0)) + {1 - E.REGIME_SHARE} * every, 6) AS pnl FROM fx"""


def _held_sql(shares: str, before: str) -> str:
    """Targets of ``shares`` (portfolio, dt, formula_id, w), walked date by date."""
    vec = "list_transform(range(1, len(h.pos) + 1), lambda i: {keep} * h.pos[i] + {new} * n.target[i])".format(keep=E.INERTIA, new=1 - E.INERTIA)
    mid = f"list_transform({vec}, lambda x: x - list_avg({vec}))"
    size = f"list_sum(list_transform({mid}, lambda x: abs(x)))"
    return f"""{before.replace('WITH ', 'WITH RECURSIVE ', 1)}, {shares},
r2 AS (SELECT formula_id, dt, asset, {_rank_sql('val', 'formula_id, dt')} AS r FROM sig), r3 AS (SELECT *, r - avg(r) OVER (PARTITION BY formula_id, dt) AS c FROM r2),
r4 AS (SELECT *, sum(abs(c)) OVER (PARTITION BY formula_id, dt) AS size FROM r3), r5 AS (SELECT formula_id, dt, asset, CASE WHEN size < 1e-8 THEN 0 ELSE c / size END AS c FROM r4),
cb AS (SELECT portfolio, dt, asset, sum(w * c) AS x FROM r5 JOIN shares USING (formula_id, dt) GROUP BY ALL), cb1 AS (SELECT *, x - avg(x) OVER (PARTITION BY portfolio, dt) AS y FROM cb),
cb2 AS (SELECT *, sum(abs(y)) OVER (PARTITION BY portfolio, dt) AS size FROM cb1),
tg AS MATERIALIZED (SELECT portfolio, dt, list(asset ORDER BY asset) AS assets, list(y / size ORDER BY asset) AS target, row_number() OVER (PARTITION BY portfolio ORDER BY dt) AS k FROM cb2 WHERE size >= 1e-8 GROUP BY portfolio, dt),
hold AS (SELECT portfolio, dt, k, assets, target AS pos FROM tg WHERE k = 1
  UNION ALL SELECT n.portfolio, n.dt, n.k, n.assets, CASE WHEN n.assets <> h.assets THEN n.target WHEN list_sum(list_transform(range(1, len(h.pos) + 1), lambda i: abs(n.target[i] - h.pos[i]))) <= {E.NO_TRADE} THEN h.pos
    WHEN {size} > 1e-8 THEN list_transform({mid}, lambda x: x / {size}) ELSE n.target END FROM hold h JOIN tg n ON n.portfolio = h.portfolio AND n.k = h.k + 1),
hp AS (SELECT portfolio, dt, unnest(assets) AS asset, unnest(pos) AS position FROM hold)"""


RECENT = """rc AS (SELECT formula_id, 1 / (stddev_pop(pnl) + 1e-8) AS inv FROM (SELECT * FROM ep WHERE train QUALIFY row_number() OVER (PARTITION BY formula_id ORDER BY dt DESC) <= 60) GROUP BY formula_id)"""
REGIME_SHARES = f"""{RECENT}, rp AS (SELECT fit.*, inv / sum(inv) OVER () AS parity FROM fit JOIN rc USING (formula_id) WHERE representative),
shares AS (SELECT 'regime' AS portfolio, dt, formula_id, coalesce(CASE regime {' '.join(f"WHEN '{r}' THEN w_{r}" for r in E.REGIMES)} END, parity) AS w FROM lab CROSS JOIN rp)"""
POOLS = f"""shares AS (SELECT 'calm' AS portfolio, dt, formula_id, coalesce(w_calm, {1 / E.REPRESENTATIVES}) AS w FROM fit CROSS JOIN lab WHERE representative UNION ALL SELECT 'stress', dt, formula_id, 1.0 FROM fit CROSS JOIN lab WHERE specialist)"""
BLENDED = f"""{_held_sql(POOLS, FIT)}, pr AS (SELECT dt, calm + normal AS c, stress AS s, CASE WHEN calm + normal + stress < 1e-8 THEN 1 ELSE calm + normal + stress END AS t FROM sh),
bl AS (SELECT dt, asset, sum(position * CASE portfolio WHEN 'calm' THEN c / t ELSE s / t END) AS x FROM hp JOIN pr USING (dt) GROUP BY ALL), bl2 AS (SELECT *, sum(abs(x)) OVER (PARTITION BY dt) AS size FROM bl)
SELECT dt, asset, round(x / size, 6) AS position FROM bl2 WHERE size >= 1e-8"""

N = len(PORTFOLIO)
ATTRIBUTION = f"""{PRE.replace('WITH ', 'WITH RECURSIVE ', 1)}, {LINEAR_SQL}, {W_SQL}, {PNL_SQL}, pw(formula_id, wt) AS (VALUES {', '.join(f"('{k}', {v}::DOUBLE)" for k, v in PORTFOLIO.items())}),
whole AS (SELECT dt FROM pnl JOIN pw USING (formula_id) GROUP BY dt HAVING count(pnl) = {N}), q AS (SELECT formula_id, wt, dt, pnl FROM pnl JOIN pw USING (formula_id) JOIN whole USING (dt)),
mu AS (SELECT *, row_number() OVER (ORDER BY formula_id) AS i FROM (SELECT formula_id, wt, avg(pnl) * 252 AS mu FROM q GROUP BY ALL)),
cv AS (SELECT a.formula_id AS a, b.formula_id AS b, a.wt AS wa, b.wt AS wb, covar_samp(a.pnl, b.pnl) * 252 AS c FROM q a JOIN q b USING (dt) GROUP BY ALL),
tot AS (SELECT sum(wa * wb * c) AS var, (SELECT sum(wt * mu) FROM mu) AS ret, (SELECT sum(wt) FROM mu) AS one FROM cv),
vec AS (SELECT a AS formula_id, sum(wb * c) AS cw, max(c) FILTER (a = b) AS own, list(c ORDER BY b) AS row FROM cv GROUP BY a),
aug AS (SELECT list(list_append(row, mu) ORDER BY i) AS m FROM vec JOIN mu USING (formula_id)),
gj AS (SELECT 1::BIGINT AS k, m FROM aug UNION ALL SELECT k + 1, list_transform(range(1, {N + 1}), lambda i: CASE WHEN i = k THEN list_transform(m[k], lambda x: x / m[k][k])
  ELSE list_transform(range(1, {N + 2}), lambda j: m[i][j] - m[i][k] * m[k][j] / m[k][k]) END) FROM gj WHERE k <= {N}),
sol AS (SELECT m FROM gj WHERE k = {N + 1}), raw AS (SELECT formula_id, wt * m[i][{N + 1}] AS raw FROM mu CROSS JOIN sol),
{_ic_sql().replace('fwd', 'nxt')}, sc AS (SELECT formula_id, avg(ic) AS s FROM ic WHERE ic IS NOT NULL GROUP BY formula_id),
att AS (SELECT mu.formula_id, wt, raw * (ret / sqrt(var)) / sum(raw) OVER () AS msc, wt * cw / var AS vs, wt * mu / ret AS rs, CASE WHEN sum(s) OVER () > 1e-8 THEN s / sum(s) OVER () ELSE 0 END AS ss,
  ((ret - wt * mu) / (one - wt)) / sqrt((var - 2 * wt * cw + wt * wt * own) / (one - wt) ** 2) AS wo, ret, sqrt(var) AS vol, ret / sqrt(var) AS sh, sum(wt * sqrt(own)) OVER () / sqrt(var) AS dr
  FROM mu JOIN vec USING (formula_id) JOIN raw USING (formula_id) LEFT JOIN sc USING (formula_id) CROSS JOIN tot)
SELECT formula_id, wt AS weight, round(msc, 6) AS msc, round(vs, 6) AS variance_share, round(rs, 6) AS return_share, round(ss, 6) AS score_share, msc < 0 AS drags, round(wo, 6) AS sharpe_without,
  round(ret, 6) AS portfolio_return, round(vol, 6) AS portfolio_volatility, round(sh, 6) AS portfolio_sharpe, round(dr, 6) AS diversification FROM att"""

QUERIES = {
    "attribution_report": lambda s, d: rounded(_attribution(s, d)),
    "ensemble_fit": lambda s, d: rounded(_fit(s, d)),
    "ensemble_pnl": lambda s, d: rounded(_pnl(s, d)),
    "forecast_pnl": lambda s, d: rounded(_forecast(s, d)),
    "ensemble_positions": lambda s, d: rounded(_positions(s, d)),
    "formula_positions": lambda s, d: rounded(_formula_positions(s, d)),
    "blended_positions": lambda s, d: rounded(_blended(s, d)),
}
ORACLE = {
    "attribution_report": ATTRIBUTION,
    "ensemble_fit": f"{FIT} SELECT formula_id, pool, place, representative, specialist, {FIT_COLS} FROM fit",
    "ensemble_pnl": f"{PARTS} SELECT dt, regime, round({E.REGIME_SHARE} * CASE WHEN regime = 'stress' AND specialist IS NOT NULL THEN specialist WHEN regime = 'calm' THEN calm WHEN regime = 'stress' THEN stress ELSE normal END + {1 - E.REGIME_SHARE} * every, 6) AS pnl FROM pt JOIN nx USING (dt)",
    "forecast_pnl": FORECAST,
    "ensemble_positions": f"{_held_sql(REGIME_SHARES, FIT)} SELECT portfolio, dt, asset, round(position, 6) AS position FROM hp",
    "formula_positions": f"{_held_sql('shares AS (SELECT DISTINCT formula_id AS portfolio, dt, formula_id, 1.0 AS w FROM sig)', PNL)} SELECT portfolio, dt, asset, round(position, 6) AS position FROM hp",
    "blended_positions": BLENDED,
}
