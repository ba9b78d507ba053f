"""Queries over component scores, rewards, closed-form costs, matches and filters."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelforge.operators import execution as E
from panelforge.operators import ledger as L
from panelforge.operators import records as K
from panelforge.operators import regimes as R
from panelforge.operators import scoring as S
from panelforge.operators.features import NAMES, features
from panelforge.plans.formula import linear_signals
from panelforge.queries.ledger import EVID, FACTS, LIFE, evidence, facts
from panelforge.queries.regimes import LABELS
from panelforge.queries.scoring import EXACT_SQL, LINEAR, LINEAR_SQL, PRE, W_SQL, _ic_sql, _pearson_sql, _rank_sql, exact, linear, rounded
from panelforge.sources import synthetic
from panelforge.sources.panel import TICKERS, lineitem_panel, lineitem_sql

NOV = "nov AS (SELECT formula_id, (length(formula_id) * 37 % 10) / 20.0 AS max_corr FROM facts GROUP BY 1)"
MSC = "(epoch * 7 % 11 - 5) / 100.0"
PRED = f"{FACTS}, pr AS (SELECT a.uid, a.ic AS predicted, b.ic AS actual FROM facts a JOIN facts b ON a.formula_id = b.formula_id AND b.epoch = a.epoch + 1)"
CAT = "CASE WHEN contains(lower(formula), 'momentum') THEN 'momentum' WHEN contains(lower(formula), 'vol') OR contains(lower(formula), 'rsi') THEN 'volatility' WHEN contains(lower(formula), 'regime') THEN 'regime' WHEN contains(lower(formula), 'zscore') THEN 'mean_reversion' WHEN contains(lower(formula), 'relative') THEN 'cross_asset' END"
CATS = "CASE hypothesis WHEN 'h0' THEN 'momentum' WHEN 'h1' THEN 'volatility' WHEN 'h2' THEN 'momentum' WHEN 'h3' THEN 'regime' WHEN 'h4' THEN 'mean_reversion' ELSE 'cross_asset' END"
CT = ", ".join(f"('{k}', {a}, {b}, {c})" for k, (a, b, c) in S.COSTS.items())
SOME = "['rank(momentum_20d)', 'volatility_20d', 'rsi_14 - zscore_20d', 'regime_signal', 'zscore(x)', 'relative_strength', 'px', 'Momentum_5d + vol_ratio']"


def novelty(s, d):
    return facts(s, d).select("formula_id").distinct().withColumn("max_corr", (F.length("formula_id") * 37 % 10) / 20.0)


def predictions(s, d):
    f = facts(s, d)
    return f.alias("a").join(f.alias("b"), F.expr("a.formula_id = b.formula_id AND b.epoch = a.epoch + 1")).select("a.uid", F.col("a.ic").alias("predicted"), F.col("b.ic").alias("actual"))


def _match(s, d):
    f = s.sql(f"SELECT explode(array({SOME[1:-1]})) AS formula")
    h = L.hypotheses(evidence(s, d)).select("hypothesis", "confidence", F.expr(CATS).alias("category"))
    return K.matched(f, h)


def _combine(s, d):
    w = s.createDataFrame([("mom", 0.6), ("mix", 0.4)], "formula_id string, weight double")
    return K.combined(linear(s, d)[1], w)


def _brier(s, d):
    o = s.read.parquet(f"{d}/orders.parquet")
    return E.brier(o.select(((F.col("o_orderkey") * 7919) % 1000 / 1000.0).cast("double").alias("p"), (F.col("o_custkey") % 2).cast("double").alias("outcome")))


def _clusters(s, d):
    pairs = S.pairwise_correlation(linear(s, d)[1], "formula_id", ["dt", "asset"], "val")
    labels = s.createDataFrame([(k, i % 2) for i, k in enumerate(sorted(LINEAR))], "formula_id string, cluster int")
    return K.cluster_statistics(pairs, labels)


def _report(s, d):
    p = lineitem_panel(s, d)
    names = ["momentum_20d", "volatility_20d", "reversal_5d", "zscore_20d", "price_accel", "rsi_14"]

    def pnl_of(panel):
        return S.pnl(S.weights(linear_signals(features(panel, names, TICKERS), LINEAR, NAMES)), panel)

    return K.scenario_report(p, synthetic.shocked(p, "stagflation"), pnl_of)


def _by_regime(s, d):
    p = lineitem_panel(s, d)
    ic = S.ic_daily(exact(s, d)[1], S.forward(p)).join(R.regime_labels(p, TICKERS), "dt")
    return K.regime_component(ic.select("formula_id", "regime", "ic"))


#: Every history of every epoch with its mean as one more value, then the walk over states.
REWARDS = f"""WITH RECURSIVE {FACTS}, {NOV},
h0 AS (SELECT formula_id, epoch, ic, row_number() OVER (PARTITION BY formula_id ORDER BY epoch) AS k FROM facts),
hist AS (SELECT a.formula_id, a.epoch, a.k, b.k - 1 AS t, b.ic FROM h0 a JOIN h0 b ON b.formula_id = a.formula_id AND b.k <= a.k),
plain AS (SELECT formula_id, epoch, k, avg(ic) AS m, stddev_pop(ic) AS s FROM hist GROUP BY ALL),
more AS (SELECT formula_id, k, t, ic FROM hist UNION ALL SELECT formula_id, k, k, m FROM plain WHERE m <> 0),
fits AS (SELECT formula_id, k, count(*) AS n, avg((ic > 0)::INT) AS stable, CASE WHEN count(*) FILTER (abs(ic) > 1e-8) >= 4 THEN -regr_slope(CASE WHEN abs(ic) > 1e-8 THEN ln(abs(ic)) END, t::DOUBLE) END AS rate FROM more GROUP BY ALL),
h1 AS MATERIALIZED (SELECT *, m AS mean, coalesce(rate > ln(2) / 10, false) AS falling FROM plain JOIN fits USING (formula_id, k)),
{LIFE[LIFE.index('life AS'):].replace('h1.k >= 3', 'n >= 3')},
parts AS (SELECT h1.*, state, CASE state {' '.join(f"WHEN '{k}' THEN {v}" for k, v in L.MULTIPLIERS.items())} END::DOUBLE AS multiplier, 1 - exp(-greatest(mean, 0) / 0.05) AS ic,
  CASE WHEN s > 0 THEN 1 - exp(-greatest(mean / (s + 1e-6), 0)) ELSE 0 END AS stability, CASE WHEN n < 4 THEN 0.5 WHEN rate IS NULL OR rate <= 0 THEN 1 ELSE least(1, ln(2) / rate / 30) END::DOUBLE AS decay,
  (1 - max_corr)::DOUBLE AS novelty FROM h1 JOIN life USING (formula_id, k) JOIN nov USING (formula_id)),
summed AS (SELECT *, (0.5 * stable + 0.25 * least(n / 20, 1) + 0.15 * 0.5 + 0.1) * multiplier AS capacity, 0.4 * ic + 0.2 * stability + 0.15 * decay + 0.15 * novelty + 0.1 * (0.5 * stable + 0.25 * least(n / 20, 1) + 0.175) * multiplier AS composite FROM parts),
smooth AS (SELECT formula_id, list_reduce(list((composite * multiplier)::DOUBLE ORDER BY k), lambda a, v: 0.8 * a + 0.2 * v) AS smoothed FROM summed GROUP BY 1)
SELECT formula_id, epoch, state, multiplier, {', '.join(f'round({x}, 6)::DOUBLE AS {x}' for x in ('ic', 'stability', 'decay', 'novelty', 'capacity', 'composite'))}, round(composite * multiplier, 6)::DOUBLE AS reward, round(smoothed, 6)::DOUBLE AS smoothed
FROM summed JOIN smooth USING (formula_id) QUALIFY row_number() OVER (PARTITION BY formula_id ORDER BY k DESC) = 1"""

QUERIES = {
    "signal_rewards": lambda s, d: rounded(K.signal_rewards(facts(s, d), novelty(s, d))),
    "regime_component": lambda s, d: rounded(_by_regime(s, d)),
    "component_scores": lambda s, d: rounded(K.component_scores(facts(s, d), novelty(s, d))),
    "recent_slope": lambda s, d: rounded(K.recent_slope(facts(s, d))),
    "research_rewards": lambda s, d: rounded(K.rewards(facts(s, d).withColumn("msc", F.expr(MSC).cast("double")))),
    "meta_scores": lambda s, d: rounded(K.meta_scores(predictions(s, d))),
    "round_trip_costs": lambda s, d: rounded(K.round_trips(s, 1e6)),
    "annual_drag": lambda s, d: rounded(K.annual_drag(s.createDataFrame([(t,) for t in (*TICKERS, "ZZZ")], "asset string"), 0.2, [1e3, 1e4, 1e5, 1e6])),
    "hypothesis_matching": lambda s, d: _match(s, d),
    "strategy_combine": lambda s, d: rounded(_combine(s, d)),
    "regime_returns": lambda s, d: rounded(K.in_regime(lineitem_panel(s, d), R.regime_labels(lineitem_panel(s, d), TICKERS), "normal")),
    "position_table": lambda s, d: rounded(K.position_table(S.weights(linear(s, d)[1].where("formula_id = 'mix'")))),
    "library_capacity": lambda s, d: rounded(K.library_capacity(facts(s, d))),
    "brier_calibration": lambda s, d: rounded(_brier(s, d)),
    "cluster_statistics": lambda s, d: rounded(_clusters(s, d)),
    "scenario_report": lambda s, d: rounded(_report(s, d)),
}
_C = lambda *n: ", ".join(f"round({x}, 6) AS {x}" for x in n)
ORACLE = {
    "signal_rewards": REWARDS,
    "regime_component": f"""{PRE}, {EXACT_SQL}, {_ic_sql()}, {LABELS}, br AS (SELECT formula_id, regime, avg(ic) AS m FROM ic JOIN lab USING (dt) WHERE ic IS NOT NULL GROUP BY ALL HAVING count(*) >= 3)
SELECT formula_id, count(m) AS regimes, CASE WHEN count(m) > 1 THEN round(min(m), 6) END AS worst, CASE WHEN count(m) > 1 THEN round(1 - exp(-greatest(min(m), 0) / 0.05), 6) ELSE 0.5 END::DOUBLE AS score FROM (SELECT DISTINCT formula_id FROM ic) LEFT JOIN br USING (formula_id) GROUP BY 1""",
    "component_scores": f"""WITH {FACTS}, {NOV}, t AS (SELECT formula_id, ic, (row_number() OVER (PARTITION BY formula_id ORDER BY epoch) - 1)::DOUBLE AS t, ln(greatest(abs(ic), 1e-6)) AS y FROM facts),
g AS (SELECT formula_id, avg(ic) AS m, stddev_samp(ic) AS s, count(*) AS n, avg((ic > 0)::INT) AS pos, regr_slope(y, t) AS slope FROM t GROUP BY 1),
c AS (SELECT formula_id, greatest(0, least(1, 1 - exp(-greatest(m, 0) / 0.05))) AS ic, greatest(0, least(1, 1 - exp(-greatest(coalesce(m / nullif(s, 0), 0), 0)))) AS stability,
  CASE WHEN n < 4 THEN 0.5 WHEN coalesce(slope >= 0, true) THEN 1.0 ELSE greatest(0, least(1, ln(2.0) / -slope / 30.0)) END::DOUBLE AS decay, greatest(0, least(1, 1 - abs(max_corr)))::DOUBLE AS novelty,
  greatest(0, least(1, 0.5 * pos + 0.25 * least(n / 20, 1) + 0.1)) AS capacity FROM g JOIN nov USING (formula_id))
SELECT formula_id, {_C('ic', 'stability', 'decay', 'novelty', 'capacity')}, round(0.4 * ic + 0.2 * stability + 0.15 * decay + 0.15 * novelty + 0.1 * capacity, 6) AS total FROM c""",
    "recent_slope": f"WITH {FACTS}, k AS (SELECT *, row_number() OVER (PARTITION BY formula_id ORDER BY epoch DESC) AS k FROM facts) SELECT formula_id, round(regr_slope(ic, -k), 6) AS slope, count(*) AS n FROM k WHERE k <= 8 GROUP BY 1",
    "research_rewards": f"""WITH {FACTS}, g AS (SELECT uid, greatest(avg(ic), 0) AS ic, greatest(avg({MSC}), 0) AS msc FROM facts GROUP BY uid), r AS (SELECT *, CASE WHEN sum(0.6 * ic + 0.4 * msc) OVER () > 1e-8 THEN (0.6 * ic + 0.4 * msc) / sum(0.6 * ic + 0.4 * msc) OVER () ELSE 1.0 / count(*) OVER () END AS reward FROM g)
SELECT uid, round(ic, 6) AS ic, round(msc, 6) AS msc, round(reward, 6) AS reward, (row_number() OVER (ORDER BY round(reward, 10) DESC, uid))::INT AS place FROM r""",
    "meta_scores": f"WITH {PRED}, rk AS (SELECT uid, predicted, actual, {_rank_sql('predicted', 'uid')} AS rp, {_rank_sql('actual', 'uid')} AS ra FROM pr) SELECT uid, round({_pearson_sql('rp', 'ra', '1e-12')}, 6) AS rank_corr, round(avg((sign(predicted) = sign(actual))::INT), 6) AS direction, count(*) AS n FROM rk GROUP BY uid",
    "round_trip_costs": f"WITH ct(asset, spread_bps, eta, adv_bn) AS (VALUES {CT}) SELECT asset, round(spread_bps + 2 * eta * 0.01 * sqrt(1e6 * 0.05 / (adv_bn * 1e9)) * 1e4, 6)::DOUBLE AS bps FROM ct",
    "annual_drag": f"""WITH ct(asset, spread_bps, eta, adv_bn) AS (VALUES {CT}), u AS (SELECT unnest(['SPY','TLT','HYG','EEM','GLD','DBC','IWM','ZZZ']) AS asset), m AS (SELECT avg(coalesce(spread_bps, 5.0)) AS s, avg(coalesce(eta, 0.15)) AS e, avg(coalesce(adv_bn, 0.2)) AS a, count(*) AS n FROM u LEFT JOIN ct USING (asset)),
c AS (SELECT unnest([1e3, 1e4, 1e5, 1e6]) AS capital) SELECT capital, round(0.2 * (s / 2e4 + e * 0.01 * sqrt(capital * 0.2 / n / (a * 1e9))) * 252, 6) AS drag FROM m CROSS JOIN c""",
    "hypothesis_matching": f"""WITH {EVID}, hy AS (SELECT hypothesis, (1 + sum((ic > 0.02)::INT)) / (2 + count(*)) AS confidence FROM evid GROUP BY 1), hc AS (SELECT *, {CATS} AS category FROM hy), b AS (SELECT category, arg_max(hypothesis, (confidence, hypothesis)) AS hypothesis FROM hc GROUP BY 1),
f AS (SELECT unnest({SOME}) AS formula), fc AS (SELECT formula, {CAT} AS category FROM f) SELECT fc.formula, fc.category, b.hypothesis FROM fc LEFT JOIN b USING (category)""",
    "strategy_combine": f"{PRE}, {LINEAR_SQL}, wt(formula_id, weight) AS (VALUES ('mom', 0.6), ('mix', 0.4)) SELECT dt, asset, round(sum(weight * val), 6) AS val FROM sig JOIN wt USING (formula_id) WHERE val IS NOT NULL GROUP BY 1, 2 HAVING count(*) = 2",
    "regime_returns": f"{PRE}, {LABELS} SELECT dt, asset, round(px / lag(px) OVER (PARTITION BY asset ORDER BY dt) - 1, 6) AS ret FROM p WHERE dt IN (SELECT dt FROM lab WHERE regime = 'normal')",
    "position_table": f"{PRE}, {LINEAR_SQL}, {W_SQL} SELECT asset, round(w, 6) AS w, CASE WHEN w > 0 THEN 'LONG' WHEN w < 0 THEN 'SHORT' ELSE 'FLAT' END AS side, (row_number() OVER (ORDER BY round(abs(w), 10) DESC, asset))::INT AS place FROM w WHERE formula_id = 'mix' AND dt = (SELECT max(dt) FROM w)",
    "library_capacity": f"WITH {FACTS}, g AS (SELECT formula_id, avg(ic) AS m, stddev_samp(ic) AS s, avg((ic > 0)::INT) AS pos FROM facts GROUP BY 1) SELECT formula_id, round(greatest(0.05, least(1, greatest(0, least(m / 0.1, 1)) * greatest(0, least(coalesce(m / nullif(s, 0), 0), 1)) * pos))::DOUBLE, 6) AS capacity FROM g",
    "brier_calibration": "WITH o AS (SELECT ((o_orderkey * 7919) % 1000 / 1000.0)::DOUBLE AS p, (o_custkey % 2)::DOUBLE AS outcome FROM orders) SELECT least(floor(p * 10), 9)::INT AS decile, round(avg((p - outcome) ** 2), 6) AS brier, round(avg(p), 6) AS p, round(avg(outcome), 6) AS outcome, count(*) AS n FROM o GROUP BY 1",
    "cluster_statistics": f"""{PRE}, {LINEAR_SQL}, cl(formula_id, cluster) AS (VALUES {', '.join(f"('{k}', {i % 2})" for i, k in enumerate(sorted(LINEAR)))}),
pc AS (SELECT a.formula_id AS a, b.formula_id AS b, {_pearson_sql('a.val', 'b.val', '1e-15')} AS corr FROM sig a JOIN sig b ON a.dt = b.dt AND a.asset = b.asset AND a.formula_id < b.formula_id GROUP BY 1, 2),
j AS (SELECT corr, x.cluster AS ca, y.cluster AS cb FROM pc JOIN cl x ON x.formula_id = pc.a JOIN cl y ON y.formula_id = pc.b), h AS (SELECT sum(n * n) / sum(n) ** 2 AS hhi FROM (SELECT count(*) AS n FROM cl GROUP BY cluster))
SELECT round(avg(abs(corr)) FILTER (ca = cb), 6) AS within, round(avg(abs(corr)) FILTER (ca <> cb), 6) AS between, round(any_value(hhi), 6) AS hhi FROM j CROSS JOIN h""",
}
