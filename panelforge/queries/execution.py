"""Execution, source and streaming queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelforge.operators import alignment as A
from panelforge.operators import execution as E
from panelforge.operators import regimes as R
from panelforge.operators import scoring as S
from panelforge.plans.formula import classify, encode, safe_formula, validate
from panelforge.queries.regimes import LABELS, SHARES
from panelforge.queries.scoring import DD_SQL, LINEAR, LINEAR_SQL, PNL_SQL, PRE, W_SQL, linear, rounded
from panelforge.operators.features import NAMES
from panelforge.sources import files, synthetic
from panelforge.sources.panel import TICKERS, complete, lineitem_panel, lineitem_sql, orders_panel, orders_sql, with_returns
from panelforge.streaming import bars as B

WPRE = f"{PRE}, {LINEAR_SQL}, {W_SQL}"


def _raw(s, d):
    """Doubled rank weights with the stress share of the date."""
    p = lineitem_panel(s, d)
    shares = R.regime_shares(R.regime_labels(p, TICKERS))
    w = S.weights(linear(s, d)[1].where("formula_id = 'mix'"))
    return w.join(F.broadcast(shares), "dt").select("dt", "asset", (F.col("w") * 2).alias("w"), F.col("stress").alias("p_stress"))


def _constrained(s, d):
    return E.constrain(_raw(s, d))


def _orders(s, d):
    c = _constrained(s, d)
    before = with_returns(lineitem_panel(s, d)).select("dt", "asset").join(c, ["dt", "asset"], "left").select("dt", "asset", F.lag(F.coalesce("w", F.lit(0.0)), 1, 0.0).over(A.Window.partitionBy("asset").orderBy("dt")).alias("w"))
    return E.trades(before, c, F.lit(0.2))


CON = f"""{WPRE}, {LABELS}, {SHARES}, c0 AS (SELECT w.dt, asset, w * 2 AS w, stress AS ps, 0.4 * (1 - 0.25 * stress) AS cap FROM w JOIN sh USING (dt) WHERE formula_id = 'mix'),
c1 AS (SELECT dt, asset, ps, greatest(-cap, least(cap, w)) AS w, CASE WHEN asset IN ('SPY', 'IWM') THEN 'equity_us' WHEN asset = 'TLT' THEN 'rates' WHEN asset = 'HYG' THEN 'credit' WHEN asset IN ('GLD', 'DBC') THEN 'commodities' ELSE 'equity_em' END AS sector FROM c0 WHERE abs(greatest(-cap, least(cap, w))) >= 0.01),
c2 AS (SELECT dt, asset, ps, CASE WHEN sum(abs(w)) OVER s > 0.6 THEN w * 0.6 / sum(abs(w)) OVER s ELSE w END AS w FROM c1 WINDOW s AS (PARTITION BY dt, sector)),
c3 AS (SELECT *, sum(w) OVER (PARTITION BY dt) AS net FROM c2), c4 AS (SELECT *, sum(CASE WHEN sign(w) = sign(net) THEN abs(w) ELSE 0 END) OVER (PARTITION BY dt) AS side FROM c3),
c5 AS (SELECT dt, asset, ps, CASE WHEN abs(net) > 0.2 AND sign(w) = sign(net) AND side > 1e-6 THEN w * (1 - (abs(net) - 0.2) / side) ELSE w END AS w FROM c4),
con AS (SELECT dt, asset, CASE WHEN sum(abs(w)) OVER d > 1e-6 THEN w / sum(abs(w)) OVER d * CASE WHEN ps > 0.65 THEN least(1, 0.3 * (1 - 0.5 * (ps - 0.65) / (0.35 + 1e-8))) ELSE 1 END ELSE w END AS w FROM c5 WINDOW d AS (PARTITION BY dt))"""
SPREAD = "CASE asset " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in E.SPREADS.items()) + " ELSE 5.0 END"
ORD = f"""{CON}, hb AS (SELECT p.dt, p.asset, lag(coalesce(con.w, 0), 1, 0) OVER (PARTITION BY p.asset ORDER BY p.dt) AS w FROM p LEFT JOIN con ON con.dt = p.dt AND con.asset = p.asset),
df AS (SELECT coalesce(hb.dt, con.dt) AS dt, coalesce(hb.asset, con.asset) AS asset, coalesce(con.w, 0) - coalesce(hb.w, 0) AS change FROM hb FULL JOIN con ON con.dt = hb.dt AND con.asset = hb.asset),
od AS (SELECT dt, asset, CASE WHEN change > 0 THEN 'BUY' ELSE 'SELL' END AS side, change, abs(change) * 100000.0 AS notional, {SPREAD} / 2 * 1.4 AS cost_bps, change * CASE WHEN change > 0 THEN 1 - {SPREAD} / 2e4 ELSE 1 + {SPREAD} / 2e4 END AS fill FROM df WHERE abs(change) >= 0.005)"""
TRK = f"""{WPRE}, {PNL_SQL}, tk AS (SELECT formula_id, dt, pnl, avg(pnl) OVER w / (stddev_pop(pnl) OVER w + 1e-8) * sqrt(252.0) AS sharpe, avg((pnl > 0)::INT) OVER w AS hit_rate, count(pnl) OVER w AS n FROM pnl WINDOW w AS (PARTITION BY formula_id ORDER BY dt ROWS BETWEEN 19 PRECEDING AND CURRENT ROW))"""
GUARD = f"""{WPRE}, {PNL_SQL}, gl AS (SELECT formula_id, dt, pnl, list(pnl) OVER (PARTITION BY formula_id ORDER BY dt ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS l FROM pnl),
gx AS (SELECT formula_id, dt, pnl, unnest(range(1, len(l) + 1)) AS i, l FROM gl), gc AS (SELECT formula_id, dt, pnl, i, list_sum(l[1:i]) AS cum FROM gx),
gp AS (SELECT formula_id, dt, pnl, cum - max(cum) OVER (PARTITION BY formula_id, dt ORDER BY i ROWS UNBOUNDED PRECEDING) AS dd FROM gc), gd AS (SELECT formula_id, dt, any_value(pnl) AS pnl, least(min(dd), 0) AS drawdown FROM gp GROUP BY 1, 2)"""


def _pnl(s, d):
    return S.pnl(S.weights(linear(s, d)[1]), lineitem_panel(s, d))


def _capital(s, d):
    """Holding returns of two formulas at four intervals, as pnl per horizon."""
    p, sig = linear(s, d)
    w = S.weights(sig.where("formula_id IN ('mom', 'rev')")).join(S.forward(p, 2), ["dt", "asset"]).where("fwd is not null")
    w = w.withColumn("i", F.row_number().over(S.per_asset()) - 1)
    each = F.explode(F.array(*[F.struct(F.lit(h).alias("horizon"), F.lit(n).alias("every")) for h, n in zip(E.HORIZONS, S.REBALANCE.values(), strict=True)]))
    x = w.select("*", each.alias("x")).select("formula_id", "dt", "asset", "w", "fwd", "i", "x.*")
    o = A.Window.partitionBy("formula_id", "horizon", "asset").orderBy("dt")
    x = x.withColumn("held", F.last(F.when(F.col("i") % F.col("every") == 0, F.col("w")), True).over(o.rowsBetween(A.Window.unboundedPreceding, 0)))
    return x.groupBy(F.col("formula_id").alias("signal"), "dt", "horizon").agg(F.sum(F.col("held") * F.col("fwd")).alias("ret"))


def _bars(s, d):
    return s.read.parquet(f"{d}/events.parquet")


def _hours(s, d):
    """Greatest value of each event type and hour, known when the hour ends."""
    return _bars(s, d).groupBy("event_type", F.expr("date_trunc('hour', ts) + INTERVAL 1 HOUR").alias("ts")).agg(F.max("value").alias("value"))


def _order_days(s, d):
    return s.read.parquet(f"{d}/orders.parquet").select("o_orderkey", (F.col("o_orderkey") % 7 + 1).cast("int").alias("asset_ord"), F.col("o_orderdate").cast("date").alias("dt"))


def _sparse(s, d):
    o = s.read.parquet(f"{d}/orders.parquet")
    return o.groupBy(F.date_trunc("week", "o_orderdate").cast("date").alias("dt"), F.col("o_orderpriority").alias("asset")).agg(F.round(F.avg("o_totalprice"), 4).alias("px"))


def _formula_table(s, d):
    """The language's validators over a table of formulas, as they would arrive: pure functions of
    one string, applied where the strings are."""
    texts = ["momentum_20d", "rank(momentum_20d) - rank(volatility_20d)", "zscore(cross_momentum)", "decay(momentum_5d, halflife=10)", "lag(momentum_5d) + skew_20d", "momentum_5d * 2", "(momentum_5d - skew_20d) * rsi_7", "-momentum_5d", "__import__('os')", "a ** b", "", "unknown_feature", "rank(momentum_5d", "x" * 201, "momentum_5d / volatility_20d"]
    rows = [(t, safe_formula(t) is not None, validate(t, NAMES), classify(t) if safe_formula(t) and not validate(t, NAMES) and t != "a ** b" else None, {k: round(v, 6) for k, v in encode(t, NAMES).items()}) for t in texts]
    return s.createDataFrame(rows, "formula string, safe boolean, problem string, kind string, weights map<string,double>")


EV = "SELECT *, date_trunc('hour', ts) AS h FROM events"
QUERIES = {
    "constraints": lambda s, d: rounded(_constrained(s, d)),
    "trade_orders": lambda s, d: rounded(_orders(s, d)),
    "trade_plans": lambda s, d: rounded(E.plans(_orders(s, d))),
    "drawdown_guard": lambda s, d: rounded(E.drawdown_guard(_pnl(s, d))),
    "tracker": lambda s, d: rounded(E.tracker(_pnl(s, d))),
    "late_labels": lambda s, d: E.late_labels(R.regime_labels(lineitem_panel(s, d), TICKERS)),
    "capital_engine": lambda s, d: rounded(E.capital_engine(_capital(s, d))),
    "backtest": lambda s, d: rounded(E.backtest(_constrained(s, d), with_returns(lineitem_panel(s, d)).select("dt", "asset", "ret"))),
    "quality_report": lambda s, d: rounded(files.quality_report(_sparse(s, d), ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW", "9-NONE"])),
    "asof_backward": lambda s, d: rounded(A.asof(_bars(s, d).select("event_id", "event_type", "ts"), _hours(s, d), "ts", "value", ("event_type",))),
    "asof_nearest": lambda s, d: rounded(A.asof(_order_days(s, d), lineitem_panel(s, d).select("asset_ord", "dt", "px"), "dt", "px", ("asset_ord",), "nearest")),
    "bars_tumbling": lambda s, d: rounded(B.bars(_bars(s, d), "1 hour")),
    "bars_sliding": lambda s, d: rounded(B.bars(_bars(s, d), "2 hours", "1 hour")),
    "sessions": lambda s, d: rounded(B.sessions(_bars(s, d), "30 minutes")),
    "formula_validation": _formula_table,
    "synthetic_statistics": lambda s, d: rounded(synthetic.statistics(synthetic.gbm(s, list(TICKERS), "2020-01-01", 300))),
    "synthetic_regimes": lambda s, d: rounded(synthetic.statistics(synthetic.market(s, "garch", list(TICKERS), "2020-01-01", 300))),
    "scenario_shock": lambda s, d: rounded(synthetic.statistics(complete(synthetic.shocked(lineitem_panel(s, d), "equity_crash_30pct")))),
    "embedding_cosines": lambda s, d: rounded(A.cosine_pairs(s.read.parquet(f"{d}/embeddings.parquet").select("label", F.posexplode("embedding").alias("i", "v")).groupBy("label", "i").agg(F.avg(F.col("v").cast("double")).alias("value")), "label", "i")),
}


def _bars_sql(hours: int) -> str:
    starts = " UNION ALL ".join(f"SELECT *, h - INTERVAL {k} HOUR AS start FROM e" for k in range(hours))
    return f"""WITH e AS ({EV}), x AS ({starts}) SELECT start, start + INTERVAL {hours} HOUR AS "end", event_type, count(*) AS n, round(arg_min(value, (ts, event_id)), 6) AS open, round(max(value), 6) AS high, round(min(value), 6) AS low,
round(arg_max(value, (ts, event_id)), 6) AS close, round(sum(value), 6) AS volume FROM x GROUP BY start, event_type"""


ORACLE = {
    "constraints": f"{CON} SELECT dt, asset, round(w, 6) AS w FROM con",
    "trade_orders": f"{ORD} SELECT dt, asset, side, round(change, 6) AS change, round(notional, 6) AS notional, round(cost_bps, 6) AS cost_bps, round(fill, 6) AS fill FROM od",
    "trade_plans": f"{ORD} SELECT dt, round(sum(abs(change)), 6) AS turnover, round(sum(cost_bps * abs(change)) / (sum(abs(change)) + 1e-8), 6) AS cost_bps, count(*) FILTER (side = 'BUY') AS n_buys, count(*) FILTER (side = 'SELL') AS n_sells FROM od GROUP BY dt",
    "drawdown_guard": f"{GUARD} SELECT formula_id, dt, round(pnl, 6) AS pnl, round(drawdown, 6) AS drawdown, round(CASE WHEN drawdown >= -0.05 THEN 1 ELSE greatest(0.25, 1 - 0.5 * least(abs(drawdown) / 0.05, 2)) END::DOUBLE, 6) AS scale FROM gd",
    "tracker": f"{TRK} SELECT formula_id, dt, round(pnl, 6) AS pnl, round(sharpe, 6) AS sharpe, round(hit_rate, 6) AS hit_rate, n, n = 20 AND sharpe < -0.5 AND NOT coalesce(lag(n = 20 AND sharpe < -0.5) OVER (PARTITION BY formula_id ORDER BY dt), false) AS retrain FROM tk",
    "late_labels": f"{PRE}, {LABELS} SELECT dt, regime, lead(regime, 5) OVER (ORDER BY dt) AS actual FROM lab",
    "quality_report": f"""WITH b AS (SELECT date_trunc('week', o_orderdate)::DATE AS dt, o_orderpriority AS asset, round(avg(o_totalprice), 4) AS px FROM orders GROUP BY 1, 2), need(asset) AS (VALUES ('1-URGENT'), ('2-HIGH'), ('3-MEDIUM'), ('4-NOT SPECIFIED'), ('5-LOW'), ('9-NONE')),
g AS (SELECT asset, count(px) AS n, min(px) AS lowest, max(dt) AS last FROM b GROUP BY asset), t AS (SELECT count(DISTINCT dt) AS dates, max(dt) AS latest FROM b),
x AS (SELECT need.asset, 1 - coalesce(n, 0) / dates AS missing, lowest, last, n, latest FROM need LEFT JOIN g USING (asset) CROSS JOIN t)
SELECT asset, round(missing, 6) AS missing, round(lowest, 6) AS lowest, last, array_to_string(list_filter([CASE WHEN n IS NULL THEN 'absent' END, CASE WHEN missing > 0.05 THEN 'gaps' END, CASE WHEN lowest <= 0 THEN 'price' END, CASE WHEN latest - last > 5 THEN 'stale' END], lambda v: v IS NOT NULL), ',') AS problems FROM x""",
    "asof_backward": f"WITH e AS ({EV}), r AS (SELECT event_type, h + INTERVAL 1 HOUR AS ts, max(value) AS value FROM e GROUP BY 1, 2) SELECT l.event_id, l.event_type, l.ts, round(r.value, 6) AS value FROM e l ASOF LEFT JOIN r ON l.event_type = r.event_type AND l.ts >= r.ts",
    "asof_nearest": f"""WITH {lineitem_sql()}, r AS (SELECT asset_ord, dt, px FROM p), l AS (SELECT o_orderkey, (o_orderkey % 7 + 1)::INT AS asset_ord, o_orderdate::DATE AS dt FROM orders),
b AS (SELECT l.*, r.dt AS bt, r.px AS bp FROM l ASOF LEFT JOIN r ON l.asset_ord = r.asset_ord AND l.dt >= r.dt), n AS (SELECT b.*, r.dt AS ft, r.px AS fp FROM b ASOF LEFT JOIN r ON b.asset_ord = r.asset_ord AND b.dt <= r.dt)
SELECT o_orderkey, asset_ord, dt, round(CASE WHEN ft IS NULL OR dt - bt <= ft - dt THEN bp ELSE fp END, 6) AS px FROM n""",
    "bars_tumbling": _bars_sql(1),
    "bars_sliding": _bars_sql(2),
    "sessions": """WITH o AS (SELECT *, CASE WHEN ts - lag(ts) OVER w <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM o)
SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS "end", count(*) AS n, round(sum(value), 6) AS total FROM s GROUP BY user_id, k""",
    "embedding_cosines": """WITH e AS (SELECT label, unnest(range(len(embedding))) AS i, unnest(embedding)::DOUBLE AS v FROM embeddings), m AS (SELECT label, i, avg(v) AS v FROM e GROUP BY 1, 2), n AS (SELECT label, sqrt(sum(v * v)) AS norm FROM m GROUP BY 1)
SELECT a.label AS a, b.label AS b, round(sum(a.v * b.v) / (any_value(x.norm) * any_value(y.norm)), 6) AS cosine FROM m a JOIN m b ON a.i = b.i AND a.label < b.label JOIN n x ON x.label = a.label JOIN n y ON y.label = b.label GROUP BY 1, 2""",
}
