"""Ledger queries.  Their inputs are derived from orders, customers, parts and events by
arithmetic on keys, so that both engines can build them."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelforge.operators import alignment as A
from panelforge.operators import ledger as L
from panelforge.operators import scoring as S
from panelforge.queries.scoring import rounded
from panelforge.sources.panel import TICKERS, lineitem_panel, lineitem_sql, with_returns

EPOCH = "CAST(year(o_orderdate) * 12 + month(o_orderdate) AS BIGINT)"
FACTS = f"""facts AS (SELECT 'f' || (o_orderkey % 50) AS formula_id, {EPOCH} AS epoch, min(o_custkey % 20) AS uid, CAST(sum((o_orderkey * 7919 + o_custkey * 31) % 2000) AS DOUBLE) / CAST(count(*) AS DOUBLE) / 1e4 - 8e-2 AS ic FROM orders GROUP BY 1, 2)"""
SCORES = f"scores AS (SELECT o_custkey % 20 AS uid, {EPOCH} AS epoch, CAST(sum((o_orderkey * 7919) % 1000) AS DOUBLE) / CAST(count(*) AS DOUBLE) / 1e3 + CASE WHEN {EPOCH} % 17 = 0 THEN 8e-1 ELSE 0e0 END AS score FROM orders GROUP BY 1, 2)"
ROLES = "CASE uid % 5 WHEN 0 THEN 'signal' WHEN 1 THEN 'strategy' WHEN 2 THEN 'risk' WHEN 3 THEN 'portfolio' ELSE 'meta' END"
SUBS = f"subs AS (SELECT o_custkey % 20 AS uid, {EPOCH} AS epoch, CASE WHEN o_orderkey % 11 = 0 THEN '__import__(os)' WHEN o_orderkey % 13 = 0 THEN '' WHEN o_orderkey % 17 = 0 THEN 'a;b' ELSE ' rank(momentum_' || (o_orderkey % 7 * 5 + 5) || 'd) ' END AS formula FROM orders)"
LINKS = "links AS (SELECT DISTINCT 'f' || (o_orderkey % 50) AS formula_id, 'h' || (o_custkey % 9) AS hypothesis FROM orders WHERE o_orderkey % 50 < 40 AND o_custkey % 9 < 7 AND o_custkey % 4 = 1 AND o_orderkey % 3 = 0)"
#: States of all formulas after every epoch, as a recursive walk over their histories.
LIFE = f"""WITH RECURSIVE {FACTS},
h0 AS (SELECT formula_id, epoch, ic, row_number() OVER (PARTITION BY formula_id ORDER BY epoch) AS k FROM facts),
h1 AS (SELECT formula_id, epoch, k, avg(ic) OVER w AS mean, avg((ic > 0)::INT) OVER w AS stable,
  count(*) FILTER (abs(ic) > 1e-8) OVER w >= 4 AND coalesce(-regr_slope(CASE WHEN abs(ic) > 1e-8 THEN ln(abs(ic)) END, k::DOUBLE) OVER w > ln(2) / 10, false) AS falling
  FROM h0 WINDOW w AS (PARTITION BY formula_id ORDER BY epoch ROWS UNBOUNDED PRECEDING)),
life AS (SELECT DISTINCT formula_id, 0::BIGINT AS k, 0::BIGINT AS epoch, 'EXPERIMENTAL' AS state, 0 AS d FROM facts
  UNION ALL
  SELECT formula_id, k, epoch, state, CASE WHEN state = 'DECAYING' THEN d + 1 ELSE 0 END FROM (
    SELECT h1.formula_id, h1.k, h1.epoch, d, CASE
      WHEN h1.k >= 3 AND mean < 0.005 THEN 'RETIRED'
      WHEN state = 'DECAYING' AND d >= 5 THEN 'RETIRED'
      WHEN state = 'EXPERIMENTAL' AND h1.k >= 3 AND mean >= 0.01 THEN 'VALIDATED'
      WHEN state IN ('VALIDATED', 'PRODUCTION') AND (falling OR stable < 0.35) THEN 'DECAYING'
      WHEN state = 'VALIDATED' AND stable >= 0.6 THEN 'PRODUCTION'
      WHEN state = 'DECAYING' AND stable >= 0.5 AND NOT falling THEN 'VALIDATED'
      ELSE state END AS state
    FROM life JOIN h1 ON h1.formula_id = life.formula_id AND h1.k = life.k + 1))"""
POS = "pos AS (SELECT user_id % 15 AS uid, 's' || (event_id % 6) AS signal, CASE WHEN (event_id * 7 + user_id) % 3 = 0 THEN 'SHORT' ELSE 'LONG' END AS direction, event_id % 12 / 10.0 AS stake, event_id % 7 / 10.0 + 0.4 AS confidence FROM events)"
ACTUAL = "actual AS (SELECT DISTINCT 's' || (event_id % 6) AS signal, (event_id % 6 % 3 - 1) * 0.05 AS actual_ic FROM events)"
PROP = "prop AS (SELECT c_custkey % 6 AS validator, CASE c_custkey % 3 WHEN 0 THEN 'signal' WHEN 1 THEN 'risk' ELSE 'meta' END AS role, c_custkey % 13 AS uid, sum(c_custkey % 29 + 1) * 1.0 AS v FROM customer GROUP BY 1, 2, 3)"


def views(spark, d, *names: str):
    """Run one of the input expressions in Spark (the same text that the oracle gets)."""
    for t in ("orders", "events", "customer", "part"):
        spark.read.parquet(f"{d}/{t}.parquet").createOrReplaceTempView(t)
    out = [spark.sql(f"WITH {SQL[n]} SELECT * FROM {n}") for n in names]
    return out if len(out) > 1 else out[0]


SQL = {"facts": FACTS, "scores": SCORES, "subs": SUBS, "links": LINKS, "pos": POS, "actual": ACTUAL, "prop": PROP}


def dbl(df, *cols):
    return df.select(*[F.col(c).cast("double").alias(c) if c in cols else F.col(c) for c in df.columns])


def facts(s, d):
    return dbl(views(s, d, "facts"), "ic")


def scores(s, d):
    return dbl(views(s, d, "scores"), "score")


def pos(s, d):
    return L.open_positions(dbl(views(s, d, "pos"), "stake", "confidence"))


def actual(s, d):
    return dbl(views(s, d, "actual"), "actual_ic")


def submissions(s, d):
    return views(s, d, "subs").groupBy("uid", "epoch").agg(F.array_sort(F.collect_list("formula")).alias("formulas"))


def role_scores(s, d):
    return scores(s, d).groupBy("uid").agg(F.avg("score").alias("score")).select(F.expr(ROLES).alias("role"), "uid", "score")


def proposals(s, d):
    p = views(s, d, "prop").withColumn("w", F.col("v").cast("double") / F.sum(F.col("v").cast("double")).over(A.Window.partitionBy("validator", "role")))
    g = p.groupBy("validator", "role").agg(F.map_from_entries(F.collect_list(F.struct("uid", "w"))).alias("weights"))
    return g.withColumn("stake", (F.col("validator") + 1) / 10.0)


PROP2 = f"{PROP}, pw AS (SELECT validator, role, uid, v / sum(v) OVER (PARTITION BY validator, role) AS w, (validator + 1) / 10.0 AS stake FROM prop), agreed AS (SELECT role, uid, x / sum(x) OVER (PARTITION BY role) AS weight FROM (SELECT role, uid, sum(w * stake) AS x FROM pw GROUP BY 1, 2))"
RS = f"{SCORES}, rs AS (SELECT {ROLES} AS role, uid, avg(score) AS score FROM scores GROUP BY uid)"
BUD = "CASE role WHEN 'signal' THEN 0.30 WHEN 'strategy' THEN 0.25 WHEN 'risk' THEN 0.20 WHEN 'portfolio' THEN 0.15 ELSE 0.10 END"
REW = f"rew AS (SELECT role, uid, e / sum(e) OVER (PARTITION BY role) * {BUD} / (SELECT sum({BUD}) FROM (SELECT DISTINCT role FROM rs)) AS reward FROM (SELECT *, exp(score - max(score) OVER (PARTITION BY role)) AS e FROM rs))"
SAN = f"{SUBS}, ranked AS (SELECT uid, epoch, trim(formula) AS formula FROM (SELECT *, row_number() OVER (PARTITION BY uid, epoch ORDER BY formula) AS n FROM subs) WHERE n <= 32), san AS (SELECT * FROM ranked WHERE length(formula) BETWEEN 1 AND 200 AND regexp_matches(lower(formula), '^[a-z0-9_()+\\-*/.,=% ]+$') AND NOT contains(formula, '__'))"
OPEN = f"{POS}, op AS (SELECT uid, signal, direction, least(greatest(stake, 0), 1) AS stake, least(greatest(confidence, 0.5), 1) AS confidence FROM pos WHERE stake >= 1e-6)"
TRUST = f"{SCORES}, tr AS (SELECT uid, epoch, score, list_reduce(list(score::DOUBLE) OVER (PARTITION BY uid ORDER BY epoch ROWS UNBOUNDED PRECEDING), lambda a, x: a * 0.9 + x * 0.1) AS trust FROM scores)"
PRICE = "price AS (SELECT signal, sum(stake * confidence * CASE direction WHEN 'LONG' THEN 1 ELSE -1 END) / sum(stake) AS price, avg((direction = 'LONG')::INT) AS bullish, sum(stake) AS stake FROM op GROUP BY signal)"
SETTLED = f"{ACTUAL}, settled AS (SELECT uid, signal, (actual_ic > 0) = (direction = 'LONG') AS correct, CASE WHEN (actual_ic > 0) = (direction = 'LONG') THEN 2 * confidence - 1 ELSE 1 - 2 * confidence END AS pnl FROM op JOIN actual USING (signal))"
EVID = f"{FACTS}, {LINKS}, evid AS (SELECT hypothesis, formula_id, epoch, ic FROM links JOIN facts USING (formula_id))"
UNIT = "positions AS (SELECT c_custkey % 20 AS uid, (['SPY','TLT','HYG','EEM','GLD','DBC','IWM'])[(c_custkey % 7 + 1)::INT] AS asset, sum(c_custkey % 11 - 5) * 1.0 AS w FROM customer GROUP BY 1, 2)"


def evidence(s, d):
    return L.propagate(views(s, d, "links"), facts(s, d))


def positions(s, d):
    c = s.read.parquet(f"{d}/customer.parquet")
    tick = F.element_at(F.array(*map(F.lit, TICKERS)), (F.col("c_custkey") % 7 + 1).cast("int"))
    return c.groupBy((F.col("c_custkey") % 20).alias("uid"), tick.alias("asset")).agg(F.sum(F.col("c_custkey") % 11 - 5).cast("double").alias("w"))


def _capital(s, d):
    p = with_returns(lineitem_panel(s, d))
    last = p.where(F.col("lret").isNotNull()).withColumn("n", F.dense_rank().over(A.Window.partitionBy("asset").orderBy(F.desc("dt")))).where("n <= 20").select("dt", "asset", "lret")
    t = L.trust(scores(s, d)).groupBy("uid").agg(F.max_by("trust", "epoch").alias("trust"))
    return L.capital_feedback(t, positions(s, d), last)


def _vectors(s, d):
    return positions(s, d).select("uid", "asset", F.col("w").alias("value"))


COS = f"{UNIT}, nn AS (SELECT uid, sqrt(sum(w * w)) AS norm FROM positions GROUP BY uid), cos AS (SELECT a.uid AS a, b.uid AS b, sum(a.w * b.w) / nullif(any_value(na.norm) * any_value(nb.norm), 0) AS cosine FROM positions a JOIN positions b ON a.asset = b.asset AND a.uid < b.uid JOIN nn na ON na.uid = a.uid JOIN nn nb ON nb.uid = b.uid GROUP BY 1, 2)"

QUERIES = {
    "formula_ids": lambda s, d: views(s, d, "subs").select("formula").distinct().select(F.trim("formula").alias("formula"), L.formula_id("formula").alias("id"), L.hypothesis_id("formula").alias("hid"), F.substring(F.md5("formula"), 1, 8).alias("cache_key")).distinct(),
    "submissions_sanitised": lambda s, d: L.sanitised(submissions(s, d)).groupBy("uid", "epoch", "formula").agg(F.count("*").alias("n")),
    "submissions_first": lambda s, d: L.first_submitters(L.sanitised(submissions(s, d))),
    "payload_validation": lambda s, d: proposals(s, d).select("validator", "role", L.valid_weights("weights").alias("valid"), F.size("weights").alias("n")),
    "role_rewards": lambda s, d: rounded(L.role_rewards(role_scores(s, d))),
    "aligned_weights": lambda s, d: rounded(L.aligned_weights(L.role_rewards(role_scores(s, d)), s.read.parquet(f"{d}/customer.parquet").select((F.col("c_custkey") % 25).alias("uid")))),
    "leaderboard": lambda s, d: rounded(L.leaderboard(facts(s, d))),
    "leaderboard_top": lambda s, d: rounded(L.leaderboard(facts(s, d)).orderBy(F.desc("mean_ic"), "formula_id").limit(10)),
    "concentration": lambda s, d: rounded(L.concentration(facts(s, d))),
    "eviction": lambda s, d: L.evict(A.last_n(L.lifecycle(facts(s, d)), "formula_id", "epoch", 1).select("formula_id", F.col("epoch").alias("last_epoch"), "state"), 20),
    "last_n_history": lambda s, d: A.last_n(facts(s, d), "formula_id", "epoch", 5),
    "trust_ema": lambda s, d: rounded(L.trust(scores(s, d))),
    "spike_penalty": lambda s, d: rounded(L.spike_penalty(L.trust(scores(s, d)))),
    "weight_cosines": lambda s, d: rounded(A.cosine_pairs(_vectors(s, d), "uid", "asset")),
    "diversity_penalty": lambda s, d: rounded(L.diversity_penalty(A.cosine_pairs(_vectors(s, d), "uid", "asset"), _vectors(s, d))),
    "capital_feedback": lambda s, d: rounded(_capital(s, d)),
    "lifecycle": lambda s, d: L.lifecycle(facts(s, d)),
    "lifecycle_counts": lambda s, d: A.last_n(L.lifecycle(facts(s, d)), "formula_id", "epoch", 1).groupBy("state").agg(F.count("*").alias("n")),
    "retire_rule": lambda s, d: rounded(L.retire_rule(facts(s, d))),
    "decay_fit": lambda s, d: rounded(S.decay_fit(facts(s, d).withColumn("t", (F.col("epoch") - 23904).cast("double")), "formula_id")),
    "hypothesis_update": lambda s, d: rounded(L.hypotheses(evidence(s, d))),
    "hypothesis_interval": lambda s, d: rounded(L.beta_interval(L.hypotheses(evidence(s, d)))),
    "graph_propagation": lambda s, d: evidence(s, d),
    "knowledge_degrees": lambda s, d: L.knowledge(views(s, d, "links"), facts(s, d), s.range(9).select(F.concat(F.lit("h"), F.col("id")).alias("hypothesis"))),
    "shared_formulas": lambda s, d: L.shared_formulas(views(s, d, "links")),
    "evolution_tree": lambda s, d: A.ancestors(s, s.read.parquet(f"{d}/part.parquet").where("p_partkey > 1").select(F.col("p_partkey").alias("child"), F.floor(F.col("p_partkey") / 2).alias("parent"))),
    "market_price": lambda s, d: rounded(L.market_price(pos(s, d))),
    "settlement": lambda s, d: rounded(L.settle(pos(s, d), actual(s, d)).groupBy("uid", "signal", "correct").agg(F.sum("pnl").alias("pnl"), F.count("*").alias("n"))),
    "market_rewards": lambda s, d: rounded(L.market_rewards(L.settle(pos(s, d), actual(s, d)))),
    "market_blend": lambda s, d: rounded(L.market_blend(actual(s, d).select("signal", F.col("actual_ic").alias("ic")), L.market_price(pos(s, d)))),
    "consensus": lambda s, d: rounded(L.consensus(proposals(s, d), s.createDataFrame([], "validator long, credibility double"))),
    "consensus_divergence": lambda s, d: rounded(L.divergence(proposals(s, d), L.consensus(proposals(s, d), s.createDataFrame([], "validator long, credibility double")))),
    "pending_predictions": lambda s, d: rounded(facts(s, d).alias("a").join(facts(s, d).alias("b"), F.expr("a.formula_id = b.formula_id AND b.epoch = a.epoch + 1")).select("a.formula_id", "a.epoch", F.col("a.ic").alias("predicted"), F.col("b.ic").alias("actual"), (F.signum("a.ic") == F.signum("b.ic")).alias("right"))),
    "trigram_similarity": lambda s, d: rounded(s.read.parquet(f"{d}/benchmark.parquet").alias("a").join(s.read.parquet(f"{d}/benchmark.parquet").alias("b"), F.expr("b.item_id = a.item_id + 1")).select(F.col("a.item_id").alias("item_id"), A.trigram_similarity(F.col("a.text"), F.col("b.text")).alias("similarity"))),
}
_TRI = lambda t: f"list_distinct(list_transform(range(1, greatest(length({t}) - 1, 2)), lambda i: substr(lower({t}), i, 3)))"
ORACLE = {
    "formula_ids": f"WITH {SUBS} SELECT DISTINCT trim(formula) AS formula, substr(sha256(trim(formula)), 1, 12) AS id, substr(sha256(lower(trim(formula))), 1, 12) AS hid, substr(md5(formula), 1, 8) AS cache_key FROM subs",
    "submissions_sanitised": f"WITH {SAN} SELECT uid, epoch, formula, count(*) AS n FROM san GROUP BY ALL",
    "submissions_first": f"WITH {SAN} SELECT epoch, substr(sha256(formula), 1, 12) AS id, min(uid) AS uid, any_value(formula) AS formula, count(*) AS copies FROM san GROUP BY 1, 2",
    "payload_validation": f"WITH {PROP2} SELECT validator, role, count(*) > 0 AND min(w) >= 0 AND abs(sum(w) - 1) <= 0.02 AS valid, count(*)::INT AS n FROM pw GROUP BY 1, 2",
    "role_rewards": f"WITH {RS}, {REW} SELECT role, uid, round(reward, 6) AS reward FROM rew",
    "aligned_weights": f"WITH {RS}, {REW}, un AS (SELECT DISTINCT c_custkey % 25 AS uid FROM customer), al AS (SELECT un.uid, coalesce(sum(reward), 0) AS r FROM un LEFT JOIN rew USING (uid) GROUP BY un.uid) SELECT uid, round(CASE WHEN sum(r) OVER () > 0 THEN r / sum(r) OVER () ELSE 1.0 / count(*) OVER () END, 6) AS weight FROM al",
    "leaderboard": f"WITH {FACTS} SELECT formula_id, round(max(ic), 6) AS best_ic, round(avg(ic), 6) AS mean_ic, round(arg_max(ic, epoch), 6) AS last_ic, count(*) AS n, count(DISTINCT uid) AS n_uids, max(epoch) - min(epoch) + 1 AS longevity FROM facts GROUP BY formula_id",
    "leaderboard_top": f"WITH {FACTS} SELECT formula_id, round(max(ic), 6) AS best_ic, round(avg(ic), 6) AS mean_ic, round(arg_max(ic, epoch), 6) AS last_ic, count(*) AS n, count(DISTINCT uid) AS n_uids, max(epoch) - min(epoch) + 1 AS longevity FROM facts GROUP BY formula_id ORDER BY avg(ic) DESC, formula_id LIMIT 10",
    "concentration": f"WITH {FACTS}, per AS (SELECT uid, count(DISTINCT formula_id) AS n FROM facts GROUP BY uid) SELECT sum(n)::BIGINT AS n_formulas, count(*) AS n_uids, round(sum(n * n) / sum(n) ** 2, 6) AS hhi FROM per",
    "eviction": f"""{LIFE}, en AS (SELECT formula_id, epoch AS last_epoch, state FROM life QUALIFY row_number() OVER (PARTITION BY formula_id ORDER BY k DESC) = 1)
SELECT * FROM en QUALIFY state <> 'RETIRED' OR row_number() OVER (PARTITION BY state = 'RETIRED' ORDER BY last_epoch, formula_id) > count(*) OVER () - 20""",
    "last_n_history": f"WITH {FACTS} SELECT formula_id, epoch, uid, ic::DOUBLE AS ic FROM facts QUALIFY row_number() OVER (PARTITION BY formula_id ORDER BY epoch DESC) <= 5",
    "trust_ema": f"WITH {TRUST} SELECT uid, epoch, score::DOUBLE AS score, round(trust, 6) AS trust FROM tr",
    "spike_penalty": f"""WITH {TRUST}, sp AS (SELECT *, count(score) OVER w AS n, (score - avg(score) OVER w) / (stddev_pop(score) OVER w + 1e-9) AS sg FROM tr WINDOW w AS (PARTITION BY uid ORDER BY epoch ROWS BETWEEN 59 PRECEDING AND 1 PRECEDING)),
sq AS (SELECT *, CASE WHEN n + 1 >= 5 AND sg > 2 THEN least(0.5, (sg - 2) / 4 * 0.5) ELSE 0 END AS penalty FROM sp) SELECT uid, epoch, score::DOUBLE AS score, round(trust, 6) AS trust, round(penalty, 6) AS penalty, round(trust * (1 - penalty), 6) AS adjusted FROM sq""",
    "weight_cosines": f"WITH {COS} SELECT a, b, round(cosine, 6) AS cosine FROM cos",
    "diversity_penalty": f"WITH {COS}, bt AS (SELECT a AS uid, cosine FROM cos UNION ALL SELECT b, cosine FROM cos) SELECT uid, round(coalesce(least(0.4, avg(greatest(0, abs(cosine) - 0.85)) / 0.15 * 0.4), 0), 6) AS penalty FROM (SELECT DISTINCT uid FROM positions) LEFT JOIN bt USING (uid) GROUP BY uid",
    "capital_feedback": f"""WITH {lineitem_sql()}, {TRUST}, {UNIT}, tl AS (SELECT uid, arg_max(trust, epoch) AS trust FROM tr GROUP BY uid), un AS (SELECT uid, asset, w / nullif(sum(abs(w)) OVER (PARTITION BY uid), 0) AS w FROM positions),
lr AS (SELECT dt, asset, lret FROM p WHERE lret IS NOT NULL QUALIFY row_number() OVER (PARTITION BY asset ORDER BY dt DESC) <= 20), an AS (SELECT uid, sum(w * lret) / 20 * 252 AS annual FROM un JOIN lr USING (asset) WHERE w IS NOT NULL GROUP BY uid)
SELECT tl.uid, round(trust, 6) AS trust, round(annual, 6) AS annual, round(CASE WHEN annual IS NULL THEN trust ELSE greatest(0, 0.8 * trust + 0.2 * tanh(annual / 0.3)) END, 6) AS adjusted FROM tl LEFT JOIN an USING (uid)""",
    "retire_rule": f"WITH {FACTS} SELECT formula_id, count(*) AS n, round(avg(ic), 6) AS mean_ic, round(avg((ic > 0)::INT), 6) AS stability, count(*) >= 5 AND avg(ic) < 0.01 AND avg((ic > 0)::INT) < 0.3 AS retire FROM facts GROUP BY formula_id",
    "decay_fit": f"WITH {FACTS}, y AS (SELECT formula_id, (epoch - 23904)::DOUBLE AS t, ln(greatest(abs(ic), 1e-6)) AS y FROM facts), rg AS (SELECT formula_id, regr_slope(y, t) AS slope, regr_intercept(y, t) AS intercept, regr_r2(y, t) AS r2, count(*) AS n FROM y GROUP BY 1) SELECT formula_id, round(slope, 6) AS slope, round(intercept, 6) AS intercept, round(r2, 6) AS r2, n, round(CASE WHEN slope < 0 THEN ln(2.0) / -slope END, 6) AS half_life FROM rg",
    "lifecycle": f"{LIFE} SELECT formula_id, epoch, state, CASE {' '.join(f"WHEN state = '{k}' THEN {v}" for k, v in L.MULTIPLIERS.items())} END::DOUBLE AS multiplier FROM life WHERE k > 0",
    "lifecycle_counts": f"{LIFE} SELECT state, count(*) AS n FROM (SELECT * FROM life QUALIFY row_number() OVER (PARTITION BY formula_id ORDER BY k DESC) = 1) GROUP BY 1",
    "hypothesis_update": f"WITH {EVID}, hy AS (SELECT hypothesis, count(*) AS n, sum((ic > 0.02)::INT)::BIGINT AS successes, avg(ic) AS mean_ic FROM evid GROUP BY 1) SELECT hypothesis, n, successes, round(mean_ic, 6) AS mean_ic, round((1 + successes) / (2 + n), 6) AS confidence, CASE WHEN n < 3 THEN 'pending' WHEN (1 + successes) / (2 + n) < 0.3 THEN 'retired' WHEN (1 + successes) / (2 + n) > 0.5 THEN 'active' ELSE 'pending' END AS status FROM hy",
    "graph_propagation": f"WITH {EVID} SELECT hypothesis, formula_id, epoch, ic::DOUBLE AS ic FROM evid",
    "knowledge_degrees": f"WITH {FACTS}, {LINKS} SELECT f.formula_id AS node, count(hypothesis) AS degree, 'formula' AS kind FROM (SELECT DISTINCT formula_id FROM facts) f LEFT JOIN links USING (formula_id) GROUP BY 1 UNION ALL SELECT h.hypothesis, count(formula_id), 'hypothesis' FROM (SELECT 'h' || i AS hypothesis FROM range(9) t(i)) h LEFT JOIN links USING (hypothesis) GROUP BY 1",
    "shared_formulas": f"WITH {LINKS} SELECT x.hypothesis AS a, y.hypothesis AS b, count(*) AS shared FROM links x JOIN links y ON x.formula_id = y.formula_id AND x.hypothesis < y.hypothesis GROUP BY 1, 2",
    "evolution_tree": "WITH RECURSIVE l AS (SELECT p_partkey AS child, p_partkey // 2 AS parent FROM part WHERE p_partkey > 1), up AS (SELECT child AS node, parent AS ancestor, 1 AS depth FROM l UNION ALL SELECT up.node, l.parent, up.depth + 1 FROM up JOIN l ON l.child = up.ancestor) SELECT * FROM up",
    "market_price": f"WITH {OPEN}, {PRICE} SELECT signal, round(price::DOUBLE, 6) AS price, round(bullish, 6) AS bullish, round(stake::DOUBLE, 6) AS stake FROM price",
    "settlement": f"WITH {OPEN}, {SETTLED} SELECT uid, signal, correct, round(sum(pnl)::DOUBLE, 6) AS pnl, count(*) AS n FROM settled GROUP BY ALL",
    "market_rewards": f"WITH {OPEN}, {SETTLED}, g AS (SELECT uid, sum(pnl)::DOUBLE AS pnl, avg(correct::INT) AS accuracy FROM settled GROUP BY uid), e AS (SELECT *, exp(pnl - max(pnl) OVER ()) AS e FROM g) SELECT uid, round(pnl, 6) AS pnl, round(accuracy, 6) AS accuracy, round(e / sum(e) OVER (), 6) AS weight FROM e",
    "market_blend": f"WITH {OPEN}, {PRICE}, {ACTUAL} SELECT a.signal, round((0.7 * coalesce((actual_ic - min(actual_ic) OVER ()) / nullif(max(actual_ic) OVER () - min(actual_ic) OVER (), 0), 0.5) + 0.3 * greatest(coalesce(price, 0), 0))::DOUBLE, 6) AS blended FROM actual a LEFT JOIN price USING (signal)",
    "consensus": f"WITH {PROP2} SELECT role, uid, round(weight, 6) AS weight FROM agreed",
    "consensus_divergence": f"""WITH {PROP2}, vr AS (SELECT DISTINCT validator, role FROM pw), dv AS (SELECT vr.role, vr.validator, avg((coalesce(w, 0) - weight) ** 2) AS divergence FROM vr JOIN agreed a ON a.role = vr.role LEFT JOIN pw ON pw.validator = vr.validator AND pw.role = vr.role AND pw.uid = a.uid GROUP BY 1, 2),
d2 AS (SELECT *, greatest(0, least(1, (divergence - 0.05) / 0.95)) AS penalty FROM dv) SELECT role, validator, round(divergence, 6) AS divergence, round(penalty, 6) AS penalty, round(greatest(0.1, least(1, 0.7 + 0.3 * (1 - penalty))), 6) AS credibility FROM d2""",
    "pending_predictions": f"WITH {FACTS} SELECT a.formula_id, a.epoch, a.ic::DOUBLE AS predicted, b.ic::DOUBLE AS actual, sign(a.ic) = sign(b.ic) AS \"right\" FROM facts a JOIN facts b ON a.formula_id = b.formula_id AND b.epoch = a.epoch + 1",
    "trigram_similarity": f"SELECT a.item_id, round(len(list_intersect({_TRI('a.text')}, {_TRI('b.text')})) / len(list_distinct(list_concat({_TRI('a.text')}, {_TRI('b.text')})))::DOUBLE, 6) AS similarity FROM benchmark a JOIN benchmark b ON b.item_id = a.item_id + 1",
}
