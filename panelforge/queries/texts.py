"""Queries over short texts: parts' names, makers and types, the dearest first."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelforge.operators.near_texts import OVER, keep_best


def near_texts(spark, d):
    part = spark.read.parquet(f"{d}/part.parquet").select("p_partkey", "p_retailprice", F.concat_ws(" ", "p_name", "p_brand", "p_type").alias("words"))
    return keep_best(part, "p_partkey", "words", "p_retailprice")


QUERIES = {"near_texts": near_texts}

#: All names have three letters or more.  The walk takes one part after the other.
ORACLE = {
    "near_texts": f"""WITH RECURSIVE t AS (SELECT p_partkey, p_retailprice, replace(lower(p_name || p_brand || p_type), ' ', '') AS s FROM part),
g AS (SELECT s, list_sort(list_distinct(list_transform(range(1, length(s) - 1), lambda i: substring(s, i, 3)))) AS g FROM (SELECT DISTINCT s FROM t)),
r AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY p_retailprice DESC, p_partkey) AS k FROM (SELECT g, max(p_retailprice) AS p_retailprice, arg_min(p_partkey, (-p_retailprice, p_partkey)) AS p_partkey FROM t JOIN g USING (s) GROUP BY g)),
f AS MATERIALIZED (SELECT k, len(g) AS n, unnest(g) AS piece FROM r),
l AS (SELECT x.k AS a, y.k AS b FROM f x JOIN f y ON x.piece = y.piece AND x.k < y.k GROUP BY x.k, y.k, x.n, y.n HAVING {OVER[1]} * count(*) > {OVER[0]} * (x.n + y.n - count(*))),
o AS MATERIALIZED (SELECT r.k, coalesce(before, []) AS before FROM r LEFT JOIN (SELECT b AS k, list(a) AS before FROM l GROUP BY b) USING (k)),
walk AS (SELECT 1::BIGINT AS k, [1::BIGINT] AS kept
  UNION ALL SELECT walk.k + 1, CASE WHEN list_has_any(o.before, walk.kept) THEN walk.kept ELSE list_append(walk.kept, o.k) END FROM walk JOIN o ON o.k = walk.k + 1)
SELECT p_partkey, p_retailprice FROM r WHERE k IN (SELECT unnest(kept) FROM walk WHERE k = (SELECT max(k) FROM r))""",
}
