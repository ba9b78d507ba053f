"""Every registered panel query: against its oracle in DuckDB, or for shape where SQL has none."""

import math
from decimal import Decimal

import duckdb
import pytest

from panelforge import queries as registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, (float, Decimal)):
        return None if math.isnan(v) else round(float(v), 5) + 0.0
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


def close(a, b):
    return a == b or (isinstance(a, (int, float)) and isinstance(b, (int, float)) and abs(a - b) <= 2e-5 * max(1, abs(a)))


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, sf_dir, duck, name):
    df = registry.queries()[name](spark, sf_dir)
    cols = sorted(df.columns)
    rows = [tuple(plain(r[c]) for c in cols) for r in df.collect()]
    sql = registry.oracle_sql().get(name)
    if sql is None:
        assert rows and cols
        return
    r = duck.sql(sql)
    assert sorted(r.columns) == cols
    at = [r.columns.index(c) for c in cols]
    want = [tuple(plain(x[i]) for i in at) for x in r.fetchall()]
    key = lambda x: tuple((v is None, f"{v:.3f}" if isinstance(v, float) else str(v)) for v in x)
    assert len(rows) == len(want)
    bad = [(x, y) for x, y in zip(sorted(rows, key=key), sorted(want, key=key), strict=True) if not all(map(close, x, y))]
    assert not bad, bad[:3]


@pytest.mark.parametrize(("name", "table", "key"), [("asof_backward", "events", "event_id"), ("asof_nearest", "orders", "o_orderkey")])
def test_asof_takes_all_rows(spark, sf_dir, name, table, key):
    got = registry.queries()[name](spark, sf_dir)
    every = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    assert sorted(r[0] for r in got.select(key).collect()) == sorted(r[0] for r in every.select(key).collect())


def test_asof_nearest_beside_a_plain_walk(spark):
    """Unsorted, with ties between both sides, times that occur twice, nulls, and keys of one side only."""
    import datetime as d

    from panelforge.operators.alignment import asof

    day = lambda n: None if n is None else d.date(2020, 3, 1) + d.timedelta(n)
    left = [(i, k, n) for i, (k, n) in enumerate([("a", 9), ("a", 0), ("a", 5), ("a", 5), ("a", 40), ("b", 3), ("c", 1), ("a", None), (None, 5), ("a", 30), ("b", -2)])]
    right = [("a", 2, 1.0), ("a", 8, 2.0), ("a", 30, None), ("b", 3, 4.0), ("d", 1, 5.0), ("a", None, 6.0), (None, 5, 7.0)]

    def near(k, n, direction):
        at = [(abs(n - m), m, v) for j, m, v in right if j == k and m is not None and (direction == "nearest" or (m <= n) == (direction == "backward") or m == n)] if k and n is not None else []
        return min(at, key=lambda x: x[:2])[2] if at else None

    l = spark.createDataFrame([(i, k, day(n)) for i, k, n in left], "id int, k string, t date").repartition(3)
    r = spark.createDataFrame([(k, day(n), v) for k, n, v in right], "k string, t date, v double").repartition(3)
    for direction in ("backward", "forward", "nearest"):
        got = {x.id: x.v for x in asof(l, r, "t", "v", ("k",), direction).collect()}
        assert got == {i: near(k, n, direction) for i, k, n in left}, direction


def test_asof_nearest_in_parts_of_a_second(spark):
    from pyspark.sql import functions as F

    from panelforge.operators.alignment import asof

    t = lambda df: df.withColumn("t", F.to_timestamp("t"))
    l, r = t(spark.createDataFrame([("2020-01-01 00:00:00.4",)], ["t"])), t(spark.createDataFrame([("2020-01-01 00:00:00.0", 1), ("2020-01-01 00:00:00.5", 2)], ["t", "v"]))
    assert [x.v for x in asof(l, r, "t", "v", (), "nearest").collect()] == [2]


def test_asof_nearest_in_time_that_grows_with_the_rows(spark):
    """60,000 rows of one key and no later value: a frame gone through anew for each row is 1.8e9 steps."""
    import time

    from pyspark.sql import functions as F

    from panelforge.operators.alignment import asof

    l = spark.range(60_000).select("id", F.lit(1).alias("k"), (F.col("id") % 2000 + 10).cast("int").alias("n")).select("id", "k", F.date_add(F.lit("2020-01-01"), F.col("n")).alias("t"))
    r = spark.sql("select 1 as k, date'2020-01-01' as t, 3.0D as v")
    asof(l.limit(5), r, "t", "v", ("k",), "nearest").collect()
    start = time.monotonic()
    assert asof(l, r, "t", "v", ("k",), "nearest").where("v = 3").count() == 60_000
    assert time.monotonic() - start < 15


def test_halves_round_as_in_the_oracle(spark):
    from panelforge.queries.scoring import rounded

    values = [2117.4353125, -2117.4353125, 0.0000005, 1.0000015, 2.5e-7, 1234.5678905, 0.1234565]
    want = [duckdb.sql(f"SELECT round({v!r}::DOUBLE, 6)").fetchall()[0][0] for v in values]
    assert [x.v for x in rounded(spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double")).orderBy("i").collect()] == want


def test_ancestors_of_deep_and_many_paths(spark):
    """Deeper than recursive SQL goes here (100 levels), more rows than it gives (1,000,000), paths
    that part and meet, a null parent, a circle, and no links at all."""
    from pyspark.sql import functions as F

    from panelforge.operators.alignment import ancestors

    links = lambda rows: spark.createDataFrame(rows, "child long, parent long")
    rows = lambda e: sorted(((r.node, r.ancestor, r.depth) for r in ancestors(spark, e).collect()), key=str)
    assert rows(links([(i, i - 1) for i in range(1, 131)])) == sorted(((i, i - d, d) for i in range(1, 131) for d in range(1, i + 1)), key=str)
    assert rows(links([(4, 2), (4, 3), (2, 1), (3, 1), (1, None)])) == sorted([(4, 2, 1), (4, 3, 1), (2, 1, 1), (3, 1, 1), (1, None, 1), (4, 1, 2), (4, 1, 2), (2, None, 2), (3, None, 2), (4, None, 3), (4, None, 3)], key=str)
    assert rows(links([])) == []
    many = ancestors(spark, spark.range(2, 80_001).select(F.col("id").alias("child"), F.floor(F.col("id") / 2).alias("parent")))
    assert many.count() == sum(n.bit_length() - 1 for n in range(2, 80_001)) > 1_000_000
    for circle in ([(7, 7)], [(1, 2), (2, 3), (3, 1), (9, 1)]):
        with pytest.raises(ValueError, match="circle"):
            ancestors(spark, links(circle))
