"""Splits and folds (G)."""

from __future__ import annotations

from pyspark.sql import functions as F

from registry.base import ORDER, query, read
from seriesmill.operators import profile as B
from seriesmill.operators import split as G

_N = "count(*) OVER () AS n"


def _hash_rank(key: str, over: str = "") -> str:
    part = f"PARTITION BY {over} " if over else ""
    return f"row_number() OVER ({part}ORDER BY md5('42:' || CAST({key} AS VARCHAR)), {key})"


_RANDOM = (
    f"r AS (SELECT *, {_hash_rank('o_orderkey')} AS r, {_N} FROM orders), "
    "s AS (SELECT o_orderkey, CASE WHEN r <= ceil(n * 0.2::DOUBLE) THEN 'test' WHEN r <= ceil(n * 0.2::DOUBLE) + "
    "ceil((n - ceil(n * 0.2::DOUBLE)) * (0.1::DOUBLE / (0.7::DOUBLE + 0.1::DOUBLE))) THEN 'val' ELSE 'train' END AS split FROM r)"
)


@query("g1_split_random", f"WITH {_RANDOM} SELECT * FROM s")
def g1(spark, d):
    return G.split_random(read(spark, d, "orders"), "o_orderkey").select("o_orderkey", "split")


@query(
    "g15_split_random_nested",
    f"WITH r AS (SELECT *, {_hash_rank('o_orderkey')} AS r, {_N} FROM orders) SELECT o_orderkey, "
    "CASE WHEN r <= ceil(n * 0.2::DOUBLE) THEN 'test' WHEN r <= ceil(n * 0.2::DOUBLE) + ceil((n - ceil(n * 0.2::DOUBLE)) * 0.1::DOUBLE) "
    "THEN 'val' ELSE 'train' END AS split FROM r",
)
def g15(spark, d):
    return G.split_random(read(spark, d, "orders"), "o_orderkey", mode="nested").select("o_orderkey", "split")


def _quota(src: str, rows: str, want: str, out: str) -> str:
    return (
        f"(SELECT *, b + CASE WHEN row_number() OVER (ORDER BY ({want} * {rows}) % t DESC, c) <= {want} - sum(b) OVER () THEN 1 ELSE 0 END AS {out} "
        f"FROM (SELECT *, ({want} * {rows}) // t AS b FROM (SELECT *, CAST(sum({rows}) OVER () AS BIGINT) AS t FROM {src})))"
    )


_STRATA = (
    "k AS (SELECT o_orderpriority AS c, count(*) AS m FROM orders GROUP BY 1), "
    "z AS (SELECT CAST(ceil(count(*) * 0.2::DOUBLE) AS BIGINT) AS nt, "
    "CAST(ceil((count(*) - ceil(count(*) * 0.2::DOUBLE)) * (0.1::DOUBLE / (0.7::DOUBLE + 0.1::DOUBLE))) AS BIGINT) AS nv FROM orders), "
    f"k1 AS (SELECT c, m, qt, m - qt AS rest, nv FROM {_quota('(SELECT * FROM k, z)', 'm', 'nt', 'qt')}), "
    f"k2 AS (SELECT c, qt, qv FROM {_quota('k1', 'rest', 'nv', 'qv')}), "
    f"r AS (SELECT *, {_hash_rank('o_orderkey', 'o_orderpriority')} AS r FROM orders) "
    "SELECT o_orderkey, o_orderpriority, CASE WHEN r <= qt THEN 'test' WHEN r <= qt + qv THEN 'val' ELSE 'train' END AS split "
    "FROM r JOIN k2 ON o_orderpriority = c"
)


@query("g2_split_stratified", f"WITH {_STRATA}")
def g2(spark, d):
    out = G.split_stratified(read(spark, d, "orders"), "o_orderkey", "o_orderpriority")
    return out.select("o_orderkey", "o_orderpriority", "split")


_EV = f"r AS (SELECT *, row_number() OVER (ORDER BY ts, event_id) - 1 AS p, {_N} FROM events)"


@query(
    "g3_split_chronological",
    f"WITH {_EV} SELECT event_id, CASE WHEN p < floor(n * 0.7::DOUBLE) THEN 'train' WHEN p < floor(n * 0.7::DOUBLE) + floor(n * 0.1::DOUBLE) "
    "THEN 'val' ELSE 'test' END AS split FROM r",
)
def g3(spark, d):
    return G.split_chronological(read(spark, d, "events"), "ts", "event_id").select("event_id", "split")


@query(
    "g14_split_chronological_nested",
    f"WITH {_EV} SELECT event_id, CASE WHEN p < floor(floor(n * (1 - 0.2::DOUBLE)) * (1 - 0.1::DOUBLE)) THEN 'train' "
    "WHEN p < floor(n * (1 - 0.2::DOUBLE)) THEN 'val' ELSE 'test' END AS split FROM r",
)
def g14(spark, d):
    return G.split_chronological(read(spark, d, "events"), "ts", "event_id", mode="nested").select("event_id", "split")


@query(
    "g16_split_chronological_cumulative",
    f"WITH {_EV} SELECT event_id, CASE WHEN p < floor(n * 0.7::DOUBLE) THEN 'train' WHEN p < floor(n * (0.7::DOUBLE + 0.15::DOUBLE)) "
    "THEN 'val' ELSE 'test' END AS split FROM r",
)
def g16(spark, d):
    fr = G.Fractions(0.7, 0.15, 0.15)
    return G.split_chronological(read(spark, d, "events"), "ts", "event_id", fr, "cumulative").select("event_id", "split")


_GROUP = (
    f"g AS (SELECT o_custkey, {_hash_rank('o_custkey')} AS r, {_N} FROM (SELECT DISTINCT o_custkey FROM orders)), "
    "s AS (SELECT o_custkey, CASE WHEN r <= ceil(n * 0.2::DOUBLE) THEN 'test' WHEN r <= ceil(n * 0.2::DOUBLE) + "
    "ceil((n - ceil(n * 0.2::DOUBLE)) * (0.1::DOUBLE / (0.7::DOUBLE + 0.1::DOUBLE))) THEN 'val' ELSE 'train' END AS split FROM g)"
)


@query("g4_split_group", f"WITH {_GROUP} SELECT o_orderkey, o_custkey, split FROM orders JOIN s USING (o_custkey)")
def g4(spark, d):
    return G.split_group(read(spark, d, "orders"), "o_custkey").select("o_orderkey", "o_custkey", "split")


_GEO = (
    "geo AS (SELECT n, n - CAST(floor(n * 0.2::DOUBLE) AS BIGINT) AS pre FROM (SELECT count(*) AS n FROM events)), "
    "ge2 AS (SELECT pre, greatest(1, CAST(floor(pre * 0.7::DOUBLE) AS BIGINT)) AS init, greatest(1, CAST(floor(pre * 0.1::DOUBLE) AS BIGINT)) AS val FROM geo)"
)


def _cv(start: str, end: str, gap: int, step: str = "val", limit: str = "") -> str:
    return (
        f"WITH {_EV}, {_GEO}, f AS (SELECT CAST(k AS INTEGER) AS k, {start} AS a, {end} AS b, {end} + {gap} AS c, {end} + {gap} + val AS e, pre FROM ge2, "
        f"(SELECT unnest(range(0, 1000)) AS k) WHERE {end} + {gap} + val <= pre {limit}) "
        "SELECT event_id, k AS fold_id, 'train' AS role FROM r JOIN f ON p >= a AND p < b UNION ALL "
        "SELECT event_id, k, 'val' FROM r JOIN f ON p >= c AND p < e UNION ALL "
        "SELECT event_id, CAST(NULL AS INTEGER), 'test' FROM r, ge2 WHERE p >= pre"
    )


@query("g5_time_series_cv_rolling", _cv("k * val", "k * val + init", 0))
def g5(spark, d):
    return G.time_series_cv(read(spark, d, "events").select(*ORDER), "rolling", "ts", "event_id").drop("ts")


@query("g6_time_series_cv_expanding", _cv("0", "k * val + init", 0))
def g6(spark, d):
    return G.time_series_cv(read(spark, d, "events").select(*ORDER), "expanding", "ts", "event_id").drop("ts")


@query("g7_time_series_cv_options", _cv("k * (val // 4)", "k * (val // 4) + init", 24, limit="AND k < 4"))
def g7(spark, d):
    df = read(spark, d, "events").select(*ORDER)
    n = df.count()
    val = max(1, int((n - int(n * 0.2)) * 0.1))
    return G.time_series_cv(df, "rolling", "ts", "event_id", n_folds=4, gap=24, step=val // 4).drop("ts")


@query(
    "g9_split_dispatch",
    f"WITH {_GROUP} SELECT split, count(*) AS n, count(DISTINCT o_custkey) AS groups FROM orders JOIN s USING (o_custkey) GROUP BY 1",
)
def g9(spark, d):
    out = G.split(read(spark, d, "orders"), "group_kfold", "o_orderkey", target="o_totalprice", group_col="o_custkey")
    return out.groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("o_custkey").alias("groups"))


@query(
    "g10_split_signature",
    f"WITH {_RANDOM} SELECT split, count(*) AS n, CAST(sum(CAST('0x' || substr(md5(CAST(o_orderkey AS VARCHAR)), 1, 8) AS BIGINT)) AS BIGINT) AS key_sum "
    "FROM s GROUP BY 1",
)
def g10(spark, d):
    orders = read(spark, d, "orders")
    first = G.split_random(orders, "o_orderkey")
    again = G.split_random(orders.repartition(7, "o_custkey"), "o_orderkey")
    G.assert_same_split(first, again, "o_orderkey")
    return G.split_signature(again, "o_orderkey").withColumn("key_sum", F.col("key_sum").cast("bigint"))


@query("g11_split_info", f"WITH {_RANDOM} SELECT split, count(*) AS n FROM s GROUP BY 1")
def g11(spark, d):
    return G.split_info(G.split_random(read(spark, d, "orders"), "o_orderkey"), minimum_test=30)


@query(
    "g12_is_sorted",
    "SELECT (SELECT count_if(p > v) = 0 FROM (SELECT ts AS v, lag(ts) OVER (ORDER BY event_id) AS p FROM events)) AS events_sorted, "
    "(SELECT count_if(p > v) = 0 FROM (SELECT o_orderdate AS v, lag(o_orderdate) OVER (ORDER BY o_orderkey) AS p FROM orders)) AS orders_sorted",
)
def g12(spark, d):
    a = B.is_sorted(read(spark, d, "events"), "ts", "event_id")
    b = B.is_sorted(read(spark, d, "orders"), "o_orderdate", "o_orderkey")
    return spark.createDataFrame([(a, b)], "events_sorted boolean, orders_sorted boolean")


_LAST = _cv("k * val", "k * val + init", 0)


@query(
    "g13_last_fold",
    f"WITH cv AS ({_LAST}) SELECT event_id, role AS split FROM cv WHERE role = 'test' OR fold_id = (SELECT max(fold_id) FROM cv)",
)
def g13(spark, d):
    return G.last_fold(G.time_series_cv(read(spark, d, "events").select(*ORDER), "rolling", "ts", "event_id")).drop("ts")
