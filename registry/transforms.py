"""Scalar transforms: imputing, scaling, outliers, encoding."""

from __future__ import annotations

from pyspark.sql import functions as F

from registry.base import EVENTS_SQL, LINES_SQL, events, lines, query, read, rounded
from seriesmill.operators import scalar as S
from seriesmill.operators.split import split_chronological

K = ["l_orderkey", "l_linenumber"]
KS = "l_orderkey, l_linenumber"


def _stat(aggs: str) -> str:
    return f"WITH {LINES_SQL}, st AS (SELECT {aggs} FROM li)"


@query(
    "f1_impute_mean",
    f"{_stat('avg(q) AS mq, avg(p) AS mp')} SELECT {KS}, round(coalesce(q, mq), 4) AS q, round(coalesce(p, mp), 4) AS p FROM li, st",
)
def f1(spark, d):
    return rounded(S.impute(lines(spark, d), ["q", "p"], "mean"), K, ["q", "p"])


@query(
    "f2_impute_median",
    f"{_stat('quantile_cont(q, 0.5) AS mq, quantile_cont(p, 0.5) AS mp')} "
    f"SELECT {KS}, round(coalesce(q, mq), 4) AS q, round(coalesce(p, mp), 4) AS p FROM li, st",
)
def f2(spark, d):
    return rounded(S.impute(lines(spark, d), ["q", "p"], "median"), K, ["q", "p"])


@query(
    "f3_impute_constant",
    f"WITH {LINES_SQL} SELECT {KS}, round(coalesce(q, -1.5), 4) AS q, round(coalesce(p, -1.5), 4) AS p FROM li",
)
def f3(spark, d):
    return rounded(S.impute(lines(spark, d), ["q", "p"], "constant", fill_value=-1.5), K, ["q", "p"])


@query(
    "f4_impute_mode",
    f"WITH {LINES_SQL}, m AS (SELECT f AS top FROM li WHERE f IS NOT NULL GROUP BY f ORDER BY count(*) DESC, f LIMIT 1) "
    f"SELECT {KS}, coalesce(f, top) AS f FROM li, m",
)
def f4(spark, d):
    return S.impute(lines(spark, d), ["f"], "mean").select(*K, "f")


@query(
    "f5_z_norm",
    f"{_stat('avg(q) AS mq, stddev_pop(q) AS sq, avg(p) AS mp, stddev_pop(p) AS sp')} "
    f"SELECT {KS}, round((q - mq) / sq, 4) AS q, round((p - mp) / sp, 4) AS p FROM li, st",
)
def f5(spark, d):
    return rounded(S.z_norm(lines(spark, d), ["q", "p"]), K, ["q", "p"])


@query(
    "f6_min_max",
    f"{_stat('min(q) AS nq, max(q) AS xq, min(p) AS np, max(p) AS xp')} "
    f"SELECT {KS}, round((q - nq) / (xq - nq), 4) AS q, round((p - np) / (xp - np), 4) AS p FROM li, st",
)
def f6(spark, d):
    return rounded(S.min_max(lines(spark, d), ["q", "p"]), K, ["q", "p"])


@query(
    "f7_log_transform",
    f"WITH {LINES_SQL}, s AS (SELECT {KS}, p, l_tax - 0.04 AS t FROM li), st AS (SELECT min(p) AS np, min(t) AS nt FROM s) "
    f"SELECT {KS}, round(CASE WHEN np < 0 THEN p ELSE ln(1 + p) END, 4) AS p, "
    "round(CASE WHEN nt < 0 THEN t ELSE ln(1 + t) END, 4) AS t FROM s, st",
)
def f7(spark, d):
    df = lines(spark, d).withColumn("t", F.col("l_tax") - 0.04)
    return rounded(S.log_transform(df, ["p", "t"]), K, ["p", "t"])


_FENCE = (
    f"WITH {EVENTS_SQL}, qs AS (SELECT quantile_cont(v, 0.25) AS a, quantile_cont(v, 0.75) AS b FROM ev), "
    "fe AS (SELECT a - 1.5 * (b - a) AS lo, b + 1.5 * (b - a) AS hi FROM qs)"
)


@query("f8_outliers_iqr", f"{_FENCE} SELECT event_id, v FROM ev, fe WHERE v >= lo AND v <= hi")
def f8(spark, d):
    return S.remove_outliers(events(spark, d), ["v"], "iqr", 1.5).select("event_id", "v")


@query(
    "f9_outliers_zscore",
    f"WITH {EVENTS_SQL}, st AS (SELECT avg(v) AS m, stddev_pop(v) AS s FROM ev) "
    "SELECT event_id, v FROM ev, st WHERE abs((v - m) / s) <= 2.5",
)
def f9(spark, d):
    return S.remove_outliers(events(spark, d), ["v"], "zscore", 2.5).select("event_id", "v")


@query(
    "f18_label_encode",
    "WITH o AS (SELECT o_orderkey, coalesce(CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_orderpriority END, 'nan') AS p FROM orders), "
    "c AS (SELECT p, row_number() OVER (ORDER BY p) - 1 AS code FROM (SELECT DISTINCT p FROM o)) "
    "SELECT o_orderkey, CAST(code AS BIGINT) AS p FROM o JOIN c USING (p)",
)
def f18(spark, d):
    o = read(spark, d, "orders").selectExpr(
        "o_orderkey", "CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_orderpriority END AS p"
    )
    return S.label_encode(o, ["p"])


@query(
    "f18_label_encode_many_classes",
    "WITH c AS (SELECT text, dense_rank() OVER (ORDER BY text) - 1 AS code FROM (SELECT DISTINCT text FROM documents)) "
    "SELECT doc_id, CAST(code AS BIGINT) AS text FROM documents JOIN c USING (text)",
)
def f18_many(spark, d):
    return S.label_encode(read(spark, d, "documents").select("doc_id", "text"), ["text"])


_TYPES = ["click", "error", "purchase", "signup", "view"]


@query(
    "f19_onehot_encode",
    "WITH e AS (SELECT event_id, CASE WHEN event_id % 9 = 0 THEN NULL ELSE event_type END AS t FROM events) SELECT event_id, "
    + ", ".join(f"CAST(coalesce(t = '{t}', false) AS INTEGER) AS t_{t}" for t in _TYPES)
    + " FROM e",
)
def f19(spark, d):
    e = read(spark, d, "events").selectExpr("event_id", "CASE WHEN event_id % 9 = 0 THEN NULL ELSE event_type END AS t")
    return S.onehot_encode(e, ["t"])


@query("f19_onehot_skips_many_categories", "SELECT p_partkey, p_brand FROM part")
def f19_skip(spark, d):
    return S.onehot_encode(read(spark, d, "part").select("p_partkey", "p_brand"), ["p_brand"])


@query(
    "f24_z_norm_sample",
    f"{_stat('avg(q) AS mq, stddev_samp(q) AS sq')} SELECT {KS}, round((q - mq) / sq, 4) AS q FROM li, st",
)
def f24(spark, d):
    return rounded(S.z_norm(lines(spark, d), ["q"], ddof=1), K, ["q"])


@query(
    "f25_min_max_null_range",
    f"{_stat('min(q) AS nq, max(q) AS xq')} SELECT {KS}, round((q - nq) / nullif(xq - nq, 0), 4) AS q, "
    "CAST(NULL AS DOUBLE) AS one FROM li, st",
)
def f25(spark, d):
    df = lines(spark, d).withColumn("one", F.col("l_quantity") * 0 + 1)
    return rounded(S.min_max(df, ["q", "one"], zero_range="null"), K, ["q", "one"])


@query(
    "f28_log_clip",
    f"WITH {LINES_SQL}, s AS (SELECT {KS}, p - 30000 AS p FROM li) "
    f"SELECT {KS}, round(ln(1 + CASE WHEN p < 0 THEN 0 ELSE p END), 4) AS p FROM s",
)
def f28(spark, d):
    df = lines(spark, d).withColumn("p", F.col("p") - 30000)
    return rounded(S.log_transform(df, ["p"], negatives="clip"), K, ["p"])


@query("f29_outliers_keep_null", f"{_FENCE} SELECT event_id, v FROM ev, fe WHERE v IS NULL OR NOT (v < lo OR v > hi)")
def f29(spark, d):
    return S.remove_outliers(events(spark, d), ["v"], "iqr", 1.5, keep_null=True).select("event_id", "v")


@query(
    "f31_impute_all_numeric_median",
    f"{_stat('quantile_cont(q, 0.5) AS mq, quantile_cont(p, 0.5) AS mp')} "
    f"SELECT {KS}, l_quantity, round(coalesce(q, mq), 4) AS q, round(coalesce(p, mp), 4) AS p FROM li, st",
)
def f31(spark, d):
    df = lines(spark, d).select(*K, "l_quantity", "q", "p")
    return rounded(S.impute(df, ["l_quantity", "q", "p"], "median"), K, ["l_quantity", "q", "p"])


_CLIP = (
    f"WITH {EVENTS_SQL}, st AS (SELECT avg(v) - 3 * stddev_samp(v) AS lo, avg(v) + 3 * stddev_samp(v) AS hi FROM ev) "
    "SELECT event_id, round(CASE WHEN v < lo THEN lo WHEN v > hi THEN hi ELSE v END, 4) AS v FROM ev, st"
)


@query("f32_clip_outliers", _CLIP)
def f32(spark, d):
    return rounded(S.clip_outliers(events(spark, d), ["v"], 3.0), ["event_id"], ["v"])


@query("f33_clip_if_issues_say_so", _CLIP)
def f33(spark, d):
    return rounded(S.clip_outliers_if(events(spark, d), ["v"], ["Large SPIKES in value"]), ["event_id"], ["v"])


_TRAIN = (
    f"WITH {EVENTS_SQL}, r AS (SELECT *, row_number() OVER (ORDER BY ts, event_id) - 1 AS p, count(*) OVER () AS n FROM ev), "
    "s AS (SELECT *, p < floor(n * CAST(0.7 AS DOUBLE)) AS train FROM r), "
    "st AS (SELECT avg(v) AS m, stddev_pop(v) AS s FROM s WHERE train)"
)


@query("f36_z_norm_fit_on_train", f"{_TRAIN} SELECT event_id, round((v - m) / st.s, 4) AS v FROM s, st")
def f36(spark, d):
    df = split_chronological(events(spark, d), "ts", "event_id")
    return rounded(S.z_norm(df, ["v"], fit_on="train"), ["event_id"], ["v"])


@query("f37_inverse_transform", f"WITH {EVENTS_SQL} SELECT event_id, round(v, 4) AS v FROM ev")
def f37(spark, d):
    df = events(spark, d)
    fitted = S.fit_z_norm(df, ["v"])
    return rounded(S.inverse_transform(S.apply_z_norm(df, fitted), fitted), ["event_id"], ["v"])


@query(
    "e6_null_guard",
    f"WITH {LINES_SQL}, st AS (SELECT avg(q) AS mq, (SELECT f FROM li WHERE f IS NOT NULL GROUP BY f ORDER BY count(*) DESC, f LIMIT 1) AS mf FROM li) "
    f"SELECT {KS}, round(coalesce(q, mq), 4) AS q, coalesce(f, mf) AS f, 0.0::DOUBLE AS e, 'missing' AS g FROM li, st",
)
def e6(spark, d):
    df = lines(spark, d).selectExpr(*K, "q", "f", "CAST(NULL AS DOUBLE) AS e", "CAST(NULL AS STRING) AS g")
    return rounded(S.null_guard(df, ["q", "f", "e", "g"]), [*K, "f", "g"], ["q", "e"])


@query(
    "l1_apply_fitted_transforms",
    f"{_stat('avg(q) AS mq')}, z AS (SELECT {KS}, coalesce(q, mq) AS q FROM li, st), "
    f"s2 AS (SELECT avg(q) AS m, stddev_pop(q) AS s FROM z) SELECT {KS}, round((q - m) / s, 4) AS q FROM z, s2",
)
def l1(spark, d):
    from seriesmill.streaming.online import transform_stream

    df = lines(spark, d)
    fill = S.fit_impute(df, ["q"])
    scale = S.fit_z_norm(S.apply_impute(df, fill), ["q"])
    return rounded(transform_stream(df, fill, scale), K, ["q"])
