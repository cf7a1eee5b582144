"""Profiles, task rules and evaluation protocols (B, C, D) and model selection."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from registry.base import EVENTS_SQL, LINES_SQL, ORDER, events, lines, query, read
from seriesmill.operators import models as M
from seriesmill.operators import profile as B
from seriesmill.operators import protocol as D
from seriesmill.operators import task as C
from seriesmill.session import materialize

# table -> (row order, {column: (inferred type, dtype)})
_I64, _I32, _F64 = ("numeric", "int64"), ("numeric", "int32"), ("numeric", "float64")
_TXT, _TIME, _ARR = ("categorical", "object"), ("datetime", "datetime64"), ("unknown", "object")
SHAPES = {
    "region": (["r_regionkey"], {"r_regionkey": _I32, "r_name": _TXT}),
    "nation": (["n_nationkey"], {"n_nationkey": _I32, "n_name": _TXT, "n_regionkey": _I32}),
    "customer": (
        ["c_custkey"],
        {"c_custkey": _I64, "c_name": _TXT, "c_nationkey": _I32, "c_acctbal": _F64, "c_mktsegment": _TXT},
    ),
    "supplier": (["s_suppkey"], {"s_suppkey": _I64, "s_name": _TXT, "s_nationkey": _I32, "s_acctbal": _F64}),
    "part": (
        ["p_partkey"],
        {"p_partkey": _I64, "p_name": _TXT, "p_brand": _TXT, "p_type": _TXT, "p_size": _I32, "p_retailprice": _F64},
    ),
    "orders": (
        ["o_orderkey"],
        {
            "o_orderkey": _I64, "o_custkey": _I64, "o_orderstatus": _TXT, "o_totalprice": _F64, "o_orderdate": _TIME,
            "o_orderpriority": _TXT,
        },
    ),
    "lineitem": (
        ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"],
        {
            "l_orderkey": _I64, "l_partkey": _I64, "l_suppkey": _I64, "l_linenumber": _I32, "l_quantity": _F64,
            "l_extendedprice": _F64, "l_discount": _F64, "l_tax": _F64, "l_returnflag": _TXT, "l_linestatus": _TXT,
            "l_shipdate": _TIME,
        },
    ),
    "events": (
        ORDER,
        {"event_id": _I64, "ts": _TIME, "user_id": _I64, "event_type": _TXT, "value": _F64, "props": _TXT},
    ),
    "documents": (["doc_id"], {"doc_id": _I64, "text": _TXT, "lang": _TXT, "source": _TXT, "n_chars": _I64}),
    "embeddings": (["vec_id"], {"vec_id": _I64, "embedding": _ARR, "label": _I32}),
    "pages": (["page_id"], {"page_id": _I64, "url": _TXT, "html": _TXT}),
    "benchmark": (["item_id"], {"item_id": _I64, "text": _TXT}),
    "labels": (["doc_id"], {"doc_id": _I64, "quality": _I32, "toxic": _I32}),
    "conversations": (["conv_id", "turn"], {"conv_id": _I64, "turn": _I64, "role": _TXT, "text": _TXT}),
}


def _column_sql(source: str, table: str, order: list[str], i: int, col: str, inferred: str, dtype: str) -> str:
    num = inferred == "numeric"
    stats = (
        f"CAST(min({col}) AS DOUBLE) AS min, CAST(max({col}) AS DOUBLE) AS max, round(avg({col}), 4) AS mean, "
        f"round(stddev_samp({col}), 4) AS std, coalesce(bool_or({col} < 0), false) AS has_negative_values"
        if num
        else "NULL::DOUBLE AS min, NULL::DOUBLE AS max, NULL::DOUBLE AS mean, NULL::DOUBLE AS std, false AS has_negative_values"
    )
    if inferred == "datetime":
        keys = ", ".join(order)
        rising = (
            f"(SELECT CASE WHEN count(*) > 1 THEN count_if(p > v) = 0 END FROM (SELECT {col} AS v, "
            f"lag({col}) OVER (ORDER BY {keys}) AS p FROM {source} WHERE {col} IS NOT NULL))"
        )
    else:
        rising = "NULL::BOOLEAN"
    return (
        f"SELECT '{table}' AS table_name, {i} AS ordinal, '{col}' AS name, '{inferred}' AS inferred_type, '{dtype}' AS dtype, "
        f"CAST(count(*) - count({col}) AS BIGINT) AS missing_count, round((count(*) - count({col})) / CAST(count(*) AS DOUBLE), 6) AS missing_fraction, "
        f"count(DISTINCT {col}) AS unique_count, {stats}, {'true' if inferred == 'datetime' else 'false'} AS is_temporal, "
        f"{rising} AS is_monotonically_increasing, count(*) AS num_rows FROM {source}"
    )


def profile_sql(tables) -> str:
    return " UNION ALL ".join(
        _column_sql(t, t, SHAPES[t][0], i, c, *kind) for t in tables for i, (c, kind) in enumerate(SHAPES[t][1].items())
    )


def catalog_profile(spark, d) -> DataFrame:
    """Profile of all tables, one row per column, written once for the rules that read it several times."""
    tables = {t: (read(spark, d, t), order) for t, (order, _) in SHAPES.items()}
    return materialize(B.profile_tables(tables).repartition(1))  # 65 rows


# ---------------------------------------------------------------- B


@query(
    "b1_infer_types",
    "SELECT unnest(['event_id', 'ts', 'event_type', 'value', 'day_text', 'half_text', 'flag']) AS name, "
    "unnest(['numeric', 'datetime', 'categorical', 'numeric', "
    "(SELECT CASE WHEN avg(CAST(try_cast(t AS TIMESTAMP) IS NOT NULL AS INTEGER)) >= 0.8 THEN 'datetime' ELSE 'categorical' END FROM "
    "(SELECT strftime(ts, '%Y-%m-%d') AS t FROM events ORDER BY ts, event_id LIMIT 20)), "
    "(SELECT CASE WHEN avg(CAST(try_cast(t AS TIMESTAMP) IS NOT NULL AS INTEGER)) >= 0.8 THEN 'datetime' ELSE 'categorical' END FROM "
    "(SELECT CASE WHEN event_id % 2 = 0 THEN 'n/a' ELSE strftime(ts, '%Y-%m-%d') END AS t FROM events ORDER BY ts, event_id LIMIT 20)), "
    "'boolean']) AS inferred_type",
)
def b1(spark, d):
    df = read(spark, d, "events").selectExpr(
        "event_id", "ts", "event_type", "value", "date_format(ts, 'yyyy-MM-dd') AS day_text",
        "CASE WHEN event_id % 2 = 0 THEN 'n/a' ELSE date_format(ts, 'yyyy-MM-dd') END AS half_text", "value > 50 AS flag",
    )
    return spark.createDataFrame(list(B.infer_types(df, ORDER).items()), "name string, inferred_type string")


_LI_COLS = ["l_orderkey", "l_quantity", "q", "p", "f"]


@query(
    "b2_missing_stats",
    f"WITH {LINES_SQL} "
    + " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", CAST(count(*) - count({c}) AS BIGINT) AS missing_count, "
        f"round((count(*) - count({c})) / CAST(count(*) AS DOUBLE), 6) AS missing_fraction FROM li"
        for c in _LI_COLS
    ),
)
def b2(spark, d):
    return B.missing_stats(lines(spark, d), _LI_COLS)


@query(
    "b3_distinct_stats",
    f"WITH {LINES_SQL} "
    + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(DISTINCT {c}) AS unique_count FROM li" for c in _LI_COLS),
)
def b3(spark, d):
    return B.distinct_stats(lines(spark, d), _LI_COLS)


_NUMS = ["l_orderkey", "l_linenumber", "q", "p", "centered"]


@query(
    "b4_numeric_stats",
    f"WITH {LINES_SQL}, s AS (SELECT *, q - 25 AS centered FROM li) "
    + " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", round(CAST(min({c}) AS DOUBLE), 4) AS min, round(CAST(max({c}) AS DOUBLE), 4) AS max, round(avg({c}), 4) AS mean, "
        f"round(stddev_samp({c}), 4) AS std, bool_or({c} < 0) AS has_negative_values FROM s"
        for c in _NUMS
    ),
)
def b4(spark, d):
    df = B.numeric_stats(lines(spark, d).withColumn("centered", F.col("q") - 25), _NUMS)
    return df.select("column", *[F.round(c, 4).alias(c) for c in ("min", "max", "mean", "std")], "has_negative_values")


@query(
    "b5_is_monotonic",
    " UNION ALL ".join(
        f"SELECT '{n}' AS what, CASE WHEN count(*) > 1 THEN count_if(p > v) = 0 END AS is_monotonic FROM "
        f"(SELECT {c} AS v, lag({c}) OVER (ORDER BY {o}) AS p FROM {t} WHERE {c} IS NOT NULL)"
        for n, c, o, t in (
            ("event time", "ts", "ts, event_id", "events"),
            ("event time by id", "ts", "event_id", "events"),
            ("order date by key", "o_orderdate", "o_orderkey", "orders"),
        )
    ),
)
def b5(spark, d):
    ev, orders = read(spark, d, "events"), read(spark, d, "orders")
    parts = [
        B.is_monotonic(ev, "ts", ORDER).withColumn("what", F.lit("event time")),
        B.is_monotonic(ev, "ts", "event_id").withColumn("what", F.lit("event time by id")),
        B.is_monotonic(orders, "o_orderdate", "o_orderkey").withColumn("what", F.lit("order date by key")),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("b6_profile", profile_sql(SHAPES))
def b6(spark, d):
    return catalog_profile(spark, d).drop("sample_values").withColumns({"mean": F.round("mean", 4), "std": F.round("std", 4)})


@query(
    "b7_quality_issues",
    "WITH s AS (SELECT CASE WHEN l_quantity > 48 THEN l_tax END AS rare, l_discount FROM lineitem), "
    "m AS (SELECT 'rare' AS name, round((count(*) - count(rare)) / CAST(count(*) AS DOUBLE), 6) AS f FROM s UNION ALL "
    "SELECT 'l_discount', round((count(*) - count(l_discount)) / CAST(count(*) AS DOUBLE), 6) FROM s) "
    "SELECT 'lineitem' AS table_name, name, 'Column ''' || name || ''' has ' || printf('%.1f', f * 100) || '% missing values (likely_unusable).' AS issue "
    "FROM m WHERE f > 0.9",
)
def b7(spark, d):
    df = read(spark, d, "lineitem").selectExpr("l_orderkey", "CASE WHEN l_quantity > 48 THEN l_tax END AS rare", "l_discount")
    return B.quality_issues(B.profile(df, "l_orderkey", "lineitem"))


# ---------------------------------------------------------------- rules: shared SQL

PROF = f"prof AS ({profile_sql(SHAPES)})"
_CANON = "name IN ('target', 'label', 'y', 'output')"
_FLOAT = "inferred_type = 'numeric' AND missing_fraction = 0 AND dtype LIKE 'float%'"
TARGET = (
    f"tf AS (SELECT table_name, count_if({_CANON}) AS nc, max(CASE WHEN {_CANON} THEN name END) AS c, "
    f"count_if({_FLOAT}) AS nf, max(CASE WHEN {_FLOAT} THEN name END) AS f, "
    "max_by(name, ordinal) FILTER (WHERE inferred_type = 'numeric') AS l FROM prof GROUP BY 1), "
    "target AS (SELECT table_name, CASE WHEN nc = 1 THEN c WHEN nf = 1 THEN f ELSE l END AS target_col, "
    "CASE WHEN nc = 1 OR nf = 1 THEN 'medium' WHEN l IS NOT NULL THEN 'low' END AS task_confidence, "
    "CASE WHEN nc = 1 THEN 2 WHEN nf = 1 THEN 3 WHEN l IS NOT NULL THEN 5 END AS target_rule FROM tf)"
)
_MONO = "coalesce(is_monotonically_increasing, false)"
TIMES = (
    "cand AS (SELECT p.*, row_number() OVER (PARTITION BY p.table_name ORDER BY NOT " + _MONO + ", ordinal) AS r "
    "FROM prof p JOIN target t USING (table_name) WHERE is_temporal AND name IS DISTINCT FROM target_col), "
    "times AS (SELECT t.table_name, c.name AS time_col, " + _MONO.replace("is_mono", "c.is_mono") + " AS time_rising "
    "FROM target t LEFT JOIN cand c ON c.table_name = t.table_name AND r = 1)"
)
GROUPS = (
    "groups AS (SELECT p.table_name, CASE WHEN bool_or(is_temporal) THEN min_by(name, ordinal) FILTER (WHERE inferred_type = 'categorical' "
    "AND name IS DISTINCT FROM target_col AND unique_count BETWEEN 2 AND greatest(2, floor(num_rows * 0.5))) END AS group_col "
    "FROM prof p JOIN target t USING (table_name) GROUP BY 1)"
)
_TYPE = (
    "CASE WHEN q.inferred_type = 'numeric' AND time_rising THEN 'time_series_forecasting' "
    "WHEN group_col IS NOT NULL THEN 'grouped_prediction' "
    "WHEN q.inferred_type = 'categorical' OR (q.dtype LIKE '%int%' AND q.unique_count <= 20) THEN 'tabular_classification' "
    "ELSE 'tabular_regression' END"
)
FACTS = (
    "facts AS (SELECT t.table_name, t.target_col, task_confidence, time_col, group_col, q.inferred_type AS tt, q.dtype AS td, "
    f"q.unique_count AS tu, q.missing_fraction AS tm, q.min AS tmin, q.max AS tmax, q.has_negative_values AS tneg, {_TYPE} AS task_type "
    "FROM target t LEFT JOIN prof q ON q.table_name = t.table_name AND q.name = t.target_col "
    "JOIN times tm ON tm.table_name = t.table_name JOIN groups g ON g.table_name = t.table_name)"
)
_SUB = "CASE WHEN td LIKE '%int%' AND NOT tneg THEN 'count' WHEN tmin >= 0 AND tmax <= 1 THEN 'bounded' ELSE 'standard' END"
SPEC = (
    "spec AS (SELECT f.table_name, task_type, CASE task_type WHEN 'time_series_forecasting' THEN 'time_series' "
    "WHEN 'grouped_prediction' THEN 'grouped_tabular' ELSE 'tabular_iid' END AS modality, target_col, "
    "CASE WHEN tt = 'numeric' THEN 'numeric' ELSE 'categorical' END AS target_dtype, tu AS target_cardinality, "
    "CASE WHEN task_type IN ('time_series_forecasting', 'grouped_prediction') THEN time_col END AS time_col, "
    "CASE WHEN task_type IN ('time_series_forecasting', 'grouped_prediction') THEN group_col END AS group_col, "
    "CASE WHEN task_type = 'time_series_forecasting' THEN 24 END AS forecast_horizon, "
    "CASE WHEN task_type = 'time_series_forecasting' THEN (SELECT count(*) > 1 FROM prof p WHERE p.table_name = f.table_name AND inferred_type = 'numeric') END AS is_multivariate_ts, "
    "CASE WHEN task_type = 'tabular_classification' THEN CASE WHEN tu <= 2 THEN 'binary' ELSE 'multiclass' END END AS classification_subtype, "
    f"CASE WHEN task_type IN ('tabular_regression', 'time_series_forecasting') THEN {_SUB} END AS regression_subtype, "
    "task_confidence, CASE WHEN target_col IS NULL THEN 'TARGET_NOT_FOUND' WHEN tm > 0.5 THEN 'TARGET_TOO_SPARSE' "
    "WHEN tu <= 1 THEN 'TARGET_CONSTANT' END AS error_code FROM facts f)"
)
RULES = f"WITH {PROF}, {TARGET}, {TIMES}, {GROUPS}, {FACTS}, {SPEC}"


@query(
    "b8_profile_hints",
    f"WITH {PROF} SELECT table_name, max_by(name, ordinal) FILTER (WHERE inferred_type = 'numeric') AS suggested_target, "
    "'low' AS target_confidence, count_if(inferred_type = 'numeric') > 1 AS is_multivariate FROM prof GROUP BY 1",
)
def b8(spark, d):
    prof = catalog_profile(spark, d)
    return B.validate_hints(prof, B.profile_hints(prof))


@query("b10_temporal_coverage", "SELECT user_id, min(ts) AS earliest, max(ts) AS latest FROM events GROUP BY 1")
def b10(spark, d):
    return B.temporal_coverage(read(spark, d, "events"), "ts", "user_id")


@query(
    "b11_series_flags",
    f"WITH {EVENTS_SQL}, p AS (SELECT v, row_number() OVER (ORDER BY ts, event_id) - 1 AS x, lag(v, 24) OVER (ORDER BY ts, event_id) AS l FROM ev), "
    "q AS (SELECT quantile_cont(v, 0.25) AS a, quantile_cont(v, 0.75) AS b FROM ev) "
    "SELECT round(regr_r2(v, x), 6) AS trend_r2, round(corr(v, l), 6) AS lag_corr, CAST(count_if(v < a - 1.5 * (b - a) OR v > b + 1.5 * (b - a)) AS BIGINT) AS outlier_count, "
    "regr_r2(v, x) >= 0.5 AS has_trend, abs(corr(v, l)) >= 0.5 AS has_seasonality, "
    "count_if(v < a - 1.5 * (b - a) OR v > b + 1.5 * (b - a)) > 0 AS has_outliers FROM p, q",
)
def b11(spark, d):
    out = B.series_flags(events(spark, d), "v", ORDER, 24)
    return out.withColumns({"trend_r2": F.round("trend_r2", 6), "lag_corr": F.round("lag_corr", 6)})


# ---------------------------------------------------------------- C


@query("c1_confirm_target", f"WITH {PROF}, {TARGET} SELECT table_name, target_col, task_confidence, target_rule FROM target")
def c1(spark, d):
    return C.confirm_target(catalog_profile(spark, d))


@query(
    "c1_confirm_target_with_hints",
    f"WITH {PROF}, {TARGET} SELECT table_name, CASE table_name WHEN 'orders' THEN 'o_custkey' WHEN 'labels' THEN 'quality' ELSE target_col END AS target_col, "
    "CASE table_name WHEN 'orders' THEN 'high' WHEN 'labels' THEN 'low' ELSE task_confidence END AS task_confidence, "
    "CASE table_name WHEN 'orders' THEN 1 WHEN 'labels' THEN 4 ELSE target_rule END AS target_rule FROM target",
)
def c1_hints(spark, d):
    hints = spark.createDataFrame(
        [("orders", "o_custkey", "high"), ("labels", "quality", "low"), ("part", "p_size", "medium")],
        "table_name string, suggested_target string, target_confidence string",
    )
    return C.confirm_target(catalog_profile(spark, d), hints)


@query("c2_detect_time_col", f"WITH {PROF}, {TARGET}, {TIMES} SELECT table_name, time_col FROM times")
def c2(spark, d):
    prof = catalog_profile(spark, d)
    return C.detect_time_col(prof, C.confirm_target(prof)).select("table_name", "time_col")


@query("c3_detect_group_col", f"WITH {PROF}, {TARGET}, {GROUPS} SELECT table_name, group_col FROM groups")
def c3(spark, d):
    prof = catalog_profile(spark, d)
    return C.detect_group_col(prof, C.confirm_target(prof))


@query("c4_classify_task", f"{RULES} SELECT table_name, target_col, task_type, modality FROM spec")
def c4(spark, d):
    return C.classify_task(catalog_profile(spark, d))


@query(
    "c5_regression_subtype",
    f"WITH {PROF} SELECT table_name, name, CASE WHEN dtype LIKE '%int%' AND NOT has_negative_values THEN 'count' "
    "WHEN min >= 0 AND max <= 1 THEN 'bounded' ELSE 'standard' END AS subtype FROM prof WHERE inferred_type = 'numeric'",
)
def c5(spark, d):
    return C.regression_subtype(catalog_profile(spark, d).filter("inferred_type = 'numeric'"))


@query("c6_task_spec", f"{RULES} SELECT * FROM spec")
def c6(spark, d):
    return C.task_spec(catalog_profile(spark, d), forecast_horizon=24)


@query("c7_task_guards", f"{RULES} SELECT table_name, error_code FROM spec")
def c7(spark, d):
    return C.task_guards(catalog_profile(spark, d))


# ---------------------------------------------------------------- D


def _tasks(spark, d):
    prof = catalog_profile(spark, d)
    rows = prof.groupBy("table_name").agg(F.max("num_rows").alias("num_rows"))
    return C.task_spec(prof, forecast_horizon=24).join(rows, "table_name")


_ROUTE = (
    "route AS (SELECT s.*, CASE task_type WHEN 'tabular_regression' THEN 'random' WHEN 'time_series_forecasting' THEN 'chronological' "
    "WHEN 'grouped_prediction' THEN CASE WHEN group_col IS NULL THEN 'random' ELSE 'group_kfold' END "
    "ELSE CASE WHEN target_cardinality < 2 THEN 'random' ELSE 'stratified' END END AS split_strategy, "
    "CASE task_type WHEN 'tabular_regression' THEN 'rmse' WHEN 'time_series_forecasting' THEN 'mae' WHEN 'grouped_prediction' THEN 'rmse' "
    "ELSE CASE WHEN classification_subtype = 'binary' THEN 'roc_auc' ELSE 'f1_weighted' END END AS primary_metric, "
    "(SELECT max(num_rows) FROM prof p WHERE p.table_name = s.table_name) AS n FROM spec s)"
)


@query(
    "d1_route_protocol",
    f"{RULES}, {_ROUTE} SELECT table_name, task_type, split_strategy, split_strategy IN ('random', 'stratified') AS shuffle, primary_metric FROM route",
)
def d1(spark, d):
    return D.route_protocol(_tasks(spark, d)).select("table_name", "task_type", "split_strategy", "shuffle", "primary_metric")


_FR = (
    "fr AS (SELECT table_name, floor(n * 0.2::DOUBLE) < 30 AND 30.0::DOUBLE / n <= 0.3 AS small, 30.0::DOUBLE / n AS need FROM "
    "(SELECT table_name, max(num_rows) AS n FROM prof GROUP BY 1))"
)


@query(
    "d2_split_fractions",
    f"WITH {PROF}, {_FR} SELECT table_name, 0.7::DOUBLE AS train_fraction, "
    "round(CASE WHEN small THEN greatest(0.0::DOUBLE, 0.1::DOUBLE - (need - 0.2::DOUBLE)) ELSE 0.1::DOUBLE END, 6) AS val_fraction, "
    "round(CASE WHEN small THEN need ELSE 0.2::DOUBLE END, 6) AS test_fraction FROM fr",
)
def d2(spark, d):
    rows = catalog_profile(spark, d).groupBy("table_name").agg(F.max("num_rows").alias("num_rows"))
    return rows.withColumns(D.split_fractions(F.col("num_rows"))).drop("num_rows")


@query(
    "d3_protocol_guards",
    f"{RULES}, {_ROUTE} SELECT table_name, CASE WHEN split_strategy = 'group_kfold' THEN 'random' ELSE split_strategy END AS split_strategy, "
    "split_strategy = 'group_kfold' AS downgraded FROM route",
)
def d3(spark, d):
    tasks = _tasks(spark, d).withColumn("group_col", F.lit(None).cast("string"))
    return D.route_protocol(tasks).select("table_name", "split_strategy", "downgraded")


_METRICS = {
    "tabular_regression": ["rmse", "mae", "mape", "r2"],
    "time_series_forecasting": ["rmse", "mae", "mape", "smape", "pinball_loss", "coverage_80", "interval_width_80"],
    "tabular_classification": ["accuracy", "f1_weighted", "roc_auc"],
    "grouped_prediction": ["rmse", "mae", "mape", "r2"],
}


@query(
    "d4_select_metrics",
    f"{RULES} SELECT table_name, task_type, metric FROM spec JOIN (VALUES "
    + ", ".join(f"('{t}', '{m}')" for t, ms in _METRICS.items() for m in ms)
    + ") v(task_type, metric) USING (task_type)",
)
def d4(spark, d):
    return D.select_metrics(_tasks(spark, d), "quantile").drop("ordinal")


_PICKS = {
    "tabular_regression": ("DummyRegressor", "XGBoost", "SVR"),
    "grouped_prediction": ("DummyRegressor", "XGBoost", "SVR"),
    "tabular_classification": ("DummyClassifier", "XGBoost", "LinearModel"),
    "time_series_forecasting": ("DummyRegressor", "XGBoost", "RandomForest"),
}


@query(
    "h14_select_models",
    f"{RULES} SELECT table_name, tier, model FROM spec JOIN (VALUES "
    + ", ".join(
        f"('{t}', '{tier}', '{m}')" for t, ms in _PICKS.items() for tier, m in zip(("baseline", "classical", "specialized"), ms)
    )
    + ") v(task_type, tier, model) USING (task_type)",
)
def h14(spark, d):
    return M.select_models(_tasks(spark, d)).drop("substituted_from")
