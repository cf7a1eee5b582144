"""Ranking, cards, logs and chart data (K)."""

from __future__ import annotations

from pyspark.sql import functions as F

from registry.base import query, read
from registry.metrics import CLS, KEYS, PRED, SQL, classes, predictions
from seriesmill.functions import metrics as J
from seriesmill.operators import report as K

_EVAL = (
    f"ev AS (SELECT run_id, model, CASE WHEN model = 'error' AND run_id < '2024-01-05' THEN 'failed' ELSE 'evaluated' END AS status, "
    f"{SQL['mae']} AS mae, {SQL['rmse']} AS rmse, CASE WHEN model = 'click' AND run_id > '2024-01-20' THEN NULL ELSE {SQL['r2']} END AS r2 FROM pred GROUP BY 1, 2)"
)


def _evaluated(spark, d):
    out = J.compute_metrics(predictions(spark, d), KEYS, ["mae", "rmse", "r2"])
    failed = (F.col("model") == "error") & (F.col("run_id") < "2024-01-05")
    gone = (F.col("model") == "click") & (F.col("run_id") > "2024-01-20")
    return out.withColumn("status", F.when(failed, "failed").otherwise("evaluated")).withColumn(
        "r2", F.when(~gone, F.col("r2"))
    )


def _rank(metric: str, desc: bool) -> str:
    return (
        f"cmp AS (SELECT run_id, row_number() OVER (PARTITION BY run_id ORDER BY {metric} {'DESC' if desc else ''}, model) AS rank, "
        f"model, {metric} AS value FROM ev WHERE status = 'evaluated' AND {metric} IS NOT NULL)"
    )


_CMP = "SELECT run_id, CAST(rank AS INTEGER) AS rank, model, round(value, 6) AS value, rank = 1 AS is_best FROM cmp"


@query("k1_comparison_table", f"WITH {PRED}, {_EVAL}, {_rank('r2', True)} {_CMP}")
def k1(spark, d):
    return K.comparison_table(_evaluated(spark, d), "r2").withColumn("value", F.round("value", 6))


@query("k7_comparison_by_rmse", f"WITH {PRED}, {_EVAL}, {_rank('rmse', False)} {_CMP}")
def k7(spark, d):
    return K.comparison_table(_evaluated(spark, d), "rmse").withColumn("value", F.round("value", 6))


_BASE = "b AS (SELECT run_id, max_by(value, rank) AS base FROM cmp GROUP BY 1)"


@query(
    "k2_leaderboard",
    f"WITH {PRED}, {_EVAL}, {_rank('mae', False)}, {_BASE}, "
    "en AS (SELECT run_id, avg(value) AS value FROM cmp GROUP BY 1), "
    "al AS (SELECT run_id, rank, model, value FROM cmp UNION ALL SELECT run_id, NULL, 'Ensemble', value FROM en) "
    "SELECT run_id, CAST(rank AS INTEGER) AS rank, model, CASE WHEN rank IS NULL THEN 'ensemble' END AS tier, round(value, 5) AS value, round(base - value, 6) AS delta, "
    "round(CASE WHEN base = 0 THEN 0 ELSE (base - value) / abs(base) * 100 END, 4) AS delta_pct, "
    "CASE WHEN rank IS NULL THEN 'Ensemble' WHEN rank = 1 THEN 'Best Overall' WHEN rank = 2 THEN 'Strong Performer' ELSE 'Baseline' END AS recommendation "
    "FROM al JOIN b USING (run_id)",
)
def k2(spark, d):
    cmp = K.comparison_table(_evaluated(spark, d), "mae")
    extra = cmp.groupBy("run_id").agg(F.avg("value").alias("value"))
    board = K.leaderboard(cmp, higher_is_better=False, ensemble=extra)
    return board.withColumn("value", F.round("value", 5)).select(
        "run_id", "rank", "model", "tier", "value", "delta", "delta_pct", "recommendation"
    )


@query(
    "k3_model_cards",
    f"WITH {PRED}, {_EVAL}, {_rank('mae', False)}, tr AS (SELECT run_id, model, count(*) AS n_train FROM pred GROUP BY 1, 2 HAVING count(*) > 60), "
    "se AS (SELECT run_id, min(model) AS model, 'first by name' AS rationale FROM pred GROUP BY 1) "
    "SELECT run_id, model, status, round(mae, 6) AS mae, n_train, rationale, CAST(rank AS INTEGER) AS rank, coalesce(rank = 1, false) AS is_recommended "
    "FROM ev LEFT JOIN tr USING (run_id, model) LEFT JOIN se USING (run_id, model) LEFT JOIN cmp USING (run_id, model)",
)
def k3(spark, d):
    pred, ev = predictions(spark, d), _evaluated(spark, d)
    train = pred.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n_train")).filter("n_train > 60")
    chosen = pred.groupBy("run_id").agg(F.min("model").alias("model")).withColumn("rationale", F.lit("first by name"))
    cards = K.model_cards(ev, train, chosen, K.comparison_table(ev, "mae"))
    return cards.select(*KEYS, "status", F.round("mae", 6).alias("mae"), "n_train", "rationale", "rank", "is_recommended")


_STAGES = (
    "st AS (SELECT user_id AS run_id, strftime(ts, '%Y-%m-%d') AS stage, min(CASE WHEN event_type = 'view' THEN ts END) AS started_at, "
    "max(CASE WHEN event_type = 'purchase' THEN ts END) AS completed_at FROM events GROUP BY 1, 2), "
    "ss AS (SELECT *, CASE WHEN completed_at IS NOT NULL THEN 'completed' WHEN started_at IS NOT NULL THEN 'running' ELSE 'pending' END AS status FROM st)"
)


def _stages(spark, d):
    ev = read(spark, d, "events").selectExpr("user_id AS run_id", "date_format(ts, 'yyyy-MM-dd') AS stage", "event_type", "ts")
    return K.stages_from_events(ev, "run_id", "stage", "event_type", "ts", "view", "purchase")


@query(
    "k4_stage_durations",
    f"WITH {_STAGES} SELECT run_id, stage, started_at, completed_at, status, "
    "round((epoch_us(completed_at) - epoch_us(started_at)) / 1e6::DOUBLE, 3) AS duration_seconds FROM ss",
)
def k4(spark, d):
    return _stages(spark, d)


@query(
    "k5_run_summary",
    f"WITH {_STAGES} SELECT run_id, CAST(count_if(status = 'completed') AS BIGINT) AS completed, string_agg(stage || '=' || status, ';' ORDER BY stage) AS stages FROM ss GROUP BY 1",
)
def k5(spark, d):
    out = K.run_summary(_stages(spark, d))
    text = F.array_join(F.transform(F.map_entries("stages"), lambda e: F.concat_ws("=", e["key"], e["value"])), ";")
    return out.select("run_id", "completed", text.alias("stages"))


@query(
    "k6_missing_artifacts",
    "WITH e AS (SELECT DISTINCT user_id, strftime(ts, '%Y-%m-%d') AS artifact FROM events), "
    "p AS (SELECT DISTINCT user_id, strftime(ts, '%Y-%m-%d') AS artifact FROM events WHERE event_type = 'purchase') "
    "SELECT user_id, artifact, true AS missing, 'file not found' AS reason FROM e WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.user_id = e.user_id AND p.artifact = e.artifact)",
)
def k6(spark, d):
    ev = read(spark, d, "events").selectExpr("user_id", "date_format(ts, 'yyyy-MM-dd') AS artifact", "event_type")
    expected = ev.select("user_id", "artifact").distinct()
    present = ev.filter("event_type = 'purchase'").select("user_id", "artifact").distinct()
    return K.missing_artifacts(expected, present, ["user_id", "artifact"])


# three models per order
_M3 = (
    "m3 AS (SELECT o_orderkey, o_totalprice AS y_true, unnest(['a', 'b', 'c']) AS model, "
    "unnest([o_totalprice * 0.9::DOUBLE, CAST(o_custkey * 10 AS DOUBLE), 250000.0::DOUBLE]) AS y_pred FROM orders)"
)


def _three(spark, d):
    return read(spark, d, "orders").selectExpr(
        "o_orderkey",
        "o_totalprice AS y_true",
        "inline(array(struct('a' AS model, o_totalprice * 0.9D AS y_pred), "
        "struct('b' AS model, CAST(o_custkey * 10 AS DOUBLE) AS y_pred), struct('c' AS model, 250000D AS y_pred)))",
    )


def _ens(expr: str) -> str:
    return f"WITH {_M3} SELECT o_orderkey, first(y_true) AS y_true, round({expr}, 4) AS y_pred FROM m3 GROUP BY 1"


@query("k8_ensemble_mean", _ens("avg(y_pred)"))
def k8(spark, d):
    return K.ensemble(_three(spark, d), "o_orderkey").withColumn("y_pred", F.round("y_pred", 4))


@query("k8_ensemble_median", _ens("median(y_pred)"))
def k8_median(spark, d):
    return K.ensemble(_three(spark, d), "o_orderkey", "median").withColumn("y_pred", F.round("y_pred", 4))


_W = "CASE model WHEN 'a' THEN 0.5::DOUBLE WHEN 'b' THEN 0.3::DOUBLE ELSE 0.2::DOUBLE END"


@query("k8_ensemble_weighted", _ens(f"sum({_W} * y_pred) / sum({_W})"))
def k8_weighted(spark, d):
    weights = spark.createDataFrame([("a", 0.5), ("b", 0.3), ("c", 0.2)], "model string, weight double")
    return K.ensemble(_three(spark, d), "o_orderkey", "weighted", weights).withColumn("y_pred", F.round("y_pred", 4))


@query(
    "k8_ensemble_quantiles",
    f"WITH {_M3} SELECT o_orderkey, round(avg(y_pred), 4) AS y_pred, CASE WHEN o_orderkey % 4 > 0 THEN round(avg(y_pred * 0.8::DOUBLE), 4) END AS q10, "
    "CASE WHEN o_orderkey % 4 > 0 THEN round(avg(y_pred), 4) END AS q50, CASE WHEN o_orderkey % 4 > 0 THEN round(avg(y_pred * 1.2::DOUBLE), 4) END AS q90 "
    "FROM m3 GROUP BY o_orderkey",
)
def k8_quantiles(spark, d):
    low = "CASE WHEN model = 'b' AND o_orderkey % 4 = 0 THEN NULL ELSE y_pred * 0.8D END AS q10"
    df = _three(spark, d).selectExpr("*", low, "y_pred AS q50", "y_pred * 1.2D AS q90")
    out = K.ensemble_quantiles(df, "o_orderkey")
    return out.select("o_orderkey", *[F.round(c, 4).alias(c) for c in ("y_pred", "q10", "q50", "q90")])


@query(
    "k9_residual_histogram",
    f"WITH {PRED}, s AS (SELECT model, min(y_true - y_pred) AS lo, max(y_true - y_pred) AS hi, CAST(least(30, greatest(5, count(*) // 10)) AS INTEGER) AS bins FROM pred GROUP BY 1), "
    "b AS (SELECT model, CAST(least(floor((y_true - y_pred - lo) / (hi - lo) * bins) + 1, bins) AS INTEGER) AS bin, count(*) AS c FROM pred JOIN s USING (model) GROUP BY 1, 2), "
    "f AS (SELECT *, CAST(unnest(range(1, bins + 1)) AS INTEGER) AS bin FROM s) "
    "SELECT model, bin, round(lo + (hi - lo) / bins * (bin - 1), 4) AS low, round(lo + (hi - lo) / bins * bin, 4) AS high, coalesce(c, 0) AS count FROM f LEFT JOIN b USING (model, bin)",
)
def k9(spark, d):
    out = K.residual_histogram(predictions(spark, d))
    return out.withColumns({"low": F.round("low", 4), "high": F.round("high", 4)})


@query(
    "k10_scatter_data",
    f"WITH {PRED} SELECT model, row_key, y_true, y_pred FROM (SELECT *, row_number() OVER (PARTITION BY model ORDER BY md5('42:' || CAST(row_key AS VARCHAR)), row_key) AS r FROM pred) WHERE r <= 200",
)
def k10(spark, d):
    return K.scatter_data(predictions(spark, d), 200, "row_key")


@query(
    "k10_identity_range",
    f"WITH {PRED} SELECT model, least(min(y_true), min(y_pred)) AS low, greatest(max(y_true), max(y_pred)) AS high FROM pred GROUP BY 1",
)
def k10_range(spark, d):
    return K.identity_range(predictions(spark, d))


@query(
    "k11_trace",
    f"WITH {PRED} SELECT model, CAST(r - 1 AS INTEGER) AS step, y_true, y_pred FROM (SELECT *, row_number() OVER (PARTITION BY model ORDER BY row_key) AS r FROM pred) WHERE r <= 100",
)
def k11(spark, d):
    return K.trace(predictions(spark, d), "row_key", 100)


@query(
    "k12_confusion_matrix",
    "WITH c AS (SELECT o_orderstatus AS model, o_orderpriority AS y_true, CASE WHEN o_custkey % 3 = 0 THEN '1-URGENT' ELSE o_orderpriority END AS y_pred FROM orders), "
    "k AS (SELECT model, y_true AS c FROM c UNION SELECT model, y_pred FROM c) "
    "SELECT a.model, a.c AS y_true, b.c AS y_pred, count(c.model) AS n FROM k a JOIN k b ON a.model = b.model "
    "LEFT JOIN c ON c.model = a.model AND c.y_true = a.c AND c.y_pred = b.c GROUP BY 1, 2, 3",
)
def k12(spark, d):
    df = read(spark, d, "orders").selectExpr(
        "o_orderstatus AS model", "o_orderpriority AS y_true",
        "CASE WHEN o_custkey % 3 = 0 THEN '1-URGENT' ELSE o_orderpriority END AS y_pred",
    )
    return K.confusion_matrix(df)


@query(
    "k13_roc_curve",
    f"WITH {CLS}, s AS (SELECT model, y_score, CAST(count_if(y_true = 1) AS DOUBLE) AS pos, CAST(count_if(y_true = 0) AS DOUBLE) AS neg FROM cls GROUP BY 1, 2) "
    "SELECT model, y_score AS threshold, round(sum(neg) OVER w / sum(neg) OVER (PARTITION BY model), 6) AS fpr, "
    "round(sum(pos) OVER w / sum(pos) OVER (PARTITION BY model), 6) AS tpr FROM s WINDOW w AS (PARTITION BY model ORDER BY y_score DESC)",
)
def k13(spark, d):
    return K.roc_curve(classes(spark, d)).withColumns({"fpr": F.round("fpr", 6), "tpr": F.round("tpr", 6)})


@query("k14_chart_data", f"WITH {PRED}, {_EVAL}, {_rank('mae', False)} SELECT run_id, model, round(value, 6) AS value FROM cmp")
def k14(spark, d):
    cmp = K.comparison_table(_evaluated(spark, d), "mae")
    return K.chart_data(cmp).withColumn("value", F.round("value", 6))


@query(
    "k12_confusion_cells",
    "SELECT o_orderstatus AS model, o_custkey % 1000 AS y_true, (o_custkey + o_orderkey % 3) % 1000 AS y_pred, count(*) AS n FROM orders GROUP BY 1, 2, 3",
)
def k12_cells(spark, d):
    df = read(spark, d, "orders").selectExpr("o_orderstatus AS model", "o_custkey % 1000 AS y_true", "(o_custkey + o_orderkey % 3) % 1000 AS y_pred")
    return K.confusion_matrix(df, zeros=False)
