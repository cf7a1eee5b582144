"""Metrics over predictions (J)."""

from __future__ import annotations

from pyspark.sql import functions as F

from registry.base import query, read
from seriesmill.functions import metrics as J

KEYS = ["run_id", "model"]
# a prediction per event: the run is the day, the model the event type
PRED = (
    "pred AS (SELECT strftime(ts, '%Y-%m-%d') AS run_id, event_type AS model, event_id AS row_key, "
    "CASE WHEN event_id % 50 = 0 THEN 0.0::DOUBLE ELSE value END AS y_true, "
    "CASE WHEN event_id % 100 = 0 THEN 0.0::DOUBLE ELSE CAST(user_id % 100 AS DOUBLE) END AS y_pred FROM events)"
)


def predictions(spark, d):
    return read(spark, d, "events").selectExpr(
        "date_format(ts, 'yyyy-MM-dd') AS run_id",
        "event_type AS model",
        "event_id AS row_key",
        "CASE WHEN event_id % 50 = 0 THEN 0D ELSE value END AS y_true",
        "CASE WHEN event_id % 100 = 0 THEN 0D ELSE CAST(user_id % 100 AS DOUBLE) END AS y_pred",
    )


# a class per line item: is it returned, guessed from the discount, scored by the quantity
CLS = (
    "cls AS (SELECT l_linestatus AS model, l_orderkey, l_linenumber, CAST(l_returnflag = 'R' AS INTEGER) AS y_true, "
    "CAST(l_discount > 0.05 AS INTEGER) AS y_pred, l_quantity AS y_score FROM lineitem)"
)


def classes(spark, d):
    return read(spark, d, "lineitem").selectExpr(
        "l_linestatus AS model", "l_orderkey", "l_linenumber", "CAST(l_returnflag = 'R' AS INT) AS y_true",
        "CAST(l_discount > 0.05 AS INT) AS y_pred", "l_quantity AS y_score",
    )


# the quality of labelled documents, scored by their length
DOC = (
    "doc AS (SELECT source AS model, quality AS y_true, CAST(n_chars AS DOUBLE) AS y_score, "
    "CAST(n_chars > 400 AS INTEGER) AS y_pred FROM labels JOIN documents USING (doc_id))"
)


def doc_scores(spark, d):
    joined = read(spark, d, "labels").join(read(spark, d, "documents").select("doc_id", "source", "n_chars"), "doc_id")
    return joined.selectExpr(
        "source AS model", "quality AS y_true", "CAST(n_chars AS DOUBLE) AS y_score", "CAST(n_chars > 400 AS INT) AS y_pred"
    )


_E = "(y_true - y_pred)"
SQL = {
    "rmse": f"sqrt(avg({_E} * {_E}))",
    "mae": f"avg(abs({_E}))",
    "mape": f"avg(abs({_E} / nullif(y_true, 0)))",
    "smape": f"avg(coalesce(2 * abs({_E}) / nullif(abs(y_true) + abs(y_pred), 0), 0))",
    "r2": f"CASE WHEN count(*) < 2 THEN NULL WHEN var_pop(y_true) = 0 THEN CASE WHEN sum({_E} * {_E}) = 0 THEN 1.0 ELSE 0.0 END "
    f"ELSE 1 - sum({_E} * {_E}) / (var_pop(y_true) * count(*)) END",
}


def _by_run(expr: str, name: str) -> str:
    return f"WITH {PRED} SELECT run_id, model, round(CAST({expr} AS DOUBLE), 6) AS {name} FROM pred GROUP BY 1, 2"


def _metric(name: str, key: str, column, expr: str) -> None:
    @query(key, _by_run(expr, name))
    def run(spark, d):
        return predictions(spark, d).groupBy(*KEYS).agg(F.round(column(), 6).alias(name))


_metric("rmse", "j1_rmse", J.rmse, SQL["rmse"])
_metric("mae", "j2_mae", J.mae, SQL["mae"])
_metric("mape", "j3_mape", J.mape, SQL["mape"])
_metric("r2", "j4_r2", J.r2, SQL["r2"])
_metric("smape", "j5_smape", J.smape, SQL["smape"])


@query(
    "j6_accuracy",
    f"WITH {CLS} SELECT model, round(avg(CAST(y_true = y_pred AS INTEGER)), 6) AS accuracy FROM cls GROUP BY 1",
)
def j6(spark, d):
    return classes(spark, d).groupBy("model").agg(F.round(J.accuracy(), 6).alias("accuracy"))


_F1 = (
    "f1 AS (SELECT model, sum(2 * tp / (t + g) * t) / sum(t) AS f FROM (SELECT model, c, "
    "CAST(count_if(y_true = c AND y_pred = c) AS DOUBLE) AS tp, CAST(count_if(y_true = c) AS DOUBLE) AS t, CAST(count_if(y_pred = c) AS DOUBLE) AS g "
    "FROM cls, (SELECT DISTINCT y_true AS c FROM cls UNION SELECT DISTINCT y_pred FROM cls) GROUP BY 1, 2) WHERE t + g > 0 GROUP BY 1)"
)


@query("j7_f1_weighted", f"WITH {CLS}, {_F1} SELECT model, round(f, 6) AS f1_weighted FROM f1")
def j7(spark, d):
    return J.f1_weighted(classes(spark, d), ["model"]).withColumn("f1_weighted", F.round("f1_weighted", 6))


@query(
    "j7_f1_weighted_text_classes",
    "WITH c AS (SELECT o_orderstatus AS model, o_orderpriority AS y, CASE WHEN o_custkey % 3 = 0 THEN '1-URGENT' ELSE o_orderpriority END AS p FROM orders), "
    "k AS (SELECT DISTINCT y AS c FROM c), x AS (SELECT model, k.c, CAST(count_if(y = k.c AND p = k.c) AS DOUBLE) AS tp, CAST(count_if(y = k.c) AS DOUBLE) AS t, "
    "CAST(count_if(p = k.c) AS DOUBLE) AS g FROM c, k GROUP BY 1, 2) "
    "SELECT model, round(sum(coalesce(2 * tp / nullif(t + g, 0), 0) * t) / sum(t), 6) AS f1_weighted FROM x GROUP BY 1",
)
def j7_text(spark, d):
    df = read(spark, d, "orders").selectExpr(
        "o_orderstatus AS model", "o_orderpriority AS y_true",
        "CASE WHEN o_custkey % 3 = 0 THEN '1-URGENT' ELSE o_orderpriority END AS y_pred",
    )
    return J.f1_weighted(df, ["model"]).withColumn("f1_weighted", F.round("f1_weighted", 6))


def _auc(src: str) -> str:
    return (
        f"a AS (SELECT model, sum(pos * (below + neg / 2.0::DOUBLE)) / nullif(sum(pos) * sum(neg), 0) AS auc FROM (SELECT *, "
        "CAST(coalesce(sum(neg) OVER (PARTITION BY model ORDER BY y_score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE) AS below FROM "
        f"(SELECT model, y_score, CAST(count_if(y_true = 1) AS DOUBLE) AS pos, CAST(count_if(y_true = 0) AS DOUBLE) AS neg FROM {src} GROUP BY 1, 2)) GROUP BY 1)"
    )


@query("j8_roc_auc", f"WITH {CLS}, {_auc('cls')} SELECT model, round(auc, 6) AS roc_auc FROM a")
def j8(spark, d):
    return J.roc_auc(classes(spark, d), ["model"]).withColumn("roc_auc", F.round("roc_auc", 6))


@query("j8_roc_auc_documents", f"WITH {DOC}, {_auc('doc')} SELECT model, round(auc, 6) AS roc_auc FROM a")
def j8_doc(spark, d):
    return J.roc_auc(doc_scores(spark, d), ["model"]).withColumn("roc_auc", F.round("roc_auc", 6))


@query("j8_roc_auc_needs_two_classes", "SELECT l_linestatus AS model, CAST(NULL AS DOUBLE) AS roc_auc FROM lineitem GROUP BY 1")
def j8_three(spark, d):
    df = read(spark, d, "lineitem").selectExpr("l_linestatus AS model", "l_returnflag AS y_true", "l_quantity AS y_score")
    return J.roc_auc(df, ["model"])


_ALL = ["rmse", "mae", "mape", "smape", "r2"]


@query(
    "j9_compute_metrics",
    f"WITH {PRED} SELECT run_id, model, "
    + ", ".join(f"round(CAST({SQL[m]} AS DOUBLE), 6) AS {m}" for m in _ALL)
    + ", CAST(NULL AS DOUBLE) AS unheard_of FROM pred GROUP BY 1, 2",
)
def j9(spark, d):
    out = J.compute_metrics(predictions(spark, d), KEYS, [*_ALL, "unheard_of"])
    return out.select(*KEYS, *[F.round(m, 6).alias(m) for m in _ALL], "unheard_of")


@query(
    "j9_compute_class_metrics",
    f"WITH {CLS}, {_F1}, {_auc('cls')}, c AS (SELECT model, avg(CAST(y_true = y_pred AS INTEGER)) AS acc FROM cls GROUP BY 1) "
    "SELECT model, round(acc, 6) AS accuracy, round(f, 6) AS f1_weighted, round(auc, 6) AS roc_auc FROM c JOIN f1 USING (model) JOIN a USING (model)",
)
def j9_cls(spark, d):
    names = ["accuracy", "f1_weighted", "roc_auc"]
    out = J.compute_metrics(classes(spark, d), ["model"], names)
    return out.select("model", *[F.round(m, 6).alias(m) for m in names])


@query(
    "j10_sanitize",
    "SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_discount = 0 OR l_tax = 0 THEN NULL ELSE round(l_tax / l_discount, 6) END AS x FROM lineitem",
)
def j10(spark, d):
    df = read(spark, d, "lineitem").selectExpr(
        "l_orderkey", "l_linenumber", "l_partkey",
        "CASE WHEN l_tax = 0 THEN double('NaN') WHEN l_discount = 0 THEN double('-Infinity') ELSE round(l_tax / l_discount, 6) END AS x",
    )
    return J.sanitize(df, ["x"])


# quantile forecasts per event: a band around the user's mean value
BAND = (
    "band AS (SELECT event_type AS model, value AS y_true, 0.5::DOUBLE * m AS q10, m AS q50, 1.75::DOUBLE * m AS q90 FROM events "
    "JOIN (SELECT user_id, avg(value) AS m FROM events GROUP BY 1) USING (user_id))"
)


def bands(spark, d):
    ev = read(spark, d, "events").select("event_type", "user_id", "value")
    means = ev.groupBy("user_id").agg(F.avg("value").alias("m"))
    return ev.join(means, "user_id").selectExpr(
        "event_type AS model", "value AS y_true", "0.5D * m AS q10", "m AS q50", "1.75D * m AS q90"
    )


def _pin(q: float, c: str) -> str:
    return f"avg(greatest({q}::DOUBLE * (y_true - {c}), ({q}::DOUBLE - 1) * (y_true - {c})))"


@query("j11_pinball", f"WITH {BAND} SELECT model, round({_pin(0.9, 'q90')}, 6) AS pinball FROM band GROUP BY 1")
def j11(spark, d):
    return bands(spark, d).groupBy("model").agg(F.round(J.pinball(0.9, p="q90"), 6).alias("pinball"))


@query(
    "j12_coverage_80",
    f"WITH {BAND} SELECT model, round(avg(CAST(y_true BETWEEN q10 AND q90 AS INTEGER)), 6) AS coverage_80 FROM band GROUP BY 1",
)
def j12(spark, d):
    return bands(spark, d).groupBy("model").agg(F.round(J.coverage_80(), 6).alias("coverage_80"))


@query("j13_interval_width_80", f"WITH {BAND} SELECT model, round(avg(q90 - q10), 6) AS interval_width_80 FROM band GROUP BY 1")
def j13(spark, d):
    return bands(spark, d).groupBy("model").agg(F.round(J.interval_width_80(), 6).alias("interval_width_80"))


@query(
    "j14_residual_stats",
    f"WITH {PRED} SELECT model, round(avg({_E}), 6) AS mean_residual, round(stddev_samp({_E}), 6) AS std_residual, "
    f"round(max(abs({_E})), 6) AS max_error FROM pred GROUP BY 1",
)
def j14(spark, d):
    aggs = [F.round(c, 6).alias(n) for n, c in J.residual_stats().items()]
    return predictions(spark, d).groupBy("model").agg(*aggs)


@query(
    "j15_mape_percent_eps",
    f"WITH {PRED} SELECT model, round(log10(avg(abs({_E}) / greatest(abs(y_true), 2.220446049250313e-16::DOUBLE)) * 100), 6) AS log_mape FROM pred GROUP BY 1",
)
def j15(spark, d):
    value = F.log10(J.mape(percent=True, zeros="eps"))
    return predictions(spark, d).groupBy("model").agg(F.round(value, 6).alias("log_mape"))


@query(
    "j16_cv_aggregate",
    f"WITH {PRED}, f AS (SELECT run_id, model, {SQL['mae']} AS value FROM pred GROUP BY 1, 2) "
    "SELECT model, round(avg(value), 6) AS mean, round(median(value), 6) AS median FROM f GROUP BY 1",
)
def j16(spark, d):
    folds = predictions(spark, d).groupBy(*KEYS).agg(J.mae().alias("value"))
    out = J.cv_aggregate(folds, ["model"])
    return out.select("model", F.round("mean", 6).alias("mean"), F.round("median", 6).alias("median"))
