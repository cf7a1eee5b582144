"""A table to a ranking in one call, for each kind of task; boosting runs 10 rounds, everything else at its defaults."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from registry.base import query, read
from registry.models import _TRAINED
from seriesmill.plans.flow import run_flow

_ROUNDS = {"XGBoost": {"n_estimators": 10}}
_CLASSIFIERS = [("DummyClassifier", "baseline"), ("XGBoost", "classical"), ("LinearModel", "specialized")]  # lent by another tier


def _sql(name: str, task: str, strategy: str, metric: str, picks: list[tuple[str, str]], rows: str, baseline: str = "NULL::DOUBLE") -> str:
    models = ", ".join(f"('{m}', '{t}')" for m, t in picks)
    return (
        f"SELECT '{name}' AS table_name, '{task}' AS task_type, '{strategy}' AS split_strategy, '{metric}' AS primary_metric, "
        f"'completed' AS status, model, tier, {rows} AS n_test, TRUE AS valued, "
        f"CASE WHEN model LIKE 'Dummy%' THEN {baseline} END AS baseline, TRUE AS not_worse FROM (VALUES {models}) AS m(model, tier)"
    )


def _outcome(df: DataFrame, name: str, baseline: bool = False) -> DataFrame:
    """Models of a run with their rows scored; the best is at least as good as the dummy's value."""
    flow = run_flow(df, "id", name, params=_ROUNDS)
    if flow.ranking is None:
        raise RuntimeError(f"{name}: {flow.stages}")
    n = flow.predictions.groupBy("model").agg(F.count("y_pred").alias("n_test"))
    p, dummy = flow.protocol, F.col("model").startswith("Dummy")
    best = flow.ranking.select(F.max(F.when(F.col("rank") == 1, F.col("delta"))).alias("gain")).first()["gain"]  # over the last rank
    out = flow.ranking.join(n, "model")
    return out.select(
        *[F.lit(v).alias(c) for c, v in (("table_name", name), ("task_type", p["task_type"]), ("split_strategy", p["split_strategy"]))],
        F.lit(p["primary_metric"]).alias("primary_metric"), F.lit(flow.status).alias("status"), "model", "tier", "n_test",
        F.col("value").isNotNull().alias("valued"),
        F.when(dummy & F.lit(baseline), F.round("value", 2)).alias("baseline"), F.lit(best >= 0).alias("not_worse"),
    )


def _orders(spark, d, target: str) -> DataFrame:
    return read(spark, d, "orders").selectExpr(
        "o_orderkey AS id", "o_custkey", "o_orderpriority", "CAST(unix_date(CAST(o_orderdate AS DATE)) AS DOUBLE) AS day", target
    )


@query(
    "flow_regression",
    f"WITH {_TRAINED} "
    + _sql(
        "prices", "tabular_regression", "random", "rmse", [("DummyRegressor", "baseline"), ("XGBoost", "classical"), ("SVR", "specialized")],
        "(SELECT count(*) FROM t WHERE split = 'test')",
        "(SELECT round(sqrt(avg(pow(o_totalprice - (SELECT avg(o_totalprice) FROM t WHERE split = 'train'), 2))), 2) FROM t WHERE split = 'test')",
    ),
)
def regression(spark, d):
    return _outcome(_orders(spark, d, "CAST(o_totalprice AS DOUBLE) AS target"), "prices", True)


_STRATIFIED = "(SELECT CAST(ceil(count(*) * 0.2::DOUBLE) AS BIGINT) FROM orders)"


@query("flow_binary", _sql("finished", "tabular_classification", "stratified", "roc_auc", _CLASSIFIERS, _STRATIFIED))
def binary(spark, d):
    return _outcome(_orders(spark, d, "CASE WHEN o_orderstatus = 'F' THEN 'finished' ELSE 'open' END AS label"), "finished")


@query("flow_multiclass", _sql("status", "tabular_classification", "stratified", "f1_weighted", _CLASSIFIERS, _STRATIFIED))
def multiclass(spark, d):
    return _outcome(_orders(spark, d, "o_orderstatus AS label"), "status")


@query(
    "flow_forecast",
    "WITH h AS (SELECT date_trunc('hour', ts) AS hour, avg(value) AS target FROM events GROUP BY 1), c AS (SELECT count(*) - 24 AS n FROM h) "
    + _sql(
        "hours", "time_series_forecasting", "chronological", "mae", [("DummyRegressor", "baseline"), ("XGBoost", "classical"), ("ARIMA", "specialized")],
        "(SELECT CAST(n - floor(n * 0.7::DOUBLE) - floor(n * 0.1::DOUBLE) AS BIGINT) FROM c)",
    ),
)
def forecast(spark, d):
    """Hours without their first 24, which have no full lags."""
    hours = read(spark, d, "events").groupBy(F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour"))
    hours = hours.agg(F.avg("value").alias("target"))
    return _outcome(hours.withColumn("id", F.unix_timestamp(F.col("hour").cast("timestamp"))), "hours")
