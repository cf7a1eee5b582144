"""Evaluation protocol: split strategy, fractions and metrics, as rules over the task table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Default fractions, smallest test set, routing and metric catalog.
TRAIN_FRACTION, VAL_FRACTION, TEST_FRACTION = 0.7, 0.1, 0.2
MINIMUM_TEST_SAMPLES = 30
ROUTES = [
    # task_type, classification_subtype, split_strategy, shuffle, primary_metric
    ("tabular_regression", None, "random", True, "rmse"),
    ("tabular_classification", "binary", "stratified", True, "roc_auc"),
    ("tabular_classification", "multiclass", "stratified", True, "f1_weighted"),
    ("time_series_forecasting", None, "chronological", False, "mae"),
    ("grouped_prediction", None, "group_kfold", False, "rmse"),
]
REGRESSION, FORECASTING, CLASSIFICATION = "tabular_regression", "time_series_forecasting", "tabular_classification"
METRICS = [
    # name, display name, higher is better, tasks, prediction type it needs
    ("rmse", "RMSE", False, [REGRESSION, FORECASTING], None),
    ("mae", "MAE", False, [REGRESSION, FORECASTING], None),
    ("mape", "MAPE (%)", False, [REGRESSION, FORECASTING], None),
    ("smape", "sMAPE (%)", False, [FORECASTING], None),
    ("pinball_loss", "Pinball Loss", False, [FORECASTING], "quantile"),
    ("coverage_80", "Coverage @ 80%", True, [FORECASTING], "quantile"),
    ("interval_width_80", "Interval Width @ 80%", False, [FORECASTING], "quantile"),
    ("r2", "R²", True, [REGRESSION], None),
    ("accuracy", "Accuracy", True, [CLASSIFICATION], None),
    ("f1_weighted", "F1 (weighted)", True, [CLASSIFICATION], None),
    ("roc_auc", "ROC-AUC", True, [CLASSIFICATION], None),
]
GROUPED_METRICS = ["rmse", "mae", "mape", "r2"]
HIGHER_IS_BETTER = {name: higher for name, _, higher, _, _ in METRICS}


def metric_catalog(spark: SparkSession) -> DataFrame:
    rows = [(i, *m) for i, m in enumerate(METRICS)]
    return spark.createDataFrame(
        rows,
        "ordinal int, metric string, display_name string, higher_is_better boolean, tasks array<string>, requires string",
    )


def route_protocol(tasks: DataFrame) -> DataFrame:
    """Adds split_strategy, shuffle and primary_metric; falls back to random where the strategy cannot work."""
    routes = tasks.sparkSession.createDataFrame(
        ROUTES, "r_task string, r_sub string, split_strategy string, shuffle boolean, primary_metric string"
    )
    match = (F.col("task_type") == F.col("r_task")) & (
        F.col("r_sub").isNull() | (F.coalesce("classification_subtype", F.lit("multiclass")) == F.col("r_sub"))
    )
    out = tasks.join(F.broadcast(routes), match, "left").drop("r_task", "r_sub")  # five fixed routes
    return protocol_guards(out)


def protocol_guards(protocol: DataFrame) -> DataFrame:
    """Downgrades to random: a group split without a group column, stratifying with fewer than two classes."""
    bad = ((F.col("split_strategy") == "group_kfold") & F.col("group_col").isNull()) | (
        (F.col("split_strategy") == "stratified") & (F.col("target_cardinality") < 2)
    )
    return protocol.withColumns(
        {
            "split_strategy": F.when(bad, "random").otherwise(F.col("split_strategy")),
            "shuffle": F.when(bad, True).otherwise(F.col("shuffle")),
            "downgraded": F.coalesce(bad, F.lit(False)),
        }
    )


def split_fractions(n: Column) -> dict[str, Column]:
    """Train, val and test fraction for ``n`` rows; a small test set grows to 30 rows at the cost of val."""
    n = n.cast("double")
    needed = F.lit(float(MINIMUM_TEST_SAMPLES)) / n
    small = (F.floor(n * TEST_FRACTION) < MINIMUM_TEST_SAMPLES) & (needed <= 0.3)
    test = F.when(small, needed).otherwise(F.lit(TEST_FRACTION))
    val = F.when(small, F.greatest(F.lit(0.0), VAL_FRACTION - (needed - TEST_FRACTION))).otherwise(F.lit(VAL_FRACTION))
    return {
        "train_fraction": F.lit(TRAIN_FRACTION),
        "val_fraction": F.round(val, 6),
        "test_fraction": F.round(test, 6),
    }


def select_metrics(tasks: DataFrame, prediction_type: str = "point") -> DataFrame:
    """(table_name, metric, ordinal): the metrics that apply to each table's task."""
    rows = [("grouped_prediction", m, i) for i, m in enumerate(GROUPED_METRICS)]
    rows += [
        (task, name, i)
        for i, (name, _, _, used_by, needs) in enumerate(METRICS)
        for task in used_by
        if needs is None or needs == prediction_type
    ]
    by_task = tasks.sparkSession.createDataFrame(rows, "task_type string, metric string, ordinal int")
    # a fixed table of task and metric names
    return tasks.select("table_name", "task_type").join(F.broadcast(by_task), "task_type").select(
        "table_name", "task_type", "metric", "ordinal"
    )


def eval_protocol(tasks: DataFrame, num_rows: str = "num_rows", prediction_type: str = "point") -> DataFrame:
    """The whole protocol: route, fractions and metric list, one row per table."""
    routed = route_protocol(tasks).withColumns(split_fractions(F.col(num_rows)))
    names = select_metrics(tasks, prediction_type).groupBy("table_name").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "metric"))), lambda m: m["metric"]).alias("metrics")
    )
    return routed.join(names, "table_name", "left").withColumns(
        {"prediction_type": F.lit(prediction_type), "minimum_test_samples": F.lit(MINIMUM_TEST_SAMPLES)}
    )
