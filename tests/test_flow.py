"""One call from a table to a ranking: regression, classes, forecasts, and runs that end early."""

import numpy as np
import pandas as pd
import pytest

from seriesmill.plans.flow import STAGES, run_flow

FAST = {"XGBoost": {"n_estimators": 3, "max_depth": 3}, "RandomForest": {"n_estimators": 3, "max_depth": 3}, "SVR": {"n_features": 16}}


def _table(spark, kind, n=240):
    rng = np.random.default_rng(5)
    x, z = rng.normal(size=n), rng.normal(size=n)
    df = pd.DataFrame({"id": np.arange(n), "x": x, "z": z, "kind": np.where(rng.random(n) < 0.5, "a", "b")})
    df.loc[::9, "x"] = np.nan
    wave = x + 0.3 * z
    if kind == "regression":
        df["target"] = 3 * wave + 1 + rng.normal(size=n) * 0.1
    elif kind == "binary":
        df["label"] = np.where(wave > 0, "yes", "no")
    elif kind == "multiclass":
        df["label"] = np.select([wave > 0.5, wave < -0.5], ["high", "low"], "mid")
    else:
        df = df.drop(columns=["kind"])
        df["when"] = pd.date_range("2024-01-01", periods=n, freq="h")
        df["target"] = np.sin(np.arange(n) / 4) + rng.normal(size=n) * 0.05
    return spark.createDataFrame(df)


@pytest.mark.parametrize(
    "kind, task, strategy, metric",
    [
        ("regression", "tabular_regression", "random", "rmse"),
        ("binary", "tabular_classification", "stratified", "roc_auc"),
        ("multiclass", "tabular_classification", "stratified", "f1_weighted"),
        ("series", "time_series_forecasting", "chronological", "mae"),
    ],
)
def test_completed(spark, kind, task, strategy, metric):
    flow = run_flow(_table(spark, kind), "id", kind, params=FAST)
    assert flow.status == "completed", flow.stages
    assert [flow.stages[s] for s in STAGES] == [("completed", None)] * len(STAGES)
    assert (flow.spec["task_type"], flow.protocol["split_strategy"], flow.protocol["primary_metric"]) == (task, strategy, metric)
    board = flow.ranking.orderBy("rank").toPandas()
    assert sorted(board.model) == sorted(r["model"] for r in flow.selection) and list(board["rank"]) == [1, 2, 3]
    assert not board.model[0].startswith("Dummy") and board.value.notna().all()
    n_test = flow.parts.filter("split = 'test'").count()
    assert n_test >= 30 and flow.predictions.count() == 3 * n_test
    assert flow.spec["target_col"] not in flow.audit.feature_columns and "id" not in flow.audit.feature_columns


def test_a_failing_model_does_not_stop_the_others(spark):
    flow = run_flow(_table(spark, "regression"), "id", params=FAST, models=["DummyRegressor", "NoSuchModel", "LinearModel"])
    assert flow.status == "partial_failure" and flow.stages["training"][0] == "partial_failure"
    assert [r.model for r in flow.ranking.orderBy("rank").collect()] == ["LinearModel", "DummyRegressor"]


def test_all_models_fail(spark):
    flow = run_flow(_table(spark, "regression"), "id", models=["NoSuchModel"])
    assert flow.status == "failed" and flow.stages["training"][0] == "failed" and flow.stages["evaluation"][0] == "skipped"
    assert "NoSuchModel" in flow.stages["training"][1] and flow.ranking is None and flow.parts.count() == 240


def test_a_constant_target_ends_the_run(spark):
    df = _table(spark, "regression").selectExpr("id", "x", "1.0D AS target")
    flow = run_flow(df, "id")
    assert flow.status == "failed" and flow.stages["problem_classification"] == ("failed", "TARGET_CONSTANT")
    table = flow.stage_table(spark).orderBy("ordinal").collect()
    assert [r.status for r in table] == ["completed", "failed"] + ["skipped"] * 5


def test_rows_without_a_target_are_left_out(spark):
    df = _table(spark, "regression").selectExpr("id", "x", "z", "CASE WHEN id % 8 = 0 THEN NULL WHEN id % 8 = 4 THEN double('NaN') ELSE target END AS target")
    flow = run_flow(df, "id", models=["DummyRegressor", "LinearModel"])
    assert flow.status == "completed", flow.stages
    assert flow.parts.count() == 180 and flow.metrics.filter("rmse IS NULL").isEmpty()
    assert flow.ranking.orderBy("rank").first().model == "LinearModel"


def test_an_empty_table_is_a_failed_run(spark):
    flow = run_flow(_table(spark, "regression").limit(0), "id")
    assert flow.status == "failed" and flow.ranking is None and "failed" in {s for s, _ in flow.stages.values()}
