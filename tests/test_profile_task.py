"""Profiles and the task and protocol rules."""

import pytest
from pyspark.sql import functions as F

from seriesmill.operators import profile as B
from seriesmill.operators import protocol as D
from seriesmill.operators import task as C
from seriesmill.operators.models import judge_models, model_catalog, pick_three, select_models


def test_profile(spark):
    rows = [(i, float(i) if i % 4 else float("nan"), "abc"[i % 3], f"2024-01-{i + 1:02d}", i % 2 == 0, [i]) for i in range(20)]
    df = spark.createDataFrame(rows, "id long, x double, c string, day string, flag boolean, arr array<int>")
    p = {r.name: r for r in B.profile(df, "id", "t").collect()}
    assert {n: r.inferred_type for n, r in p.items()} == {
        "id": "numeric", "x": "numeric", "c": "categorical", "day": "datetime", "flag": "boolean", "arr": "unknown"
    }
    assert (p["x"].missing_count, p["x"].missing_fraction, p["x"].unique_count) == (5, 0.25, 15)
    assert p["x"].min == 1.0 and p["x"].max == 19.0 and p["x"].mean == 10.0 and p["x"].has_negative_values is False
    assert p["day"].is_monotonically_increasing is True and p["id"].is_monotonically_increasing is None
    assert p["x"].sample_values == ["1.0", "2.0", "3.0", "5.0", "6.0"]
    assert [p[c].dtype for c in ("id", "x", "c")] == ["int64", "float64", "object"]
    approx = {r.name: r for r in B.profile(df, "id", "t", approx=True).collect()}
    assert approx["c"].unique_count == 3


def test_monotonic(spark):
    df = spark.range(100).selectExpr("id", "CASE WHEN id % 5 > 0 THEN id DIV 10 END AS up", "100 - id AS down", "CASE WHEN id = 3 THEN 1 END AS one")
    assert B.is_monotonic(df, "up", "id").first()[0] is True
    assert B.is_monotonic(df, "down", "id").first()[0] is False
    assert B.is_monotonic(df, "one", "id").first()[0] is None
    assert B.is_sorted(df, "up", "id") and not B.is_sorted(df, "down", "id")


def test_sample_values_found_beyond_the_first_rows(spark):
    from seriesmill.sources.tables import sample_values

    df = spark.range(3000).selectExpr("id", "CASE WHEN id > 2500 THEN id END AS late")
    got = {(r.column, r["rank"]): r.value for r in sample_values(df, "id", 2).collect()}
    assert got == {("id", 1): "0", ("id", 2): "1", ("late", 1): "2501", ("late", 2): "2502"}


COLS = {
    "label": ("categorical", "object"), "n": ("numeric", "int64"), "f": ("numeric", "float64"), "g": ("numeric", "float64"),
    "date": ("datetime", "datetime64"), "store": ("categorical", "object"), "target": ("numeric", "float64"),
}


def prof(spark, *cols, rows=100):
    out = []
    for i, (name, extra) in enumerate(cols):
        kind, dtype = extra.get("kind") or COLS[name]
        out.append((
            "t", i, name, kind, dtype, extra.get("missing", 0.0), extra.get("unique", 50), extra.get("min", 0.5),
            extra.get("max", 9.0), extra.get("neg", False), kind == "datetime", extra.get("rising"), rows,
        ))
    return spark.createDataFrame(
        out,
        "table_name string, ordinal int, name string, inferred_type string, dtype string, missing_fraction double, "
        "unique_count long, min double, max double, has_negative_values boolean, is_temporal boolean, "
        "is_monotonically_increasing boolean, num_rows long",
    )


@pytest.mark.parametrize(
    "cols, want",
    [
        ([("f", {}), ("label", {"unique": 2})], dict(task_type="tabular_classification", classification_subtype="binary")),
        ([("f", {}), ("label", {"unique": 4})], dict(task_type="tabular_classification", classification_subtype="multiclass")),
        ([("label", {"kind": ("numeric", "int64"), "unique": 7})], dict(task_type="tabular_classification")),
        ([("n", {"unique": 90}), ("f", {})], dict(task_type="tabular_regression", target_col="f", regression_subtype="standard")),
        ([("f", {"max": 1.0})], dict(regression_subtype="bounded")),
        ([("n", {"unique": 90})], dict(regression_subtype="count", task_confidence="low")),
        ([("date", {"rising": True}), ("f", {})], dict(task_type="time_series_forecasting", time_col="date", forecast_horizon=24)),
        (
            [("date", {"rising": False}), ("store", {"unique": 5}), ("target", {})],
            dict(task_type="grouped_prediction", group_col="store", time_col="date", target_col="target"),
        ),
        ([("date", {"rising": False}), ("store", {"unique": 60}), ("target", {})], dict(task_type="tabular_regression")),
        ([("f", {"unique": 1})], dict(error_code="TARGET_CONSTANT")),
        ([("target", {"missing": 0.6})], dict(error_code="TARGET_TOO_SPARSE")),
        ([("store", {})], dict(error_code="TARGET_NOT_FOUND")),
    ],
)
def test_task_rules(spark, cols, want):
    spec = C.task_spec(prof(spark, *cols), forecast_horizon=24).first().asDict()
    assert {k: spec[k] for k in want} == want


def test_target_priorities(spark):
    p = prof(spark, ("f", {}), ("g", {}), ("n", {}))
    hint = lambda name, conf: spark.createDataFrame([("t", name, conf)], "table_name string, suggested_target string, target_confidence string")
    assert C.confirm_target(p).first().target_col == "n"
    assert C.confirm_target(p, hint("g", "low")).first().target_col == "g"
    both = prof(spark, ("target", {}), ("f", {}), ("n", {}))
    assert C.confirm_target(both, hint("f", "low")).first().target_col == "target"
    assert C.confirm_target(both, hint("f", "high")).first().target_col == "f"
    gone = B.validate_hints(both, hint("nowhere", "high")).first()
    assert gone.suggested_target is None and gone.target_confidence == "low"
    with pytest.raises(Exception, match="TARGET_CONSTANT"):
        C.task_spec(prof(spark, ("f", {"unique": 1})), strict=True).collect()


@pytest.mark.parametrize("n, val, test", [(1000, 0.1, 0.2), (144, 0.091667, 0.208333), (110, 0.027273, 0.272727), (50, 0.1, 0.2)])
def test_fractions(spark, n, val, test):
    row = spark.range(1).select(*[c.alias(k) for k, c in D.split_fractions(F.lit(n)).items()]).first()
    assert (row.val_fraction, row.test_fraction) == (pytest.approx(val, abs=1e-6), pytest.approx(test, abs=1e-6))


def test_protocol_and_models(spark):
    p = prof(spark, ("date", {"rising": True}), ("n", {}), ("f", {}))
    tasks = C.task_spec(p).withColumn("num_rows", F.lit(144))
    out = D.eval_protocol(tasks, prediction_type="quantile").first()
    assert (out.split_strategy, out.primary_metric) == ("chronological", "mae")
    assert out.metrics == ["rmse", "mae", "mape", "smape", "pinball_loss", "coverage_80", "interval_width_80"]
    picks = {r.tier: (r.model, r.substituted_from) for r in select_models(tasks).collect()}
    assert picks == {
        "baseline": ("DummyRegressor", "ARIMA"), "classical": ("XGBoost", None), "specialized": ("RandomForest", "Chronos")
    }
    why = {r.model: r.rejection for r in judge_models(tasks, model_catalog(spark)).collect()}
    assert why["ARIMA"] == "univariate only" and why["LSTM"] == "not registered" and why["XGBoost"] is None
    with pytest.raises(ValueError, match="POOL"):
        pick_three("tabular_regression", {"baseline": set(), "classical": set(), "specialized": set()})


def test_unsorted_columns_need_no_sort(spark, monkeypatch):
    df = spark.range(5000).selectExpr(
        "id", "timestamp_seconds(id) AS up", "timestamp_seconds((id * 7919) % 5000) AS mixed", "timestamp_seconds(id + IF(id = 17, 2, 0)) AS nearly",
        "CAST(timestamp_seconds(5000 - id) AS STRING) AS text", "CAST(NULL AS TIMESTAMP) AS none", "IF(id = 3000, timestamp_seconds(1), NULL) AS one",
    )
    cols = df.columns[1:]
    found = B.surely_falling(df, cols, "id")
    assert found == {"mixed", "text"}
    exact = {c: B.is_monotonic(df, c, "id").first()[0] for c in cols}
    assert exact == {"up": True, "mixed": False, "nearly": False, "text": False, "none": None, "one": None}
    asked, real = [], B.is_monotonic
    monkeypatch.setattr(B, "is_monotonic", lambda df, c, *a: asked.append(c) or real(df, c, *a))
    got = {r.name: r.is_monotonically_increasing for r in B.profile(df, "id").collect()}
    assert {c: got[c] for c in cols} == exact and asked == ["up", "nearly", "none", "one"]
    assert B.surely_falling(df.filter("id < 0"), cols, "id") == B.surely_falling(df.filter("id = 5"), cols, "id") == set()
