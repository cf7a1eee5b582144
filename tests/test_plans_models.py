"""Plans, models, forecasts, search."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from seriesmill.functions.metrics import compute_metrics
from seriesmill.operators import forecast as X
from seriesmill.operators import models as H
from seriesmill.operators import search as I
from seriesmill.operators.ordering import Sizing
from seriesmill.operators.split import split_random
from seriesmill.plans import plan as P


@pytest.fixture(scope="module")
def hourly(spark):
    n, rng = 2000, np.random.default_rng(0)
    names = ["HUFL", "HULL", "MUFL", "MULL", "LUFL", "LULL", "OT"]
    pdf = pd.DataFrame({"date": pd.date_range("2016-07-01", periods=n, freq="h"), **{c: rng.normal(size=n).cumsum() for c in names}})
    pdf.loc[::50, "HUFL"] = np.nan
    return pdf, spark.createDataFrame(pdf)


def test_default_series_plan(hourly):
    pdf, df = hourly
    task = P.Task("OT", "time_series", "date")
    steps = P.default_plan(task, ["HUFL", "HULL", "MUFL", "MULL", "LUFL", "LULL"])
    out, audit = P.apply_plan(df, steps, task, sizing=Sizing(300, 50, 100))
    got = out.orderBy("date").toPandas()
    assert got.shape == (2000 - 24, 55) and len(audit.feature_columns) == 53
    want = pdf.copy()
    want["HUFL"] = want.HUFL.fillna(want.HUFL.mean())
    roll = want.HUFL.rolling(24, min_periods=1).mean()[24:]
    np.testing.assert_allclose(got.HUFL_rolling_mean_24, (roll - roll.mean()) / roll.std(ddof=0), atol=1e-8)
    lag = want.OT.shift(24)[24:]
    np.testing.assert_allclose(got.OT_lag_24, (lag - lag.mean()) / lag.std(ddof=0), atol=1e-8)
    np.testing.assert_allclose(got.OT, pdf.OT[24:])
    assert [(r["method"], r["rows_before"], r["rows_after"]) for r in audit.records] == [
        ("imputation", 2000, 2000), ("rolling_stats", 2000, 2000), ("lag_features", 2000, 1976), ("z_norm", 1976, 1976)
    ]


def test_steps_after_lags_see_only_remaining_rows(hourly):
    pdf, df = hourly
    task = P.Task("OT", "time_series", "date")
    steps = [P.Step(1, "lag_features", {"lags": [3]}, ["HULL"]), P.Step(2, "rolling_stats", {"window": 4}, ["HULL"]),
             P.Step(3, "lag_features", {"lags": [2]}, ["MULL"])]
    out, audit = P.apply_plan(df, steps, task)
    cut = pdf.iloc[3:].reset_index(drop=True)
    want = cut.HULL.rolling(4, min_periods=1).mean()[2:]
    got = out.orderBy("date").toPandas()
    np.testing.assert_allclose(got.HULL_rolling_mean_4, want)
    assert audit.records[-1]["rows_after"] == len(got) == 1995


def test_plan_guards(spark):
    df = spark.range(50).selectExpr("id", "CAST(id AS DOUBLE) AS x", "CASE WHEN id % 5 > 0 THEN 'a' END AS c", "CAST(id AS DOUBLE) AS y")
    task = P.Task("y", keep=("id",))
    bad = [P.Step(1, "teleport"), P.Step(2, "smoothing"), P.Step(3, "min_max", {}, "all_numeric")]
    out, audit = P.apply_plan(df, bad, task)
    assert [r.get("skipped_reason", "")[:8] for r in audit.records] == ["UNKNOWN_", "MODALITY", ""]
    assert out.filter("c IS NULL").count() == 0 and out.agg(F.max("x")).first()[0] == 1.0
    with pytest.raises(RuntimeError, match="failures"):
        P.apply_plan(df, [*bad, P.Step(4, "nope")], task)
    targeted, _ = P.apply_plan(df, [P.Step(1, "min_max", {}, "target_only")], task)
    assert targeted.agg(F.max("y")).first()[0] == 1.0
    with pytest.raises(RuntimeError, match="TARGET_MODIFIED"):
        P.assert_target_unchanged(df, df.withColumn("y", F.when(F.col("id") == 7, 0.0).otherwise(F.col("y"))), "id", "y")
    P.assert_target_unchanged(df, df.filter("id > 10"), "id", "y")
    shrunk, audit = P.apply_plan(df, [P.Step(1, "remove_outliers", {"method": "zscore", "threshold": 1.0}, ["x"])], task)
    assert audit.records[0]["rows_after"] == shrunk.count() < 50
    assert audit.table(spark).count() == 1
    encoded, _ = P.apply_plan(df, [P.Step(1, "onehot_encode", {}, "all_categorical"), P.Step(2, "label_encode", {}, ["c"])], task)
    assert encoded.columns == ["id", "x", "y", "c_a"]


def test_fit_on_train(spark):
    df = spark.range(100).selectExpr("id", "CAST(id AS DOUBLE) AS x", "CAST(1 AS DOUBLE) + id AS y", "IF(id < 50, 'train', 'test') AS split")
    out, audit = P.apply_plan(df, [P.Step(1, "z_norm", {}, "all_numeric")], P.Task("y", keep=("id",)), fit_on="train")
    assert audit.fitted[0].params["x"]["mean"] == 24.5 and out.filter("id = 0").first().x < -1.6


def test_validate_plan():
    task = P.Task("y", "time_series", "t", "g")
    steps = [
        {"order": 5, "method": "smoothing", "applies_to": ["y", "x", "t"]},
        {"order": 1, "method": "remove_outliers"},
        {"order": 2, "method": "lag_features", "applies_to": ["y", "g"]},
        {"order": "3", "method": "z_norm"},
        {"order": 4, "method": "z_norm", "skip_columns": "x", "parameters": None},
        "junk",
    ]
    assert P.validate_plan(steps, task) == [P.Step(1, "z_norm"), P.Step(2, "smoothing", {}, ["x"])]


@pytest.fixture(scope="module")
def regression(spark):
    rng = np.random.default_rng(42)
    n = 400
    pdf = pd.DataFrame({"id": np.arange(n), "a": rng.normal(size=n), "b": rng.uniform(-5, 5, n)})
    pdf["y"] = 3 * pdf.a - 2 * pdf.b + rng.normal(0, 0.1, n)
    pdf["c"] = (pdf.y > 0).astype(int)
    df = split_random(spark.createDataFrame(pdf), "id").persist()
    return pdf, df, H.stable_partitions(df.filter("split = 'train'"), "id", 2).persist(), df.filter("split = 'test'")


def test_ridge_equals_closed_form(spark, regression):
    pdf, df, _, _ = regression
    x = pdf[["a", "b"]].to_numpy()
    xc, yc = x - x.mean(0), pdf.y - pdf.y.mean()
    for alpha in (1.0, 50.0):
        want = np.linalg.solve(xc.T @ xc + alpha * np.eye(2), xc.T @ yc)
        got = {r.term: r.value for r in H.linear_coefficients(H.ridge(df, ["a", "b"], "y", alpha), spark).collect()}
        assert [got["a"], got["b"]] == pytest.approx(list(want), rel=1e-6)
        assert got["intercept"] == pytest.approx(pdf.y.mean() - x.mean(0) @ want, rel=1e-6)


def test_logistic_is_at_its_optimum(regression):
    pdf, df, _, _ = regression
    fit = H.logistic(df, ["a", "b"], "c", C=0.5)
    inner = fit.model.stages[-1]
    w, b = inner.coefficients.toArray(), inner.intercept
    x = pdf[["a", "b"]].to_numpy()
    p = 1 / (1 + np.exp(-(x @ w + b)))
    assert np.abs(x.T @ (p - pdf.c) + w / 0.5).max() < 1e-2
    assert abs((p - pdf.c).sum()) < 1e-2


def test_models_learn(spark, regression):
    _, df, train, test = regression
    models = {
        "DummyRegressor": None, "LinearModel": None, "RandomForest": {"n_estimators": 8}, "nonsense": None,
        "XGBoost": {"n_estimators": 8, "max_depth": 4, "learning_rate": 0.3}, "SVR": {"n_features": 40},
    }
    report = H.fit_all(train, ["a", "b"], "y", models)
    assert report.status == "partial_failure" and len(report.models) == 5
    long = H.score_all(report.models, test, "id", "y")
    scores = {r.model: r.r2 for r in compute_metrics(long, ["model"], ["r2"]).collect()}
    assert scores["LinearModel"] > 0.99 and scores["RandomForest"] > 0.7 and scores["XGBoost"] > 0.7 and scores["SVR"] > 0.5
    assert scores["DummyRegressor"] < 0.05
    top = H.feature_importance(report.models["RandomForest"], spark).collect()
    assert top[0].feature == "b" and sum(r.importance for r in top) == pytest.approx(1.0)
    loss = H.gbt_history(report.models["XGBoost"], train, test)
    first, last = (loss.filter(f"part = 'train' AND round = {k}").first().loss for k in (1, 8))
    assert last < first


def test_forest_repeats_after_repartition(regression):
    _, df, train, test = regression
    again = H.stable_partitions(df.repartition(5).filter("split = 'train'"), "id", 2)
    a, b = (H.random_forest(d, ["a", "b"], "y", n_estimators=4) for d in (train, again))
    pick = lambda m: [round(r.y_pred, 9) for r in m.predict(test).orderBy("id").collect()]
    assert pick(a) == pick(b)


def test_save_and_load(spark, regression, tmp_path):
    _, _, train, test = regression
    fit = H.ridge(train, ["a", "b"], "y")
    H.save_model(fit, str(tmp_path / "m"))
    back = H.load_model(spark, str(tmp_path / "m"))
    assert back.features == ["a", "b"]
    assert back.predict(test).agg(F.sum("y_pred")).first() == fit.predict(test).agg(F.sum("y_pred")).first()


def test_register_model(regression):
    from pyspark.ml.regression import DecisionTreeRegressor

    _, _, train, test = regression
    H.register_model("Tree", lambda params, ctx: DecisionTreeRegressor(labelCol=ctx.target, maxDepth=params["depth"]), {"depth": 3})
    assert "Tree" in H.available_models()
    assert H.fit_model(train, ["a", "b"], "y", "Tree").predict(test).count() == test.count()


def test_search(spark, regression):
    _, df, train, _ = regression
    val = df.filter("split = 'val'")
    found = I.tune("LinearModel", train, val, ["a", "b"], "y", "rmse", 4)
    assert found.best_score == min(t["score"] for t in found.trials) and found.table(spark).count() == 4
    assert I.sample_space("XGBoost", 3, 1) == I.sample_space("XGBoost", 3, 1) != I.sample_space("XGBoost", 3, 2)
    broken = I.tune("RandomForest", train, val, ["a", "b"], "y", "r2", 2, space={"max_depth": ("choice", -1)})
    assert broken.best_score is None and all(t["error"] for t in broken.trials)


def two_stage(y):
    """The same two regressions with NumPy."""
    d = np.diff(y)
    a = np.linalg.lstsq(np.column_stack([d[1:-1], d[:-2]]), d[2:], rcond=None)[0]
    u = d[2:] - np.column_stack([d[1:-1], d[:-2]]) @ a
    return tuple(np.linalg.lstsq(np.column_stack([d[2:-1], u[:-1]]), d[3:], rcond=None)[0])


def test_arima_recovers_parameters(spark):
    rng = np.random.default_rng(5)
    rows = []
    for s, (phi, theta) in enumerate([(0.6, 0.3), (-0.4, 0.5)]):
        e, d, y = rng.normal(size=6001), 0.0, 0.0
        for t in range(1, 6001):
            d = phi * d + e[t] + theta * e[t - 1]
            y += d
            rows.append((s, t, y))
    df = spark.createDataFrame(pd.DataFrame(rows, columns=["s", "t", "y"]))
    plain = X.arima_fit(df, "y", "t", "s")
    cut = X.arima_fit(df, "y", "t", "s", sizing=Sizing(1000, 100, 2000))
    for fit in (plain, cut):
        got = {r.s: (r.phi, r.theta) for r in fit.collect()}
        for k in (0, 1):
            assert got[k] == pytest.approx(two_stage(np.array([y for s, _, y in rows if s == k])), abs=1e-6)
        # the second series is nearly white after differencing (phi + theta = 0.1), so only the first is sharp
        assert got[0] == pytest.approx((0.6, 0.3), abs=0.08)
    fc = X.arima_forecast(plain, 3, "s")
    r = plain.filter("s = 0").first()
    e = r.d_last - r.phi * r.d_prev - r.theta * r.u_prev
    d1 = r.phi * r.d_last + r.theta * e
    want = [r.y_last + d1, r.y_last + d1 * (1 + r.phi), r.y_last + d1 * (1 + r.phi + r.phi**2)]
    assert [x.y_pred for x in fc.filter("s = 0").orderBy("step").collect()] == pytest.approx(want)
    shocks = X.arima_residuals(df, plain, "y", "t", "s")
    assert shocks.agg(F.stddev("residual")).first()[0] == pytest.approx(1.0, abs=0.05)
    paths = X.bootstrap_paths(plain, shocks, "t", "s", 3, 200)
    q = X.quantile_forecast(paths, keys=("s", "step")).filter("s = 0 AND step = 1").first()
    assert q.q10 < q.q50 < q.q90 and q.q50 == pytest.approx(want[0], abs=0.3)
    assert paths.count() == 2 * 3 * 200


def test_short_series_have_no_parameters(spark):
    df = spark.range(10).selectExpr("1 AS s", "id AS t", "CAST(id * id AS DOUBLE) AS y")
    assert X.arima_fit(df, "y", "t", "s").first().phi is None


def test_context(spark):
    df = spark.range(100).selectExpr("id % 2 AS s", "id AS t")
    for sizing in (None, Sizing(10, 2, 20)):
        old = X.recent_context(df.filter("t < 50"), "s", "t", 4, sizing)
        got = X.update_context(old, df.filter("t >= 50 AND t < 53"), "s", "t", 4, sizing)
        assert sorted(r.t for r in got.collect()) == [45, 46, 47, 48, 49, 50, 51, 52]


def test_short_series_keep_their_last_value_on_paths(spark):
    df = spark.range(80).selectExpr("IF(id < 10, 1, 2) AS s", "id AS t", "CAST(sin(id * id) AS DOUBLE) AS y")
    fit = X.arima_fit(df, "y", "t", "s")
    paths = X.bootstrap_paths(fit, X.arima_residuals(df, fit, "y", "t", "s"), "t", "s", 3, 5)
    assert paths.groupBy("s").count().orderBy("s").collect() == [(1, 15), (2, 15)]
    assert {r.value for r in paths.filter("s = 1").collect()} == {fit.filter("s = 1").first().y_last}


def test_rejected_steps_stand_in_the_audit(spark):
    df = spark.range(20).selectExpr("id", "CAST(id AS DOUBLE) AS x", "CAST(id AS DOUBLE) AS y")
    task = P.Task("y", keep=("id",))
    raw = [{"order": 2, "method": "z_norm", "applies_to": ["x"]}, {"order": 1, "method": "detrend"}, {"method": "z_norm"}, None]
    steps, rejected = P.parse_plan(raw, task)
    assert [r["skipped_reason"] for r in rejected] == ["MODALITY_VIOLATION", "NO_ORDER", "NOT_A_STEP"]
    _, audit = P.apply_plan(df, steps, task, rejected=rejected)
    reasons = [r.skipped_reason for r in audit.table(spark).collect()]
    assert reasons == ["MODALITY_VIOLATION", "NO_ORDER", "NOT_A_STEP", None]


def test_window_step_without_order_fails_under_its_own_name(spark):
    df = spark.range(50).selectExpr("id", "CAST(id AS DOUBLE) AS x", "CAST(id AS DOUBLE) AS y")
    task = P.Task("y", "time_series", keep=("id",))
    steps = [P.Step(1, "lag_features", {"lags": [1]}, ["x"]), P.Step(2, "z_norm", {}, ["x"])]
    out, audit = P.apply_plan(df, steps, task)
    lag, scale = audit.records
    assert "order" in lag["skipped_reason"] and lag["columns_affected"] == []
    assert "skipped_reason" not in scale and out.count() == 50 and "x_lag_1" not in out.columns


def test_queued_window_steps_are_marked_when_they_fail_together(spark, monkeypatch):
    def broken(*_):
        raise ValueError("no blocks")

    df = spark.range(50).selectExpr("id", "CAST(id AS DOUBLE) AS x", "CAST(id AS DOUBLE) AS y")
    steps = [P.Step(1, "lag_features", {"lags": [1]}, ["x"]), P.Step(2, "z_norm", {}, ["x"])]
    monkeypatch.setattr(P, "fit_layout", broken)
    out, audit = P.apply_plan(df, steps, P.Task("y", "time_series", order_by=("id",)))
    assert [r.get("skipped_reason") for r in audit.records] == ["no blocks", None]
    assert out.count() == 50 and audit.records[1]["rows_before"] == 50


def test_label_encoding_is_fitted_by_a_plan(spark):
    df = spark.range(30).selectExpr("id", "CAST(id % 3 AS STRING) AS c", "CAST(id AS DOUBLE) AS y")
    out, audit = P.apply_plan(df, [P.Step(1, "label_encode", {}, ["c"])], P.Task("y", keep=("id",)))
    assert audit.records[0]["fitted_params"]["c"]["encoding"] == {"0": 0, "1": 1, "2": 2}
    assert audit.fitted[0].method == "label_encode" and out.filter("c <> id % 3").count() == 0
