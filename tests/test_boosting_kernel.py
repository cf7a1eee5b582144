"""Boosted trees and kernel regression against plain NumPy; saved models of every kind."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from seriesmill.operators import boosting, kernel
from seriesmill.operators import models as H


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(7)
    n = 900
    a, b, c = rng.integers(0, 12, n), rng.integers(0, 9, n), rng.normal(size=n).round(1)
    y = 3.0 * a - 2.0 * (b > 4) + np.where(a > 6, c * 4, -c) + rng.normal(0, 0.3, n)
    b = b.astype(float)
    b[::17] = np.nan
    pdf = pd.DataFrame({"id": np.arange(n), "a": a, "b": b, "c": c, "y": y})
    pdf["two"] = (pdf.y > pdf.y.median()).astype(int)
    pdf["three"] = np.where(pdf.y > 25, "high", np.where(pdf.y > 10, "mid", "ä low"))
    return pdf, spark.createDataFrame(pdf).repartition(3)


def grow(x, g, h, depth, lam, alpha, lr):
    """Exact greedy tree over all values; missing values try both sides."""
    soft = lambda v: np.sign(v) * max(abs(v) - alpha, 0.0)
    score = lambda u, v: soft(u) ** 2 / (v + lam)
    out = np.zeros(len(g))

    def split(rows, level):
        gs, hs = g[rows].sum(), h[rows].sum()
        best = (1e-9, None)
        if level < depth:
            for side in (True, False):
                for f in range(x.shape[1]):
                    v = x[rows, f]
                    for cut in np.unique(v[~np.isnan(v)]):
                        left = np.where(np.isnan(v), side, v <= cut)
                        gl, hl = g[rows][left].sum(), h[rows][left].sum()
                        if hl < 1 or hs - hl < 1:
                            continue
                        gain = 0.5 * (score(gl, hl) + score(gs - gl, hs - hl) - score(gs, hs))
                        if gain > best[0] * (1 + 1e-12):
                            best = (gain, left)
        if best[1] is None:
            out[rows] = -lr * soft(gs) / (hs + lam)
        else:
            split(rows[best[1]], level + 1)
            split(rows[~best[1]], level + 1)

    split(np.arange(len(g)), 0)
    return out


def exact(x, y, rounds, depth, lam=1.0, alpha=0.0, lr=0.3, loss="squared"):
    p = y.mean()
    m = np.full(len(y), p if loss == "squared" else np.log(p / (1 - p)))
    for _ in range(rounds):
        q = m if loss == "squared" else 1 / (1 + np.exp(-m))
        m = m + grow(x, q - y, np.ones(len(y)) if loss == "squared" else q * (1 - q), depth, lam, alpha, lr)
    return m


ALL = dict(subsample=1.0, colsample_bytree=1.0, learning_rate=0.3)


@pytest.mark.parametrize("alpha", [0.0, 40.0])
def test_squared_equals_exact_greedy(data, alpha):
    pdf, df = data
    s = boosting.Settings(n_estimators=3, max_depth=3, reg_alpha=alpha, reg_lambda=2.0, max_bins=200, **ALL)
    fit = boosting.fit(df, ["a", "b", "c"], "y", settings=s)
    got = df.select("id", fit.column(df)[0].alias("p")).toPandas().set_index("id").p.sort_index()
    assert got.to_numpy() == pytest.approx(exact(pdf[["a", "b", "c"]].to_numpy(float), pdf.y.to_numpy(), 3, 3, 2.0, alpha), abs=1e-8)
    loss = fit.history(df, "y")
    assert loss == sorted(loss, reverse=True) and loss[-1] == pytest.approx(float(((got - pdf.y) ** 2).mean()))


def test_log_loss_equals_exact_greedy(data):
    pdf, df = data
    s = boosting.Settings(n_estimators=3, max_depth=2, max_bins=200, **ALL)
    fit = boosting.fit(df, ["a", "b", "c"], "two", boosting.LOGISTIC, settings=s)
    got = df.select("id", fit.column(df)[1].alias("p")).toPandas().set_index("id").p.sort_index()
    margin = exact(pdf[["a", "b", "c"]].to_numpy(float), pdf.two.to_numpy(float), 3, 2, loss="log")
    assert got.to_numpy() == pytest.approx(1 / (1 + np.exp(-margin)), abs=1e-8)


def test_text_classes_sampling_and_scores(data):
    pdf, df = data
    fit = H.gbt(df, ["a", "b", "c"], "three", H.CLASSIFICATION, n_estimators=12, max_depth=3, subsample=0.7, colsample_bytree=0.7, learning_rate=0.3)
    out = fit.probabilities(fit.predict(df, "y_pred")).toPandas()
    assert np.allclose(out.y_scores.map(sum), 1.0) and set(out.y_pred) <= {"high", "mid", "ä low"}
    assert (out.y_pred == out.three).mean() > 0.9
    again = H.gbt(df, ["a", "b", "c"], "three", H.CLASSIFICATION, n_estimators=12, max_depth=3, subsample=0.7, colsample_bytree=0.7, learning_rate=0.3)
    assert boosting.to_dict(again.boosted)["trees"][0] == boosting.to_dict(fit.boosted)["trees"][0]
    assert sum(fit.boosted.gains) == pytest.approx(1.0)


def test_quantile_bins_and_odd_inputs(spark, data):
    pdf, df = data
    wide = df.withColumn("z", F.col("y") + F.rand(3) * 0.01).withColumn("none", F.lit(None).cast("double")).withColumn("one", F.lit(4))
    fit = boosting.fit(wide, ["z", "none", "one"], "y", settings=boosting.Settings(n_estimators=30, max_depth=4, max_bins=16, **ALL))
    assert len(fit.edges[0]) == 15 and len(fit.edges[1]) == len(fit.edges[2]) == 0 and fit.gains[0] == 1.0
    assert fit.history(wide, "y")[-1] < 0.02 * float(pdf.y.var())
    with pytest.raises(ValueError):
        boosting.fit(df.filter("id < 0"), ["a"], "y")
    with pytest.raises(ValueError):
        boosting.Settings(max_bins=1)


def objective(z, y, beta, C, eps):  # noqa: N803
    return 0.5 * beta[:-1] @ beta[:-1] + C * np.maximum(0, np.abs(y - z @ beta) - eps).sum()


def solved(z, y, C, eps):  # noqa: N803
    """A smoothed objective by damped Newton steps, the smoothing taken away little by little."""
    z = np.concatenate((z, np.ones((len(z), 1))), axis=1)
    beta = np.linalg.lstsq(z, y, rcond=None)[0]
    for mu in 10.0 ** -np.arange(0, 6):
        for _ in range(60):
            e = y - z @ beta
            up, down = (1 / (1 + np.exp(-np.clip(v / mu, -500, 500))) for v in (e - eps, -e - eps))
            grad = np.append(beta[:-1], 0) - C * z.T @ (up - down)
            w = C * (up * (1 - up) + down * (1 - down)) / mu
            hess = (z * w[:, None]).T @ z + np.diag(np.append(np.ones(len(beta) - 1), 1e-9))
            step, t, now = np.linalg.solve(hess + 1e-9 * np.eye(len(beta)), grad), 1.0, objective(z, y, beta, C, eps)
            smooth = lambda b: 0.5 * b[:-1] @ b[:-1] + C * mu * sum(np.logaddexp(0, v / mu).sum() for v in (y - z @ b - eps, z @ b - y - eps))  # noqa: E731,B023
            while t > 1e-8 and smooth(beta - t * step) > smooth(beta):
                t /= 2
            beta = beta - t * step
    return objective(z, y, beta, C, eps)


@pytest.mark.parametrize("C,eps,gamma", [(1.0, 0.1, 0.05), (0.01, 2.0, 0.05), (10.0, 0.5, None)])
def test_epsilon_insensitive(data, C, eps, gamma):  # noqa: N803
    pdf, df = data
    full = pdf.dropna()
    fit = kernel.fit(df, ["a", "b", "c"], "y", C, eps, gamma, 20, 3)
    z = kernel.mapped(full[["a", "b", "c"]].to_numpy(float), fit.weights, fit.shifts)
    best = solved(z, full.y.to_numpy(), C, eps)
    assert objective(np.concatenate((z, np.ones((len(z), 1))), 1), full.y.to_numpy(), np.append(fit.coef, fit.intercept), C, eps) == pytest.approx(fit.objective, rel=1e-9)
    assert fit.objective <= 1.01 * best
    got = df.dropna().select("id", fit.prediction().alias("p")).toPandas().set_index("id").p.sort_index()
    assert got.to_numpy() == pytest.approx(z @ fit.coef + fit.intercept)


def test_every_model_is_saved(spark, data, tmp_path):
    _, df = data
    df = df.fillna(0.0)
    numbers = {"DummyRegressor": None, "LinearModel": None, "XGBoost": {"n_estimators": 3}, "SVR": {"n_features": 8}, "RandomForest": {"n_estimators": 3}, "ARIMA": {"p": 1, "d": 0, "q": 0}}
    report = H.fit_all(df, ["a", "b", "c"], "y", numbers, order_by="id")
    classes = H.fit_all(df, ["a", "b", "c"], "three", {"DummyClassifier": None, "LinearModel": None, "XGBoost": {"n_estimators": 3}, "RandomForest": {"n_estimators": 3}}, H.CLASSIFICATION)
    assert report.status == classes.status == "completed", [r for r in report.records + classes.records if r["error"]]
    for i, fit in enumerate([*report.models.values(), *classes.models.values()]):
        H.save_model(fit, str(tmp_path / f"m{i}"))
        back = H.load_model(spark, str(tmp_path / f"m{i}"))
        one, two = (sorted((r.id, r.y_pred) for r in m.predict(df).select("id", "y_pred").collect()) for m in (fit, back))
        assert one == two and back.params.keys() == fit.params.keys()
    long = H.score_all(classes.models, df, "id", "three")
    assert {r.y_true for r in long.select("y_true").distinct().collect()} == {"high", "mid", "ä low"}
    assert H.fit_all(df, ["a"], "three", {"SVR": None, "DummyClassifier": None}, H.CLASSIFICATION).status == "partial_failure"


def test_the_rows_of_many_models_are_made_once(spark):
    made = spark.sparkContext.accumulator(0)

    def seen(batches):
        for batch in batches:
            made.add(batch.num_rows)
            yield batch

    rng = np.random.default_rng(2)
    pdf = pd.DataFrame({"id": np.arange(400), "a": rng.normal(size=400).round(2)})
    pdf["y"] = 2 * pdf.a + rng.normal(size=400)
    df = spark.createDataFrame(pdf).repartition(3, "id").mapInArrow(seen, "id bigint, a double, y double")
    models = {"DummyRegressor": None, "LinearModel": None, "XGBoost": {"n_estimators": 2}, "ARIMA": {"p": 1, "d": 0, "q": 0}}
    report = H.fit_all(df, ["a"], "y", models, order_by="id")
    assert report.status == "completed" and made.value == 400
    long = H.score_all(report.models, df, "id", "y")
    assert long.filter("y_pred IS NOT NULL").groupBy("model").count().filter("count = 400").count() == 4
    assert made.value == 800
