"""Linear trials need one pass over the rows for all of them."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from seriesmill.operators import models as H
from seriesmill.operators import search
from seriesmill.operators.moments import WEIGHT, moments


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(4)
    pdf = pd.DataFrame({"a": rng.normal(1e4, 3, 900), "b": rng.integers(0, 9, 900), "c": 0.1})
    pdf["d"] = pdf.a - 2 * pdf.b
    pdf["y"] = pdf.a - 5 * pdf.b + rng.normal(size=900)
    return pdf, spark.createDataFrame(pdf).repartition(5).persist()


def test_a_few_rows_stand_for_all(spark, data):
    pdf, df = data
    found = moments(df, ["a", "b", "c", "y"])
    x = pdf[["a", "b", "c", "y"]].to_numpy()
    assert found.n == 900 and np.allclose(found.mean, x.mean(axis=0), rtol=1e-14)
    assert np.allclose(found.scatter, np.cov(x.T, bias=True) * 900, atol=1e-6)
    few = found.rows(spark).toPandas()
    assert len(few) == 8 and few[WEIGHT].sum() == pytest.approx(900) and few.c.nunique() == 1
    assert np.allclose(np.cov(few[["a", "b", "c", "y"]].to_numpy().T, bias=True, aweights=few[WEIGHT]) * 900, found.scatter, atol=1e-6)


def test_missing_values_and_text_are_left_to_the_rows(spark, data):
    df = data[1]
    assert moments(df.withColumn("a", F.when(F.col("b") > 0, F.col("a"))), ["a", "y"]) is None
    assert moments(df.withColumn("a", F.col("a").cast("string")), ["a", "y"]) is None
    assert moments(df.limit(0), ["a", "y"]) is None


@pytest.mark.parametrize("features", [["a", "b"], ["a", "b", "c"], ["a", "b", "d"]])
def test_fits_from_moments_are_fits_over_rows(spark, data, features):
    df = data[1]
    context = H.training_context(df, features, "y")
    context.extra["moments"] = moments(df, [*features, "y"])
    for alpha in (1e-3, 1.0, 500.0):
        fits = [H.fit_model(df, features, "y", "LinearModel", {"alpha": alpha}, context=c) for c in (context, None)]
        one, two = ([r.p for r in f.predict(df, "p").orderBy("a").collect()] for f in fits)
        assert np.allclose(one, two, rtol=1e-8)


def test_linear_trials_pass_over_the_rows_once(spark, data, monkeypatch):
    pdf, df = data
    passes, own = [], H.Pipeline.fit
    monkeypatch.setattr(H.Pipeline, "fit", lambda self, rows: passes.append(rows.count()) or own(self, rows))
    found = search.tune("LinearModel", df, df, ["a", "b"], "y", "rmse", 4)
    assert len(passes) == 4 and max(passes) <= 6 and not any(t["error"] for t in found.trials)
    alone = H.fit_model(df, ["a", "b"], "y", "LinearModel", found.best_params)
    assert search.val_score(alone, df, "rmse") == pytest.approx(found.best_score)


def test_a_missing_feature_fails_every_trial(spark, data):
    df = data[1]
    gone = df.withColumn("a", F.when(F.col("b") > 0, F.col("a")))
    for train, val in ((df, gone), (gone, df)):
        found = search.tune("LinearModel", train, val, ["a", "b"], "y", "rmse", 2)
        assert found.best_score is None and all(t["error"] for t in found.trials)
