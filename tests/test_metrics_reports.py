"""Metrics and report tables on small fixtures with hand-checked results."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from seriesmill.functions import metrics as J
from seriesmill.operators import report as K
from seriesmill.operators.ordering import Sizing


@pytest.fixture(scope="module")
def reg(spark):
    rows = [(1.0, 1.1), (2.0, 1.9), (3.0, 3.2), (4.0, 3.8), (5.0, 5.1)]
    return spark.createDataFrame(rows, "y_true double, y_pred double").withColumn("model", F.lit("m"))


@pytest.fixture(scope="module")
def clf(spark):
    true, pred = [0, 0, 1, 1, 0, 1, 0, 1], [0, 1, 1, 1, 0, 0, 0, 1]
    score = [0.1, 0.4, 0.8, 0.9, 0.2, 0.3, 0.05, 0.95]
    rows = list(zip(true, pred, score))
    return spark.createDataFrame(rows, "y_true int, y_pred int, y_score double").withColumn("model", F.lit("m"))


def test_regression_metrics(reg):
    m = J.compute_metrics(reg, [], ["mae", "rmse", "r2", "mape", "smape", "made_up"]).first()
    assert m.mae == pytest.approx(0.14)
    assert m.rmse == pytest.approx(math.sqrt(0.022))
    assert m.r2 == pytest.approx(1 - 0.11 / 10)
    assert m.mape == pytest.approx(np.mean([0.1, 0.05, 0.2 / 3, 0.05, 0.02]))
    assert 0 < m.smape < 2 and m.made_up is None
    stats = reg.agg(*[c.alias(n) for n, c in J.residual_stats().items()]).first()
    assert stats.max_error == pytest.approx(0.2) and stats.mean_residual == pytest.approx(-0.02)


def test_edge_cases(spark):
    zeros = spark.createDataFrame([(0.0, 0.0), (0.0, 1.0)], "y_true double, y_pred double")
    m = J.compute_metrics(zeros, [], ["mape", "smape", "r2"]).first()
    assert m.mape is None and m.smape == pytest.approx(1.0) and m.r2 == 0.0
    flat = spark.createDataFrame([(2.0, 2.0), (2.0, 2.0)], "y_true double, y_pred double")
    assert J.compute_metrics(flat, [], ["r2", "rmse"]).first() == (1.0, 0.0)
    eps = zeros.agg(J.mape(percent=True, zeros="eps")).first()[0]
    assert eps == pytest.approx(0.5 / J.EPS * 100)
    wild = spark.createDataFrame([(float("nan"),), (float("inf"),), (1.0,)], "x double")
    assert [r.x for r in J.sanitize(wild, ["x"]).collect()] == [None, None, 1.0]


@pytest.mark.parametrize("keys", [[], ["model"]])
def test_classification_metrics(clf, keys):
    m = J.compute_metrics(clf, keys, ["accuracy", "f1_weighted", "roc_auc"]).first()
    assert m.accuracy == 6 / 8
    assert m.f1_weighted == pytest.approx(0.75)
    assert m.roc_auc == pytest.approx(15 / 16)


def test_auc_is_null_unless_binary(clf):
    assert J.roc_auc(clf.filter("y_true = 1"), ["model"]).first().roc_auc is None
    three = clf.withColumn("y_true", F.when(F.col("y_score") > 0.9, 2).otherwise(F.col("y_true")))
    assert J.roc_auc(three, ["model"]).first().roc_auc is None


def test_auc_with_ties_over_blocks(spark):
    rng = np.random.default_rng(3)
    y, s = rng.integers(0, 2, 400), np.round(rng.random(400), 2)
    df = spark.createDataFrame([(int(a), float(b), "m") for a, b in zip(y, s)], "y_true int, y_score double, model string")
    wins = sum((s[i] > s[j]) + 0.5 * (s[i] == s[j]) for i in np.where(y == 1)[0] for j in np.where(y == 0)[0])
    want = wins / (y.sum() * (len(y) - y.sum()))
    for sizing in (None, Sizing(20, 5, 10)):
        assert J.roc_auc(df, ["model"], sizing=sizing).first().roc_auc == pytest.approx(want)
    curve = K.roc_curve(df, sizing=Sizing(20, 5, 10)).orderBy(F.desc("threshold")).collect()
    assert (curve[-1].fpr, curve[-1].tpr) == (1.0, 1.0)
    fpr, tpr = [0.0] + [r.fpr for r in curve], [0.0] + [r.tpr for r in curve]
    assert np.trapezoid(tpr, fpr) == pytest.approx(want)


def test_quantile_metrics(spark):
    df = spark.createDataFrame([(1.0, 0.0, 1.0, 3.0), (9.0, 0.0, 2.0, 4.0)], "y_true double, q10 double, q50 double, q90 double")
    m = J.compute_metrics(df, [], ["coverage_80", "interval_width_80", "pinball_loss"]).first()
    assert m.coverage_80 == 0.5 and m.interval_width_80 == 3.5 and m.pinball_loss > 0
    assert J.metrics_map(df.withColumn("y_pred", F.col("q50")), [], ["mae"]).first().metrics == {"mae": 3.5}


@pytest.fixture(scope="module")
def metrics(spark):
    rows = [
        ("r", "a", "baseline", "evaluated", 4.0), ("r", "b", "classical", "evaluated", 1.0),
        ("r", "c", "special", "evaluated", 1.0), ("r", "d", "special", "failed", 0.5), ("r", "e", "x", "evaluated", None),
    ]
    return spark.createDataFrame(rows, "run_id string, model string, tier string, status string, mae double")


def test_ranking(metrics):
    cmp = K.comparison_table(metrics, "mae")
    assert [(r.rank, r.model, r.is_best) for r in cmp.orderBy("rank").collect()] == [(1, "b", True), (2, "c", False), (3, "a", False)]
    board = K.leaderboard(cmp, False).orderBy("rank").collect()
    assert [(r.delta, r.delta_pct, r.recommendation) for r in board] == [
        (3.0, 75.0, "Best Overall"), (3.0, 75.0, "Strong Performer"), (0.0, 0.0, "Baseline")
    ]
    better = K.leaderboard(cmp, True).orderBy("rank").first()
    assert better.delta == -3.0
    assert K.chart_data(cmp).count() == 3


def test_histogram_and_matrix(reg, clf):
    h = K.residual_histogram(reg).orderBy("bin").collect()
    counts, edges = np.histogram([-0.1, 0.1, -0.2, 0.2, -0.1], bins=5)
    assert sum(r["count"] for r in h) == 5 and len(h) == 5
    assert [r.low for r in h] == pytest.approx(list(edges[:-1]), abs=1e-9)
    m = {(r.y_true, r.y_pred): r.n for r in K.confusion_matrix(clf).collect()}
    assert m == {(0, 0): 3, (0, 1): 1, (1, 0): 1, (1, 1): 3}


def test_stage_log(spark):
    rows = [("r", "s", "completed", "2024-01-01 00:00:00.1234", "2024-01-01 00:00:02"), ("r", "t", "running", "2024-01-01 00:00:00", None)]
    df = spark.createDataFrame(rows, "run_id string, stage string, status string, a string, b string").selectExpr(
        "run_id", "stage", "status", "timestamp(a) AS started_at", "timestamp(b) AS completed_at"
    )
    assert [r.duration_seconds for r in K.stage_durations(df).orderBy("stage").collect()] == [1.877, None]
    assert K.run_summary(df).first().stages == {"s": "completed", "t": "running"}
