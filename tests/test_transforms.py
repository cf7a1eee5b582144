"""Transforms against pandas, on data with nulls, NaN and constant columns."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from seriesmill.operators import align, fills
from seriesmill.operators import scalar as S
from seriesmill.operators import windows as W
from seriesmill.operators.joins import lookup_join
from seriesmill.operators.ordering import Sizing

SMALL = Sizing(target_rows=60, min_rows=10, hot_rows=40)


@pytest.fixture(scope="module")
def pdf():
    rng = np.random.default_rng(1)
    n = 400
    out = pd.DataFrame({"i": np.arange(n), "s": rng.integers(0, 3, n), "v": rng.normal(size=n).cumsum(), "y": rng.normal(size=n)})
    out.loc[rng.random(n) < 0.2, "v"] = np.nan
    out.loc[:3, "v"] = np.nan
    out["one"] = 1.0
    out["t"] = rng.choice(["b", "a", "c"], n)
    return out


@pytest.fixture(scope="module")
def sdf(spark, pdf):
    return spark.createDataFrame(pdf)  # NaN stay NaN: they must count as missing


def column(df, name):
    return df.orderBy("i").toPandas()[name].astype(float).to_numpy()


def same(df, name, want):
    np.testing.assert_allclose(column(df, name), np.asarray(want, dtype=float), equal_nan=True, atol=1e-9)


def test_impute(sdf, pdf):
    same(S.impute(sdf, ["v", "y"], "mean"), "v", pdf.v.fillna(pdf.v.mean()))
    same(S.impute(sdf, ["v"], "median"), "v", pdf.v.fillna(pdf.v.median()))
    same(S.impute(sdf, ["v"], "constant", fill_value=7), "v", pdf.v.fillna(7))
    assert list(S.fit_impute(sdf, ["v", "y"]).params) == ["v"]


def test_impute_without_values(spark):
    df = spark.createDataFrame([(1, None, None)], "i int, v double, t string")
    assert S.impute(df, ["v", "t"]).first()[1:] == (0.0, "")
    assert S.null_guard(df, ["v", "t"]).first()[1:] == (0.0, "missing")


def test_mode_tie_takes_smallest(spark):
    df = spark.createDataFrame([("b",), ("a",), ("b",), ("a",), (None,)], "t string")
    assert S.modes(df, ["t"]) == {"t": "a"}


def test_scaling(sdf, pdf):
    same(S.z_norm(sdf, ["v"]), "v", (pdf.v - pdf.v.mean()) / pdf.v.std(ddof=0))
    same(S.z_norm(sdf, ["v"], ddof=1), "v", (pdf.v - pdf.v.mean()) / pdf.v.std())
    same(S.z_norm(sdf, ["one"]), "one", pdf.one)
    same(S.min_max(sdf, ["v"]), "v", (pdf.v - pdf.v.min()) / (pdf.v.max() - pdf.v.min()))
    same(S.min_max(sdf, ["one"]), "one", pdf.one)
    assert np.isnan(column(S.min_max(sdf, ["one"], zero_range="null"), "one")).all()


def test_log(sdf, pdf):
    same(S.log_transform(sdf, ["v"]), "v", pdf.v)  # has negatives: left alone
    same(S.log_transform(sdf, ["one"]), "one", np.log1p(pdf.one))
    same(S.log_transform(sdf, ["v"], negatives="clip"), "v", np.log1p(pdf.v.clip(lower=0)))


@pytest.mark.parametrize("fit", [S.fit_z_norm, S.fit_min_max, lambda d, c: S.fit_log_transform(d, c, "skip")])
def test_inverse(sdf, pdf, fit):
    fitted = fit(sdf, ["v", "one"])
    same(S.inverse_transform(S.apply_fitted(sdf, fitted), fitted), "v", pdf.v)


def test_outliers(sdf, pdf):
    q1, q3 = pdf.y.quantile(0.25), pdf.y.quantile(0.75)
    lo, hi = q1 - 0.5 * (q3 - q1), q3 + 0.5 * (q3 - q1)
    assert S.remove_outliers(sdf, ["y"], "iqr", 0.5).count() == pdf.y.between(lo, hi).sum()
    z = (pdf.v - pdf.v.mean()) / pdf.v.std(ddof=0)
    assert S.remove_outliers(sdf, ["v", "one"], "zscore", 1.0).count() == (z.abs() <= 1).sum()
    assert S.remove_outliers(sdf, ["v"], "iqr", 99, keep_null=True).count() == len(pdf)
    assert S.remove_outliers(sdf, ["v"], "iqr", 99).count() == pdf.v.notna().sum()
    m, s = pdf.y.mean(), pdf.y.std()
    same(S.clip_outliers(sdf, ["y"], 1.0), "y", pdf.y.clip(m - s, m + s))
    same(S.clip_outliers_if(sdf, ["y"], ["late rows"]), "y", pdf.y)


def test_encoding(sdf, pdf):
    same(S.label_encode(sdf, ["t"]), "t", pdf.t.astype("category").cat.codes)
    same(S.apply_label_encode(sdf, S.fit_label_encode(sdf, ["t"])), "t", pdf.t.astype("category").cat.codes)
    hot = S.onehot_encode(sdf, ["t"])
    assert hot.columns == ["i", "s", "v", "y", "one", "t_a", "t_b", "t_c"]
    same(hot, "t_b", pdf.t == "b")
    assert "t" in S.onehot_encode(sdf, ["t"], max_card=2).columns


def test_lookup_join_salts_hot_keys(spark):
    df = spark.range(5000).selectExpr("id", "CASE WHEN id % 3 = 0 THEN NULL WHEN id % 3 = 1 THEN -1 ELSE id END AS k")
    table = df.groupBy("k").count().withColumn("label", F.coalesce(F.col("k"), F.lit(-7)) * 2)
    small = lookup_join(df, table, "k", "count")
    large = lookup_join(df, table, "k", "count", broadcast_rows=0)
    assert sorted(map(tuple, small.collect()), key=str) == sorted(map(tuple, large.collect()), key=str)
    assert large.filter("label IS NULL").count() == 0


@pytest.mark.parametrize("sizing", [None, SMALL])
def test_windows(sdf, pdf, sizing):
    o = ["i"]
    same(W.difference(sdf, ["v"], o, sizing=sizing), "v", pdf.v.diff()[1:])
    same(W.difference(sdf, ["v"], o, first="zero", sizing=sizing), "v", pdf.v.diff().fillna(0))
    same(W.smooth(sdf, ["v"], 3, o, sizing=sizing), "v", pdf.v.rolling(3, min_periods=1).mean())
    for w in (4, 5):
        want = pdf.y.rolling(w, center=True).mean().bfill().ffill()
        same(W.smooth(sdf, ["y"], w, o, center=True, sizing=sizing), "y", want)
    lagged = W.lag_features(sdf, ["v"], [1, 24], o, target="y", sizing=sizing)
    same(lagged, "v_lag_24", pdf.v.shift(24)[24:])
    same(lagged, "y_lag_1", pdf.y.shift(1)[24:])
    rolled = W.rolling_stats(sdf, ["v"], 6, o, target="y", sizing=sizing)
    same(rolled, "v_rolling_mean_6", pdf.v.rolling(6, min_periods=1).mean())
    same(rolled, "v_rolling_std_6", pdf.v.rolling(6, min_periods=1).std(ddof=0).fillna(0))
    same(rolled, "y_rolling_mean_6", pdf.y.shift(1).rolling(6, min_periods=1).mean())
    filled = pdf.v.fillna(pdf.v.mean())
    line = np.polyval(np.polyfit(pdf.i, filled, 1), pdf.i)
    same(W.detrend(sdf, ["v"], o, sizing=sizing), "v", filled - line)
    same(W.detrend(sdf, ["v"], o, "constant", sizing=sizing), "v", filled - filled.mean())


@pytest.mark.parametrize("sizing", [None, SMALL])
def test_fills(sdf, pdf, sizing):
    o = ["i"]
    same(fills.ffill(sdf, ["v"], o, sizing=sizing), "v", pdf.v.ffill())
    same(fills.ffill_bfill(sdf, ["v"], o, sizing=sizing), "v", pdf.v.ffill().bfill())
    same(fills.interpolate(sdf, ["v"], o, sizing=sizing), "v", pdf.v.interpolate())
    same(fills.interpolate(sdf, ["v"], o, "both", sizing=sizing), "v", pdf.v.interpolate(limit_direction="both"))
    by = pdf.groupby("s").v.transform(lambda x: x.interpolate())
    same(fills.interpolate(sdf, ["v"], o, "forward", "s", sizing=sizing), "v", by)
    long_gap = sdf.withColumn("v", F.when(F.col("i").isin(20, 390), F.col("i").cast("double")))
    want = pd.Series(np.where(pdf.i.isin([20, 390]), pdf.i, np.nan)).interpolate()
    same(fills.interpolate(long_gap, ["v"], o, sizing=sizing), "v", want)


def test_interpolate_both_with_empty_column(spark):
    df = spark.createDataFrame([(0, 1, None), (1, 1, None), (2, 2, 4.0)], "i int, s int, v double")
    out = fills.interpolate(df, ["v"], ["i"], "both", "s").orderBy("i")
    assert [r.v for r in out.collect()] == [4.0, 4.0, 4.0]


def test_align_hours_and_months(spark):
    hours = spark.createDataFrame(
        [("a", "2024-01-01 00:00:00", 1), ("a", "2024-01-01 01:00:00", 2), ("a", "2024-01-01 04:00:00", 3), ("a", "2024-01-01 02:30:00", 9)],
        "s string, t string, v int",
    )
    step = align.Step(micros=align.HOUR_US)
    out = align.align_time(hours, "t", step, "s").orderBy("t").collect()
    assert [r.v for r in out] == [1, 2, None, None, 3]
    months = spark.createDataFrame([(f"1949-{m:02d}", m) for m in range(1, 13) if m != 5], "m string, v int")
    assert align.infer_step(months.withColumn("m", F.col("m").cast("timestamp")), "m") == align.Step(months=1)
    got = align.align_time(months, "m").orderBy("m").collect()
    assert [r.v for r in got] == [1, 2, 3, 4, None, 6, 7, 8, 9, 10, 11, 12]


def test_time_column_probe(spark):
    df = spark.createDataFrame([(1, "x", "2024-01-01"), (2, "y", "2024-01-02")], "id int, a string, b string")
    assert align.detect_time_col_by_probe(df, ["id"]) == "b"
    assert align.detect_time_col_by_probe(df.withColumnRenamed("a", "Date"), ["id"]) == "Date"
    with pytest.raises(ValueError):
        align.detect_time_col_by_probe(df.drop("b"), ["id"])


@pytest.mark.parametrize("inline", [3, 4, 5])
def test_label_encoding_is_the_same_on_both_sides_of_the_limit(spark, inline):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(["b", "a", None, "b", "c"])], "id int, t string")
    fitted = S.fit_label_encode(df, ["t"], inline)
    assert ("lookup" in fitted.params["t"]) == (inline < 4)
    assert {r.id: r.t for r in S.apply_label_encode(df, fitted).collect()} == {0: 1, 1: 0, 2: 3, 3: 1, 4: 2}
    assert {r.id: r.t for r in S.label_encode(df, ["t"]).collect()} == {0: 1, 1: 0, 2: 3, 3: 1, 4: 2}
    new = spark.createDataFrame([(0, "x"), (1, "c")], "id int, t string")
    assert {r.id: r.t for r in S.apply_label_encode(new, fitted).collect()} == {0: None, 1: 2}


def test_long_labels_are_joined(spark):
    df = spark.range(4).selectExpr("id", "repeat(CAST(id % 2 AS STRING), 1000) AS t")
    fitted = S.fit_label_encode(df, ["t"])
    assert "lookup" in fitted.params["t"] and S.apply_label_encode(df, fitted).filter("t <> id % 2").count() == 0


def test_texts_of_labels_are_not_joined_and_read_twice_at_most(spark):
    made = spark.sparkContext.accumulator(0)

    def seen(batches):
        for batch in batches:
            made.add(batch.num_rows)
            yield batch

    df = spark.range(600).selectExpr("id", "repeat(CAST(id % 5 AS STRING), 1000) AS t").mapInArrow(seen, "id bigint, t string")
    assert S.label_encode(df, ["t"]).filter("t <> id % 5").count() == 0
    assert made.value <= 1200
    table = S.fit_label_encode(df, ["t"]).params["t"]["lookup"]
    assert table.dtypes[0][1] == "binary" and {len(r[0]) for r in table.collect()} == {32}


@pytest.mark.parametrize("limits", [{"BROADCAST_ROWS": 0}, {"BROADCAST_BYTES": 3}, {}])
def test_lookup_join_is_the_same_by_every_way(spark, monkeypatch, limits):
    from seriesmill.operators import joins

    for name, value in limits.items():
        monkeypatch.setattr(joins, name, value)
    df = spark.range(5000).selectExpr("id", "CASE WHEN id < 3000 THEN 'hot' WHEN id < 3010 THEN NULL ELSE CAST(id AS STRING) END AS k")
    table = df.groupBy("k").count().withColumnRenamed("count", "n").withColumn("v", F.coalesce("k", F.lit("none")))
    out = joins.lookup_join(df, table, "k", "n")
    assert out.columns == ["id", "k", "v"] and out.count() == 5000
    assert out.filter("v <> coalesce(k, 'none') OR v IS NULL").count() == 0
