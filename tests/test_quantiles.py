"""Exact quantiles of many columns: values against NumPy, passes over the data counted."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from seriesmill.operators import quantiles as Q


@pytest.fixture(scope="module")
def wide(spark):
    rng = np.random.default_rng(5)
    n = 6000
    made = {f"c{i}": rng.normal(i, 1 + i, n) for i in range(16)}
    made |= {"few": rng.integers(0, 3, n).astype(float), "same": np.full(n, 7.0), "inf": np.where(rng.random(n) < 0.3, np.inf, rng.normal(size=n))}
    made["gaps"] = np.where(rng.random(n) < 0.5, np.nan, rng.exponential(size=n))
    pdf = pd.DataFrame(made)
    return pdf, spark.createDataFrame(pdf).repartition(4)


@pytest.mark.parametrize("bracket", [50, 200_000])
def test_large_path(wide, monkeypatch, bracket):
    monkeypatch.setattr(Q, "BRACKET_ROWS", bracket)
    pdf, df = wide
    probs = [0.0, 0.25, 0.5, 0.75, 0.999, 1.0]
    got = Q.exact_quantiles(df, list(pdf.columns), probs, small_rows=0)
    for c in pdf.columns:
        v = np.sort(pdf[c].dropna().to_numpy())
        for p in probs:
            place = (len(v) - 1) * p
            k = int(place)
            want = v[k] if k == place else v[k] + (v[min(k + 1, len(v) - 1)] - v[k]) * (place - k)
            assert got[c][p] == want or (np.isnan(want) and np.isnan(got[c][p]))


def test_passes_do_not_grow_with_columns(spark, wide):
    pdf, df = wide
    rows = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            rows.add(b.num_rows)
            yield b

    passes = []
    for cols in (list(pdf.columns)[:2], list(pdf.columns)):
        before = rows.value
        Q.exact_quantiles(df.mapInArrow(counted, df.schema), cols, [0.25, 0.75], small_rows=0)
        passes.append((rows.value - before) / len(pdf))
    assert passes[1] <= 4 and passes == [3, 3]


def test_empty_and_small(spark, wide):
    pdf, df = wide
    assert Q.exact_quantiles(df.filter("false"), ["c0"], [0.5], small_rows=0) == {"c0": {0.5: None}}
    assert Q.exact_quantiles(df, ["c0"], [0.5])["c0"][0.5] == pytest.approx(float(pdf.c0.median()))
    assert Q.exact_quantiles(df, ["c0"], [0.5], where=F.col("c0") > 0)["c0"][0.5] == pytest.approx(float(pdf.c0[pdf.c0 > 0].median()))
