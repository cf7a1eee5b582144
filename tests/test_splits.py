"""Splits: sizes, disjointness, determinism, no leaks, fold geometry, parameter checks."""

import math

import pytest
from pyspark.sql import functions as F

from seriesmill.operators import split as G
from seriesmill.operators.ordering import Sizing


def parts(df, key="id"):
    out = {}
    for r in df.select(key, "split").collect():
        out.setdefault(r.split, set()).add(r[key])
    return out


@pytest.fixture(scope="module")
def table(spark):
    return spark.range(100).selectExpr("id", "id AS time", "CAST(id % 10 AS STRING) AS g", "CASE WHEN id < 50 THEN 'A' ELSE 'B' END AS label")


def test_random(table):
    p = parts(G.split_random(table, "id"))
    assert {k: len(v) for k, v in p.items()} == {"train": 69, "val": 11, "test": 20}
    assert len(set.union(*p.values())) == 100
    assert parts(G.split_random(table.repartition(7), "id")) == p
    assert parts(G.split_random(table, "id", seed=43)) != p
    nested = parts(G.split_random(table, "id", mode="nested"))
    assert {k: len(v) for k, v in nested.items()} == {"train": 72, "val": 8, "test": 20}


def test_rank_cuts_equal_sorting(spark, monkeypatch):
    monkeypatch.setattr("seriesmill.operators.ranks.TAKE_ROWS", 10)
    df = spark.range(2000).selectExpr("id", "CAST(id % 3 AS DOUBLE) AS t")
    got = parts(G.split_chronological(df, "t", "id"))
    order = [r.id for r in df.orderBy("t", "id").collect()]
    assert got == {"train": set(order[:1400]), "val": set(order[1400:1600]), "test": set(order[1600:])}
    n_val = math.ceil(1600 * (0.1 / (0.7 + 0.1)))  # 201: the share is a little more than an eighth in floating point
    sizes = {k: len(v) for k, v in parts(G.split_random(df, "id")).items()}
    assert sizes == {"train": 1600 - n_val, "val": n_val, "test": 400}


def test_stratified(table):
    for sizing in (None, Sizing(20, 5, 10)):
        out = G.split_stratified(table, "id", "label", sizing=sizing)
        counts = {(r.split, r.label): r["count"] for r in out.groupBy("split", "label").count().collect()}
        assert counts[("test", "A")] == counts[("test", "B")] == 10
        assert sum(v for (s, _), v in counts.items() if s == "val") in (10, 11)
    assert parts(G.split_stratified(table.repartition(3), "id", "label")) == parts(out)


def test_stratified_keeps_null_class(spark):
    df = spark.range(60).selectExpr("id", "CASE WHEN id % 2 = 0 THEN 'x' END AS c")
    assert sum(len(v) for v in parts(G.split_stratified(df, "id", "c")).values()) == 60


def test_chronological(table):
    p = parts(G.split_chronological(table, "time", "id"))
    assert p == {"train": set(range(70)), "val": set(range(70, 80)), "test": set(range(80, 100))}
    p = parts(G.split_chronological(table, "time", "id", mode="nested"))
    assert (len(p["train"]), len(p["val"]), len(p["test"])) == (72, 8, 20)
    p = parts(G.split_chronological(table, "time", "id", G.Fractions(0.7, 0.15, 0.15), "cumulative"))
    assert (len(p["train"]), len(p["val"]), len(p["test"])) == (70, 15, 15)


def test_group(table):
    p = parts(G.split_group(table, "g"), "g")
    # of the 8 groups that are not test, ceil(8 * 0.1 / (0.7 + 0.1)) = 2 are validation (see above)
    assert {k: len(v) for k, v in p.items()} == {"train": 6, "val": 2, "test": 2}
    assert len(set.union(*p.values())) == 10 == sum(map(len, p.values()))


@pytest.mark.parametrize("method", ["rolling", "expanding"])
@pytest.mark.parametrize("options", [{}, {"gap": 5}, {"step": 3, "n_folds": 2}, {"initial": 50, "val": 10}])
def test_folds(spark, method, options):
    n = 200
    df = spark.range(n).selectExpr("id", "id AS time")
    f = G.plan_folds(n, method, **options)
    got = {}
    out = G.time_series_cv(df, method, "time", "id", sizing=Sizing(20, 5, 10), **options)
    for r in out.collect():
        got.setdefault((r.fold_id, r.role), []).append(r.id)
    want = {(None, "test"): list(range(160, 200))}
    k, step = 0, f.step
    while options.get("n_folds", 10**9) > k:
        a = k * step if method == "rolling" else 0
        b = k * step + f.initial
        c = b + options.get("gap", 0)
        if c + f.val > 160:
            break
        want[(k, "train")], want[(k, "val")] = list(range(a, b)), list(range(c, c + f.val))
        k += 1
    assert {key: sorted(v) for key, v in got.items()} == want
    assert f.n_folds == k
    last = G.last_fold(out)
    assert {r.split for r in last.select("split").distinct().collect()} == {"train", "val", "test"}


def test_checks(table):
    with pytest.raises(ValueError):
        G.Fractions(0.7, 0.2, 0.2)
    with pytest.raises(ValueError):
        G.Fractions(0.8, 0.0, 0.2)
    with pytest.raises(ValueError):
        G.split(table, "sideways", "id")
    with pytest.raises(ValueError):
        G.split(table, "chronological", "id")
    with pytest.raises(ValueError):
        G.split(table, "group_kfold", "id", group_col="nope")
    with pytest.raises(ValueError):
        G.plan_folds(100, "rolling", n_folds=50)
    with pytest.raises(ValueError):
        G.plan_folds(100, "zigzag")
    assert parts(G.split(table, "random", "id")) == parts(G.split_random(table, "id"))
    assert G.split(table, "time_series_cv", "id", time_col="time", method="expanding").columns[-2:] == ["fold_id", "role"]


def test_split_info_and_guards(table):
    a = G.split_random(table, "id")
    assert {r.split: r.n for r in G.split_info(a, 20).collect()} == {"train": 69, "val": 11, "test": 20}
    with pytest.raises(ValueError, match="INSUFFICIENT"):
        G.split_info(a, 21)
    G.assert_same_split(a, G.split_random(table.repartition(4), "id"), "id")
    with pytest.raises(ValueError, match="MISMATCH"):
        G.assert_same_split(a, G.split_random(table, "id", seed=1), "id")
    with pytest.raises(ValueError, match="LEAK"):
        G.assert_same_split(a, a, "id", ["x", "y"], "y")
    assert a.filter(F.col("split").isNull()).count() == 0


def test_quotas_of_very_many_rows(spark):
    from seriesmill.operators.split import _quotas

    rows = [("a", 5 * 10**11 + 1), ("b", 3 * 10**11), ("c", 2 * 10**11 - 1)]
    strata = spark.createDataFrame(rows, "__c string, n bigint")
    want = 2 * 10**11 + 1
    got = {r["__c"]: r.q for r in _quotas(strata, "n", want, "q").collect()}
    exact = {c: divmod(want * n, 10**12) for c, n in rows}
    left = want - sum(q for q, _ in exact.values())
    first = sorted(exact, key=lambda c: (-exact[c][1], c))[:left]
    assert got == {c: q + (c in first) for c, (q, _) in exact.items()}
