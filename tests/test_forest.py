"""Random forests: the ways to grow agree with a plain tree, whatever the size."""

import numpy as np
import pandas as pd
import pytest

from seriesmill.operators import forest
from seriesmill.operators import models as H

ONE = {"n_estimators": 1, "bootstrap": False, "max_features": "all", "max_bins": 255}


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(3)
    n = 1500
    pdf = pd.DataFrame({"id": np.arange(n), "a": rng.integers(0, 12, n) * 1.0, "b": rng.normal(size=n).round(1), "c": rng.integers(0, 5, n) * 1.0})
    pdf["y"] = 3 * pdf.a - pdf.b * pdf.c + rng.normal(0, 0.5, n)
    pdf["k"] = (pdf.y > pdf.y.median()).astype(int) + (pdf.c > 3)
    return pdf, H.stable_partitions(spark.createDataFrame(pdf), "id", 3).persist()


def plain(x, y, depth, leaf, classes):
    """Greedy tree by loops; returns the value of every row."""

    def score(v):
        return sum((v == k).sum() ** 2 for k in range(classes)) / len(v) if classes else v.sum() ** 2 / len(v)

    def value(v):
        return np.array([(v == k).mean() for k in range(classes)]) if classes else np.array([v.mean()])

    out = np.zeros((len(y), max(1, classes)))

    def go(rows, left):
        best = (0, None)
        if left and not (classes and len(set(y[rows])) == 1):
            for f in range(x.shape[1]):
                for cut in np.unique(x[rows, f])[:-1]:
                    at = x[rows, f] <= cut
                    if min(at.sum(), (~at).sum()) >= leaf:
                        gain = score(y[rows][at]) + score(y[rows][~at]) - score(y[rows])
                        if gain > best[0] * (1 + 1e-9) + 1e-8:
                            best = (gain, at)
        if best[1] is None:
            out[rows] = value(y[rows])
        else:
            go(rows[best[1]], left - 1)
            go(rows[~best[1]], left - 1)

    go(np.arange(len(y)), depth)
    return out


WAYS = {"cells": {}, "levels": {"LOCAL_CELLS": 0, "LOCAL_ROWS": 0, "JOB_BYTES": 20_000}, "small nodes": {"LOCAL_CELLS": 0, "LOCAL_ROWS": 200, "JOB_BYTES": 20_000}}


@pytest.mark.parametrize("way", WAYS)
@pytest.mark.parametrize(("target", "classes"), [("y", 0), ("k", 3)])
def test_equals_a_plain_tree(data, monkeypatch, way, target, classes):
    pdf, df = data
    for name, value in WAYS[way].items():
        monkeypatch.setattr(forest, name, value)
    fit = forest.fit(df, ["a", "b", "c"], target, classes, forest.Settings(max_depth=5, min_samples_leaf=3, **ONE))
    got = df.select("id", fit.column(df).alias("p")).toPandas().set_index("id").p.sort_index()
    want = plain(pdf[["a", "b", "c"]].to_numpy(), pdf[target].to_numpy(), 5, 3, classes)
    assert np.abs(np.stack(got) - want).max() < 1e-9
    assert fit.gains.sum() == pytest.approx(1.0)


@pytest.mark.parametrize("way", WAYS)
def test_forests_learn_and_repeat(data, monkeypatch, way):
    pdf, df = data
    for name, value in WAYS[way].items():
        monkeypatch.setattr(forest, name, value)
    s = forest.Settings(n_estimators=5, max_depth=8)
    one, two = (forest.fit(df, ["a", "b", "c"], "y", 0, s) for _ in range(2))
    assert all((a.left == b.left).all() and (a.value == b.value).all() for a, b in zip(one.trees, two.trees))
    assert len({t.value[0, 0] for t in one.trees}) == 5  # rows are drawn anew for every tree
    got = df.select("id", one.column(df)[0].alias("p")).toPandas().set_index("id").p.sort_index()
    assert 1 - ((pdf.y - got) ** 2).mean() / pdf.y.var() > 0.8


def test_draws_are_poisson():
    w = forest._draws(400_000, forest.Settings(), 3, 5)
    for k, share in enumerate([0.367879, 0.367879, 0.18394, 0.061313]):
        assert (w == k).mean() == pytest.approx(share, abs=0.004)
    assert w.mean() == pytest.approx(1, abs=0.01) and len(w) == 400_000


def test_features_are_drawn_per_node():
    assert [forest.Settings(max_features=v).drawn(4) for v in ("sqrt", "log2", 0.5, 0.8, "all", None, 3)] == [2, 2, 2, 4, 4, 4, 3]
    picks = forest._node_features(forest.Settings(max_features=0.5), 0, np.arange(200), 4)
    assert picks.shape == (200, 2) and (picks[:, 0] < picks[:, 1]).all() and len(np.unique(picks, axis=0)) == 6
    with pytest.raises(ValueError):
        forest.Settings(max_features="many")


def test_equal_trees_are_grown_once(data):
    pdf, df = data
    s = forest.Settings(n_estimators=5, bootstrap=False, max_features="all", max_depth=6)
    many, one = (forest.fit(df, ["a", "b", "c"], "y", 0, forest.Settings(**{**vars(s), "n_estimators": n})) for n in (5, 1))
    assert len(many.trees) == 5 and len({id(t) for t in many.trees}) == 1
    a, b = ([r[0][0] for r in df.select("id", f.column(df).alias("p")).orderBy("id").select("p").collect()] for f in (many, one))
    assert np.allclose(a, b, rtol=1e-12)


@pytest.mark.parametrize("classes", [False, True])
@pytest.mark.parametrize("at_once", [1, 7, 512])
def test_subtrees_do_not_depend_on_how_many_nodes_are_taken_together(monkeypatch, classes, at_once):
    rng = np.random.default_rng(5)
    bins = np.unique(rng.integers(0, 30, (3000, 3)).astype(np.uint8), axis=0)
    w = rng.poisson(1.0, len(bins)).astype(float)
    sums = rng.poisson(0.7, (len(bins), 3)).astype(float) if classes else np.stack((w, w * rng.integers(-99, 99, len(bins))), axis=1)
    s = forest.Settings(max_depth=20, min_samples_leaf=1, max_features=0.5)
    whole = forest.grow_here(bins, sums, s, 0, 20, 31, classes)[0].done(20, classes)
    monkeypatch.setattr(forest, "NODES_AT_ONCE", at_once)
    cut = forest.grow_here(bins, sums, s, 0, 20, 31, classes)[0].done(20, classes)
    assert all(np.array_equal(getattr(whole, c), getattr(cut, c)) for c in ("feature", "split", "left", "value"))
    full, picks = forest._histogram(bins, sums, np.zeros(len(bins), np.int64), np.arange(3)[None], 31), np.arange(3)[None]
    short, at = forest._short_histogram(bins, sums, np.zeros(len(bins), np.int64), picks, 31)
    for x, y in zip(forest._best(full, picks, s, classes), forest._best(short, picks, s, classes, at)):
        assert np.array_equal(x, y)


def test_trials_share_the_binned_rows(spark, data, monkeypatch):
    from seriesmill.operators import search

    pdf, df = data
    calls, own = [], forest.laid_out
    monkeypatch.setattr(forest, "laid_out", lambda *a: calls.append(1) or own(*a))
    space = {"n_estimators": ("int", 2, 4), "max_depth": ("int", 2, 5)}
    found = search.tune("RandomForest", df, df, ["a", "b", "c"], "y", "rmse", 3, space=space)
    assert len(calls) == 1 and not any(t["error"] for t in found.trials)
    alone = H.fit_model(df.coalesce(1), ["a", "b", "c"], "y", "RandomForest", found.best_params)
    assert search.val_score(alone, df, "rmse") == pytest.approx(found.best_score)


def test_a_frequent_cell_is_shared_by_partitions(spark, monkeypatch):
    from seriesmill.operators import layout

    monkeypatch.setattr(layout, "BLOCK_ROWS", 100)
    n = 2000
    pdf = pd.DataFrame({"a": np.where(np.arange(n) % 2, 3, np.arange(n) % 40) * 1.0, "y": np.arange(n) * 1.0})
    held = forest.prepared(spark.createDataFrame(pdf).repartition(5), ["a"], "y")
    parts = held.laid.collect()
    assert len(parts) == 16 and max(len(p[3]) for p in parts) < 200
    assert sum(len(p[1]) for p in parts) <= len(held.cells) + len(parts)  # a cell goes on in the next partition at most
    got = [(b, y) for _, cells, starts, ys in parts for b, y in zip(np.repeat(held.cells[cells][:, 0], np.diff(starts, append=len(ys))), ys)]
    assert sorted(got) == sorted(zip(layout.binned([pdf.a.to_numpy()], held.edges)[:, 0], pdf.y))
    held.free()


@pytest.mark.parametrize(("target", "classes"), [("y", 0), ("k", 3)])
def test_forests_over_the_same_rows_share_sums_and_leave_their_trees(data, monkeypatch, target, classes):
    pdf, df = data
    monkeypatch.setattr(forest, "CHUNK", 100)
    held, names = forest.prepared(df.filter("a < 9 OR c > 0"), ["a", "b", "c"], target), ["a", "b", "c"]
    held.trees = 6
    held.cover(df)
    assert len(held.others)  # vectors that no training row has
    for s in (forest.Settings(n_estimators=n, max_depth=6, bootstrap=b) for n, b in ((6, True), (4, True), (5, False), (3, False))):
        fit = forest.fit(df, names, target, classes, s, held)
        known = [r.p for r in df.select("id", fit.column(df).alias("p")).orderBy("id").collect()]
        assert fit.trees.held is None  # no tree has come to the driver
        other = df.select("*")
        assert np.allclose(known, [r.p for r in other.select("id", fit.column(other).alias("p")).orderBy("id").collect()], rtol=1e-12)
        alone = forest.fit(df.filter("a < 9 OR c > 0"), names, target, classes, s)
        assert len(fit.trees) == s.n_estimators and all(np.array_equal(a.value, b.value) for a, b in zip(fit.trees, alone.trees))
    assert len(held.shared) == 2  # with and without bootstrap
    held.free()
