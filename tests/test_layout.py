"""Rows dealt out for trees."""

import numpy as np
import pandas as pd

from seriesmill.operators import boosting, layout


def frame(spark, n, parts):
    pdf = pd.DataFrame({"a": np.arange(n) % 7.0, "b": np.arange(n) % 5.0, "c": np.arange(n) % 3})
    pdf.loc[::11, "a"] = np.nan
    pdf["y"] = np.arange(n) % 13 * 1.0
    return pdf, spark.createDataFrame(pdf).repartition(parts)


def test_partitions_follow_from_rows(spark, monkeypatch):
    """Jobs per level are short: 40 partitions of few rows become one, large tables are cut by rows alone."""
    pdf, df = frame(spark, 3000, 40)
    edges = boosting.bin_edges(df, ["a", "b"], 64)
    laid, n = layout.laid_out(df, ["a", "b"], "y", edges, False)
    assert laid.getNumPartitions() == 1 and n == 3000
    monkeypatch.setattr(layout, "BLOCK_ROWS", 100)
    monkeypatch.setattr(layout, "PART_ROWS", 150)
    for parts in (1, 7):
        laid, n = layout.laid_out(frame(spark, 3000, parts)[1], ["a", "b"], "y", edges, False)
        sizes = laid.map(lambda p: len(p[4])).collect()
        assert laid.getNumPartitions() == 20 and sum(sizes) == 3000 and max(sizes) <= 300


def test_cells_stand_for_rows(spark):
    pdf, df = frame(spark, 3000, 4)
    edges = boosting.bin_edges(df, ["a", "b"], 64)
    want = layout.binned([pdf.a.to_numpy(), pdf.b.to_numpy()], edges)
    for target, classes in (("y", False), ("c", True)):
        [(number, bins, own, idx, y)] = layout.laid_out(df, ["a", "b"], target, edges, classes)[0].collect()
        assert sorted(map(tuple, np.column_stack((bins[idx], y)))) == sorted(map(tuple, np.column_stack((want, pdf[target]))))
        assert len(bins) == len(np.unique(np.column_stack((want, pdf[target])) if classes else want, axis=0))
        assert not classes or (own[idx] == y).all()


def test_wide_vectors_are_numbered():
    rng = np.random.default_rng(1)
    bins = rng.integers(0, 250, (500, 40)).astype(np.uint8)
    bins = np.concatenate((bins, bins[::-1]))
    first, idx = layout.numbered_cells(bins)
    assert len(first) == 500 and (bins[first][idx] == bins).all()
