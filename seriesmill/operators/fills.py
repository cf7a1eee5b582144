"""Filling gaps from neighbours: forward and backward fill, linear interpolation.

A gap may span any number of rows. Inside a block the nearest value comes from a window; across blocks
it is carried through a table with one row per block.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from seriesmill.functions.columns import as_double, as_list, numeric_columns, present, quoted, string_columns
from seriesmill.operators.ordering import BLK, Layout, fit_layout
from seriesmill.operators.quantiles import exact_quantiles


def _order_struct(layout: Layout, value: Column) -> Column:
    """Sortable (order columns, value) with nulls last, as the windows sort them."""
    parts = []
    for i, c in enumerate(layout.order):
        parts += [quoted(c).isNull().alias(f"n{i}"), quoted(c).alias(f"k{i}")]
    return F.struct(*parts, value.alias("v"))


def _carry(bound: DataFrame, layout: Layout, aggs: dict[str, tuple[Column, str]]) -> DataFrame:
    """Joins, per block, the nearest value before (``last``) or after (``first``) the block.

    ``aggs = {name: (per-block aggregate, "last" | "first")}``. One row per block: bounded by the layout.
    """
    blocks = bound.filter(F.col(BLK) > 0).groupBy(*layout.series, BLK).agg(*[a.alias(n) for n, (a, _) in aggs.items()])
    w = Window.partitionBy(*layout.series)
    cols = []
    for name, (_, side) in aggs.items():
        order = F.col(BLK).asc() if side == "last" else F.col(BLK).desc()
        frame = w.orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
        cols.append(F.last(name, ignorenulls=True).over(frame).alias(name))
    table = blocks.select(F.col(BLK).alias("__cb"), *cols)
    return bound.join(F.broadcast(table), F.col(BLK) == F.col("__cb"), "left").drop("__cb")


def _running(layout: Layout) -> tuple[WindowSpec, WindowSpec]:
    """Frames from the start of the block to the row, in order and in reverse.

    Looking ahead is a running frame over the reverse order: a frame that ends in UNBOUNDED FOLLOWING would be
    evaluated anew for every row.
    """
    start = Window.unboundedPreceding
    return layout.window().rowsBetween(start, 0), layout.reverse_window().rowsBetween(start, 0)


def fill_edges(df: DataFrame, cols: Sequence[str], layout: Layout, first: str = "forward", both: bool = True) -> DataFrame:
    """Fills nulls from the nearest row in the ``first`` direction and, if ``both``, then from the other one."""
    if not cols:
        return df
    bound = layout.bind(df)
    sides = ["forward", "backward"] if first == "forward" else ["backward", "forward"]
    sides = sides if both else sides[:1]
    values = {c: present(df, c) for c in cols}
    if layout.cut:
        aggs = {}
        for i, c in enumerate(cols):
            at = F.when(values[c].isNotNull(), _order_struct(layout, values[c]))
            if "forward" in sides:
                aggs[f"__f{i}"] = (F.max(at)["v"], "last")
            if "backward" in sides:
                aggs[f"__b{i}"] = (F.min(at)["v"], "first")
        bound = _carry(bound, layout, aggs)
    ahead, back = _running(layout)
    new = {}
    for i, c in enumerate(cols):
        near = {
            "forward": [F.last(values[c], ignorenulls=True).over(ahead)],
            "backward": [F.last(values[c], ignorenulls=True).over(back)],
        }
        if layout.cut:
            near["forward"].append(F.col(f"__f{i}")) if "forward" in sides else None
            near["backward"].append(F.col(f"__b{i}")) if "backward" in sides else None
        new[c] = F.coalesce(*[x for side in sides for x in near[side]])
    return bound.select(*[new[c].alias(c) if c in new else quoted(c) for c in df.columns])


def ffill(df, cols, order_by, partition_by=None, sizing=None) -> DataFrame:
    """Last value before the gap; leading nulls stay."""
    return fill_edges(df, cols, fit_layout(df, order_by, partition_by, 0, sizing), both=False)


def ffill_bfill(df, cols, order_by, partition_by=None, sizing=None) -> DataFrame:
    """Forward fill, then backward fill of leading nulls."""
    return fill_edges(df, cols, fit_layout(df, order_by, partition_by, 0, sizing))


def interpolate(df, cols, order_by, direction="forward", partition_by=None, sizing=None) -> DataFrame:
    """Linear between the neighbours by row position.

    ``forward`` holds the last value after the end and leaves leading nulls; ``both`` also holds the first
    value before the start and puts the column median where a whole series is null.
    """
    if direction not in ("forward", "both"):
        raise ValueError("direction must be 'forward' or 'both'")
    cols = numeric_columns(df, cols)
    if not cols:
        return df
    layout = fit_layout(df, order_by, partition_by, 0, sizing)
    bound = layout.bind(df)
    w = layout.window()
    place = (F.row_number().over(w) - 1).cast("bigint")
    if layout.cut:
        place = place + F.coalesce(F.col("__offset"), F.lit(0))
    bound = bound.withColumn("__p", place)
    points = {}
    for i, c in enumerate(cols):
        v = as_double(df, c)
        points[c] = F.when(v.isNotNull(), F.struct(F.col("__p").alias("p"), v.alias("v")))
    if layout.cut:
        aggs = {}
        for i, c in enumerate(cols):
            aggs[f"__f{i}"] = (F.max(points[c]), "last")
            aggs[f"__b{i}"] = (F.min(points[c]), "first")
        bound = _carry(bound, layout, aggs)
    ahead, back = _running(layout)
    shown, filled = [], {}
    for i, c in enumerate(cols):
        prev = [F.last(points[c], ignorenulls=True).over(ahead)]
        nxt = [F.last(points[c], ignorenulls=True).over(back)]
        if layout.cut:
            prev.append(F.col(f"__f{i}"))
            nxt.append(F.col(f"__b{i}"))
        shown += [F.coalesce(*prev).alias(f"__pv{i}"), F.coalesce(*nxt).alias(f"__nx{i}")]
    near = bound.select(*df.columns, "__p", *shown)
    medians = exact_quantiles(df, cols, [0.5]) if direction == "both" else {}
    for i, c in enumerate(cols):
        a, b = F.col(f"__pv{i}"), F.col(f"__nx{i}")
        step = (b["v"] - a["v"]) * (F.col("__p") - a["p"]) / F.nullif(b["p"] - a["p"], F.lit(0))
        value = F.coalesce(as_double(df, c), a["v"] + step, a["v"])
        if direction == "both":
            value = F.coalesce(value, b["v"], F.lit(medians[c][0.5]))
        filled[c] = value
    return near.select(*[filled[c].alias(c) if c in filled else quoted(c) for c in df.columns])


def fill_missing(df, order_by, strategy="mean", partition_by=None, sizing=None) -> DataFrame:
    """Whole-table filling: numbers by ``strategy`` (mean, median, forward or interpolate), text by forward fill."""
    from seriesmill.operators.scalar import impute

    numbers, text = numeric_columns(df), string_columns(df)
    keys = set(as_list(order_by)) | set(as_list(partition_by))
    numbers = [c for c in numbers if c not in keys]
    text = [c for c in text if c not in keys]
    if strategy in ("mean", "median"):
        df = impute(df, numbers, strategy)
    elif strategy == "forward":
        return ffill(df, numbers + text, order_by, partition_by, sizing)
    else:
        df = interpolate(df, numbers, order_by, "forward", partition_by, sizing)
    return ffill(df, text, order_by, partition_by, sizing) if text else df
