"""Transforms over neighbouring rows: lags, rolling statistics, differences, smoothing, detrending.

Without ``partition_by`` the table is one long series, as in a flat file. ``order_by`` names the time
column and a unique tiebreak. Several window transforms that read the same columns can be evaluated in
one pass (one shuffle, one sort) by adding their ``WindowStep``s.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F

from seriesmill.functions.columns import as_double, as_list, field_type, is_float, numeric_columns, present, quoted
from seriesmill.operators.fills import fill_edges
from seriesmill.operators.joins import lookup_join
from seriesmill.operators.ordering import Layout, Sizing, fit_layout


@dataclass
class WindowStep:
    """New columns as functions of the ordered window, and how far they look."""

    columns: dict[str, Callable[[WindowSpec], Column]] = field(default_factory=dict)
    before: int = 0
    after: int = 0
    skip_first: int = 0
    sources: list[str] = field(default_factory=list)  # columns whose NaN count as null

    def __add__(self, other: WindowStep) -> WindowStep:
        return WindowStep(
            {**self.columns, **other.columns},
            max(self.before, other.before),
            max(self.after, other.after),
            max(self.skip_first, other.skip_first),
            list(dict.fromkeys([*self.sources, *other.sources])),
        )

    def evaluate(self, df: DataFrame, layout: Layout) -> DataFrame:
        # NaN become null once, before the shuffle, so that the window functions share the plain columns
        floats = {c: present(df, c) for c in self.sources if is_float(field_type(df, c))}
        df = df.withColumns(floats) if floats else df
        return layout.windowed(df, self.columns, self.before, self.after, self.skip_first)

    @property
    def reach(self) -> int:
        return max(self.before, self.after, self.skip_first)


def run_windows(
    df: DataFrame,
    step: WindowStep,
    order_by: Sequence[str],
    partition_by: Sequence[str] | str | None = None,
    layout: Layout | None = None,
    sizing: Sizing | None = None,
) -> DataFrame:
    """Evaluates a window step; a layout fitted earlier for the same order is reused."""
    if not step.columns and not step.skip_first:
        return df
    if layout is None or layout.reach < step.reach:
        layout = fit_layout(df, order_by, partition_by, step.reach, sizing)
    return step.evaluate(df, layout)


# ---------------------------------------------------------------- lags and rolling


def lag_step(df: DataFrame, cols: Sequence[str], lags: Sequence[int], target: str | None = None) -> WindowStep:
    """``{c}_lag_{k}`` for numeric columns and, as extra features, for the target; drops the first max(lags) rows."""
    step = WindowStep()
    if not lags:
        return step
    sources = numeric_columns(df, cols)
    if target is not None:
        sources = sources + numeric_columns(df, [target])
    step.sources = sources
    for c in sources:
        for k in lags:
            step.columns[f"{c}_lag_{k}"] = lambda w, c=c, k=k: F.lag(quoted(c), k).over(w)
    step.before = step.skip_first = max(lags)
    return step


def rolling_step(df: DataFrame, cols: Sequence[str], window: int = 24, target: str | None = None) -> WindowStep:
    """Trailing mean and population deviation; the target's window ends before the current row."""
    step = WindowStep()

    def add(c: str, first: int, last: int) -> None:
        v = quoted(c)
        step.sources.append(c)
        step.columns[f"{c}_rolling_mean_{window}"] = lambda w: F.avg(v).over(w.rowsBetween(first, last))
        step.columns[f"{c}_rolling_std_{window}"] = lambda w: F.coalesce(
            F.stddev_pop(v).over(w.rowsBetween(first, last)), F.lit(0.0)
        )

    for c in numeric_columns(df, cols):
        add(c, -(window - 1), 0)
    step.before = window - 1
    if target is not None and numeric_columns(df, [target]):
        add(target, -window, -1)
        step.before = window
    return step


def lag_features(df, cols, lags, order_by, partition_by=None, target=None, sizing=None) -> DataFrame:
    return run_windows(df, lag_step(df, cols, lags, target), order_by, partition_by, sizing=sizing)


def rolling_stats(df, cols, window, order_by, partition_by=None, target=None, sizing=None) -> DataFrame:
    return run_windows(df, rolling_step(df, cols, window, target), order_by, partition_by, sizing=sizing)


# ---------------------------------------------------------------- difference and smoothing


def difference_step(df: DataFrame, cols: Sequence[str], first: str = "drop") -> WindowStep:
    """Each value minus the one before it; the first row is dropped, or holds 0 (``first="zero"``)."""
    step = WindowStep(before=1)
    step.sources = numeric_columns(df, cols)
    for c in step.sources:
        v = quoted(c).cast("double")
        if first == "zero":
            step.columns[c] = lambda w, v=v: F.coalesce(v - F.lag(v, 1).over(w), F.lit(0.0))
        else:
            step.columns[c] = lambda w, v=v: v - F.lag(v, 1).over(w)
    if first == "drop" and step.columns:
        step.skip_first = 1
    return step


def difference(df, cols, order_by, partition_by=None, first="drop", sizing=None) -> DataFrame:
    return run_windows(df, difference_step(df, cols, first), order_by, partition_by, sizing=sizing)


def smooth_step(df: DataFrame, cols: Sequence[str], window: int = 3) -> WindowStep:
    """Trailing moving average over up to ``window`` rows."""
    step = WindowStep(before=window - 1)
    step.sources = numeric_columns(df, cols)
    for c in step.sources:
        step.columns[c] = lambda w, c=c: F.avg(quoted(c)).over(w.rowsBetween(-(window - 1), 0))
    return step


def smooth(df, cols, window, order_by, partition_by=None, center=False, sizing=None) -> DataFrame:
    """Moving average. ``center=True`` averages full windows around the row and fills the ends from their neighbours."""
    if not center:
        return run_windows(df, smooth_step(df, cols, window), order_by, partition_by, sizing=sizing)
    before = (window - 1) // 2 if window % 2 else window // 2
    after = window - 1 - before
    step = WindowStep(before=before, after=after, sources=numeric_columns(df, cols))
    for c in step.sources:

        def full(w: WindowSpec, c=c) -> Column:
            frame = w.rowsBetween(-before, after)
            return F.when(F.count(quoted(c)).over(frame) == window, F.avg(quoted(c)).over(frame))

        step.columns[c] = full
    layout = fit_layout(df, order_by, partition_by, step.reach, sizing)
    averaged = step.evaluate(df, layout)
    return fill_edges(averaged, list(step.columns), layout, first="backward")


# ---------------------------------------------------------------- detrend


def detrend(
    df: DataFrame,
    cols: Sequence[str],
    order_by: Sequence[str],
    kind: str = "linear",
    partition_by: Sequence[str] | str | None = None,
    sizing: Sizing | None = None,
) -> DataFrame:
    """Subtracts the least-squares line over the row position (or the mean), nulls counted as the mean.

    Filling nulls with the mean leaves the cross product of the present pairs unchanged, so one aggregation
    over the positions gives the line of the filled series.
    """
    if kind not in ("linear", "constant"):
        raise ValueError("kind must be 'linear' or 'constant'")
    cols = numeric_columns(df, cols)
    series = as_list(partition_by)
    if not cols:
        return df
    placed = fit_layout(df, order_by, partition_by, 0, sizing).position(df, "__x") if kind == "linear" else df
    x = F.col("__x").cast("double")
    aggs = [F.count(F.lit(1)).alias("__n")]
    for i, c in enumerate(cols):
        v = as_double(df, c)
        aggs.append(F.coalesce(F.avg(v), F.lit(0.0)).alias(f"__m{i}"))
        if kind == "linear":
            aggs.append(F.coalesce(F.regr_sxy(v, x), F.lit(0.0)).alias(f"__s{i}"))
    if kind == "linear":
        aggs += [F.avg(x).alias("__mx"), (F.var_pop(x) * F.count(x)).alias("__sxx")]
    if series:
        fits = placed.groupBy(*series).agg(*aggs).withColumn("__rows", F.col("__n"))
        source = lookup_join(placed, fits, series, "__rows")
        get = F.col
    else:
        row = placed.agg(*aggs).first()
        source, get = placed, lambda name: F.lit(row[name])
    new = {}
    for i, c in enumerate(cols):
        v = as_double(df, c)
        flat = F.coalesce(v, get(f"__m{i}")) - get(f"__m{i}")
        if kind == "linear":
            slope = F.coalesce(F.try_divide(get(f"__s{i}"), get("__sxx")), F.lit(0.0))
            flat = flat - slope * (x - get("__mx"))
        new[c] = F.when(get("__n") < 2, v).otherwise(flat)
    return source.select(*[new[c].alias(c) if c in new else quoted(c) for c in df.columns])
