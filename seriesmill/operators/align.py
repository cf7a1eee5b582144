"""Regular time grids: find the time column, infer the step, insert missing steps."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seriesmill.functions.columns import as_list, field_type, is_string, is_temporal, quoted
from seriesmill.operators.ordering import Sizing, fit_layout

TIME_NAMES = ("time", "date", "timestamp")
HOUR_US = 3_600_000_000
_CHUNK = 10_000  # grid points made from one row


def detect_time_col_by_probe(df: DataFrame, order_by: Sequence[str], probe: int = 50) -> str:
    """A column named time, date or timestamp, else the first one whose first ``probe`` values all parse."""
    for c in df.columns:
        if c.lower() in TIME_NAMES:
            return c
    text = [c for c in df.columns if is_string(field_type(df, c))]
    bad = {}
    if text:
        head = df.orderBy(*order_by).limit(probe).select(*text)
        tests = [F.count_if(quoted(c).isNotNull() & quoted(c).try_cast("timestamp").isNull()).alias(c) for c in text]
        bad = head.agg(*tests).first().asDict()
    for c in df.columns:
        if is_temporal(field_type(df, c)) or (c in bad and bad[c] == 0):
            return c
    raise ValueError("no time-like column found")


@dataclass(frozen=True)
class Step:
    """Grid step: a number of microseconds, or of calendar months."""

    micros: int = 0
    months: int = 0

    def after(self, start: Column, k: Column) -> Column:
        if self.months:
            return F.timestamp_add("MONTH", (k * self.months).cast("int"), start)
        return F.timestamp_add("MICROSECOND", k * F.lit(self.micros).cast("bigint"), start)

    def count(self, start: Column, end: Column) -> Column:
        """Whole steps between two times."""
        if self.months:
            return F.floor(F.timestamp_diff("MONTH", start, end) / self.months).cast("bigint")
        return F.floor(F.timestamp_diff("MICROSECOND", start, end) / F.lit(self.micros)).cast("bigint")


def infer_step(df: DataFrame, time_col: str, partition_by=None, sizing: Sizing | None = None) -> Step:
    """Most frequent gap between neighbouring times (the smallest on a tie), hourly if there is none.

    Times that all fall on midnight of the first of a month count in months.
    """
    series = as_list(partition_by)
    times = df.select(*[quoted(s) for s in series], quoted(time_col).alias("t")).filter("t is not null")
    layout = fit_layout(times, ["t"], series or None, 1, sizing)
    gaps = layout.windowed(times, {"prev": lambda w: F.lag("t", 1).over(w)}, before=1)
    gaps = gaps.select(
        F.timestamp_diff("MICROSECOND", F.col("prev"), F.col("t")).alias("us"),
        F.timestamp_diff("MONTH", F.col("prev"), F.col("t")).alias("months"),
        ((F.dayofmonth("t") != 1) | (F.date_trunc("day", F.col("t")) != F.col("t"))).alias("off"),
    )
    counts = gaps.groupBy("us", "months").agg(F.count(F.lit(1)).alias("n"), F.max("off").alias("off"))
    positive = F.col("us") > 0
    row = counts.agg(
        F.min(F.when(positive, F.struct((-F.col("n")).alias("m"), F.col("us").alias("v")))).alias("by_us"),
        F.max("off").alias("off"),
    ).first()
    if row["by_us"] is None:
        return Step(micros=HOUR_US)
    if not row["off"] and row["by_us"]["v"] >= 28 * 24 * HOUR_US:
        top = (
            counts.filter("months > 0")
            .groupBy("months")
            .agg((-F.sum("n")).alias("m"))
            .agg(F.min(F.struct("m", "months")).alias("top"))
            .first()["top"]
        )
        if top is not None:
            return Step(months=int(top["months"]))
    return Step(micros=int(row["by_us"]["v"]))


def align_time(
    df: DataFrame,
    time_col: str,
    freq: Step | None = None,
    partition_by: Sequence[str] | str | None = None,
    sizing: Sizing | None = None,
) -> DataFrame:
    """One row per grid time between the first and last time (of each series); off-grid rows drop.

    Long grids are made chunk by chunk, so no task builds a whole series' grid as one array.
    """
    series = as_list(partition_by)
    if is_string(field_type(df, time_col)):
        df = df.withColumn(time_col, quoted(time_col).cast("timestamp"))
    elif isinstance(field_type(df, time_col), T.DateType):
        df = df.withColumn(time_col, quoted(time_col).cast("timestamp_ntz"))
    step = freq or infer_step(df, time_col, series, sizing)
    keys = [quoted(s) for s in series]
    span = df.groupBy(*keys).agg(F.min(quoted(time_col)).alias("__from"), F.max(quoted(time_col)).alias("__to"))
    span = span.filter(F.col("__from").isNotNull())
    span = span.withColumn("__n", step.count(F.col("__from"), F.col("__to")))
    chunks = span.withColumn("__k", F.explode(F.expr(f"sequence(0L, __n, {_CHUNK}L)")))
    chunks = chunks.repartition(*keys, "__k")
    points = chunks.withColumn("__k", F.explode(F.expr(f"sequence(__k, least(__n, __k + {_CHUNK - 1}L))")))
    grid = points.select(*keys, step.after(F.col("__from"), F.col("__k")).alias("__t"))
    right = df.select(*[quoted(c).alias(f"__r{i}") for i, c in enumerate(df.columns)])
    place = {c: f"__r{i}" for i, c in enumerate(df.columns)}
    on = F.col("__t") == F.col(place[time_col])
    for s in series:
        on = on & quoted(s).eqNullSafe(F.col(place[s]))
    joined = grid.join(right, on, "left")
    known = {time_col: F.col("__t"), **{s: quoted(s) for s in series}}
    return joined.select(*[known.get(c, F.col(place[c])).alias(c) for c in df.columns])
