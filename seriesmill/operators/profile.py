"""Column profiles: types, missing and distinct counts, numeric statistics, time order, hints.

The profile is a table with one row per column, so that many tables can be profiled and classified together.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seriesmill.functions.columns import (
    as_double,
    as_list,
    field_type,
    is_numeric,
    is_string,
    is_temporal,
    missing,
    numeric_columns,
    order_code,
    present,
    quoted,
)
from seriesmill.operators.ordering import Sizing, fit_layout
from seriesmill.operators.quantiles import exact_quantiles
from seriesmill.sources.tables import sample_values

PROBE_ROWS = 20  # values looked at when text is tested for dates
WITNESS_RANGES = 1_000  # ranges of the row order in which smallest and largest values are compared
PARSE_SHARE = 0.8  # share of them that must parse

# Names of the data types as the task rules test them.
DTYPE_NAMES = {
    T.ByteType: "int8",
    T.ShortType: "int16",
    T.IntegerType: "int32",
    T.LongType: "int64",
    T.FloatType: "float32",
    T.DoubleType: "float64",
    T.BooleanType: "bool",
    T.TimestampType: "datetime64",
    T.TimestampNTZType: "datetime64",
    T.DateType: "datetime64",
    T.StringType: "object",
}


def dtype_name(dt: T.DataType) -> str:
    return DTYPE_NAMES.get(type(dt), "decimal" if isinstance(dt, T.DecimalType) else "object")


def _one_row_to_long(
    stats: DataFrame, cols: Sequence[str], fields: dict[str, str], known: Sequence[dict[str, Column]] | None = None
) -> DataFrame:
    """Turns columns ``{i}|{field}`` of a one-row frame into one row per profiled column, with what is ``known`` added."""
    rows = [
        F.struct(
            F.lit(c).alias("column"),
            *[F.col(f"`{i}|{f}`").cast(t).alias(f) for f, t in fields.items()],
            *[v.alias(n) for n, v in (known[i] if known else {}).items()],
        )
        for i, c in enumerate(cols)
    ]
    return stats.select(F.inline(F.array(*rows)))


def missing_stats(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """(column, missing_count, missing_fraction): null or NaN, fraction to 6 places."""
    cols = list(df.columns if cols is None else cols)
    n = F.count(F.lit(1))
    exprs = []
    for i, c in enumerate(cols):
        gone = F.count_if(missing(df, c))
        exprs += [gone.alias(f"{i}|missing_count"), _fraction(gone, n).alias(f"{i}|missing_fraction")]
    return _one_row_to_long(df.agg(*exprs), cols, {"missing_count": "bigint", "missing_fraction": "double"})


def _fraction(part: Column, n: Column) -> Column:
    return F.round(F.coalesce(F.try_divide(part.cast("double"), n), F.lit(0.0)), 6)


def distinct_stats(df: DataFrame, cols: Sequence[str] | None = None, approx: bool = False) -> DataFrame:
    """(column, unique_count) without missing values.

    Exact counts read every column on its own, so that only its distinct values are shuffled and no row is
    copied once per column. ``approx=True`` uses sketches and shuffles no values at all.
    """
    cols = list(df.columns if cols is None else cols)
    if approx:
        exprs = [F.approx_count_distinct(_hashable(df, c)).alias(f"{i}|unique_count") for i, c in enumerate(cols)]
        return _one_row_to_long(df.agg(*exprs), cols, {"unique_count": "bigint"})
    parts = [
        df.select(_hashable(df, c).alias("v")).distinct().agg(F.lit(c).alias("column"), F.count("v").alias("unique_count"))
        for c in cols
    ]
    return reduce(DataFrame.unionByName, parts)


def _hashable(df: DataFrame, c: str) -> Column:
    if isinstance(field_type(df, c), T.MapType):
        return F.to_json(quoted(c))
    return present(df, c)


NUMERIC_FIELDS = {"min": "double", "max": "double", "mean": "double", "std": "double", "has_negative_values": "boolean"}


def _numeric_exprs(df: DataFrame, c: str, i: int) -> list[Column]:
    if not is_numeric(field_type(df, c)):
        null = F.first(F.lit(None))
        parts = [null.cast("double")] * 4 + [F.first(F.lit(False))]
    else:
        v = as_double(df, c)
        parts = [F.min(v), F.max(v), F.avg(v), F.stddev_samp(v), F.coalesce(F.bool_or(v < 0), F.lit(False))]
    return [p.alias(f"{i}|{f}") for p, f in zip(parts, NUMERIC_FIELDS)]


def numeric_stats(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """(column, min, max, mean, std, has_negative_values) of numeric columns; sample deviation, null for one value."""
    cols = numeric_columns(df, cols)
    exprs = [e for i, c in enumerate(cols) for e in _numeric_exprs(df, c, i)]
    return _one_row_to_long(df.agg(*exprs), cols, NUMERIC_FIELDS)


def _first_values(df: DataFrame, order_by, probe: int, n: int, cols: Sequence[str]) -> dict[str, tuple[float, list[str]]]:
    """Per column: share of its first ``probe`` values that parse as a time, and the first ``n`` of them as text."""
    if not cols:
        return {}
    values = sample_values(df, order_by, max(probe, n), cols)
    shown = F.transform(
        F.array_sort(F.collect_list(F.when(F.col("rank") <= n, F.struct("rank", "value")))), lambda s: s["value"]
    )
    parsed = F.when(F.col("rank") <= probe, F.col("value").try_cast("timestamp").isNotNull().cast("int"))
    per_column = values.groupBy("column").agg(F.avg(parsed).alias("share"), shown.alias("first"))
    return {r["column"]: (r["share"], r["first"]) for r in per_column.collect()}  # one row per column


def _types(df: DataFrame, first: dict, thr: float) -> dict[str, str]:
    out = {}
    for c in df.columns:
        dt = field_type(df, c)
        if isinstance(dt, T.BooleanType):
            out[c] = "boolean"
        elif is_temporal(dt):
            out[c] = "datetime"
        elif is_numeric(dt):
            out[c] = "numeric"
        elif is_string(dt):
            out[c] = "datetime" if c in first and first[c][0] >= thr else "categorical"
        else:
            out[c] = "unknown"
    return out


def infer_types(
    df: DataFrame, order_by: str | Sequence[str], probe: int = PROBE_ROWS, thr: float = PARSE_SHARE
) -> dict[str, str]:
    """Inferred type per column; text counts as datetime when enough of its first values parse."""
    text = [c for c in df.columns if is_string(field_type(df, c))]
    return _types(df, _first_values(df, order_by, probe, 0, text), thr)


def is_monotonic(df: DataFrame, col: str, order_by: str | Sequence[str], sizing: Sizing | None = None) -> DataFrame:
    """One row: does ``col`` never decrease in row order; nulls are ignored, null result for fewer than two values."""
    order = as_list(order_by)
    value = quoted(col)
    if is_string(field_type(df, col)):
        value = value.try_cast("timestamp")
    rows = df.select(*[quoted(c).alias(f"__o{i}") for i, c in enumerate(order)], value.alias("__v"))
    rows = rows.filter(F.col("__v").isNotNull())
    layout = fit_layout(rows, [f"__o{i}" for i in range(len(order))], None, 1, sizing)
    pairs = layout.windowed(rows, {"__p": lambda w: F.lag("__v", 1).over(w)}, before=1)
    ordered = F.count_if(F.col("__p") > F.col("__v")) == 0
    return pairs.agg(F.when(F.count(F.lit(1)) > 1, ordered).alias("is_monotonic"))


def surely_falling(df: DataFrame, cols: Sequence[str], order_by: str | Sequence[str]) -> set[str]:
    """Columns of which a value is below one of an earlier range of the first order column, found for all in one pass.

    These are not monotonic; of the others nothing is known. Spares most unsorted columns the sort of the whole table.
    """
    first = as_list(order_by)[0]
    if not cols or is_string(field_type(df, first)):
        return set()
    values = {f"__v{i}": quoted(c).try_cast("timestamp") if is_string(field_type(df, c)) else quoted(c) for i, c in enumerate(cols)}
    rows = df.select(order_code(df, first).cast("double").alias("__o"), *[v.alias(n) for n, v in values.items()])
    rows = rows.select("__o", *[order_code(rows, n).alias(n) for n in values]).filter(F.col("__o").isNotNull())
    low, high = rows.agg(F.min("__o"), F.max("__o")).first()
    if low is None or not low < high or math.isinf(high - low):
        return set()
    ranges = rows.groupBy(F.floor((F.col("__o") - low) * (WITNESS_RANGES / (high - low))).alias("__r"))
    found = ranges.agg(*[f(n).alias(f"{k}{n}") for n in values for k, f in (("lo", F.min), ("hi", F.max))])
    out, upto = set(), dict.fromkeys(values)
    for r in sorted(found.collect(), key=lambda r: r["__r"]):  # WITNESS_RANGES + 1 rows at most
        for n, c in zip(values, cols):
            if r[f"lo{n}"] is None:
                continue
            if upto[n] is not None and r[f"lo{n}"] < upto[n]:
                out.add(c)
            upto[n] = r[f"hi{n}"] if upto[n] is None else max(upto[n], r[f"hi{n}"])
    return out


def is_sorted(df: DataFrame, col: str, order_by: str | Sequence[str], sizing: Sizing | None = None) -> bool:
    """Whether sorting by ``col`` would leave the row order unchanged."""
    return is_monotonic(df, col, order_by, sizing).first()[0] is not False


PROFILE_FIELDS = {
    "missing_count": "bigint",
    "missing_fraction": "double",
    **NUMERIC_FIELDS,
    "num_rows": "bigint",
}


def profile(
    df: DataFrame,
    order_by: str | Sequence[str],
    table_name: str = "table",
    approx: bool = False,
    sizing: Sizing | None = None,
) -> DataFrame:
    """One row per column: type, missing and distinct counts, statistics, sample values, time order.

    Counts and statistics come from one aggregation over the table, distinct counts from one pass per column.
    """
    order, cols = as_list(order_by), df.columns
    first = _first_values(df, order, PROBE_ROWS, 5, cols)
    types = _types(df, first, PARSE_SHARE)
    n = F.count(F.lit(1))
    exprs = []
    for i, c in enumerate(cols):
        gone = F.count_if(missing(df, c))
        exprs += [
            gone.alias(f"{i}|missing_count"),
            _fraction(gone, n).alias(f"{i}|missing_fraction"),
            *_numeric_exprs(df, c, i),
            n.alias(f"{i}|num_rows"),
        ]
    rising = {c: True for c in cols if types[c] == "datetime" and c == order[0] and not is_string(field_type(df, c))}
    open_ = [c for c in cols if types[c] == "datetime" and c not in rising]
    falling = surely_falling(df, open_, order)
    rising |= {c: False if c in falling else is_monotonic(df, c, order, sizing).first()[0] for c in open_}
    known = [
        {
            "ordinal": F.lit(i),
            "inferred_type": F.lit(types[c]),
            "dtype": F.lit(dtype_name(field_type(df, c))),
            "is_monotonically_increasing": F.lit(rising.get(c)).cast("boolean"),
            "sample_values": F.array(*[F.lit(v) for v in first.get(c, (0.0, []))[1]]).cast("array<string>"),
        }
        for i, c in enumerate(cols)
    ]
    out = _one_row_to_long(df.agg(*exprs), cols, PROFILE_FIELDS, known)
    out = out.join(F.broadcast(distinct_stats(df, cols, approx)), "column")  # one row per column on both sides
    return out.select(
        F.lit(table_name).alias("table_name"),
        "ordinal",
        F.col("column").alias("name"),
        "inferred_type",
        "dtype",
        "missing_count",
        "missing_fraction",
        "unique_count",
        "sample_values",
        *NUMERIC_FIELDS,
        (F.col("inferred_type") == "datetime").alias("is_temporal"),
        "is_monotonically_increasing",
        "num_rows",
    )


def profile_tables(tables: dict[str, tuple[DataFrame, Sequence[str]]], approx: bool = False) -> DataFrame:
    """Profiles of several tables, ``{name: (table, order_by)}``, in one frame."""
    parts = [profile(df, order, name, approx) for name, (df, order) in tables.items()]
    return reduce(DataFrame.unionByName, parts)


def quality_issues(prof: DataFrame, limit: float = 0.9) -> DataFrame:
    """A message for every column with more than ``limit`` of its values missing."""
    text = F.format_string(
        "Column '%s' has %.1f%% missing values (likely_unusable).", "name", F.col("missing_fraction") * 100
    )
    hit = prof.filter(F.col("missing_fraction") > limit)
    return hit.select("table_name", "name", text.alias("issue"))


def profile_hints(prof: DataFrame) -> DataFrame:
    """Per table: the last numeric column as target candidate and whether there are several numeric columns."""
    numeric = F.col("inferred_type") == "numeric"
    return prof.groupBy("table_name").agg(
        F.max_by(F.when(numeric, F.col("name")), F.when(numeric, F.col("ordinal"))).alias("suggested_target"),
        F.lit("low").alias("target_confidence"),
        (F.count_if(numeric) > 1).alias("is_multivariate"),
    )


def validate_hints(prof: DataFrame, hints: DataFrame) -> DataFrame:
    """Hints whose suggested column does not exist become null with low confidence."""
    names = prof.select("table_name", F.col("name").alias("suggested_target"), F.lit(True).alias("__known"))
    out = hints.join(names, ["table_name", "suggested_target"], "left")
    known = F.coalesce(F.col("__known"), F.lit(False))
    return out.select(
        "table_name",
        F.when(known, F.col("suggested_target")).alias("suggested_target"),
        F.when(known, F.col("target_confidence")).otherwise(F.lit("low")).alias("target_confidence"),
        *[c for c in hints.columns if c not in ("table_name", "suggested_target", "target_confidence")],
    )


def temporal_coverage(df: DataFrame, time_col: str, partition_by: str | Sequence[str] | None = None) -> DataFrame:
    """Earliest and latest time (per series)."""
    keys = as_list(partition_by)
    return df.groupBy(*keys).agg(F.min(quoted(time_col)).alias("earliest"), F.max(quoted(time_col)).alias("latest"))


def series_flags(
    df: DataFrame,
    value: str,
    order_by: str | Sequence[str],
    lag: int = 24,
    trend_r2: float = 0.5,
    season_corr: float = 0.5,
    sizing: Sizing | None = None,
) -> DataFrame:
    """One row: trend strength (r² over the position), correlation with the value ``lag`` rows back, outlier count."""
    order = as_list(order_by)
    v = as_double(df, value)
    rows = df.select(*[quoted(c).alias(f"__o{i}") for i, c in enumerate(order)], v.alias("__v"))
    keys = [f"__o{i}" for i in range(len(order))]
    fences = exact_quantiles(rows, ["__v"], [0.25, 0.75])["__v"]
    reach = 1.5 * (fences[0.75] - fences[0.25])
    low, high = fences[0.25] - reach, fences[0.75] + reach
    layout = fit_layout(rows, keys, None, lag, sizing)
    placed = layout.position(rows, "__x")
    lagged = layout.windowed(placed, {"__l": lambda w: F.lag("__v", lag).over(w)}, before=lag)
    out = lagged.agg(
        F.regr_r2(F.col("__v"), F.col("__x").cast("double")).alias("trend_r2"),
        F.corr("__v", "__l").alias("lag_corr"),
        F.count_if((F.col("__v") < low) | (F.col("__v") > high)).alias("outlier_count"),
    )
    return out.select(
        "trend_r2",
        "lag_corr",
        "outlier_count",
        (F.col("trend_r2") >= trend_r2).alias("has_trend"),
        (F.abs("lag_corr") >= season_corr).alias("has_seasonality"),
        (F.col("outlier_count") > 0).alias("has_outliers"),
    )
