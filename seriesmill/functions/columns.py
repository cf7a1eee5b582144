"""Column helpers shared by the operators: type selectors, missing values, numeric order codes."""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def field_type(df: DataFrame, col: str) -> T.DataType:
    return df.schema[col].dataType


def is_numeric(dt: T.DataType) -> bool:
    return isinstance(dt, T.NumericType)


def is_float(dt: T.DataType) -> bool:
    return isinstance(dt, (T.DoubleType, T.FloatType))


def is_temporal(dt: T.DataType) -> bool:
    return isinstance(dt, (T.TimestampType, T.TimestampNTZType, T.DateType))


def is_string(dt: T.DataType) -> bool:
    return isinstance(dt, (T.StringType, T.VarcharType, T.CharType))


def numeric_columns(df: DataFrame, cols: Iterable[str] | None = None) -> list[str]:
    """The numeric columns among ``cols`` (all columns by default); booleans are not numeric."""
    names = df.columns if cols is None else list(cols)
    return [c for c in names if is_numeric(field_type(df, c))]


def string_columns(df: DataFrame, cols: Iterable[str] | None = None) -> list[str]:
    names = df.columns if cols is None else list(cols)
    return [c for c in names if is_string(field_type(df, c))]


def quoted(name: str) -> Column:
    """Column reference that is safe for names with dots."""
    return F.col("`" + name.replace("`", "``") + "`")


def missing(df: DataFrame, col: str) -> Column:
    """True where the value is null or NaN."""
    c = quoted(col)
    return (c.isNull() | F.isnan(c)) if is_float(field_type(df, col)) else c.isNull()


def present(df: DataFrame, col: str) -> Column:
    """The column with NaN turned into null."""
    c = quoted(col)
    return F.when(~F.isnan(c), c) if is_float(field_type(df, col)) else c


def as_double(df: DataFrame, col: str) -> Column:
    """Numeric column as double, NaN as null."""
    return present(df, col).cast("double")


def finite(c: Column) -> Column:
    """Null for NaN and the infinities."""
    return F.when(~F.isnan(c) & (F.abs(c) != F.lit(float("inf"))), c)


def safe_name(value: object) -> str:
    """Text of a category as it may appear in a column name."""
    return re.sub(r"[`\n\r]", "_", str(value))


def common_head(low: str, high: str) -> int:
    """Bytes that all strings between two strings have in common at their start."""
    a, b = low.encode(), high.encode()
    return next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))


def text_code(value: str, head: int) -> float:
    """``order_code`` of one string."""
    return float(int.from_bytes(value.encode()[head : head + 6].ljust(6, b"\0"), "big"))


def order_code(df: DataFrame, col: str, head: int | Column = 0) -> Column:
    """A double that never decreases when the column grows, for cutting a sort order into ranges.

    Equal codes do not imply equal values (long strings share a prefix), so the code only decides
    in which range a row falls; the rows inside a range are sorted by the real column. Strings that all share ``head``
    bytes are told apart by the six bytes after them.
    """
    c, dt = quoted(col), field_type(df, col)
    if isinstance(dt, T.TimestampType):
        return F.unix_micros(c).cast("double")
    if isinstance(dt, T.TimestampNTZType):
        day = F.datediff(F.to_date(c), F.lit("1970-01-01").cast("date")).cast("double")
        clock = F.hour(c) * 3600 + F.minute(c) * 60
        return day * 86400.0 + clock + F.extract(F.lit("SECOND"), c).cast("double")
    if isinstance(dt, T.DateType):
        return F.datediff(c, F.lit("1970-01-01").cast("date")).cast("double")
    if is_float(dt):  # infinities and NaN stay below the code that stands for null
        c = c.cast("double")
        return F.when(F.isnan(c), F.lit(1.5e308)).otherwise(F.least(c, F.lit(1e308)))
    if isinstance(dt, T.BooleanType) or is_numeric(dt):
        return c.cast("double")
    if is_string(dt):
        start = head + 1 if isinstance(head, int) else head.cast("int") + 1
        six = F.substring(c.cast("binary"), start, 6 if isinstance(head, int) else F.lit(6))
        return F.conv(F.rpad(F.hex(six), 12, "0"), 16, 10).cast("double")
    raise TypeError(f"cannot order by {col}: {dt.simpleString()}")


def literal(value: object, dt: T.DataType) -> Column:
    """A collected value as a literal of its column's type.

    Python's datetimes do not tell local time from instants: as a plain literal, a time without zone would be read in the
    zone of this process and compared in the session's.
    """
    if value is not None and isinstance(dt, T.TimestampNTZType):
        return F.lit(value.isoformat(sep=" ")).cast(dt)
    if value is not None and isinstance(dt, T.TimestampType):
        return F.timestamp_micros(F.lit(int(value.replace(microsecond=0).timestamp()) * 1_000_000 + value.microsecond))
    return F.lit(value).cast(dt)


def ascending(cols: Sequence[str]) -> list[Column]:
    return [quoted(c).asc_nulls_last() for c in cols]


def descending(cols: Sequence[str]) -> list[Column]:
    return [quoted(c).desc_nulls_first() for c in cols]


def as_list(cols: str | Sequence[str] | None) -> list[str]:
    if cols is None:
        return []
    return [cols] if isinstance(cols, str) else list(cols)


def hash_order(key: str | Sequence[str], seed: int) -> list[Column]:
    """Pseudo-random but reproducible order of rows: md5 of ``seed:key``.

    Returns the first 15 hex digits as a bigint (uniform, cheap to cut into ranges) and the full digest.
    """
    parts = [quoted(k).cast("string") for k in as_list(key)]
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), *parts))
    return [F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint"), digest]
