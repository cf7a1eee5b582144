"""The k-th row of an order, found by narrowing value ranges: no sort and no shuffle of the whole table."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from seriesmill.functions.columns import ascending, field_type, literal, order_code, quoted
from seriesmill.session import materialize

TAKE_ROWS = 200_000  # remaining rows that are sorted by a bounded top-k
_ACCURACY = 10_000
_HEX = 15  # hex digits of a digest that place it on the unit interval
_NULL_CODE = 1.7e308


def row_at(df: DataFrame, order_by: Sequence[str], rank: int, n: int | None = None, take_rows: int | None = None) -> Row:
    """The order columns of the row at 0-based ``rank``; nulls last.

    One order column after the other is pinned to its value at that rank; a later column is looked at only among rows
    that are equal in all earlier ones. Quantiles of a numeric code narrow a column quickly; where codes no longer tell
    values apart (long common heads of strings, a rank between two frequent values) real values of the column split it.
    """
    limit = TAKE_ROWS if take_rows is None else take_rows
    order = list(order_by)
    part = df.select(*order)
    size = part.count() if n is None else n
    for col in order:
        c, code, step = quoted(col), F.coalesce(order_code(df, col), F.lit(_NULL_CODE)), 0
        narrow_by_code, pinned = True, False
        while size > limit and not pinned:
            if narrow_by_code:
                want, eps = (rank + 0.5) / size, 2.0 / _ACCURACY
                ends = F.array(F.lit(max(0.0, want - eps)), F.lit(min(1.0, want + eps)))
                lo, hi = part.agg(F.percentile_approx(code, ends, F.lit(_ACCURACY))).first()[0]
                lo = float("-inf") if want - eps <= 0 else lo
                hi = float("inf") if want + eps >= 1 else hi
                inside = code.between(lo, hi)
                under, within = part.agg(F.count_if(code < lo), F.count_if(inside)).first()
                narrow_by_code = under <= rank < under + within and within < size
                if narrow_by_code:
                    part, rank, size = part.filter(inside), rank - under, within
                continue
            step += 1
            pivot = part.agg(F.min_by(c, F.when(c.isNotNull(), F.xxhash64(c, F.lit(step))))).first()[0]
            if pivot is None:
                break  # only nulls are left: equal in this column
            v = literal(pivot, field_type(df, col))
            under, same = part.agg(F.count_if(c < v), F.count_if(c == v)).first()
            if rank < under:
                part, size = part.filter(c < v), under
            elif rank < under + same:
                part, rank, size, pinned = part.filter(c == v), rank - under, same, True
            else:
                part, rank, size = part.filter((c > v) | c.isNull()), rank - under - same, size - under - same
        if size <= limit:
            return part.orderBy(*ascending(order)).offset(rank).limit(1).first()
    return part.limit(1).first()  # all rows left are equal in every order column


def up_to(df: DataFrame, order_by: Sequence[str], row: Row) -> Column:
    """True for rows of ``df`` at or before ``row`` in the order (nulls last)."""
    test: Column | None = None
    for col in reversed(list(order_by)):
        c = quoted(col)
        if row[col] is None:
            before, same = c.isNotNull(), c.isNull()
        else:
            bound = literal(row[col], field_type(df, col))
            before, same = F.coalesce(c < bound, F.lit(False)), F.coalesce(c == bound, F.lit(False))
        test = (before | same) if test is None else (before | (same & test))
    return test


def hash_rows_at(df: DataFrame, digest: str, order_by: Sequence[str], ranks: Sequence[int], n: int) -> list[Row]:
    """``row_at`` for several ranks of an order that starts with a hex digest.

    Digests are spread evenly, so the rank itself tells where to look: one pass counts the rows below and keeps the few rows
    around all ranks. Should a rank lie elsewhere, or a kept row occur more than once, it is searched in the usual way.
    """
    space, d, spans = 16**_HEX, quoted(digest), []
    for rank in ranks:
        p = (rank + 0.5) / n
        slack = (8.0 * math.sqrt(n * p * (1.0 - p)) + 16.0) / n
        low = format(int(max(0.0, p - slack) * space), f"0{_HEX}x")
        high = "g" if p + slack >= 1.0 else format(int((p + slack) * space), f"0{_HEX}x")
        spans.append((d >= low) & (d < high) if p > slack else d < high)
        spans.append(d < low if p > slack else F.lit(False))
    around = reduce(or_, spans[::2])
    places = [F.coalesce(c, F.lit(False)).alias(f"__at{i}") for i, c in enumerate(spans)]
    kept = df.select(*places, *[F.when(around, quoted(c)).alias(c) for c in order_by])
    kept = materialize(kept.groupBy(*kept.columns).agg(F.count(F.lit(1)).alias("__n")))
    out = []
    for i, rank in enumerate(ranks):
        at, n_at = F.col(f"__at{2 * i}"), F.col("__n")
        sums = (F.sum(F.when(c, n_at)) for c in (at, F.col(f"__at{2 * i + 1}")))
        inside, below, most = kept.agg(*sums, F.max(F.when(at, n_at))).first()
        inside, below = inside or 0, below or 0
        if not below <= rank < below + inside:
            out.append(row_at(df, order_by, rank, n))
        else:
            out.append(row_at(kept.filter(at) if most == 1 else df.filter(spans[2 * i]), order_by, rank - below, inside))
    return out
