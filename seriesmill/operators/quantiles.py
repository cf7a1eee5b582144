"""Exact quantiles of whole columns without holding a column's distinct values in one task."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seriesmill.functions.columns import as_double

SMALL_ROWS = 2_000_000  # up to here one exact `percentile` aggregate is cheap enough
BRACKET_ROWS = 200_000  # values that a final bracket may hold
_ACCURACY = 10_000
_EPS = 2.0 / _ACCURACY


@dataclass
class _Target:
    """A wanted rank of a column and the range of values that holds it."""

    col: int
    prob: float
    rank: int
    lo: float = float("-inf")
    hi: float = float("inf")
    below: int = 0  # rows under the range
    size: int = 0  # rows in it
    value: float | None = None
    stuck: bool = False  # the range does not shrink any more

    def inside(self) -> Column:
        return F.col(f"v{self.col}").between(self.lo, self.hi)


def exact_quantiles(
    df: DataFrame, cols: Sequence[str], probs: Sequence[float], small_rows: int | None = None, where=None
) -> dict[str, dict[float, float | None]]:
    """Linearly interpolated quantiles, nulls and NaN ignored: ``{column: {prob: value}}``.

    Small tables use the exact aggregate. For larger ones mergeable sketches give a narrow range of values for every
    wanted rank of every column, one pass counts all ranges together, and the values that are left are looked at
    in one more. The number of passes does not depend on how many columns and ranks there are: three up to about
    half a billion rows, two more for each further factor of 2,500.
    """
    limit = SMALL_ROWS if small_rows is None else small_rows
    if where is not None:
        df = df.filter(where)
    frame = df.select(*[as_double(df, c).alias(f"v{i}") for i, c in enumerate(cols)])
    every, sure = range(len(cols)), [float(p) for p in probs]
    ends = F.array(*[F.lit(x) for p in sure for x in (max(0.0, p - _EPS), min(1.0, p + _EPS))])
    if limit > 0:  # small tables are told apart without a sketch
        counts = list(frame.agg(*[F.count(f"v{i}") for i in every]).first())
        if max(counts, default=0) <= limit:
            plist = F.array(*[F.lit(p) for p in sure])
            row = frame.agg(*[F.percentile(f"v{i}", plist).alias(f"q{i}") for i in every]).first()
            return {c: dict(zip(probs, row[f"q{i}"] or [None] * len(probs))) for i, c in enumerate(cols)}
    row = frame.agg(*[F.count(f"v{i}") for i in every], *[F.percentile_approx(f"v{i}", ends, F.lit(_ACCURACY)) for i in every]).first()
    counts, brackets = row[: len(cols)], row[len(cols) :]
    targets: dict[tuple[int, int], _Target] = {}
    for i in every:
        for j, p in enumerate(sure):
            place = (counts[i] - 1) * p
            for rank in {int(place), min(int(place) + 1, counts[i] - 1)} if counts[i] else ():
                lo, hi = brackets[i][2 * j : 2 * j + 2]
                lo = float("-inf") if p <= _EPS else lo
                hi = float("inf") if p >= 1.0 - _EPS else hi
                targets.setdefault((i, rank), _Target(i, p, rank, lo, hi, 0, counts[i]))
    _count(frame, list(targets.values()))
    while wide := [t for t in targets.values() if t.value is None and t.size > BRACKET_ROWS and not t.stuck]:
        _narrow(frame, wide)
        _count(frame, wide)
    _pick(frame, [t for t in targets.values() if t.value is None])
    out: dict[str, dict[float, float | None]] = {c: {} for c in cols}
    for i, c in enumerate(cols):
        for p in probs:
            if not counts[i]:
                out[c][p] = None
                continue
            place = (counts[i] - 1) * float(p)
            k = int(place)
            low, high = targets[i, k].value, targets[i, min(k + 1, counts[i] - 1)].value
            out[c][p] = low if k == place else low + (high - low) * (place - k)
    return out


def _narrow(frame: DataFrame, targets: list[_Target]) -> None:
    """Asks sketches of the ranges for smaller ones, in one pass."""
    asked = []
    for t in targets:
        want = (t.rank - t.below + 0.5) / t.size
        ends = F.array(F.lit(max(0.0, want - _EPS)), F.lit(min(1.0, want + _EPS)))
        asked.append(F.percentile_approx(F.when(t.inside(), F.col(f"v{t.col}")), ends, F.lit(_ACCURACY)))
    for t, (lo, hi) in zip(targets, frame.agg(*asked).first()):
        want = (t.rank - t.below + 0.5) / t.size
        t.lo, t.hi = t.lo if want <= 2 * _EPS else lo, t.hi if want >= 1 - 2 * _EPS else hi


def _count(frame: DataFrame, targets: list[_Target]) -> None:
    """Counts all ranges in one pass and puts their ends on real values; a range that missed its rank is widened to the whole column."""
    if not targets:
        return
    asked = []
    for t in targets:
        v, inside = F.col(f"v{t.col}"), t.inside()
        asked.append(F.struct(F.count_if(v < t.lo), F.count_if(inside), F.min(F.when(inside, v)), F.max(F.when(inside, v))))
    for t, (under, size, smallest, largest) in zip(targets, frame.agg(*asked).first()):
        if not under <= t.rank < under + size:
            t.lo, t.hi, t.below, t.stuck = float("-inf"), float("inf"), 0, True
        elif smallest == largest:
            t.value = smallest
        else:
            t.stuck = size == t.size
            t.lo, t.hi, t.below, t.size = smallest, largest, under, size


def _pick(frame: DataFrame, targets: list[_Target]) -> None:
    """Exact ranks in small ranges: equal values are merged before the shuffle, each range is one group of few values."""
    few = [t for t in targets if not t.stuck]
    if few:
        hits = F.array(*[F.when(t.inside(), F.struct(F.lit(i).alias("t"), F.col(f"v{t.col}").alias("v"))) for i, t in enumerate(few)])
        found = frame.select(F.inline(F.filter(hits, lambda x: x.isNotNull()))).groupBy("t", "v").agg(F.count(F.lit(1)).alias("n"))
        found = found.groupBy("t").agg(F.array_sort(F.collect_list(F.struct("v", "n"))).alias("values"))  # BRACKET_ROWS at most
        wanted = F.array(*[F.lit(t.rank - t.below) for t in few])
        start = F.struct(F.lit(0).cast("bigint").alias("upto"), F.lit(None).cast("double").alias("v"))
        step = lambda acc, x: F.struct(
            (acc["upto"] + x["n"]).alias("upto"),
            F.when((acc["upto"] <= F.get(wanted, F.col("t"))) & (F.get(wanted, F.col("t")) < acc["upto"] + x["n"]), x["v"]).otherwise(acc["v"]).alias("v"),
        )
        for r in found.select("t", F.aggregate("values", start, step)["v"].alias("v")).collect():  # one row per range
            few[r["t"]].value = r["v"]
    for t in targets:
        if t.stuck:  # few distinct, frequent values
            part = frame.select(f"v{t.col}").filter(t.inside())
            t.value = _by_value_counts(part, f"v{t.col}", t.rank - t.below)


def _by_value_counts(part: DataFrame, v: str, rank: int) -> float:
    """Exact rank over (value, count) pairs; equal values are merged before anything is shuffled."""
    from seriesmill.operators.ordering import fit_layout

    counts = part.groupBy(v).agg(F.count(F.lit(1)).alias("n"))
    upto = fit_layout(counts, [v]).running_sum(counts, {"upto": "n"})
    return upto.filter(F.col("upto") > rank).agg(F.min(v)).first()[0]


GROUP_ROWS = 1_000_000  # groups up to this size may be held by one aggregate


def grouped_quantiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    probs: Sequence[float],
    names: Sequence[str],
    group_rows: int | None = None,
    sizing=None,
    largest: int | None = None,
) -> DataFrame:
    """(keys, names): exact linear quantiles per group.

    While the largest group is small the built-in aggregate is used. Beyond that equal values are counted
    together, ranks come from running totals over range blocks, and no task ever holds a whole group. ``largest`` is the
    size of the largest group where it is known; else it is counted, which computes ``df`` once more.
    """
    from seriesmill.operators.joins import lookup_join
    from seriesmill.operators.ordering import fit_layout

    keys, probs = list(keys), [float(p) for p in probs]
    limit = GROUP_ROWS if group_rows is None else group_rows
    rows = df.select(*keys, as_double(df, value).alias("__v"))
    if largest is None:
        largest = rows.groupBy(*keys).agg(F.count("__v").alias("n")).agg(F.max("n")).first()[0]
    if (largest or 0) <= limit:
        plist = F.array(*[F.lit(p) for p in probs])
        out = rows.groupBy(*keys).agg(F.percentile("__v", plist).alias("__q"))
        return out.select(*keys, *[F.col("__q")[i].alias(n) for i, n in enumerate(names)])
    counts = rows.filter(F.col("__v").isNotNull()).groupBy(*keys, "__v").agg(F.count(F.lit(1)).alias("__n"))
    totals = counts.groupBy(*keys).agg(F.sum("__n").alias("__all"), F.count(F.lit(1)).alias("__rows"))
    upto = fit_layout(counts, ["__v"], keys, 0, sizing).running_sum(counts, {"__upto": "__n"})
    ranked = lookup_join(upto, totals, keys, "__rows")
    picks = []
    for i, p in enumerate(probs):
        place = (F.col("__all") - 1) * F.lit(p)
        for side, rank in (("lo", F.floor(place)), ("hi", F.ceil(place))):
            here = (F.col("__upto") - F.col("__n") <= rank) & (rank < F.col("__upto"))
            picks.append(F.max(F.when(here, F.col("__v"))).alias(f"__{side}{i}"))
        picks.append((F.max(place) - F.floor(F.max(place))).alias(f"__w{i}"))
    out = ranked.groupBy(*keys).agg(*picks)
    blend = lambda i: F.col(f"__lo{i}") + (F.col(f"__hi{i}") - F.col(f"__lo{i}")) * F.col(f"__w{i}")
    return out.select(*keys, *[blend(i).alias(n) for i, n in enumerate(names)])
