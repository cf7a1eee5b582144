"""Train / validation / test splits and time-series folds, as a ``split`` column or as fold rows.

A random split ranks rows by md5(seed:key), so it depends on nothing but the data and the seed: the same
rows fall into the same part after any repartitioning, on any cluster, in any later run. Where a part is a
prefix of an order (random, chronological) only the boundary rows are looked up; the split itself is a
projection without a shuffle.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seriesmill.functions.columns import as_list, hash_order, quoted
from seriesmill.operators.joins import lookup_join
from seriesmill.operators.ordering import Sizing, fit_layout
from seriesmill.operators.ranks import hash_rows_at, row_at, up_to
from seriesmill.session import materialize

STRATEGIES = ("random", "stratified", "chronological", "group_kfold", "time_series_cv")
MINIMUM_TEST_SAMPLES = 30


@dataclass(frozen=True)
class Fractions:
    train: float = 0.7
    val: float = 0.1
    test: float = 0.2

    def __post_init__(self) -> None:
        for name in ("train", "val", "test"):
            if getattr(self, name) <= 0:
                raise ValueError(f"{name} fraction must be > 0")
        if abs(self.train + self.val + self.test - 1.0) > 1e-9:
            raise ValueError("fractions must sum to 1")

    @property
    def val_of_rest(self) -> float:
        return self.val / (self.train + self.val)


def validate_split(df: DataFrame, strategy: str, target=None, time_col=None, group_col=None, stratify_on=None) -> None:
    """Checks the strategy name and that the columns it needs exist."""
    if strategy not in STRATEGIES:
        raise ValueError(f"invalid strategy {strategy!r}; expected one of {sorted(STRATEGIES)}")
    needed = {"target": target, "stratify_on": stratify_on}
    if strategy in ("chronological", "time_series_cv"):
        if time_col is None:
            raise ValueError(f"strategy {strategy!r} needs time_col")
        needed["time_col"] = time_col
    if strategy == "group_kfold":
        if group_col is None:
            raise ValueError("strategy 'group_kfold' needs group_col")
        needed["group_col"] = group_col
    for what, col in needed.items():
        if col is not None and col not in df.columns:
            raise ValueError(f"{what} {col!r} not found in the table")


def _hashed(df: DataFrame, key: str | Sequence[str], seed: int) -> tuple[DataFrame, list[str]]:
    head, digest = hash_order(key, seed)
    return df.withColumns({"__h": head, "__d": digest}), ["__h", "__d", *as_list(key)]


def _by_cuts(
    df: DataFrame, order: Sequence[str], n: int, cuts: Sequence[tuple[str, int]], rest: str, hashed: bool = False
) -> Column:
    """The part of each row: ``cuts`` are (name, rows) prefixes of the order, what follows is ``rest``."""
    ends, done = [], 0  # (name, rank of the part's last row)
    for name, size in cuts:
        if size > 0 and done < n:
            done = min(n, done + size)
            ends.append((name, done - 1))
    ranks = [rank for _, rank in ends if rank < n - 1]
    if hashed and ranks:
        rows = hash_rows_at(df, order[0], order, ranks, n)
    else:
        rows = [row_at(df, order, rank, n) for rank in ranks]
    out = F
    for (name, _), row in zip(ends, rows):
        out = out.when(up_to(df, order, row), name)
    last = ends[-1][0] if len(ends) > len(rows) else rest
    return F.lit(last) if out is F else out.otherwise(F.lit(last))


def split_random(
    df: DataFrame, key: str | Sequence[str], fractions: Fractions = Fractions(), seed: int = 42, mode: str = "standard"
) -> DataFrame:
    """Test part first, then validation from the rest. ``mode="nested"`` takes ``fractions.val`` of the rest itself."""
    hashed, order = _hashed(df, key, seed)
    order = order[1:]  # the digest orders the rows by itself
    n = df.count()
    n_test = math.ceil(n * fractions.test)
    share = fractions.val if mode == "nested" else fractions.val_of_rest
    n_val = math.ceil((n - n_test) * share)
    part = _by_cuts(hashed, order, n, [("test", n_test), ("val", n_val)], "train", hashed=True)
    return hashed.withColumn("split", part).drop("__h", "__d")


def _quotas(strata: DataFrame, rows: str, want: int, out: str) -> DataFrame:
    """Largest-remainder share of ``want`` rows per stratum (``__c``); a tie goes to the smaller class value.

    The classes that get one row more are those up to a rank in the order of the remainders; its row is searched by
    narrowing ranges, so any number of classes is apportioned without being sorted in one task.
    """
    total = strata.agg(F.sum(rows)).first()[0] or 0
    if not total:
        return strata.withColumn(out, F.lit(0).cast("bigint"))
    # decimals: the product leaves 64 bits from about 1e10 rows
    whole, order = F.lit(total).cast("decimal(19,0)"), ["__less", "__c"]
    exact = F.lit(want).cast("decimal(19,0)") * F.col(rows).cast("decimal(19,0)")
    ranked = strata.withColumn("__less", -F.try_mod(exact, whole))
    ranked = ranked.withColumn("__base", ((exact + F.col("__less")) / whole).cast("bigint"))
    left = want - ranked.agg(F.sum("__base")).first()[0]
    more = up_to(ranked, order, row_at(ranked, order, left - 1)).cast("bigint") if left > 0 else F.lit(0)
    return ranked.withColumn(out, F.col("__base") + more).drop("__less", "__base")


def split_stratified(
    df: DataFrame,
    key: str | Sequence[str],
    by: str,
    fractions: Fractions = Fractions(),
    seed: int = 42,
    sizing: Sizing | None = None,
) -> DataFrame:
    """Each class gives its share of every part; inside a class rows are ranked by hash."""
    hashed, order = _hashed(df, key, seed)
    strata = materialize(df.groupBy(quoted(by).alias("__c")).agg(F.count(F.lit(1)).cast("bigint").alias("__n")))  # one row per class
    n = strata.agg(F.sum("__n")).first()[0] or 0
    n_test = math.ceil(n * fractions.test)
    n_val = math.ceil((n - n_test) * fractions.val_of_rest)
    strata = _quotas(strata, "__n", n_test, "__nt").withColumn("__rest", F.col("__n") - F.col("__nt"))
    strata = _quotas(strata, "__rest", n_val, "__nv").select(F.col("__c"), "__n", "__nt", "__nv")
    placed = fit_layout(hashed, order, [by], 0, sizing).position(hashed, "__p").withColumn("__c", quoted(by))
    out = lookup_join(placed, strata, "__c", "__n")
    part = (
        F.when(F.col("__p") < F.col("__nt"), "test")
        .when(F.col("__p") < F.col("__nt") + F.col("__nv"), "val")
        .otherwise("train")
    )
    return out.select(*[quoted(c) for c in df.columns], part.alias("split"))


def split_chronological(
    df: DataFrame,
    time_col: str,
    tiebreak: str | Sequence[str],
    fractions: Fractions = Fractions(),
    mode: str = "standard",
) -> DataFrame:
    """Oldest rows train, newest rows test.

    ``standard``: floor(n·train), floor(n·val), remainder. ``nested``: test is what follows int(n·(1-test)) and
    validation what follows int((1-val)·that). ``cumulative``: cuts at int(n·train) and int(n·(train+val)).
    """
    order = [time_col, *as_list(tiebreak)]
    n = df.count()
    if mode == "standard":
        n_train, n_val = math.floor(n * fractions.train), math.floor(n * fractions.val)
    elif mode == "nested":
        before_test = int(n * (1 - fractions.test))
        n_train = int(before_test * (1 - fractions.val))
        n_val = before_test - n_train
    elif mode == "cumulative":
        n_train = int(n * fractions.train)
        n_val = int(n * (fractions.train + fractions.val)) - n_train
    else:
        raise ValueError("mode must be 'standard', 'nested' or 'cumulative'")
    return df.withColumn("split", _by_cuts(df, order, n, [("train", n_train), ("val", n_val)], "test"))


def split_group(df: DataFrame, group: str, fractions: Fractions = Fractions(), seed: int = 42) -> DataFrame:
    """A fraction of the groups, not of the rows; no group is in two parts."""
    groups = df.groupBy(quoted(group).alias("__g")).agg(F.count(F.lit(1)).alias("__n"))
    head, digest = hash_order("__g", seed)
    groups = groups.withColumns({"__h": head, "__d": digest})
    n = groups.count()
    n_test = math.ceil(n * fractions.test)
    n_val = math.ceil((n - n_test) * fractions.val_of_rest)
    part = _by_cuts(groups, ["__d", "__g"], n, [("test", n_test), ("val", n_val)], "train", hashed=True)
    table = groups.select("__g", "__n", part.alias("split"))
    return lookup_join(df.withColumn("__g", quoted(group)), table, "__g", "__n").drop("__g")


# ---------------------------------------------------------------- folds


@dataclass(frozen=True)
class Folds:
    """Geometry of time-series folds: positions, not rows."""

    method: str
    n: int
    n_pre: int
    initial: int
    val: int
    step: int
    gap: int
    n_folds: int

    def bounds(self, k: int) -> tuple[int, int, int, int]:
        start = k * self.step if self.method == "rolling" else 0
        end = k * self.step + self.initial
        return start, end, end + self.gap, end + self.gap + self.val


def plan_folds(
    n: int,
    method: str,
    fractions: Fractions = Fractions(),
    n_folds: int | None = None,
    initial: int | None = None,
    val: int | None = None,
    step: int | None = None,
    gap: int = 0,
) -> Folds:
    """Fold positions over ``n`` ordered rows; the last floor(n·test) rows are a frozen test set."""
    if method not in ("rolling", "expanding"):
        raise ValueError("method must be 'rolling' or 'expanding'")
    n_test = math.floor(n * fractions.test)
    if n_test < 1:
        raise ValueError(f"test fraction {fractions.test} leaves no test rows for n={n}")
    n_pre = n - n_test
    initial = max(1, math.floor(n_pre * fractions.train)) if initial is None else initial
    val = max(1, math.floor(n_pre * fractions.val)) if val is None else val
    step = val if step is None else step
    if step < 1:
        raise ValueError("step must be positive")
    room = n_pre - (initial + gap + val)
    possible = room // step + 1 if room >= 0 else 0
    if n_folds is not None:
        if n_folds <= 0:
            raise ValueError("n_folds must be positive")
        if possible < n_folds:
            raise ValueError(f"cannot produce {n_folds} folds, only {possible} are possible")
        possible = n_folds
    return Folds(method, n, n_pre, initial, val, step, gap, possible)


def time_series_cv(
    df: DataFrame,
    method: str,
    time_col: str,
    tiebreak: str | Sequence[str],
    fractions: Fractions = Fractions(),
    sizing: Sizing | None = None,
    **options,
) -> DataFrame:
    """One row per (fold_id, role, row): ``train`` and ``val`` rows of every fold, ``test`` rows with a null fold.

    The folds of a row follow from its position by arithmetic, so there is no range join.
    """
    layout = fit_layout(df, [time_col, *as_list(tiebreak)], None, 0, sizing)
    f = plan_folds(df.count(), method, fractions, **options)
    placed = layout.position(df, "__p")
    p, last = F.col("__p"), F.lit(f.n_folds - 1)
    first_train = F.greatest(F.lit(0), F.floor((p - f.initial) / f.step) + 1)
    last_train = F.least(last, F.floor(p / f.step)) if method == "rolling" else last
    at = p - f.initial - f.gap
    first_val = F.greatest(F.lit(0), F.floor((at - f.val) / f.step) + 1)
    last_val = F.least(last, F.floor(at / f.step))

    def ids(low: Column, high: Column, role: str) -> Column:
        some = F.when(low <= high, F.sequence(low.cast("int"), high.cast("int")))
        return F.transform(some, lambda k: F.struct(k.alias("fold_id"), F.lit(role).alias("role")))

    none = F.array().cast("array<struct<fold_id:int,role:string>>")
    pre = F.concat(F.coalesce(ids(first_train, last_train, "train"), none), F.coalesce(ids(first_val, last_val, "val"), none))
    test = F.array(F.struct(F.lit(None).cast("int").alias("fold_id"), F.lit("test").alias("role")))
    member = F.when(p >= f.n_pre, test).otherwise(pre)
    return placed.select(*[quoted(c) for c in df.columns], F.inline(member))


def last_fold(folds: DataFrame) -> DataFrame:
    """Train and validation rows of the last fold, with the test rows, as a ``split`` column."""
    top = folds.agg(F.max("fold_id")).first()[0]
    picked = folds.filter(F.col("fold_id").eqNullSafe(F.lit(top)) | (F.col("role") == "test"))
    return picked.withColumnRenamed("role", "split").drop("fold_id")


# ---------------------------------------------------------------- summary and guards


def split_info(df: DataFrame, minimum_test: int | None = None) -> DataFrame:
    """(split, n); raises when the test part is smaller than ``minimum_test``."""
    counts = df.groupBy("split").agg(F.count(F.lit(1)).alias("n"))
    if minimum_test is not None:
        n_test = df.filter("split = 'test'").limit(minimum_test).count()
        if n_test < minimum_test:
            raise ValueError(f"INSUFFICIENT_TEST_SAMPLES: {n_test} test rows, at least {minimum_test} are needed")
    return counts


def split_signature(df: DataFrame, key: str | Sequence[str]) -> DataFrame:
    """(split, n, key_sum): equal for two splits exactly when (up to hash accidents) they hold the same rows."""
    digest = F.md5(F.concat_ws(":", *[quoted(k).cast("string") for k in as_list(key)]))
    number = F.conv(F.substring(digest, 1, 8), 16, 10).cast("decimal(38,0)")
    return df.groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.sum(number).alias("key_sum"))


def assert_same_split(a: DataFrame, b: DataFrame, key: str | Sequence[str], features: Sequence[str] = (), target=None) -> None:
    """Raises when two splits differ, or when the target is among the features."""
    if target is not None and target in features:
        raise ValueError(f"TARGET_LEAK: {target!r} is among the feature columns")
    left = {r["split"]: (r["n"], r["key_sum"]) for r in split_signature(a, key).collect()}  # three rows
    right = {r["split"]: (r["n"], r["key_sum"]) for r in split_signature(b, key).collect()}
    if left != right:
        raise ValueError(f"SPLIT_MISMATCH: {left} against {right}")


def split(df: DataFrame, strategy: str, key, fractions: Fractions = Fractions(), seed: int = 42, **options) -> DataFrame:
    """Dispatch by strategy name."""
    named = {k: options.get(k) for k in ("target", "time_col", "group_col", "stratify_on")}
    validate_split(df, strategy, **named)
    if strategy == "random":
        return split_random(df, key, fractions, seed)
    if strategy == "stratified":
        return split_stratified(df, key, named["stratify_on"] or named["target"], fractions, seed)
    if strategy == "chronological":
        return split_chronological(df, named["time_col"], key, fractions)
    if strategy == "group_kfold":
        return split_group(df, named["group_col"], fractions, seed)
    extra = {k: v for k, v in options.items() if k not in named and k != "method"}
    return time_series_cv(df, options.get("method", "rolling"), named["time_col"], key, fractions, **extra)
