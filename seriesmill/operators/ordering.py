"""Row order on a cluster: range blocks, global positions, halo windows, running sums.

A window without ``partitionBy`` puts the whole table into one task, and a window partitioned by a
series key puts a series that holds a third of all rows into one task. Both are avoided here in the
same way. The sort order is cut into *blocks* of similar size:

* quantiles of a numeric code of the first order column give the cut points (one aggregation);
* a value which repeats in the quantiles is hot, and its rows are cut again by the next order column; strings that
  only begin alike are first cut again by the bytes after what they have in common, group by group;
* block sizes are counted once (one row per block reaches the driver), giving every block's offset.

Windows are then partitioned by (series, block). Rows just before a block are copied into it
(the halo) so that lags and rolling frames see their neighbours, and are dropped afterwards.
Series that are small enough for one task keep a single block and pay for none of this.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seriesmill.functions.columns import (
    ascending, as_list, common_head, descending, field_type, is_string, order_code, quoted, text_code,
)
from seriesmill.session import parallelism

BLK = "__blk"
HALO = "__halo"
_MAX_BLOCKS = 8192  # upper bound of cut points per level: what the driver and a broadcast may hold
_LEVEL_BASE = 16384  # more than _MAX_BLOCKS + 2, so that level codes do not overlap
_MAX_LEVELS = 3
_MAX_TEXT_LEVELS = 4  # without a series key
_NULL_CODE = 1.7e308  # nulls sort last


@dataclass(frozen=True)
class Sizing:
    """How large a block may get and from which size a series is cut at all."""

    target_rows: int = 1_000_000  # aimed rows per block
    min_rows: int = 1_024  # do not cut finer than this only for the sake of parallelism
    hot_rows: int = 2_000_000  # series with more rows are cut into blocks


DEFAULT_SIZING = Sizing()


@dataclass
class _Level:
    key: str
    splits: list[float]
    hot: list[tuple[float, float, float, int]] = field(default_factory=list)  # (code, min next, max next, common head)
    after: str | None = None  # the column of the next level


def _buckets(df: DataFrame, code: str, out: str, splits: list[float]) -> DataFrame:
    bounds = [float("-inf"), *splits, float("inf")]
    return Bucketizer(splits=bounds, inputCol=code, outputCol=out, handleInvalid="keep").transform(df)


def _spread(idx: Column, value: Column, low: Column, high: Column) -> Column:
    """``idx`` plus the place of ``value`` between ``low`` and ``high``: groups one after the other on one axis."""
    width = high - low
    place = F.when(width > 0, (value - low) / width * 0.999).otherwise(F.lit(0.0))
    return idx + F.when(value.isNull(), F.lit(0.9995)).otherwise(place)


def _quantiles(df: DataFrame, code: str, blocks: int) -> list[float]:
    probs = F.array(*[F.lit(i / blocks) for i in range(1, blocks)])
    row = df.agg(F.percentile_approx(F.col(code), probs, F.lit(max(10_000, 4 * blocks))).alias("q")).first()
    return [float(v) for v in (row["q"] or [])]


class Layout:
    """Blocks of one sort order; fitted once, bound to any frame that has the key columns."""

    def __init__(self, spark, series, order, reach, levels, series_hot, block_rows, head=0):
        self._head: int = head  # bytes that all values of a first text column share
        self.spark = spark
        self.series: list[str] = series
        self.order: list[str] = order
        self.reach: int = reach
        self._levels: list[_Level] = levels
        self._series_hot: list[tuple] | None = series_hot
        self._blocks: DataFrame | None = None
        self.n_blocks = 0
        if block_rows is not None:
            self.n_blocks = len(block_rows)
            schema = "__code bigint, __blk bigint, __offset bigint, __after bigint, __prev bigint, __next bigint"
            self._blocks = spark.createDataFrame(block_rows, schema)

    @property
    def cut(self) -> bool:
        """Whether any series spans more than one block."""
        return self._blocks is not None

    def _first_code(self, df: DataFrame, how: str) -> DataFrame:
        """Adds ``__v0``, the level-0 code: the first order column, or (hot series, first order column)."""
        if not self.series:
            return df.withColumn("__v0", F.coalesce(order_code(df, self.order[0], self._head), F.lit(_NULL_CODE)))
        fields = [T.StructField(f"__s{i}", df.schema[s].dataType) for i, s in enumerate(self.series)]
        schema = T.StructType(fields + [T.StructField(n, T.DoubleType()) for n in ("__idx", "__lo", "__hi")])
        hot = self.spark.createDataFrame(self._series_hot, schema)
        same = None
        for i, s in enumerate(self.series):
            test = quoted(s).eqNullSafe(F.col(f"__s{i}"))
            same = test if same is None else same & test
        # size bound: at most _MAX_BLOCKS / 2 hot series (see fit_layout)
        out = df.join(F.broadcast(hot), same, how).drop(*[f"__s{i}" for i in range(len(self.series))])
        first = _spread(F.col("__idx"), order_code(df, self.order[0]), F.col("__lo"), F.col("__hi"))
        return out.withColumn("__v0", F.when(F.col("__idx").isNotNull(), first))

    def _coded(self, df: DataFrame) -> DataFrame:
        """Adds ``__code``, the position of the row's range in the sort order (null for uncut series)."""
        out = self._first_code(df, "left")
        live = F.col("__idx").isNotNull() if self.series else F.lit(True)
        code = F.col("__idx").cast("bigint") if self.series else F.lit(0).cast("bigint")
        for depth, level in enumerate(self._levels):
            value = f"__v{depth}"
            out = out.withColumn(value, F.coalesce(F.col(value), F.lit(float("nan"))))
            out = _buckets(out, value, f"__b{depth}", level.splits)
            step = F.when(live, F.col(f"__b{depth}").cast("bigint")).otherwise(F.lit(_LEVEL_BASE - 1))
            code = code * _LEVEL_BASE + step
            if depth + 1 < len(self._levels):
                rows = [(v, float(i), lo, hi, head) for i, (v, lo, hi, head) in enumerate(level.hot)]
                names = f"__h{depth} double, __i{depth} double, __lo{depth} double, __hi{depth} double, __head{depth} int"
                hot = self.spark.createDataFrame(rows, names)
                out = out.join(F.broadcast(hot), F.col(value) == F.col(f"__h{depth}"), "left")
                live = F.col(f"__h{depth}").isNotNull()
                spread = _spread(
                    F.col(f"__i{depth}"),
                    order_code(df, level.after, F.col(f"__head{depth}")),
                    F.col(f"__lo{depth}"),
                    F.col(f"__hi{depth}"),
                )
                out = out.withColumn(f"__v{depth + 1}", F.when(live, spread))
        if self.series:
            code = F.when(F.col("__idx").isNotNull(), code)
        return out.select(*df.columns, code.alias("__code"))

    def bind(self, df: DataFrame) -> DataFrame:
        """Adds the block id (and the block's offset and neighbours when the order is cut)."""
        if not self.cut:
            return df.withColumn(BLK, F.lit(0).cast("bigint"))
        # size bound: at most two blocks per cut point, _MAX_BLOCKS cut points per level
        out = self._coded(df).join(F.broadcast(self._blocks), "__code", "left").drop("__code")
        return out.withColumn(BLK, F.coalesce(F.col(BLK), F.lit(0).cast("bigint")))

    def window(self) -> WindowSpec:
        """Rows of one block in order; valid inside ``with_halo`` / ``bind`` frames."""
        return Window.partitionBy(*[quoted(s) for s in self.series], BLK).orderBy(*ascending(self.order))

    def reverse_window(self) -> WindowSpec:
        return Window.partitionBy(*[quoted(s) for s in self.series], BLK).orderBy(*descending(self.order))

    def with_halo(self, df: DataFrame, before: int, after: int = 0) -> DataFrame:
        """``df`` with block ids and, for every cut block, copies of the neighbouring rows marked in ``__halo``."""
        if max(before, after) > self.reach:
            raise ValueError("the layout was fitted for a shorter reach")
        bound = self.bind(df)
        parts = [bound.select(*df.columns, BLK, F.lit(False).alias(HALO))]
        if self.cut and before > 0:
            near = bound.filter(F.col("__next").isNotNull())
            near = near.withColumn("__rn", F.row_number().over(self.reverse_window())).filter(F.col("__rn") <= before)
            parts.append(near.select(*df.columns, F.col("__next").alias(BLK), F.lit(True).alias(HALO)))
        if self.cut and after > 0:
            near = bound.filter(F.col("__prev").isNotNull())
            near = near.withColumn("__rn", F.row_number().over(self.window())).filter(F.col("__rn") <= after)
            parts.append(near.select(*df.columns, F.col("__prev").alias(BLK), F.lit(True).alias(HALO)))
        out = parts[0]
        for part in parts[1:]:
            out = out.unionByName(part)
        return out

    def windowed(
        self,
        df: DataFrame,
        columns: dict[str, Callable[[WindowSpec], Column]],
        before: int,
        after: int = 0,
        skip_first: int = 0,
        drop: Sequence[str] = (),
    ) -> DataFrame:
        """Adds (or replaces) window columns; each value is a function of the ordered window.

        ``skip_first`` drops the first rows of every series (of the table when there is no series key).
        All columns share one shuffle and one sort.
        """
        need = max(before, skip_first)
        src = self.with_halo(df, need, after)
        w = self.window()
        keep = [c for c in df.columns if c not in columns and c not in drop]
        made = [fn(w).alias(name) for name, fn in columns.items()]
        rank = [F.row_number().over(w).alias("__rn")] if skip_first else []
        by_name = {name: col for name, col in zip(columns, made)}
        shown = [by_name.pop(c) if c in by_name else quoted(c) for c in df.columns if c in columns or c in keep]
        out = src.select(*shown, *by_name.values(), *rank, HALO).filter(~F.col(HALO))
        if skip_first:
            # a block which is not the first of its series starts with at least skip_first halo rows
            out = out.filter(F.col("__rn") > skip_first)
        return out.drop(HALO, "__rn")

    def position(self, df: DataFrame, out: str = "pos") -> DataFrame:
        """Adds the 0-based position of the row in its series (in the table when there is no series key)."""
        bound = self.bind(df)
        rank = (F.row_number().over(self.window()) - 1).cast("bigint")
        if self.cut:
            rank = rank + F.coalesce(F.col("__offset"), F.lit(0))
        return bound.select(*df.columns, rank.alias(out))

    def first_rows(self, df: DataFrame, n: int, rank: str | None = None) -> DataFrame:
        """The first ``n`` rows of every series; blocks that lie wholly behind them are not even shuffled."""
        return self._end_rows(df, n, "__offset", self.window(), rank)

    def last_rows(self, df: DataFrame, n: int, rank: str | None = None) -> DataFrame:
        """The last ``n`` rows of every series; ``rank`` counts from the end."""
        return self._end_rows(df, n, "__after", self.reverse_window(), rank)

    def _end_rows(self, df: DataFrame, n: int, skipped: str, w: WindowSpec, rank: str | None) -> DataFrame:
        bound = self.bind(df)
        passed = F.coalesce(F.col(skipped), F.lit(0)) if self.cut else F.lit(0)
        near = bound.filter(passed < n).withColumn("__rn", F.row_number().over(w))
        # a limit on the row number alone lets Spark drop rows before the shuffle
        near = near.filter(F.col("__rn") <= n).filter(F.col("__rn") + passed <= n)
        extra = [(F.col("__rn") - 1 + passed).cast("int").alias(rank)] if rank else []
        return near.select(*df.columns, *extra)

    def running_sum(self, df: DataFrame, sums: dict[str, str], inclusive: bool = True) -> DataFrame:
        """Adds running totals ``{new column: source column}`` along the order, per series."""
        bound = self.bind(df)
        last = 0 if inclusive else -1
        w = self.window().rowsBetween(Window.unboundedPreceding, last)
        inside = {o: F.coalesce(F.sum(quoted(c)).over(w), F.lit(0)) for o, c in sums.items()}
        if not self.cut:
            return bound.select(*df.columns, *[e.alias(o) for o, e in inside.items()])
        keys = [*self.series, BLK]
        totals = bound.groupBy(*keys).agg(*[F.sum(quoted(c)).alias(f"__t_{o}") for o, c in sums.items()])
        # one row per block: the blocks of all cut series together are bounded by the layout
        totals = totals.filter(F.col(BLK) > 0)
        back = Window.orderBy(BLK) if not self.series else Window.partitionBy(*self.series).orderBy(BLK)
        back = back.rowsBetween(Window.unboundedPreceding, -1)
        carry = totals.select(
            F.col(BLK).alias("__cb"), *[F.sum(f"__t_{o}").over(back).alias(f"__c_{o}") for o in sums]
        )
        out = bound.join(F.broadcast(carry), F.col(BLK) == F.col("__cb"), "left")
        return out.select(
            *df.columns, *[(e + F.coalesce(F.col(f"__c_{o}"), F.lit(0))).alias(o) for o, e in inside.items()]
        )


def _level_plan(df: DataFrame, order: list[str], value: str, blocks: int, most: int = _MAX_LEVELS) -> list[_Level]:
    """Cut points per level for the rows of ``df``, whose level-0 code is in ``value``."""
    levels: list[_Level] = []
    frame, code, at = df, value, 0
    while True:
        key, depth = order[at], len(levels)
        quants = _quantiles(frame, code, blocks)
        splits = sorted(set(quants))
        level = _Level(key, splits)
        levels.append(level)
        repeated = sorted({a for a, b in zip(quants, quants[1:]) if a == b})
        if not repeated or depth + 1 >= most:
            break
        text = is_string(field_type(df, key))
        ends = frame.filter(F.col(code).isin(repeated)).groupBy(F.col(code).alias("__h")).agg(F.min(quoted(key)).alias("a"), F.max(quoted(key)).alias("b"))
        found = {r["__h"]: (r["a"], r["b"]) for r in ends.collect()}  # at most one row per repeated cut point
        longer = {h: common_head(a, b) for h, (a, b) in found.items() if text and a is not None and a != b}
        if longer:  # the same column again; groups of one value get one code and are cut by the next column after that
            for h, (a, b) in sorted(found.items()):
                n = longer.get(h, 0)
                level.hot.append((h, *(0.0 if v is None else text_code(v, n) for v in (a, b)), n))
        elif at + 1 < len(order):
            at += 1
            nxt = order_code(df, order[at])
            pure = [h for h, (a, b) in found.items() if a == b]
            spans = frame.filter(F.col(code).isin(pure)).groupBy(F.col(code).alias("__h")).agg(F.min(nxt).alias("lo"), F.max(nxt).alias("hi"))
            level.hot.extend((r["__h"], r["lo"], r["hi"], 0) for r in spans.filter("lo IS NOT NULL").orderBy("__h").collect())
        if not level.hot:
            break
        level.after = order[at]
        table = frame.sparkSession.createDataFrame(
            [(v, float(i), lo, hi, head) for i, (v, lo, hi, head) in enumerate(level.hot)],
            "__h double, __i double, __l double, __u double, __head int",
        )
        frame = frame.join(F.broadcast(table), F.col(code) == F.col("__h"))
        code = f"__v{depth + 1}"
        frame = frame.withColumn(code, _spread(F.col("__i"), order_code(df, level.after, F.col("__head")), F.col("__l"), F.col("__u")))
        frame = frame.drop("__h", "__i", "__l", "__u", "__head")
    return levels


def _block_rows(counts: list[tuple[int, int, int]], reach: int) -> list[tuple]:
    """Merges neighbouring ranges until each holds ``reach`` rows; returns the rows of the block table."""
    by_series: dict[int, list[tuple[int, int]]] = {}
    for series, code, n in counts:
        by_series.setdefault(series, []).append((code, n))
    rows, block = [], 0
    for series in sorted(by_series):
        groups: list[list] = []  # [codes, rows]
        for code, n in sorted(by_series[series]):
            if groups and groups[-1][1] < max(1, reach):
                groups[-1][0].append(code)
                groups[-1][1] += n
            else:
                groups.append([[code], n])
        if len(groups) > 1 and groups[-1][1] < max(1, reach):
            codes, n = groups.pop()
            groups[-1][0].extend(codes)
            groups[-1][1] += n
        offset, total = 0, sum(n for _, n in groups)
        first, last = block + 1, block + len(groups)
        for codes, n in groups:
            block += 1
            prev = block - 1 if block > first else None
            nxt = block + 1 if block < last else None
            rows.extend((code, block, offset, total - offset - n, prev, nxt) for code in codes)
            offset += n
    return rows


def fit_layout(
    df: DataFrame,
    order_by: str | Sequence[str],
    partition_by: str | Sequence[str] | None = None,
    reach: int = 0,
    sizing: Sizing | None = None,
) -> Layout:
    """Cuts the order of ``df`` into blocks in which a lag or frame of up to ``reach`` rows is local.

    ``order_by`` must end in a column that makes the order unique; nulls sort last.
    """
    sizing = sizing or DEFAULT_SIZING
    series, order = as_list(partition_by), as_list(order_by)
    spark = df.sparkSession
    keys = df.select(*dict.fromkeys([*series, *order]))
    if series:
        code = order_code(df, order[0])
        per_series = keys.groupBy(*series).agg(
            F.count(F.lit(1)).alias("__n"), F.min(code).alias("__lo"), F.max(code).alias("__hi")
        )
        total, largest = per_series.agg(F.sum("__n"), F.max("__n")).first()
        limit = max(sizing.hot_rows, 2 * (total or 0) // _MAX_BLOCKS)
        if not total or largest <= limit:
            return Layout(spark, series, order, reach, [], None, None)
        hot = per_series.filter(F.col("__n") > limit).collect()  # fewer than _MAX_BLOCKS / 2 rows
        hot.sort(key=lambda r: tuple(str(r[s]) for s in series))
        series_hot = [(*[r[s] for s in series], float(i), r["__lo"], r["__hi"]) for i, r in enumerate(hot)]
        rows = sum(r["__n"] for r in hot)
    else:
        series_hot = None
        rows = keys.count()
    blocks = max(rows // sizing.target_rows + 1, min(parallelism(spark), rows // sizing.min_rows))
    blocks = min(blocks, _MAX_BLOCKS)
    if blocks < 2:
        return Layout(spark, series, order, reach, [], None, None)
    head, most = 0, _MAX_LEVELS
    if not series and is_string(field_type(df, order[0])):
        low, high = keys.agg(F.min(quoted(order[0])), F.max(quoted(order[0]))).first()
        head, most = (common_head(low, high) if low is not None else 0), _MAX_TEXT_LEVELS
    draft = Layout(spark, series, order, reach, [], series_hot, None, head)
    draft._levels = levels = _level_plan(draft._first_code(keys, "inner"), order, "__v0", blocks, most)
    base = _LEVEL_BASE ** len(levels)
    counts = (
        draft._coded(keys).filter(F.col("__code").isNotNull()).groupBy("__code").count().collect()
    )  # one row per range
    table = [(int(r["__code"]) // base if series else 0, int(r["__code"]), int(r["count"])) for r in counts]
    return Layout(spark, series, order, reach, levels, series_hot, _block_rows(table, reach), head)


def with_position(df, order_by, partition_by=None, out="pos", sizing=None) -> DataFrame:
    """Adds the 0-based position of every row in the given order."""
    return fit_layout(df, order_by, partition_by, sizing=sizing).position(df, out)
