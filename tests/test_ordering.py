"""Blocks, halos, positions and running sums against plain windows, with hot keys, ties and nulls."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from seriesmill.operators.ordering import Sizing, fit_layout
from seriesmill.operators.quantiles import exact_quantiles, grouped_quantiles
from seriesmill.operators.ranks import row_at

SMALL = Sizing(target_rows=60, min_rows=10, hot_rows=40)


@pytest.fixture(scope="module")
def frames(spark, sf_dir):
    ev = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "ts", "user_id", "event_type", "value")
    hot = ev.withColumns(
        {
            "ts": F.when(F.col("event_id") % 3 == 0, F.lit("2024-01-10").cast("timestamp_ntz")).otherwise(F.col("ts")),
            "user_id": F.when(F.col("event_id") % 2 == 0, F.lit(None)).otherwise(F.col("user_id")),
        }
    )
    holes = ev.withColumn("ts", F.when(F.col("event_id") % 3 > 0, F.col("ts")))
    return {
        "plain": (ev, ["ts", "event_id"], None),
        "hot time": (hot, ["ts", "event_id"], None),
        "hot series": (hot, ["ts", "event_id"], ["user_id"]),
        "null times": (holes, ["ts", "event_id"], None),
        "text first": (ev, ["event_type", "event_id"], None),
        "constant first": (ev.withColumn("k", F.lit(1)), ["k", "event_type", "event_id"], None),
    }


def rows(df, cols):
    return sorted(
        tuple(repr(round(v, 6)) if isinstance(v, float) else repr(v) for v in r) for r in df.select(*cols).collect()
    )


@pytest.mark.parametrize("name", ["plain", "hot time", "hot series", "null times", "text first", "constant first"])
def test_blocks_equal_plain_windows(frames, name):
    df, order, series = frames[name]
    layout = fit_layout(df, order, series, 24, SMALL)
    assert layout.cut and layout.n_blocks > 3
    w = Window.partitionBy(*(series or [F.lit(1)])).orderBy(*[F.col(c).asc_nulls_last() for c in order])
    want = df.select(
        "*",
        F.lag("value", 24).over(w).alias("l"),
        F.avg("value").over(w.rowsBetween(-23, 0)).alias("m"),
        F.lead("value", 2).over(w).alias("n"),
        (F.row_number().over(w) - 1).cast("bigint").alias("pos"),
        F.sum("value").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("run"),
    )
    made = {
        "l": lambda w: F.lag("value", 24).over(w),
        "m": lambda w: F.avg("value").over(w.rowsBetween(-23, 0)),
        "n": lambda w: F.lead("value", 2).over(w),
    }
    assert rows(layout.windowed(df, made, 24, 2), ["event_id", *made]) == rows(want, ["event_id", *made])
    assert rows(layout.position(df), ["event_id", "pos"]) == rows(want, ["event_id", "pos"])
    assert rows(layout.running_sum(df, {"run": "value"}), ["event_id", "run"]) == rows(want, ["event_id", "run"])
    top = want.filter("pos < 7")
    assert rows(layout.first_rows(df, 7), ["event_id"]) == rows(top, ["event_id"])
    skipped = layout.windowed(df, {"l": made["l"]}, 24, 0, skip_first=24)
    assert rows(skipped, ["event_id", "l"]) == rows(want.filter("pos >= 24"), ["event_id", "l"])


def test_last_rows(frames):
    df, order, series = frames["hot series"]
    w = Window.partitionBy("user_id").orderBy(*[F.col(c).desc_nulls_first() for c in order])
    want = df.withColumn("r", F.row_number().over(w)).filter("r <= 9")
    got = fit_layout(df, order, series, 0, SMALL).last_rows(df, 9)
    assert rows(got, ["event_id"]) == rows(want, ["event_id"])


def test_no_window_without_partitioning_over_data(frames):
    df, order, _ = frames["plain"]
    layout = fit_layout(df, order, None, 1, SMALL)
    out = layout.windowed(df, {"l": lambda w: F.lag("value").over(w)}, 1)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan


def test_result_does_not_depend_on_partitioning(frames):
    df, order, _ = frames["hot time"]
    a = fit_layout(df, order, None, 0, SMALL).position(df)
    b = df.repartition(5, "value")
    b = fit_layout(b, order, None, 0, SMALL).position(b)
    assert rows(a, ["event_id", "pos"]) == rows(b, ["event_id", "pos"])


@pytest.mark.parametrize("values", ["id", "id % 7", "CASE WHEN id % 3 = 0 THEN 5 ELSE id END", "0"])
def test_quantiles_of_large_tables_are_exact(spark, values, monkeypatch):
    monkeypatch.setattr("seriesmill.operators.quantiles.BRACKET_ROWS", 50)
    df = spark.range(3000).selectExpr(f"CAST({values} AS DOUBLE) AS v")
    got = exact_quantiles(df, ["v"], [0.0, 0.25, 0.5, 0.99, 1.0], small_rows=10)["v"]
    want = df.agg(F.percentile("v", F.array(*[F.lit(p) for p in got]))).first()[0]
    assert list(got.values()) == pytest.approx(want)


@pytest.mark.parametrize("rank", [0, 1, 333, 500, 999])
def test_row_at_rank(frames, rank):
    df, order, _ = frames["hot time"]
    want = df.orderBy(*order).select(*order).collect()[rank]
    assert row_at(df, order, rank, take_rows=20) == want


def test_grouped_quantiles_of_large_groups(spark):
    df = spark.range(1500).selectExpr("IF(id % 3 = 0, NULL, id % 7) AS g", "CAST(id * 37 % 101 AS DOUBLE) AS v")
    args = (["g"], "v", [0.1, 0.5, 0.75, 1.0], ["a", "b", "c", "d"])
    small = grouped_quantiles(df, *args)
    large = grouped_quantiles(df, *args, group_rows=0, sizing=Sizing(20, 5, 30))
    assert rows(small, small.columns) == rows(large, small.columns)
