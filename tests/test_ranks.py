"""row_at against a plain sort at limits that force every way of narrowing, and the two large cases at the default limit."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from seriesmill.functions.columns import ascending
from seriesmill.operators.ranks import TAKE_ROWS, row_at


@pytest.mark.parametrize("limit", [1, 3, 1000])
def test_every_rank(spark, limit):
    base = spark.range(24).select(
        (F.col("id") % 3).alias("tied"), F.when(F.col("id") % 4 > 0, F.concat(F.lit("common-head-"), F.col("id") % 5)).alias("text"),
        F.when(F.col("id") % 5 > 0, F.col("id") / 2).alias("num"), F.col("id"),
    ).cache()
    for order in (["tied", "id"], ["text", "id"], ["num", "text", "id"]):
        rows = base.orderBy(*ascending(order)).select(*order).collect()
        for rank in range(0, len(rows), 5 if limit == 1 else 4):
            assert row_at(base, order, rank, take_rows=limit) == rows[rank]
    assert row_at(base, ["tied"], 10, take_rows=2)["tied"] == 1  # rows that are equal in all order columns


def test_cut_between_two_frequent_days(spark):
    day = F.date_add(F.lit(dt.date(2024, 1, 1)), (F.col("id") / 100_000).cast("int"))
    df = spark.range(600_000).select(day.alias("day"), (F.col("id") % 100_000).alias("k"))
    assert TAKE_ROWS < 600_000
    assert tuple(row_at(df, ["day", "k"], 299_999)) == (dt.date(2024, 1, 3), 99_999)
    assert tuple(row_at(df, ["day", "k"], 300_000)) == (dt.date(2024, 1, 4), 0)


def test_strings_with_a_common_head(spark):
    df = spark.range(500_000).select(F.format_string("series-%08d", F.col("id")).alias("s"))
    assert row_at(df, ["s"], 349_999)["s"] == "series-00349999"


def test_ranks_of_digests_come_from_few_rows(spark, monkeypatch):
    from seriesmill.operators import ranks

    seen, own = [], ranks.row_at
    monkeypatch.setattr(ranks, "row_at", lambda df, *a: seen.append(df.count()) or own(df, *a))
    one = spark.range(20_000).select(F.md5(F.col("id").cast("string")).alias("d"), "id")
    for df, most in ((one, 3000), (one.union(one), 6000)):  # twice: rows that are equal in the whole order
        rows, n = df.orderBy("d", "id").collect(), df.count()
        seen.clear()
        for wanted in ([0, n - 2], [n // 5, n // 5 + 7], [n // 3]):
            assert ranks.hash_rows_at(df, "d", ["d", "id"], wanted, n) == [rows[i] for i in wanted]
        assert max(seen) < most
    few = one.limit(30)
    rows = few.orderBy("d", "id").collect()
    assert ranks.hash_rows_at(few, "d", ["d", "id"], [3, 20], 30) == [rows[3], rows[20]]


def test_the_table_is_read_once_for_all_ranks(spark):
    from seriesmill.operators import ranks

    read = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def digest(i):
        read.add(1)
        return __import__("hashlib").md5(str(i).encode()).hexdigest()

    df = spark.range(5000).select(digest.asNondeterministic()("id").alias("d"), "id")
    ranks.hash_rows_at(df, "d", ["d", "id"], [1000, 2000], 5000)
    assert read.value == 5000
