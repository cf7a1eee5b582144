"""Joins of a large table with a table that has one row per key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seriesmill.functions.columns import as_list, literal, quoted

BROADCAST_ROWS = 500_000  # narrow lookup tables up to this many rows are broadcast
HOT_SHARE = 1_000  # a key with more than 1/HOT_SHARE of the rows is salted
BROADCAST_BYTES = 64 << 20  # and up to this many bytes of text or binary values


def lookup_join(
    df: DataFrame, table: DataFrame, key: str | Sequence[str], weight: str, broadcast_rows: int | None = None
) -> DataFrame:
    """Left join of ``df`` with ``table`` on ``key`` (null matches null), skew-safe.

    ``table`` holds one row per key and the number of rows of ``df`` with that key in ``weight``. It is
    broadcast while its rows and the bytes of its texts are few. Beyond that both sides are shuffled; rows of a
    frequent key are spread over as many partitions as its weight holds shares of 1/HOT_SHARE, and only the matching lookup rows are copied to each of them.
    """
    keys = as_list(key)
    limit = BROADCAST_ROWS if broadcast_rows is None else broadcast_rows
    long = [quoted(f.name) for f in table.schema.fields if f.dataType.typeName() in ("string", "binary")]
    size = F.sum(sum((F.coalesce(F.octet_length(c), F.lit(0)) for c in long), F.lit(0)).cast("long"))
    rows, total, size = table.agg(F.count(F.lit(1)), F.sum(weight), size).first()
    rest = [quoted(c) for c in table.columns if c not in keys and c != weight]
    names = [quoted(k).alias(f"__k{i}") for i, k in enumerate(keys)]

    def same(prefix: str = "__k") -> Column:
        test = quoted(keys[0]).eqNullSafe(F.col(f"{prefix}0"))
        for i, k in enumerate(keys[1:], 1):
            test = test & quoted(k).eqNullSafe(F.col(f"{prefix}{i}"))
        return test

    gone = [f"__k{i}" for i in range(len(keys))]
    if rows <= limit and (size or 0) <= BROADCAST_BYTES:
        return df.join(F.broadcast(table.select(*names, *rest)), same(), "left").drop(*gone)
    hot_from = max(1, total // HOT_SHARE)
    is_hot = F.col(weight) > hot_from
    salts = F.ceil(F.col(weight) / hot_from).cast("int")  # at most about HOT_SHARE for all keys together
    hot = table.filter(is_hot).select(*[quoted(k).alias(f"__h{i}") for i, k in enumerate(keys)], salts.alias("__hot"))
    # at most HOT_SHARE keys can hold more than 1/HOT_SHARE of the rows each
    left = df.join(F.broadcast(hot), same("__h"), "left").drop(*[f"__h{i}" for i in range(len(keys))])
    plain = [quoted(c) for c in df.columns if df.schema[c].dataType.typeName() not in ("map", "variant")]
    # content and input partition: repeatable when a task is retried, and exact copies still spread out
    spread = F.pmod(F.xxhash64(F.spark_partition_id(), *plain), F.col("__hot")).cast("int")
    left = left.withColumn("__salt", F.coalesce(spread, F.lit(0))).drop("__hot")
    copies = F.when(is_hot, F.sequence(F.lit(0), salts - 1)).otherwise(F.array(F.lit(0)))
    salted = table.select(*names, *rest, F.explode(copies).alias("__rs"))
    return left.join(salted, same() & (F.col("__salt") == F.col("__rs")), "left").drop(*gone, "__rs", "__salt")


def attach_row(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Adds the columns of a one-row aggregate to every row, as literals."""
    row = one_row.first()
    return df.withColumns({f.name: literal(row[f.name], f.dataType) for f in one_row.schema.fields})
