"""Registered queries and the SQL that states their expected result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers ``fn(spark, sf_dir)`` under ``name``, with the equivalent SQL where there is one."""

    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return add


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{table}.parquet")


# events with missing values made by an expression, equal on both sides
EV_NULLS = "CASE WHEN event_id % 7 = 0 THEN NULL ELSE value END"
ORDER = ["ts", "event_id"]


def events(spark, d):
    return read(spark, d, "events").selectExpr("event_id", "ts", "user_id", "event_type", "value", f"{EV_NULLS} AS v")


EVENTS_SQL = f"ev AS (SELECT event_id, ts, user_id, event_type, value, {EV_NULLS} AS v FROM events)"

LI_NULLS = {
    "q": "CASE WHEN l_orderkey % 7 = 0 THEN NULL ELSE l_quantity END",
    "p": "CASE WHEN l_orderkey % 11 = 0 THEN NULL ELSE l_extendedprice END",
    "f": "CASE WHEN l_orderkey % 5 = 0 THEN NULL ELSE l_returnflag END",
}


def lines(spark, d):
    made = [f"{e} AS {c}" for c, e in LI_NULLS.items()]
    return read(spark, d, "lineitem").selectExpr(
        "l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", *made
    )


LINES_SQL = (
    "li AS (SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, "
    + ", ".join(f"{e} AS {c}" for c, e in LI_NULLS.items())
    + " FROM lineitem)"
)


def rounded(df: DataFrame, keys, values, places: int = 4) -> DataFrame:
    from pyspark.sql import functions as F

    return df.select(*keys, *[F.round(F.col(f"`{v}`").cast("double"), places).alias(v) for v in values])
