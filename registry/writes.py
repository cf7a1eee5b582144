"""Sinks that can be repeated, the target guard with its evidence, contexts kept on a stream."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from registry.base import ORDER, query, read
from registry.splits import _RANDOM
from seriesmill.operators.split import split_random
from seriesmill.plans.plan import changed_targets
from seriesmill.session import shared_folder
from seriesmill.sources import tables as S
from seriesmill.streaming.online import update_context_stream

_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _folder(spark, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


@query("a6_write_parts", f"WITH {_RANDOM} SELECT o_orderkey, o_totalprice, split FROM orders JOIN s USING (o_orderkey)")
def a6(spark, d):
    """All parts are written, the test part is written again by a second run, and the first run is repeated."""
    df = split_random(read(spark, d, "orders").select("o_orderkey", "o_totalprice"), "o_orderkey")
    path = _folder(spark, "processed")
    for run, part in (("first", df), ("second", df.filter("split = 'test'")), ("first", df)):
        S.write_parts(part, path, run)
    return spark.read.parquet(path).select("o_orderkey", "o_totalprice", "split")


@query(
    "a6_commit_record",
    f"WITH {_RANDOM} SELECT 'first' AS run_id, 'test,train,val' AS parts, count(*) AS rows FROM s UNION ALL SELECT 'second', 'test', count(*) FROM s WHERE split = 'test'",
)
def a6_record(spark, d):
    df = split_random(read(spark, d, "orders").select("o_orderkey"), "o_orderkey")
    path = _folder(spark, "processed")
    for run, part in (("first", df), ("second", df.filter("split = 'test'")), ("second", df.filter("split = 'test'"))):
        S.write_parts(part, path, run)
    return S.commits(spark, path).select("run_id", F.array_join("partitions", ",").alias("parts"), "rows")


@query(
    "a7_write_artifact",
    "SELECT o_orderpriority AS run_id, count(*) AS n, CAST(NULL AS DOUBLE) AS score, round(max(o_totalprice), 2) AS best FROM orders GROUP BY 1",
)
def a7(spark, d):
    docs = read(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("run_id"))
    docs = docs.agg(F.count(F.lit(1)).alias("n"), F.lit(None).cast("double").alias("score"), F.round(F.max("o_totalprice"), 2).alias("best"))
    path = _folder(spark, "artifact")
    for _ in range(2):
        S.write_artifact(docs, path)
    return S.read_artifact(spark, path, "run_id string, n bigint, score double, best double")


_AFTER = "CASE WHEN o_orderkey % 97 = 0 THEN o_totalprice + 1 WHEN o_orderkey % 193 = 0 THEN NULL ELSE o_totalprice END"


@query(
    "e7_changed_targets",
    f"WITH a AS (SELECT o_orderkey, o_totalprice AS old FROM orders WHERE o_orderkey % 1001 <> 0), b AS (SELECT o_orderkey, {_AFTER} AS new FROM orders WHERE o_orderkey % 997 <> 0) "
    "SELECT o_orderkey, old, new, CASE WHEN a.o_orderkey IS NULL THEN 'added' WHEN b.o_orderkey IS NULL THEN 'removed' ELSE 'changed' END AS change "
    "FROM a FULL JOIN b USING (o_orderkey) WHERE a.o_orderkey IS NULL OR b.o_orderkey IS NULL OR old IS DISTINCT FROM new",
)
def e7(spark, d):
    orders = read(spark, d, "orders")
    before = orders.filter("o_orderkey % 1001 <> 0").select("o_orderkey", "o_totalprice")
    after = orders.filter("o_orderkey % 997 <> 0").select("o_orderkey", F.expr(_AFTER).alias("o_totalprice"))
    return changed_targets(before, after, "o_orderkey", "o_totalprice")


@query("e7_unchanged_target", "SELECT o_orderkey, o_totalprice AS old, o_totalprice AS new, 'changed' AS change FROM orders WHERE false")
def e7_same(spark, d):
    orders = read(spark, d, "orders").select("o_orderkey", "o_totalprice")
    return changed_targets(orders, orders.repartition(5, "o_totalprice"), "o_orderkey", "o_totalprice")


@query(
    "l2_recent_rows_on_a_stream",
    "SELECT user_id, ts, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 8",
)
def l2(spark, d):
    """A file source read in two runs with one checkpoint; rows of every age come in both, so half of them are late."""
    rows = read(spark, d, "events").select("user_id", "ts", "event_id", "value")
    folder, key = _folder(spark, "stream"), "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, _ROCKS)

    def keep(batch, number):
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{folder}/out/{number}")  # a retried batch replaces itself

    try:
        for turn in (0, 1):
            rows.filter(F.pmod(F.xxhash64("event_id"), F.lit(2)) == turn).write.mode("append").parquet(f"{folder}/in")
            stream = spark.readStream.schema(rows.schema).parquet(f"{folder}/in")  # a run takes all new files as one batch
            run = update_context_stream(stream, "user_id", ORDER, 8).writeStream.foreachBatch(keep).outputMode("update")
            run.option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(key, before)
    out = spark.read.option("recursiveFileLookup", "true").parquet(f"{folder}/out")
    latest = out.groupBy("user_id").agg(F.max("batch").alias("batch"))
    return out.join(latest, ["user_id", "batch"]).select("user_id", "ts", "event_id", "value")
