"""Shards that all hold the corpus mixture: proportional stratified interleaving.

Rows are shuffled within their source by a seeded digest and ranked; the fractional rank (rank + 1/2) / (rows of the
source) places every source evenly on the unit interval, so any cut of the common order holds each source in
proportion. Shard sizes in rows differ by one at most.

Both rankings work on blocks of equal share: digests and fractional ranks are uniform, so a block is a range of the
value itself, and a block's first rank is the running sum of the block counts. No source, however large, meets in one
task.

Defined results: a null source is a source of its own; a null text has 0 bytes and the checksum of no bytes; null and
repeated ids are ordinary rows; ties are ordered by source, digest, id, checksum and size. An empty table gives an
empty result. There are no groups to keep together in this method: copies may lie in different shards. Columns other
than the named ones are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seriesmill.functions.columns import hash_order
from seriesmill.llm.common import settle, utf8

BLOCK_ROWS = 200_000  # rows that are ranked together
DIGEST_SPACE = float(16**15)


def narrow(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """Id, source, bytes and checksum: all that the shards are decided on."""
    raw = utf8(F.col(text_col))
    return docs.select(
        F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"),
        (F.octet_length(raw) + 16).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"),
    )


def interleave(rows: DataFrame, shards: int, seed: int = 0, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Adds ``place`` (rank in the common order), ``shard`` and ``slot`` to rows with ``doc_id`` and ``source``."""
    rows = settle(rows.withColumn("_h", hash_order("doc_id", seed)[0]), "shards")
    n = rows.count()
    blocks = max(1, -(-n // block_rows))
    ties = [F.col(c).asc_nulls_last() for c in rows.columns if c not in ("_h", "source")]
    place = [F.col("source").asc_nulls_last(), F.col("_h").asc(), *ties]

    rows = rows.withColumn("_b", F.floor(F.col("_h") / F.lit(DIGEST_SPACE) * blocks))
    by_source = Window.partitionBy("source")
    starts = (
        rows.groupBy("source", "_b").agg(F.count("*").alias("_n"))
        .withColumn("_start", F.sum("_n").over(by_source.orderBy("_b")) - F.col("_n"))
        .withColumn("_all", F.sum("_n").over(by_source)).drop("_n")
        .select(F.col("source").alias("_s"), F.col("_b").alias("_sb"), "_start", "_all")
    )
    ranked = rows.join(starts, rows["source"].eqNullSafe(starts["_s"]) & (rows["_b"] == starts["_sb"])).drop("_s", "_sb")
    inside = F.row_number().over(Window.partitionBy("source", "_b").orderBy(*place[1:]))
    ranked = ranked.withColumn("_f", (F.col("_start") + inside - F.lit(0.5)) / F.col("_all"))

    ranked = settle(ranked.withColumn("_c", F.floor(F.col("_f") * blocks)).drop("_b", "_start", "_all"), "shards")
    firsts = ranked.groupBy("_c").agg(F.count("*").alias("_n"))  # one row per block of the common order
    firsts = firsts.select("_c", (F.sum("_n").over(Window.orderBy("_c")) - F.col("_n")).alias("_first"))
    inside = F.row_number().over(Window.partitionBy("_c").orderBy("_f", *place))
    out = ranked.join(firsts, "_c").withColumn("place", (F.col("_first") + inside - 1).cast("long"))
    shard = F.expr(f"place * {shards}L div {max(n, 1)}L")
    out = out.withColumn("shard", shard.cast("int"))
    start = F.expr(f"(shard * {n}L + {shards - 1}L) div {shards}L")
    return out.withColumn("slot", F.col("place") - start.cast("long")).drop("_h", "_f", "_c", "_first")
