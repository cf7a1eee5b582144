"""What the text operators share: reading, shared tables, words, shipping the package to the workers."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import seriesmill
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SPACES = r"[\x20\x09-\x0D]+"  # what separates words
BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
_BATCH_LIMIT = 8 << 20  # bytes of text that a Python worker gets at once, unless the session says less
_MARK_BITS = 27  # of the table of marks: 16 MB at any size of data
_SHIPPED: set[str] = set()
_OWN_FOLDER: dict[str, str] = {}  # by application, of local sessions that name no shared folder


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{table}.parquet")


def ready(spark: SparkSession) -> SparkSession:
    """Sends this package to the executors once per application and bounds the bytes of an Arrow batch."""
    sc = spark.sparkContext
    if sc.applicationId not in _SHIPPED:
        root = os.path.dirname(os.path.abspath(seriesmill.__file__))
        if os.path.isdir(root):
            path = os.path.join(tempfile.mkdtemp(prefix="seriesmill-"), "seriesmill_package.zip")
            with zipfile.ZipFile(path, "w") as out:
                for folder, _, names in os.walk(root):
                    for name in names:
                        if name.endswith(".py"):
                            full = os.path.join(folder, name)
                            out.write(full, os.path.relpath(full, os.path.dirname(root)))
            sc.addPyFile(path)
        _SHIPPED.add(sc.applicationId)
    if int(spark.conf.get(BATCH_BYTES, str(2**31 - 1))) > _BATCH_LIMIT:
        spark.conf.set(BATCH_BYTES, str(_BATCH_LIMIT))
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; one of our own only in a local session that names none."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN_FOLDER:
        _OWN_FOLDER[app] = tempfile.mkdtemp(prefix="seriesmill-shared-")
    return _OWN_FOLDER[app]


def settle(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` as Parquet to the shared folder and reads it back: later passes and lost executors start here."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def marks(hashes: DataFrame) -> Callable[[Column], Column]:
    """A test of 64-bit hashes: true for all in ``hashes`` (one bigint column), and for few others.

    It tells rows that an exact join must look at from those it cannot concern, so that the texts of the latter stay
    where they are. The table of marks has a fixed size; more hashes make more rows meet the join, not other results.
    """
    hashes = hashes.toDF("mark").filter("mark IS NOT NULL")
    slot = F.col("mark").bitwiseAND(F.lit((1 << _MARK_BITS) - 1))
    bits = hashes.select(F.shiftright(slot, 6).alias("word"), F.expr("shiftleft(1L, CAST(mark & 63L AS INT))").alias("bit"))
    found = bits.groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    table = np.zeros(1 << (_MARK_BITS - 6), np.uint64)
    table[found.column("word").to_numpy()] = found.column("bits").to_numpy().view(np.uint64)
    shared = hashes.sparkSession.sparkContext.broadcast(table)

    @F.arrow_udf("boolean")
    def marked(hashes: pa.Array) -> pa.Array:
        slot = hashes.to_numpy(zero_copy_only=False).view(np.uint64) & np.uint64((1 << _MARK_BITS) - 1)
        return pa.array((shared.value[slot >> np.uint64(6)] >> (slot & np.uint64(63)) & np.uint64(1)).astype(bool))

    return marked


def whole_row(docs: DataFrame) -> Column:
    """All columns as one struct ``row``, so that none is mistaken for a column made on the way."""
    return F.struct(*[F.col("`" + c.replace("`", "``") + "`") for c in docs.columns]).alias("row")


def words(text: Column) -> Column:
    """The runs of characters other than space and tab to carriage return; none for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACES), "")


def word_count(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def utf8(text: Column) -> Column:
    return F.encode(F.coalesce(text, F.lit("")), "UTF-8")


def held_out(doc_id: Column) -> Column:
    """The fifth of the documents that no model learns from, by crc32 of the id's text."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def parts_for(df: DataFrame, least: int = 1) -> int:
    """Shuffle partitions of the session, which the cluster sets by its size of data."""
    return max(least, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")))
