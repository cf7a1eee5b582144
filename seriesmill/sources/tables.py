"""Loading tables by format, looking at their first rows, writing results and checking result documents."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seriesmill.functions.columns import ascending, as_list, missing, quoted

# File extensions and the formats they stand for.
FORMATS = {".csv": "csv", ".parquet": "parquet", ".json": "json"}

# Fields that every result document must have.
REQUIRED_FIELDS = {
    "dataset_profile": ["run_id", "num_rows", "num_columns", "columns"],
    "task_spec": ["run_id", "task_type", "target_col"],
    "eval_protocol": [
        "run_id", "task_type", "split_strategy", "train_fraction", "val_fraction", "test_fraction", "shuffle",
        "stratify_on", "group_col", "time_col", "cv", "prediction_type", "quantiles", "primary_metric", "metrics",
        "metrics_for_this_run", "minimum_test_samples",
    ],
    "preprocessing_manifest": [
        "run_id", "steps_applied", "final_shape", "feature_columns", "target_column", "time_column",
    ],
    "preprocessing_plan": [
        "run_id", "steps", "preserve_temporal_order", "exclude_columns_from_features", "plan_source",
    ],
    "selected_models": [
        "run_id", "task_type", "selected_models", "selection_strategy", "models_considered", "models_rejected",
    ],
    "training_results": ["run_id", "models", "split_info", "feature_columns", "target_column"],
    "evaluation_report": ["run_id", "primary_metric", "test_split_size", "models", "evaluated_at"],
    "comparison_table": ["run_id", "ranked_by", "ranking"],
    "leaderboard": [
        "run_id", "dataset_name", "task_type", "primary_metric", "higher_is_better", "models", "generated_at",
    ],
    "run_summary": ["run_id", "assembled_at", "stages"],
}


def detect_format(path: str) -> str:
    """Format from the file extension; anything but csv, parquet and json is rejected."""
    tail = path.rstrip("/").rsplit("/", 1)[-1].lower()
    for ext, fmt in FORMATS.items():
        if tail.endswith(ext):
            return fmt
    raise ValueError(f"unsupported file format: {path!r}; expected one of {sorted(FORMATS)}")


def load_table(
    spark: SparkSession, path: str, fmt: str | None = None, schema: T.StructType | str | None = None
) -> DataFrame:
    """Reads a csv (with header), parquet or json table. Give ``schema`` to spare the inference pass of csv and json.

    JSON may be one array of records or one record per line; a single large array cannot be split by
    Spark, so large inputs should be line-delimited (``fmt="jsonl"``).
    """
    fmt = fmt or detect_format(path)
    reader = spark.read if schema is None else spark.read.schema(schema)
    if fmt == "csv":
        return reader.csv(path, header=True, inferSchema=schema is None)
    if fmt == "parquet":
        return reader.parquet(path)
    if fmt == "json":
        return reader.json(path, multiLine=True)
    if fmt == "jsonl":
        return reader.json(path)
    raise ValueError(f"unsupported file format: {fmt!r}")


def require_shape(df: DataFrame, min_rows: int = 2, min_cols: int = 1) -> DataFrame:
    """The table itself, if it has at least ``min_rows`` rows and ``min_cols`` columns."""
    if len(df.columns) < min_cols or len(df.limit(min_rows).take(min_rows)) < min_rows:
        raise ValueError(f"INGESTION_EMPTY_FILE: at least {min_rows} rows and {min_cols} column(s) are needed")
    return df


def head_rows(df: DataFrame, order_by: str | Sequence[str], n: int = 50) -> DataFrame:
    """The first ``n`` rows in order."""
    return df.orderBy(*ascending(as_list(order_by))).limit(n)


def _text(df: DataFrame, col: str) -> Column:
    dt = df.schema[col].dataType
    if isinstance(dt, (T.ArrayType, T.MapType, T.StructType)):
        return F.to_json(quoted(col))
    return quoted(col).cast("string")


def sample_values(df: DataFrame, order_by: str | Sequence[str], n: int = 5, cols: Sequence[str] | None = None) -> DataFrame:
    """The first ``n`` non-missing values of every column, as text: (column, rank, value).

    The values almost always lie in the first rows of the table. A column with too few values there is
    looked up in the whole table, where each task forwards at most ``n`` rows per column.
    """
    order = as_list(order_by)
    cols = list(df.columns if cols is None else cols)
    head = df.orderBy(*ascending(order)).limit(max(200, 20 * n))
    present_in_head = head.agg(
        F.count(F.lit(1)).alias("rows"), *[F.count_if(~missing(df, c)).alias(f"c{i}") for i, c in enumerate(cols)]
    ).first()
    whole_table_seen = present_in_head["rows"] < max(200, 20 * n)
    short = [c for i, c in enumerate(cols) if present_in_head[f"c{i}"] < n and not whole_table_seen]
    parts = []
    for source, names in ((head, [c for c in cols if c not in short]), (df, short)):
        if names:
            pairs = F.array(
                *[
                    F.struct(
                        F.lit(c).alias("column"), F.when(~missing(df, c), _text(df, c)).alias("value")
                    )
                    for c in names
                ]
            )
            keys = [quoted(k).alias(f"__o{i}") for i, k in enumerate(order)]
            parts.append(source.select(*keys, F.inline(pairs)).filter(F.col("value").isNotNull()))
    long = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    w = Window.partitionBy("column").orderBy(*ascending([f"__o{i}" for i in range(len(order))]))
    ranked = long.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)
    return ranked.select("column", "rank", "value")


def write_processed(df: DataFrame, path: str, fmt: str = "parquet", partition_by: str | None = "split") -> None:
    """Writes a processed table; partitioned by the split column when there is one."""
    writer = df.write.mode("overwrite")
    if partition_by is not None and partition_by in df.columns:
        writer = writer.partitionBy(partition_by)
    if fmt == "csv":
        writer.csv(path, header=True)
    elif fmt == "parquet":
        writer.parquet(path)
    else:
        raise ValueError(f"unsupported file format: {fmt!r}")


_COMMITS = "_commits"  # readers of the table pass over names that begin with _
_RECORD = "run_id string, partitions array<string>, rows bigint"


def write_parts(df: DataFrame, path: str, run_id: str, partition_by: str = "split") -> DataFrame:
    """Replaces the partitions that ``df`` holds, and no others, and records the commit; returns the record.

    A run may be repeated, or retried after a failure at any point: its partitions are replaced as a whole, its record is
    written last and under its own name, so the table holds every row once and only complete runs are on record.
    """
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition_by).parquet(path)
    spark, part = df.sparkSession, quoted(partition_by)
    written = spark.read.parquet(path).join(F.broadcast(df.select(part.alias("__p")).distinct()), part.eqNullSafe(F.col("__p")), "left_semi")
    found = written.groupBy(part.cast("string").alias("p")).agg(F.count(F.lit(1)).alias("n"))  # footers only
    record = found.agg(F.lit(run_id).alias("run_id"), F.array_sort(F.collect_list("p")).alias("partitions"), F.coalesce(F.sum("n"), F.lit(0)).alias("rows"))
    record.coalesce(1).write.mode("overwrite").json(f"{path}/{_COMMITS}/{run_id}")
    return commits(spark, path).filter(F.col("run_id") == run_id)


def commits(spark: SparkSession, path: str) -> DataFrame:
    """(run_id, partitions, rows) of every complete run."""
    return spark.read.schema(_RECORD).option("recursiveFileLookup", "true").json(f"{path}/{_COMMITS}")


def read_artifact(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Result documents with the columns of ``schema``; fields that a document lacks are null."""
    return spark.read.schema(schema).json(path)


def write_artifact(df: DataFrame, path: str) -> None:
    """Writes result documents, one JSON object per row, atomically through the output committer."""
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def required_fields(spark: SparkSession) -> DataFrame:
    rows = [(name, fields) for name, fields in REQUIRED_FIELDS.items()]
    return spark.createDataFrame(rows, "schema_name string, required array<string>")


def contract_check(docs: DataFrame, schema_col: str = "schema_name", doc_col: str = "doc") -> DataFrame:
    """Adds ``missing_fields`` and ``valid`` to JSON documents; unknown schemas give null."""
    need = required_fields(docs.sparkSession).withColumnRenamed("schema_name", "__schema")
    # the table of required fields has a fixed, small number of rows
    out = docs.join(F.broadcast(need), quoted(schema_col) == F.col("__schema"), "left").drop("__schema")
    keys = F.coalesce(F.json_object_keys(F.col(doc_col)), F.array().cast("array<string>"))
    gone = F.array_sort(F.array_except("required", keys))
    out = out.withColumn("missing_fields", gone).withColumn("valid", F.size(gone) == 0)
    return out.withColumn("valid", F.when(F.col("required").isNotNull(), F.col("valid"))).drop("required")


def artifact_contract_check(spark: SparkSession, directory: str) -> DataFrame:
    """Scans a folder of runs for ``<schema_name>.json`` documents: one row per document with its missing fields."""
    files = (
        spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json").text(directory, wholetext=True)
    )
    named = files.select(
        F.input_file_name().alias("path"),
        F.regexp_extract(F.input_file_name(), r"([^/]+)\.json$", 1).alias("schema_name"),
        F.col("value").alias("doc"),
    )
    checked = contract_check(named.filter(F.col("schema_name").isin(list(REQUIRED_FIELDS))))
    return checked.select("path", "schema_name", "missing_fields", "valid")
