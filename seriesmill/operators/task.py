"""Task inference: rules over the profile table, for any number of profiled tables at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Names that mark a target column, limits of the rules, modality of each task.
TARGET_NAMES = ["target", "label", "y", "output"]
MAX_INT_CLASSES = 20
GROUP_SHARE = 0.5
MODALITY = {
    "time_series_forecasting": "time_series",
    "grouped_prediction": "grouped_tabular",
    "tabular_classification": "tabular_iid",
    "tabular_regression": "tabular_iid",
}


def _with_hint(prof: DataFrame, hints: DataFrame | None) -> DataFrame:
    if hints is None:
        return prof.select("*", F.lit(None).cast("string").alias("__hint"), F.lit("low").alias("__conf"))
    h = hints.select("table_name", F.col("suggested_target").alias("__hint"), F.col("target_confidence").alias("__conf"))
    return prof.join(h, "table_name", "left")  # one row per table


def confirm_target(prof: DataFrame, hints: DataFrame | None = None) -> DataFrame:
    """Target per table by five priorities: sure hint, one canonical name, one complete float column, any hint, last number."""
    numeric = F.col("inferred_type") == "numeric"
    canon = F.col("name").isin(TARGET_NAMES)
    floats = numeric & (F.col("missing_fraction") == 0) & F.col("dtype").rlike("float(64|32|16)")
    hinted = F.col("name") == F.col("__hint")
    facts = (
        _with_hint(prof, hints)
        .groupBy("table_name")
        .agg(
            F.max(F.when(hinted, F.col("name"))).alias("hint"),
            F.coalesce(F.max("__conf"), F.lit("low")).alias("conf"),
            F.count_if(canon).alias("n_canon"),
            F.max(F.when(canon, F.col("name"))).alias("canon"),
            F.count_if(floats).alias("n_float"),
            F.max(F.when(floats, F.col("name"))).alias("float"),
            F.max_by(F.when(numeric, F.col("name")), F.when(numeric, F.col("ordinal"))).alias("last"),
        )
    )
    rules = [
        (F.col("hint").isNotNull() & (F.col("conf") == "high"), "hint", "high"),
        (F.col("n_canon") == 1, "canon", "medium"),
        (F.col("n_float") == 1, "float", "medium"),
        (F.col("hint").isNotNull(), "hint", "low"),
        (F.col("last").isNotNull(), "last", "low"),
    ]
    target, confidence, rule = F, F, F
    for i, (test, name, level) in enumerate(rules, 1):
        target = target.when(test, F.col(name))
        confidence = confidence.when(test, F.lit(level))
        rule = rule.when(test, F.lit(i))
    return facts.select(
        "table_name", target.alias("target_col"), confidence.alias("task_confidence"), rule.alias("target_rule")
    )


def detect_time_col(prof: DataFrame, target: DataFrame) -> DataFrame:
    """(table_name, time_col): first rising datetime column, else the first one; never the target."""
    joined = prof.join(target.select("table_name", "target_col"), "table_name", "left")
    rising = F.coalesce(F.col("is_monotonically_increasing"), F.lit(False))
    fit = F.col("is_temporal") & ~F.col("name").eqNullSafe(F.col("target_col"))
    best = F.min(F.when(fit, F.struct((~rising).alias("late"), "ordinal", "name")))
    return joined.groupBy("table_name").agg(best.alias("b")).select(
        "table_name", F.col("b.name").alias("time_col"), (~F.col("b.late")).alias("time_rising")
    )


def detect_group_col(prof: DataFrame, target: DataFrame) -> DataFrame:
    """(table_name, group_col): first categorical column with 2..max(2, half the rows) values, if the table has a date."""
    joined = prof.join(target.select("table_name", "target_col"), "table_name", "left")
    most = F.greatest(F.lit(2), F.floor(F.col("num_rows") * GROUP_SHARE))
    fit = (
        (F.col("inferred_type") == "categorical")
        & ~F.col("name").eqNullSafe(F.col("target_col"))
        & F.col("unique_count").between(F.lit(2), most)
    )
    first = F.min_by(F.when(fit, F.col("name")), F.when(fit, F.col("ordinal")))
    found = joined.groupBy("table_name").agg(first.alias("g"), F.bool_or("is_temporal").alias("dated"))
    return found.select("table_name", F.when(F.col("dated"), F.col("g")).alias("group_col"))


def _facts(prof: DataFrame, hints: DataFrame | None) -> DataFrame:
    """One row per table: target with its profile, time and group candidates."""
    target = confirm_target(prof, hints)
    of_target = prof.select(
        "table_name",
        F.col("name").alias("target_col"),
        F.col("inferred_type").alias("t_type"),
        F.col("dtype").alias("t_dtype"),
        F.col("unique_count").alias("t_unique"),
        F.col("missing_fraction").alias("t_missing"),
        F.col("min").alias("t_min"),
        F.col("max").alias("t_max"),
        F.col("has_negative_values").alias("t_negative"),
    )
    out = target.join(of_target, ["table_name", "target_col"], "left")
    return out.join(detect_time_col(prof, target), "table_name", "left").join(
        detect_group_col(prof, target), "table_name", "left"
    )


def _task_type():
    is_int = F.col("t_dtype").contains("int")
    return (
        F.when((F.col("t_type") == "numeric") & F.coalesce(F.col("time_rising"), F.lit(False)), "time_series_forecasting")
        .when(F.col("group_col").isNotNull(), "grouped_prediction")
        .when((F.col("t_type") == "categorical") | (is_int & (F.col("t_unique") <= MAX_INT_CLASSES)), "tabular_classification")
        .otherwise("tabular_regression")
    )


def _modality(task):
    chain = F
    for name, modality in MODALITY.items():
        chain = chain.when(task == name, F.lit(modality))
    return chain


def classify_task(prof: DataFrame, hints: DataFrame | None = None) -> DataFrame:
    """Task type and modality per table."""
    out = _facts(prof, hints).withColumn("task_type", _task_type())
    return out.select("table_name", "target_col", "task_type", _modality(F.col("task_type")).alias("modality"))


def regression_subtype(prof: DataFrame) -> DataFrame:
    """Per column: count (integers without negatives), bounded (inside 0..1) or standard."""
    return prof.select("table_name", "name", _subtype("dtype", "min", "max", "has_negative_values").alias("subtype"))


def _subtype(dtype: str, low: str, high: str, negative: str):
    return (
        F.when(F.col(dtype).contains("int") & ~F.coalesce(F.col(negative), F.lit(False)), "count")
        .when((F.col(low) >= 0) & (F.col(high) <= 1), "bounded")
        .otherwise("standard")
    )


def task_guards(prof: DataFrame, hints: DataFrame | None = None) -> DataFrame:
    """(table_name, error_code): why no model can be trained, or null."""
    return _facts(prof, hints).select("table_name", _error().alias("error_code"))


def _error():
    # forecasting is only inferred when a rising time column exists, so it never lacks one here
    return (
        F.when(F.col("target_col").isNull() | F.col("t_type").isNull(), "TARGET_NOT_FOUND")
        .when(F.col("t_missing") > 0.5, "TARGET_TOO_SPARSE")
        .when(F.col("t_unique") <= 1, "TARGET_CONSTANT")
    )


def task_spec(prof: DataFrame, hints: DataFrame | None = None, forecast_horizon: int = 10, strict: bool = False) -> DataFrame:
    """The full task description, one row per table; ``strict`` raises on the first table that fails a guard."""
    out = _facts(prof, hints).withColumn("task_type", _task_type()).withColumn("error_code", _error())
    if strict:
        text = F.concat_ws(": ", "error_code", "table_name")
        out = out.withColumn("task_type", F.when(F.col("error_code").isNull(), F.col("task_type")).otherwise(F.raise_error(text)))
    numbers = prof.groupBy("table_name").agg((F.count_if(F.col("inferred_type") == "numeric") > 1).alias("many"))
    out = out.join(numbers, "table_name")
    series = F.col("task_type") == "time_series_forecasting"
    grouped = F.col("task_type") == "grouped_prediction"
    classes = F.when(F.col("t_unique") <= 2, "binary").otherwise("multiclass")
    return out.select(
        "table_name",
        "task_type",
        _modality(F.col("task_type")).alias("modality"),
        "target_col",
        F.when(F.col("t_type") == "numeric", "numeric").otherwise("categorical").alias("target_dtype"),
        F.col("t_unique").alias("target_cardinality"),
        F.when(series | grouped, F.col("time_col")).alias("time_col"),
        F.when(series | grouped, F.col("group_col")).alias("group_col"),
        F.when(series, F.lit(forecast_horizon)).alias("forecast_horizon"),
        F.when(series, F.col("many")).alias("is_multivariate_ts"),
        F.when(F.col("task_type") == "tabular_classification", classes).alias("classification_subtype"),
        F.when(
            F.col("task_type").isin("tabular_regression", "time_series_forecasting"),
            _subtype("t_dtype", "t_min", "t_max", "t_negative"),
        ).alias("regression_subtype"),
        "task_confidence",
        "error_code",
    )
