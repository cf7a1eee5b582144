"""Column transforms that need at most a few statistics per column: imputing, scaling, outliers, encoding.

Every transform has a fit part, which runs one aggregation and returns a ``Fitted`` (a few numbers per
column), and an apply part, a plain projection or filter that also works on a stream.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seriesmill.functions.columns import (
    as_double,
    field_type,
    is_numeric,
    missing,
    numeric_columns,
    present,
    quoted,
    safe_name,
)
from seriesmill.operators.joins import lookup_join
from seriesmill.operators.quantiles import exact_quantiles
from seriesmill.session import materialize


@dataclass
class Fitted:
    """Fitted parameters of one transform: ``params[column] = {...}``."""

    method: str
    params: dict[str, dict] = field(default_factory=dict)
    options: dict = field(default_factory=dict)

    @property
    def columns(self) -> list[str]:
        return [c for c, p in self.params.items() if not p.get("skipped_reason")]


def _stats(df: DataFrame, cols: Sequence[str], aggs: dict, where: Column | None = None) -> dict[str, dict]:
    """One aggregation over all columns: ``aggs = {name: function(column)}``."""
    if not cols:
        return {}
    src = df if where is None else df.filter(where)
    exprs = [fn(as_double(df, c)).alias(f"{i}|{name}") for i, c in enumerate(cols) for name, fn in aggs.items()]
    row = src.agg(*exprs).first()
    return {c: {name: row[f"{i}|{name}"] for name in aggs} for i, c in enumerate(cols)}


def _train_only(fit_on: str) -> Column | None:
    if fit_on == "all":
        return None
    if fit_on == "train":
        return F.col("split") == "train"
    raise ValueError("fit_on must be 'all' or 'train'")


def _replace(df: DataFrame, new: dict[str, Column]) -> DataFrame:
    return df.select(*[new[c].alias(c) if c in new else quoted(c) for c in df.columns]) if new else df


# ---------------------------------------------------------------- frequent values


def value_counts(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(column, value, n) for non-missing values, counted on the map side first."""
    pairs = F.array(
        *[F.struct(F.lit(c).alias("column"), F.when(~missing(df, c), quoted(c)).cast("string").alias("value")) for c in cols]
    )
    return (
        df.select(F.inline(pairs))
        .filter(F.col("value").isNotNull())
        .groupBy("column", "value")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def modes(df: DataFrame, cols: Sequence[str]) -> dict[str, str]:
    """Most frequent value per column; the smallest one on a tie; no entry for a column without values."""
    if not cols:
        return {}
    rows = (
        value_counts(df, cols)
        .groupBy("column")
        .agg(F.min(F.struct((-F.col("n")).alias("m"), F.col("value"))).alias("top"))
        .collect()  # one row per column
    )
    return {r["column"]: r["top"]["value"] for r in rows}


# ---------------------------------------------------------------- impute


def fit_impute(
    df: DataFrame,
    cols: Sequence[str],
    strategy: str = "mean",
    fill_value: float = 0.0,
    fit_on: str = "all",
    no_mode: str = "",
) -> Fitted:
    """Fill values: mean (default, also for ``most_frequent``), median or constant for numbers, mode for text."""
    where = _train_only(fit_on)
    holes = df.agg(*[F.count_if(missing(df, c)).alias(f"m{i}") for i, c in enumerate(cols)]).first() if cols else []
    cols = [c for i, c in enumerate(cols) if holes[i]]
    numeric = numeric_columns(df, cols)
    text = [c for c in cols if c not in numeric]
    if strategy == "constant":
        fills = {c: float(fill_value) for c in numeric}
    elif strategy == "median":
        quants = exact_quantiles(df, numeric, [0.5], where=where) if numeric else {}
        fills = {c: q[0.5] for c, q in quants.items()}
    else:
        fills = {c: s["mean"] for c, s in _stats(df, numeric, {"mean": F.avg}, where).items()}
    params: dict[str, dict] = {c: {"fill_value": 0.0 if v is None else v} for c, v in fills.items()}
    top = modes(df if where is None else df.filter(where), text)
    params.update({c: {"fill_value": top.get(c, no_mode)} for c in text})
    return Fitted("imputation", {c: params[c] for c in cols}, {"strategy": strategy})


def apply_impute(df: DataFrame, fitted: Fitted) -> DataFrame:
    new = {}
    for c, p in fitted.params.items():
        if is_numeric(field_type(df, c)):
            new[c] = F.coalesce(as_double(df, c), F.lit(float(p["fill_value"])))
        else:
            new[c] = F.coalesce(quoted(c), F.lit(p["fill_value"]).cast(field_type(df, c)))
    return _replace(df, new)


def impute(df: DataFrame, cols: Sequence[str], strategy: str = "mean", fill_value: float = 0.0, fit_on: str = "all"):
    return apply_impute(df, fit_impute(df, cols, strategy, fill_value, fit_on))


# ---------------------------------------------------------------- scaling


def fit_z_norm(df: DataFrame, cols: Sequence[str], ddof: int = 0, fit_on: str = "all") -> Fitted:
    """Mean and standard deviation (population by default); a constant column is left alone."""
    dev = F.stddev_pop if ddof == 0 else F.stddev_samp
    cols = numeric_columns(df, cols)
    params = {}
    for c, s in _stats(df, cols, {"mean": F.avg, "std": dev}, _train_only(fit_on)).items():
        params[c] = s if s["std"] else {"mean": s["mean"], "std": 0.0, "skipped_reason": "constant column"}
    return Fitted("z_norm", params, {"ddof": ddof})


def apply_z_norm(df: DataFrame, fitted: Fitted) -> DataFrame:
    new = {}
    for c in fitted.columns:
        p = fitted.params[c]
        new[c] = (as_double(df, c) - F.lit(p["mean"])) / F.lit(p["std"])
    return _replace(df, new)


def z_norm(df: DataFrame, cols: Sequence[str], ddof: int = 0, fit_on: str = "all") -> DataFrame:
    return apply_z_norm(df, fit_z_norm(df, cols, ddof, fit_on))


def fit_min_max(df: DataFrame, cols: Sequence[str], zero_range: str = "keep", fit_on: str = "all") -> Fitted:
    """Range of each column; a column with zero range is kept as it is, or becomes null (``zero_range="null"``)."""
    params = {}
    for c, s in _stats(df, numeric_columns(df, cols), {"min": F.min, "max": F.max}, _train_only(fit_on)).items():
        flat = s["min"] is None or s["max"] == s["min"]
        params[c] = {**s, "skipped_reason": "zero range"} if flat and zero_range == "keep" else s
    return Fitted("min_max", params, {"zero_range": zero_range})


def apply_min_max(df: DataFrame, fitted: Fitted) -> DataFrame:
    new = {}
    for c in fitted.columns:
        low, high = fitted.params[c]["min"], fitted.params[c]["max"]
        if low is None or high == low:
            new[c] = F.lit(None).cast("double")
        else:
            new[c] = (as_double(df, c) - F.lit(low)) / F.lit(high - low)
    return _replace(df, new)


def min_max(df: DataFrame, cols: Sequence[str], zero_range: str = "keep", fit_on: str = "all") -> DataFrame:
    return apply_min_max(df, fit_min_max(df, cols, zero_range, fit_on))


def fit_log_transform(df: DataFrame, cols: Sequence[str], negatives: str = "skip") -> Fitted:
    """log(1+x). ``negatives="skip"`` leaves a column with any negative value alone, ``"clip"`` raises them to 0."""
    cols = numeric_columns(df, cols)
    if negatives == "clip":
        return Fitted("log_transform", {c: {} for c in cols}, {"negatives": "clip"})
    params = {}
    for c, s in _stats(df, cols, {"min": F.min}).items():
        params[c] = {"skipped_reason": "negative values"} if s["min"] is not None and s["min"] < 0 else {}
    return Fitted("log_transform", params, {"negatives": "skip"})


def apply_log_transform(df: DataFrame, fitted: Fitted) -> DataFrame:
    clip = fitted.options.get("negatives") == "clip"
    new = {}
    for c in fitted.columns:
        x = as_double(df, c)
        # greatest() skips nulls, so the clip must not turn a null into 0
        new[c] = F.log1p(F.when(x < 0, F.lit(0.0)).otherwise(x) if clip else x)
    return _replace(df, new)


def log_transform(df: DataFrame, cols: Sequence[str], negatives: str = "skip") -> DataFrame:
    return apply_log_transform(df, fit_log_transform(df, cols, negatives))


def inverse_transform(df: DataFrame, fitted: Fitted, cols: Sequence[str] | None = None) -> DataFrame:
    """Back to raw units from a fitted z_norm, min_max or log_transform; ``cols`` defaults to all fitted columns."""
    new = {}
    for c in fitted.columns if cols is None else cols:
        p, x = fitted.params[c], as_double(df, c)
        if p.get("skipped_reason"):
            continue
        if fitted.method == "z_norm":
            new[c] = x * F.lit(p["std"]) + F.lit(p["mean"])
        elif fitted.method == "min_max":
            new[c] = x * F.lit(p["max"] - p["min"]) + F.lit(p["min"])
        elif fitted.method == "log_transform":
            new[c] = F.expm1(x)
        else:
            raise ValueError(f"{fitted.method} has no inverse")
    return _replace(df, new)


# ---------------------------------------------------------------- outliers


def fit_outliers(df: DataFrame, cols: Sequence[str], method: str = "iqr", threshold: float = 1.5) -> Fitted:
    """Allowed interval per column, from the whole table: quartile fences or |z| <= threshold."""
    cols = numeric_columns(df, cols)
    params: dict[str, dict] = {}
    if method == "iqr":
        for c, q in exact_quantiles(df, cols, [0.25, 0.75]).items() if cols else ():
            if q[0.25] is None:
                params[c] = {"low": None, "high": None}
            else:
                reach = threshold * (q[0.75] - q[0.25])
                params[c] = {"low": q[0.25] - reach, "high": q[0.75] + reach}
    elif method == "zscore":
        for c, s in _stats(df, cols, {"mean": F.avg, "std": F.stddev_pop}).items():
            params[c] = {"skipped_reason": "constant column"} if s["std"] == 0 else s
    return Fitted("remove_outliers", params, {"method": method, "threshold": threshold})


def apply_outliers(df: DataFrame, fitted: Fitted, keep_null: bool = False) -> DataFrame:
    """Keeps rows inside every interval; a null drops the row unless ``keep_null``."""
    test = F.lit(True)
    for c in fitted.columns:
        p, x = fitted.params[c], as_double(df, c)
        if fitted.options["method"] == "iqr":
            inside = x.between(F.lit(p["low"]).cast("double"), F.lit(p["high"]).cast("double"))
        else:
            z = (x - F.lit(p["mean"]).cast("double")) / F.lit(p["std"]).cast("double")
            inside = F.abs(z) <= F.lit(float(fitted.options["threshold"]))
        test = test & F.coalesce(inside, F.lit(keep_null))
    return df.filter(test)


def remove_outliers(df, cols, method: str = "iqr", threshold: float = 1.5, keep_null: bool = False) -> DataFrame:
    return apply_outliers(df, fit_outliers(df, cols, method, threshold), keep_null)


def fit_clip(df: DataFrame, cols: Sequence[str], z: float = 3.0) -> Fitted:
    """Clipping bounds mean ± z sample deviations; a deviation of 0 counts as 1."""
    params = {}
    for c, s in _stats(df, numeric_columns(df, cols), {"mean": F.avg, "std": F.stddev_samp}).items():
        if s["mean"] is None or s["std"] is None:
            params[c] = {"skipped_reason": "too few values"}
        else:
            std = s["std"] or 1.0
            params[c] = {"low": s["mean"] - z * std, "high": s["mean"] + z * std}
    return Fitted("clip_outliers", params, {"z": z})


def apply_clip(df: DataFrame, fitted: Fitted) -> DataFrame:
    new = {}
    for c in fitted.columns:
        x, p = as_double(df, c), fitted.params[c]
        new[c] = F.when(x < p["low"], F.lit(p["low"])).when(x > p["high"], F.lit(p["high"])).otherwise(x)
    return _replace(df, new)


def clip_outliers(df: DataFrame, cols: Sequence[str], z: float = 3.0) -> DataFrame:
    return apply_clip(df, fit_clip(df, cols, z))


def clip_outliers_if(df: DataFrame, cols: Sequence[str], issues: Sequence[str] | str | None, z: float = 3.0) -> DataFrame:
    """Clips only when the recorded quality issues speak of outliers or spikes."""
    text = " ".join([issues] if isinstance(issues, str) else [str(i) for i in (issues or [])]).lower()
    return clip_outliers(df, cols, z) if "outlier" in text or "spike" in text else df


# ---------------------------------------------------------------- encoding

INLINE_CLASSES, INLINE_BYTES = 1_000, 256  # encodings up to this size are kept as fitted parameters


def label_table(df: DataFrame, col: str) -> DataFrame:
    """(value, n, code): every distinct text, null as the class "nan", codes 0.. in sorted order.

    The distinct texts are written once: finding their order takes several passes.
    """
    from seriesmill.operators.ordering import fit_layout

    text = F.coalesce(F.when(~missing(df, col), quoted(col)).cast("string"), F.lit("nan"))
    counts = materialize(df.select(text.alias("value")).groupBy("value").agg(F.count(F.lit(1)).alias("n")))
    return fit_layout(counts, ["value"]).position(counts, "code")


def _digest(text: Column) -> Column:
    """SHA-256, which stands for a text of any length in joins."""
    return F.unhex(F.sha2(text.cast("binary"), 256))


def _codes(df: DataFrame, col: str) -> DataFrame:
    """(key, n, code), written once; ``key`` is the digest of the value."""
    return materialize(label_table(df, col).select(_digest(F.col("value")).alias("key"), "n", "code"))


def label_encode(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Replaces text columns by the rank of their value among the sorted distinct values."""
    for c in cols:
        if is_numeric(field_type(df, c)):
            continue
        text = F.coalesce(F.when(~missing(df, c), quoted(c)).cast("string"), F.lit("nan"))
        df = _join_codes(df, c, text, _codes(df, c))
    return df


def fit_label_encode(df: DataFrame, cols: Sequence[str], inline: int = INLINE_CLASSES) -> Fitted:
    """Encodings of text columns, for reuse on other frames and streams.

    Up to ``inline`` classes of up to ``INLINE_BYTES`` bytes are kept as values; beyond that the codes stay a table,
    written once, that is joined. The codes are the same either way.
    """
    params: dict[str, dict] = {}
    for c in cols:
        if is_numeric(field_type(df, c)):
            continue
        text = F.coalesce(F.when(~missing(df, c), quoted(c)).cast("string"), F.lit("nan"))
        short = F.when(F.octet_length("v") <= INLINE_BYTES, F.col("v"))
        seen = [r[0] for r in df.select(text.alias("v")).distinct().select(short).limit(inline + 1).collect()]
        if len(seen) > inline or None in seen:
            params[c] = {"lookup": _codes(df, c)}
        else:
            params[c] = {"encoding": {v: i for i, v in enumerate(sorted(seen, key=lambda t: t.encode()))}}
    return Fitted("label_encode", params)


def apply_label_encode(df: DataFrame, fitted: Fitted) -> DataFrame:
    """Codes from a fitted encoding; a value that was not there at fit time gives null."""
    new = {}
    for c in fitted.columns:
        text = F.coalesce(quoted(c).cast("string"), F.lit("nan"))
        if "lookup" in fitted.params[c]:
            df = _join_codes(df, c, text, fitted.params[c]["lookup"])
        elif fitted.params[c]["encoding"]:
            pairs = [F.lit(x) for item in fitted.params[c]["encoding"].items() for x in item]
            new[c] = F.try_element_at(F.create_map(*pairs), text).cast("bigint")
        else:
            new[c] = F.lit(None).cast("bigint")
    return _replace(df, new)


def _join_codes(df: DataFrame, col: str, text: Column, table: DataFrame) -> DataFrame:
    joined = lookup_join(df.withColumn("__lv", _digest(text)).drop(col), table.withColumnRenamed("key", "__lv"), "__lv", "n")
    return joined.select(*[F.col("code").cast("bigint").alias(n) if n == col else quoted(n) for n in df.columns])


def fit_onehot(df: DataFrame, cols: Sequence[str], max_card: int = 20) -> Fitted:
    """Sorted categories of non-numeric columns; columns with more than ``max_card`` distinct values are skipped."""
    params: dict[str, dict] = {}
    for c in cols:
        if is_numeric(field_type(df, c)):
            continue
        values = df.filter(~missing(df, c)).select(quoted(c).alias("v")).distinct().limit(max_card + 1).collect()
        if len(values) > max_card:
            params[c] = {"skipped_reason": "too many categories"}
        else:
            params[c] = {"categories": sorted(r[0] for r in values)}
    return Fitted("onehot_encode", params, {"max_cardinality": max_card})


def onehot_names(fitted: Fitted) -> list[str]:
    return [f"{c}_{safe_name(v)}" for c in fitted.columns for v in fitted.params[c]["categories"]]


def apply_onehot(df: DataFrame, fitted: Fitted) -> DataFrame:
    flags = [
        F.coalesce(quoted(c) == F.lit(v), F.lit(False)).cast("int").alias(f"{c}_{safe_name(v)}")
        for c in fitted.columns
        for v in fitted.params[c]["categories"]
    ]
    return df.select(*[quoted(c) for c in df.columns if c not in fitted.columns], *flags)


def onehot_encode(df: DataFrame, cols: Sequence[str], max_card: int = 20) -> DataFrame:
    return apply_onehot(df, fit_onehot(df, cols, max_card))


# ---------------------------------------------------------------- null guard


def fit_null_guard(df: DataFrame, features: Sequence[str]) -> Fitted:
    """Last fill of features: mean for numbers (0.0 if all null), mode for others ("missing" if none)."""
    return fit_impute(df, features, "mean", no_mode="missing")


def null_guard(df: DataFrame, features: Sequence[str]) -> DataFrame:
    return apply_impute(df, fit_null_guard(df, features))


APPLY = {
    "imputation": apply_impute,
    "z_norm": apply_z_norm,
    "min_max": apply_min_max,
    "log_transform": apply_log_transform,
    "remove_outliers": apply_outliers,
    "clip_outliers": apply_clip,
    "label_encode": apply_label_encode,
    "onehot_encode": apply_onehot,
}


def apply_fitted(df: DataFrame, *fitted: Fitted) -> DataFrame:
    """Applies fitted transforms in order; a projection (or filter) without any aggregation."""
    for f in fitted:
        df = APPLY[f.method](df, f)
    return df
