"""Metrics over predictions ``(run_id, model, y_true, y_pred[, y_score | q10, q50, q90])``.

Regression metrics are plain aggregate columns, so any number of them shares one pass. A metric never
fails: where it is not defined it is null.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seriesmill.functions.columns import finite
from seriesmill.operators.joins import attach_row, lookup_join
from seriesmill.operators.ordering import Sizing, fit_layout

EPS = 2.220446049250313e-16  # machine epsilon of a double


def _err(y: str, p: str) -> Column:
    return F.col(y).cast("double") - F.col(p).cast("double")


def rmse(y: str = "y_true", p: str = "y_pred") -> Column:
    return F.sqrt(F.avg(_err(y, p) * _err(y, p)))


def mae(y: str = "y_true", p: str = "y_pred") -> Column:
    return F.avg(F.abs(_err(y, p)))


def mape(y: str = "y_true", p: str = "y_pred", percent: bool = False, zeros: str = "skip") -> Column:
    """Fraction by default; ``zeros="eps"`` divides by the machine epsilon where the truth is zero."""
    size = F.abs(F.col(y).cast("double"))
    if zeros == "eps":
        share = F.abs(_err(y, p)) / F.greatest(size, F.lit(EPS))
    else:
        share = F.try_divide(F.abs(_err(y, p)), size)
    return F.avg(share) * F.lit(100.0 if percent else 1.0)


def smape(y: str = "y_true", p: str = "y_pred") -> Column:
    """0..2; a pair of zeros counts as 0."""
    e = F.abs(_err(y, p))
    both = F.abs(F.col(y).cast("double")) + F.abs(F.col(p).cast("double"))
    return F.avg(F.when(e.isNotNull(), F.coalesce(F.try_divide(2.0 * e, both), F.lit(0.0))))


def r2(y: str = "y_true", p: str = "y_pred") -> Column:
    sse = F.sum(_err(y, p) * _err(y, p))
    sst = F.var_pop(F.col(y).cast("double")) * F.count(F.col(y))
    flat = F.when(sse == 0, 1.0).otherwise(0.0)
    return F.when(F.count(F.col(y)) < 2, None).when(sst == 0, flat).otherwise(F.lit(1.0) - F.try_divide(sse, sst))


def accuracy(y: str = "y_true", p: str = "y_pred") -> Column:
    return F.avg(F.col(y).eqNullSafe(F.col(p)).cast("int"))


def pinball(q: float, y: str = "y_true", p: str = "y_pred") -> Column:
    e = _err(y, p)
    return F.avg(F.greatest(F.lit(q) * e, F.lit(q - 1.0) * e))


def coverage_80(y: str = "y_true", low: str = "q10", high: str = "q90") -> Column:
    return F.avg(F.col(y).between(F.col(low), F.col(high)).cast("int"))


def interval_width_80(low: str = "q10", high: str = "q90") -> Column:
    return F.avg(F.col(high) - F.col(low))


def residual_stats(y: str = "y_true", p: str = "y_pred") -> dict[str, Column]:
    e = _err(y, p)
    return {"mean_residual": F.avg(e), "std_residual": F.stddev_samp(e), "max_error": F.max(F.abs(e))}


def sanitize(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Non-finite numbers become null."""
    return df.withColumns({c: finite(F.col(c)) for c in cols})


REGRESSION = {"rmse": rmse, "mae": mae, "mape": mape, "smape": smape, "r2": r2, "accuracy": accuracy}
QUANTILE = {
    "pinball_loss": lambda: (pinball(0.1, p="q10") + pinball(0.5, p="q50") + pinball(0.9, p="q90")) / 3,
    "coverage_80": coverage_80,
    "interval_width_80": interval_width_80,
}


def confusion_counts(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys, "y_true", "y_pred").agg(F.count(F.lit(1)).alias("n"))


def f1_weighted(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, f1_weighted): F1 per class weighted by its true share; 0 where nothing was predicted or true."""
    sides = F.array(
        F.struct(F.col("y_true").alias("c"), F.col("n").alias("truth"), F.lit(0).cast("bigint").alias("guess")),
        F.struct(F.col("y_pred").alias("c"), F.lit(0).cast("bigint").alias("truth"), F.col("n").alias("guess")),
    )
    hit = F.when(F.col("y_true").eqNullSafe(F.col("y_pred")), F.col("n")).otherwise(F.lit(0))
    per_pair = confusion_counts(df, keys).select(*keys, hit.alias("hit"), F.inline(sides))
    per_class = per_pair.groupBy(*keys, "c").agg(
        F.sum(F.when(F.col("truth") > 0, F.col("hit")).otherwise(0)).cast("double").alias("tp"),
        F.sum("truth").cast("double").alias("truth"),
        F.sum("guess").cast("double").alias("guess"),
    )
    f1 = F.coalesce(F.try_divide(2.0 * F.col("tp"), F.col("truth") + F.col("guess")), F.lit(0.0))
    share = F.try_divide(F.sum(f1 * F.col("truth")), F.sum("truth"))
    return per_class.groupBy(*keys).agg(share.alias("f1_weighted"))


def _score_counts(df: DataFrame, keys: Sequence[str], score: str) -> DataFrame:
    """Positives and negatives per distinct score. The larger of the two classes is the positive one."""
    two = df.groupBy(*keys).agg(
        F.min("y_true").alias("__lo"), F.max("y_true").alias("__hi"), F.count(F.lit(1)).alias("__rows")
    )
    both = lookup_join(df, two, keys, "__rows") if keys else attach_row(df, two)
    # a third class lies strictly between the smallest and the largest one
    return both.groupBy(*keys, F.col(score).cast("double").alias("score")).agg(
        F.count_if(F.col("y_true") == F.col("__hi")).alias("pos"),
        F.count_if(F.col("y_true") == F.col("__lo")).alias("neg"),
        F.count_if((F.col("y_true") > F.col("__lo")) & (F.col("y_true") < F.col("__hi"))).alias("other"),
        F.bool_or(F.col("__lo") == F.col("__hi")).alias("single"),
    )


def roc_auc(df: DataFrame, keys: Sequence[str], score: str = "y_score", sizing: Sizing | None = None) -> DataFrame:
    """(keys, roc_auc): chance that a positive outscores a negative, ties half; null unless there are two classes."""
    keys = list(keys)
    counts = _score_counts(df, keys, score)
    below = fit_layout(counts, ["score"], keys or None, 0, sizing).running_sum(counts, {"below": "neg"}, inclusive=False)
    pos, neg = F.col("pos").cast("double"), F.col("neg").cast("double")
    area = F.sum(pos * (F.col("below") + neg / 2.0))
    valid = (F.sum("other") == 0) & ~F.bool_or("single")
    return below.groupBy(*keys).agg(F.when(valid, F.try_divide(area, F.sum(pos) * F.sum(neg))).alias("roc_auc"))


def compute_metrics(
    df: DataFrame, keys: Sequence[str], names: Sequence[str], score: str = "y_score", sizing: Sizing | None = None
) -> DataFrame:
    """One row per key with a column per requested metric; an unknown name, or one whose inputs are absent, is null."""
    keys, have = list(keys), set(df.columns)
    aggs, joins = {}, []
    for name in names:
        if name in REGRESSION:
            aggs[name] = finite(REGRESSION[name]().cast("double"))
        elif name in QUANTILE and {"q10", "q50", "q90"} <= have:
            aggs[name] = finite(QUANTILE[name]().cast("double"))
        elif name == "f1_weighted":
            joins.append(f1_weighted(df, keys))
        elif name == "roc_auc" and score in have:
            joins.append(roc_auc(df, keys, score, sizing))
        else:
            aggs[name] = F.first(F.lit(None)).cast("double")
    rows = F.count(F.lit(1)).alias("__rows")
    out = df.groupBy(*keys).agg(rows, *[c.alias(n) for n, c in aggs.items()])
    for other in joins:
        out = out.join(other, keys, "left") if keys else attach_row(out, other)
    return out.select(*keys, *names)


def metrics_map(df: DataFrame, keys: Sequence[str], names: Sequence[str]) -> DataFrame:
    """Like ``compute_metrics`` with all metrics in one map column."""
    wide = compute_metrics(df, keys, names)
    pairs = [x for n in names for x in (F.lit(n), F.col(n))]
    return wide.select(*keys, F.create_map(*pairs).alias("metrics"))


def cv_aggregate(fold_metrics: DataFrame, keys: Sequence[str], value: str = "value") -> DataFrame:
    """Mean and median of a metric over folds."""
    return fold_metrics.groupBy(*keys).agg(F.avg(value).alias("mean"), F.median(value).alias("median"))
