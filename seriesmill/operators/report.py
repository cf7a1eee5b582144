"""Ranking, model cards, run logs and the data behind diagnostic charts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seriesmill.functions.columns import as_list, hash_order
from seriesmill.operators.joins import attach_row, lookup_join
from seriesmill.operators.ordering import Sizing, fit_layout
from seriesmill.operators.protocol import HIGHER_IS_BETTER

# Labels of the leaderboard.
BEST, STRONG, OTHER, ENSEMBLE = "Best Overall", "Strong Performer", "Baseline", "Ensemble"


def comparison_table(metrics: DataFrame, metric: str, run: str = "run_id") -> DataFrame:
    """Ranks the evaluated models of every run by one metric; models without a value are left out."""
    value = F.col(metric).cast("double")
    usable = metrics.filter(value.isNotNull())
    if "status" in metrics.columns:
        usable = usable.filter(F.col("status") == "evaluated")
    best_first = -value if HIGHER_IS_BETTER.get(metric, False) else value
    w = Window.partitionBy(run).orderBy(best_first, "model")  # the models of one run
    ranked = usable.withColumn("rank", F.row_number().over(w))
    extra = ["tier"] if "tier" in metrics.columns else []
    return ranked.select(run, "rank", "model", *extra, value.alias("value"), (F.col("rank") == 1).alias("is_best"))


def leaderboard(cmp: DataFrame, higher_is_better: bool, run: str = "run_id", ensemble: DataFrame | None = None) -> DataFrame:
    """Improvement of every model over the last ranked one, with a label by rank.

    ``ensemble`` (run, value) adds an unranked row per run.
    """
    worst = cmp.groupBy(run).agg(F.max_by("value", "rank").alias("__base"))
    board = cmp
    if ensemble is not None:
        extra = ensemble.select(
            run,
            F.lit(None).cast("int").alias("rank"),
            F.lit("Ensemble").alias("model"),
            F.lit("ensemble").alias("tier"),
            F.col("value").cast("double").alias("value"),
        )
        board = cmp.unionByName(extra, allowMissingColumns=True)
    joined = board.join(worst, run, "left")  # one row per run
    value, base = F.col("value"), F.col("__base")
    delta = F.coalesce(value - base if higher_is_better else base - value, F.lit(0.0))
    pct = F.coalesce(F.try_divide(delta, F.abs(base)) * 100.0, F.lit(0.0))
    label = (
        F.when(F.col("rank").isNull(), ENSEMBLE)
        .when(F.col("rank") == 1, BEST)
        .when(F.col("rank") == 2, STRONG)
        .otherwise(OTHER)
    )
    extra = ["tier"] if "tier" in board.columns else []
    return joined.select(
        run, "rank", "model", *extra, "value",
        F.round(delta, 6).alias("delta"), F.round(pct, 4).alias("delta_pct"), label.alias("recommendation"),
    )


def model_cards(evaluation: DataFrame, training: DataFrame, selection: DataFrame, ranking: DataFrame) -> DataFrame:
    """One card per evaluated model, with what is known about it from training, selection and ranking."""
    on = [c for c in ("run_id", "model") if all(c in d.columns for d in (evaluation, training, selection, ranking))]
    fresh = lambda d: d.select(*on, *[c for c in d.columns if c not in evaluation.columns])
    out = evaluation.join(fresh(training), on, "left").join(fresh(selection), on, "left")
    out = out.join(ranking.select(*on, "rank"), on, "left")
    return out.withColumn("is_recommended", F.coalesce(F.col("rank") == 1, F.lit(False)))


def stage_durations(stages: DataFrame) -> DataFrame:
    """Adds duration_seconds (3 places); null while a stage is open."""
    us = F.timestamp_diff("MICROSECOND", F.col("started_at"), F.col("completed_at"))
    return stages.withColumn("duration_seconds", F.round(us.cast("double") / 1e6, 3))


def stages_from_events(events: DataFrame, run: str, stage: str, kind: str, ts: str, start: str, end: str) -> DataFrame:
    """Pairs start and end events into one row per (run, stage)."""
    times = events.groupBy(run, stage).agg(
        F.min(F.when(F.col(kind) == start, F.col(ts))).alias("started_at"),
        F.max(F.when(F.col(kind) == end, F.col(ts))).alias("completed_at"),
    )
    status = F.when(F.col("completed_at").isNotNull(), "completed").when(F.col("started_at").isNotNull(), "running")
    return stage_durations(times.withColumn("status", status.otherwise("pending")))


def run_summary(stages: DataFrame, run: str = "run_id") -> DataFrame:
    """Stage statuses of every run as a map."""
    entries = F.map_from_entries(F.array_sort(F.collect_list(F.struct("stage", "status"))))
    return stages.groupBy(run).agg(entries.alias("stages"), F.count_if(F.col("status") == "completed").alias("completed"))


def missing_artifacts(expected: DataFrame, present: DataFrame, on: Sequence[str]) -> DataFrame:
    """Expected documents that are not there."""
    gone = expected.join(present, list(on), "left_anti")
    return gone.select(*on, F.lit(True).alias("missing"), F.lit("file not found").alias("reason"))


def ensemble(predictions: DataFrame, key: Sequence[str] | str, method: str = "mean", weights: DataFrame | None = None) -> DataFrame:
    """Combines the models' predictions per row: mean, median, or mean weighted by ``weights(model, weight)``."""
    keys = as_list(key)
    if method == "mean":
        out = F.avg("y_pred")
    elif method == "median":
        out = F.median("y_pred")
    elif method == "weighted":
        predictions = predictions.join(F.broadcast(weights), "model")  # one row per model
        out = F.try_divide(F.sum(F.col("weight") * F.col("y_pred")), F.sum("weight"))
    else:
        raise ValueError("method must be 'mean', 'median' or 'weighted'")
    return predictions.groupBy(*keys).agg(F.first("y_true").alias("y_true"), out.alias("y_pred"))


def ensemble_quantiles(predictions: DataFrame, key: Sequence[str] | str, qs: Sequence[str] = ("q10", "q50", "q90")) -> DataFrame:
    """Mean of each quantile; null (point forecast only) where any model lacks one of them."""
    whole = F.count_if(F.greatest(*[F.col(q).isNull().cast("int") for q in qs]) == 1) == 0
    return predictions.groupBy(*as_list(key)).agg(
        F.avg("y_pred").alias("y_pred"), *[F.when(whole, F.avg(q)).alias(q) for q in qs]
    )


# ---------------------------------------------------------------- chart data


def residual_histogram(pred: DataFrame, keys: Sequence[str] = ("model",)) -> DataFrame:
    """(keys, bin, low, high, count): min(30, max(5, n // 10)) equal bins over the residuals, empty bins included."""
    keys = list(keys)
    e = (F.col("y_true") - F.col("y_pred")).cast("double")
    span = pred.groupBy(*keys).agg(F.min(e).alias("lo"), F.max(e).alias("hi"), F.count(e).alias("n"))
    bins = F.least(F.lit(30), F.greatest(F.lit(5), F.floor(F.col("n") / 10))).cast("int")
    flat = F.col("hi") == F.col("lo")
    span = span.select(
        *keys,
        bins.alias("bins"),
        F.when(flat, F.col("lo") - 0.5).otherwise(F.col("lo")).alias("lo"),
        F.when(flat, F.col("hi") + 0.5).otherwise(F.col("hi")).alias("hi"),
        F.col("n").alias("__n"),
    )
    rows = pred.select(*keys, e.alias("e"))
    rows = lookup_join(rows, span, keys, "__n") if keys else attach_row(rows, span)
    b = F.least(F.floor((F.col("e") - F.col("lo")) / (F.col("hi") - F.col("lo")) * F.col("bins")) + 1, F.col("bins"))
    counts = rows.filter(F.col("e").isNotNull()).groupBy(*keys, b.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("count"))
    frame = span.select(*keys, "bins", "lo", "hi", F.explode(F.sequence(F.lit(1), F.col("bins"))).alias("bin"))
    width = (F.col("hi") - F.col("lo")) / F.col("bins")
    return frame.join(counts, [*keys, "bin"], "left").select(
        *keys,
        "bin",
        (F.col("lo") + width * (F.col("bin") - 1)).alias("low"),
        (F.col("lo") + width * F.col("bin")).alias("high"),
        F.coalesce("count", F.lit(0)).cast("bigint").alias("count"),
    )


def scatter_data(pred: DataFrame, n: int, key: str | Sequence[str], model: str = "model", seed: int = 42) -> DataFrame:
    """``n`` reproducibly chosen (y_true, y_pred) pairs per model; a chart shows a sample."""
    head, digest = hash_order(key, seed)
    rows = pred.select(model, *as_list(key), "y_true", "y_pred", head.alias("__h"), digest.alias("__d"))
    picked = fit_layout(rows, ["__h", "__d", *as_list(key)], [model]).first_rows(rows, n)
    return picked.select(model, *as_list(key), "y_true", "y_pred")


def identity_range(pred: DataFrame, model: str = "model") -> DataFrame:
    """Ends of the diagonal of an actual-against-predicted chart."""
    return pred.groupBy(model).agg(
        F.least(F.min("y_true"), F.min("y_pred")).alias("low"), F.greatest(F.max("y_true"), F.max("y_pred")).alias("high")
    )


def trace(pred: DataFrame, order_by: str | Sequence[str], n: int = 100, model: str = "model") -> DataFrame:
    """The first ``n`` steps of every model's predictions."""
    order = as_list(order_by)
    rows = pred.select(*dict.fromkeys([model, *order, "y_true", "y_pred"]))
    picked = fit_layout(rows, order, [model]).first_rows(rows, n, rank="step")
    return picked.select(model, "step", "y_true", "y_pred")


def confusion_matrix(pred: DataFrame, keys: Sequence[str] = ("model",), zeros: bool = True) -> DataFrame:
    """(keys, y_true, y_pred, n): all pairs of classes, or with ``zeros=False`` those that occur, for many classes."""
    keys = list(keys)
    counts = pred.groupBy(*keys, "y_true", "y_pred").agg(F.count(F.lit(1)).alias("n"))
    if not zeros:
        return counts
    both = counts.select(*keys, F.explode(F.array("y_true", "y_pred")).alias("c"))
    classes = both.groupBy(*keys).agg(F.collect_set("c").alias("cs"))  # as many entries as the matrix has rows
    cells = classes.select(*keys, "cs", F.explode("cs").alias("y_true")).select(*keys, "y_true", F.explode("cs").alias("y_pred"))
    out = cells.join(counts, [*keys, "y_true", "y_pred"], "left")
    return out.select(*keys, "y_true", "y_pred", F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))


def roc_curve(pred: DataFrame, keys: Sequence[str] = ("model",), score: str = "y_score", sizing: Sizing | None = None) -> DataFrame:
    """(keys, threshold, fpr, tpr): one point per distinct score, from the highest score down."""
    from seriesmill.functions.metrics import _score_counts

    keys = list(keys)
    counts = _score_counts(pred, keys, score).withColumn("__down", -F.col("score"))
    layout = fit_layout(counts, ["__down"], keys or None, 0, sizing)
    points = layout.running_sum(counts, {"tp": "pos", "fp": "neg"})
    totals = counts.groupBy(*keys).agg(
        F.sum("pos").alias("P"), F.sum("neg").alias("N"), F.count(F.lit(1)).alias("__n")
    )
    out = lookup_join(points, totals, keys, "__n") if keys else attach_row(points, totals)
    return out.select(
        *keys,
        F.col("score").alias("threshold"),
        F.try_divide(F.col("fp").cast("double"), F.col("N")).alias("fpr"),
        F.try_divide(F.col("tp").cast("double"), F.col("P")).alias("tpr"),
    )


def chart_data(cmp: DataFrame, run: str = "run_id") -> DataFrame:
    """Bars of the comparison chart: models that have a value."""
    return cmp.filter(F.col("value").isNotNull()).select(run, "model", "value")
