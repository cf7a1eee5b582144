"""Hyper-parameter search on the frozen validation rows: seeded random candidates, trials run side by side."""

from __future__ import annotations

import math
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriesmill.functions.columns import quoted
from seriesmill.functions.metrics import compute_metrics
from seriesmill.operators import forest
from seriesmill.operators.models import REGRESSION, FittedModel, default_params, fit_model, numbered, training_context
from seriesmill.operators.moments import moments
from seriesmill.operators.protocol import HIGHER_IS_BETTER
from seriesmill.session import materialize

TRIAL_ROWS = 50_000

# Search spaces. ("int", low, high), ("float", low, high), ("log", low, high), ("choice", ...).
SPACES = {
    "XGBoost": {
        "n_estimators": ("int", 50, 500),
        "max_depth": ("int", 3, 15),
        "learning_rate": ("log", 0.01, 0.3),
        "subsample": ("float", 0.6, 1.0),
        "colsample_bytree": ("float", 0.6, 1.0),
        "reg_alpha": ("log", 1e-8, 10.0),
        "reg_lambda": ("log", 1e-8, 10.0),
    },
    "RandomForest": {
        "n_estimators": ("int", 50, 300),
        "max_depth": ("int", 5, 30),
        "min_samples_leaf": ("int", 1, 10),
        "max_features": ("choice", "sqrt", "log2", 0.5, 0.8),
        "bootstrap": ("choice", True, False),
    },
    "LinearModel": {"alpha": ("log", 1e-4, 100.0), "C": ("log", 1e-4, 100.0), "max_iter": ("int", 100, 2000)},
    "SVR": {
        "C": ("log", 1e-2, 1e3),
        "epsilon": ("log", 1e-3, 1.0),
        "kernel": ("choice", "rbf", "linear"),
        "gamma": ("choice", "scale", "auto"),
    },
    "DummyRegressor": {"strategy": ("choice", "mean", "median")},
}


def sample_space(name: str, n: int, seed: int = 42, space: dict | None = None) -> list[dict]:
    """``n`` parameter sets drawn from a model's space; the same seed draws the same sets."""
    rng = np.random.default_rng(seed)
    space = SPACES.get(name, {}) if space is None else space
    out = []
    for _ in range(n):
        params = {}
        for key, (kind, *bounds) in space.items():
            if kind == "int":
                params[key] = int(rng.integers(bounds[0], bounds[1] + 1))
            elif kind == "float":
                params[key] = float(rng.uniform(*bounds))
            elif kind == "log":
                params[key] = float(math.exp(rng.uniform(math.log(bounds[0]), math.log(bounds[1]))))
            else:
                params[key] = bounds[int(rng.integers(len(bounds)))]
        out.append(params)
    return out


def val_score(model: FittedModel, val: DataFrame, metric: str) -> float | None:
    """One metric on the validation rows; null when it is not finite."""
    needs_score = metric == "roc_auc"
    scored = model.predict(val, "y_pred", "y_score" if needs_score else None)
    truth = quoted(model.target) if model.labels is not None else quoted(model.target).cast("double")
    pred = scored.select(truth.alias("y_true"), "y_pred", *(["y_score"] if needs_score else []))
    value = compute_metrics(pred, [], [metric]).first()[metric]
    return value if value is not None and math.isfinite(value) else None


@dataclass
class SearchResult:
    best_params: dict
    best_score: float | None
    trials: list[dict]

    def table(self, spark) -> DataFrame:
        """(trial, params, score, error)."""
        rows = [(t["trial"], {k: str(v) for k, v in t["params"].items()}, t["score"], t["error"]) for t in self.trials]
        return spark.createDataFrame(rows, "trial int, params map<string,string>, score double, error string")


def tune(
    name: str,
    train: DataFrame,
    val: DataFrame,
    features: Sequence[str],
    target: str,
    metric: str,
    n_trials: int = 20,
    seed: int = 42,
    task: str = REGRESSION,
    space: dict | None = None,
    at_once: int | None = None,
    written: bool = False,
) -> SearchResult:
    """Best of ``n_trials`` random parameter sets on the validation rows; a failed trial scores worst.

    Trials run ``at_once`` (by default as many as keep all cores busy, 2 at least) as jobs of their own scheduler pools. What they have
    in common is found once: the moments of linear models, the binned rows, drawn sums and bin vectors of forests. Both parts are
    written once (unless ``written`` says that they are), in partitions of ``TRIAL_ROWS`` rows or more, and read by every trial: trees add up tables of statistics
    per partition, so many small partitions cost more than they spare, and small tables are parallel by trial.
    If no trial has a score, there are no best parameters.
    """
    higher = HIGHER_IS_BETTER.get(metric, False)
    worst = -math.inf if higher else math.inf
    context = training_context(train, features, target, task, seed)
    columns = [*dict.fromkeys([*features, target])]
    width = max(1, min(train.rdd.getNumPartitions(), -(-context.n // TRIAL_ROWS)))
    parts = [d.select(*columns).coalesce(width) for d in (train, val)]
    parts = parts if written else [materialize(d) for d in parts]
    parts[1].persist()  # every trial passes over them
    sc, sets = train.sparkSession.sparkContext, sample_space(name, n_trials, seed, space)
    try:
        if name == "RandomForest":  # all forests grow on the same binned rows
            held = forest.prepared(numbered(parts[0], target, context.labels) if context.labels else parts[0], features, target)
            context.extra["forest"] = held
            full = [{"bootstrap": True, **default_params(name), **p} for p in sets]
            held.trees = max((p["n_estimators"] for p in full if p["bootstrap"]), default=1)
            held.cover(parts[1])
        elif name == "LinearModel" and task == REGRESSION:
            found = moments(parts[0], columns)
            context.extra.update({"moments": found} if found else {})
    except Exception:  # noqa: BLE001, S110
        pass  # every trial meets the error itself and records it

    def trial(i: int, params: dict) -> dict:
        sc.setLocalProperty("spark.scheduler.pool", f"trial-{i}")
        score, error = None, None
        try:
            model = fit_model(parts[0], features, target, name, params, task, seed, context)
            score = val_score(model, parts[1], metric)
        except Exception as exc:  # noqa: BLE001
            error = str(exc)
        return {"trial": i, "params": params, "score": worst if score is None else score, "error": error}

    try:
        with ThreadPoolExecutor(at_once or max(2, sc.defaultParallelism // width)) as pool:
            # each thread takes over the caller's job group and description
            jobs = [pool.submit(inheritable_thread_target(train.sparkSession)(trial), i, p) for i, p in enumerate(sets)]
            trials = [j.result() for j in jobs]
    finally:
        parts[1].unpersist()
        if "forest" in context.extra:
            context.extra["forest"].free()
    best = (max if higher else min)(trials, key=lambda t: t["score"])
    if not math.isfinite(best["score"]):
        return SearchResult({}, None, trials)
    return SearchResult(best["params"], best["score"], trials)
