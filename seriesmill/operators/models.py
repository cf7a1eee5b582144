"""Estimators behind model names, fitting with isolation, scoring in one pass, importances.

Linear models train through MLlib, forests, boosted trees, kernel regression and ARIMA through modules of their own,
all on the cluster. Regularisation is scaled so that results equal those of the
usual single-node definitions (penalty on the sum of squares, not on the mean).
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from functools import reduce
from operator import add, or_

import numpy as np
from pyspark.ml import Estimator, Model, Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import StringIndexerModel, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import LinearRegression
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seriesmill.functions.columns import as_double, as_list, field_type, is_string, quoted
from seriesmill.operators import arima, boosting, forest, kernel, moments
from seriesmill.operators.boosting import Boosted
from seriesmill.operators.forest import Forest
from seriesmill.operators.kernel import KernelFit
from seriesmill.operators.quantiles import exact_quantiles
from seriesmill.session import materialize, parallelism

MAX_CLASSES = 10_000
CLASSIFICATION = "tabular_classification"
REGRESSION = "tabular_regression"

# Default hyper-parameters of each model.
DEFAULTS = {
    "DummyRegressor": {"strategy": "mean"},
    "DummyClassifier": {},
    "LinearModel": {"alpha": 1.0, "C": 1.0, "max_iter": 1000},
    "RandomForest": {"n_estimators": 100, "max_depth": 10, "min_samples_leaf": 2, "max_features": "sqrt"},
    "XGBoost": {
        "n_estimators": 100, "max_depth": 6, "learning_rate": 0.1, "subsample": 0.8, "colsample_bytree": 0.8, "reg_alpha": 0.0, "reg_lambda": 1.0,
    },
    "SVR": {"C": 1.0, "epsilon": 0.1, "kernel": "rbf", "gamma": "scale", "n_features": 64},
    "ARIMA": {"p": 1, "d": 1, "q": 1},
}


def default_params(name: str) -> dict:
    return dict(DEFAULTS.get(name, {}))


@dataclass
class Context:
    """What a factory may need to know about the training rows."""

    features: list[str]
    target: str
    task: str = REGRESSION
    n: int = 0
    y_std: float = 0.0
    n_classes: int = 2
    seed: int = 42
    labels: list[str] | None = None  # classes of a text target, in order; their numbers are what models learn
    extra: dict = field(default_factory=dict)  # what fits over the same rows share


# ---------------------------------------------------------------- constant models


def dummy_value(train: DataFrame, target: str, strategy: str = "mean") -> float | None:
    """The constant that a baseline regressor predicts."""
    if strategy == "median":
        return exact_quantiles(train, [target], [0.5])[target][0.5]
    if strategy != "mean":
        raise ValueError("strategy must be 'mean' or 'median'")
    return train.agg(F.avg(as_double(train, target))).first()[0]


def dummy_regressor(df: DataFrame, target: str, strategy: str = "mean") -> DataFrame:
    """Adds ``y_pred``: mean or median of the target over the rows with split = 'train'."""
    return df.withColumn("y_pred", F.lit(dummy_value(df.filter("split = 'train'"), target, strategy)).cast("double"))


def majority_class(train: DataFrame, target: str):
    """Most frequent class; the smallest one on a tie."""
    counts = train.filter(quoted(target).isNotNull()).groupBy(quoted(target).alias("c")).agg(F.count(F.lit(1)).alias("n"))
    top = counts.agg(F.min(F.struct((-F.col("n")).alias("m"), "c")).alias("top")).first()["top"]
    return None if top is None else top["c"]


def dummy_classifier(df: DataFrame, target: str) -> DataFrame:
    """Adds ``y_pred``: the most frequent class of the rows with split = 'train'."""
    value = majority_class(df.filter("split = 'train'"), target)
    return df.withColumn("y_pred", F.lit(value).cast(df.schema[target].dataType))


# ---------------------------------------------------------------- estimators


def assembler(features: Sequence[str]) -> VectorAssembler:
    return VectorAssembler(inputCols=list(features), outputCol="features", handleInvalid="error")


def _linear(params: dict, ctx: Context) -> Estimator:
    if ctx.task == CLASSIFICATION:
        return LogisticRegression(
            labelCol=ctx.target,
            regParam=1.0 / (params["C"] * max(1, ctx.n)),
            elasticNetParam=0.0,
            standardization=False,
            maxIter=params["max_iter"],
            tol=1e-8,
        )
    # MLlib minimises the mean squared error of the target divided by its deviation
    scale = params["alpha"] * ctx.y_std / max(1, ctx.n)
    solver = "normal" if len(ctx.features) <= 4096 else "l-bfgs"
    return LinearRegression(
        labelCol=ctx.target, regParam=scale, elasticNetParam=0.0, standardization=False, solver=solver
    )


Factory = Callable[[dict, Context], Estimator]
_REGISTRY: dict[str, Factory] = {"LinearModel": _linear}


def register_model(name: str, factory: Factory, defaults: dict | None = None) -> None:
    """Adds a model; ``factory(params, context)`` returns an MLlib estimator over the column ``features``."""
    _REGISTRY[name] = factory
    if defaults is not None:
        DEFAULTS[name] = dict(defaults)


def available_models() -> list[str]:
    return sorted({*_REGISTRY, "DummyRegressor", "DummyClassifier", "SVR", "ARIMA", "XGBoost", "RandomForest"})


def class_labels(train: DataFrame, target: str) -> list[str]:
    """The classes of a text target in order, at most ``MAX_CLASSES``."""
    found = train.select(quoted(target).alias("c")).filter("c IS NOT NULL").distinct().limit(MAX_CLASSES + 1).collect()
    if len(found) > MAX_CLASSES:
        raise ValueError(f"{target} has more than {MAX_CLASSES} classes")
    return sorted((r["c"] for r in found), key=lambda c: c.encode())


def training_context(
    train: DataFrame, features: Sequence[str], target: str, task: str = REGRESSION, seed: int = 42
) -> Context:
    if is_string(field_type(train, target)):
        labels = class_labels(train, target)
        return Context(list(features), target, task, train.filter(quoted(target).isNotNull()).count(), 0.0, len(labels), seed, labels)
    row = train.agg(
        F.count(quoted(target)), F.stddev_pop(as_double(train, target)), F.max(as_double(train, target))
    ).first()
    classes = int(row[2]) + 1 if task == CLASSIFICATION and row[2] is not None else 2
    return Context(list(features), target, task, row[0], row[1] or 0.0, classes, seed)


def numbered(df: DataFrame, target: str, labels: list[str]) -> DataFrame:
    """The text target as the number of its class; rows of other classes are left out."""
    index = StringIndexerModel.from_labels(labels, inputCol=target, outputCol="__class", handleInvalid="skip")
    out = index.transform(df)
    return out.select(*[F.col("__class").alias(c) if c == target else quoted(c) for c in df.columns])


def stable_partitions(df: DataFrame, key: str | Sequence[str], n: int | None = None) -> DataFrame:
    """Same rows in the same partitions in the same order, whatever the input layout: seeded trees repeat exactly."""
    keys = [quoted(k) for k in as_list(key)]
    return df.repartition(n or parallelism(df.sparkSession), *keys).sortWithinPartitions(*keys)


@dataclass
class FittedModel:
    """A fitted model by name: an MLlib model, or a constant."""

    name: str
    target: str
    features: list[str]
    model: Model | None = None
    constant: object = None
    params: dict = field(default_factory=dict)
    score_col: str | None = None
    labels: list[str] | None = None

    def predict(self, df: DataFrame, out: str = "y_pred", score: str | None = None) -> DataFrame:
        """Adds the prediction (text where the target is text) and, for binary classifiers, the score of the positive class."""
        if self.model is None:
            value = F.lit(self.constant) if self.labels is not None else F.lit(self.constant).cast("double")
            done = df.withColumn(out, value)
            return done.withColumn(score, F.lit(0.5)) if score else done
        scored = self.model.transform(df)
        cols = [self.named(F.col("prediction").cast("double")).alias(out)]
        if score:
            has = "probability" in scored.columns
            cols.append((vector_to_array("probability")[1] if has else F.lit(None).cast("double")).alias(score))
        return scored.select(*[quoted(c) for c in df.columns], *cols)

    def named(self, number: Column) -> Column:
        return number if self.labels is None else F.get(F.array(*map(F.lit, self.labels)), number.cast("int"))


@dataclass
class BoostedModel(FittedModel):
    """Second-order boosted trees; see ``boosting``."""

    boosted: Boosted | None = None

    def predict(self, df: DataFrame, out: str = "y_pred", score: str | None = None) -> DataFrame:
        done = self.probabilities(df, "__p")
        p = F.col("__p")
        if self.boosted.loss == boosting.SQUARED:
            value, second = p[0], F.lit(None).cast("double")
        else:
            value, second = self.named((F.array_position(p, F.array_max(p)) - 1).cast("double")), p[1]
        cols = [value.alias(out), *([second.alias(score)] if score else [])]
        return done.select(*[quoted(c) for c in df.columns], *cols)

    def probabilities(self, df: DataFrame, out: str = "y_scores") -> DataFrame:
        """Adds the probability of every class (the prediction itself for numbers) as an array."""
        return df.withColumn(out, self.boosted.column(df))


@dataclass
class ForestModel(FittedModel):
    """A random forest; see ``forest``."""

    forest: Forest | None = None

    def predict(self, df: DataFrame, out: str = "y_pred", score: str | None = None) -> DataFrame:
        done, p = df.withColumn("__p", self.forest.column(df)), F.col("__p")
        if not self.forest.n_classes:
            value, second = p[0], F.lit(None).cast("double")
        else:
            value, second = self.named((F.array_position(p, F.array_max(p)) - 1).cast("double")), F.get(p, F.lit(1))
        return done.select(*[quoted(c) for c in df.columns], value.alias(out), *([second.alias(score)] if score else []))


@dataclass
class LinearFit(FittedModel):
    """A linear regression that predicts by an expression in place of vectors; a missing feature is an error as it is there."""

    def predict(self, df: DataFrame, out: str = "y_pred", score: str | None = None) -> DataFrame:
        inner, x = self.model.stages[-1], [as_double(df, f) for f in self.features]
        value = reduce(add, [F.lit(float(c)) * v for c, v in zip(inner.coefficients, x)]) + F.lit(float(inner.intercept))
        gone = reduce(or_, [v.isNull() for v in x])
        done = F.when(gone, F.raise_error(F.lit("a feature is missing")).cast("double")).otherwise(value)
        return df.select(*[quoted(c) for c in df.columns], done.alias(out), *([F.lit(None).cast("double").alias(score)] if score else []))


@dataclass
class ArimaModel(FittedModel):
    """One ARIMA fit per series; predicts rows that follow the training rows in order."""

    fitted: DataFrame | None = None
    order_by: list[str] = field(default_factory=list)
    series: list[str] = field(default_factory=list)

    def predict(self, df: DataFrame, out: str = "y_pred", score: str | None = None) -> DataFrame:
        done = arima.forecast_rows(self.fitted, df, self.order_by, self.series, out)
        return done.withColumn(score, F.lit(None).cast("double")) if score else done


def fit_model(
    train: DataFrame,
    features: Sequence[str],
    target: str,
    name: str,
    params: dict | None = None,
    task: str = REGRESSION,
    seed: int = 42,
    context: Context | None = None,
    order_by: str | Sequence[str] | None = None,
    series: str | Sequence[str] | None = None,
) -> FittedModel:
    """Fits one registered model on ``train``. ARIMA also needs ``order_by`` and, for many series, ``series``."""
    full = {**default_params(name), **(params or {})}
    if name == "ARIMA":
        return _fit_arima(train, target, full, as_list(order_by), as_list(series))
    text = is_string(field_type(train, target))
    labels = (context.labels if context and context.labels else class_labels(train, target)) if text else None
    if name == "DummyClassifier":
        return FittedModel(name, target, list(features), None, majority_class(train, target), full, None, labels)
    if text and task != CLASSIFICATION:
        raise ValueError(f"{target} is text: only classification can predict it")
    if name == "DummyRegressor":
        return FittedModel(name, target, list(features), None, dummy_value(train, target, full["strategy"]), full)
    if name == "SVR":
        return _fit_kernel(train, features, target, full, seed)
    if name not in available_models():
        raise ValueError(f"unknown model {name!r}; available: {available_models()}")
    if context is not None and "moments" in context.extra and name == "LinearModel" and task == REGRESSION and _REGISTRY[name] is _linear:
        estimator = _linear(full, context).setWeightCol(moments.WEIGHT)  # by normal equations, which need no more of the rows
        model = Pipeline(stages=[assembler(features), estimator]).fit(context.extra["moments"].rows(train.sparkSession))
        return LinearFit(name, target, list(features), model, None, full)
    # models pass over the rows many times; what an executor loses is computed again
    rows = train.select(*dict.fromkeys([*features, target]))
    rows = (numbered(rows, target, labels) if text else rows).persist()
    try:
        ctx = context or training_context(rows, features, target, task, seed)
        if name == "XGBoost":
            return _fit_boosted(rows, ctx, full, labels)
        if name == "RandomForest":
            return _fit_forest(rows, ctx, full, labels)
        pipeline = Pipeline(stages=[assembler(features), _REGISTRY[name](full, ctx)])
        return FittedModel(name, target, list(features), pipeline.fit(rows), None, full, None, labels)
    finally:
        rows.unpersist()


def _fit_boosted(rows: DataFrame, ctx: Context, params: dict, labels: list[str] | None) -> BoostedModel:
    many = ctx.n_classes > 2
    loss = boosting.SQUARED if ctx.task != CLASSIFICATION else boosting.SOFTMAX if many else boosting.LOGISTIC
    known = {k: v for k, v in params.items() if k in boosting.Settings.__dataclass_fields__}
    made = boosting.fit(rows, ctx.features, ctx.target, loss, ctx.n_classes, boosting.Settings(**{"seed": ctx.seed, **known}))
    return BoostedModel("XGBoost", ctx.target, list(ctx.features), None, None, params, None, labels, made)


def _fit_forest(rows: DataFrame, ctx: Context, params: dict, labels: list[str] | None) -> ForestModel:
    known = {k: v for k, v in params.items() if k in forest.Settings.__dataclass_fields__}
    classes = ctx.n_classes if ctx.task == CLASSIFICATION else 0
    made = forest.fit(rows, ctx.features, ctx.target, classes, forest.Settings(**{"seed": ctx.seed, **known}), ctx.extra.get("forest"))
    return ForestModel("RandomForest", ctx.target, list(ctx.features), None, None, params, None, labels, made)


def _fit_arima(train: DataFrame, target: str, params: dict, order_by: list[str], series: list[str]) -> ArimaModel:
    if not order_by:
        raise ValueError("ARIMA needs the columns that order the rows: order_by")
    order = tuple(int(params[k]) for k in "pdq")
    fitted = materialize(arima.fit(train, target, order_by, series, order))  # one row per series
    return ArimaModel("ARIMA", target, [], None, None, params, None, None, fitted, order_by, series)


def ridge(df: DataFrame, features: Sequence[str], y: str, alpha: float = 1.0) -> FittedModel:
    return fit_model(df, features, y, "LinearModel", {"alpha": alpha})


def logistic(df: DataFrame, features: Sequence[str], y: str, C: float = 1.0, max_iter: int = 1000) -> FittedModel:  # noqa: N803
    return fit_model(df, features, y, "LinearModel", {"C": C, "max_iter": max_iter}, CLASSIFICATION)


def random_forest(df, features, y, task: str = REGRESSION, seed: int = 42, **params) -> FittedModel:
    return fit_model(df, features, y, "RandomForest", params, task, seed)


def gbt(df, features, y, task: str = REGRESSION, seed: int = 42, **params) -> FittedModel:
    return fit_model(df, features, y, "XGBoost", params, task, seed)


def linear_coefficients(fitted: FittedModel, spark: SparkSession) -> DataFrame:
    """(term, value): intercept and coefficients of a linear model."""
    inner = fitted.model.stages[-1]
    rows = [("intercept", float(inner.intercept))]
    rows += [(f, float(c)) for f, c in zip(fitted.features, inner.coefficients)]
    return spark.createDataFrame(rows, "term string, value double")


# ---------------------------------------------------------------- kernel regression


@dataclass
class KernelModel(FittedModel):
    """Epsilon-insensitive regression over random features; see ``kernel``."""

    kernel: KernelFit | None = None

    def predict(self, df: DataFrame, out: str = "y_pred", score: str | None = None) -> DataFrame:
        extra = [F.lit(None).cast("double").alias(score)] if score else []
        return df.select(*[quoted(c) for c in df.columns], self.kernel.prediction().alias(out), *extra)


def _gamma(train: DataFrame, features: Sequence[str], gamma) -> float:
    d = len(features)
    if gamma == "auto":
        return 1.0 / d
    if gamma != "scale":
        return float(gamma)
    sums = [(F.avg(as_double(train, f)), F.avg(as_double(train, f) * as_double(train, f))) for f in features]
    row = train.agg(*[c for pair in sums for c in pair]).first()
    mean = sum(row[2 * i] for i in range(d)) / d
    var = sum(row[2 * i + 1] for i in range(d)) / d - mean * mean
    return 1.0 / (d * var) if var > 0 else 1.0


def _fit_kernel(train: DataFrame, features, target: str, params: dict, seed: int) -> KernelModel:
    rows = train.select(*dict.fromkeys([*features, target])).persist()  # passed over until the objective stands still
    try:
        if params["kernel"] not in ("rbf", "linear"):
            raise ValueError("kernel must be 'rbf' or 'linear'")
        gamma = _gamma(rows, features, params["gamma"]) if params["kernel"] == "rbf" else None
        made = kernel.fit(rows, features, target, params["C"], params["epsilon"], gamma, params["n_features"], seed)
    finally:
        rows.unpersist()
    return KernelModel("SVR", target, list(features), None, None, params, None, None, made)


def kernel_regression(df, features, y, gamma="scale", D: int = 64, seed: int = 42, **params) -> FittedModel:  # noqa: N803
    return fit_model(df, features, y, "SVR", {**params, "gamma": gamma, "n_features": D}, seed=seed)


# ---------------------------------------------------------------- many models


@dataclass
class FitReport:
    models: dict[str, FittedModel]
    records: list[dict]

    @property
    def status(self) -> str:
        if not self.models:
            return "failed"
        return "completed" if len(self.models) == len(self.records) else "partial_failure"


def fit_all(
    train: DataFrame,
    features: Sequence[str],
    target: str,
    models: dict[str, dict | None],
    task: str = REGRESSION,
    seed: int = 42,
    order_by: str | Sequence[str] | None = None,
    series: str | Sequence[str] | None = None,
) -> FitReport:
    """Fits ``{name: params}``; a model that fails is recorded and does not stop the others.

    ``order_by`` and ``series`` are for models of time series. Classes may be text. Every model passes over the rows several
    times, so what they need is written once, in the partitions and the order it has.
    """
    train = materialize(train.select(*map(quoted, dict.fromkeys([*features, target, *as_list(order_by), *as_list(series)]))))
    context = training_context(train, features, target, task, seed)
    fitted, records = {}, []
    for name, params in models.items():
        start, error = time.time(), None
        try:
            fitted[name] = fit_model(train, features, target, name, params, task, seed, context, order_by, series)
        except Exception as exc:  # noqa: BLE001
            error = str(exc)
        records.append(
            {
                "model": name,
                "status": "failed" if error else "success",
                "hyperparameters": {**default_params(name), **(params or {})},
                "training_duration_seconds": round(time.time() - start, 4),
                "error": error,
            }
        )
    return FitReport(fitted, records)


def score_all(
    models: dict[str, FittedModel], test: DataFrame, key: str | Sequence[str], target: str, run_id: str = "run", scores: bool = False
) -> DataFrame:
    """Long predictions (run_id, model, key, y_true, y_pred[, y_score]); all models score the rows in one pass."""
    keys = as_list(key)
    if any(isinstance(m, ArimaModel) for m in models.values()):  # places in the order take passes of their own
        need = [c for m in models.values() for c in [*m.features, *(m.order_by + m.series if isinstance(m, ArimaModel) else [])]]
        test = materialize(test.select(*map(quoted, dict.fromkeys([*keys, target, *need]))))
    wide, parts = test, []
    for i, (name, model) in enumerate(models.items()):
        wide = model.predict(wide, f"__p{i}", f"__s{i}" if scores else None)
        cell = [F.lit(name).alias("model"), F.col(f"__p{i}").alias("y_pred")]
        parts.append(F.struct(*cell, *([F.col(f"__s{i}").alias("y_score")] if scores else [])))
    text = any(m.labels is not None for m in models.values())
    y = (quoted(target) if text else quoted(target).cast("double")).alias("y_true")
    long = wide.select(*[quoted(k) for k in keys], y, F.inline(F.array(*parts)))
    return long.select(F.lit(run_id).alias("run_id"), "model", *keys, "y_true", "y_pred", *(["y_score"] if scores else []))


def feature_importance(fitted: FittedModel, spark: SparkSession) -> DataFrame:
    """(feature, importance), largest first; they sum to 1 where a tree has split at all."""
    if isinstance(fitted, BoostedModel):
        values = fitted.boosted.gains
    else:
        values = fitted.forest.gains if isinstance(fitted, ForestModel) else fitted.model.stages[-1].featureImportances.toArray()
    rows = sorted(zip(fitted.features, map(float, values)), key=lambda r: (-r[1], r[0]))
    return spark.createDataFrame(rows, "feature string, importance double")


def gbt_history(fitted: BoostedModel, train: DataFrame, val: DataFrame | None = None) -> DataFrame:
    """(round, part, loss): squared error (log loss for classes) after every boosting round; one pass per part."""
    rows = []
    for part, df in (("train", train), ("val", val)):
        if df is not None:
            data = df if fitted.labels is None else numbered(df, fitted.target, fitted.labels)
            rows += [(i, part, float(v)) for i, v in enumerate(fitted.boosted.history(data, fitted.target), 1)]
    return train.sparkSession.createDataFrame(rows, "round int, part string, loss double")


_META = "kind string, name string, target string, features array<string>, params string, labels array<string>, content string"


def save_model(fitted: FittedModel, path: str) -> None:
    """Saves any fitted model: what it needs besides an MLlib pipeline, trees or a table of series is one JSON row."""
    kind, content = "mllib", {}
    if isinstance(fitted, BoostedModel):
        kind, content = "boosted", boosting.to_dict(fitted.boosted)
    elif isinstance(fitted, KernelModel):
        k, lists = fitted.kernel, lambda x: None if x is None else x.tolist()
        kind, content = "kernel", {"weights": lists(k.weights), "shifts": lists(k.shifts), "coef": lists(k.coef), "intercept": k.intercept, "objective": k.objective, "passes": k.passes}
    elif isinstance(fitted, ForestModel):
        kind, content = "forest", {"edges": [e.tolist() for e in fitted.forest.edges], "n_classes": fitted.forest.n_classes}
        trees = [(i, *(bytearray(getattr(t, c).tobytes()) for c in forest.ARRAYS), t.depth) for i, t in enumerate(fitted.forest.trees)]
        SparkSession.getActiveSession().createDataFrame(trees, forest.TREES).write.mode("overwrite").parquet(path + "/trees")
    elif isinstance(fitted, ArimaModel):
        kind, content = "arima", {"order_by": fitted.order_by, "series": fitted.series}
        fitted.fitted.write.mode("overwrite").parquet(path + "/fits")
    elif fitted.model is None:
        kind, content = "constant", {"value": fitted.constant}
    else:
        fitted.model.write().overwrite().save(path + "/model")
    meta = [(kind, fitted.name, fitted.target, fitted.features, json.dumps(fitted.params), fitted.labels, json.dumps(content))]
    SparkSession.getActiveSession().createDataFrame(meta, _META).write.mode("overwrite").json(path + "/meta")


def load_model(spark: SparkSession, path: str) -> FittedModel:
    """A saved model; it predicts as the one that was saved."""
    meta = spark.read.schema(_META).json(path + "/meta").first()
    own = (meta["name"], meta["target"], meta["features"])
    params, labels, content = json.loads(meta["params"]), meta["labels"], json.loads(meta["content"])
    if meta["kind"] == "boosted":
        return BoostedModel(*own, None, None, params, None, labels, boosting.from_dict(content))
    if meta["kind"] == "forest":
        rows = spark.read.parquet(path + "/trees").orderBy("tree").collect()  # the model
        trees = [forest.from_row(r, max(1, content["n_classes"])) for r in rows]
        made = Forest(meta["features"], [np.array(e, np.float64) for e in content["edges"]], content["n_classes"], trees)
        return ForestModel(*own, None, None, params, None, labels, made)
    if meta["kind"] == "kernel":
        arrays = {c: None if content[c] is None else np.array(content[c]) for c in ("weights", "shifts", "coef")}
        made = KernelFit(meta["features"], *arrays.values(), content["intercept"], content["objective"], content["passes"])
        return KernelModel(*own, None, None, params, None, labels, made)
    if meta["kind"] == "arima":
        return ArimaModel(*own, None, None, params, None, labels, spark.read.parquet(path + "/fits"), content["order_by"], content["series"])
    if meta["kind"] == "constant":
        return FittedModel(*own, None, content["value"], params, None, labels)
    return FittedModel(*own, PipelineModel.load(path + "/model"), None, params, None, labels)


# ---------------------------------------------------------------- model selection

TIERS = ("baseline", "classical", "specialized")

# Which models each task prefers per tier, and the catalog of known models.
PREFERENCES = {
    "tabular_regression": {
        "baseline": ["DummyRegressor", "LinearModel"],
        "classical": ["XGBoost", "LightGBM", "RandomForest", "SVR"],
        "specialized": ["SVR", "RandomForest"],
    },
    "tabular_classification": {
        "baseline": ["DummyClassifier", "LinearModel"],
        "classical": ["XGBoost", "LightGBM", "RandomForest"],
        "specialized": ["RandomForest", "LightGBM"],
    },
    "time_series_forecasting": {
        "baseline": ["ARIMA", "DummyRegressor"],
        "classical": ["XGBoost", "RandomForest"],
        "specialized": ["Chronos", "LSTM", "ARIMA"],
    },
}
_ALL = ["tabular_regression", "tabular_classification", "time_series_forecasting"]
CATALOG = [
    # name, tier, compatible tasks, available, univariate only
    ("DummyRegressor", "baseline", ["tabular_regression", "time_series_forecasting"], True, False),
    ("DummyClassifier", "baseline", ["tabular_classification"], True, False),
    ("LinearModel", "baseline", ["tabular_regression", "tabular_classification"], True, False),
    ("RandomForest", "classical", _ALL, True, False),
    ("XGBoost", "classical", _ALL, True, False),
    ("LightGBM", "classical", _ALL, False, False),
    ("ARIMA", "specialized", ["time_series_forecasting"], True, True),
    ("LSTM", "specialized", ["time_series_forecasting"], True, False),
    ("Chronos", "specialized", ["time_series_forecasting"], False, False),
    ("SVR", "specialized", ["tabular_regression"], True, False),
]


def model_catalog(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        CATALOG, "model string, tier string, tasks array<string>, available boolean, univariate_only boolean"
    )


def judge_models(tasks: DataFrame, catalog: DataFrame, registered: Sequence[str] | None = None) -> DataFrame:
    """(table_name, model, tier, rejection): every catalog model against every task; null rejection = usable.

    Grouped prediction follows the rules of regression.
    """
    known = available_models() if registered is None else list(registered)
    task = F.when(F.col("task_type") == "grouped_prediction", "tabular_regression").otherwise(F.col("task_type"))
    many = F.coalesce(F.col("is_multivariate_ts"), F.lit(False))
    entries = [
        F.struct(
            F.lit(m["model"]).alias("model"),
            F.lit(m["tier"]).alias("tier"),
            F.array(*[F.lit(t) for t in m["tasks"]]).alias("tasks"),
            F.lit(m["available"]).alias("available"),
            F.lit(m["univariate_only"]).alias("univariate_only"),
        )
        for m in catalog.collect()  # a handful of models
    ]
    pairs = tasks.select("table_name", task.alias("task"), many.alias("many"), F.inline(F.array(*entries)))
    why = (
        F.when(~F.array_contains("tasks", F.col("task")), "task not supported")
        .when(~F.col("available"), "marked as not available")
        .when(~F.col("model").isin(known), "not registered")
        .when(F.col("many") & F.col("univariate_only"), "univariate only")
    )
    return pairs.select("table_name", "task", "model", "tier", why.alias("rejection"))


def pick_three(task: str, usable: dict[str, set[str]]) -> list[tuple[str, str, str]]:
    """(tier, model, substituted for): the first preferred model of each tier, or one borrowed from another tier."""
    prefs, taken, out = PREFERENCES[task], set(), []
    for tier in TIERS:
        own = [m for m in prefs[tier] if m in usable[tier] and m not in taken]
        lent = []
        for other in TIERS:
            if other != tier:
                free = [m for m in prefs[other] if m in usable[other] and m not in taken]
                lent += free[:1]
        choice = own[:1] or lent[:1]
        if not choice:
            raise ValueError(f"MODEL_POOL_INSUFFICIENT: no {tier} model for {task}")
        taken.add(choice[0])
        out.append((tier, choice[0], prefs[tier][0] if choice[0] != prefs[tier][0] else ""))
    return out


def select_models(tasks: DataFrame, catalog: DataFrame | None = None, registered: Sequence[str] | None = None) -> DataFrame:
    """(table_name, tier, model, substituted_from): three models per table, one per tier."""
    catalog = model_catalog(tasks.sparkSession) if catalog is None else catalog
    judged = judge_models(tasks, catalog, registered)
    usable = judged.filter("rejection is null").groupBy("table_name", "task").agg(
        F.array_sort(F.collect_set(F.struct("tier", "model"))).alias("pool")
    )
    rows = []
    # few different pools exist: one per task type and variate flag
    for r in usable.select("task", "pool").distinct().collect():
        pools = {t: {p["model"] for p in r["pool"] if p["tier"] == t} for t in TIERS}
        rows += [(r["task"], [tuple(p) for p in r["pool"]], *pick) for pick in pick_three(r["task"], pools)]
    picks = tasks.sparkSession.createDataFrame(
        rows, "task string, pool array<struct<tier:string,model:string>>, tier string, model string, sub string"
    )
    out = usable.join(F.broadcast(picks), ["task", "pool"])  # three rows per distinct pool
    return out.select("table_name", "tier", "model", F.nullif(F.col("sub"), F.lit("")).alias("substituted_from"))
