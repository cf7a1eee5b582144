"""A table to a ranking of models in one call: profile, task, plan, protocol, selection, fit, score, rank.

Every stage works on what the earlier ones found. What reaches the driver is small and of fixed size: one row per column
(profile), one row per table (task, protocol), a few models. The prepared table is written once and every model reads it.

Outcomes: ``completed``; ``partial_failure`` (some models failed, the others are ranked); ``failed`` (a guard of the task,
a stage or all models failed). Stages before a failure keep their results, those after it are ``skipped``. Rows without a
target value take part in the transforms, but are neither learned from nor scored; an empty table is a failed run.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from seriesmill.functions.columns import as_list, field_type, is_string, missing, numeric_columns
from seriesmill.functions.metrics import compute_metrics
from seriesmill.operators.models import FitReport, REGRESSION, fit_all, score_all, select_models
from seriesmill.operators.profile import profile
from seriesmill.operators.protocol import HIGHER_IS_BETTER, eval_protocol
from seriesmill.operators.report import comparison_table, leaderboard
from seriesmill.operators.split import Fractions, split, split_info
from seriesmill.operators.task import task_spec
from seriesmill.plans.plan import Audit, Step, Task, apply_plan, default_plan
from seriesmill.session import materialize

# The stages in their order.
STAGES = (
    "ingestion", "problem_classification", "preprocessing_planning", "evaluation_protocol", "model_selection", "training", "evaluation",
)
ENCODED_CLASSES = 1000  # text columns with more values are not features of the plan that is made here


@dataclass
class Flow:
    """What every stage found; a result is None where its stage was not reached."""

    run_id: str
    status: str = "failed"
    stages: dict[str, tuple[str, str | None]] = field(default_factory=lambda: {s: ("skipped", None) for s in STAGES})
    profile: DataFrame | None = None
    spec: Row | None = None
    plan: list[Step] | None = None
    audit: Audit | None = None
    protocol: Row | None = None
    parts: DataFrame | None = None
    selection: list[Row] | None = None
    report: FitReport | None = None
    predictions: DataFrame | None = None
    metrics: DataFrame | None = None
    ranking: DataFrame | None = None

    def stage_table(self, spark: SparkSession) -> DataFrame:
        rows = [(self.run_id, i, s, *self.stages[s]) for i, s in enumerate(STAGES, 1)]
        return spark.createDataFrame(rows, "run_id string, ordinal int, stage string, status string, error string")


def _plan(task: Task, prof: Sequence[Row]) -> list[Step]:
    """The default plan; a table's text columns of few values are numbered first."""
    own = task.protected | set(task.keep)
    plan = default_plan(task, [r["name"] for r in prof if r["inferred_type"] == "numeric" and r["name"] not in own])
    text = [r["name"] for r in prof if r["inferred_type"] == "categorical" and r["name"] not in own and 2 <= r["unique_count"] <= ENCODED_CLASSES]
    if task.modality == "time_series" or not text:
        return plan
    later = [replace(s, order=s.order + 1) for s in plan[1:]]
    return [plan[0], Step(2, "label_encode", {}, text), *later]


def run_flow(
    df: DataFrame,
    key: str | Sequence[str],
    table_name: str = "table",
    hints: DataFrame | None = None,
    plan: Sequence[Step] | None = None,
    params: dict[str, dict] | None = None,
    models: Sequence[str] | None = None,
    seed: int = 42,
    run_id: str | None = None,
) -> Flow:
    """Runs all stages on ``df``, whose rows ``key`` tells apart.

    ``hints`` (see ``profile_hints``) may name the target; ``plan`` replaces the default one; ``params`` gives
    hyper-parameters by model; ``models`` replaces the three selected ones.
    """
    flow, spark, keys = Flow(run_id or table_name), df.sparkSession, as_list(key)

    def ingestion() -> None:
        prof = profile(df, keys, table_name)
        flow.profile = spark.createDataFrame(prof.collect(), prof.schema)  # one row per column of the table

    def classification() -> None:
        facts = flow.profile.filter(~F.col("name").isin(keys))  # a key is neither target nor group
        flow.spec = task_spec(facts, hints).first()
        if flow.spec is None or flow.spec["error_code"]:
            raise ValueError("TARGET_NOT_FOUND" if flow.spec is None else flow.spec["error_code"])

    def tasks() -> DataFrame:
        return _one(spark, flow.spec, flow.profile.first()["num_rows"])

    def planning() -> None:
        s = flow.spec
        task = Task(s["target_col"], s["modality"], s["time_col"], s["group_col"], tuple(_order()), tuple(keys))
        flow.plan = list(plan) if plan is not None else _plan(task, flow.profile.collect())
        ready, flow.audit = apply_plan(df, flow.plan, task)
        flow.parts = ready  # the protocol cuts it

    def _order() -> list[str]:
        return list(dict.fromkeys([*([flow.spec["time_col"]] if flow.spec["time_col"] else []), *keys]))

    def protocol() -> None:
        p = flow.protocol = eval_protocol(tasks()).first()
        shares = Fractions(p["train_fraction"], round(1 - p["train_fraction"] - p["test_fraction"], 6), p["test_fraction"])
        options = {"target": p["target_col"], "time_col": p["time_col"], "group_col": p["group_col"]}
        known = flow.parts.filter(~missing(flow.parts, p["target_col"]))
        flow.parts = materialize(split(known, p["split_strategy"], keys, shares, seed, **options))
        split_info(flow.parts, min(p["minimum_test_samples"], max(1, int(p["num_rows"] * p["test_fraction"]))))

    def selection() -> None:
        flow.selection = select_models(tasks()).collect()  # three models

    def training() -> None:
        s, chosen = flow.spec, list(models) if models is not None else [r["model"] for r in flow.selection]
        usable = set(numeric_columns(flow.parts))
        features = [c for c in flow.audit.feature_columns if c in usable and c != s["target_col"]]
        named = {m: (params or {}).get(m) for m in chosen}
        task = s["task_type"] if s["classification_subtype"] else REGRESSION
        series = [s["group_col"]] if s["group_col"] else None
        train = flow.parts.filter("split = 'train'")
        flow.report = fit_all(train, features, s["target_col"], named, task, seed, _order(), series)
        if not flow.report.models:
            raise RuntimeError("ALL_MODELS_FAILED: " + "; ".join(f"{r['model']}: {r['error']}" for r in flow.report.records))

    def evaluation() -> None:
        p, target = flow.protocol, flow.spec["target_col"]
        classes = flow.spec["classification_subtype"] is not None
        rows = score_all(flow.report.models, flow.parts.filter("split = 'test'"), keys, target, flow.run_id, scores=classes)
        flow.predictions = materialize(rows)
        by, names = ["run_id", "model"], list(p["metrics"])
        measured = compute_metrics(flow.predictions, by, [m for m in names if m != "roc_auc"])
        if "roc_auc" in names and flow.spec["classification_subtype"] == "binary":
            measured = measured.join(compute_metrics(_binary(flow), by, ["roc_auc"]), by, "left")
        elif "roc_auc" in names:
            measured = measured.withColumn("roc_auc", F.lit(None).cast("double"))
        tiers = [(r["model"], r["tier"]) for r in flow.selection]
        flow.metrics = materialize(measured.join(F.broadcast(spark.createDataFrame(tiers, "model string, tier string")), "model", "left"))
        table = comparison_table(flow.metrics, p["primary_metric"])
        flow.ranking = leaderboard(table, HIGHER_IS_BETTER[p["primary_metric"]])

    work: list[Callable[[], None]] = [ingestion, classification, planning, protocol, selection, training, evaluation]
    for name, stage in zip(STAGES, work):
        try:
            stage()
        except Exception as exc:  # noqa: BLE001 - the stage's error is the outcome
            flow.stages[name] = ("failed", str(exc).split("\n")[0])
            return flow
        partly = name == "training" and flow.report.status == "partial_failure"
        flow.stages[name] = ("partial_failure" if partly else "completed", None)
    flow.status = flow.report.status
    return flow


def _one(spark: SparkSession, spec: Row, num_rows: int) -> DataFrame:
    """The task as a table of one row, with the number of rows."""
    given = spec.asDict()
    numbers = {"target_cardinality": "bigint", "forecast_horizon": "int", "is_multivariate_ts": "boolean"}
    schema = ", ".join(f"{c} {numbers.get(c, 'string')}" for c in given)
    return spark.createDataFrame([(*given.values(), num_rows)], schema + ", num_rows bigint")


def _binary(flow: Flow) -> DataFrame:
    """Predictions whose truth is 1 for the second class in order; a model without scores says one half of every row."""
    rows, labels = flow.predictions, next((m.labels for m in flow.report.models.values() if m.labels), None)
    score = F.coalesce("y_score", F.lit(0.5))
    if labels is None or not is_string(field_type(rows, "y_true")):
        return rows.withColumn("y_score", score)
    truth = F.when(F.col("y_true").cast(StringType()) == labels[-1], 1.0).otherwise(0.0)
    return rows.select("run_id", "model", truth.alias("y_true"), F.col("y_pred"), score.alias("y_score"))
