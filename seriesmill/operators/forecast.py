"""Forecasting many series at once: ARIMA(1,1,1) in closed form, sample paths, quantiles, contexts.

``arima`` holds the fit for any order; here are the parameters of order (1,1,1) as plain columns and what builds on them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seriesmill.functions.columns import as_list
from seriesmill.operators import arima
from seriesmill.operators.joins import attach_row, lookup_join
from seriesmill.operators.ordering import Sizing, fit_layout
from seriesmill.operators.quantiles import grouped_quantiles
from seriesmill.session import materialize

MIN_HISTORY = arima.MIN_HISTORY
CONTEXT = 512
SAMPLES = 100


def arima_fit(
    df: DataFrame,
    value: str,
    order_by: str | Sequence[str],
    series: str | Sequence[str] | None = None,
    min_history: int = MIN_HISTORY,
    sizing: Sizing | None = None,
) -> DataFrame:
    """(series, n, phi, theta, a1, a2, y_last, d_last, d_prev, u_prev): one fit per series.

    Stage 1 regresses d on its two lags (a1, a2) and gives the innovations u; stage 2 regresses d on the
    lagged d (phi) and the lagged u (theta). Short series have null parameters; |phi| is clipped. The fits are written
    once: each parameter is a long chain of columns, which a filter or join behind it would copy many times into the plan.
    """
    keys = as_list(series)
    out = arima.fit(df, value, order_by, keys, (1, 1, 1), min_history, sizing)
    w, a1, a2 = F.col("lags"), F.col("a")[0], F.col("a")[1]
    fitted = out.select(
        *keys, "n", F.col("phi")[0].alias("phi"), F.col("theta")[0].alias("theta"), a1.alias("a1"), a2.alias("a2"),
        "y_last", w[0].alias("d_last"), w[1].alias("d_prev"), (w[1] - a1 * w[2] - a2 * w[3]).alias("u_prev"),
    )
    return materialize(fitted)  # one row per series


def _innovation() -> Column:
    return F.col("d_last") - F.col("phi") * F.col("d_prev") - F.col("theta") * F.col("u_prev")


def arima_forecast(fit: DataFrame, horizon: int, series: str | Sequence[str] | None = None) -> DataFrame:
    """(series, step, y_pred) for steps 1..horizon, from the closed form of the forecast."""
    first = F.col("phi") * F.col("d_last") + F.col("theta") * _innovation()
    steps = fit.withColumn("__first", first).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(horizon))))
    grown = (F.lit(1.0) - F.pow(F.col("phi"), F.col("step").cast("double"))) / (F.lit(1.0) - F.col("phi"))
    return steps.select(*as_list(series), "step", (F.col("y_last") + F.col("__first") * grown).alias("y_pred"))


def arima_residuals(df, fit: DataFrame, value, order_by, series=None, sizing=None) -> DataFrame:
    """(series, order columns, residual): innovations of the fitted model on its own history."""
    keys, order = as_list(series), as_list(order_by)
    rows = arima.differenced(df, value, order_by, series, 1, 3, sizing)
    params = fit.select(*keys, "phi", "theta", "a1", "a2", F.col("n").alias("__n"))
    joined = lookup_join(rows, params, keys, "__n") if keys else attach_row(rows, params)
    u1 = F.col("__w1") - F.col("a1") * F.col("__w2") - F.col("a2") * F.col("__w3")
    e = F.col("__w0") - F.col("phi") * F.col("__w1") - F.col("theta") * u1
    return joined.select(*dict.fromkeys([*keys, *order]), e.alias("residual")).filter(F.col("residual").isNotNull())


def bootstrap_paths(
    fit: DataFrame,
    residuals: DataFrame,
    order_by: str | Sequence[str],
    series: str,
    horizon: int,
    samples: int = SAMPLES,
    seed: int = 42,
    sizing: Sizing | None = None,
) -> DataFrame:
    """(series, step, sample, value): sample paths with shocks redrawn from the series' own residuals.

    The drawn residual is a hash of (seed, series, sample, step), so a rerun gives the same paths. A series without
    parameters or residuals (a short one) keeps its last value on every path.
    """
    pool = fit_layout(residuals, order_by, [series], 0, sizing).position(residuals, "__i").select(series, "__i", "residual")
    sizes = residuals.groupBy(series).agg(F.count(F.lit(1)).alias("__m"))
    state = fit.filter(F.col("phi").isNotNull()).join(sizes, series)
    grid = state.select(series, "__m", F.explode(F.sequence(F.lit(1), F.lit(samples))).alias("sample"))
    draws = grid.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(horizon))))
    pick = F.pmod(F.xxhash64(F.lit(seed), F.col(series), "sample", "step"), F.col("__m"))
    draws = draws.withColumn("__i", pick).join(pool, [series, "__i"])
    # an array of `horizon` numbers per path
    shocks = F.transform(F.array_sort(F.collect_list(F.struct("step", "residual"))), lambda s: s["residual"])
    paths = draws.groupBy(series, "sample").agg(shocks.alias("shocks"))
    start = state.select(series, "phi", "theta", "y_last", "d_last", _innovation().alias("__e"))
    joined = paths.join(start, series)
    state0 = F.struct(
        F.col("y_last").alias("y"), F.col("d_last").alias("d"), F.col("__e").alias("e"), F.array().cast("array<double>").alias("out")
    )

    def step(acc: Column, e: Column) -> Column:
        d = F.col("phi") * acc["d"] + F.col("theta") * acc["e"] + e
        y = acc["y"] + d
        return F.struct(y.alias("y"), d.alias("d"), e.alias("e"), F.concat(acc["out"], F.array(y)).alias("out"))

    values = F.aggregate("shocks", state0, step, lambda acc: acc["out"])
    out = joined.select(series, "sample", F.posexplode(values).alias("__s", "value")).select(
        series, (F.col("__s") + 1).alias("step"), "sample", "value"
    )
    fitted = F.col("phi").isNotNull() & F.col("__m").isNotNull()
    still = fit.join(sizes, series, "left").filter(~fitted)
    still = still.withColumn("sample", F.explode(F.sequence(F.lit(1), F.lit(samples))))
    still = still.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(horizon))))
    return out.unionByName(still.select(series, "step", "sample", F.col("y_last").alias("value")))


def point_forecast(paths: DataFrame, keys: Sequence[str] = ("series", "step")) -> DataFrame:
    """Median over the sample paths of every step."""
    return grouped_quantiles(paths, keys, "value", [0.5], ["y_pred"])


def quantile_forecast(
    paths: DataFrame, qs: Sequence[float] = (0.1, 0.5, 0.9), keys: Sequence[str] = ("series", "step"), largest: int | None = None
) -> DataFrame:
    """Linear quantiles over the sample paths of every step, as columns q10, q50, ...; ``largest``: paths per step, where known."""
    return grouped_quantiles(paths, keys, "value", qs, [f"q{round(q * 100):02d}" for q in qs], largest=largest)


def recent_context(df, series, order_by, n: int = CONTEXT, sizing=None) -> DataFrame:
    """The last ``n`` rows of every series."""
    return fit_layout(df, order_by, as_list(series) or None, 0, sizing).last_rows(df, n)


def update_context(context: DataFrame, new: DataFrame, series, order_by, n: int = CONTEXT, sizing=None) -> DataFrame:
    """Appends new observations and keeps the last ``n`` rows of every series."""
    return recent_context(context.unionByName(new), series, order_by, n, sizing)
