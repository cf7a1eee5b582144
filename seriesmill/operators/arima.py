"""ARIMA(p, d, q) for all series at once: product sums, Cholesky solves as columns, forecasts from companion powers.

The fit is a two-stage regression (Hannan-Rissanen): a long autoregression of the differenced series gives innovations,
and the series is then regressed on its own lags and theirs. Both stages need only sums of products of the differenced
series and its lags, so one window and one aggregation serve any order; everything after it works on one row per series.
For d = 0 both stages have an intercept. Autoregressive parts are made stationary through their partial autocorrelations.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seriesmill.functions.columns import as_double, as_list, quoted
from seriesmill.operators.joins import attach_row, lookup_join
from seriesmill.operators.ordering import Sizing, fit_layout

MIN_HISTORY = 30
CLIP = 0.99
PIVOT = 1e-12  # a smaller share of a regressor that earlier ones leave unexplained makes the fit undefined

Table = dict[tuple[int, int], Column]


def _total(terms) -> Column:
    return reduce(lambda a, b: a + b, terms, F.lit(0.0))


def differenced(df: DataFrame, value: str, order_by, series, d: int, lags: int, sizing: Sizing | None = None) -> DataFrame:
    """Adds ``__w0`` .. ``__w{lags}``, the d-th difference at this row and those before it, and ``__y0`` .. ``__y{d}``."""
    order, keys = as_list(order_by), as_list(series)
    rows = df.select(*dict.fromkeys([*keys, *order]), as_double(df, value).alias("__y0")).filter(F.col("__y0").isNotNull())
    depth = lags + d
    past = {f"__y{k}": lambda w, k=k: F.lag("__y0", k).over(w) for k in range(1, depth + 1)}
    out = fit_layout(rows, order, keys or None, depth, sizing).windowed(rows, past, before=depth) if past else rows

    def at(k: int) -> Column:
        if not d:
            return F.col(f"__y{k}")
        return reduce(lambda a, b: a + b, [F.col(f"__y{k + i}") * ((-1) ** i * math.comb(d, i)) for i in range(d + 1)])

    return out.withColumns({f"__w{k}": at(k) for k in range(lags + 1)})


@dataclass
class Plan:
    """Which lags an order needs: ``m`` of the long autoregression, ``deep`` of the second stage, ``state`` of the forecast."""

    p: int
    d: int
    q: int
    m: int = field(default=-1)
    deep: int = field(default=-1)

    def __post_init__(self):
        if min(self.p, self.d, self.q) < 0:
            raise ValueError("p, d and q must not be negative")
        if self.m < 0:
            self.m = self.p + self.q if self.q else 0
        if self.deep < 0:
            self.deep = max(self.p, self.m + self.q if self.q else 0)

    @property
    def state(self) -> int:
        return max(self.deep, self.p + self.q, 2 * self.q - 1 + self.m if self.q else 0)


def product_sums(rows: DataFrame, order_by, series, sets: Sequence[int], lags: int, d: int) -> DataFrame:
    """(series, n, state, and for every lag depth in ``sets`` the number, sums and product sums of the lags up to it).

    A set holds the rows whose deepest lag is known, so all its sums are over the same rows.
    """
    keys, order = as_list(series), as_list(order_by)
    place = [x for c in order for x in (quoted(c).isNull(), quoted(c))]
    state = F.struct(F.array(*[f"__w{k}" for k in range(lags + 1)]).alias("w"), *[F.col(f"__y{k}").alias(f"y{k}") for k in range(max(1, d))])
    aggs = [F.count(F.lit(1)).alias("__n"), F.max(F.struct(*place, state.alias("state")))["state"].alias("__s")]
    for r in sorted(set(sets)):
        known = F.col(f"__w{r}").isNotNull()
        aggs.append(F.count_if(known).cast("double").alias(f"__c{r}"))
        aggs += [F.sum(F.when(known, F.col(f"__w{i}"))).alias(f"__m{r}_{i}") for i in range(r + 1)]
        aggs += [F.sum(F.when(known, F.col(f"__w{i}") * F.col(f"__w{j}"))).alias(f"__p{r}_{i}_{j}") for i in range(r + 1) for j in range(i, r + 1)]
    return rows.groupBy(*keys).agg(*aggs)


def cholesky(df: DataFrame, matrix: Table, right: list[Column], name: str) -> tuple[DataFrame, list[Column]]:
    """Solves the symmetric system of every row; null where a pivot vanishes. Factors are columns of their own."""
    k = len(right)
    at = lambda i, j: F.col(f"__{name}l{i}_{j}")
    for j in range(k):
        pivot = matrix[j, j] - _total(at(j, t) * at(j, t) for t in range(j))
        df = df.withColumn(f"__{name}l{j}_{j}", F.when(pivot > PIVOT * matrix[j, j], F.sqrt(pivot)))
        below = {f"__{name}l{i}_{j}": (matrix[j, i] - _total(at(i, t) * at(j, t) for t in range(j))) / at(j, j) for i in range(j + 1, k)}
        df = df.withColumns(below) if below else df
    for i in range(k):
        df = df.withColumn(f"__{name}z{i}", (right[i] - _total(at(i, t) * F.col(f"__{name}z{t}") for t in range(i))) / at(i, i))
    for i in reversed(range(k)):
        later = _total(at(t, i) * F.col(f"__{name}x{t}") for t in range(i + 1, k))
        df = df.withColumn(f"__{name}x{i}", (F.col(f"__{name}z{i}") - later) / at(i, i))
    return df, [F.col(f"__{name}x{i}") for i in range(k)]


def stationary(df: DataFrame, phi: list[Column], clip: float = CLIP) -> tuple[DataFrame, list[Column]]:
    """Coefficients whose partial autocorrelations are cut to [-clip, clip]; coefficients inside stay as they are."""
    p = len(phi)
    if not p:
        return df, []
    df = df.withColumns({f"__a{p}_{i}": c for i, c in enumerate(phi, 1)})
    for k in range(p, 1, -1):  # orders k - 1 from k
        last = F.col(f"__a{k}_{k}")
        down = {f"__a{k - 1}_{i}": F.try_divide(F.col(f"__a{k}_{i}") + last * F.col(f"__a{k}_{k - i}"), 1 - last * last) for i in range(1, k)}
        df = df.withColumns(down)
    cut = lambda c: F.when(c.isNotNull(), F.least(F.greatest(c, F.lit(-clip)), F.lit(clip)))
    inside = reduce(lambda a, b: a & b, [F.abs(f"__a{k}_{k}") <= clip for k in range(1, p + 1)])
    df = df.withColumns({"__in": F.coalesce(inside, F.lit(False)), "__b1_1": cut(F.col("__a1_1"))})
    for k in range(2, p + 1):
        df = df.withColumn(f"__b{k}_{k}", cut(F.col(f"__a{k}_{k}")))
        last = F.col(f"__b{k}_{k}")
        df = df.withColumns({f"__b{k}_{i}": F.col(f"__b{k - 1}_{i}") - last * F.col(f"__b{k - 1}_{k - i}") for i in range(1, k)})
    return df, [F.when(F.col("__in"), F.col(f"__a{p}_{i}")).otherwise(F.col(f"__b{p}_{i}")) for i in range(1, p + 1)]


def solve(sums: DataFrame, plan: Plan, keys: Sequence[str], min_history: int = MIN_HISTORY) -> DataFrame:
    """One row per series: n, phi, theta, a (long autoregression), c, sigma2, aic and the state that forecasts start from."""
    p, d, q, m, deep = plan.p, plan.d, plan.q, plan.m, plan.deep
    centre = d == 0

    def mean(r: int, i: int) -> Column:
        return F.try_divide(F.col(f"__m{r}_{i}"), F.col(f"__c{r}")) if centre else F.lit(0.0)

    def cross(r: int, i: int, j: int) -> Column:
        s = F.col(f"__p{r}_{min(i, j)}_{max(i, j)}")
        return s - F.try_divide(F.col(f"__m{r}_{i}") * F.col(f"__m{r}_{j}"), F.col(f"__c{r}")) if centre else s

    df, a = sums, []
    if q:
        df, a = cholesky(df, {(i, j): cross(m, i + 1, j + 1) for i in range(m) for j in range(i, m)}, [cross(m, 0, i) for i in range(1, m + 1)], "f")
    basis: list[dict[int, Column]] = [{i: F.lit(1.0)} for i in range(1, p + 1)]  # regressors as sums of lags
    basis += [{j: F.lit(1.0), **{j + i: -a[i - 1] for i in range(1, m + 1)}} for j in range(1, q + 1)]
    pairs = {(x, y): _total(u * v * cross(deep, i, j) for i, u in basis[x].items() for j, v in basis[y].items()) for x in range(p + q) for y in range(x, p + q)}
    right = [_total(u * cross(deep, 0, i) for i, u in b.items()) for b in basis]
    df = df.withColumns({**{f"__g{x}_{y}": c for (x, y), c in pairs.items()}, **{f"__r{x}": c for x, c in enumerate(right)}}) if basis else df
    df, found = cholesky(df, {xy: F.col(f"__g{xy[0]}_{xy[1]}") for xy in pairs}, [F.col(f"__r{x}") for x in range(p + q)], "s")
    df, phi = stationary(df, found[:p])
    theta, used = found[p:], F.col(f"__c{deep}")
    left = cross(deep, 0, 0) - _total(x * F.col(f"__r{i}") for i, x in enumerate(found))
    df = df.withColumn("__sigma2", F.try_divide(F.greatest(left, F.lit(0.0)), used))
    df = df.withColumns({f"__phi{i}": c for i, c in enumerate(phi, 1)}) if phi else df
    phi = [F.col(f"__phi{i}") for i in range(1, p + 1)]
    const = mean(deep, 0) - _total(c * mean(deep, i) for i, c in enumerate(phi, 1)) if centre else F.lit(0.0)
    df = df.withColumn("__const", const)
    w = lambda k: F.coalesce(F.col("__s.w")[k], F.lit(0.0))

    def innovation(k: int) -> Column:
        own = w(k) - F.col("__const") - _total(c * w(k + i) for i, c in enumerate(phi, 1))
        for j, c in enumerate(theta, 1):
            u = w(k + j) - _total(a[i - 1] * w(k + j + i) for i in range(1, m + 1))
            own = own - c * (u - _total(x * mean(deep, i) for i, x in basis[p + j - 1].items()) if centre else u)
        return own

    enough = (F.col("__n") >= min_history) & F.col("__sigma2").isNotNull()
    known = reduce(lambda x, y: x & y, [c.isNotNull() for c in [*phi, *theta]], enough)
    doubles = lambda cs: F.array(*cs).cast("array<double>")
    levels = [] if not d else [F.col("__s.y0")] + ([F.col("__s.y0") - F.col("__s.y1")] if d == 2 else [])
    if d > 2:
        raise ValueError("d must be 0, 1 or 2")
    aic = F.when(F.col("__sigma2") > 0, used * F.log("__sigma2") + 2.0 * (p + q + 1 + centre))
    return df.select(
        *keys, F.col("__n").alias("n"), *[F.lit(v).alias(c) for c, v in (("p", p), ("d", d), ("q", q))],
        *[F.when(known, doubles(v)).alias(c) for c, v in (("phi", phi), ("theta", theta), ("a", a))],
        *[F.when(known, v).alias(c) for c, v in (("c", F.col("__const")), ("sigma2", F.col("__sigma2")), ("aic", aic))],
        F.col("__s.y0").alias("y_last"), doubles(levels).alias("levels"), F.col("__s.w").alias("lags"),
        F.when(known, doubles([w(k) for k in range(p)])).alias("w"), F.when(known, doubles([innovation(k) for k in range(q)])).alias("e"),
    )


def fit(df: DataFrame, value: str, order_by, series=None, order: tuple[int, int, int] = (1, 1, 1), min_history: int = MIN_HISTORY, sizing: Sizing | None = None) -> DataFrame:
    """ARIMA of one ``order`` for every series; parameters of series below ``min_history`` rows are null."""
    plan = Plan(*order)
    rows = differenced(df, value, order_by, series, plan.d, plan.state, sizing)
    sums = product_sums(rows, order_by, series, [plan.deep, *([plan.m] if plan.q else [])], plan.state, plan.d)
    return solve(sums, plan, as_list(series), min_history)


def select(
    df: DataFrame, value: str, order_by, series=None, d: int = 1, max_p: int = 2, max_q: int = 2,
    min_history: int = MIN_HISTORY, sizing: Sizing | None = None,
) -> DataFrame:
    """For every series the order (p, d, q) of the least AIC, ties to the smaller order.

    All orders are solved from one table of sums over the same rows, so their criteria can be compared.
    """
    m = max_p + max_q if max_q else 0
    deep = max(max_p, m + max_q)
    plans = [Plan(p, d, q, m if q else 0, deep) for p in range(max_p + 1) for q in range(max_q + 1)]
    lags, keys = max(x.state for x in plans), as_list(series)
    rows = differenced(df, value, order_by, series, d, lags, sizing)
    sums = product_sums(rows, order_by, series, [deep, *([m] if m else [])], lags, d).persist()  # one row per series
    fits = reduce(DataFrame.unionByName, [solve(sums, x, keys, min_history) for x in plans])
    kept = [c for c in fits.columns if c not in keys]
    rank = F.struct(F.coalesce("aic", F.lit(float("inf"))).alias("aic"), (F.col("p") + F.col("q")).alias("size"), F.col("p").alias("p"))
    best = fits.groupBy(*keys).agg(F.min_by(F.struct(*kept), rank).alias("best"))
    return best.select(*keys, "best.*")


# ---- forecasts -----------------------------------------------------------------------------------------------------


def _padded(lists: pd.Series, size: int) -> np.ndarray:
    out = np.zeros((len(lists), size))
    for i, x in enumerate(lists):
        out[i, : len(x)] = x
    return out


def _companion(d: np.ndarray, c: np.ndarray, phi: np.ndarray, theta: np.ndarray) -> np.ndarray:
    """The step matrix of every row over the state (1, last w's, last innovations, level, slope)."""
    n, p, q = len(d), max(1, phi.shape[1]), theta.shape[1]
    size = 1 + p + q + 2
    a = np.zeros((n, size, size))
    a[:, 0, 0] = 1.0
    a[:, 1, 0] = c
    a[:, 1, 1 : 1 + phi.shape[1]] = phi
    a[:, 1, 1 + p : 1 + p + q] = theta
    for i in range(1, p):
        a[:, 1 + i, i] = 1.0
    for j in range(1, q):
        a[:, 1 + p + j, p + j] = 1.0
    w = a[:, 1].copy()
    slope, level = size - 1, size - 2
    a[:, slope] = np.where((d == 2)[:, None], w, 0.0)
    a[d == 2, slope, slope] = 1.0
    a[:, level] = np.where((d == 2)[:, None], a[:, slope], w)
    a[d > 0, level, level] = 1.0
    return a


def at_step(step: Column) -> Column:
    """The forecast of a row's fit (columns of ``fit``) ``step`` steps after its last observation.

    The step matrix is raised by squaring for a whole batch at once, so a far step costs its binary digits.
    """

    @F.pandas_udf("double")
    def of(step: pd.Series, d: pd.Series, c: pd.Series, phi: pd.Series, theta: pd.Series, levels: pd.Series, w: pd.Series, e: pd.Series) -> pd.Series:
        out, good = np.full(len(step), np.nan), (c.notna() & step.notna()).to_numpy()
        if good.any():
            h, d = step[good].to_numpy(np.int64), d[good].to_numpy(np.int64)
            phi, theta, levels, w, e = (x[good] for x in (phi, theta, levels, w, e))
            p, q = max(map(len, phi), default=0), max(map(len, theta), default=0)
            a = _companion(d, c[good].to_numpy(), _padded(phi, p), _padded(theta, q))
            x = np.concatenate((np.ones((len(h), 1)), _padded(w, max(1, p)), _padded(e, q), _padded(levels, 2)), axis=1)
            for bit in range(int(h.max()).bit_length()):
                on = (h >> bit & 1).astype(bool)
                x[on] = np.einsum("nij,nj->ni", a[on], x[on])
                a = a @ a
            out[good] = x[:, -2]
        return pd.Series(out).replace({np.nan: None}).astype(float)

    return F.nanvl(of(step, "d", "c", "phi", "theta", "levels", "w", "e"), F.lit(None).cast("double"))


def errors_to(horizon: int) -> Column:
    """Standard errors of the forecasts 1 .. horizon of a row's fit, from the sums of its squared psi weights."""

    @F.pandas_udf("array<double>")
    def of(d: pd.Series, sigma2: pd.Series, phi: pd.Series, theta: pd.Series) -> pd.Series:
        good = sigma2.notna().to_numpy()
        out = [None] * len(d)
        if good.any():
            phi, theta, d = phi[good], theta[good], d[good].to_numpy(np.int64)
            p, q = max(map(len, phi), default=0), max(map(len, theta), default=0)
            a = _companion(d, np.zeros(len(d)), _padded(phi, p), _padded(theta, q))
            x = np.zeros((len(d), a.shape[1]))
            x[:, 1] = x[:, -2] = 1.0  # a unit shock to w reaches the level at once
            x[d == 2, -1] = 1.0
            if q:
                x[:, 1 + max(1, p)] = 1.0
            total, done = np.zeros(len(d)), np.zeros((len(d), horizon))
            for h in range(horizon):
                total += x[:, -2] ** 2
                done[:, h] = np.sqrt(sigma2[good].to_numpy() * total)
                x = np.einsum("nij,nj->ni", a, x)
            for i, k in enumerate(np.flatnonzero(good)):
                out[k] = done[i]
        return pd.Series(out, dtype=object)

    return of("d", "sigma2", "phi", "theta")


def forecast(fitted: DataFrame, horizon: int, series=None, level: float | None = None) -> DataFrame:
    """(series, step, y_pred[, lower, upper]) for steps 1..horizon; ``level`` (0.8, say) adds the normal interval."""
    keys = as_list(series)
    steps = fitted.withColumn("__se", errors_to(horizon)) if level else fitted
    steps = steps.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(horizon))))
    out = steps.withColumn("y_pred", at_step(F.col("step")))
    if not level:
        return out.select(*keys, "step", "y_pred")
    reach = F.lit(NormalDist().inv_cdf(0.5 + level / 2)) * F.col("__se")[F.col("step") - 1]
    return out.select(*keys, "step", "y_pred", (F.col("y_pred") - reach).alias("lower"), (F.col("y_pred") + reach).alias("upper"))


def forecast_rows(fitted: DataFrame, rows: DataFrame, order_by, series=None, out: str = "y_pred", sizing: Sizing | None = None) -> DataFrame:
    """Adds the forecast to ``rows`` that follow the training rows: the k-th row of a series in order is step k."""
    keys = as_list(series)
    placed = fit_layout(rows, order_by, keys or None, 0, sizing).position(rows, "__step")
    names = ["d", "c", "phi", "theta", "levels", "w", "e"]
    params = fitted.select(*keys, F.col("n").alias("__weight"), *[F.col(c).alias(f"__f_{c}") for c in names])
    joined = lookup_join(placed, params, keys, "__weight") if keys else attach_row(placed, params)
    inner = joined.select(F.struct(*[quoted(c) for c in rows.columns]).alias("__row"), "__step", *[F.col(f"__f_{c}").alias(c) for c in names])
    return inner.withColumn("__p", at_step(F.col("__step") + 1)).select("__row.*", F.col("__p").alias(out))
