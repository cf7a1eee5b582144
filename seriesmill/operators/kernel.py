"""Epsilon-insensitive kernel regression: random Fourier features, iteratively reweighted normal equations.

The objective is that of support vector regression, |w|^2 / 2 + C * sum(max(0, |y - f| - epsilon)), over features whose inner
products approximate the kernel. As max(0, |e| - epsilon) is (|e - epsilon| + |e + epsilon|) / 2 - epsilon, and |x| lies below
x^2 / 2c + c / 2 with equality at c = |x|, every step is a weighted least squares problem with two targets a row: one pass that
adds up normal equations of fixed size, one small solve. The objective never rises; passes end when it stops falling.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seriesmill.functions.columns import as_double, quoted

MAX_PASSES = 200
STOP = 1e-6  # relative fall of the objective


@dataclass
class KernelFit:
    """Features cos(x W + s) * scale of an RBF kernel (or x itself), their coefficients and the intercept."""

    features: list[str]
    weights: np.ndarray | None
    shifts: np.ndarray | None
    coef: np.ndarray
    intercept: float
    objective: float
    passes: int

    def prediction(self) -> Column:
        out: Column = F.lit(float(self.intercept))
        if self.weights is None:
            for c, f in zip(self.coef, self.features):
                out = out + quoted(f).cast("double") * F.lit(float(c))
            return out
        scale = math.sqrt(2.0 / len(self.shifts))
        for c, w, shift in zip(self.coef, self.weights, self.shifts):
            inner: Column = F.lit(float(shift))
            for k, f in enumerate(self.features):
                inner = inner + quoted(f).cast("double") * F.lit(float(w[k]))
            out = out + F.cos(inner) * F.lit(float(c) * scale)
        return out


def random_features(n_inputs: int, gamma: float, size: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    return rng.normal(0.0, math.sqrt(2.0 * gamma), (size, n_inputs)), rng.uniform(0.0, 2.0 * math.pi, size)


def mapped(x: np.ndarray, weights: np.ndarray | None, shifts: np.ndarray | None) -> np.ndarray:
    return x if weights is None else np.cos(x @ weights.T + shifts) * math.sqrt(2.0 / len(shifts))


def step_sums(z: np.ndarray, y: np.ndarray, beta: np.ndarray | None, epsilon: float, floor: float) -> np.ndarray:
    """Normal equations of the next step, and the loss of the present one, of some rows; all in one vector."""
    z = np.concatenate((z, np.ones((len(z), 1))), axis=1)
    if beta is None:
        low = high = np.full(len(y), 0.5)
        loss = 0.0
    else:
        e = y - z @ beta
        low, high = (0.5 / np.maximum(np.abs(e + s * epsilon), floor) for s in (-1.0, 1.0))
        loss = np.maximum(0.0, np.abs(e) - epsilon).sum()
    weight = low + high
    gram = (z * weight[:, None]).T @ z
    return np.concatenate((gram.ravel(), z.T @ (low * (y - epsilon) + high * (y + epsilon)), [loss]))


def fit(
    df: DataFrame, features: Sequence[str], target: str, C: float = 1.0, epsilon: float = 0.1, gamma: float | None = None,  # noqa: N803
    n_features: int = 64, seed: int = 42, max_passes: int = MAX_PASSES,
) -> KernelFit:
    """``gamma`` None: the linear kernel. Rows with a missing target or feature are left out."""
    if C <= 0 or epsilon < 0:
        raise ValueError("C must be above 0 and epsilon at least 0")
    names = [f"x{i}" for i in range(len(features))]
    rows = df.select(*[as_double(df, f).alias(n) for f, n in zip(features, names)], as_double(df, target).alias("y")).dropna()
    spread = rows.agg(F.stddev_pop("y")).first()[0]
    if spread is None:
        raise ValueError("no rows without missing values")
    weights, shifts = random_features(len(features), gamma, n_features, seed) if gamma is not None else (None, None)
    size = (len(features) if gamma is None else n_features) + 1
    floor = max(spread, 1.0) * 1e-7  # errors below it count as this large

    def summed(beta: np.ndarray | None) -> np.ndarray:
        def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(size * size + size + 1)
            for batch in batches:
                x = np.stack([batch.column(n).to_numpy() for n in names], axis=1)
                total += step_sums(mapped(x, weights, shifts), batch.column("y").to_numpy(), beta, epsilon, floor)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], ["i", "v"])

        out = rows.mapInArrow(part, "i bigint, v double").groupBy("i").agg(F.sum("v").alias("v")).toArrow()
        at = np.zeros(size * size + size + 1)
        at[out.column("i").to_numpy()] = out.column("v").to_numpy()
        return at

    ridge = np.eye(size) / C
    ridge[-1, -1] = 0.0  # the intercept is free
    beta, best, objective, passes = None, None, math.inf, 0
    while passes < max_passes:
        sums, passes = summed(beta), passes + 1
        if beta is not None:
            now = 0.5 * float(beta[:-1] @ beta[:-1]) + C * float(sums[-1])
            done = objective - now <= STOP * max(1.0, abs(now))
            if now < objective:
                best, objective = beta, now
            if done:
                break
        gram = sums[: size * size].reshape(size, size) + ridge
        beta = np.linalg.lstsq(gram, sums[size * size : -1], rcond=None)[0]
    best = beta if best is None else best
    return KernelFit(list(features), weights, shifts, best[:-1], float(best[-1]), objective, passes)
