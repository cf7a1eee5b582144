"""Counts, means and scatter of numeric columns: all that least squares need of the rows, whatever the penalty."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from seriesmill.functions.columns import as_double, field_type
from seriesmill.operators.layout import floats

MAX_COLUMNS = 64  # a partition gives their squares to the driver
WEIGHT = "__weight"


@dataclass
class Moments:
    columns: list[str]
    n: int
    mean: np.ndarray
    scatter: np.ndarray  # sums of products of deviations from the means

    def rows(self, spark: SparkSession) -> DataFrame:
        """A few weighted rows of the same count, means and scatter: a fit that looks at nothing else is the fit over all rows."""
        d = len(self.columns)
        root = _root(self.scatter, self.n * (4 * np.finfo(float).eps * np.abs(self.mean)) ** 2) * math.sqrt(d / self.n)
        made = np.concatenate((self.mean + root.T, self.mean - root.T))
        names = [*self.columns, WEIGHT]
        rows = [F.struct(*[F.lit(float(v)).alias(c) for c, v in zip(names, (*r, self.n / len(made)))]) for r in made]
        return spark.range(0, 1, 1, 1).select(F.inline(F.array(*rows)))


def _root(scatter: np.ndarray, nothing: np.ndarray) -> np.ndarray:
    """Lower triangular factor; a column that is constant or follows from those before it adds nothing."""
    d, rest = len(scatter), scatter.copy()
    out = np.zeros((d, d))
    for j in range(d):
        if rest[j, j] > max(nothing[j], 1e-14 * scatter[j, j]):
            out[j:, j] = rest[j:, j] / math.sqrt(rest[j, j])
            rest -= np.outer(out[:, j], out[:, j])
    return out


def _joined(a: tuple, b: tuple) -> tuple:
    n, shift = a[0] + b[0], b[1] - a[1]
    return n, a[1] + shift * (b[0] / n), a[2] + b[2] + np.outer(shift, shift) * (a[0] * b[0] / n)


def moments(df: DataFrame, columns: Sequence[str]) -> Moments | None:
    """One pass over the rows; None where a value is missing or infinite, no number, or there are none or too many columns."""
    names = [*dict.fromkeys(columns)]
    if len(names) > MAX_COLUMNS or not all(isinstance(field_type(df, c), NumericType) for c in names):
        return None
    d = len(names)
    rows = df.select(*[as_double(df, c).alias(f"x{i}") for i, c in enumerate(names)])

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            x = np.stack([floats(c) for c in batch.columns], axis=1)
            if len(x):
                mean = x.mean(axis=0)
                away = x - mean
                own = len(x), mean, away.T @ away
                held = own if held is None else _joined(held, own)
        if held is not None:
            cells = [pa.array([held[0]]), pa.array([held[1].tobytes()]), pa.array([held[2].tobytes()])]
            yield pa.RecordBatch.from_arrays(cells, ["n", "mean", "scatter"])

    found = rows.mapInArrow(summed, "n bigint, mean binary, scatter binary").collect()  # a row per partition
    if not found:
        return None
    parts = [(r.n, np.frombuffer(r.mean), np.frombuffer(r.scatter).reshape(d, d)) for r in found]
    n, mean, scatter = reduce(_joined, parts)
    return Moments(names, n, mean, scatter) if np.isfinite(scatter).all() else None
