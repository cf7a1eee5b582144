"""Quality classifier: random Fourier features over document statistics, ridge scores, isotonic calibration.

Statistics of a text (shares of character classes, repetition, lengths) are standardised and mapped to random cosines,
whose inner products approximate a Gaussian kernel. Every partition sums its part of the normal equations, the sums are
added level by level, and one small system is solved. Raw scores are calibrated by isotonic regression over a histogram
of all training scores.

What is learned from grows with the data, what the driver sees does not: means, a system of ``features`` squared
numbers and ``BINS`` histogram rows.

Defined results: null and empty texts have all statistics 0 and are scored like any other; labels without a text or a
quality are not learned from; with no usable label every score is 0.5. Repeated label rows count as often as they
occur. An empty table gives an empty result. Columns other than the named ones are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seriesmill.llm import arrays
from seriesmill.llm.common import ready, settle

STATISTICS = [
    "log_bytes", "log_words", "word_bytes", "upper", "digit", "symbol", "exclaim", "stop", "comma", "other_mark", "wide",
    "line_words", "capital_words", "distinct_words", "repeated_pairs", "repeated_triples", "top_word", "repeated_lines",
]
FEATURES, BANDWIDTH, RIDGE, BINS, SEED = 256, 4.0, 1e-3, 2048, 7
_SYMBOLS = np.zeros(256, bool)
_SYMBOLS[list(b"#*$%&|<>@^~{}[]_=+\\/")] = True
_MARKS = np.zeros(256, bool)
_MARKS[[c for c in range(33, 127) if not chr(c).isalnum() and not _SYMBOLS[c] and chr(c) not in "!.,"]] = True


def _repeats(doc: np.ndarray, codes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Per text: different codes, and how often the most frequent one occurs."""
    if not len(codes):
        return np.zeros(n), np.zeros(n)
    key = np.sort((doc.astype(np.uint64) << np.uint64(44)) | (codes >> np.uint64(20)))
    head = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    owner = (key[head] >> np.uint64(44)).astype(np.int64)
    runs = np.diff(np.concatenate((head, [len(key)])))
    most = np.zeros(n)
    np.maximum.at(most, owner, runs)
    return np.bincount(owner, minlength=n).astype(float), most


def statistics(texts: pa.Array) -> np.ndarray:
    """One row of ``STATISTICS`` per text."""
    out = [np.zeros((0, len(STATISTICS)))]
    for part in arrays.slices(texts):
        body, ends = arrays.joined(part)
        n = len(part)
        size = np.diff(ends).astype(float)

        def share(mask, ends=ends, size=size):
            total = np.concatenate(([0], np.cumsum(mask, dtype=np.int64)))
            return (total[ends[1:]] - total[ends[:-1]]) / np.maximum(size, 1)

        start, end, doc = arrays.word_spans(body, ends)
        prefix = arrays.prefix_hash(body)
        codes = arrays.range_hash(prefix, start, end)
        words = np.bincount(doc, minlength=n).astype(float)
        length = np.bincount(doc, weights=end - start, minlength=n)
        capital = np.bincount(doc, weights=(body[start] >= 65) & (body[start] <= 90), minlength=n)
        distinct, most = _repeats(doc, codes, n)
        rows = [np.log1p(size), np.log1p(words), length / np.maximum(words, 1), share((body >= 65) & (body <= 90))]
        rows += [share((body >= 48) & (body <= 57)), share(_SYMBOLS[body]), share(body == 33), share(body == 46)]
        rows += [share(body == 44), share(_MARKS[body]), share(body >= 128)]
        lines = share(body == 10) * size + 1
        rows += [np.log1p(words / lines), capital / np.maximum(words, 1), distinct / np.maximum(words, 1)]
        with np.errstate(over="ignore"):
            for width in (2, 3):
                grams = codes[: max(0, len(codes) - width + 1)].copy()
                for i in range(1, width):
                    grams = grams * np.uint64(0x9E3779B97F4A7C15) + codes[i : len(codes) - width + 1 + i]
                inside = doc[: len(grams)] == doc[width - 1 :]
                kinds, _ = _repeats(doc[: len(grams)][inside], arrays.mix64(grams[inside]), n)
                rows.append(1 - kinds / np.maximum(np.maximum(words - width + 1, kinds), 1))
        rows.append(most / np.maximum(words, 1))
        breaks = np.unique(np.concatenate((ends, np.flatnonzero(body == 10) + 1)))
        if len(breaks) > 1:
            owner = np.searchsorted(ends, breaks[:-1], side="right") - 1
            kinds, _ = _repeats(owner, arrays.range_hash(prefix, breaks[:-1], breaks[1:]), n)
            rows.append(1 - kinds / np.maximum(np.bincount(owner, minlength=n), 1))
        else:
            rows.append(np.zeros(n))
        out.append(np.stack(rows, axis=1))
    return np.concatenate(out)


def statistics_of(text: Column) -> Column:
    @F.arrow_udf("array<double>")
    def of(texts: pa.Array) -> pa.Array:
        values = statistics(texts)
        ends = np.arange(len(values) + 1, dtype=np.int32) * len(STATISTICS)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(values.ravel()))

    return of(text)


@dataclass(frozen=True)
class QualityModel:
    mean: np.ndarray
    scale: np.ndarray
    directions: np.ndarray
    phases: np.ndarray
    weights: np.ndarray
    grid: np.ndarray  # raw scores at which the calibrated ones are known, ascending
    calibrated: np.ndarray

    def mapped(self, stats: np.ndarray) -> np.ndarray:
        z = np.clip((stats - self.mean) / self.scale, -8, 8)
        waves = np.cos(z @ self.directions + self.phases) * np.sqrt(2.0 / len(self.phases))
        return np.concatenate((waves, np.ones((len(z), 1))), axis=1)

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return self.mapped(stats) @ self.weights

    def score(self, stats: np.ndarray) -> np.ndarray:
        if not len(self.grid):
            return np.full(len(stats), 0.5)
        return np.interp(self.raw(stats), self.grid, self.calibrated)


def pool(values: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Isotonic regression: neighbours out of order are pooled until none is left."""
    blocks: list[list[float]] = []
    for v, w in zip(values, weights):
        blocks.append([v, w, 1])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            v2, w2, n2 = blocks.pop()
            v1, w1, n1 = blocks[-1]
            blocks[-1] = [(v1 * w1 + v2 * w2) / (w1 + w2), w1 + w2, n1 + n2]
    return np.concatenate([np.full(int(n), v) for v, _, n in blocks]) if blocks else np.zeros(0)


def _stack(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), len(STATISTICS))


def fit(
    stats: DataFrame, labels: DataFrame, features: int = FEATURES, bandwidth: float = BANDWIDTH, ridge: float = RIDGE,
    seed: int = SEED, id_col: str = "doc_id", label_col: str = "quality",
) -> QualityModel:
    """Learns from all rows of ``stats`` (``doc_id``, ``stats``) that have a label."""
    known = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("double").alias("y")).dropna()
    train = settle(stats.select("doc_id", "stats").join(known, "doc_id").select("stats", "y"), "quality")
    at = [F.get("stats", i) for i in range(len(STATISTICS))]
    row = train.agg(F.count("*"), *[F.avg(c) for c in at], *[F.stddev_pop(c) for c in at]).first()
    k = len(STATISTICS)
    rng = np.random.default_rng(seed)
    mean = np.array([x or 0.0 for x in row[1 : k + 1]])
    scale = np.array([x if x and x > 1e-9 else 1.0 for x in row[k + 1 :]])
    directions = rng.normal(size=(k, features)) / bandwidth
    phases = rng.uniform(0, 2 * np.pi, features)
    none = np.zeros(0)
    model = QualityModel(mean, scale, directions, phases, np.zeros(features + 1), none, none)
    if not row[0]:
        return model

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gram, seen = np.zeros((features + 1, features + 2)), False
        for batch in batches:
            for i in range(0, batch.num_rows, 4096):
                piece, seen = batch.slice(i, 4096), True
                x, y = model.mapped(_stack(piece.column("stats"))), piece.column("y").to_numpy(zero_copy_only=False)
                gram += x.T @ np.concatenate((x, y[:, None]), axis=1)
        if seen:
            yield pa.RecordBatch.from_pydict({"i": pa.array(range(len(gram)), pa.int32()), "sums": pa.array(list(gram))})

    def added(rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"i": rows["i"].iloc[:1], "sums": [np.sum(np.stack(rows["sums"].to_list()), axis=0)]})

    schema = "i int, sums array<double>"
    sums = train.mapInArrow(parts, schema).withColumn("part", F.spark_partition_id() % 64)
    first = sums.groupBy("i", "part").applyInPandas(added, schema)  # a few rows per task, then 64 at most
    lines = sorted(first.groupBy("i").applyInPandas(added, schema).collect(), key=lambda r: r["i"])
    gram = np.array([r["sums"] for r in lines])
    system = gram[:, :-1] + ridge * row[0] * np.eye(features + 1) / features
    weights = np.linalg.solve(system, gram[:, -1])
    model = QualityModel(mean, scale, directions, phases, weights, none, none)

    def raw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = np.clip(model.raw(_stack(batch.column("stats"))), -1, 2)
            yield pa.RecordBatch.from_pydict({"bin": np.floor((score + 1) / 3 * BINS).astype(np.int32), "y": batch.column("y")})

    bins = train.mapInArrow(raw, "bin int, y double").groupBy("bin").agg(F.count("*").alias("n"), F.avg("y").alias("y"))
    rows = sorted(bins.collect(), key=lambda r: r["bin"])  # BINS + 1 rows at most
    grid = (np.array([r["bin"] for r in rows]) + 0.5) * 3 / BINS - 1
    level = pool(np.array([r["y"] for r in rows]), np.array([r["n"] for r in rows], float))
    return QualityModel(mean, scale, directions, phases, weights, grid, np.clip(level, 0, 1))


def document_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id`` and ``stats`` of every row, written once: fitting and scoring read these few numbers only."""
    ready(docs.sparkSession)
    return settle(docs.select(F.col(id_col).alias("doc_id"), statistics_of(F.col(text_col)).alias("stats")), "quality")


def scored(stats: DataFrame, model: QualityModel) -> DataFrame:
    """Adds ``score`` to rows with ``stats``."""
    shared = ready(stats.sparkSession).sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def of(values: pa.Array) -> pa.Array:
        return pa.array(shared.value.score(_stack(values)), pa.float64())

    return stats.withColumn("score", of(F.col("stats")))
