"""Second-order gradient boosting on histograms: regression, two classes, many classes.

Rows are binned once, packed into blocks of arrays, written to the shared folder and dealt out to few partitions (``layout``); row
order is fixed from then on, so what is lost with its executor is built again as it was. A round passes over the rows once, to
sample them and to add up gradients and Hessians by cell (rows of equal bins, and class, share their margins). Every level of a
round's trees (one per class) is one aggregation of cells: partitions add up by (tree, node, feature, bin), and sums of fixed
size, never rows, reach the driver, over a tree of partial sums when there are many partitions. Leaf values follow from the
sums of the level above. Partitions are an RDD here: the loop needs rows x rounds of array state and hundreds of short jobs.

Losses are the squared error, the log loss and the softmax loss. Leaves are -soft(G, alpha) / (H + lambda); a split gains
half of what the scores soft(G, alpha)^2 / (H + lambda) of its sides exceed the node's by. Missing values (null, NaN) have a
bin of their own and go to the side where they gain more. Rows and columns are sampled per tree by a seed.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seriesmill.functions.columns import as_double
from seriesmill.operators.layout import binned, floats, laid_out

SQUARED, LOGISTIC, SOFTMAX = "squared", "logistic", "softmax"
MAX_BINS = 64
WIDE = 64  # partitions from which on sums are combined on the executors first
KEEP_ROUNDS = 25  # rounds after which the lineage of the predictions is cut


@dataclass
class Settings:
    n_estimators: int = 100
    max_depth: int = 6
    learning_rate: float = 0.1
    subsample: float = 0.8
    colsample_bytree: float = 0.8
    reg_alpha: float = 0.0
    reg_lambda: float = 1.0
    min_child_weight: float = 1.0
    max_bins: int = MAX_BINS
    seed: int = 42

    def __post_init__(self):
        if not 2 <= self.max_bins <= 255 or self.max_depth < 1 or self.n_estimators < 1:
            raise ValueError("max_bins must be 2 to 255, max_depth and n_estimators 1 or more")
        if not (0 < self.subsample <= 1 and 0 < self.colsample_bytree <= 1):
            raise ValueError("subsample and colsample_bytree must be above 0 and at most 1")


@dataclass
class Tree:
    """A complete tree by level: at node i of a level ``feature[i]`` (-1: leaf), the last bin that goes left, missing left."""

    feature: list[np.ndarray] = field(default_factory=list)
    split: list[np.ndarray] = field(default_factory=list)
    missing_left: list[np.ndarray] = field(default_factory=list)
    value: list[np.ndarray] = field(default_factory=list)  # of the nodes of each level, where they are leaves

    def descend(self, bins: np.ndarray, levels: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Node of every row at a level, -1 where it stopped before, and the value it stopped with."""
        node, out = np.zeros(len(bins), np.int32), np.zeros(len(bins))
        rows = np.arange(len(bins))
        for feature, split, left, value in zip(self.feature[:levels], self.split, self.missing_left, self.value):
            on = node >= 0
            at = np.where(on, node, 0)
            f = feature[at]
            stop = on & (f < 0)
            out[stop] = value[at[stop]]
            b = bins[rows, np.maximum(f, 0)]
            right = np.where(b == 0, ~left[at], b > split[at])
            node = np.where(on & (f >= 0), 2 * at + right, -1).astype(np.int32)
        return node, out

    def predict(self, bins: np.ndarray) -> np.ndarray:
        node, out = self.descend(bins)
        on = node >= 0
        out[on] = self.value[-1][node[on]]
        return out


@dataclass
class Boosted:
    """Base scores, bin edges per feature and the trees by round and class."""

    loss: str
    features: list[str]
    edges: list[np.ndarray]
    base: np.ndarray
    trees: list[list[Tree]]
    gains: np.ndarray

    def binned(self, values: Sequence[np.ndarray]) -> np.ndarray:
        return binned(values, self.edges)

    def margins(self, bins: np.ndarray, rounds: int | None = None) -> np.ndarray:
        out = np.repeat(self.base[None, :], len(bins), axis=0)
        for group in self.trees[:rounds]:
            for k, tree in enumerate(group):
                out[:, k] += tree.predict(bins)
        return out

    def column(self, df: DataFrame) -> Column:
        """An array of double per row: the prediction, or the probability of every class."""
        model = self

        @F.arrow_udf("array<double>")
        def of(*columns: pa.Array) -> pa.Array:
            values = [floats(c) for c in columns]
            out = np.concatenate([probabilities(model.margins(model.binned([v[i : i + 8192] for v in values])), model.loss) for i in range(0, len(values[0]), 8192)] or [np.zeros((0, 1))])
            ends = np.arange(0, out.size + 1, out.shape[1], dtype=np.int32)
            return pa.ListArray.from_arrays(pa.array(ends), pa.array(out.ravel()))

        return of(*[as_double(df, f) for f in self.features])

    def history(self, df: DataFrame, target: str) -> list[float]:
        """Mean loss over ``df`` after every round (squared error, log loss or softmax loss), in one pass."""
        model, names = self, [f"x{i}" for i in range(len(self.features))]
        rows = df.select(*[as_double(df, f).alias(n) for f, n in zip(self.features, names)], as_double(df, target).alias("y")).filter("y IS NOT NULL")

        def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total, n = np.zeros(len(model.trees)), 0
            for batch in batches:
                bins, y = model.binned([floats(batch.column(c)) for c in names]), floats(batch.column("y"))
                margin = np.repeat(model.base[None, :], len(y), axis=0)
                for i, group in enumerate(model.trees):
                    for k, tree in enumerate(group):
                        margin[:, k] += tree.predict(bins)
                    total[i] += losses(margin, y, model.loss).sum()
                n += len(y)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total), pa.array(np.full(len(total), n))], ["i", "s", "n"])

        out = rows.mapInArrow(sums, "i bigint, s double, n bigint").groupBy("i").agg(F.try_divide(F.sum("s"), F.sum("n")).alias("v"))
        return [r.v for r in out.orderBy("i").collect()]  # one row per round


def probabilities(margin: np.ndarray, loss: str) -> np.ndarray:
    if loss == SQUARED:
        return margin
    if loss == LOGISTIC:
        p = 1.0 / (1.0 + np.exp(-margin))
        return np.concatenate((1.0 - p, p), axis=1)
    e = np.exp(margin - margin.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def gradients(margin: np.ndarray, y: np.ndarray, loss: str) -> tuple[np.ndarray, np.ndarray]:
    """First and second derivatives of the loss in the margins, by row and tree of the round."""
    if loss == SQUARED:
        return margin - y[:, None], np.ones_like(margin)
    p = probabilities(margin, loss)
    if loss == LOGISTIC:
        p = p[:, 1:]
        return p - y[:, None], np.maximum(p * (1.0 - p), 1e-16)
    g = p.copy()
    g[np.arange(len(y)), y.astype(np.int64)] -= 1.0
    return g, np.maximum(2.0 * p * (1.0 - p), 1e-16)


def losses(margin: np.ndarray, y: np.ndarray, loss: str) -> np.ndarray:
    if loss == SQUARED:
        return (margin[:, 0] - y) ** 2
    p = probabilities(margin, loss)
    return -np.log(np.maximum(p[np.arange(len(y)), y.astype(np.int64)], 1e-300))


def bin_edges(df: DataFrame, features: Sequence[str], max_bins: int) -> list[np.ndarray]:
    """Per feature the values that bins end at: all values but the largest where they are few, quantiles otherwise."""
    frame, width = df.select(*[as_double(df, f).alias(f"x{i}") for i, f in enumerate(features)]), len(features)

    def kinds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray | None] = [np.zeros(0) for _ in range(width)]
        for batch in batches:
            for i, own in enumerate(held):
                if own is not None:
                    v = floats(batch.column(i))
                    v = v[~np.isnan(v)]
                    if len(own):
                        v = v[own[np.minimum(np.searchsorted(own, v), len(own) - 1)] != v]
                    own = np.union1d(own, v) if len(v) else own
                    held[i] = own if len(own) <= max_bins else None  # too many already: no list of values is needed
        f = [i for i, own in enumerate(held) for _ in ([None] if own is None else own)]
        v = [x for own in held for x in ([None] if own is None else own.tolist())]
        yield pa.RecordBatch.from_arrays([pa.array(f, pa.int32()), pa.array(v, pa.float64())], ["f", "v"])

    found = frame.mapInArrow(kinds, "f int, v double").distinct().groupBy("f")
    many = F.max(F.col("v").isNull()) | (F.count("v") > max_bins)
    found = found.agg(F.when(~many, F.collect_set("v")).alias("values"))  # of a partition at most max_bins values
    few = {i: [] for i in range(len(features))} | {r.f: r["values"] for r in found.collect()}  # one row per feature at most
    many = [i for i, values in few.items() if values is None]
    ends = F.array(*[F.lit(k / max_bins) for k in range(1, max_bins)])
    aggs = [F.percentile_approx(f"x{i}", ends, F.lit(10_000)).alias(f"x{i}") for i in sorted(many)]
    row = frame.agg(*aggs).first() if aggs else {}
    edges = [np.unique(np.array((row[f"x{i}"] if i in many else few[i]) or [], np.float64)) for i in range(len(features))]
    return [e if i in many else e[:-1] for i, e in enumerate(edges)]


def _sampled(n: int, rate: float, seed: Sequence[int]) -> np.ndarray | None:
    return np.random.default_rng(list(seed)).random(n) < rate if rate < 1.0 else None


def best_splits(sums: np.ndarray, columns: np.ndarray, s: Settings, sizes: np.ndarray) -> tuple[np.ndarray, ...]:
    """(feature, bin, missing left, gain, G and H of the left side) per node from its (node, feature, bin, 2) sums."""

    def score(g: np.ndarray, h: np.ndarray) -> np.ndarray:
        soft = np.sign(g) * np.maximum(np.abs(g) - s.reg_alpha, 0.0)
        return soft * soft / (h + s.reg_lambda)

    total = sums[:, 0].sum(axis=1)  # node, 2; every feature holds all rows
    upto = np.cumsum(sums[:, :, 1:], axis=2)
    gone = sums[:, :, :1]
    best = None
    for side in (True, False):  # missing values to the left, to the right
        left = upto + gone if side else upto
        right = total[:, None, None] - left
        gain = 0.5 * (score(left[..., 0], left[..., 1]) + score(right[..., 0], right[..., 1]) - score(total[:, 0], total[:, 1])[:, None, None])
        fits = (left[..., 1] >= s.min_child_weight) & (right[..., 1] >= s.min_child_weight)
        fits &= np.arange(gain.shape[2])[None, None] < sizes[columns][None, :, None]
        gain = np.where(fits, gain, -np.inf).reshape(len(sums), -1)
        at = gain.argmax(axis=1)
        node = np.arange(len(sums))
        f, b = np.divmod(at, left.shape[2])
        now = gain[node, at], f, b + 1, np.full(len(sums), side), left[node, f, b]
        if best is None:
            best = now
        else:
            more = now[0] > np.where(np.isfinite(best[0]), best[0] * (1 + 1e-12), best[0])
            best = tuple(np.where(more.reshape(-1, *[1] * (x.ndim - 1)), x, y) for x, y in zip(now, best))
    gain, f, b, side, left = best
    return columns[f], b, side, gain, left, total


def fit(df: DataFrame, features: Sequence[str], target: str, loss: str = SQUARED, n_classes: int = 2, settings: Settings | None = None) -> Boosted:
    """Boosts trees over the numeric ``features``; classes are numbers from 0."""
    s = settings or Settings()
    width = n_classes if loss == SOFTMAX else 1
    model = Boosted(loss, list(features), bin_edges(df, features, s.max_bins), np.zeros(width), [], np.zeros(len(features)))
    n_features, sizes = len(features), np.array([len(e) for e in model.edges])
    n_bins = int(sizes.max(initial=0)) + 2  # a bin for missing values and one above the last edge
    laid, n = laid_out(df, features, target, model.edges, loss != SQUARED)
    laid.persist(StorageLevel.MEMORY_AND_DISK)

    def totals(rows: Iterator) -> Iterator:
        out = np.zeros(2 + width)
        for *_, y in rows:
            out[:2] += len(y), y.sum()
            if loss == SOFTMAX:
                out[2:] += np.bincount(y.astype(np.int64), minlength=width)[:width]
        yield out

    def summed(rdd, parts: Callable) -> np.ndarray | None:
        sums = rdd.mapPartitions(parts)
        if rdd.getNumPartitions() > WIDE:
            return sums.treeReduce(np.add, 2)
        found = sums.collect()  # ``WIDE`` arrays of fixed size at most
        return sum(found[1:], found[0]) if found else None

    counts = summed(laid, totals)
    mean = counts[1] / n
    if loss == SQUARED:
        model.base[:] = mean
    elif loss == LOGISTIC:
        p = min(max(mean, 1e-6), 1 - 1e-6)
        model.base[:] = np.log(p / (1 - p))
    else:
        model.base[:] = np.log(np.maximum(counts[2:] / n, 1e-6))
    base = model.base.copy()
    # a partition: its number, its cells' bins and classes, its rows' cells and targets, its cells' margins
    state = laid.map(lambda p: (*p, np.repeat(base[None, :], len(p[1]), axis=0))).persist(StorageLevel.MEMORY_AND_DISK)
    kept = [laid, state]

    def round_sums(part: tuple, turn: int) -> tuple:
        """Bins, gradients and Hessians of the cells, over the rows that the round takes."""
        number, bins, own, idx, y, margin = part
        chosen = _sampled(len(y), s.subsample, (s.seed, turn, number))
        at = idx if chosen is None else idx[chosen]
        rows = np.bincount(at, minlength=len(bins)).astype(np.float64)[:, None]
        if loss == SQUARED:
            return bins, margin * rows - np.bincount(at, y if chosen is None else y[chosen], len(bins))[:, None], rows
        g, h = gradients(margin, own, loss)
        return bins, g * rows, h * rows

    for turn in range(s.n_estimators):
        rng = np.random.default_rng([s.seed, turn])
        take = max(1, round(s.colsample_bytree * n_features))
        columns = [np.sort(rng.permutation(n_features)[:take]) for _ in range(width)]
        group = [Tree() for _ in range(width)]
        cells = state.map(lambda part, turn=turn: round_sums(part, turn)).persist(StorageLevel.MEMORY_AND_DISK)
        for level in range(s.max_depth):
            nodes = 1 << level

            def level_sums(parts: Iterator, group=group, columns=columns, level=level, nodes=nodes) -> Iterator:
                out = np.zeros((width, nodes, take, n_bins, 2))
                for bins, g, h in parts:
                    for k, tree in enumerate(group):
                        node = tree.descend(bins, level)[0] if level else np.zeros(len(bins), np.int32)
                        on = node >= 0
                        at, gk, hk = node[on].astype(np.int64) * n_bins, g[on, k], h[on, k]
                        for i, f in enumerate(columns[k]):
                            code = at + bins[on, f]
                            for z, weight in enumerate((gk, hk)):
                                out[k, :, i, :, z] += np.bincount(code, weight, nodes * n_bins).reshape(nodes, n_bins)
                yield out

            sums = summed(cells, level_sums)
            for k, tree in enumerate(group):
                f, b, side, gain, left, total = best_splits(sums[k], columns[k], s, sizes)
                split = gain > 1e-9
                leaf = _leaf(total, s)
                tree.feature.append(np.where(split, f, -1).astype(np.int32))
                tree.split.append(b)
                tree.missing_left.append(side)
                tree.value.append(leaf)
                np.add.at(model.gains, f[split], gain[split])
                if level == s.max_depth - 1:
                    tree.value.append(_leaf(np.stack((left, total - left), axis=1).reshape(-1, 2), s))
            if not any((t.feature[-1] >= 0).any() for t in group):
                break
        for tree in group:
            if len(tree.value) == len(tree.feature):  # stopped early: nothing goes below the last level
                tree.value.append(np.zeros(2 * len(tree.feature[-1])))
        model.trees.append(group)

        cells.unpersist()

        def moved(part: tuple, group=group) -> tuple:
            return *part[:5], part[5] + np.stack([t.predict(part[1]) for t in group], axis=1)

        state = state.map(moved).persist(StorageLevel.MEMORY_AND_DISK)
        if (turn + 1) % KEEP_ROUNDS == 0 and turn + 1 < s.n_estimators:
            state.checkpoint()  # to the reliable folder, with the next level's job
        kept.append(state)
        if len(kept) > 2:
            kept.pop(0).unpersist()
    for rdd in kept:
        rdd.unpersist()
    total = model.gains.sum()
    model.gains = model.gains / total if total > 0 else model.gains
    return model


def to_dict(model: Boosted) -> dict:
    """The model as plain lists."""
    tree = lambda t: {c: [x.tolist() for x in getattr(t, c)] for c in ("feature", "split", "missing_left", "value")}
    plain = {"loss": model.loss, "features": model.features, "edges": [e.tolist() for e in model.edges], "base": model.base.tolist()}
    return {**plain, "gains": model.gains.tolist(), "trees": [[tree(t) for t in group] for group in model.trees]}


def from_dict(plain: dict) -> Boosted:
    types = {"feature": np.int32, "split": np.int64, "missing_left": bool, "value": np.float64}
    trees = [[Tree(**{c: [np.array(x, d) for x in t[c]] for c, d in types.items()}) for t in group] for group in plain["trees"]]
    edges = [np.array(e, np.float64) for e in plain["edges"]]
    return Boosted(plain["loss"], plain["features"], edges, np.array(plain["base"]), trees, np.array(plain["gains"]))


def _leaf(total: np.ndarray, s: Settings) -> np.ndarray:
    g, h = total[:, 0], total[:, 1]
    soft = np.sign(g) * np.maximum(np.abs(g) - s.reg_alpha, 0.0)
    with np.errstate(invalid="ignore", divide="ignore"):
        return np.where(h + s.reg_lambda > 0, -s.learning_rate * soft / (h + s.reg_lambda), 0.0)
