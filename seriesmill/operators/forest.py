"""Random forests on histograms: means of numbers, shares of classes.

Rows are binned and dealt out once (``layout``). A tree weighs every row by a Poisson draw of mean 1 that follows from (seed,
tree, partition), or by 1 without bootstrap, and adds up weights and targets by cell; nodes are split where the sums of squares
(Gini shares of classes) gain most, over features drawn per node. Trees grow in three ways, with the same splits:

* levels: partitions add up by (tree, node, feature, bin); the sums of a tree meet in one task, which picks its splits;
* a node of few rows is finished in one task, which gets the node's cells (``LOCAL_ROWS`` at most);
* when all distinct bin vectors are few (``LOCAL_CELLS``), a tree's sums by cell meet in one task, which grows all of it. Rows
  are dealt out in the order of their cells then, so a sum leaves one or two partitions, however many there are.

Without bootstrap all trees have the same sums, which are added up once; where every node also sees all features the trees are
equal, so one is grown and counts for all. Forests over the same rows (``Prepared``) share the sums of trees of equal number.

A job handles as many trees and nodes as fit in ``JOB_BYTES`` of sums, so memory does not grow with trees, depth or rows. Missing
values have the lowest bin. Only splits and finished trees reach the driver.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field
from threading import Lock

import numpy as np
import pyarrow as pa
from pyspark import RDD, Broadcast, StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seriesmill.functions.columns import as_double
from seriesmill.operators.boosting import bin_edges
from seriesmill.operators.layout import binned, floats, laid_out, numbered_cells

MAX_BINS = 64
MAX_DEPTH = 30
LOCAL_CELLS = 1 << 16  # distinct bin vectors of the whole table, up to which a tree grows in one task
LOCAL_ROWS = 1 << 16  # rows of a node, up to which its subtree does
JOB_BYTES = 64 << 20  # sums that one task of a job may hold
KNOWN_BYTES = 4 << 20  # predictions at known bin vectors
KEEP_BYTES = 1 << 31  # sums that forests over the same rows may share
NODES_AT_ONCE = 512  # nodes of a subtree whose histograms are made together
CHUNK = 1 << 15


@dataclass
class Settings:
    n_estimators: int = 100
    max_depth: int = 10
    min_samples_leaf: int = 2
    max_features: str | float | int | None = "sqrt"
    bootstrap: bool = True
    max_bins: int = MAX_BINS
    seed: int = 42

    def __post_init__(self):
        if self.n_estimators < 1 or self.min_samples_leaf < 1 or not 2 <= self.max_bins <= 255:
            raise ValueError("n_estimators and min_samples_leaf must be 1 or more, max_bins 2 to 255")
        if self.max_depth < 0:
            raise ValueError("max_depth must be 0 or more")
        self.max_depth = min(MAX_DEPTH, self.max_depth)
        self.drawn(1)

    def drawn(self, n: int) -> int:
        """Features drawn per node, of ``n``."""
        v = self.max_features
        named = {"sqrt": math.ceil(math.sqrt(n)), "log2": math.ceil(math.log2(n)) if n > 1 else 1, "onethird": math.ceil(n / 3), "all": n, None: n}
        if v in named:
            return max(1, named[v])
        if isinstance(v, str) or v <= 0:
            raise ValueError(f"unknown max_features {v!r}")
        return max(1, min(n, math.ceil(v * n) if v <= 1 else int(v)))


@dataclass
class Tree:
    """Nodes as arrays: a row goes to ``left`` (bin <= ``split``) or ``left`` + 1; a leaf points to itself. ``value`` per node."""

    feature: np.ndarray
    split: np.ndarray
    left: np.ndarray
    value: np.ndarray
    gains: np.ndarray  # per feature
    depth: int

    def leaves(self, bins: np.ndarray, start: np.ndarray | None = None) -> np.ndarray:
        flat, base = bins.ravel(), np.arange(len(bins)) * bins.shape[1]
        node = np.zeros(len(bins), np.int32) if start is None else start
        for _ in range(self.depth):
            node = self.left[node] + (flat[base + self.feature[node]] > self.split[node])
        return node


class Growing:
    """A tree while its levels are split: nodes as arrays, with the sums of each; a leaf points to itself."""

    def __init__(self, total: np.ndarray, n_features: int):
        self.feature, self.split, self.left = np.zeros(1, np.int64), np.full(1, 255), np.zeros(1, np.int64)
        self.sums, self.gains = total[None, :].astype(np.float64), np.zeros(n_features)

    def grow(self, nodes: np.ndarray, found: tuple, s: Settings, classes: bool) -> np.ndarray:
        """Splits ``nodes`` as ``found``; the children that may be split again, with their rows as a second column."""
        feature, split, gain, total, left = found
        self.sums[nodes] = total
        on = gain > 0
        child = len(self.left) + 2 * np.arange(on.sum())
        self.feature[nodes[on]], self.split[nodes[on]], self.left[nodes[on]] = feature[on], split[on], child
        np.add.at(self.gains, feature[on], gain[on])
        sums = np.stack((left[on], total[on] - left[on]), axis=1).reshape(-1, total.shape[1])
        new = len(self.left) + np.arange(len(sums))
        self.feature = np.concatenate((self.feature, np.zeros(len(new), np.int64)))
        self.split = np.concatenate((self.split, np.full(len(new), 255)))
        self.left = np.concatenate((self.left, new))
        self.sums = np.concatenate((self.sums, sums))
        n = sums.sum(axis=1) if classes else sums[:, 0]
        again = n >= 2 * s.min_samples_leaf
        if classes:
            again &= sums.max(axis=1, initial=0.0) < n
        return np.stack((new[again], n[again]), axis=1)

    def graft(self, node: int, tree: Growing) -> None:
        """Puts a subtree in the place of a node."""
        at = np.arange(len(tree.left)) + len(self.left) - 1
        at[0] = node
        self.feature[node], self.split[node], self.left[node], self.sums[node] = tree.feature[0], tree.split[0], at[tree.left[0]], tree.sums[0]
        self.feature, self.split = np.concatenate((self.feature, tree.feature[1:])), np.concatenate((self.split, tree.split[1:]))
        self.left, self.sums = np.concatenate((self.left, at[tree.left[1:]])), np.concatenate((self.sums, tree.sums[1:]))
        self.gains += tree.gains

    def done(self, depth: int, classes: bool) -> Tree:
        n = self.sums.sum(axis=1, keepdims=True) if classes else self.sums[:, :1]
        value = (self.sums if classes else self.sums[:, 1:]) / np.maximum(n, 1e-300)
        total = self.gains.sum()
        gains = self.gains / total if total > 0 else self.gains
        return Tree(self.feature.astype(np.int16), self.split.astype(np.uint8), self.left.astype(np.int32), value, gains, depth)


UPTO = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(16)])  # chances of a Poisson draw of mean 1 to be k at most


def _drawn(n: int, s: Settings, tree: int, part: int) -> Iterator[np.ndarray]:
    """A weight per row, Poisson draws of mean 1, ``CHUNK`` at a time in the same memory."""
    rng = np.random.Generator(np.random.SFC64([s.seed, tree, part])) if s.bootstrap else None
    size = min(CHUNK, n)
    u, k, over, out = np.empty(size), np.empty(size, np.uint8), np.empty(size, bool), np.ones(size)
    for i in range(0, n, CHUNK):
        if n - i < size:
            u, k, over, out = (x[: n - i] for x in (u, k, over, out))
        if rng is not None:
            rng.random(out=u)
            np.greater_equal(u, UPTO[0], out=k.view(bool))
            for limit in UPTO[1:4]:
                k += np.greater_equal(u, limit, out=over).view(np.uint8)
            more = np.flatnonzero(k == 4)  # few rows are drawn more often
            k[more] += np.searchsorted(UPTO[4:], u[more], "right").astype(np.uint8)
            out[:] = k
        yield out


def _draws(n: int, s: Settings, tree: int, part: int) -> np.ndarray:
    return np.concatenate([np.zeros(0), *(w.copy() for w in _drawn(n, s, tree, part))])


def _cell_sums(n_cells: int, at: np.ndarray, y: np.ndarray, w: np.ndarray, n_classes: int) -> np.ndarray:
    """By cell: weight and weighted target, or the weight of every class."""
    if n_classes:
        return np.bincount(at * n_classes + y.astype(np.int64), w, n_cells * n_classes).reshape(n_cells, n_classes)
    return np.stack((np.bincount(at, w, n_cells), np.bincount(at, w * y, n_cells)), axis=1)


def _run_sums(starts: np.ndarray, y: np.ndarray, draws: Iterator[np.ndarray], n_classes: int) -> np.ndarray:
    """``_cell_sums`` of rows that lie in the order of their cells; ``starts`` are the cells' first rows."""
    out, lo, drawn = np.zeros((len(starts), n_classes or 2)), 0, np.empty(min(CHUNK, len(y)))
    for w in draws:
        hi = lo + len(w)
        a, b = np.searchsorted(starts, lo, "right") - 1, np.searchsorted(starts, hi)
        at = np.maximum(starts[a:b] - lo, 0)
        if n_classes:
            out[a:b] += _cell_sums(b - a, np.repeat(np.arange(b - a), np.diff(at, append=len(w))), y[lo:hi], w, n_classes)
        else:
            out[a:b, 0] += np.add.reduceat(w, at)
            out[a:b, 1] += np.add.reduceat(np.multiply(w, y[lo:hi], out=drawn[: len(w)]), at)
        lo = hi
    return out


def _node_features(s: Settings, tree: int, nodes: np.ndarray, n_features: int, salt: int = 0) -> np.ndarray:
    """Features of every node, by (seed, tree, first node of the level): nodes of a level are asked for together or in order."""
    k = s.drawn(n_features)
    if k == n_features:
        return np.broadcast_to(np.arange(n_features), (len(nodes), n_features))
    draws = np.random.default_rng([s.seed, tree, salt, int(nodes[0])]).random((len(nodes), n_features))
    return np.sort(np.argsort(draws, axis=1)[:, :k], axis=1)


def _short_histogram(bins: np.ndarray, sums: np.ndarray, slot: np.ndarray, picks: np.ndarray, n_bins: int) -> tuple[np.ndarray, np.ndarray]:
    """``_histogram`` without the bins that a node has no cell in, and the bin at every place; padded to the longest list."""
    m, k = picks.shape
    rows, places, found = np.arange(len(bins)), [], []
    for j in range(k):
        b = bins[rows, picks[slot, j]]
        seen = np.zeros((m, n_bins), bool)
        seen[slot, b] = True
        rank = np.cumsum(seen, axis=1, dtype=np.uint8)
        places.append(rank[slot, b] - 1)
        found.append((seen, rank))
    width = max(2, max(int(rank[:, -1].max(initial=0)) for _, rank in found))
    out, at = np.empty((m, k, width, sums.shape[1])), np.zeros((m, k, width), np.uint8)
    for j, (place, (seen, rank)) in enumerate(zip(places, found)):
        node, b = np.nonzero(seen)
        at[node, j, rank[node, b] - 1] = b
        code = slot * width + place
        for c in range(sums.shape[1]):
            out[:, j, :, c] = np.bincount(code, sums[:, c], m * width).reshape(m, width)
    return out, at


def _histogram(bins: np.ndarray, sums: np.ndarray, slot: np.ndarray, picks: np.ndarray, n_bins: int) -> np.ndarray:
    """(node, picked feature, bin, channel) sums of cells; ``slot`` is the place of a cell's node."""
    m, k = picks.shape
    out, rows = np.empty((m, k, n_bins, sums.shape[1])), np.arange(len(bins))
    for j in range(k):
        code = slot * n_bins + (bins[:, picks[0, j]] if m == 1 else bins[rows, picks[slot, j]])
        for c in range(sums.shape[1]):
            out[:, j, :, c] = np.bincount(code, sums[:, c], m * n_bins).reshape(m, n_bins)
    return out


def _best(hist: np.ndarray, picks: np.ndarray, s: Settings, classes: bool, bin_at: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """(feature, last bin to the left, gain or 0, sums of the node, sums of its left side) per node; ``bin_at``: bins by place."""

    def size(x: np.ndarray) -> np.ndarray:
        return x.sum(axis=-1) if classes else x[..., 0]

    def score(x: np.ndarray) -> np.ndarray:
        square = (x * x).sum(axis=-1) if classes else x[..., 1] ** 2
        return square / np.maximum(size(x), 1e-300)

    total = hist[:, 0].sum(axis=1)
    left = np.cumsum(hist, axis=2)[:, :, :-1]
    right = total[:, None, None] - left
    whole = score(total)[:, None, None]
    gain = score(left) + score(right) - whole
    fits = (size(left) >= s.min_samples_leaf) & (size(right) >= s.min_samples_leaf) & (gain > 1e-10 * np.abs(whole))
    gain = np.where(fits, gain, 0.0).reshape(len(hist), -1)
    at = gain.argmax(axis=1)
    node = np.arange(len(hist))
    j, b = np.divmod(at, left.shape[2])
    return picks[node, j], b if bin_at is None else bin_at[node, j, b].astype(np.int64), gain[node, at], total, left[node, j, b]


def grow_here(bins: np.ndarray, sums: np.ndarray, s: Settings, tree: int, depth: int, n_bins: int, classes: bool, salt: int = 0) -> tuple[Growing, int, np.ndarray]:
    """A tree (or subtree) over cells in memory, its depth, and the leaf of every cell."""
    made, node, reached = Growing(sums.sum(axis=0), bins.shape[1]), np.zeros(len(bins), np.int64), 0
    frontier = np.zeros(1, np.int64)
    per_node = s.drawn(bins.shape[1]) * n_bins * sums.shape[1] * 8
    step = min(NODES_AT_ONCE, max(1, JOB_BYTES // (8 * per_node)))
    live = np.arange(len(bins))  # cells of nodes that may be split
    for level in range(depth):
        slot_of = np.full(len(made.left), -1)
        slot_of[frontier] = np.arange(len(frontier))
        slot = slot_of[node[live]]
        live, slot = live[slot >= 0], slot[slot >= 0]
        # nodes of like size are taken together, so that none is padded to the length of a much larger one
        by_size, own = np.arange(len(frontier)), [slice(None)]
        if len(frontier) > step:
            by_size = np.argsort(-np.bincount(slot, minlength=len(frontier)), kind="stable")
        turn = np.empty(len(frontier), np.int64)
        turn[by_size] = np.arange(len(frontier))
        if len(frontier) > step:
            group = (turn // step)[slot]
            order = np.argsort(group.astype(np.uint16) if len(frontier) <= step << 16 else group, kind="stable")
            own = np.split(order, np.searchsorted(group[order], np.arange(1, -(-len(frontier) // step))))
        picks = _node_features(s, tree, frontier, bins.shape[1], salt)
        parts = []
        for lo, part in zip(range(0, len(frontier), step), own):
            part, here = live[part], picks[by_size[lo : lo + step]]
            at_node = turn[slot[own[lo // step]]] - lo
            if len(here) * n_bins <= len(part):
                parts.append(_best(_histogram(bins[part], sums[part], at_node, here, n_bins), here, s, classes))
            else:
                hist, at = _short_histogram(bins[part], sums[part], at_node, here, n_bins)
                parts.append(_best(hist, here, s, classes, at))
        frontier = made.grow(frontier, tuple(np.concatenate(x)[turn] for x in zip(*parts)), s, classes)[:, 0].astype(np.int64)
        at = node[live]
        node[live] = made.left[at] + (bins[live, made.feature[at]] > made.split[at])
        if len(made.left) > len(slot_of):
            reached = level + 1
        if not len(frontier):
            break
    return made, reached, node


ARRAYS = {"feature": np.int16, "split": np.uint8, "left": np.int32, "value": np.float64, "gains": np.float64}
TREES = "tree int, feature binary, split binary, left binary, value binary, gains binary, depth int"


def from_row(row, width: int) -> Tree:
    """A tree from a row of ``TREES``."""
    arrays = {c: np.frombuffer(row[c], kind) for c, kind in ARRAYS.items()}
    return Tree(**{**arrays, "value": arrays["value"].reshape(-1, width)}, depth=row["depth"])


class Later(Sequence):
    """Trees that are brought to the driver where somebody asks for them."""

    def __init__(self, n: int, grow: Callable[[], list[Tree]]):
        self.n, self.grow, self.held = n, grow, None

    def __len__(self) -> int:
        return self.n

    def __getitem__(self, i):
        if self.held is None:
            self.held = self.grow()
        return self.held[i]


def _codes(bins: np.ndarray, sizes: Sequence[int]) -> np.ndarray:
    """A number per bin vector; there are as many as the product of ``sizes``."""
    code = np.zeros(len(bins), np.int64)
    for i, size in enumerate(sizes):
        code = code * size + bins[:, i]
    return code


@dataclass
class Known:
    """What a forest predicts at every bin vector of ``rows``, in the order of the vectors' numbers."""

    rows: DataFrame
    codes: np.ndarray
    values: np.ndarray


@dataclass
class Forest:
    features: list[str]
    edges: list[np.ndarray]
    n_classes: int  # 0: numbers
    trees: Sequence[Tree]
    known: Known | None = None

    @property
    def gains(self) -> np.ndarray:
        total = sum((t.gains for t in self.trees), np.zeros(len(self.features)))
        return total / total.sum() if total.sum() > 0 else total

    def column(self, df: DataFrame) -> Column:
        """An array of double per row: the prediction, or the share of every class."""
        features, edges, width, n_trees = self.features, self.edges, max(1, self.n_classes), len(self.trees)
        sc, sizes = df.sparkSession.sparkContext, [len(e) + 2 for e in self.edges]
        if self.known is not None and df is self.known.rows:
            table, trees = sc.broadcast((self.known.codes, self.known.values)), None
        else:
            same = Counter(map(id, self.trees))  # equal trees of one forest are one object
            table, trees = None, sc.broadcast([(t, same[id(t)]) for t in {id(t): t for t in self.trees}.values()])

        @F.arrow_udf("array<double>")
        def of(*columns: pa.Array) -> pa.Array:
            values, outs = [floats(c) for c in columns], []
            for i in range(0, len(values[0]), 8192):
                bins = binned([v[i : i + 8192] for v in values], edges)
                if table is not None:
                    codes, known = table.value
                    code = _codes(bins, sizes)
                    at = np.minimum(np.searchsorted(codes, code), len(codes) - 1)
                    if (codes[at] != code).any():
                        raise ValueError("rows have changed since their bin vectors were listed")
                    outs.append(known[at])
                    continue
                out = np.zeros((len(bins), width))
                for tree, times in trees.value:
                    out += times * tree.value[tree.leaves(bins)]
                outs.append(out / n_trees)
            out = np.concatenate(outs or [np.zeros((0, width))])
            return pa.ListArray.from_arrays(pa.array(np.arange(0, out.size + 1, width, dtype=np.int32)), pa.array(out.ravel()))

        return of(*[as_double(df, f) for f in features])


def _all_cells(laid: RDD) -> np.ndarray | None:
    """The distinct bin vectors in order, or None when there are more than ``LOCAL_CELLS``."""

    def joined(a: np.ndarray | None, b: np.ndarray | None) -> np.ndarray | None:
        out = None if a is None or b is None else np.unique(np.concatenate((a, b)), axis=0)
        return None if out is None or len(out) > LOCAL_CELLS else out

    return laid.map(lambda p: p[1] if len(p[1]) <= LOCAL_CELLS else None).treeReduce(joined, 2)


def _places(cells: np.ndarray, bins: np.ndarray) -> np.ndarray:
    """Numbers of bin vectors in a table that holds them all."""
    _, idx = numbered_cells(np.concatenate((cells, bins)))
    place = np.zeros(len(cells), np.int64)
    place[idx[: len(cells)]] = np.arange(len(cells))
    return place[idx[len(cells) :]]


def _runs(cells: np.ndarray) -> np.ndarray:
    """Where another cell begins, in an order of cells."""
    return np.flatnonzero(np.diff(cells.astype(np.int64), prepend=-1))


def _in_cell_order(laid: RDD, cells: np.ndarray) -> RDD:
    """The rows dealt out anew by cell: (partition, its cells, first row of each, target by row).

    The order of cells is cut into parts of equal size; a cell of many rows lies in several, and gets the same share of its rows
    from every partition.
    """
    table, parts = laid.context.broadcast(cells), laid.getNumPartitions()
    small = np.uint16 if len(cells) <= 1 << 16 else np.int32  # 16 bits are sorted by counting
    counts = laid.map(lambda p: np.bincount(_places(table.value, p[1])[p[3]], minlength=len(table.value))).treeReduce(np.add, 2)
    held, total = laid.context.broadcast((np.cumsum(counts) - counts, counts)), int(counts.sum())

    def dealt(rows: Iterator) -> Iterator:
        first, size = held.value
        for number, bins, _, idx, y in rows:
            cell = _places(table.value, bins).astype(small)[idx]
            order = np.argsort(cell, kind="stable")
            cell, y = cell[order], y[order]
            starts = _runs(cell)
            own = np.diff(starts, append=len(cell))
            share = (np.arange(len(cell)) - np.repeat(starts, own) + 0.5) / np.repeat(own, own)
            rank = first[cell] + (share * size[cell]).astype(np.int64)
            cuts = np.searchsorted(rank * parts // total, np.arange(parts + 1))
            for to in np.flatnonzero(np.diff(cuts)).tolist():
                yield to, (number, cell[cuts[to] : cuts[to + 1]], y[cuts[to] : cuts[to + 1]])

    def joined(number: int, rows: Iterator) -> Iterator:
        held = sorted((r for _, r in rows), key=lambda r: r[0])
        if held:
            cell, y = np.concatenate([r[1] for r in held]), np.concatenate([r[2] for r in held])
            order = np.argsort(cell, kind="stable")
            cell = cell[order]
            starts = _runs(cell)
            yield number, cell[starts], starts, y[order]

    return laid.mapPartitions(dealt).partitionBy(parts, int).mapPartitionsWithIndex(joined)


@dataclass
class Prepared:
    """Binned rows in memory for any number of forests.

    Where their distinct bin vectors, ``cells``, are few (else None), the rows lie in the order of cells. Then forests share sums
    of up to ``trees`` trees, and predict all vectors of a ``covered`` table as they grow.
    """

    features: list[str]
    edges: list[np.ndarray]
    laid: RDD
    cells: np.ndarray | None
    max_bins: int
    trees: int = 0
    covered: DataFrame | None = None
    others: np.ndarray | None = None  # bin vectors of ``covered`` that are not among the cells
    table: Broadcast | None = None  # cells and others
    shared: dict = field(default_factory=dict)
    lock: Lock = field(default_factory=Lock)

    def cover(self, df: DataFrame) -> None:
        """Lists the bin vectors of ``df``; too many, or any number of them without cells, are left to the trees."""
        edges, names, sizes = self.edges, [f"x{i}" for i in range(len(self.features))], [len(e) + 2 for e in self.edges]
        if self.cells is None or math.prod(sizes) >= 1 << 62:
            return
        known = df.sparkSession.sparkContext.broadcast(np.sort(_codes(self.cells, sizes)))

        def unknown(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held = np.zeros(0, np.int64)
            for batch in batches:
                code = _codes(binned([floats(batch.column(c)) for c in names], edges), sizes)
                at = np.minimum(np.searchsorted(known.value, code), len(known.value) - 1)
                held = np.union1d(held, code[known.value[at] != code])
                if len(held) > LOCAL_CELLS:
                    break  # too many already
            yield pa.RecordBatch.from_arrays([pa.array(held)], ["code"])

        rows = df.select(*[as_double(df, f).alias(c) for f, c in zip(self.features, names)])
        found = rows.mapInArrow(unknown, "code bigint").distinct().limit(LOCAL_CELLS + 1).toArrow()["code"].to_numpy()
        known.destroy()
        if len(found) <= LOCAL_CELLS:
            rest, columns = np.sort(found), []
            for size in reversed(sizes):
                rest, own = np.divmod(rest, size)
                columns.append(own.astype(np.uint8))
            self.others, self.covered = np.stack(columns[::-1], axis=1), df

    def sums(self, s: Settings, trees: range, n_classes: int) -> tuple[RDD, int]:
        """(key, sums by cell) and the number of keys: a key per tree of a forest, or without bootstrap one per task."""
        sc, per_tree = self.laid.context, len(self.cells) * max(2, n_classes) * 8
        tasks = max(1, min(4 * sc.defaultParallelism, max(self.trees, trees.stop)))
        if not s.bootstrap:
            tasks = max(1, min(tasks, JOB_BYTES // per_tree))
            trees = range(tasks)
        elif trees.start == 0 and trees.stop < self.trees and per_tree * self.trees <= KEEP_BYTES:
            trees = range(self.trees)
        n_cells = len(self.cells)

        def added(parts: Iterator) -> Iterator:
            for number, cells, starts, y in parts:
                found = None
                for key in trees:
                    if s.bootstrap or found is None:
                        found = _run_sums(starts, y, _drawn(len(y), s, key, number), n_classes)
                    yield key, (number, cells, found)

        def met(parts: Iterator) -> Iterator:
            held = defaultdict(list)
            for key, found in parts:
                held[key].append(found)
            for key in sorted(held):
                out = np.zeros((n_cells, n_classes or 2))
                for _, cells, found in sorted(held.pop(key), key=lambda f: f[0]):  # in the same order wherever they come from
                    out[cells] += found
                yield key, out

        name = (s.bootstrap, s.seed if s.bootstrap else 0, n_classes, trees)
        with self.lock:
            if name not in self.shared:
                made = self.laid.mapPartitions(added).partitionBy(tasks, int).mapPartitions(met)
                if per_tree * len(trees) > KEEP_BYTES or not self.trees:
                    return made, tasks
                made.persist(StorageLevel.MEMORY_AND_DISK).count()
                self.shared[name] = made
            return self.shared[name], tasks

    def free(self) -> None:
        for rdd in (self.laid, *self.shared.values()):
            rdd.unpersist()


def prepared(df: DataFrame, features: Sequence[str], target: str, max_bins: int = MAX_BINS) -> Prepared:
    """Bins the rows once; ``free()`` gives up the memory."""
    edges = bin_edges(df, features, max_bins)
    laid, _ = laid_out(df, features, target, edges, False)
    laid.persist(StorageLevel.MEMORY_AND_DISK)
    cells = _all_cells(laid)
    if cells is not None:
        dealt, laid = laid, _in_cell_order(laid, cells).persist(StorageLevel.MEMORY_AND_DISK)
        laid.count()
        dealt.unpersist()
    return Prepared(list(features), edges, laid, cells, max_bins)


def fit(df: DataFrame, features: Sequence[str], target: str, n_classes: int = 0, settings: Settings | None = None, rows: Prepared | None = None) -> Forest:
    """A forest over the numeric ``features``; classes are numbers from 0, ``n_classes`` 0 is for a number as target.

    ``rows`` are the rows of ``df`` as ``prepared`` gave them, where several forests share them.
    """
    s = settings or Settings()
    own = rows is None or rows.max_bins != s.max_bins
    held = prepared(df, features, target, s.max_bins) if own else rows
    n_bins = max((len(e) for e in held.edges), default=0) + 2
    try:
        if held.covered is not None and (len(held.cells) + len(held.others)) * max(1, n_classes) * 8 <= KNOWN_BYTES:
            known = _known(held, s, n_bins, n_classes)
            return Forest(list(features), held.edges, n_classes, Later(s.n_estimators, lambda: _by_cells(held, s, n_bins, n_classes)), known)
        if held.cells is not None:
            grown = _by_cells(held, s, n_bins, n_classes)
        else:
            grown = _by_levels(held.laid, len(features), s, n_bins, n_classes)
    finally:
        if own:
            held.free()
    return Forest(list(features), held.edges, n_classes, grown)


def _tasks(laid: RDD, n: int) -> int:
    return max(1, min(n, 4 * laid.context.defaultParallelism))


def _grown(held: Prepared, s: Settings, n_bins: int, n_classes: int) -> Iterator[RDD]:
    """(tree's number, tree, leaf of every cell), as many trees at a time as tasks may hold the sums of."""
    classes, cells = n_classes > 0, held.cells
    n_grown = 1 if _all_equal(s, cells.shape[1]) else s.n_estimators
    if held.table is None:
        held.table = held.laid.context.broadcast(cells)
    table = held.table
    at_once = max(1, JOB_BYTES // (len(cells) * max(2, n_classes) * 8)) * 4 * held.laid.context.defaultParallelism
    for first in range(0, n_grown, at_once if s.bootstrap else n_grown):
        batch = range(first, min(first + at_once, n_grown) if s.bootstrap else n_grown)
        sums, tasks = held.sums(s, batch, n_classes)

        def grown(parts: Iterator, batch=batch, tasks=tasks) -> Iterator:
            for key, total in parts:
                for tree in [key] if s.bootstrap else batch[key::tasks]:
                    if tree in batch:  # the sums may be those of a larger forest
                        made, depth, leaf = grow_here(table.value, total, s, tree, s.max_depth, n_bins, classes)
                        yield tree, made.done(depth, classes), leaf

        yield sums.mapPartitions(grown)


def _by_cells(held: Prepared, s: Settings, n_bins: int, n_classes: int) -> list[Tree]:
    """Sums by cell meet tree by tree; a task holds one tree's ``LOCAL_CELLS`` at a time."""
    trees = {}
    for grown in _grown(held, s, n_bins, n_classes):
        trees.update(grown.map(lambda g: g[:2]).collect())  # the model
    return [trees[t % len(trees)] for t in range(s.n_estimators)]


def _known(held: Prepared, s: Settings, n_bins: int, n_classes: int) -> Known:
    """What the forest predicts at the cells and the other vectors of the covered table; the trees stay where they grow."""
    others, n_cells, width, total, n = held.others, len(held.cells), max(1, n_classes), 0.0, 0

    def values(grown: Iterator) -> Iterator:
        out, n = np.zeros((n_cells + len(others), width)), 0
        for _, tree, leaf in grown:
            out[:n_cells] += tree.value[leaf]
            out[n_cells:] += tree.value[tree.leaves(others)]
            n += 1
        if n:
            yield out, n

    for grown in _grown(held, s, n_bins, n_classes):
        for out, k in grown.mapPartitions(values).collect():  # ``KNOWN_BYTES`` a task at most
            total, n = total + out, n + k
    code = _codes(np.concatenate((held.cells, others)), [len(e) + 2 for e in held.edges])
    order = np.argsort(code)
    return Known(held.covered, code[order], (total / n)[order])


def _all_equal(s: Settings, n_features: int) -> bool:
    """Whether nothing is drawn, neither rows nor features, so that all trees are the same."""
    return not s.bootstrap and s.drawn(n_features) == n_features


def _by_levels(laid: RDD, n_features: int, s: Settings, n_bins: int, n_classes: int) -> list[Tree]:
    """Level by level over all partitions; nodes of few rows leave for one task each."""
    classes, width = n_classes > 0, max(2, n_classes)
    total = laid.map(lambda p: _cell_sums(1, np.zeros(len(p[4]), np.int64), p[4], np.ones(len(p[4])), n_classes)[0]).reduce(np.add)
    made = [Growing(total, n_features) for _ in range(s.n_estimators)]
    depths = [0] * s.n_estimators
    todo = [np.zeros(1, np.int64) for _ in made]
    per_node = s.drawn(n_features) * n_bins * width * 8

    def at_nodes(part: tuple, t: int, tree: Tree, nodes: np.ndarray) -> tuple:
        """Sums of a partition's cells in ``nodes``, and the places of these."""
        number, bins, _, idx, y = part
        node = tree.leaves(bins)
        slot_of = np.full(len(tree.left), -1)
        slot_of[nodes] = np.arange(len(nodes))
        slot = slot_of[node]
        on = slot >= 0
        sums = _cell_sums(len(bins), idx.astype(np.int64), y, _draws(len(y), s, t, number), n_classes)
        return bins[on], sums[on], slot[on]

    def so_far(t: int) -> Tree:
        g = made[t]
        return Tree(g.feature.astype(np.int16), g.split.astype(np.uint8), g.left.astype(np.int32), np.zeros((0, 1)), np.zeros(0), depths[t])

    def in_jobs(items: list[tuple[int, np.ndarray, int]]) -> Iterator[dict]:
        """Items (tree, nodes, bytes) in groups of ``JOB_BYTES``."""
        held, size = [], 0
        for t, nodes, cost in items:
            if held and size + cost > JOB_BYTES:
                yield held
                held, size = [], 0
            held.append((t, nodes))
            size += cost
        if held:
            yield held

    for level in range(s.max_depth):
        step = max(1, JOB_BYTES // per_node)
        items = [(t, nodes[i : i + step], len(nodes[i : i + step]) * per_node) for t, nodes in enumerate(todo) for i in range(0, len(nodes), step)]
        nexts = defaultdict(list)
        for job in in_jobs(items):
            work = laid.context.broadcast([(t, so_far(t), nodes, _node_features(s, t, nodes, n_features)) for t, nodes in job])

            def sums(parts: Iterator, work=work) -> Iterator:
                for part in parts:
                    for i, (t, tree, nodes, picks) in enumerate(work.value):
                        bins, cell_sums, slot = at_nodes(part, t, tree, nodes)
                        yield i, _histogram(bins, cell_sums, slot, picks, n_bins)

            def chosen(parts: Iterator, work=work) -> Iterator:
                held = {}
                for i, hist in parts:
                    held[i] = held[i] + hist if i in held else hist
                for i, hist in held.items():
                    yield i, _best(hist, work.value[i][3], s, classes)

            found = laid.mapPartitions(sums).partitionBy(_tasks(laid, len(job)), int).mapPartitions(chosen).collect()  # a split per node
            work.unpersist()
            for i, best in sorted(found, key=lambda r: r[0]):
                t, nodes = job[i]
                nexts[t].append(made[t].grow(nodes, best, s, classes))
        small = []
        for t, rows in ((t, np.concatenate(r)) for t, r in nexts.items()):
            depths[t] = level + 1
            few = rows[:, 1] <= LOCAL_ROWS
            todo[t] = rows[~few, 0].astype(np.int64)
            if level + 1 < s.max_depth:
                small += [(t, int(node), int(n)) for node, n in rows[few]]
        for t in set(range(len(todo))) - set(nexts):
            todo[t] = np.zeros(0, np.int64)
        if small:
            _finish(laid, made, depths, small, at_nodes, so_far, in_jobs, level + 1, s, n_bins, classes)
        if not any(len(nodes) for nodes in todo):
            break
    return [g.done(s.max_depth, classes) for g in made]


def _finish(laid: RDD, made: list[Growing], depths: list[int], small: list, at_nodes, so_far, in_jobs, level: int, s: Settings, n_bins: int, classes: bool) -> None:
    """Grows the subtrees of small nodes, a node in one task, and puts them in their places."""
    by_tree = defaultdict(list)
    for t, node, _ in small:
        by_tree[t].append(node)
    trees = {t: so_far(t) for t in by_tree}
    parts = laid.getNumPartitions()
    cell = 1 + len(made[0].gains) + 8 * made[0].sums.shape[1]
    items = []
    for t, nodes in by_tree.items():
        rows = {node: n for u, node, n in small if u == t}
        held, size = [], 0
        for node in nodes:  # a partition holds about its share of a node's rows
            cost = -(-rows[node] // parts) * cell
            if held and size + cost > JOB_BYTES:
                items.append((t, np.array(held), size))
                held, size = [], 0
            held.append(node)
            size += cost
        items.append((t, np.array(held), size))
    for job in in_jobs(items):
        work = laid.context.broadcast([(t, trees[t], nodes) for t, nodes in job])

        def cells(rows: Iterator, work=work) -> Iterator:
            for part in rows:
                for t, tree, nodes in work.value:
                    bins, sums, slot = at_nodes(part, t, tree, nodes)
                    order = np.argsort(slot, kind="stable")
                    ends = np.searchsorted(slot[order], np.arange(len(nodes) + 1))
                    for i, node in enumerate(nodes.tolist()):
                        own = order[ends[i] : ends[i + 1]]
                        if len(own):
                            yield (t, node), (part[0], bins[own], sums[own])

        def grown(rows: Iterator) -> Iterator:
            held = defaultdict(list)
            for key, found in rows:
                held[key].append(found)
            for (t, node), found in held.items():
                found.sort(key=lambda f: f[0])
                bins, sums = np.concatenate([f[1] for f in found]), np.concatenate([f[2] for f in found])
                yield t, node, grow_here(bins, sums, s, t, s.max_depth - level, n_bins, classes, node)[0]

        n = _tasks(laid, sum(len(nodes) for _, nodes in job))
        place = lambda key: (key[0] * 1_000_003 + key[1]) % n  # noqa: B023, E731
        for t, node, tree in sorted(laid.mapPartitions(cells).partitionBy(n, place).mapPartitions(grown).collect(), key=lambda r: r[:2]):  # the model
            made[t].graft(node, tree)
        work.unpersist()
