"""Binned rows for trees: blocks of arrays dealt out to partitions of similar size, equal bin vectors numbered once.

How many partitions there are follows from the number of rows alone, so sums and seeded draws do not depend on the cluster or
on how many partitions the input had. In a partition every row points to its *cell*, a distinct vector of bins (and class, where
the class is part of it): rows of a cell go the same way in every tree. Rows are passed over to draw and to add up, trees
grow on cells. Where no two rows are equal a cell is a row.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import RDD, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriesmill.functions.columns import as_double
from seriesmill.session import materialize

BLOCK_ROWS = 1 << 16
PART_ROWS = 1 << 21  # rows of a partition of a large table: 13 bytes each and a byte per feature
FEW_PARTS = 16  # smaller tables are cut into up to so many


def floats(values: pa.Array) -> np.ndarray:
    return values.cast(pa.float64()).fill_null(float("nan")).to_numpy(zero_copy_only=False)


def binned(values: Sequence[np.ndarray], edges: Sequence[np.ndarray]) -> np.ndarray:
    """Bin 0 for missing values, else 1 + the number of edges below the value."""
    out = np.zeros((len(values[0]) if len(values) else 0, len(values)), np.uint8)
    for i, (v, edge) in enumerate(zip(values, edges)):
        out[:, i] = np.where(np.isnan(v), 0, 1 + np.searchsorted(edge, v, side="left"))
    return out


def blocks_of(df: DataFrame, features: Sequence[str], target: str, edges: Sequence[np.ndarray]) -> DataFrame:
    """Binned rows as arrays, about ``BLOCK_ROWS`` each, written to the shared folder. Rows without a target are left out."""
    names = [f"x{i}" for i in range(len(features))]
    rows = df.select(*[as_double(df, f).alias(n) for f, n in zip(features, names)], as_double(df, target).alias("y")).filter("y IS NOT NULL")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, seq = [], 0, 0
        part = TaskContext.get().partitionId()

        def block() -> pa.RecordBatch:
            bins, y = (np.concatenate(x) for x in zip(*held))
            cells = [pa.array([v], t) for v, t in ((part, pa.int32()), (seq, pa.int32()), (n, pa.int64()), (bins.tobytes(), pa.binary()), (y.tobytes(), pa.binary()))]
            return pa.RecordBatch.from_arrays(cells, ["part", "seq", "n", "bins", "y"])

        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK_ROWS):
                part_ = batch.slice(at, BLOCK_ROWS)
                held.append((binned([floats(part_.column(c)) for c in names], edges), floats(part_.column("y"))))
                n += part_.num_rows
                if n >= BLOCK_ROWS:
                    yield block()
                    held, n, seq = [], 0, seq + 1
        if n:
            yield block()

    return materialize(rows.mapInArrow(pack, "part int, seq int, n bigint, bins binary, y binary"))


def numbered_cells(bins: np.ndarray, y: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(first row of every distinct vector, its number per row); ``y`` holds class numbers that are part of the vector."""
    columns = [bins[:, i] for i in range(bins.shape[1])] + ([] if y is None else [y.astype(np.int64)])
    code, span = np.zeros(len(bins), np.int64), 1
    for c in columns:
        size = int(c.max(initial=0)) + 1
        if span * size >= 1 << 62:  # number what there is so far and go on with the numbers
            code = np.unique(code, return_inverse=True)[1].astype(np.int64)
            span = int(code.max(initial=0)) + 1
        code, span = code * size + c, span * size
    _, first, idx = np.unique(code, return_index=True, return_inverse=True)
    return first, idx.astype(np.int32)


def laid_out(df: DataFrame, features: Sequence[str], target: str, edges: Sequence[np.ndarray], classes: bool) -> tuple[RDD, int]:
    """One element per partition (its number, bins by cell, class by cell or None, cell by row, target by row), and the number of rows.

    With ``classes`` the class is part of the cell.
    """
    blocks, width = blocks_of(df, features, target, edges), len(features)
    sizes = sorted(tuple(r) for r in blocks.select("part", "seq", "n").collect())  # one row per block or input partition
    total = sum(n for _, _, n in sizes)
    if not total:
        raise ValueError("no rows with a target")
    parts = max(min(FEW_PARTS, -(-total // BLOCK_ROWS)), -(-total // PART_ROWS))
    place, upto = {}, 0
    for part, seq, n in sizes:
        place[part, seq] = (upto + n // 2) * parts // total
        upto += n

    def dealt(rows: Iterator) -> Iterator:
        for r in rows:
            yield place[r.part, r.seq], (r.part, r.seq, bytes(r.bins), bytes(r.y))

    def joined(number: int, rows: Iterator) -> Iterator:
        held = sorted((r for _, r in rows), key=lambda r: r[:2])
        if held:
            bins = np.frombuffer(b"".join(r[2] for r in held), np.uint8).reshape(-1, width)
            y = np.frombuffer(b"".join(r[3] for r in held), np.float64)
            first, idx = numbered_cells(bins, y if classes else None)
            yield number, bins[first], y[first] if classes else None, idx, y

    return blocks.rdd.mapPartitions(dealt).partitionBy(parts, int).mapPartitionsWithIndex(joined), total
