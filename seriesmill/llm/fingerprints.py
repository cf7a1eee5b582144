"""Bottom-k sketches of shingle hashes.

A sketch is the k smallest distinct hashes of a text's shingles (five words unless told otherwise; fewer words make one
shingle). Sketches merge by union, so those of parts give that of the whole. From two sketches follow resemblance
(share of the k smallest of the union that both hold), from one the number of distinct shingles, from these the
containment.

Sketches are strings: 16 hex digits per hash, ascending. Defined results: null and wordless texts have the empty sketch;
two empty sketches resemble each other by 1, an empty and another one by 0. Repeated rows are sketched alike. Null ids
come last in the order of documents. An empty table gives an empty result. Columns other than the named ones are not
read. Memory is bounded by slices of texts; one text is held whole.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seriesmill.llm import arrays
from seriesmill.llm.common import parts_for, ready, settle

WIDTH, K = 5, 128
_HEX = 16


def sketches(texts: pa.Array, width: int = WIDTH, k: int = K) -> list[np.ndarray]:
    """The k smallest distinct shingle hashes (uint64, ascending) of every text."""
    out: list[np.ndarray] = []
    for part in arrays.slices(texts):
        body, ends = arrays.joined(part)
        start, end, doc = arrays.word_spans(body, ends)
        words = arrays.range_hash(arrays.prefix_hash(body), start, end)
        counts = np.bincount(doc, minlength=len(part))
        first = np.concatenate(([0], np.cumsum(counts)))
        sums, n = np.zeros(len(words), np.uint64), len(words)
        odd = arrays.mix64(np.arange(1, width + 1, dtype=np.uint64)) | np.uint64(1)
        with np.errstate(over="ignore"):
            for i in range(min(width, n)):
                sums[: n - i] += words[i:] * odd[i]
        hashes = arrays.mix64(sums)
        for i in range(len(part)):
            a, m = first[i], counts[i]
            if m >= width:
                own = hashes[a : a + m - width + 1]
                if len(own) > 4 * k:  # most hashes are far above the k-th smallest
                    own = _smallest(own, k)
                out.append(np.unique(own)[:k])
            elif m:
                with np.errstate(over="ignore"):
                    out.append(arrays.mix64(np.sum(words[a : a + m] * odd[:m], dtype=np.uint64, keepdims=True)))
            else:
                out.append(np.zeros(0, np.uint64))
    return out


def _smallest(own: np.ndarray, k: int) -> np.ndarray:
    """All that may belong to the k smallest distinct values: more are looked at while repeats fill the places."""
    take = 2 * k
    while take < len(own):
        low = np.partition(own, take)[: take + 1]
        if len(np.unique(low)) > k:
            return low
        take *= 4
    return own


def as_text(sketch: np.ndarray) -> str:
    return sketch.astype(">u8").tobytes().hex()


def sketch_of(text: Column, width: int = WIDTH, k: int = K) -> Column:
    @F.arrow_udf("string")
    def of(texts: pa.Array) -> pa.Array:
        return pa.array([as_text(s) for s in sketches(texts, width, k)], pa.string())

    return of(text)


def hashes_of(sketch: Column) -> Column:
    """The hashes of a sketch as an array of hex strings."""
    return F.filter(F.regexp_extract_all(sketch, F.lit(f"(.{{{_HEX}}})"), 1), lambda h: h != "")


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated Jaccard likeness of the shingles behind two sketches."""
    return _compare(k, "both")(a, b)


def _compare(k: int, what: str):
    @F.arrow_udf("double")
    def of(left: pa.Array, right: pa.Array) -> pa.Array:
        out = []
        for x, y in zip(left, right):
            x, y = x.as_py(), y.as_py()
            out.append(None if x is None or y is None else likeness(x, y, k) if what == "both" else containment(x, y, k))
        return pa.array(out, pa.float64())

    return of


def _parsed(sketch: str) -> np.ndarray:
    return np.frombuffer(bytes.fromhex(sketch), ">u8").astype(np.uint64)


def likeness(x: str, y: str, k: int = K) -> float:
    if x == y:
        return 1.0
    if not x or not y:
        return 0.0
    a, b = _parsed(x), _parsed(y)
    union = np.union1d(a, b)[:k]
    shared = np.intersect1d(a, b, assume_unique=True)
    return float(np.count_nonzero(np.isin(union, shared, assume_unique=True)) / len(union))


def distinct_count(sketch: str, k: int = K) -> float:
    """Estimated number of distinct shingles; exact below k."""
    n = len(sketch) // _HEX
    return float(n) if n < k else (k - 1) / (int(sketch[-_HEX:], 16) / 2.0**64)


def containment(x: str, y: str, k: int = K) -> float:
    """Estimated share of x's shingles that y has too."""
    if not x:
        return 1.0
    j = likeness(x, y, k)
    a, b = distinct_count(x, k), distinct_count(y, k)
    return min(1.0, j / (1.0 + j) * (a + b) / a)


def shingle_count(sketch: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles behind a sketch, as a built-in expression."""
    n = F.char_length(sketch) / F.lit(_HEX)
    last = F.conv(F.substring(sketch, -_HEX, 12), 16, 10).cast("double") / F.lit(2.0**48)
    return F.when(n < k, n).otherwise(F.lit(k - 1.0) / last)


def containment_of(a: Column, b: Column, k: int = K) -> Column:
    return _compare(k, "one")(a, b)


def merged(parts: DataFrame, by: str, sketch: str = "sketch", k: int = K, pieces: int = 256) -> DataFrame:
    """One sketch per value of ``by``: the k smallest distinct hashes of all its parts.

    A key is merged per input partition first, then in ``pieces`` groups of partitions, so a key with a third of all
    rows is spread out and no task sees more than its share of k-hash rows.
    """

    @F.pandas_udf("string")
    def union(values: pd.Series) -> str:  # a grouped aggregate over one bounded piece
        rows = [_parsed(v) for v in values if v]
        return as_text(np.unique(np.concatenate(rows))[:k]) if rows else ""

    rows = parts.select(F.col(by).alias("_by"), F.col(sketch).alias("_s"))
    rows = rows.withColumn("_part", F.spark_partition_id()).distinct()
    rows = rows.groupBy("_by", "_part").agg(union("_s").alias("_s"))
    rows = rows.groupBy("_by", (F.col("_part") % pieces).alias("_part")).agg(union("_s").alias("_s"))
    return rows.groupBy(F.col("_by").alias(by)).agg(union("_s").alias(sketch))


def _blocks(docs: DataFrame, parts: int):
    """Number of the range of ids that a row lies in, looked up in two steps; nulls are in the last one."""
    spread = F.percentile_approx("doc_id", F.array(*[F.lit(i / parts) for i in range(1, parts)]), 100 * parts)
    bounds = sorted(set(docs.agg(spread).first()[0] or [])) if parts > 1 else []
    if not bounds:
        return F.lit(0)
    step = max(1, int(len(bounds) ** 0.5))
    groups = [bounds[i : i + step] for i in range(0, len(bounds), step)]
    below = lambda values: F.size(F.filter(values, lambda b: b <= F.col("doc_id")))
    heads = F.array(*[F.lit(g[0]).cast("long") for g in groups])
    each = F.array(*[F.array(*[F.lit(b).cast("long") for b in g]) for g in groups])
    coarse = below(heads)
    block = F.when(coarse == 0, 0).otherwise((coarse - 1) * step + below(F.get(each, coarse - 1)))
    return F.when(F.col("doc_id").isNull(), F.lit(len(bounds))).otherwise(block)


def in_order(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows in blocks of consecutive ids. The first row of a block also ends the one before it (``_extra``), so every
    row meets its successor inside a block; the very first row also ends the last block.

    Ids that repeat are ordered by a hash of their text. Nulls come last.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    docs = docs.withColumn("_key", F.xxhash64("text"))
    docs = docs.withColumn("_block", _blocks(docs, parts_for(docs)).cast("int"))
    place = F.struct(F.col("doc_id").isNull().alias("n"), F.col("doc_id").alias("id"), F.col("_key").alias("key"))
    firsts = docs.groupBy("_block").agg(F.min(place).alias("f"))
    every = Window.orderBy("_block")  # one row per block
    last = F.max("_block").over(every.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    firsts = firsts.select("f", F.coalesce(F.lag("_block").over(every), last).alias("to"))
    firsts = settle(firsts.select("f.id", "f.key", "to"), "firsts")
    same = docs["doc_id"].eqNullSafe(firsts["id"]) & (docs["_key"] == firsts["key"])
    tails = docs.join(F.broadcast(firsts), same).dropDuplicates(["id", "key", "to"])  # one row per block
    tails = tails.select("doc_id", "text", "_key", F.col("to").alias("_block"), F.lit(True).alias("_extra"))
    return docs.withColumn("_extra", F.lit(False)).unionByName(tails)


def with_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, k: int = K) -> DataFrame:
    """Each text, its edited text (the last quarter replaced by the head of the next document) and likenesses.

    Returns ``doc_id``, ``text``, ``edited``, ``sketch``, ``edited_sketch``, ``near_edited``, ``near_next``.
    """
    ready(docs.sparkSession)
    rows = in_order(docs, id_col, text_col)
    own = Window.partitionBy("_block").orderBy("_extra", F.col("doc_id").asc_nulls_last(), "_key")
    cut = F.floor(F.char_length("text") / 4).cast("int")
    rows = rows.withColumn("_next", F.lead("text").over(own))
    kept = F.substr("text", F.lit(1), (F.char_length("text") - cut).cast("int"))
    edited = F.concat(kept, F.coalesce(F.substr("_next", F.lit(1), cut), F.lit("")))
    rows = rows.withColumn("edited", edited).filter(~F.col("_extra"))
    # the next text is sketched once more here: carrying its sketch over would shuffle all texts again
    made = {name: sketch_of(F.col(c), width, k) for name, c in (("sketch", "text"), ("edited_sketch", "edited"), ("_next_sketch", "_next"))}
    rows = rows.withColumns(made)
    return rows.select(
        "doc_id", "text", "edited", "sketch", "edited_sketch",
        resemblance(F.col("sketch"), F.col("edited_sketch"), k).alias("near_edited"),
        resemblance(F.col("sketch"), F.col("_next_sketch"), k).alias("near_next"),
    )
