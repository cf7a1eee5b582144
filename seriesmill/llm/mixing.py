"""Mixes sources to target weights with hash thresholds; documents are never sorted.

Every document has a fixed digest. The sizes of a source are summed by the digest's leading bits, the running sum over
these buckets shows the one in which the budget is used up, and only that bucket is summed again by its next bits.
What lies under the final threshold is taken. A larger budget has a higher threshold on the same digests, so its
documents include those of a smaller one (nested budgets).

A target of more than a source's size takes the source once in full and the rest by threshold; targets stop at
``max_repeats`` times the source's size and the excess goes to the others by weight.

Defined results: null texts have size 0, a null source is a source of its own (last), repeated rows share a digest and
are taken alike, a null id has a digest of its own. Sources of size 0 get target 0. An empty table gives an empty
result. One document may be larger than the budget: the cut that comes nearest to the target is used. Columns other
than the named ones are not read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seriesmill.llm.common import settle, whole_row, word_count

BITS, LEVELS = 12, 4  # bits of the digest per histogram, and how often the boundary bucket is cut again


def digest(seed: int, id_col: str = "doc_id") -> Column:
    """48 bits of md5 over seed and id."""
    text = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(id_col).cast("string")).cast("binary"))
    return F.conv(F.substring(text, 1, BITS * LEVELS // 4), 16, 10).cast("long")


def sized(docs: DataFrame, seed: int = 0, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """Id, source, words and digest of every document."""
    return docs.select(
        F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"),
        digest(seed, id_col).alias("h"),
    )


def targets(sizes: DataFrame, weights: Sequence[float], share: float, max_repeats: float) -> DataFrame:
    """One row per source: ``source_size``, ``weight``, ``target``.

    The level at which the water stands: sources in the order of cap / weight, those before the first one that holds
    its share are filled to the cap. Windows run over one row per source.
    """
    src = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = Window.orderBy(F.col("source").asc_nulls_last())
    pick = F.array(*[F.lit(float(w)) for w in weights])
    src = src.withColumn("weight", F.get(pick, (F.row_number().over(place) - 1) % len(weights)))
    cap = F.lit(float(max_repeats)) * F.col("source_size")
    src = src.withColumns({"cap": cap, "fill": cap / F.col("weight")})
    order = Window.orderBy("fill", F.col("source").asc_nulls_last())
    everything = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    budget = F.lit(float(share)) * F.sum("source_size").over(everything)
    level = (budget - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    src = src.withColumns({"level": level, "rank": F.row_number().over(order)})
    found = F.min_by(F.when(F.col("fill") >= F.col("level"), F.col("level")), F.when(F.col("fill") >= F.col("level"), F.col("rank")))
    src = src.withColumn("water", found.over(everything))
    target = F.least(F.col("cap"), F.coalesce(F.col("water") * F.col("weight"), F.col("cap")))
    return src.select("source", "source_size", "weight", target.alias("target"))


def thresholds(sizes: DataFrame, wanted: DataFrame) -> DataFrame:
    """Adds ``whole`` (copies of everything) and ``threshold`` (one more copy below it) to the sources in ``wanted``."""
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    plan = wanted.withColumn("whole", whole.cast("long"))
    plan = plan.withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))
    edge = plan.select(F.col("source").alias("s"), "rest", F.lit(0).cast("long").alias("prefix"), F.lit(0).cast("long").alias("under"))
    order = Window.partitionBy("s").orderBy("bucket")
    for level in range(1, LEVELS + 1):
        bits = BITS * (LEVELS - level)
        inside = sizes["source"].eqNullSafe(edge["s"])
        if level > 1:
            inside &= F.shiftright(sizes["h"], bits + BITS) == edge["prefix"]
        sums = (
            sizes.join(edge, inside)
            .groupBy("s", "rest", "under", F.shiftright("h", bits).alias("bucket")).agg(F.sum("size").alias("tokens"))
        )
        sums = sums.withColumn("upto", F.col("under") + F.sum("tokens").over(order))
        edge = (
            sums.filter(F.col("upto") > F.col("rest")).groupBy("s", "rest")
            .agg(F.min_by(F.struct("bucket", "upto", "tokens"), "bucket").alias("x"))
            .select("s", "rest", F.col("x.bucket").alias("prefix"), (F.col("x.upto") - F.col("x.tokens")).alias("under"), F.col("x.upto").alias("upto"))
        )
    nearer = (F.col("upto") - F.col("rest")) < (F.col("rest") - F.col("under"))
    cut = edge.select("s", (F.col("prefix") + nearer.cast("long")).alias("threshold"))
    joined = plan.join(cut, plan["source"].eqNullSafe(cut["s"]), "left")
    return joined.select("source", "source_size", "target", "whole", F.coalesce("threshold", F.lit(0).cast("long")).alias("threshold"))


def cuts(
    docs: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, max_repeats: float = 2, seed: int = 0,
    id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
) -> DataFrame:
    """One row per source: its size, target, whole copies and threshold."""
    return cuts_of(settle(sized(docs, seed, id_col, text_col, source_col), "mix"), weights, share, max_repeats)


def cuts_of(sizes: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, max_repeats: float = 2) -> DataFrame:
    """The same from the documents' sizes and digests (``sized``), written once."""
    return settle(thresholds(sizes, targets(sizes, weights, share, max_repeats)), "mix")


def with_copies(docs: DataFrame, cut: DataFrame, max_repeats: float = 2, seed: int = 0, id_col: str = "doc_id", source_col: str = "source") -> DataFrame:
    """Adds ``source_size``, ``target`` and ``copies`` (how often the mix takes the row) by comparing digests."""
    mark = cut.select(*[F.col(c).alias(f"_cut_{c}") for c in cut.columns])
    copies = F.col("_cut_whole") + (digest(seed, id_col) < F.col("_cut_threshold")).cast("long")
    out = docs.join(mark, docs[source_col].eqNullSafe(mark["_cut_source"]))
    own = [c for c in docs.columns if c not in ("source_size", "target", "copies")]
    return out.select(
        *[docs[c] for c in own], F.col("_cut_source_size").alias("source_size"), F.col("_cut_target").alias("target"),
        F.least(copies, F.lit(int(max_repeats)).cast("long")).alias("copies"),
    )


def mix(docs: DataFrame, cut: DataFrame, max_repeats: float = 2, seed: int = 0, id_col: str = "doc_id", source_col: str = "source") -> DataFrame:
    """The mixed corpus: the rows of ``docs``, each as often as it is taken. Columns of any name are kept as they are."""
    rows = docs.select(docs[id_col].alias("doc_id"), docs[source_col].alias("source"), whole_row(docs))
    taken = with_copies(rows, cut, max_repeats, seed).filter("copies > 0")
    return taken.select("row", F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int")))).select("row.*")
