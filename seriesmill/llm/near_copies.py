"""Near copies by word shingles: Golay keys over a long SimHash fingerprint, joined and verified exactly.

Texts are near copies when their sets of five-word shingles have a likeness of 0.8 or more; such fingerprints differ in
about 15 % of their bits, far more than whole segments of 64 bits can absorb. So the fingerprint here has 253 bits in
11 segments of 23. Every segment is decoded to the codewords of the perfect binary Golay code near it (its own and those
of its single-bit neighbours, six on average); segments with two wrong bits always meet, with three or four often, and
with 11 segments one of them nearly always has few (pigeonhole). A codeword index has only 12 bits, so each segment's
keys are completed by an anchor, the least of the text's shingle hashes under a hash of the segment's own: texts that
share nothing do not meet, however many there are, and a passage that many texts share is dealt out over 4096 codewords.
What meets is compared by fingerprint, then verified by the exact likeness of the shingle sets.

Every text is compared with the heaviest centre of its keys first, one pair a text, which connects groups of copies; then up to
``pair_limit`` texts of a key are compared with each other, as far as they are not connected yet. Texts that meet in a
larger key are keyed again by a prefix filter, which is exact for the likeness: with shingles in one order, rarest first, two sets of likeness t share
one among the first (1 - t) / (1 + t) of the smaller's shingles and the first 1 - t of the larger's. Passages and
templates that many texts share come last in that order and key nothing unless they are nearly the whole text. A prefix
key that is still large holds copies of one text: all are compared with its centre, and then those that are not yet
connected to the key's largest component are compared with every member of another component, once a pair and only if
their first shingles leave enough to have in common. Only pairs that are connected already or cannot be alike are left out.

Defined results: A-Z is lower-cased; fewer words than a shingle holds make one shingle; null, empty and wordless texts
are near copies of each other; equal texts (by 64-bit hash) are one node from the start; repeated rows are near copies;
null ids take part. An empty table gives an empty result. Columns other than the named ones are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seriesmill.llm.common import marks, ready, settle
from seriesmill.llm.components import components
from seriesmill.llm.simhash import decode, first_rows

WIDTH = 5
LEAST = 0.8
PAIR_LIMIT = 16
SEGMENTS = 11
FAR_BITS = 72  # of 256; at a likeness of 0.8 the mean is 39 and the deviation 6
_WORDS = 4  # 64-bit words of a fingerprint
_APART = " + ".join(f"bit_count(a{i} ^ b{i})" for i in range(_WORDS))
_STEP = np.uint64(0x9E3779B97F4A7C15)
_CHUNK = 1 << 15
_RANKED = 1 << 20  # shingles with a place of their own in the order of shingles
_LEAD = 64  # first shingles of a text that tell how many two texts can have in common


def _mix(x: np.ndarray) -> np.ndarray:
    """The finalizer of SplitMix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _salts(n: int, start: int) -> np.ndarray:
    return _mix(_STEP * np.arange(start, start + n, dtype=np.uint64)) | np.uint64(1)


_BIT_SALTS, _ANCHOR_SALTS = _salts(_WORDS, 1), _salts(SEGMENTS, 1 + _WORDS)


def shingles(text: str | None, width: int = WIDTH) -> np.ndarray:
    """Hashes of a text's different shingles, ascending."""
    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()  # lowers A-Z only; ASCII white space
    if not parts:
        return np.zeros(0, np.uint64)
    joined, n = b" ".join(parts), max(1, len(parts) - width + 1)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    of = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((of(joined[i:j], 42) for i, j in zip(starts[:n].tolist(), ends[-n:].tolist())), np.uint64, n))


def sketch(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The fingerprint's four words and the anchor of every segment; zeros where there is no shingle."""
    if not len(hashes):
        return np.zeros(_WORDS, np.uint64), np.zeros(SEGMENTS, np.uint64)
    counts = np.zeros(64 * _WORDS, np.int64)
    for at in range(0, len(hashes), _CHUNK):
        bits = _mix(hashes[at : at + _CHUNK, None] ^ _BIT_SALTS)
        counts += np.unpackbits(bits.view(np.uint8), axis=1).sum(axis=0, dtype=np.int32)
    anchors = np.array([(hashes * salt).min() for salt in _ANCHOR_SALTS], np.uint64)
    return np.packbits(2 * counts > len(hashes)).view(np.uint64), anchors


def keys(prints: np.ndarray, anchors: np.ndarray) -> list[np.ndarray]:
    """Per text the keys (int64) under which it is met: every segment's anchor with every codeword near the segment."""
    flips = np.concatenate(([0], 1 << np.arange(23))).astype(np.int64)
    bits = np.unpackbits(prints.view(np.uint8), axis=1)[:, : 23 * SEGMENTS].reshape(len(prints), SEGMENTS, 23)
    words = bits.astype(np.int64) @ (1 << np.arange(23))
    near = np.sort(decode(words[:, :, None] ^ flips), axis=2)
    fresh = np.concatenate((np.ones((*words.shape, 1), bool), near[:, :, 1:] != near[:, :, :-1]), axis=2)
    out = _mix((_mix(anchors ^ _ANCHOR_SALTS)[:, :, None]) ^ near.astype(np.uint64)).view(np.int64)
    return [k[f] for k, f in zip(out, fresh)]


def sketched(text: Column, width: int = WIDTH) -> Column:
    """An array of bigint: the four words of the fingerprint, then the keys."""

    @F.arrow_udf("array<bigint>")
    def of(texts: pa.Array) -> pa.Array:
        made = [sketch(shingles(t.as_py(), width)) for t in texts]
        if not made:
            return pa.array([], pa.list_(pa.int64()))
        prints, anchors = (np.array(x) for x in zip(*made))
        rows = [np.concatenate((p.view(np.int64), k)) for p, k in zip(prints, keys(prints, anchors))]
        ends = np.cumsum([0] + [len(r) for r in rows]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(rows)))

    return of(text)


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if len(a) or len(b) else 1.0


def likeness(left: Column, right: Column, width: int = WIDTH) -> Column:
    """The exact likeness of two texts' shingle sets."""

    @F.arrow_udf("double")
    def of(left: pa.Array, right: pa.Array) -> pa.Array:
        held = lru_cache(4)(lambda t: shingles(t, width))
        return pa.array([jaccard(held(a.as_py()), held(b.as_py())) for a, b in zip(left, right)], pa.float64())

    return of(left, right)


def close(pairs: DataFrame, prints: DataFrame) -> DataFrame:
    """The different pairs ``a``, ``b`` whose fingerprints are not far apart."""
    a, b = (prints.select(F.col("node").alias(x), *[F.col(f"f{i}").alias(f"{x}{i}") for i in range(_WORDS)]) for x in "ab")
    return pairs.distinct().join(a, "a").join(b, "b").filter(f"{_APART} <= {FAR_BITS}").select("a", "b")


def _ends(n: int, least: float) -> tuple[int, int]:
    """Length of the prefix of ``n`` shingles against any set, and against sets that are not smaller."""
    return n - int(np.ceil(least * n - 1e-9)) + 1, n - int(np.ceil(2 * least / (1 + least) * n - 1e-9)) + 1


def prefixes(texts: DataFrame, width: int = WIDTH, least: float = LEAST) -> DataFrame:
    """``key``, ``node``, ``weight``, ``size`` and ``short`` for the rarest shingles of every text (``node``, ``weight``, ``text``).

    The order of the shingles is by the number of texts that have them, then by hash. It decides how many texts share
    a key; that two sets of likeness ``least`` share one holds in any order. A text's first row has its first shingles
    in that order (``lead``), the others null.
    """
    spark = texts.sparkSession

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            every = [shingles(t.as_py(), width) for t in batch.column("text")]
            found, n = np.unique(np.concatenate(every), return_counts=True) if every else (np.zeros(0, np.uint64), np.zeros(0, int))
            yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(n, pa.int64())], ["key", "n"])

    found = texts.select("text").mapInArrow(counts, "key bigint, n bigint")
    often = found.groupBy("key").agg(F.sum("n").alias("n")).filter("n > 2").orderBy(F.desc("n"), "key").limit(_RANKED).toArrow()
    known, n = often.column("key").to_numpy().view(np.uint64), often.column("n").to_numpy()
    order = np.argsort(known)
    shared = spark.sparkContext.broadcast((known[order], n[order]))

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, times = shared.value
        for batch in batches:
            out, leads = [[], [], [], []], []
            for t in batch.column("text"):
                own = shingles(t.as_py(), width)
                at = np.minimum(np.searchsorted(known, own), max(0, len(known) - 1))
                rank = np.where(known[at] == own, times[at], 0) if len(known) else np.zeros(len(own), np.int64)
                end, inner = _ends(len(own), least)
                ordered = own[np.argsort(rank, kind="stable")]
                first = ordered[:end] if len(own) else np.zeros(1, np.uint64)
                leads += [ordered[:_LEAD].view(np.int64)] + [None] * (len(first) - 1)
                for x, y in zip(out, (first.view(np.int64), np.full(len(first), len(own)), np.arange(len(first)) < inner, [len(first)])):
                    x.append(y)
            if out[0]:
                key, size, short, n = map(np.concatenate, out)
                node, weight = (np.repeat(batch.column(c).to_numpy(), n) for c in ("node", "weight"))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key), pa.array(node), pa.array(weight), pa.array(size.astype(np.int32)), pa.array(short), pa.array(leads, pa.list_(pa.int64()))],
                    ["key", "node", "weight", "size", "short", "lead"],
                )

    return texts.select("node", "weight", "text").mapInArrow(keyed, "key bigint, node bigint, weight bigint, size int, short boolean, lead array<bigint>")


def may_be_near(a: str, b: str, least: float) -> str:
    """SQL: what two members of a prefix key must have to be near copies."""
    before = "({0}.size < {1}.size OR ({0}.size = {1}.size AND {0}.node < {1}.node))"
    roles = " OR ".join(f"({x}.short AND {before.format(x, y)})" for x, y in ((a, b), (b, a)))
    return f"({roles}) AND least({a}.size, {b}.size) >= {least} * greatest({a}.size, {b}.size) - 1e-9D"


def can_be_near(a: str, b: str, least: float) -> str:
    """SQL: what two members of a prefix key must have in their first shingles, true in one key of a pair's only.

    Of what follows the first shingles at most the longer rest can be shared, as all have one order. A pair is taken in the
    first key that both have; where that comes after the first shingles, in every key.
    """
    both = f"array_intersect({a}.lead, {b}.lead)"
    rest = f"greatest({a}.size - size({a}.lead), {b}.size - size({b}.lead))"
    shared = f"size({both}) + {rest} >= {least / (1 + least)!r}D * ({a}.size + {b}.size) - 1e-6D"
    return f"coalesce(get({both}, 0) = {a}.key, true) AND {shared}"


def _ordered(a: str, b: str) -> list[Column]:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def near_copies(docs: DataFrame, width: int = WIDTH, least: float = LEAST, id_col: str = "doc_id", text_col: str = "text", pair_limit: int = PAIR_LIMIT) -> DataFrame:
    """``doc_id``, ``key`` (hash of the text), ``root`` and ``component_id`` (smallest id of the group) of every row."""
    ready(docs.sparkSession)
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("node"), text.alias("text"))
    rows = settle(base.select("doc_id", "node", sketched(F.col("text"), width).alias("sketch")), "near")
    nodes = settle(rows.groupBy("node").agg(F.min("doc_id").alias("first_id"), F.first("sketch").alias("sketch")), "near")
    keyed = nodes.select("node", F.explode(F.expr(f"slice(sketch, {_WORDS + 1}, size(sketch))")).alias("key"))
    sizes = keyed.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    met = settle(keyed.join(sizes, "key"), "met")
    members = met.groupBy("node").agg(F.sum("n").alias("weight"), F.max("n").alias("largest"))
    members = settle(nodes.select("node", "first_id", *[F.col("sketch")[i].alias(f"f{i}") for i in range(_WORDS)]).join(members, "node"), "met")
    wanted = marks(members.select(F.xxhash64("node", "first_id").alias("mark")))  # texts that meet no other are not moved
    texts = base.filter(wanted(F.xxhash64("node", "doc_id"))).join(members.select("node", "weight", "largest"), "node").groupBy("node")
    texts = settle(texts.agg(F.first("text").alias("text"), F.max("weight").alias("weight"), F.max("largest").alias("largest")), "near")

    def verified(pairs: DataFrame) -> DataFrame:
        pairs = settle(close(pairs, members), "near")
        both = pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("left")), "a")
        both = both.join(texts.select(F.col("node").alias("b"), F.col("text").alias("right")), "b")
        return settle(both.filter(likeness(F.col("left"), F.col("right"), width) >= least).select("a", "b"), "near")

    # every text meets the heaviest centre of its keys first; groups of copies are connected by that, one pair a text
    weighed = met.join(members.select("node", "weight"), "node")
    centres = weighed.groupBy("key").agg(F.max(F.struct("weight", "node")).alias("centre"))
    headed = met.join(centres, "key").filter("node <> centre.node")
    headed = headed.groupBy("node").agg(F.max("centre")["node"].alias("centre"))
    headed = settle(headed.select(*_ordered("node", "centre")).distinct(), "met")
    first = verified(headed)
    # then, in the small keys, only pairs that are not connected yet and were not compared with each other
    few = met.filter(F.col("n") <= pair_limit).select("key", "node").join(components(first, "a", "b"), "node", "left")
    few = settle(few.select("key", "node", F.coalesce("root", "node").alias("root")), "met")
    mixed = few.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low <> high").select("key")
    few = settle(few.join(mixed, "key").join(members.drop("first_id", "weight", "largest"), "node"), "met")
    x, y = (few.select("key", F.col("node").alias(x), F.col("root").alias(f"r{x}"), *[F.col(f"f{i}").alias(f"{x}{i}") for i in range(_WORDS)]) for x in "ab")
    some = x.join(y, "key").filter(f"a < b AND ra <> rb AND {_APART} <= {FAR_BITS}").select("a", "b").distinct()
    some = some.join(headed, ["a", "b"], "left_anti")
    again = settle(prefixes(texts.filter(F.col("largest") > pair_limit), width, least), "near")
    leads = settle(again.filter("lead IS NOT NULL").select("node", "lead"), "near")
    again = again.drop("lead")
    kinds = again.groupBy("key").agg(F.count("*").alias("n"), F.max(F.struct("weight", "node")).alias("centre"))
    kinds = settle(kinds.filter("n > 1").select("key", "n", F.col("centre.node").alias("centre")), "near")
    again = settle(again.join(kinds, "key"), "near")
    # keys with the same members are one list
    lists = again.filter(F.col("n") <= pair_limit).groupBy("key").agg(F.array_sort(F.collect_list(F.struct("node", "size", "short"))).alias("m"))
    lists = lists.select("m").distinct().filter(F.exists("m", lambda x: x["short"]))
    inner = F.flatten(F.transform("m", lambda x: F.transform("m", lambda y: F.struct(x.alias("x"), y.alias("y")))))
    inner = F.filter(inner, lambda p: (p["x"]["node"] < p["y"]["node"]))
    inner = F.filter(inner, lambda p: F.least(p["x"]["size"], p["y"]["size"]) >= least * F.greatest(p["x"]["size"], p["y"]["size"]) - 1e-9)
    listed = lists.select(F.explode(inner).alias("p")).select(F.col("p.x").alias("x"), F.col("p.y").alias("y"))
    listed = listed.filter(may_be_near("x", "y", least)).select(*_ordered("x.node", "y.node"))
    large = again.filter(F.col("n") > pair_limit)
    star = large.filter("node <> centre").select(*_ordered("node", "centre"))
    links = first.unionByName(verified(some.unionByName(listed).unionByName(star)))
    # of what is still large, only pairs across components are left
    roots = components(links, "a", "b")
    large = settle(large.join(roots, "node", "left").select("key", "node", "size", "short", F.coalesce("root", "node").alias("root")), "near")
    parts = large.groupBy("key", "root").agg(F.count("*").alias("n"))
    parts = parts.groupBy("key").agg(F.max(F.struct("n", "root")).alias("top"), F.count("*").alias("parts")).filter("parts > 1")
    mixed = settle(large.join(parts.select("key", F.col("top.root").alias("top")), "key").join(leads, "node"), "near")
    rest, every = mixed.filter("root <> top").alias("x"), mixed.alias("y")
    across = rest.join(every, F.expr(f"x.key = y.key AND x.root <> y.root AND {may_be_near('x', 'y', least)} AND {can_be_near('x', 'y', least)}"))
    links = links.unionByName(verified(across.select(*_ordered("x.node", "y.node"))))
    roots = components(links, "a", "b")
    named = nodes.select("node", "first_id").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    smallest = named.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = settle(named.join(smallest, "root").select("node", "root", "component_id"), "near")
    return rows.select("doc_id", F.col("node").alias("key")).join(named.withColumnRenamed("node", "key"), "key")


def one_of_each(docs: DataFrame, width: int = WIDTH, least: float = LEAST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` without near copies: of every group the row of smallest id stays (nulls last)."""
    return first_rows(docs, near_copies(docs, width, least, id_col, text_col), id_col, text_col)
