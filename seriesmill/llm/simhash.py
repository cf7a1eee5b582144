"""SimHash fingerprints linked through Golay-code keys.

The 64 bits of a fingerprint are three segments of 22, 21 and 21 bits. Two fingerprints that differ in at most two
bits agree fully in one segment (pigeonhole) and differ in at most two bits of the next one. The perfect binary Golay
code decodes every 23-bit word to one of 4096 codewords; two words at distance two have a word between them at
distance one of both, so the sets of codewords that a word and its single-bit neighbours decode to share an element.
A fingerprint's keys are (segment, codeword index of the next segment) for every such index: 16 rows on average, 33 bits
each. Fingerprints that meet under a key are joined and verified.

Equal fingerprints are one node from the start. A key with more than ``pair_limit`` different fingerprints is not
joined with itself: its members meet at the fingerprints one bit away from both instead. Of these at most 65 members
exist, all of them within two bits of each other, so a link to the smallest keeps every connection. Nothing is
capped and no group is spread into its pairs.

Defined results: null and wordless texts have fingerprint 0 and are linked like any other; fewer words than a shingle
holds make one shingle; repeated rows share a fingerprint; null ids are linked but never name a component unless
all its ids are null. An empty table gives an empty result. Columns other than the named ones are not read.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seriesmill.llm.common import marks, ready, settle, whole_row
from seriesmill.llm.components import components

SEGMENTS = ((42, 22), (21, 21), (0, 21))  # shift and bits
GENERATOR = 0b110001110101  # x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1, of the cyclic (23, 12) code
PAIR_LIMIT = 32
_CHUNK = 1 << 16


def simhash(text: str | None, width: int, seed: int = 42) -> int:
    """The fingerprint of one text as an unsigned number."""
    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()  # lowers A-Z only; ASCII white space
    if not parts:
        return 0
    joined, n = b" ".join(parts), max(1, len(parts) - width + 1)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    first, last = starts[:n].tolist(), ends[-n:].tolist()
    digest, counts = xxhash.xxh64_digest, np.zeros(64, np.int64)
    for at in range(0, n, _CHUNK):
        raw = b"".join([digest(joined[i:j], seed) for i, j in zip(first[at : at + _CHUNK], last[at : at + _CHUNK])])
        counts += np.unpackbits(np.frombuffer(raw, np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > n).tobytes(), "big")


def fingerprint(text: Column, width: int = 3) -> Column:
    """The fingerprint of every text as a signed bigint."""

    @F.arrow_udf("bigint")
    def of(texts: pa.Array) -> pa.Array:
        bits = np.array([simhash(t.as_py(), width) for t in texts], np.uint64)
        return pa.array(bits.view(np.int64))

    return of(text)


def _remainder(word: int) -> int:
    for bit in range(22, 10, -1):
        if word >> bit & 1:
            word ^= GENERATOR << (bit - 11)
    return word


@cache
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Remainders of the low 12 and the high 11 bits of a word, and the error of up to three bits by remainder."""
    low = np.array([_remainder(x) for x in range(1 << 12)], np.int64)
    high = np.array([_remainder(x << 12) for x in range(1 << 11)], np.int64)
    errors, single = np.zeros(1 << 11, np.int64), [1 << i for i in range(23)]
    for i, a in enumerate(single):
        errors[_remainder(a)] = a
        for j, b in enumerate(single[:i]):
            errors[_remainder(a | b)] = a | b
            for c in single[:j]:
                errors[_remainder(a | b | c)] = a | b | c
    return low, high, errors


def decode(word: np.ndarray) -> np.ndarray:
    """Index (0 to 4095) of the codeword at most three bits from each 23-bit word."""
    low, high, errors = _tables()
    return (word ^ errors[low[word & 0xFFF] ^ high[word >> 12]]) >> 11


def golay_keys(fp: np.ndarray) -> list[np.ndarray]:
    """Per fingerprint (uint64) the keys under which all fingerprints within two bits are met."""
    flips = np.concatenate(([0], 1 << np.arange(23))).astype(np.int64)
    parts = [((fp >> np.uint64(s)) & np.uint64((1 << b) - 1)).astype(np.int64) for s, b in SEGMENTS]
    out = []
    for i in range(3):
        near = np.sort(decode(parts[(i + 1) % 3][:, None] ^ flips), axis=1)
        fresh = np.concatenate((np.ones((len(fp), 1), bool), near[:, 1:] != near[:, :-1]), axis=1)
        out.append((near | (parts[i] << 12)[:, None] | (i << 40), fresh))
    keys, fresh = (np.concatenate(x, axis=1) for x in zip(*out))
    return [k[f] for k, f in zip(keys, fresh)]


def keys_of(fp: Column) -> Column:
    @F.arrow_udf("array<bigint>")
    def of(fp: pa.Array) -> pa.Array:
        keys = golay_keys(fp.to_numpy(zero_copy_only=False).view(np.uint64))
        ends = np.cumsum([0] + [len(k) for k in keys]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(keys) if keys else np.zeros(0, np.int64)))

    return of(fp)


def links(nodes: DataFrame, pair_limit: int = PAIR_LIMIT) -> DataFrame:
    """Pairs ``a``, ``b`` of the different fingerprints in ``nodes.fp`` that connect all within two bits of each other."""
    keyed = settle(nodes.select("fp", F.explode(keys_of(F.col("fp"))).alias("key")), "golay")
    sizes = keyed.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    met = settle(keyed.join(sizes, "key"), "golay")
    few = met.filter(F.col("n") <= pair_limit)
    left, right = few.select("key", F.col("fp").alias("a")), few.select("key", F.col("fp").alias("b"))
    pairs = left.join(right, "key").filter("a < b AND bit_count(a ^ b) <= 2").select("a", "b")
    near = F.array(F.col("fp"), *[F.expr(f"fp ^ shiftleft(1L, {i})") for i in range(64)])
    around = met.filter(F.col("n") > pair_limit).select("fp").distinct().select("fp", F.explode(near).alias("mid"))
    least = around.groupBy("mid").agg(F.min("fp").alias("a"), F.count("*").alias("n")).filter("n > 1").drop("n")
    crowded = around.join(least, "mid").filter("a <> fp").select("a", F.col("fp").alias("b"))
    return pairs.unionByName(crowded).distinct()


def near_duplicates(docs: DataFrame, width: int = 3, id_col: str = "doc_id", text_col: str = "text", pair_limit: int = PAIR_LIMIT) -> DataFrame:
    """``doc_id``, ``key`` (hash of the text), ``fp`` (bigint), ``root`` and ``component_id`` of every row."""
    ready(docs.sparkSession)
    text = F.coalesce(F.col(text_col), F.lit(""))
    prints = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("key"), fingerprint(F.col(text_col), width).alias("fp"))
    prints = settle(prints, "simhash")
    nodes = settle(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "simhash")
    roots = components(links(nodes, pair_limit), "a", "b")
    named = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = named.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = settle(named.join(least, "root").select("fp", "root", "component_id"), "simhash")
    return prints.join(named, "fp").select("doc_id", "key", "fp", "root", "component_id")


def first_rows(docs: DataFrame, grouped: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Of every group (``doc_id``, ``key``, ``root``) the row of ``docs`` with the smallest id (nulls last, then ``key``)."""
    place = F.struct(F.col("doc_id").isNull().alias("n"), F.col("doc_id").alias("id"), F.col("key").alias("key"))
    grouped = settle(grouped.select("doc_id", "key", "root"), "simhash")
    groups = settle(grouped.groupBy("root").agg(F.min(place).alias("p"), F.count("*").alias("n")), "simhash")
    kept = groups.select(F.col("p.id").alias("_kept_id"), F.col("p.key").alias("_kept_key")).distinct()
    several = marks(grouped.join(groups.filter("n > 1").select("root"), "root").select(F.xxhash64("doc_id", "key")))
    rows = docs.select(docs[id_col].alias("id"), F.xxhash64(F.coalesce(docs[text_col], F.lit(""))).alias("key"), whole_row(docs))
    several = several(F.xxhash64("id", "key"))
    alone = rows.filter(~several).select("row.*")  # the only rows of their groups are not moved
    rows = rows.filter(several)
    rows = rows.join(kept, rows["id"].eqNullSafe(kept["_kept_id"]) & (rows["key"] == kept["_kept_key"]), "left_semi")
    same = Window.partitionBy(F.coalesce("id", F.lit(0)), F.col("id").isNull(), "key").orderBy(F.lit(1))
    return alone.union(rows.withColumn("nth", F.row_number().over(same)).filter("nth = 1").select("row.*"))


def one_of_each(docs: DataFrame, width: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` without near duplicates: of every component the row of smallest id stays (nulls last)."""
    return first_rows(docs, near_duplicates(docs, width, id_col, text_col), id_col, text_col)
