"""Removes lines that many documents share: a sharded minimal perfect hash over line hashes, probed by every document.

1. A line's key is the line without white space at its ends, A-Z in lower case. Keys of ``min_chars`` code points or more
   are hashed to 128 bits; documents and the largest id are counted per hash, combined before the shuffle.
2. The hashes found in ``least_docs`` documents or more are cut into shards by their first half. A task makes a shard's
   minimal perfect hash: a key that is alone in its slot of a level's bit array stays there, the others go to the next
   level, and the number of set bits before a key's own is its place. At that place three arrays hold the fingerprint
   (the second half of the hash, which tells lines that are not indexed, wrong once in 2^64 probes), the number of
   documents and the largest id.
3. Documents probe the arrays while they are read; no line is joined. The most frequent ``HOT`` hashes at most are broadcast
   (about 21 bytes each). What does not fit is rarer than those, and so no hot key: its probes go, as hashes, to the shard,
   and only hits come back to the documents.

Defined results: a null or empty text is one empty line. Rows with one id are one document for the count, null ids are
one document that comes before all others; repeated rows get the same result. An empty table gives an empty result.
Columns other than the named ones are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seriesmill.llm import arrays
from seriesmill.llm.common import ready, settle

MIN_CHARS, LEAST_DOCS = 40, 5
HOT = 1 << 20  # hashes that are broadcast at most
SHARD_KEYS = 1 << 17  # hashes of a shard on average
_SPACE = " \t\n\x0b\x0c\r"
_GAMMA = 2.0  # slots of a level per key
_LEVEL = np.uint64(0x9E3779B97F4A7C15)
_INDEX = "shard int, n int, sizes array<int>, bits binary, prints binary, docs binary, last binary"


class PerfectHash:
    """Minimal perfect hash of different (h, g) pairs: ``place`` is a bijection from the keys to 0 .. n - 1."""

    def __init__(self, sizes: np.ndarray, words: np.ndarray):
        self.sizes, self.words = sizes, words
        self.first = np.concatenate(([0], np.cumsum(sizes // 64)))
        self.before = np.concatenate(([0], np.cumsum(np.bitwise_count(words), dtype=np.int64)))

    @staticmethod
    def slot(h: np.ndarray, g: np.ndarray, level: int, size: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            mixed = arrays.mix64(h ^ arrays.mix64(g + _LEVEL * np.uint64(level + 1)))
        return ((mixed >> np.uint64(32)) * np.uint64(size) >> np.uint64(32)).astype(np.int64)

    @classmethod
    def of(cls, h: np.ndarray, g: np.ndarray) -> PerfectHash:
        sizes, words = [], [np.zeros(0, np.uint64)]
        while len(h):
            size = max(64, -(-int(_GAMMA * len(h)) // 64) * 64)
            slot = cls.slot(h, g, len(sizes), size)
            alone = np.bincount(slot, minlength=size) == 1
            words.append(np.packbits(alone, bitorder="little").view(np.uint64))
            sizes.append(size)
            left = ~alone[slot]
            h, g = h[left], g[left]
        return cls(np.array(sizes, np.int64), np.concatenate(words))

    def place(self, h: np.ndarray, g: np.ndarray) -> np.ndarray:
        """The place of every key; some place, or -1, for pairs that are no keys."""
        out, open_ = np.full(len(h), -1, np.int64), np.arange(len(h))
        for level, size in enumerate(self.sizes.tolist()):
            slot = self.slot(h[open_], g[open_], level, size)
            word, bit = self.first[level] + (slot >> 6), (slot & 63).astype(np.uint64)
            here = (self.words[word] >> bit) & np.uint64(1) == 1
            below = self.words[word[here]] & ((np.uint64(1) << bit[here]) - np.uint64(1))
            out[open_[here]] = self.before[word[here]] + np.bitwise_count(below)
            open_ = open_[~here]
            if not len(open_):
                break
        return out


class Shard:
    """A perfect hash with its arrays of fingerprints, document counts and largest ids."""

    def __init__(self, sizes, bits: bytes, prints: bytes, docs: bytes, last: bytes):
        self.hash = PerfectHash(np.array(sizes, np.int64), np.frombuffer(bits, np.uint64))
        self.prints, self.docs, self.last = np.frombuffer(prints, np.uint64), np.frombuffer(docs, np.uint32), np.frombuffer(last, np.int64)

    def probe(self, h: np.ndarray, g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Documents (0: not indexed) and largest id of every line hash."""
        place = self.hash.place(h, g)
        known = place >= 0
        known[known] = self.prints[place[known]] == g[known]
        docs, last = np.zeros(len(h), np.int64), np.zeros(len(h), np.int64)
        docs[known], last[known] = self.docs[place[known]], self.last[place[known]]
        return docs, last


class Shards:
    """All shards of a part of the index; a hash's shard follows from its first half."""

    def __init__(self, rows: list[dict]):
        self.shards = {r["shard"]: Shard(r["sizes"], r["bits"], r["prints"], r["docs"], r["last"]) for r in rows}
        self.n = max(self.shards, default=-1) + 1

    def probe(self, h: np.ndarray, g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        docs, last = np.zeros(len(h), np.int64), np.zeros(len(h), np.int64)
        if self.n:
            where = (h % np.uint64(self.n)).astype(np.int64)
            for i, shard in self.shards.items():
                own = np.flatnonzero(where == i)
                docs[own], last[own] = shard.probe(h[own], g[own])
        return docs, last


# ---- lines ---------------------------------------------------------------------------------------------------------


def key_hash(line: str, min_chars: int) -> bytes | None:
    """Digest of a line's key; none for short keys."""
    key = line.strip(_SPACE)
    return xxhash.xxh3_128_digest(key.encode("utf-8", "replace").lower()) if len(key) >= min_chars else None  # lowers A-Z only


def halves(digests: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(b"".join(digests), np.uint64).reshape(-1, 2)
    return both[:, 0].copy(), both[:, 1].copy()


def line_keys(docs: DataFrame, min_chars: int, known: object = None) -> DataFrame:
    """``doc_id``, ``t`` (the text's hash), ``h`` and ``g`` of every different key of a row (``doc_id``, ``t``, ``text``).

    Without those that ``known``, a broadcast part of the index, holds.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for part in arrays.slices(batch.column("text"), 4 << 20):
                own = [{k for line in t.as_py().split("\n") if (k := key_hash(line, min_chars))} for t in part]
                h, g = halves([k for keys in own for k in keys])
                doc = np.repeat(np.arange(at, at + len(part)), list(map(len, own)))
                at += len(part)
                if known is not None:
                    fresh = known.value.probe(h, g)[0] == 0
                    h, g, doc = h[fresh], g[fresh], doc[fresh]
                ids = [batch.column(c).take(pa.array(doc, pa.int64())) for c in ("doc_id", "t")]
                yield pa.RecordBatch.from_arrays([*ids, pa.array(h.view(np.int64)), pa.array(g.view(np.int64))], ["doc_id", "t", "h", "g"])

    return docs.select("doc_id", "t", "text").mapInArrow(rows, "doc_id bigint, t bigint, h bigint, g bigint")


def line_counts(keys: DataFrame) -> DataFrame:
    """``h``, ``g``, ``docs`` (documents that hold the line) and ``last`` (the largest of their ids)."""
    some = F.max(F.col("doc_id").isNull().cast("long"))
    return keys.groupBy("h", "g").agg((F.count_distinct("doc_id") + some).alias("docs"), F.max("doc_id").alias("last"))


def build(lines: DataFrame, shard_keys: int = SHARD_KEYS) -> DataFrame:
    """One row per shard for the hashes in ``lines`` (``h``, ``g``, ``docs``, ``last``)."""
    n = max(1, -(-lines.count() // shard_keys))

    def made(rows: pa.Table) -> pa.Table:
        h, g = (rows.column(c).to_numpy().view(np.uint64) for c in "hg")
        perfect = PerfectHash.of(h, g)
        order = np.empty(len(h), np.int64)
        order[perfect.place(h, g)] = np.arange(len(h))
        docs = np.minimum(rows.column("docs").to_numpy(), 2**32 - 1).astype(np.uint32)
        last = rows.column("last").fill_null(0).to_numpy()
        row = {"shard": [rows.column("shard")[0].as_py()], "n": [len(h)], "sizes": [perfect.sizes.tolist()], "bits": [perfect.words.tobytes()]}
        row |= {"prints": [g[order].tobytes()], "docs": [docs[order].tobytes()], "last": [last[order].tobytes()]}
        return pa.table(row, pa.schema([("shard", pa.int32()), ("n", pa.int32()), ("sizes", pa.list_(pa.int32())), *[(c, pa.binary()) for c in ("bits", "prints", "docs", "last")]]))

    shard = F.expr(f"int(pmod(pmod(h, {n}L) + IF(h < 0, {2**64 % n}L, 0L), {n}L))")  # h as an unsigned number
    return lines.select("h", "g", "docs", "last", shard.alias("shard")).groupBy("shard").applyInArrow(made, _INDEX)


def hot_from(lines: DataFrame, hot: int) -> int:
    """The least power of two such that at most ``hot`` lines have that many documents; 64 rows reach the driver."""
    counts = lines.groupBy(F.floor(F.log2("docs")).cast("int").alias("b")).agg(F.count("*").alias("n")).collect()
    total, least = 0, max((r.b for r in counts), default=0) + 1
    for b, n in sorted(((r.b, r.n) for r in counts), reverse=True):
        total += n
        if total > hot:
            break
        least = b
    return 1 << least


# ---- documents -------------------------------------------------------------------------------------------------------


def without(doc_id: Column, text: Column, gone: Column, known: object, min_chars: int) -> Column:
    """Struct of ``n_lines``, ``n_dropped`` and ``kept`` (null where all lines stay)."""

    @F.arrow_udf("struct<n_lines: bigint, n_dropped: bigint, kept: string>")
    def of(doc_id: pa.Array, text: pa.Array, gone: pa.Array) -> pa.Array:
        out: list[list] = [[], [], []]
        at = 0
        for part in arrays.slices(text, 4 << 20):
            lines = [t.as_py().split("\n") for t in part]
            digests = [key_hash(line, min_chars) for own in lines for line in own]
            where = np.flatnonzero([d is not None for d in digests])
            drop = np.zeros(len(digests), bool)
            docs, last = known.value.probe(*halves([digests[i] for i in where]))
            ids = doc_id.slice(at, len(part))
            row = np.repeat(np.arange(len(part)), list(map(len, lines)))[where]
            own = ids.fill_null(0).to_numpy(zero_copy_only=False)[row]
            null = ids.is_null().to_numpy(zero_copy_only=False)[row]
            drop[where] = (docs > 0) & (null | (own != last))
            begin = 0
            for i, split in enumerate(lines):
                end = begin + len(split)
                flags = drop[begin:end]
                if (far := gone[at + i].as_py()) is not None:
                    far = set(far)
                    flags = flags | np.array([d in far for d in digests[begin:end]])
                n = int(flags.sum())
                kept = "\n".join([s for s, f in zip(split, flags.tolist()) if not f]) if n else None
                for column, value in zip(out, (len(split), n, kept)):
                    column.append(value)
                begin = end
            at += len(part)
        types = (pa.int64(), pa.int64(), pa.string())
        return pa.StructArray.from_arrays([pa.array(v, t) for v, t in zip(out, types)], ["n_lines", "n_dropped", "kept"])

    return of(doc_id, text, gone)


def far_hits(docs: DataFrame, index: DataFrame, known: object, min_chars: int) -> DataFrame:
    """``doc_id``, ``t`` and ``gone`` (digests to drop) by the shards of ``index``, to which the probes go."""
    n = index.agg(F.max("shard")).first()[0] + 1
    shard = F.expr(f"int(pmod(pmod(h, {n}L) + IF(h < 0, {2**64 % n}L, 0L), {n}L))")
    probes = line_keys(docs, min_chars, known).withColumn("shard", shard).withColumn("probe", F.lit(True))
    both = probes.unionByName(index.withColumn("probe", F.lit(False)), allowMissingColumns=True)
    both = both.repartition("shard").sortWithinPartitions("shard", "probe")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = -1, None
        for batch in batches:
            shard, probe = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("shard", "probe"))
            cuts = [0, *(np.flatnonzero((shard[1:] != shard[:-1]) | (probe[1:] != probe[:-1])) + 1).tolist(), len(shard)]
            for a, b in zip(cuts, cuts[1:]):
                part = batch.slice(a, b - a)
                if b > a and not probe[a]:
                    r = part.select(["sizes", "bits", "prints", "docs", "last"]).to_pylist()[0]
                    at, held = shard[a], Shard(**r)
                elif b > a and shard[a] == at:
                    h, g = (part.column(c).to_numpy().view(np.uint64) for c in "hg")
                    docs, last = held.probe(h, g)
                    ids = part.column("doc_id")
                    hit = (docs > 0) & (ids.is_null().to_numpy(zero_copy_only=False) | (ids.fill_null(0).to_numpy() != last))
                    found = part.select(["doc_id", "t"]).filter(pa.array(hit))
                    raw = np.stack((h[hit], g[hit]), axis=1).tobytes()
                    keys = pa.array([raw[i : i + 16] for i in range(0, len(raw), 16)], pa.binary())
                    yield pa.RecordBatch.from_arrays([*found.columns, keys], ["doc_id", "t", "k"])

    hits = both.mapInArrow(rows, "doc_id bigint, t bigint, k binary")
    return hits.groupBy("doc_id", "t").agg(F.collect_set("k").alias("gone"))  # bounded by a text's lines


def drop_shared_lines(
    docs: DataFrame, min_chars: int = MIN_CHARS, least_docs: int = LEAST_DOCS, hot: int = HOT, shard_keys: int = SHARD_KEYS,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """``doc_id``, ``n_lines``, ``n_dropped`` and ``kept`` (the remaining lines) of every row.

    Lines whose keys are found in ``least_docs`` (2 or more) documents go, except in the document of the largest id.
    """
    if least_docs < 2:
        raise ValueError("least_docs must be 2 or more")
    spark = ready(docs.sparkSession)
    text = F.coalesce(F.col(text_col), F.lit(""))
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("t"))
    shared = settle(line_counts(line_keys(docs, min_chars)).filter(F.col("docs") >= least_docs), "lines")
    least = hot_from(shared, hot)
    near = build(shared.filter(F.col("docs") >= least), shard_keys).toArrow()  # ``hot`` hashes at most
    known = spark.sparkContext.broadcast(Shards(near.to_pylist()))
    rest = settle(build(shared.filter(F.col("docs") < least), shard_keys), "lines")
    none = F.lit(None).cast("array<binary>")
    if rest.isEmpty():
        docs = docs.withColumn("gone", none)
    else:
        far = settle(far_hits(docs, rest, known, min_chars), "lines").select(F.col("doc_id").alias("i"), F.col("t").alias("u"), "gone")
        docs = docs.join(far, docs["doc_id"].eqNullSafe(far["i"]) & (docs["t"] == far["u"]), "left")
    out = docs.select("doc_id", "text", without(F.col("doc_id"), F.col("text"), F.col("gone"), known, min_chars).alias("r"))
    return out.select("doc_id", "r.n_lines", "r.n_dropped", F.coalesce("r.kept", "text").alias("kept"))
