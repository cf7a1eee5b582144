"""Language identification with language-bitmask n-gram filters.

Each language contributes its most frequent letter n-grams, counted over all its documents. They go into a Bloom filter
that is sliced by bit: a slot is not one bit but a mask with a bit per language, so one look-up (the conjunction of
the slots of an n-gram's hashes) returns all languages that hold the n-gram. A text's n-grams are looked up, set
bits are counted per language, and counts are corrected for the filter's share of false positives. The language with
the largest corrected share of n-grams wins; shares of n-grams that all languages hold cancel out.

The filter has a fixed size: n-grams per language, slots and hashes are parameters, so its size depends on the number
of languages alone (a mask has as many 64-bit words as needed).

Defined results: ``und`` for null texts and texts without a letter, with score 0; a text whose n-grams no language
holds gets the most frequent learned language with score 0; without a learned language every text is ``und``.
Ties go to the more frequent language. Repeated rows are predicted alike; ids are only carried. An empty table gives
an empty result. Texts are read whole, in slices of bounded memory. Columns other than the named ones are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seriesmill.llm import arrays
from seriesmill.llm.common import ready

GRAM_SIZES = (3, 4)
GRAMS_PER_LANGUAGE, SLOT_BITS, HASHES = 4000, 20, 2
UNKNOWN = "und"
_LETTER = regex.compile(r"\p{L}")


def grams(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Per size the codes of all letter n-grams (bytes of lower-case text, a blank for each run of others) and the
    ascending numbers of their texts."""
    text = pc.utf8_lower(pc.fill_null(texts.cast(pa.large_string()), ""))
    body, ends = arrays.joined(text)
    letter = (body >= 128) | ((body >= 97) & (body <= 122))
    keep = letter.copy()
    keep[:1] = True
    keep[1:] |= letter[:-1]  # the first of a run of others stands for it
    doc = np.repeat(np.arange(len(texts), dtype=np.int32), np.diff(ends))[keep]
    clean = np.where(letter, body, 32)[keep].astype(np.uint64)
    value = clean
    for n in range(2, max(GRAM_SIZES) + 1):
        value = (value[:-1] << np.uint64(8)) | clean[n - 1 :]
        if n in GRAM_SIZES:
            inside = doc[: len(value)] == doc[n - 1 :]
            yield value[inside] | np.uint64(n << 56), doc[: len(value)][inside]


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        langs = batch.column("lang").to_pylist()
        names = sorted(set(langs))
        number = np.array([names.index(x) for x in langs], np.uint64)
        start = 0
        for part in arrays.slices(batch.column("text")):
            own = number[start : start + len(part)]
            start += len(part)
            for codes, docs in grams(part):
                for i, name in enumerate(names):
                    found, n = np.unique(codes[own[docs] == i], return_counts=True)
                    columns = [pa.array([name] * len(found), pa.string()), pa.array(found.view(np.int64)), pa.array(n, pa.int64())]
                    yield pa.RecordBatch.from_arrays(columns, ["lang", "gram", "n"])


@dataclass(frozen=True)
class Filter:
    """``slots`` is (2^bits, words) of masks; ``languages`` are in the order of their bits, most frequent first."""

    languages: list[str]
    slots: np.ndarray
    hashes: int
    false_share: np.ndarray  # per language: chance that an n-gram never put in is found

    def masks(self, codes: np.ndarray) -> np.ndarray:
        found = None
        for at in places(codes, self.slots.shape[0], self.hashes):
            hit = self.slots[at]
            found = hit if found is None else found & hit
        return found


def places(codes: np.ndarray, slots: int, hashes: int) -> Iterator[np.ndarray]:
    with np.errstate(over="ignore"):
        for i in range(1, hashes + 1):
            yield (arrays.mix64(codes * np.uint64(2 * i + 1) + np.uint64(i)) & np.uint64(slots - 1)).astype(np.int64)


def build(languages: list[str], held: dict[str, np.ndarray], slot_bits: int = SLOT_BITS, hashes: int = HASHES) -> Filter:
    slots = np.zeros((1 << slot_bits, max(1, -(-len(languages) // 64))), np.uint64)
    for i, lang in enumerate(languages):
        bit = np.uint64(1 << (i % 64))
        for at in places(held[lang], len(slots), hashes):
            slots[at, i // 64] |= bit
    full = np.array([np.mean(slots[:, i // 64] >> np.uint64(i % 64) & np.uint64(1)) for i in range(len(languages))])
    return Filter(languages, slots, hashes, full**hashes)


def learn(
    docs: DataFrame, lang_col: str = "lang", text_col: str = "text", per_language: int = GRAMS_PER_LANGUAGE,
    slot_bits: int = SLOT_BITS, hashes: int = HASHES,
) -> Filter:
    """Counts the n-grams of every document with a language and builds the filter from the most frequent ones."""
    ready(docs.sparkSession)
    known = docs.filter(F.col(lang_col).isNotNull()).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    counted = known.mapInArrow(_counts, "lang string, gram bigint, n bigint")
    counted = counted.groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    # the best of parts of a language first, so that no language is ranked in one task
    salted = Window.partitionBy("lang", F.pmod(F.xxhash64("gram"), F.lit(32))).orderBy(F.desc("n"), "gram")
    best = counted.withColumn("r", F.row_number().over(salted)).filter(F.col("r") <= per_language)
    whole = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    best = best.withColumn("r", F.row_number().over(whole)).filter(F.col("r") <= per_language)
    rows = best.groupBy("lang").agg(F.collect_list("gram").alias("grams"), F.sum("n").alias("n")).collect()
    rows = sorted(rows, key=lambda r: (-r["n"], r["lang"]))
    return build([r["lang"] for r in rows], {r["lang"]: np.array(r["grams"], np.int64).view(np.uint64) for r in rows}, slot_bits, hashes)


def shares(texts: pa.Array, held: Filter) -> np.ndarray:
    """Corrected share (0 to 1) of each text's n-grams that each language holds."""
    n, hits = np.zeros(len(texts)), np.zeros((len(texts), len(held.languages)))
    for codes, docs in grams(texts):
        first = np.searchsorted(docs, np.arange(len(texts) + 1))
        n += np.diff(first)
        masks = held.masks(codes)
        for i in range(len(held.languages)):
            bits = (masks[:, i // 64] >> np.uint64(i % 64) & np.uint64(1)).astype(np.int64)
            total = np.concatenate(([0], np.cumsum(bits)))
            hits[:, i] += total[first[1:]] - total[first[:-1]]
    expected = n[:, None] * held.false_share
    return np.clip((hits - expected) / (np.maximum(n, 1)[:, None] * np.maximum(1 - held.false_share, 1e-9)), 0, 1)


def predicted(text: Column, broadcast) -> Column:
    """Struct of ``lang_pred`` and ``score``; ``broadcast`` holds the filter."""

    @F.arrow_udf("struct<lang_pred: string, score: double>")
    def of(texts: pa.Array) -> pa.Array:
        held, names, scores = broadcast.value, [], []
        for part in arrays.slices(texts):
            share = shares(part, held) if held.languages else np.zeros((len(part), 0))
            for t, own in zip(part, share):
                t = t.as_py()
                if not own.size or t is None or not _LETTER.search(t):
                    names.append(UNKNOWN)
                    scores.append(0.0)
                    continue
                best = int(np.argmax(own))
                rest = np.delete(own, best).max() if own.size > 1 else 0.0
                names.append(held.languages[best])
                scores.append(float(own[best] / (own[best] + rest)) if own[best] > 0 else 0.0)
        return pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["lang_pred", "score"])

    return of(text)


def identify(docs: DataFrame, held: Filter, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``lang_pred`` and ``score`` of every row."""
    shared = ready(docs.sparkSession).sparkContext.broadcast(held)
    return docs.select(F.col(id_col).alias("doc_id"), predicted(F.col(text_col), shared).alias("p")).select("doc_id", "p.lang_pred", "p.score")
