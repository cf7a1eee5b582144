"""Aligns the tokens of two tokenizers by interval coalescing over byte offsets.

Tokenizer A (byte-level BPE, JSON file) encodes a space and the text, tokenizer B (sentencepiece model) the text, before
which it puts a space itself; both then cover the same bytes. The tokens of A and B are intervals; sorted by start, with
the running maximum of their ends, a group begins where a start reaches that maximum. Inside a group every A token expands
into the B tokens whose bytes it overlaps: the links. Whole slices of texts are laid end to end and done at once, as a text's
end is an end of both sides.

Texts are encoded once; a row keeps its different id pairs with their numbers. Pairs are counted over all rows, combined
before the shuffle. The ``HOT`` most frequent pairs at most are broadcast (17 bytes each) and looked up where the rows are read; the
links of rarer pairs, if there are any, are joined with the counts and summed per row.

A's merges are done by the ``tiktoken`` library with ranks made from A's own file; this needs ids that ascend with the
merges, which is checked. Texts with very long runs of white space, which that library's pattern can't take, are encoded by
``bpe``, with the same ids.

Defined results: strings of special tokens are plain text. Texts that are null or empty, or whose A or B tokens' bytes are
not the space and the text (a U+2581 in it, say) have no tokens: zeros and an empty string. Repeated rows count each. An
empty table gives an empty result. Columns other than the named ones are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import sentencepiece
import tiktoken
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seriesmill.llm import arrays, bpe
from seriesmill.llm.common import ready, settle

HOT = 1 << 22  # id pairs that are broadcast at most
_B = 1 << 31  # a pair in one number: A's id times this, plus B's
_LONG_SPACE = re.compile(r"\s{1000}")
_SLICE = 256 << 10


class Pair:
    """Both tokenizers, the bytes of their tokens, and the decimal ids with what follows them in a group's text."""

    def __init__(self, path_a: str, path_b: str):
        self.own = bpe.load(path_a)
        ids = [union for _, union in sorted(self.own.merges.values())]
        if ids != sorted(ids):
            raise ValueError(f"ids of {path_a} do not ascend with its merges")
        special = set(self.own.added.values())
        ranks = {raw: i for i, raw in self.own.bytes_of.items() if i not in special}
        self.a = tiktoken.Encoding("a", pat_str=bpe.PRE_TOKEN, mergeable_ranks=ranks, special_tokens={})
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        of_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        of_a = [self.own.bytes_of.get(i, b"") for i in range(max(self.own.bytes_of) + 1)]
        self.raw = of_a, of_b
        self.sizes = tuple(np.array(list(map(len, x)), np.int64) for x in self.raw)
        self.n_a = len(of_a)
        names = [str(i) for i in range(self.n_a)], [str(i) for i in range(len(of_b))]
        # what follows: the next token of the side, or the other side, or the next group, or the text's end
        self.shown = [f"{i}{after}" for own, sides in zip(names, (",|", ",;")) for after in sides for i in own] + names[1]

    def encode(self, text: str) -> tuple[list[int], list[int]]:
        """Ids of both sides, none where the bytes of either differ from a space and the text."""
        if not text:
            return [], []
        spaced = " " + text
        a = self.a.encode_ordinary(spaced) if not _LONG_SPACE.search(spaced) else self.own.encode_plain(spaced)
        b, whole = self.b.encode(text), spaced.encode("utf-8", "replace")
        for ids, raw in zip((a, b), self.raw):
            if b"".join(map(raw.__getitem__, ids)) != whole:
                return [], []
        return a, b


@cache
def load(path_a: str, path_b: str) -> Pair:
    return Pair(path_a, path_b)


def coalesce(end_a: np.ndarray, end_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order of all tokens (A's, then B's numbers) by group and side, each one's group, and A's number.

    ``end_a`` and ``end_b`` are the ends of consecutive tokens from byte 0 on, with the same last end.
    """
    end = np.concatenate((end_a, end_b))
    start = np.concatenate(([0], end_a[:-1], [0], end_b[:-1])) if len(end) else end
    order = np.lexsort((-end, start))
    reach = np.maximum.accumulate(end[order])
    fresh = np.ones(len(order), bool)
    fresh[1:] = start[order][1:] >= reach[:-1]
    group = np.empty(len(order), np.int64)
    group[order] = np.cumsum(fresh) - 1
    side = np.arange(len(order)) >= len(end_a)
    return np.lexsort((side, group)), group, side


def overlaps(end_a: np.ndarray, end_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs (A's number, B's number) of tokens whose bytes overlap."""
    start_a = np.concatenate(([0], end_a[:-1])) if len(end_a) else end_a
    start_b = np.concatenate(([0], end_b[:-1])) if len(end_b) else end_b
    first, last = np.searchsorted(end_b, start_a, side="right"), np.searchsorted(start_b, end_a, side="left")
    n = last - first
    a = np.repeat(np.arange(len(end_a)), n)
    b = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first, n)
    return a, b


_ALIGNED = "struct<n_a: bigint, n_b: bigint, n_groups: bigint, n_links: bigint, groups: string, pairs: array<bigint>, times: array<int>>"


def _aligned(texts: list[str], pair: Pair) -> list[pa.Array]:
    """The columns of ``_ALIGNED`` for one slice of texts."""
    ids = [pair.encode(t) for t in texts]
    n = len(texts)
    n_a, n_b = (np.array([len(x[i]) for x in ids], np.int64) for i in (0, 1))
    a, b = (np.fromiter((t for x in ids for t in x[i]), np.int64, int(k.sum())) for i, k in ((0, n_a), (1, n_b)))
    end_a, end_b = np.cumsum(pair.sizes[0][a]), np.cumsum(pair.sizes[1][b])
    order, group, side = coalesce(end_a, end_b)
    doc = np.concatenate((np.repeat(np.arange(n), n_a), np.repeat(np.arange(n), n_b)))
    # the text of the groups: A's ids, then B's, with what follows each
    own, at, right = np.concatenate((a, b))[order], group[order], side[order]
    turn = np.ones(len(order), bool)
    turn[:-1] = (at[1:] != at[:-1]) | (right[1:] != right[:-1])
    final = np.ones(len(order), bool)
    final[:-1] = doc[order][1:] != doc[order][:-1]
    n_a_ids, n_b_ids = pair.n_a, len(pair.raw[1])
    shown = np.where(right, 2 * n_a_ids + n_b_ids * (turn.astype(np.int64) + final), n_a_ids * turn) + own
    shown, ends = shown.tolist(), np.concatenate(([0], np.cumsum(n_a + n_b))).tolist()
    names = pair.shown.__getitem__
    groups = ["".join(map(names, shown[i:j])) for i, j in zip(ends, ends[1:])]
    n_groups = np.bincount(doc[order][np.concatenate(([True], at[1:] != at[:-1]))], minlength=n) if len(at) else np.zeros(n, np.int64)
    # links
    left, met = overlaps(end_a, end_b)
    of = doc[left]
    code = a[left] * _B + b[met]
    by = np.lexsort((code, of))
    of, code = of[by], code[by]
    head = np.ones(len(by), bool)
    head[1:] = (of[1:] != of[:-1]) | (code[1:] != code[:-1])
    first = np.flatnonzero(head)
    times = np.diff(np.concatenate((first, [len(by)])))
    offsets = pa.array(np.concatenate(([0], np.cumsum(np.bincount(of[first], minlength=n)))).astype(np.int32))
    n_links = np.bincount(of, minlength=n).astype(np.int64)
    lists = [pa.ListArray.from_arrays(offsets, pa.array(v)) for v in (code[first], times.astype(np.int32))]
    return [*(pa.array(v.astype(np.int64)) for v in (n_a, n_b, n_groups, n_links)), pa.array(groups, pa.string()), *lists]


_FIELDS = ["n_a", "n_b", "n_groups", "n_links", "groups", "pairs", "times"]


def aligned(text: Column, path_a: str, path_b: str) -> Column:
    """Struct of counts, ``groups`` (A's ids | B's ids of every group) and the different id ``pairs`` with their ``times``."""

    @F.arrow_udf(_ALIGNED)
    def of(texts: pa.Array) -> pa.Array:
        pair, out = load(path_a, path_b), []
        for part in arrays.slices(texts, _SLICE):
            out.append(pa.StructArray.from_arrays(_aligned([t.as_py() or "" for t in part], pair), _FIELDS))
        return pa.concat_arrays(out) if out else pa.StructArray.from_arrays(_aligned([], pair), _FIELDS)

    return of(text)


def align_documents(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``n_a``, ``n_b``, ``n_groups``, ``n_links``, ``groups``, ``pairs`` and ``times`` of every row."""
    ready(docs.sparkSession)
    out = docs.select(F.col(id_col).alias("doc_id"), aligned(F.col(text_col), path_a, path_b).alias("r"))
    return out.select("doc_id", *[f"r.{c}" for c in _FIELDS])


def pair_counts(rows: DataFrame) -> DataFrame:
    """``pair``, ``n`` (links that hold it, over all ``rows``) and ``best``: no pair of the same B id has more."""
    each = rows.select(F.explode(F.arrays_zip("pairs", "times")).alias("x")).select(F.col("x.pairs").alias("pair"), F.col("x.times").alias("k"))
    counts = each.groupBy("pair").agg(F.sum("k").alias("n"))
    top = F.max("n").over(Window.partitionBy(F.col("pair") % _B))  # of one B id: A's vocabulary at most
    return counts.withColumn("best", F.col("n") == top)


def summed(pairs: Column, times: Column, known: object) -> Column:
    """Struct of ``n_best`` and ``count_sum`` over the pairs that are known, and the others with their times."""

    @F.arrow_udf("struct<n_best: bigint, count_sum: bigint, pairs: array<bigint>, times: array<int>>")
    def of(pairs: pa.Array, times: pa.Array) -> pa.Array:
        keys, n, best = known.value
        code, k = (x.flatten().to_numpy() for x in (pairs, times))
        row = np.repeat(np.arange(len(pairs)), np.diff(pairs.offsets.to_numpy()))
        at = np.minimum(np.searchsorted(keys, code), max(0, len(keys) - 1))
        found = keys[at] == code if len(keys) else np.zeros(len(code), bool)
        some, at = k[found].astype(np.int64), at[found]
        sums = np.zeros((2, len(pairs)), np.int64)
        np.add.at(sums[0], row[found], some * best[at])
        np.add.at(sums[1], row[found], some * n[at])
        ends = pa.array(np.concatenate(([0], np.cumsum(np.bincount(row[~found], minlength=len(pairs))))).astype(np.int32))
        rest = [pa.ListArray.from_arrays(ends, pa.array(x[~found])) for x in (code, k)]
        return pa.StructArray.from_arrays([pa.array(sums[0]), pa.array(sums[1]), *rest], ["n_best", "count_sum", "pairs", "times"])

    return of(pairs, times)


def with_counts(rows: DataFrame, counts: DataFrame, hot: int = HOT) -> DataFrame:
    """``rows`` (which have ``pairs`` and ``times``) with ``n_best`` and ``count_sum`` in their place."""
    spark = rows.sparkSession
    sizes = counts.groupBy(F.floor(F.log2("n")).cast("int").alias("b")).agg(F.count("*").alias("n")).collect()  # 64 rows at most
    total, least = 0, max((r.b for r in sizes), default=0) + 1
    for b, n in sorted(((r.b, r.n) for r in sizes), reverse=True):
        total += n
        if total > hot:
            break
        least = b
    most = counts.filter(F.col("n") >= (1 << least)).toArrow()  # ``hot`` rows at most
    keys, n, best = (most.column(c).to_numpy() for c in ("pair", "n", "best"))
    order = np.argsort(keys)
    known = spark.sparkContext.broadcast((keys[order], n[order], best[order]))
    keep = [c for c in rows.columns if c not in ("pairs", "times")]
    done = rows.select(*keep, summed(F.col("pairs"), F.col("times"), known).alias("r"))
    if len(keys) == sum(r.n for r in sizes):
        return done.select(*keep, "r.n_best", "r.count_sum")
    done = settle(done.withColumn("row", F.expr("uuid()")), "aligned")
    rare = done.select("row", F.explode(F.arrays_zip("r.pairs", "r.times")).alias("x")).select("row", F.col("x.pairs").alias("pair"), F.col("x.times").alias("k"))
    rare = rare.join(counts, "pair").groupBy("row").agg(F.sum(F.col("k") * F.col("n")).alias("sum"), F.sum(F.when(F.col("best"), F.col("k")).otherwise(0)).alias("top"))
    zero = F.lit(0).cast("long")
    both = [(F.col("r.n_best") + F.coalesce("top", zero)).alias("n_best"), (F.col("r.count_sum") + F.coalesce("sum", zero)).alias("count_sum")]
    return done.join(rare, "row", "left").select(*keep, *both)
