"""Masked pseudo-likelihood of documents under a small bidirectional window network, trained in numpy.

Tokens are lower-case words; the most frequent ones of the whole corpus have ids of their own, all others share
hashed ids, and a word's probability is its id's times its share of the id by the full counts. The network adds one vector per neighbour (``REACH`` words to each side), applies tanh and predicts the word
between them in two steps: its class, then the word within the class. A document's score is the sum of the
log-probabilities of its words, each given both sides.

Training is data-parallel: in each round every partition runs through its own share of the corpus from the common weights,
and the new weights are averaged by tokens seen. Each round takes every ``STRIDE``-th word of every text, counted within the
text, another residue each time: with as many rounds as ``STRIDE``, every word of every text is predicted once. Memory is bounded by slices of
texts, the weights' size is fixed by parameters.

Defined results: null, empty and wordless texts have 0 tokens, log-likelihood 0 and a null mean; texts of one word are
predicted from two borders. Repeated rows score alike. An empty table gives an empty result (and an untrained model is
uniform up to its start values). Ids are only carried. Columns other than the named ones are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seriesmill.llm import arrays
from seriesmill.llm.common import ready, settle

CLASSES, PER_CLASS, WIDTH, REACH = 32, 32, 16, 2
SHARED = 256  # ids that words outside the vocabulary are hashed to
STRIDE, ROUNDS, BATCH, RATE = 2, 2, 1024, 1.0
SIDES = [i for i in range(-REACH, REACH + 1) if i]
_CHUNKS = 64
_SLICE = 1 << 13  # words whose probabilities are computed at once


def word_codes(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Number of texts, word hashes and their text numbers, slice by slice."""
    for part in arrays.slices(texts):
        body, ends = arrays.joined(part)
        start, end, doc = arrays.word_spans(body, ends)
        yield len(part), arrays.range_hash(arrays.prefix_hash(arrays.lowered(body)), start, end), doc


def word_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``word`` (hash) and ``n`` of every word of all texts."""
    ready(docs.sparkSession)

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, codes, _ in word_codes(batch.column("text")):
                found, n = np.unique(codes, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(n, pa.int64())], ["word", "n"])

    return docs.select(F.col(text_col).alias("text")).mapInArrow(counts, "word bigint, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def vocabulary(docs: DataFrame, text_col: str = "text", size: int = CLASSES * PER_CLASS - SHARED, counts: DataFrame | None = None) -> np.ndarray:
    """Hashes of the most frequent words of all texts, most frequent first."""
    total = word_counts(docs, text_col) if counts is None else counts
    rows = total.orderBy(F.desc("n"), "word").limit(size).collect()  # a fixed number of words
    return np.array([r["word"] for r in rows], np.int64).view(np.uint64)


@dataclass
class Network:
    """Vocabulary and weights. Id ``CLASSES * PER_CLASS`` stands for what lies beyond a text's border."""

    words: np.ndarray  # sorted hashes
    ids: np.ndarray  # their ids
    around: np.ndarray  # (sides, ids + 1, width)
    to_class: np.ndarray  # (width + 1, classes)
    to_word: np.ndarray  # (classes, width + 1, per class)

    @staticmethod
    def fresh(vocab: np.ndarray, seed: int = 11) -> Network:
        rng, n = np.random.default_rng(seed), CLASSES * PER_CLASS
        order = np.argsort(vocab)
        small = lambda *shape: (rng.normal(size=shape) * 0.1).astype(np.float32)
        return Network(
            vocab[order], order + SHARED, small(len(SIDES), n + 1, WIDTH), small(WIDTH + 1, CLASSES), small(CLASSES, WIDTH + 1, PER_CLASS)
        )

    def flat(self) -> np.ndarray:
        return np.concatenate([self.around.ravel(), self.to_class.ravel(), self.to_word.ravel()])

    def with_weights(self, flat: np.ndarray) -> Network:
        flat, at, out = flat.astype(np.float32), 0, []
        for w in (self.around, self.to_class, self.to_word):
            out.append(flat[at : at + w.size].reshape(w.shape).copy())
            at += w.size
        return Network(self.words, self.ids, *out)

    def tokens(self, codes: np.ndarray) -> np.ndarray:
        """Ids of words; neighbouring ids differ in class, so classes are equally frequent."""
        if not len(self.words):
            return (codes % np.uint64(SHARED)).astype(np.int64)
        at = np.minimum(np.searchsorted(self.words, codes), len(self.words) - 1)
        return np.where(self.words[at] == codes, self.ids[at], (codes % np.uint64(SHARED)).astype(np.int64))

    def hidden(self, context: np.ndarray) -> np.ndarray:
        total = np.take(self.around[0], context[:, 0], axis=0)
        for side in range(1, len(SIDES)):
            total += np.take(self.around[side], context[:, side], axis=0)
        out = np.ones((len(total), WIDTH + 1), np.float32)
        np.tanh(total, out=out[:, :-1])
        return out

    def by_class(self, token: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Classes and a table with the places of their words in one row per class, filled up with ``len(token)``.

        Classes of like size share a table, so a frequent class doesn't widen the others.
        """
        kind = (token % CLASSES).astype(np.uint8)
        order = np.append(np.argsort(kind, kind="stable"), len(token))
        sizes = np.bincount(kind, minlength=CLASSES)
        begins = np.cumsum(sizes) - sizes
        for kinds in np.split(np.argsort(sizes, kind="stable"), [CLASSES // 2, CLASSES * 7 // 8]):
            nth = np.arange(sizes[kinds].max())
            if len(nth):
                yield kinds, order[np.where(nth < sizes[kinds][:, None], begins[kinds][:, None] + nth, len(token))]

    def log_probabilities(self, context: np.ndarray, token: np.ndarray) -> np.ndarray:
        out = np.empty(len(token), np.float32)
        for at in range(0, len(token), _SLICE):
            own = token[at : at + _SLICE]
            n, h = len(own), self.hidden(context[at : at + _SLICE])
            a = h @ self.to_class
            h, place = np.concatenate((h, h[:1])), np.append(own // CLASSES, 0)
            part = np.empty(n + 1, np.float32)
            for kinds, rows in self.by_class(own):
                b = np.take(h, rows, axis=0) @ self.to_word[kinds]
                part[rows] = np.take_along_axis(b, place[rows][..., None], axis=2)[..., 0] - np.log(np.exp(b, out=b).sum(axis=2))
            out[at : at + n] = part[:n] + a[np.arange(n), own % CLASSES] - np.log(np.exp(a).sum(axis=1))
        return out

    def step(self, context: np.ndarray, token: np.ndarray, rate: float) -> None:
        """One gradient step on the mean log-probability."""
        n, h = len(token), self.hidden(context)
        a = np.exp(h @ self.to_class)
        a /= a.sum(axis=1, keepdims=True)
        a[np.arange(n), token % CLASSES] -= 1
        grad_class = h.T @ a
        padded, place = np.concatenate((h, np.zeros((1, WIDTH + 1), np.float32))), np.append(token // CLASSES, 0)
        back = np.empty_like(padded)  # its last row takes what the fillers give, and is left out
        for kinds, rows in self.by_class(token):
            own, weights = np.take(padded, rows, axis=0), self.to_word[kinds]
            b = own @ weights
            np.exp(b, out=b)
            b /= b.sum(axis=2, keepdims=True)
            b.reshape(-1, PER_CLASS)[np.arange(rows.size), place[rows.ravel()]] -= 1
            back[rows] = b @ weights.transpose(0, 2, 1)
            self.to_word[kinds] -= np.float32(rate / n * 4) * (own.transpose(0, 2, 1) @ b)
        back = back[:n] + a @ self.to_class.T
        self.to_class -= np.float32(rate / n) * grad_class
        inner = (back[:, :-1] * (1 - h[:, :-1] ** 2)) * np.float32(8 * rate / n)
        vectors = context + np.arange(len(SIDES)) * (CLASSES * PER_CLASS + 1)
        numbers = (vectors * WIDTH)[:, :, None] + np.arange(WIDTH)
        np.subtract.at(self.around.reshape(-1), numbers.reshape(-1), np.repeat(inner[:, None], len(SIDES), axis=1).reshape(-1))


def contexts(token: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Ids of the neighbours of every word, the border id beyond its text."""
    out = np.full((len(token), len(SIDES)), CLASSES * PER_CLASS, np.int64)
    for side, shift in enumerate(SIDES):
        a, b = (slice(0, len(token) + shift), slice(-shift, None)) if shift < 0 else (slice(shift, None), slice(0, len(token) - shift))
        if abs(shift) < len(token):
            same = doc[a] == doc[b]
            out[b, side][same] = token[a][same]
    return out


def targets(doc: np.ndarray, turn: int, stride: int) -> np.ndarray:
    """Places of the words that a round predicts: every ``stride``-th of each text."""
    return np.flatnonzero((np.arange(len(doc)) - np.searchsorted(doc, doc)) % stride == turn % stride)


def trained(docs: DataFrame, text_col: str = "text", rounds: int = ROUNDS, stride: int = STRIDE, rate: float = RATE, seed: int = 11, counts: DataFrame | None = None) -> Network:
    """Trains on all texts, round by round."""
    net = Network.fresh(vocabulary(docs, text_col, counts=counts), seed)
    spark = docs.sparkSession
    texts = docs.select(F.col(text_col).alias("text"))

    def added(rows: pd.DataFrame) -> pd.DataFrame:
        total = np.sum(np.stack(rows["sums"].to_list()), axis=0)
        return pd.DataFrame({"chunk": rows["chunk"].iloc[:1], "n": [rows["n"].sum()], "sums": [total]})

    schema = "chunk int, n double, sums array<float>"
    for turn in range(rounds):
        shared = spark.sparkContext.broadcast(net)

        def learn(batches: Iterator[pa.RecordBatch], turn=turn, shared=shared) -> Iterator[pa.RecordBatch]:
            own, seen = shared.value.with_weights(shared.value.flat()), 0
            for batch in batches:
                for _, codes, doc in word_codes(batch.column("text")):
                    token = own.tokens(codes)
                    around = contexts(token, doc)
                    chosen = targets(doc, turn, stride)
                    for at in range(0, len(chosen), BATCH):
                        rows = chosen[at : at + BATCH]
                        own.step(around[rows], token[rows], rate * min(1.0, len(rows) / BATCH))
                    seen += len(chosen)
            if seen:
                pieces = np.array_split(own.flat() * np.float32(seen), _CHUNKS)
                columns = [pa.array(range(_CHUNKS), pa.int32()), pa.array([float(seen)] * _CHUNKS), pa.array(pieces, pa.list_(pa.float32()))]
                yield pa.RecordBatch.from_arrays(columns, ["chunk", "n", "sums"])

        sums = texts.mapInArrow(learn, schema).withColumn("part", F.spark_partition_id() % 64)
        sums = sums.groupBy("chunk", "part").applyInPandas(added, schema).groupBy("chunk").applyInPandas(added, schema)
        rows = sorted(sums.collect(), key=lambda r: r["chunk"])  # one set of weights
        if not rows:
            break
        net = net.with_weights(np.concatenate([np.array(r["sums"]) / r["n"] for r in rows]))
    return net


def scored(text: Column, broadcast) -> Column:
    """Struct of ``n_tokens``, ``log_likelihood`` with shared ids as they are, and the words that have those, with their numbers."""

    @F.arrow_udf("struct<n_tokens: bigint, log_likelihood: double, rare: array<bigint>, times: array<bigint>>")
    def of(texts: pa.Array) -> pa.Array:
        none = np.zeros(0, np.int64)
        net, counts, sums, kinds, rare, times = broadcast.value, [none], [np.zeros(0)], [none], [none], [none]
        for n, codes, doc in word_codes(texts):
            token = net.tokens(codes)
            counts.append(np.bincount(doc, minlength=n))
            sums.append(np.bincount(doc, weights=net.log_probabilities(contexts(token, doc), token), minlength=n))
            shared = token < SHARED
            words, owner = codes[shared].view(np.int64), doc[shared]
            order = np.lexsort((words, owner))
            words, owner = words[order], owner[order]
            first = np.flatnonzero(np.concatenate(([True], (words[1:] != words[:-1]) | (owner[1:] != owner[:-1])))[: len(words)])
            times.append(np.diff(np.append(first, len(words))))
            rare.append(words[first])
            kinds.append(np.bincount(owner[first], minlength=n))
        columns = [pa.array(np.concatenate(counts), pa.int64()), pa.array(np.concatenate(sums), pa.float64())]
        ends = pa.array(np.append(0, np.cumsum(np.concatenate(kinds))), pa.int32())
        columns += [pa.ListArray.from_arrays(ends, pa.array(np.concatenate(x), pa.int64())) for x in (rare, times)]
        return pa.StructArray.from_arrays(columns, ["n_tokens", "log_likelihood", "rare", "times"])

    return of(text)


def shares(words: DataFrame, net: Network, counts: DataFrame) -> DataFrame:
    """Adds ``share``, the logarithm of a word's part of its shared id: by its number in the corpus plus a half, a half if unseen."""
    spark, half, ident = words.sparkSession, F.lit(0.5), F.col("word").bitwiseAND(F.lit(SHARED - 1))
    own = spark.createDataFrame([(int(w),) for w in net.words.view(np.int64)], "word bigint")
    others = counts.join(F.broadcast(own), "word", "left_anti")
    totals = others.groupBy(ident.alias("id")).agg((F.sum("n") + half * (F.count("*") + 1)).alias("total"))
    out = words.join(others, "word", "left").withColumn("id", ident).join(F.broadcast(totals), "id", "left")
    return out.withColumn("share", F.log(F.coalesce("n", F.lit(0)) + half) - F.log(F.coalesce("total", half))).drop("n", "id", "total")


def score_documents(docs: DataFrame, net: Network, id_col: str = "doc_id", text_col: str = "text", counts: DataFrame | None = None) -> DataFrame:
    """``doc_id``, ``n_tokens``, ``log_likelihood`` and ``mean_log_likelihood`` (null without tokens).

    ``counts`` (of ``word_counts``) takes a word with a shared id at its own probability: the id's times the word's share.
    """
    shared = ready(docs.sparkSession).sparkContext.broadcast(net)
    out = docs.select(F.col(id_col).alias("doc_id"), scored(F.col(text_col), shared).alias("s")).select("doc_id", "s.*")
    if counts is not None:
        out = settle(out.withColumn("row", F.monotonically_increasing_id()), "lm")
        words = out.select("row", F.explode(F.arrays_zip("rare", "times")).alias("w")).select("row", F.col("w.rare").alias("word"), F.col("w.times").alias("times"))
        less = shares(words, net, counts).groupBy("row").agg(F.sum(F.col("times") * F.col("share")).alias("less"))
        out = out.drop("rare", "times").join(less, "row", "left")
        out = out.withColumn("log_likelihood", F.col("log_likelihood") + F.coalesce("less", F.lit(0.0)))
    mean = F.when(F.col("n_tokens") > 0, F.col("log_likelihood") / F.col("n_tokens"))
    return out.select("doc_id", "n_tokens", "log_likelihood").withColumn("mean_log_likelihood", mean)
