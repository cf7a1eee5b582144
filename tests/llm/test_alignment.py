"""Token alignment against a loop over all pairs of tokens."""

import hashlib
from bisect import bisect_right
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from seriesmill.llm import alignment

A, B = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")


def brute(rows):
    """Per row (n_a, n_b, n_groups, n_links, n_best, count_sum, digest) by the tokenizers' own libraries."""
    tok = Tokenizer.from_file(A)
    tok.encode_special_tokens = True
    sp = sentencepiece.SentencePieceProcessor(model_file=B)
    letter = {c: bytes([b]) for b, c in enumerate(alignment.bpe.byte_letters())}
    counts, done = Counter(), []
    for d, t in rows:
        a = tok.encode(" " + t, add_special_tokens=False).ids if t else []
        b = sp.encode(t) if t else []
        raw_a = [b"".join(letter[c] for c in tok.id_to_token(i)) for i in a]
        raw_b = [bytes([int(sp.id_to_piece(i)[3:5], 16)]) if sp.is_byte(i) else sp.id_to_piece(i).replace("▁", " ").encode() for i in b]
        if not t or b"".join(raw_a) != (" " + t).encode() or b"".join(raw_b) != (" " + t).encode():
            a = b = raw_a = raw_b = []
        spans = []
        for raw in (raw_a, raw_b):
            ends = np.cumsum([0] + list(map(len, raw))).tolist()
            spans.append(list(zip(ends, ends[1:])))
        links, low = [], 0
        for i, (s, e) in zip(a, spans[0]):
            while low < len(b) and spans[1][low][1] <= s:
                low += 1
            j = low
            while j < len(b) and spans[1][j][0] < e:
                links.append((i, b[j]))
                j += 1
        counts.update(links)
        cuts = sorted({e for _, e in spans[0]} & {e for _, e in spans[1]})
        sides = [([], []) for _ in cuts]
        for side, ids in enumerate((a, b)):
            for i, (s, _) in zip(ids, spans[side]):
                sides[bisect_right(cuts, s)][side].append(str(i))
        groups = ["|".join(map(",".join, x)) for x in sides]
        done.append((d, len(a), len(b), links, ";".join(groups), len(groups)))
    top = Counter()
    for (_, j), n in counts.items():
        top[j] = max(top[j], n)
    out = []
    for d, n_a, n_b, links, groups, n in done:
        best = sum(counts[x] == top[x[1]] for x in links)
        out.append((d, n_a, n_b, n, len(links), best, sum(counts[x] for x in links), hashlib.sha256(groups.encode()).hexdigest() if n_a else ""))
    return sorted(out, key=str)


def found(docs, hot=alignment.HOT):
    digest = F.when(F.col("n_a") == 0, F.lit("")).otherwise(F.sha2("groups", 256)).alias("digest")
    rows = alignment.align_documents(docs, A, B).select("doc_id", "n_a", "n_b", "n_groups", "n_links", digest, "pairs", "times")
    out = alignment.with_counts(rows, alignment.pair_counts(rows), hot)
    return sorted(((r.doc_id, r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.digest) for r in out.collect()), key=str)


SHORT = "Größe naïve façade, 12345 tokens; don't  stop\n\n\tnow! <|endoftext|> <s> </s> \U0001f600 日本語のテキスト x\x00y "


@pytest.mark.parametrize("hot", [1 << 22, 40, 0])
def test_against_loops(make, hot):
    rows = [(i if i % 4 else None, SHORT[i:] * (1 + i % 2)) for i in range(25)]
    rows += [(1, None), (2, ""), (3, " "), (4, "a ▁ b"), (5, "\n"), (6, SHORT), (6, SHORT), (7, " " * 5000), (8, "x" * 3000), (9, "\r\n" * 1200), (10, "é")]
    docs = make([(d, t, None, None) for d, t in rows])
    for name in ("r", "pairs", "times", "n", "best", "row", "pair", "k", "groups", "n_a"):
        docs = docs.withColumn(name, F.lit("x"))
    assert found(docs, hot) == brute(rows)


def test_given(spark, texts):
    some = texts[:80]
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").filter(F.col("doc_id") <= some[-1][0])
    assert found(docs) == brute(some)


def test_odd_and_empty(odd, make):
    assert found(odd) == brute([(r.doc_id, r.text) for r in odd.collect()])
    assert found(make([])) == []


def test_coalesce_small():
    # A: [0, 3) [3, 5) [5, 6); B: [0, 1) [1, 5) [5, 6)
    order, group, side = alignment.coalesce(np.array([3, 5, 6]), np.array([1, 5, 6]))
    assert group.tolist() == [0, 0, 1, 0, 0, 1] and order.tolist() == [0, 1, 3, 4, 2, 5]
    a, b = alignment.overlaps(np.array([3, 5, 6]), np.array([1, 5, 6]))
    assert list(zip(a.tolist(), b.tolist())) == [(0, 0), (0, 1), (1, 1), (2, 2)]
