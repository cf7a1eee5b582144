"""Line dedup against a dictionary of lines; the perfect hash; both ways of probing."""

import hashlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from seriesmill.llm import lines

SPACE = " \t\n\x0b\x0c\r"


def brute(rows, least=5, chars=40):
    held = defaultdict(set)
    split = [((d, t), (t or "").split("\n")) for d, t in rows]

    def key(line):
        k = line.strip(SPACE)
        return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in k) if len(k) >= chars else None

    for (d, _), own in split:
        for line in own:
            if (k := key(line)) is not None:
                held[k].add(d)
    last = {k: max((d for d in ids if d is not None), default=None) for k, ids in held.items() if len(ids) >= least}
    out = []
    for (d, _), own in split:
        kept = [x for x in own if key(x) not in last or (d is not None and d == last[key(x)])]
        out.append((d, len(own), len(own) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=str)


def found(df):
    return sorted(((r.doc_id, r.n_lines, r.n_dropped, hashlib.sha256(r.kept.encode()).hexdigest()) for r in df.collect()), key=str)


def crowd():
    """Lines shared by 1 to 30 documents, case and white space varied, with a hot one, nulls, repeated rows and empty texts."""
    shared = [f"Passage number {i} with enough letters to be counted ÀÉ" for i in range(30)]
    rows = []
    for d in range(60):
        own = [f"a line of document {d} alone, long enough to be a key {j}" for j in range(3)]
        own += [(f" {s.upper()}\t" if (d + i) % 3 == 0 else s) for i, s in enumerate(shared) if d % 30 <= i]
        own += ["short", "", "a hot line that every document holds, forty letters"] * (1 + d % 2)
        rows.append((d if d % 7 else None, "\n".join(own)))
    return rows + [rows[3], rows[3], (5, rows[4][1]), (None, None), (99, ""), (98, None), (97, "\n\n")]


def test_perfect_hash_is_a_bijection():
    rng = np.random.default_rng(3)
    for n in (0, 1, 2, 63, 5000):
        h, g = rng.integers(0, 2**64, (2, n), dtype=np.uint64)
        h[: n // 2] = h[:1]  # equal first halves
        hashed = lines.PerfectHash.of(h, g)
        assert sorted(hashed.place(h, g).tolist()) == list(range(n))
        assert len(hashed.words) * 64 <= 10 * n + 64 * 12


@pytest.mark.parametrize("hot", [1 << 20, 8, 0])
def test_against_dictionary(make, hot):
    rows = crowd()
    docs = make([(d, t, None, None) for d, t in rows])
    assert found(lines.drop_shared_lines(docs, hot=hot, shard_keys=4)) == brute(rows)


def test_given(spark, texts):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert found(lines.drop_shared_lines(docs)) == brute(texts)


def test_odd_and_empty(odd, make):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    assert found(lines.drop_shared_lines(odd, least_docs=2, min_chars=5)) == brute(rows, 2, 5)
    assert lines.drop_shared_lines(make([])).collect() == []


def test_other_columns_are_not_read(make):
    rows = crowd()
    docs = make([(d, t, None, None) for d, t in rows])
    for name in ("h", "g", "t", "docs", "last", "gone", "known", "shard", "r", "kept", "n_lines", "k", "i", "u", "probe"):
        docs = docs.withColumn(name, F.lit("x"))
    assert found(lines.drop_shared_lines(docs, hot=8, shard_keys=4)) == brute(rows)
