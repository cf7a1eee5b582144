"""Spelling variants against all pairs of words."""

import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from seriesmill.llm import spelling


def near(a, b):
    """Exactly one inserted, deleted or replaced letter."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(rows):
    counts = Counter()
    for d, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            low = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if d is None else d}:{low}".encode())
            if h % 31 == 0:
                at = h % len(low)
                low = low[:at] + low[at + 1 :]
            counts[low] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}
    form, n_near = {}, {}
    for w, n in words.items():
        others = [x for x in words if abs(len(x) - len(w)) <= 1 and near(w, x)]
        n_near[w] = len(others)
        best = min(others, key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= 10 * n else None

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return sorted((w, form[w], root(w), n, n_near[w], words.get(form[w])) for w, n in words.items())


def found(df):
    return sorted((r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect())


def family():
    """A chain of forms of about 2, 30, 500 and 8,000 occurrences, ties, anagrams, accents, every place of the edit."""
    base, rows = "überlegung", []
    for n, w in ((2, "uberlegung"), (30, base), (500, "überlegungÿ"), (8000, "überlegungÿs"), (30, "überleegung"), (30, "überlegunga")):
        rows += [f"{w} {w.upper() if w.isascii() else w}" for _ in range(n // 2)]
    rows += [f"{base[:i]}X{base[i:]} {base[:i]}X{base[i:]} {base[:i]}{base[i + 1:]} {base[:i]}{base[i + 1:]}" for i in range(len(base))]
    rows += ["gnugelrebü gnugelrebü regnugelbü regnugelbü aaaaaaa aaaaaaaa aaaaaaaa aaaaaaa", "aaaaaab aaaaaab abaaaaa abaaaaa ×÷×÷×÷× ×÷×÷×÷×"]
    return [(i if i % 5 else None, t) for i, t in enumerate(rows)] + [(1, None), (2, ""), (3, "sixsix"), (3, "sixsix")]


@pytest.mark.parametrize("parts", [3, 5, 7])
def test_against_all_pairs(make, parts):
    rows = family()
    got = found(spelling.spelling_variants(make([(d, t, None, None) for d, t in rows]), parts=parts))
    assert got == brute(rows)
    assert {r[2] for r in got if r[0] == "uberlegung"} == {"überlegungÿs"}


def test_given(spark, texts):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert found(spelling.spelling_variants(docs)) == brute(texts)


def test_odd_empty_and_other_columns(odd, make):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    docs = odd
    for name in ("word", "n", "near", "near_n", "form", "key", "run", "root", "next"):
        docs = docs.withColumn(name, F.lit("x"))
    assert found(spelling.spelling_variants(docs)) == brute(rows)
    assert spelling.spelling_variants(make([])).collect() == []
