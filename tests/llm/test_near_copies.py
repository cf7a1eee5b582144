"""Near copies against the likeness of all pairs."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from seriesmill.llm import common, near_copies

SF = "/root/testdata/sf0.001"


def shingle_set(text):
    lower = bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode())
    words = lower.split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def exact_groups(texts):
    """Smallest id that each id reaches over pairs of likeness 0.8 or more."""
    sets, root = {i: shingle_set(t) for i, t in texts.items()}, {i: i for i in texts}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(texts)
    for at, a in enumerate(ids):
        for b in ids[:at]:
            small, large = sorted((len(sets[a]), len(sets[b])))
            if small >= 0.8 * large:
                both = len(sets[a] & sets[b])
                if not large or both >= 0.8 * (small + large - both):
                    x, y = sorted((top(a), top(b)))
                    root[y] = x
    return {i: top(i) for i in ids}


def prose(rng, n):
    return [f"w{rng.randrange(4000)}" for _ in range(n)]


def edited(rng, words, times):
    out = list(words)
    for at in rng.sample(range(len(out)), times):
        out[at] = f"new{rng.randrange(10**6)}"
    return out


def test_given(spark, texts):
    got = {r.doc_id: r.component_id for r in near_copies.near_copies(spark.read.parquet(f"{SF}/documents.parquet")).collect()}
    assert got == exact_groups(dict(texts))


@pytest.mark.parametrize("limit", [2, 16])
def test_large_group(make, limit):
    rng, rows = random.Random(5), []
    base, shared = prose(rng, 200), prose(rng, 150)
    rows += [" ".join(edited(rng, base, 4)) for _ in range(60)] + [" ".join(base)]  # to the base 0.82, mostly less to each other
    rows += [" ".join(shared + prose(rng, 150)) for _ in range(40)]  # one passage in texts that are not alike
    rows += [" ".join(base[:199]).upper(), " ".join(base) + "\n"]
    rng.shuffle(rows)
    texts = dict(enumerate(rows))
    got = {r.doc_id: r.component_id for r in near_copies.near_copies(make([(i, t, "en", "a") for i, t in texts.items()]), pair_limit=limit).collect()}
    assert got == exact_groups(texts)
    kept = near_copies.one_of_each(make([(i, t, "en", "a") for i, t in texts.items()]))
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(exact_groups(texts).values()))


def test_pairs_inside_a_template_family(make):
    rng, rows = random.Random(8), []
    template = prose(rng, 160)
    for _ in range(1000):
        rows.append(" ".join(template + prose(rng, 40)))  # likeness of two: 0.64
    planted = [(i, 1000 + n) for n, i in enumerate(range(0, 1000, 10))]
    for i, _ in planted:
        rows.append(" ".join(template + edited(rng, rows[i].split()[160:], 4)))  # 0.8 or more to its pair only
    texts = dict(enumerate(rows))
    got = {r.doc_id: r.component_id for r in near_copies.near_copies(make([(i, t, "en", "a") for i, t in texts.items()])).collect()}
    assert [got[b] for _, b in planted] == [a for a, _ in planted]
    assert len(set(got.values())) == 1000


def test_odd(odd):
    got = sorted(((r.doc_id, r.component_id) for r in near_copies.near_copies(odd).collect()), key=str)
    empty, prose_group = 1, 4
    want = [(1, empty), (2, empty), (3, empty), (None, empty), (4, prose_group), (4, prose_group), (5, prose_group)]
    assert all(got.count(w) >= want.count(w) for w in want) and len(got) == odd.count()
    kept = near_copies.one_of_each(odd)
    assert kept.columns == odd.columns and sorted((r.doc_id for r in kept.collect()), key=str) == sorted([1, 4, 4, 6, 7, 8, 9, 10, None], key=str)
    assert near_copies.near_copies(odd.limit(0)).count() == 0


def test_keys_meet_at_two_bits():
    rng = np.random.default_rng(3)
    anchors = np.zeros((1, near_copies.SEGMENTS), np.uint64)
    for _ in range(50):
        bits = rng.integers(0, 2, 256).astype(np.uint8)
        other = bits.copy()
        for segment in range(near_copies.SEGMENTS):  # three errors everywhere but in one segment, two there
            other[23 * segment + rng.choice(23, 2 if segment == 4 else 3, replace=False)] ^= 1
        a, b = (near_copies.keys(np.packbits(x).view(np.uint64)[None, :], anchors)[0] for x in (bits, other))
        assert set(a.tolist()) & set(b.tolist())


def test_shingles_of_all_texts_are_counted(spark, monkeypatch):
    """A shingle that all texts share comes last in every one of them, however many texts there are."""
    monkeypatch.setattr(near_copies, "_COUNTED", 1, raising=False)  # a part was counted from so many texts on
    rows = [(i, 1, " ".join(["shared"] + [f"w{i}x{j}" for j in range(10)])) for i in range(12)]
    made = near_copies.prefixes(spark.createDataFrame(rows, "node bigint, weight bigint, text string"), 1, 0.8).collect()
    shared = near_copies.shingles("shared", 1).view(np.int64)[0]
    assert len(made) == 12 * 3 and shared not in {r.key for r in made}


def test_members_of_a_family_are_compared_once_and_only_if_they_can_be_near(make, monkeypatch):
    """Copies of one text with edits of their own share many rare keys without being near to each other."""
    rng, rows, seen = random.Random(11), [], []
    base = prose(rng, 150)
    rows += [" ".join(edited(rng, base, 4)) for _ in range(60)]
    near = [" ".join(edited(rng, rows[i].split(), 1)) for i in range(0, 60, 12)]
    texts = dict(enumerate(rows + near))
    close = near_copies.close
    monkeypatch.setattr(near_copies, "close", lambda pairs, prints: seen.append(pairs.count()) or close(pairs, prints))
    made = near_copies.near_copies(make([(i, t, "en", "a") for i, t in texts.items()]), pair_limit=4).collect()
    assert {r.doc_id: r.component_id for r in made} == exact_groups(texts)
    assert seen[-1] < 300  # across components of large keys; of 2,080 pairs


def test_marks(spark):
    """All hashes asked for are found, few others are; nulls count for nothing."""
    values = [0, 1, -1, 63, 64, 2**63 - 1, -(2**63), *range(10**12, 10**15, 10**12)]
    asked = spark.createDataFrame([(v,) for v in [*values, None]], "mark bigint")
    test = common.marks(asked)
    assert asked.filter("mark IS NOT NULL").filter(test(F.col("mark"))).count() == len(values)
    others = spark.range(100_000).select(F.xxhash64("id").alias("mark"))
    assert others.filter(test(F.col("mark"))).count() < 50
    assert others.filter(common.marks(asked.limit(0))(F.col("mark"))).count() == 0
