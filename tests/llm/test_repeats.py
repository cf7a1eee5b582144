import time

import numpy as np
import pyarrow as pa
import pytest

from seriesmill.llm import repeats


def contexts(rng, n, length, most, letters=3):
    """Strings that share parts around an anchor, with the anchor's place in each, documents and bases."""
    gram = bytes(rng.integers(0, 256, repeats.GRAM, np.uint8))
    pool = [bytes(rng.integers(0, letters, 2 * length, np.uint8)) for _ in range(3)]
    strings, places = [], []
    for _ in range(n):
        a, b = rng.integers(0, len(pool), 2)
        left, right = rng.integers(0, most + 1), rng.integers(0, length - len(gram) + 1)
        noise = lambda k: bytes(rng.integers(0, letters, k, np.uint8))
        same_left, same_right = rng.integers(0, left + 1), rng.integers(0, right + 1)
        before = noise(left - same_left) + pool[a][len(pool[a]) - same_left :]
        strings.append(before + gram + pool[b][:same_right] + noise(right - same_right))
        places.append(left)
    return strings, np.array(places), rng.integers(0, n // 2 + 1, n), rng.integers(0, 1000, n)


def brute(strings, places, doc, base, length):
    """Covered bytes of every string: windows equal at equal places from the anchor, all but the earliest."""
    first, hit = {}, [np.zeros(len(s), bool) for s in strings]
    windows = [(i, k) for i, s in enumerate(strings) for k in range(len(s) - length + 1)]
    name = lambda i, k: (k - places[i], strings[i][k : k + length])
    for i, k in windows:
        place = (doc[i], base[i] + k)
        first[name(i, k)] = min(first.get(name(i, k), place), place)
    for i, k in windows:
        if (doc[i], base[i] + k) > first[name(i, k)]:
            hit[i][k : k + length] = True
    return hit


@pytest.mark.parametrize("seed", range(12))
def test_later_runs_at_anchors(seed):
    rng = np.random.default_rng(seed)
    length, most = [(40, 16), (30, 6), (26, 40)][seed % 3]
    strings, places, doc, base = contexts(rng, [0, 1, 2, 30, 80, 300][seed % 6], length, most, letters=[1, 2, 4][seed % 3])
    got = [np.zeros(len(s), bool) for s in strings]
    for i, start, end in zip(*repeats.later_runs(strings, doc, base, length, places)):
        got[i][start:end] = True
    assert all((a == b).all() for a, b in zip(got, brute(strings, places, doc, base, length)))


@pytest.mark.parametrize("limit", [1, 50, 1 << 19])
def test_repeats_at_once(limit):
    rng = np.random.default_rng(5)
    strings, places, _, _ = contexts(rng, 60, 40, 16)
    for anchors in (None, places):
        tree = repeats.SuffixArray(strings, 30, anchors)
        one_by_one = [(n, p.tolist()) for n, p in tree.maximal_repeats(30)]
        together = []
        for size, many, found in tree.repeats_at_once(30, limit):
            together += zip(size.tolist(), [p.tolist() for p in np.split(found, np.cumsum(many)[:-1])])
        assert together == one_by_one and len(one_by_one) > 5


def test_only_suffixes_with_a_partner_are_listed():
    """Contexts that are equal for less than ``length`` bytes cost no sorting of all their suffixes."""
    rng = np.random.default_rng(6)
    gram = bytes(rng.integers(0, 256, repeats.GRAM, np.uint8))
    noise = lambda n: bytes(rng.integers(0, 256, n, np.uint8))
    strings = [noise(76) + gram + noise(76) for _ in range(200)]
    strings[7] = noise(10) + strings[3][10:150] + noise(26)
    tree = repeats.SuffixArray(strings, 100, np.full(200, 76))
    assert len(tree.suffixes) == 2 * 41 and [n for n, _ in tree.maximal_repeats(100)] == [140]


def test_trees_of_contexts_take_a_fraction_of_the_time():
    """The rows that stage 3 gets, next to suffix arrays over all bytes of the same contexts."""
    rng = np.random.default_rng(7)
    strings, left, doc, base = [], [], [], []
    for g in range(300):
        gram, shared = (bytes(rng.integers(97, 123, n, np.uint8)) for n in (repeats.GRAM, 152))
        for d in range(8):
            own = bytes(rng.integers(97, 123, 152, np.uint8))
            a, b = rng.integers(0, 76, 2)
            strings.append(own[:a] + shared[a:76] + gram + shared[76 : 152 - b] + own[152 - b :])
            left.append(76), doc.append(d), base.append(1000 * g)
    doc, base, n = np.array(doc), np.array(base), len(strings)
    rows = pa.RecordBatch.from_arrays(
        [pa.array(np.repeat(np.arange(n // 8), 8)), pa.array(left, pa.int32()), pa.array(strings, pa.binary()), pa.array(doc, pa.int64()),
         pa.array(np.zeros(n, np.int32)), pa.array(base + 76, pa.int32())], ["gram", "left", "context", "ord", "var", "pos"],
    )

    def timed(work):
        start = time.process_time()
        return work(), time.process_time() - start

    def covered(pairs):
        return {(i, b) for i, start, end in pairs for b in range(start, end)}

    out, fast = min((timed(lambda: list(repeats._tree_runs(100)(iter([rows])))) for _ in range(3)), key=lambda r: r[1])
    (owner, start, end), slow = timed(lambda: repeats.later_runs(strings, doc, base, 100))
    got = covered(zip(*(np.concatenate([b.column(c).to_numpy() for b in out]).tolist() for c in ("ord", "start", "end"))))
    want = covered(zip(doc[owner].tolist(), (base[owner] + start).tolist(), (base[owner] + end).tolist()))
    assert got == want and fast < slow / 3, (fast, slow)
