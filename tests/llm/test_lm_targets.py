"""Training targets of the language model, and words that share an id."""

import numpy as np

from seriesmill.llm import lm


def test_every_word_is_predicted_once():
    doc = np.repeat(np.arange(7), [1, 9, 2, 16, 1, 3, 8])
    places = np.concatenate([lm.targets(doc, turn, lm.STRIDE) for turn in range(lm.ROUNDS)])
    assert sorted(places.tolist()) == list(range(len(doc)))
    assert set(doc[lm.targets(doc, 0, lm.STRIDE)].tolist()) == set(range(7))


def test_words_of_a_shared_id_have_their_own_probability(make):
    words = [f"w{i}" for i in range(3000)]
    rows = [(i, " ".join(words[i % 50 :: 50]), "en", "a") for i in range(200)] + [(200, " ".join(words[:900]) + " once", "en", "a")]
    docs = make(rows)
    counts = lm.word_counts(docs)
    net = lm.Network.fresh(lm.vocabulary(docs, counts=counts))
    seen = {r.word: r.n for r in counts.collect()}
    assert sum(seen.values()) == sum(len(r[1].split()) for r in rows)
    kinds = counts.select("word").union(docs.sparkSession.createDataFrame([(k,) for k in range(512)], "word bigint"))
    kinds = kinds.filter(~kinds["word"].isin([int(w) for w in net.words.view(np.int64)]))
    got = {r.word: r.share for r in lm.shares(kinds, net, counts).collect()}
    for ident in range(lm.SHARED):
        known = [np.exp(s) for w, s in got.items() if w in seen and w & 255 == ident]
        assert abs(sum(known) + np.exp(got[ident]) - 1) < 1e-9  # ids 0 to 511 stand for unseen words
        assert not known or np.exp(got[ident]) < min(known)
    plain, whole = ({r.doc_id: r.log_likelihood for r in lm.score_documents(docs, net, counts=c).collect()} for c in (None, counts))
    assert len(whole) == len(rows) and all(whole[i] < plain[i] for i in plain)


def _word_by_word(net, token, around, at):
    """Logits of class and word, and their loss, of one word by the definition."""
    h = np.append(np.tanh(sum(net.around[side][around[at, side]].astype(float) for side in range(len(lm.SIDES)))), 1.0)
    kind, place = token[at] % lm.CLASSES, token[at] // lm.CLASSES
    a, b = h @ net.to_class, h @ net.to_word[kind]
    return a[kind] - np.log(np.exp(a).sum()) + b[place] - np.log(np.exp(b).sum())


def _some_words(n=700, skew=True):
    rng = np.random.default_rng(3)
    token = rng.integers(0, lm.CLASSES * lm.PER_CLASS, n)
    if skew:  # a third of all words is one word, some classes are empty
        token[rng.random(n) < 0.3] = 5
        token = token - (token % lm.CLASSES > 20) * 12
    net = lm.Network.fresh(np.arange(1, 700, dtype=np.uint64))
    return net.with_weights(net.flat() * 8), token, lm.contexts(token, np.sort(rng.integers(0, 30, n)))


def test_log_probabilities_word_by_word():
    for n in (1, 2, 700):
        net, token, around = _some_words(n)
        want = [_word_by_word(net, token, around, i) for i in range(n)]
        assert np.allclose(net.log_probabilities(around, token), want, atol=1e-4)


def test_a_step_goes_along_the_gradient():
    net, token, around = _some_words(60)
    after = net.with_weights(net.flat())
    after.step(around, token, 1.0)
    rates = {"to_class": 1, "to_word": 4, "around": 8}
    rng = np.random.default_rng(1)
    for name, rate in rates.items():
        before, moved = getattr(net, name), getattr(after, name) - getattr(net, name)
        places = np.flatnonzero(np.abs(moved).ravel() > 1e-4)
        for place in [*rng.choice(places, 8), *rng.choice(before.size, 2)]:
            losses = []
            for sign in (1, -1):
                other = net.with_weights(net.flat())
                getattr(other, name).reshape(-1)[place] += sign * 1e-2
                losses.append(sum(_word_by_word(other, token, around, i) for i in range(60)) / 60)
            assert abs((losses[0] - losses[1]) / 2e-2 * rate - moved.ravel()[place]) < 3e-3 * rate


def test_rare_words_of_texts(make):
    texts = ["", None, "a b a zz", "q", " ", "zz zz zz b"]
    docs = make([(i, t, "en", "a") for i, t in enumerate(texts)])
    net = lm.Network.fresh(np.zeros(0, np.uint64))
    rows = docs.select("doc_id", lm.scored(docs["text"], docs.sparkSession.sparkContext.broadcast(net)).alias("s")).collect()
    got = {r.doc_id: (r.s.n_tokens, sorted(r.s.times), len(set(r.s.rare))) for r in rows}
    assert got == {0: (0, [], 0), 1: (0, [], 0), 2: (4, [1, 1, 2], 3), 3: (1, [1], 1), 4: (0, [], 0), 5: (4, [1, 3], 2)}
