"""The learned operators' arithmetic against plain definitions: all pairs,
enumeration of label sequences, differences of the loss, ids of the tokenizer."""

import itertools
import zlib

import numpy as np
import pytest

from renalyze.llm import bpe, langid, packing, quality, toxicity


# --- factorisation machine ----------------------------------------------------

def plain_score(m, idx, x):
    pairs = sum(float(m.v[i] @ m.v[j]) * a * b for (i, a), (j, b) in itertools.combinations(zip(idx, x), 2))
    return m.w0 + sum(m.w[i] * a for i, a in zip(idx, x)) + pairs


def test_machine_equals_the_sum_over_all_pairs():
    rng = np.random.default_rng(1)
    m = quality.FactorisationMachine(0.3, rng.normal(size=40), rng.normal(size=(40, quality.FACTORS)))
    rows = [(rng.choice(40, n, replace=False), rng.normal(size=n)) for n in (1, 2, 7, 20)]
    want = [plain_score(m, *r) for r in rows]
    assert [m.score(*r) for r in rows] == pytest.approx(want)
    idx, x = (np.concatenate(z) for z in zip(*rows))
    got, _ = m._scores(idx, x, np.repeat(np.arange(4), [len(r[0]) for r in rows]), 4)
    assert got == pytest.approx(want)


def test_machine_learns_an_interaction_no_single_word_shows():
    """Label 1 where exactly one of two words occurs: linear weights alone cannot tell."""
    rng = np.random.default_rng(2)
    rows, labels = [], []
    for _ in range(1200):
        a, b = rng.integers(0, 2, 2)
        idx = np.array([0] * a + [1] * b + [2 + int(rng.integers(0, 5))])
        rows.append((idx, np.ones(len(idx))))
        labels.append(int(a != b))
    m = quality.FactorisationMachine.fit(rows, labels, dim=8)
    assert np.mean([(m.score(*r) > 0) == y for r, y in zip(rows, labels)]) > 0.95


def test_quality_inputs():
    for t in ("", " ", "One two two\nthree!", "é 日本 " * 50):
        idx, x = quality.inputs(t)
        assert len(idx) == len(set(idx.tolist())) and (idx < quality.DIM).all() and np.isfinite(x).all()
        i, y = quality.unpack(quality.packed_inputs(t))
        assert (i == idx).all() and (y == x).all()


# --- conditional random field ---------------------------------------------------

def enumerate_chain(scores, start, move):
    """Label probabilities and pair sums of one chain, over all label sequences."""
    n, k = scores.shape
    p, pairs, total = np.zeros((n, k)), np.zeros((k, k)), 0.0
    for ys in itertools.product(range(k), repeat=n):
        z = np.exp(start[ys[0]] + sum(scores[i, y] for i, y in enumerate(ys)) + sum(move[a, b] for a, b in zip(ys, ys[1:])))
        total += z
        for i, y in enumerate(ys):
            p[i, y] += z
        for a, b in zip(ys, ys[1:]):
            pairs[a, b] += z
    return p / total, pairs / total


def test_forward_backward_equals_enumeration():
    rng = np.random.default_rng(3)
    lengths = np.array([4, 1, 6, 0, 5])
    chain, place, n = langid.chains(lengths, most=3)
    scores, start, move = rng.normal(size=(lengths.sum(), 3)), rng.normal(size=3), rng.normal(size=(3, 3))
    p, pairs = langid.forward_backward(scores, chain, place, n, start, move, True)
    want_pairs = np.zeros((3, 3))
    for c in range(n):
        own = np.flatnonzero(chain == c)
        want, more = enumerate_chain(scores[own], start, move)
        assert p[own] == pytest.approx(want)
        want_pairs += more
    assert pairs == pytest.approx(want_pairs)


def test_words_of_a_mixed_text_follow_their_neighbours():
    """Forward-backward labels the words of a text that switches language."""
    rng = np.random.default_rng(4)
    vocab = {0: [f"{a}lund" for a in "abcdefgh"], 1: [f"{a}zzio" for a in "abcdefgh"]}
    docs, labels = [], []
    for k in range(60):
        docs.append([vocab[k % 2][i] for i in rng.integers(0, 8, 12)])
        labels.append(k % 2)
    m = langid.fit(["north", "south"], docs, labels)
    words, gold = langid.code_switched(docs, labels, 0.5)
    assert words and all(len(w) == len(g) and len(set(g)) == 2 for w, g in zip(words, gold))
    mixed = vocab[0][:5] + ["xx"] + vocab[1][:5]
    chain, place, n = langid.chains(np.array([len(mixed)]))
    p, _ = langid.forward_backward(m.word_scores(mixed), chain, place, n, m.start, m.move)
    assert p.argmax(1).tolist()[:5] == [0] * 5 and p.argmax(1).tolist()[6:] == [1] * 5
    assert m.move[0, 0] > m.move[0, 1] and m.move[1, 1] > m.move[1, 0]
    alone = langid.fit(["north", "south"], docs, labels, 0.0)
    assert m.move[0, 1] - m.move[0, 0] > alone.move[0, 1] - alone.move[0, 0]        # a switch has been seen


def test_spans_of_a_text_that_switches(spark):
    docs = [[w] * 4 for w in ("alund", "blund", "clund", "azzio", "bzzio", "czzio")] * 8
    m = langid.fit(["north", "south"], docs, [0, 0, 0, 1, 1, 1] * 8)
    rows = [(1, "alund blund 12 clund azzio ! bzzio czzio"), (2, None), (3, ""), (4, "12 !"), (None, "azzio"), (5, "alund " * 200)]
    got = sorted(map(tuple, langid.word_spans(spark.createDataFrame(rows, "doc_id bigint, text string"), m).select("doc_id", "first", "words", "lang").collect()), key=str)
    assert got == sorted([(1, 0, 3, "north"), (1, 4, 3, "south"), (None, 0, 1, "south"), (5, 0, 200, "north")], key=str)
    assert langid.word_spans(spark.createDataFrame([], "doc_id bigint, text string"), m).count() == 0


# --- cumulative links -------------------------------------------------------------

def test_ordinal_probabilities_and_gradient():
    """P(grade >= k) falls with k, severity is their sum, and the gradient is the loss's difference quotient."""
    rng = np.random.default_rng(5)
    t = np.array([0.4, 1.1, 2.0])
    m = toxicity.OrdinalModel({}, {}, np.zeros(4), t)
    x, target = rng.integers(0, 2, (30, 4)).astype(float), (rng.integers(0, 4, 30)[:, None] >= np.arange(1, 4)).astype(float)

    def loss(w):
        p = m.exceed(x @ w)
        return -(target * np.log(p) + (1 - target) * np.log(1 - p)).sum() / len(x)

    w = rng.normal(size=4)
    p = m.exceed(x @ w)
    assert (np.diff(p, axis=1) < 0).all()
    grades = np.concatenate([1 - p[:, :1], p[:, :-1] - p[:, 1:], p[:, -1:]], 1)
    assert grades.sum(1) == pytest.approx(1) and (grades @ np.arange(4)) == pytest.approx(p.sum(1))
    grad = x.T @ ((p - target) / len(x)).sum(1)
    for k in range(4):
        d = np.zeros(4)
        d[k] = 1e-6
        assert grad[k] == pytest.approx((loss(w + d) - loss(w - d)) / 2e-6, rel=1e-4, abs=1e-7)


def test_toxicity_separates_and_orders():
    bad, rng = ["zurk", "blatt", "vrell"], np.random.default_rng(6)
    texts = [" ".join(f"w{i}" for i in rng.integers(0, 300, 20)) for _ in range(150)]
    toxic = np.array([0] * 90 + [1] * 60)
    for k in range(90, 150):
        texts[k] += " " + " ".join(bad[:1 + k % 3])
    rows = [np.frombuffer(toxicity.packed_inputs(t), "<i4").reshape(-1, 2).astype(np.int64) for t in texts]
    m = toxicity.fit(rows, toxic)
    p = m.exceed(m.scores(texts))
    assert ((p[:, 0] >= toxicity.REJECT) == (toxic == 1)).mean() > 0.98
    held = ["calm words only", "some zurk here", "zurk and blatt here", "zurk blatt vrell here"]
    s = m.exceed(m.scores(held)).sum(1)
    assert s[0] < s[1] and s[1] <= s[2] <= s[3]
    assert np.isfinite(m.scores(["", " ", "\x00"])).all()


# --- packing ------------------------------------------------------------------------

def test_packed_pieces_are_the_tokenizers_ids(spark):
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(bpe.vocabulary_path())
    texts = [None, "", "one", "two  words\n", "é日本 <|endoftext|> don't " * 40] + [f"document {k} " * (7 * k) for k in range(1, 12)]
    docs = spark.createDataFrame([(k, x) for k, x in enumerate(texts)], "doc_id bigint, text string")
    got = packing.pack_documents(docs, window=64).collect()
    for k, x in enumerate(texts):
        ids = t.encode(x or "", add_special_tokens=False).ids + [1]
        own = sorted((p.start, p.length, p.ids_crc32, p.doc_tokens) for p in got if p.doc_id == k)
        assert [s for s, *_ in own] == [sum(n for _, n, *_ in own[:i]) for i in range(len(own))]
        assert sum(n for _, n, *_ in own) == len(ids)
        for s, n, crc, total in own:
            assert total == len(ids) and crc == zlib.crc32(np.array(ids[s:s + n], "<u4").tobytes())
