"""Language identification: a linear-chain conditional random field.

Words are labelled one by one, so code-switched text gets the language of
each of its parts.  A word's features are its beginnings and endings (1 to 3
letters), its letter 2- and 3-grams and the word itself (lexicon), hashed;
the label scores are sums of learned weights, neighbouring labels are tied by
learned transitions, and forward-backward gives every word's label
probabilities.  A document's score for a language is the mean over its words.

A chain is a run of at most ``CHAIN`` words of one document.  Chains of a
batch are stacked, so each forward or backward step is one small matrix
product over all of them; label scores are computed once for each distinct
token of a batch.  It is fitted by full-batch AdaGrad on a
bounded sample (``MAX_TRAIN`` documents, shared out by lang so that a rare one is
learned too; every word carries its document's lang).

Defined cases: null text or text without a letter is ``und`` with score 0; a
document with null lang or doc_id is never learned from; without training
documents every language is ``und``; ties go to the first language in
alphabetical order; lang, source and doc_id are no inputs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_rest
from .learning import collect_features, sample_of_each, segments

MAX_TRAIN = 800                  # documents used for fitting, at most
BITS = 16
CHAIN = 64
STEPS, RATE, L2 = 25, 0.5, 2e-6
SWITCHED = 0.1                   # code-switched chains made from the sample, per document
UNKNOWN = "und"


def letters_of(token: str) -> str:
    return token.lower() if token.isalpha() else "".join(filter(str.isalpha, token)).lower()


def _mix(h: np.ndarray, salt: int) -> np.ndarray:
    h = (h ^ np.uint32(salt * 0x9E3779B1 & 0xFFFFFFFF)) * np.uint32(0x85EBCA77)
    h ^= h >> np.uint32(15)
    return (h * np.uint32(0xC2B2AE3D)) >> np.uint32(32 - BITS)


def word_features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(word number, feature number) pairs of some words (letters only, none empty)."""
    c = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
    n = np.array([len(w) for w in words], np.int64)
    first = np.cumsum(n) - n
    word = np.repeat(np.arange(len(n)), n)
    place = np.arange(len(c)) - first[word]
    rest = n[word] - place                                  # letters from here to the word's end
    power = np.cumprod(np.full(int(n.max(initial=1)), 0x01000193, np.uint32), dtype=np.uint32)
    of, found = [np.arange(len(n))], [_mix(np.add.reduceat(c * power[place], first, dtype=np.uint32), 1)]
    gram = np.zeros(len(c), np.uint32)
    for k in (1, 2, 3):
        gram = gram * np.uint32(0x01000193) + np.concatenate([c[k - 1:], np.zeros(k - 1, np.uint32)])
        for salt, where in ((10 * k, (place == 0) & (rest >= k)), (10 * k + 1, rest == k), (10 * k + 2, (rest >= k) & (k > 1))):
            of.append(word[where])
            found.append(_mix(gram[where], salt))
    return np.concatenate(of), np.concatenate(found).astype(np.int64)


class Crf:
    def __init__(self, langs: list[str], weights: np.ndarray, start: np.ndarray, move: np.ndarray):
        self.langs, self.weights, self.start, self.move = langs, weights, start, move

    def word_scores(self, words: list[str]) -> np.ndarray:
        """(words, labels): sums of the words' feature weights."""
        of, feature = word_features(words)
        return np.stack([np.bincount(of, w[feature], len(words)) for w in self.weights.T], 1)


def chains(lengths: np.ndarray, most: int = CHAIN) -> tuple[np.ndarray, np.ndarray, int]:
    """(chain, place) of every word of documents with these numbers of words
    laid end to end, and the number of chains."""
    n = np.maximum(0, -(-lengths // most))
    place = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    return np.repeat(np.cumsum(n) - n, lengths) + place // most, place % most, int(n.sum())


def forward_backward(scores: np.ndarray, chain: np.ndarray, place: np.ndarray, n: int, start: np.ndarray, move: np.ndarray,
                     with_pairs: bool = False):
    """Label probabilities of every word, and the sum of the pair probabilities
    of neighbours (labels x labels) if asked for.  Longer chains come first, so a
    step works on the leading rows only."""
    k, kind = scores.shape[1], scores.dtype
    size = np.bincount(chain, minlength=n)
    order = np.argsort(-size, kind="stable")
    row = np.empty(n, np.int64)
    row[order] = np.arange(n)
    row = row[chain]
    alive = np.bincount(place, minlength=1)                 # chains that reach each place
    e = np.exp(scores - scores.max(1, keepdims=True))
    steps = [np.empty((m, k), kind) for m in alive.tolist()]
    by_place = np.lexsort((row, place))
    ends = np.cumsum(alive)
    for i, m in enumerate(alive.tolist()):
        steps[i][:] = e[by_place[ends[i] - m:ends[i]]]
    t, first = np.exp(move).astype(kind), np.exp(start - start.max()).astype(kind)
    alpha: list[np.ndarray] = []
    for i, x in enumerate(steps):
        a = first * x if i == 0 else (alpha[i - 1][:len(x)] @ t) * x
        alpha.append(a / a.sum(1, keepdims=True))
    p = np.empty_like(e)
    pairs = np.zeros((k, k))
    beta = np.ones((len(steps[-1]), k), kind)
    for i in range(len(steps) - 1, -1, -1):
        if i + 1 < len(steps):
            ahead = steps[i + 1] * beta
            b = ahead @ t.T
            if with_pairs:
                left = alpha[i][:len(b)]
                pairs += t * ((left / (left * b).sum(1, keepdims=True)).T @ ahead)
            beta = np.ones((len(steps[i]), k), kind)
            beta[:len(b)] = b / b.sum(1, keepdims=True)
        q = alpha[i] * beta
        p[by_place[ends[i] - len(q):ends[i]]] = q / q.sum(1, keepdims=True)
    return p, pairs


def code_switched(docs: list[list[str]], labels: list[int], share: float = SWITCHED) -> tuple[list[list[str]], list[np.ndarray]]:
    """Chains that begin in one document and go on in one of another language,
    with the language of every word: a document of one language never shows a switch."""
    rng = np.random.default_rng(5)
    half, words, gold = CHAIN // 2, [], []
    for _ in range(int(share * len(docs)) if len(set(labels)) > 1 else 0):
        i, j = rng.integers(0, len(docs), 2)
        if labels[i] != labels[j]:
            a, b = docs[i][:half], docs[j][:half]
            words.append(a + b)
            gold.append(np.repeat([labels[i], labels[j]], [len(a), len(b)]))
    return words, gold


def fit(langs: list[str], docs: list[list[str]], labels: list[int], share: float = SWITCHED) -> Crf:
    """docs: their words (letters only), labels: places in ``langs``."""
    k = len(langs)
    m = Crf(langs, np.zeros((1 << BITS, k)), np.zeros(k), np.zeros((k, k)))
    words = sorted({w for d in docs for w in d})
    if not words:
        return m
    at = {w: i for i, w in enumerate(words)}
    of, flat = word_features(words)
    mixed, languages = code_switched(docs, labels, share)
    gold = np.concatenate([np.repeat(np.array(labels), [len(d) for d in docs]), *languages])
    docs = [*docs, *mixed]
    lengths = np.array([len(d) for d in docs])
    ids = np.array([at[w] for d in docs for w in d])
    chain, place, n = chains(lengths)
    seen = np.bincount(ids * k + gold, minlength=len(words) * k).reshape(-1, k)
    first = np.bincount(gold[place == 0], minlength=k)
    inner = np.flatnonzero(place > 0)
    moves = np.bincount(gold[inner - 1] * k + gold[inner], minlength=k * k).reshape(k, k).astype(float)
    total = len(ids)
    sums = [np.full(m.weights.shape, 1e-10), np.full(k, 1e-10), np.full((k, k), 1e-10)]
    for _ in range(STEPS):
        scores = np.stack([np.bincount(of, c[flat], len(words)) for c in m.weights.T], 1)
        p, pairs = forward_backward(scores[ids], chain, place, n, m.start, m.move, True)
        expected = np.stack([np.bincount(ids, c, len(words)) for c in p.T], 1)
        d = (expected - seen) / total
        grads = [np.stack([np.bincount(flat, c[of], 1 << BITS) for c in d.T], 1) + L2 * m.weights,
                 (p[place == 0].sum(0) - first) / total, (pairs - moves) / total + 1e-3 * m.move]
        for x, g, s in zip((m.weights, m.start, m.move), grads, sums):
            s += g * g
            x -= RATE * g / np.sqrt(s)
    return m


def train(docs: DataFrame, max_train: int = MAX_TRAIN) -> Crf:
    """Fitted on documents with a lang whose crc32(doc_id) modulo 5 is not 0."""
    keys = (docs.where((crc_rest(F.col("doc_id"), 5, 0) != 0) & F.col("text").isNotNull())
                .select("doc_id", F.col("lang").alias("label")))
    pack = lambda t: " ".join(w for w in map(letters_of, t.split()) if w).encode()
    rows = collect_features(sample_of_each(keys, docs, max_train), pack)
    langs = sorted({y for y, _ in rows})
    return fit(langs, [x.decode().split() for _, x in rows], [langs.index(y) for y, _ in rows])


def _posteriors(texts: list[str | None], model: Crf) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """(numbers of words, their places among the white-space tokens of each
    text, label probabilities of all words) of some texts."""
    split = [(t or "").split() for t in texts]
    words, number = [], {}                                                   # 0: no word
    for t in set().union(*split):
        if w := letters_of(t):
            words.append(w)
        number[t] = len(words) if w else 0
    ids = [np.fromiter(map(number.__getitem__, x), np.int64, len(x)) for x in split]
    places = [np.flatnonzero(x) for x in ids]
    ids = [x[x != 0] for x in ids]
    lengths = np.array([len(x) for x in ids], np.int64)
    if not model.langs or not lengths.sum():
        return lengths, places, np.zeros((lengths.sum(), max(1, len(model.langs))))
    scores = model.word_scores(words).astype(np.float32)[np.concatenate(ids) - 1]
    chain, place, n = chains(lengths)
    return lengths, places, forward_backward(scores, chain, place, n, model.start, model.move)[0]


def word_spans(docs: DataFrame, model: Crf) -> DataFrame:
    """(doc_id, first, words, lang, score): the runs of a text's words that are
    most likely in one language, ``first`` counted in white-space tokens; ``score`` is the
    mean probability of its words.  Tokens without letters belong to no run but
    do not end one; a null text has none."""
    model = Crf(model.langs, model.weights.astype(np.float32), model.start, model.move)

    def run(batches):
        for b in batches:
            lengths, places, p = _posteriors(b.column("text").to_pylist(), model)
            out: list[tuple] = []
            at = 0
            for k, (n, place) in enumerate(zip(lengths.tolist(), places)):
                own = p[at:at + n]
                at += n
                if not n or not model.langs:
                    continue
                best = own.argmax(1)
                cuts = np.flatnonzero(np.r_[True, best[1:] != best[:-1], True])
                out += [(k, int(place[x]), int(y - x), model.langs[best[x]], float(own[x:y, best[x]].mean())) for x, y in zip(cuts, cuts[1:])]
            cols = list(zip(*out)) if out else [[]] * 5
            yield pa.record_batch([b.column("doc_id").take(pa.array(cols[0], pa.int64())), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64()),
                                   pa.array(cols[3], pa.string()), pa.array(cols[4], pa.float64())], names=["doc_id", "first", "words", "lang", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, first bigint, words bigint, lang string, score double")


def predict_language(docs: DataFrame, model: Crf) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row."""
    model = Crf(model.langs, model.weights.astype(np.float32), model.start, model.move)
    k = len(model.langs)

    def run(batches):
        for b in batches:
            lengths, _, p = _posteriors(b.column("text").to_pylist(), model)
            prob = np.zeros((len(lengths), max(1, k)))
            if k and lengths.sum():
                doc = segments(lengths.tolist())
                prob = np.stack([np.bincount(doc, c, len(lengths)) for c in p.T], 1) / np.maximum(1, lengths)[:, None]
            best = prob.argmax(1)
            some = (lengths > 0) & (k > 0)
            yield pa.record_batch([b.column("doc_id"), b.column("held_out"),
                                   pa.array([model.langs[i] if s else UNKNOWN for i, s in zip(best.tolist(), some.tolist())], pa.string()),
                                   pa.array(np.where(some, np.clip(prob.max(1), 0.0, 1.0), 0.0))],
                                  names=["doc_id", "held_out", "lang_pred", "score"])

    src = docs.select("doc_id", (crc_rest(F.col("doc_id"), 5, 0) == 0).alias("held_out"), "text")
    return src.mapInArrow(run, f"doc_id {src.schema['doc_id'].dataType.simpleString()}, held_out boolean, lang_pred string, score double")
