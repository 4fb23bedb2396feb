"""Toxicity: cumulative-link ordinal regression over sparse text features.

P(grade >= k) = sigmoid(w.x - t_k) with one weight vector for all thresholds
t_1 < t_2 < t_3; the score is P(grade >= 1) and the severity the expected grade
(the sum of P(grade >= k)).

Inputs: presence of hashed words and of word beginnings.  A feature is used
when it is over-represented in the toxic documents of the sample (chi-square
over ``CHI2``, in ``MIN_SHARE`` of them, ``LIFT`` times as often as elsewhere);
all others weigh nothing, so length alone raises no score.

The labels say toxic or not.  Grades are 0 for rows not marked, and 1 to 3
for marked rows by the terciles of the number of used words they hold.

Defined cases: null text is empty; a null doc_id is held out; without toxic
labels every document has score 0; labels, lang, source and doc_id are no inputs.
"""

from __future__ import annotations

import re
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_rest
from .learning import WordTable, collect_features, labelled_sample, segments, sigmoid

MAX_TRAIN = 8000                 # labelled rows used for fitting, at most
BITS = 24                        # of a feature's hash
PREFIX = 4
CHI2 = 20.0
MIN_SHARE, MIN_SEEN = 0.02, 3    # of the toxic sample rows that a used feature is in, at least
LIFT = 8                         # and its rate there against the others
GRADES = 3
STEPS, RATE, L2 = 400, 1.0, 1e-5
REJECT = 0.5                     # a document with this score or more is rejected

_WORD = re.compile(r"[^\W\d_]+")


def _feature(kind: str, s: str) -> int:
    return zlib.crc32((kind + s).encode()) & ((1 << BITS) - 1)


def _features(token: str) -> list[tuple[int, int]]:
    """(word feature, beginning feature) of each word in a white-space token."""
    return [(_feature("w", w), _feature("p", w[:PREFIX])) for w in _WORD.findall(token.lower())]


@lru_cache(maxsize=1)
def _tokens() -> WordTable:
    return WordTable(_features)


def packed_inputs(text: str) -> bytes:
    """All (word, beginning) features of a text, one a word occurrence."""
    table = _tokens()
    pairs = [p for t in text.split() for p in table[t]]
    return np.array(pairs, "<i4").reshape(-1, 2).tobytes()


class OrdinalModel:
    def __init__(self, words: dict[int, int], begins: dict[int, int], weights: np.ndarray, thresholds: np.ndarray):
        """words, begins: feature -> column."""
        self.words, self.begins, self.weights, self.thresholds = words, begins, weights, thresholds

    def columns(self, words, begins) -> list[int]:
        """Columns of a document's distinct words and beginnings."""
        return [self.words[w] for w in words if w in self.words] + [self.begins[b] for b in begins if b in self.begins]

    def exceed(self, z: np.ndarray) -> np.ndarray:
        """(n, GRADES): P(grade >= k)."""
        return sigmoid(z[:, None] - self.thresholds[None, :])

    def scores(self, texts: list[str]) -> np.ndarray:
        """w.x of each text; the distinct tokens of all are looked up once."""
        split = [t.split() for t in texts]
        hits = {}
        for token in set().union(*split) if split else ():
            if cols := self.columns(*zip(*_features(token))) if _WORD.search(token) else None:
                hits[token] = cols
        out = np.zeros(len(texts))
        for k, tokens in enumerate(split):
            if found := {c for t in tokens if t in hits for c in hits[t]}:
                out[k] = self.weights[sorted(found)].sum()
        return out


def marked(rows: list[np.ndarray], toxic: np.ndarray, col: int) -> dict[int, int]:
    """Features over-represented in toxic rows -> their number."""
    feats, seen = np.unique(np.concatenate([np.unique(r[:, col]) + (t << BITS) for r, t in zip(rows, toxic.tolist())]), return_counts=True)
    n1, n0 = toxic.sum(), len(toxic) - toxic.sum()
    is1, key = (feats >> BITS) == 1, feats & ((1 << BITS) - 1)
    keys = np.unique(key)
    a, b = np.zeros(len(keys)), np.zeros(len(keys))
    a[np.searchsorted(keys, key[is1])] = seen[is1]
    b[np.searchsorted(keys, key[~is1])] = seen[~is1]
    n = n1 + n0
    with np.errstate(divide="ignore", invalid="ignore"):
        chi2 = n * (a * (n0 - b) - b * (n1 - a)) ** 2 / (n1 * n0 * (a + b) * (n - a - b))
    good = (chi2 > CHI2) & (a >= max(MIN_SEEN, MIN_SHARE * n1)) & (a / n1 > LIFT * b / n0)
    return {int(k): i for i, k in enumerate(keys[good])}


def fit(rows: list[np.ndarray], toxic: np.ndarray) -> OrdinalModel:
    if not len(rows) or toxic.sum() in (0, len(toxic)):
        return OrdinalModel({}, {}, np.zeros(0), np.full(GRADES, 60.0))
    words, begins = marked(rows, toxic, 0), marked(rows, toxic, 1)
    begins = {b: len(words) + k for k, b in enumerate(begins)}
    m = OrdinalModel(words, begins, np.zeros(len(words) + len(begins)), np.arange(1.0, GRADES + 1))
    cols = [m.columns(np.unique(r[:, 0]).tolist(), np.unique(r[:, 1]).tolist()) for r in rows]
    hits = np.array([sum(c < len(words) for c in found) for found in cols])
    cuts = np.quantile(hits[toxic == 1], np.arange(1, GRADES) / GRADES)
    grade = np.where(toxic == 1, 1 + (hits[:, None] > cuts[None, :]).sum(1), 0)
    # AdaGrad on the sum of the thresholds' log losses; a threshold is the one before plus a positive step
    idx, seg = np.concatenate([np.array(c, np.int64) for c in cols]), segments([len(c) for c in cols])
    target = (grade[:, None] >= np.arange(1, GRADES + 1)[None, :]).astype(float)
    steps, g_w, g_t = np.array([1.0] + [0.5] * (GRADES - 1)), np.full(len(m.weights), 1e-8), np.full(GRADES, 1e-8)
    for _ in range(STEPS):
        m.thresholds = np.concatenate([[steps[0]], steps[0] + np.cumsum(np.maximum(steps[1:], 0.05))])
        err = (m.exceed(np.bincount(seg, m.weights[idx], len(rows))) - target) / len(rows)
        d_w = np.bincount(idx, err.sum(1)[seg], len(m.weights)) + L2 * m.weights
        d_t = -np.cumsum(err.sum(0)[::-1])[::-1]
        g_w, g_t = g_w + d_w * d_w, g_t + d_t * d_t
        m.weights = m.weights - RATE * d_w / np.sqrt(g_w)
        steps = steps - RATE * d_t / np.sqrt(g_t)
    return m


def train(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> OrdinalModel:
    """Fitted on labels(doc_id, toxic) whose crc32(doc_id) modulo 3 is not 1."""
    keys = labels.where(crc_rest(F.col("doc_id"), 3, 1) != 1).select("doc_id", F.col("toxic").cast("int").alias("label"))
    rows = collect_features(labelled_sample(keys, docs, max_train), packed_inputs)
    return fit([np.frombuffer(x, "<i4").reshape(-1, 2).astype(np.int64) for _, x in rows], np.array([int(y > 0) for y, _ in rows], np.int64))


def score_toxicity(docs: DataFrame, model: OrdinalModel) -> DataFrame:
    """doc_id, held_out, score, severity, predicted of every row."""
    def run(batches):
        for b in batches:
            p = model.exceed(model.scores(b.column("text").to_pylist()))
            yield pa.record_batch([b.column("doc_id"), b.column("held_out"), pa.array(p[:, 0]), pa.array(p.sum(1))],
                                  names=["doc_id", "held_out", "score", "severity"])

    src = docs.select("doc_id", (crc_rest(F.col("doc_id"), 3, 1) == 1).alias("held_out"), F.coalesce("text", F.lit("")).alias("text"))
    out = src.mapInArrow(run, f"doc_id {src.schema['doc_id'].dataType.simpleString()}, held_out boolean, score double, severity double")
    return out.withColumn("predicted", (F.col("score") >= REJECT).cast("int"))


def keep_clean(docs: DataFrame, model: OrdinalModel) -> DataFrame:
    """``docs`` without the rows whose score is REJECT or more; one pass, the
    text decides, so nothing is joined."""
    @F.pandas_udf("double")
    def score(texts):
        import pandas as pd
        return pd.Series(model.exceed(model.scores([t or "" for t in texts]))[:, 0])

    return docs.where(score(F.col("text")) < REJECT)
