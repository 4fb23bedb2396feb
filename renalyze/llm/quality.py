"""Quality classifier: a factorisation machine.

A document's input is sparse: hashed words (log counts, scaled to unit
length), and bins of structure statistics (shares of upper case, digits,
symbols and white space, distinct words and lines, word and line lengths) and
of metadata (length).  The score is

    w0 + sum w_i x_i + 1/2 sum_f [ (sum v_if x_i)^2 - sum v_if^2 x_i^2 ]

so all pairwise interactions cost time linear in the input.  It is fitted by
AdaGrad on a bounded sample of labelled rows (``MAX_TRAIN``), then every
whole text is scored in Arrow batches.

Defined cases: null text scores like empty text; a null doc_id is held out;
without labelled rows every score is 0.5; labels, lang, source and doc_id
are no inputs.
"""

from __future__ import annotations

import string
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_rest
from .learning import WordTable, collect_features, labelled_sample, segments, sigmoid

MAX_TRAIN = 4000                 # labelled rows used for fitting, at most
WORD_BITS = 14
FACTORS = 6
EPOCHS = 15
BATCH = 128
RATE, L2 = 0.1, 1e-4
BINS = 12

_CLASSES = ["upper", "lower", "digit", "space", "newline", "stop", "bang", "bar", "symbol", "other"]


def _byte_classes() -> np.ndarray:
    of = np.full(256, _CLASSES.index("other"))
    for chars, name in ((string.ascii_uppercase, "upper"), (string.ascii_lowercase, "lower"), (string.digits, "digit"),
                        (" \t\r\v\f", "space"), ("\n", "newline"), (".,;:'\"-?", "stop"), ("!", "bang"), ("|<>{}[]/\\", "bar"),
                        ("#$%&*+=@^_`~()", "symbol")):
        for c in chars:
            of[ord(c)] = _CLASSES.index(name)
    return of.astype(np.uint8)


CLASS_OF = _byte_classes()
STATS = [*_CLASSES, "distinct words", "distinct lines", "word length", "line words", "top word", "length", "lines"]
DIM = (1 << WORD_BITS) + len(STATS) * BINS


@lru_cache(maxsize=1)
def _words() -> WordTable:
    return WordTable(lambda w: zlib.crc32(w.encode()) & ((1 << WORD_BITS) - 1))


def statistics(text: str, words: list[str], counts: np.ndarray) -> list[float]:
    """STATS, each 0 to 1."""
    data = np.frombuffer(text.encode(), np.uint8)
    n, m = max(1, len(data)), max(1, len(words))
    share = np.bincount(CLASS_OF[data], minlength=len(_CLASSES)) / n
    lines = text.split("\n")
    return [*np.sqrt(share), len(counts) / m, len(set(lines)) / len(lines), min(1.0, n / m / 24), min(1.0, m / len(lines) / 240),
            float(counts.max(initial=0)) / m, min(1.0, np.log1p(n) / 14), min(1.0, np.log1p(len(lines)) / 9)]


def inputs(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(indices, values) of a document."""
    words = text.split()
    idx, counts = np.unique(np.fromiter(map(_words().__getitem__, map(str.lower, words)), np.int32, len(words)), return_counts=True)
    x = np.log1p(counts)
    x = x / max(1e-9, np.sqrt((x * x).sum()))
    bins = [(1 << WORD_BITS) + k * BINS + min(BINS - 1, int(v * BINS)) for k, v in enumerate(statistics(text, words, counts))]
    return np.concatenate([idx, np.array(bins, np.int32)]), np.concatenate([x, np.full(len(bins), 0.5)]).astype(np.float32)


def packed_inputs(text: str) -> bytes:
    i, x = inputs(text)
    return i.astype("<i4").tobytes() + x.astype("<f4").tobytes()


def unpack(b: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = len(b) // 8
    return np.frombuffer(b, "<i4", n), np.frombuffer(b, "<f4", n, 4 * n)


class FactorisationMachine:
    def __init__(self, w0: float, w: np.ndarray, v: np.ndarray):
        self.w0, self.w, self.v = w0, w, v

    @staticmethod
    def fit(rows: list[tuple[np.ndarray, np.ndarray]], labels: list[int], dim: int = DIM) -> FactorisationMachine:
        rng = np.random.default_rng(11)
        m = FactorisationMachine(0.0, np.zeros(dim), rng.normal(0, 0.05, (dim, FACTORS)))
        if not rows:
            return m
        y = np.array(labels, float)
        gw, gv, g0 = np.full(dim, 1e-6), np.full((dim, FACTORS), 1e-6), 1e-6
        for _ in range(EPOCHS):
            order = rng.permutation(len(rows))
            for at in range(0, len(rows), BATCH):
                part = order[at:at + BATCH]
                idx, x = (np.concatenate(z) for z in zip(*(rows[k] for k in part)))
                seg = segments([len(rows[k][0]) for k in part])
                z, s = m._scores(idx, x, seg, len(part))
                err = (sigmoid(z) - y[part]) / len(part)
                used, back = np.unique(idx, return_inverse=True)
                e = err[seg] * x
                dw = np.bincount(back, e) + L2 * m.w[used]
                dv = e[:, None] * (s[seg] - m.v[idx] * x[:, None])
                dv = np.stack([np.bincount(back, c) for c in dv.T], 1) + L2 * m.v[used]
                gw[used] += dw * dw
                gv[used] += dv * dv
                g0 += err.sum() ** 2
                m.w[used] -= RATE * dw / np.sqrt(gw[used])
                m.v[used] -= RATE * dv / np.sqrt(gv[used])
                m.w0 -= RATE * err.sum() / np.sqrt(g0)
        return m

    def _scores(self, idx, x, seg, n):
        vx = self.v[idx] * x[:, None]
        s = np.stack([np.bincount(seg, c, n) for c in vx.T], 1)
        q = np.bincount(seg, (vx * vx).sum(1) * -0.5 + self.w[idx] * x, n)
        return self.w0 + q + 0.5 * (s * s).sum(1), s

    def score(self, idx: np.ndarray, x: np.ndarray) -> float:
        vx = self.v[idx] * x[:, None]
        s = vx.sum(0)
        return self.w0 + float(self.w[idx] @ x) + 0.5 * float((s * s).sum() - (vx * vx).sum())


def train(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> FactorisationMachine:
    """Fitted on labels(doc_id, quality) whose crc32(doc_id) modulo 3 is not 1."""
    keys = labels.where(crc_rest(F.col("doc_id"), 3, 1) != 1).select("doc_id", F.col("quality").cast("int").alias("label"))
    rows = collect_features(labelled_sample(keys, docs, max_train), packed_inputs)
    return FactorisationMachine.fit([unpack(x) for _, x in rows], [int(y > 0) for y, _ in rows])


def score_quality(docs: DataFrame, model: FactorisationMachine) -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""
    m = FactorisationMachine(model.w0, model.w.astype(np.float32), model.v.astype(np.float32))
    trained = bool(np.any(model.w))

    def run(batches):
        for b in batches:
            z = np.array([m.score(*inputs(t)) if trained else 0.0 for t in b.column("text").to_pylist()])
            yield pa.record_batch([b.column("doc_id"), b.column("held_out"), pa.array(sigmoid(z))], names=["doc_id", "held_out", "score"])

    src = docs.select("doc_id", (crc_rest(F.col("doc_id"), 3, 1) == 1).alias("held_out"), F.coalesce("text", F.lit("")).alias("text"))
    out = src.mapInArrow(run, f"doc_id {src.schema['doc_id'].dataType.simpleString()}, held_out boolean, score double")
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
