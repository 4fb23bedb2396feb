"""What the three classifiers share: a bounded labelled sample and word tables."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

TABLE_WORDS = 300_000            # words kept a worker; speed only


class WordTable(dict):
    """Word -> value, filled on demand up to a bound."""

    def __init__(self, make: Callable, bound: int = TABLE_WORDS):
        self.make, self.bound = make, bound

    def __missing__(self, word: str):
        v = self.make(word)
        if len(self) < self.bound and len(word) < 64:
            self[word] = v
        return v


def labelled_sample(keys: DataFrame, docs: DataFrame, bound: int) -> DataFrame:
    """(label, text) of at most ``bound`` of the (doc_id, label) rows in
    ``keys``, those with the smallest hash of their id; the bound also limits
    what is broadcast."""
    chosen = (keys.where("doc_id IS NOT NULL AND label IS NOT NULL")
                  .orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(bound))
    return (docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
                .join(F.broadcast(chosen), "doc_id").select("doc_id", "label", "text"))


def shares(counts: dict, bound: int) -> dict:
    """How many rows of each label to take, about ``bound`` in all: equal
    shares, and what a small label leaves goes to the larger ones.  None gets 0."""
    out, left = {}, bound
    for k, (label, n) in enumerate(sorted(counts.items(), key=lambda x: (x[1], x[0]))):
        out[label] = min(n, max(1, left // (len(counts) - k)))
        left -= out[label]
    return out


def sample_of_each(keys: DataFrame, docs: DataFrame, bound: int) -> DataFrame:
    """(doc_id, label, text) of about ``bound`` of the (doc_id, label) rows in
    ``keys``: of each label its share, those with the smallest hash of their
    id.  Counts a range of hashes tell how far each label has to be read, so
    only about that many rows a label are sorted, whatever a label's size."""
    keys = (keys.where("doc_id IS NOT NULL AND label IS NOT NULL")
                .withColumns({"hash": F.xxhash64("doc_id"), "range": F.shiftright(F.xxhash64("doc_id"), 52)}))
    before = F.sum("n").over(Window.partitionBy("label").orderBy("range")) - F.col("n")
    ranges = keys.groupBy("label", "range").agg(F.count("*").alias("n")).withColumn("before", before)
    last = ranges.where(F.col("before") < bound).groupBy("label").agg(F.max("range").alias("last"), F.sum("n").alias("n")).collect()
    taken = shares({r.label: min(r.n, bound) for r in last}, bound)
    wanted = docs.sparkSession.createDataFrame([(r.label, r["last"], taken[r.label]) for r in last],
                                               f"label {keys.schema['label'].dataType.simpleString()}, last bigint, share int")
    order = Window.partitionBy("label").orderBy("hash", "doc_id")
    chosen = (keys.join(F.broadcast(wanted), "label").where("range <= last").withColumn("rank", F.row_number().over(order))
                  .where((F.col("rank") <= bound) & (F.col("rank") <= F.col("share"))).select("doc_id", "label"))
    return (docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
                .join(F.broadcast(chosen), "doc_id").select("doc_id", "label", "text"))


def collect_features(sample: DataFrame, features: Callable[[str], bytes]) -> list[tuple]:
    """[(label, features of the text)] on the driver, in a fixed order."""
    label = sample.schema["label"].dataType.simpleString()

    def run(batches):
        for b in batches:
            x = pa.array([features(t) for t in b.column("text").to_pylist()], pa.binary())
            yield pa.record_batch([b.column("doc_id"), b.column("label"), x], names=["doc_id", "label", "x"])

    rows = sample.mapInArrow(run, f"doc_id {sample.schema['doc_id'].dataType.simpleString()}, label {label}, x binary").collect()
    return [(r.label, bytes(r.x)) for r in sorted(rows, key=lambda r: (r.doc_id, str(r.label), bytes(r.x)))]


def segments(lengths: list[int]) -> np.ndarray:
    """Row number of every element of a list of lists laid end to end."""
    return np.repeat(np.arange(len(lengths)), lengths)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -35, 35)))
