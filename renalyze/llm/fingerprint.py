"""Document fingerprints: a quartile bucket digest.

Byte triplets drawn from a sliding window of five bytes are hashed into
``BUCKETS`` counters.  The counters' quartiles turn each one into two bits
(which quarter it lies in), and a header holds the length on a logarithmic
scale and the quartiles' ratios.  Two digests differ by the sum of their
buckets' quarter distances (the far corner counts extra) plus header terms;
likeness is 1 - difference / largest difference, so it lies in 0..1.

``fingerprint_edits`` compares each document with its edited text (second half
replaced by the beginning of the next document by doc_id) and with that next
document.  Ranges of doc_ids are cut and their first ids found without reading
texts; then one shuffle brings each range together, with the first row of the
next range behind it, and the sorted texts are streamed.  Nothing is written in between.

Defined cases: null text is empty; an empty text has the all-zero digest; rows
with equal doc_ids are ordered by text; null doc_ids come first; a table of
one row is its own successor; ids that are no numbers make one range; further columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import partitions

BUCKETS = 1024
#: Triplets of a five-byte window: offsets of the second and third byte, and a salt each.
TRIPLETS = ((1, 2, 2), (1, 3, 3), (1, 4, 7))
CORNER = 3                       # extra difference between the lowest and the highest quarter
LENGTH_STEP = 1.3                # the length header counts powers of this
LENGTH_MOST, RATIO_MOST = 63, 15
HEADER_WEIGHT = 4
RANGES = 4                       # of doc_ids, per partition
_DIFF = np.array([[abs(a - b) if abs(a - b) < 3 else 3 + CORNER for b in range(4)] for a in range(4)], np.int32)
MOST = BUCKETS * (3 + CORNER) + HEADER_WEIGHT * (LENGTH_MOST + 2 * RATIO_MOST)


def digest(text: str) -> np.ndarray:
    """Header (3 bytes) and one quarter (0..3) a bucket."""
    data = np.frombuffer(text.encode(), np.uint8).astype(np.uint32)
    counts = np.zeros(BUCKETS, np.int64)
    n = len(data)
    for j, k, salt in TRIPLETS:
        if n > k:
            h = (data[:n - k] * np.uint32(0x9E3779B1) + data[j:n - k + j] * np.uint32(0x85EBCA77)
                 + data[k:] * np.uint32(0xC2B2AE3D) + np.uint32(salt * 0x27D4EB2F & 0xFFFFFFFF))
            h ^= h >> np.uint32(15)
            h *= np.uint32(0x2C1B3C6D)
            counts += np.bincount(h >> np.uint32(22), minlength=BUCKETS)
    out = np.zeros(3 + BUCKETS, np.uint8)
    if n:
        q1, q2, q3 = np.partition(counts, [BUCKETS // 4, BUCKETS // 2, 3 * BUCKETS // 4])[[BUCKETS // 4, BUCKETS // 2, 3 * BUCKETS // 4]]
        out[0] = min(LENGTH_MOST, 1 + int(np.log(n) / np.log(LENGTH_STEP)))
        out[1:3] = [int(RATIO_MOST * q / q3) if q3 else 0 for q in (q1, q2)]
        out[3:] = (counts > q1).astype(np.uint8) + (counts > q2) + (counts > q3)
    return out


def as_text(d: np.ndarray) -> str:
    """Two hexadecimal digits a header field, then four quarters a byte."""
    q = d[3:].reshape(-1, 4)
    return (d[:3].tobytes() + (q[:, 0] << 6 | q[:, 1] << 4 | q[:, 2] << 2 | q[:, 3]).astype(np.uint8).tobytes()).hex()


def from_text(s: str) -> np.ndarray:
    b = np.frombuffer(bytes.fromhex(s), np.uint8)
    q = b[3:]
    return np.concatenate([b[:3], np.stack([q >> 6, q >> 4 & 3, q >> 2 & 3, q & 3], 1).ravel()])


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """0 to 1; 1 for equal digests."""
    body = int(_DIFF[a[3:], b[3:]].sum())
    head = HEADER_WEIGHT * int(np.abs(a[:3].astype(int) - b[:3].astype(int)).sum())
    return 1.0 - (body + head) / MOST


def edited(text: str, following: str) -> str:
    """The last floor(n/2) code points give way to the first as many of ``following``."""
    h = len(text) // 2
    return text[:len(text) - h] + following[:h]


_OUT = ["n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]


def _row(text: str, d: np.ndarray, following: str, d_next: np.ndarray) -> tuple:
    e = edited(text, following)
    d_e = digest(e)
    return (len(text), hashlib.sha256(e.encode()).hexdigest(), as_text(d), as_text(d_e), likeness(d, d_e), likeness(d, d_next))


def _ranges(docs: DataFrame, n: int) -> Column:
    """The range (0 to about ``n``) that a row's doc_id falls in, by quantiles of
    the ids; found in two steps of about sqrt(n) comparisons.  Null ids are in the first."""
    x = F.col("doc_id").try_cast("double")
    marks = [k / n for k in range(1, n)]
    bounds = sorted(set(docs.select(x.alias("x")).approxQuantile("x", marks, 1.0 / (4 * n)))) if marks else []
    if not bounds:
        return F.lit(0)
    step = int(len(bounds) ** 0.5) + 1
    runs = F.array(*[F.array(*[F.lit(b) for b in bounds[k:k + step]]) for k in range(0, len(bounds), step)])

    def at_most(a: Column) -> Column:
        return F.size(F.filter(a, lambda b: b <= x))

    run = F.size(F.filter(runs, lambda r: r[0] <= x))
    return F.when(x.isNull() | (run == 0), 0).otherwise((run - 1) * step + at_most(F.get(runs, run - 1)))


def fingerprint_edits(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    spark = docs.sparkSession
    n = partitions(spark)
    src = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    src = src.withColumn("part", _ranges(docs, RANGES * n))
    # each range's smallest id, from the ids alone: those rows also follow the last one of the range before
    first = F.min(F.struct(F.col("doc_id").isNotNull().alias("known"), "doc_id")).alias("first")
    heads = sorted(src.groupBy("part").agg(first).collect(), key=lambda r: r["part"])       # one row a range
    kind = docs.schema["doc_id"].dataType.simpleString()
    before = spark.createDataFrame([(h["part"], h["first"]["doc_id"], heads[k - 1]["part"]) for k, h in enumerate(heads)],
                                   f"_part int, _id {kind}, _before int")
    rows = src.join(F.broadcast(before), (src["part"] == before["_part"]) & src["doc_id"].eqNullSafe(before["_id"]), "left")
    follows = F.when(F.col("_part").isNotNull(), F.struct(F.col("_before").alias("part"), F.lit(1).alias("follows")))
    dealt = (rows.select("doc_id", "text", F.explode(F.array_compact(F.array(F.struct("part", F.lit(0).alias("follows")), follows))).alias("_to"))
                 .select("doc_id", "text", "_to.part", "_to.follows")
                 .repartition(n, "part").sortWithinPartitions("part", "follows", "doc_id", "text"))
    measures = "n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    types = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]

    def run(batches):
        open_ = None                # the row that waits for its successor: part, doc_id, text, digest
        for b in batches:
            ids, rows = b.column("doc_id"), []
            own = []                # places of the rows' doc_ids
            for k, (t, part, follows) in enumerate(zip(b.column("text").to_pylist(), b.column("part").to_pylist(), b.column("follows").to_pylist())):
                if open_ is None and follows:
                    continue        # another row of the id that has closed the range
                d = digest(t)
                if open_ is not None:
                    own.append(open_[0])
                    rows.append(_row(open_[1], open_[2], t, d))
                open_ = None if follows else (ids[k], t, d)
            yield pa.record_batch([pa.array([i.as_py() for i in own], ids.type),
                                   *(pa.array([r[k] for r in rows], t) for k, t in enumerate(types))], names=["doc_id", *_OUT])

    return dealt.mapInArrow(run, f"doc_id {kind}, {measures}")
