"""Substring deduplication: fixed-block anchors.

A window of WINDOW words is removed from a document when the same words also
start in a document with a smaller doc_id.

1. Anchors.  Every document's words are cut into non-overlapping blocks of
   BLOCK words; any window of 2 * BLOCK - 1 words or more holds a whole block.
   Every rolling BLOCK-word window of every document probes the blocks.  Blocks
   and probes travel as packed 3-byte steps of sorted hashes (each distinct one once a chunk,
   with flags for "is a block" and "occurs again"), dealt by hash; a hash
   found at two places, one of them a block, is a hit and is told to the chunks
   that asked.
2. Extension.  Around its hits each chunk takes every WINDOW-word window that
   holds one; these (96-bit hash, smallest doc_id) are dealt by hash, and
   each chunk learns the smallest doc_id of the windows it has.  Windows with a
   smaller one are repeats; runs of them are the maximal exact repeats, and the
   words they cover are removed.

A false hit in step 1 only costs work in step 2.  Texts move once, dealt into
chunks of about CHUNK_BYTES by a hash of the row; all three passes read that one
exchange.  A passage in a third of all documents costs each chunk one entry, so
no bucket grows with it, and no pairs are formed.

Defined cases: null text has no words; windows do not cross documents; rows
with a null doc_id lose nothing and remove nothing; rows with equal doc_ids do
not remove each other's words; texts of any length are read whole.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import partitions

WINDOW = 13
BLOCK = (WINDOW + 1) // 2
CHUNK_BYTES = 6 << 20
BUCKET_BYTES = 16 << 20          # of text whose hashes share a bucket: a group does not grow with the input
MOST_BUCKETS = 1 << 24           # so that bucket and hash fit one 64-bit number
HASH_BITS = 30                   # of a packed anchor hash; its bucket adds to them
_LOW = np.uint64((1 << HASH_BITS) - 1)
_BASE = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str | None) -> list[bytes]:
    """Runs of bytes other than ASCII white space, unchanged."""
    return (text or "").encode().split()


_SPACE = np.isin(np.arange(256), list(b" \t\n\x0b\x0c\r"))
#: Two word hashes: a random value for each byte, times a power of an odd base.
_BYTE_VALUES = np.random.default_rng(13).integers(1, 1 << 63, (2, 256), dtype=np.uint64) | np.uint64(1)
_BASES = (0x2545F4914F6CDD1D, 0xD1342543DE82EF95)


class ChunkWords:
    """The words of a chunk's documents laid end to end, hashed."""

    def __init__(self, texts: list):
        parts = [(t or "").encode() for t in texts]
        data = np.frombuffer(b"\n".join([*parts, b""]), np.uint8)
        space = _SPACE[data]
        word = ~space
        before = np.concatenate([[True], space[:-1]])[:len(data)]
        self.data, self.start = data, np.flatnonzero(word & before)
        self.end = np.flatnonzero(space & ~np.concatenate([[True], space[:-1]])[:len(data)])
        self.n = len(self.start)
        offsets = np.cumsum([0, *(len(x) + 1 for x in parts)])
        self.n_docs = len(parts)
        self.doc = np.searchsorted(offsets, self.start, "right") - 1
        self.lengths = np.bincount(self.doc, minlength=self.n_docs)
        first = np.cumsum(self.lengths) - self.lengths
        self.place = np.arange(self.n) - first[self.doc]
        self.rest = self.lengths[self.doc] - self.place
        self._h: dict[int, np.ndarray] = {}
        self._bytes = (data[word], self.end - self.start)

    def hashes(self, k: int) -> np.ndarray:
        """Sum of byte value * base^place over each word's bytes (mod 2^64), mixed with its length."""
        if k not in self._h:
            letters, size = self._bytes
            first = np.cumsum(size) - size
            power = np.cumprod(np.full(int(size.max(initial=1)), _BASES[k], np.uint64), dtype=np.uint64)
            values = _BYTE_VALUES[k][letters]
            values *= power[np.arange(len(letters)) - np.repeat(first, size)]
            h = np.add.reduceat(values, first) if self.n else np.zeros(0, np.uint64)
            h ^= size.astype(np.uint64) * _BASE
            h ^= h >> np.uint64(31)
            self._h[k] = h * np.uint64(0x94D049BB133111EB)
        return self._h[k]

    def rolling(self, width: int, half: int) -> np.ndarray:
        """Hash of the window that starts at each word (valid where rest >= width)."""
        h = np.concatenate([self.hashes(half), np.zeros(width, np.uint64)])
        acc = np.zeros(self.n, np.uint64)
        for j in range(width):
            acc = acc * _BASE + h[j:j + self.n]
        acc ^= acc >> np.uint64(29)
        acc *= np.uint64(0xBF58476D1CE4E5B9)
        return acc ^ (acc >> np.uint64(32))

    def texts(self, kept: np.ndarray) -> pa.Array:
        """Each document's kept words joined by one space."""
        edge = np.zeros(len(self.data) + 2, np.int8)
        np.add.at(edge, self.start[kept], 1)
        np.add.at(edge, self.end[kept] + 1, -1)                # the byte after a word becomes its space
        mask = np.cumsum(edge, dtype=np.int8)[:len(self.data)] > 0
        doc = self.doc[kept]
        last = np.flatnonzero(np.append(doc[1:] != doc[:-1], True)[:len(doc)])
        mask[self.end[kept][last]] = False
        out = np.where(_SPACE[self.data], np.uint8(32), self.data)[mask]
        size = np.bincount(doc, (self.end - self.start)[kept] + 1, self.n_docs).astype(np.int64)
        size -= (size > 0)
        offsets = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
        return pa.LargeStringArray.from_buffers(self.n_docs, pa.py_buffer(offsets), pa.py_buffer(out.tobytes())).cast(pa.string())


def pack_sorted(v: np.ndarray) -> bytes:
    """Ascending numbers as 3-byte steps, or whole if a step is too long."""
    steps = np.diff(v, prepend=np.uint64(0))
    if len(v) and int(steps.max()) >= 1 << 24:
        return b"\x01" + v.astype("<u8").tobytes()
    return b"\x00" + np.ascontiguousarray(steps.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :3]).tobytes()


def unpack_sorted(b: bytes) -> np.ndarray:
    if b[0]:
        return np.frombuffer(b, "<u8", offset=1)
    out = np.zeros(((len(b) - 1) // 3, 8), np.uint8)
    out[:, :3] = np.frombuffer(b, np.uint8, offset=1).reshape(-1, 3)
    return np.cumsum(out.reshape(-1).view("<u8"), dtype=np.uint64)


def pack_columns(*columns: np.ndarray) -> bytes:
    """Arrays of one length, byte planes apart: high bytes that are alike compress."""
    return b"".join(np.ascontiguousarray(c.view(np.uint8).reshape(len(c), -1).T).tobytes() for c in columns)


def unpack_columns(b: bytes, kinds: str) -> list[np.ndarray]:
    types = [np.dtype(k) for k in kinds.split()]
    n, at, out = len(b) // sum(t.itemsize for t in types), 0, []
    for t in types:
        planes = np.frombuffer(b, np.uint8, n * t.itemsize, at).reshape(t.itemsize, n)
        out.append(np.ascontiguousarray(planes.T).reshape(-1).view(t))
        at += n * t.itemsize
    return out


def _anchor_keys(c: ChunkWords, n_buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place in the chunk, bucket, packed hash) of every rolling window."""
    at = np.flatnonzero(c.rest >= BLOCK)
    h = c.rolling(BLOCK, 0)[at]
    return at, ((h >> np.uint64(HASH_BITS)) % np.uint64(n_buckets)).astype(np.int64), h & _LOW


def _dealt(bucket: np.ndarray, payload, chunk: int) -> dict:
    """Rows (bucket, chunk, data) of elements sorted by bucket."""
    keys, starts = np.unique(bucket, return_index=True)
    ends = np.append(starts[1:], len(bucket))
    return {"bucket": pa.array(keys, pa.int64()), "chunk": pa.array(np.full(len(keys), chunk), pa.int64()),
            "data": pa.array([payload(a, b) for a, b in zip(starts.tolist(), ends.tolist())], pa.binary())}


_ROWS = "bucket bigint, chunk bigint, data binary"


def _probe(n_buckets: int):
    def run(t: pa.Table) -> pa.Table:
        c = ChunkWords(t["text"].to_pylist())
        at, bucket, low = _anchor_keys(c, n_buckets)
        block = (c.place[at] % BLOCK == 0).astype(np.uint64)
        shift = np.uint64(HASH_BITS + 1)
        v = np.sort(bucket.astype(np.uint64) << shift | low << np.uint64(1) | block)
        starts = np.flatnonzero(np.append(True, v[1:] >> np.uint64(1) != v[:-1] >> np.uint64(1))[:len(v)])
        times = np.diff(np.append(starts, len(v)))
        v = v[starts + times - 1]                                           # of equal hashes the last tells whether one is a block
        packed = (v & ((_LOW << np.uint64(1)) | np.uint64(1))) << np.uint64(1) | (times > 1).astype(np.uint64)   # hash, is a block, occurs again
        return pa.table(_dealt((v >> shift).astype(np.int64), lambda a, b: pack_sorted(packed[a:b]), t["_chunk"][0].as_py()))
    return run


def _match(t: pa.Table) -> pa.Table:
    """Tells each chunk which of its hashes in this bucket are hits."""
    data = [unpack_sorted(x) for x in t["data"].to_pylist()]
    v = np.sort(np.concatenate(data))
    h = v >> np.uint64(2)
    starts = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
    flags = np.bitwise_or.reduceat(v & np.uint64(3), starts)
    times = np.diff(np.append(starts, len(v)))
    hits = h[starts][(flags & np.uint64(2) > 0) & ((times > 1) | (flags & np.uint64(1) > 0))]
    own = [np.intersect1d(x >> np.uint64(2), hits, assume_unique=True) for x in data]
    keep = [k for k, x in enumerate(own) if len(x)]
    bucket = t["bucket"][0].as_py()
    return pa.table({"bucket": pa.array([bucket] * len(keep), pa.int64()), "chunk": t["chunk"].take(pa.array(keep, pa.int64())).combine_chunks(),
                     "data": pa.array([pack_sorted(own[k]) for k in keep], pa.binary())})


_WINDOW_COLUMNS = "<u8 <u4 <i8 <i8"       # 96 bits of hash, smallest doc_id of the chunk, largest less smallest
_REPLY_COLUMNS = "<u8 <i8"                # 64 bits name one of a chunk's windows; smallest doc_id of all


def _ids(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """(doc_id, is known)."""
    x = t["doc_id"].combine_chunks()
    return x.fill_null(0).cast(pa.int64()).to_numpy(zero_copy_only=False), ~np.asarray(x.is_null())


def _extend(n_buckets: int):
    def run(t: pa.Table, hits: pa.Table) -> pa.Table:
        empty = {"bucket": pa.array([], pa.int64()), "chunk": pa.array([], pa.int64()), "data": pa.array([], pa.binary())}
        if not t.num_rows or not hits.num_rows:
            return pa.table(empty)
        c = ChunkWords(t["text"].to_pylist())
        at, bucket, low = _anchor_keys(c, n_buckets)
        shift = np.uint64(HASH_BITS)
        told = np.concatenate([unpack_sorted(x) | np.uint64(k) << shift for k, x in zip(hits["bucket"].to_pylist(), hits["data"].to_pylist())])
        hit = np.zeros(c.n + WINDOW, np.int64)
        hit[at] = np.isin(bucket.astype(np.uint64) << shift | low, told)
        total = np.concatenate([[0], np.cumsum(hit)])
        i = np.arange(c.n)
        ids, known = _ids(t)
        take = np.flatnonzero((c.rest >= WINDOW) & (total[i + WINDOW - BLOCK + 1] > total[i]) & known[c.doc])
        if not len(take):
            return pa.table(empty)
        a, b, d = c.rolling(WINDOW, 0)[take], c.rolling(WINDOW, 1)[take].astype("<u4"), ids[c.doc[take]]
        key = (a % np.uint64(n_buckets)).astype(np.int64)
        order = np.lexsort((d, b, a, key))
        a, b, d, key = a[order], b[order], d[order], key[order]
        first = np.flatnonzero(np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])))
        last = np.append(first[1:], len(a)) - 1
        columns = a[first], b[first], d[first], d[last] - d[first]
        return pa.table(_dealt(key[first], lambda x, y: pack_columns(*(v[x:y] for v in columns)), t["_chunk"][0].as_py()))
    return run


def _smallest(t: pa.Table) -> pa.Table:
    """Tells each chunk the smallest doc_id of those of its windows that have one smaller than its largest."""
    data = [unpack_columns(x, _WINDOW_COLUMNS) for x in t["data"].to_pylist()]
    a, b, own_low, span = (np.concatenate(c) for c in zip(*data))
    sizes = [len(x[0]) for x in data]
    order = np.lexsort((own_low, b, a))
    starts = np.flatnonzero(np.append(True, (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1])))
    low = np.empty(len(a), np.int64)
    low[order] = np.repeat(own_low[order][starts], np.diff(np.append(starts, len(a))))
    wanted = low < own_low + span
    part = np.repeat(np.arange(len(data)), sizes)[wanted]
    cuts = np.searchsorted(part, np.arange(len(data) + 1))
    a, low = a[wanted], low[wanted]
    keep = np.flatnonzero(np.diff(cuts)).tolist()
    return pa.table({"bucket": pa.array([t["bucket"][0].as_py()] * len(keep), pa.int64()),
                     "chunk": t["chunk"].take(pa.array(keep, pa.int64())).combine_chunks(),
                     "data": pa.array([pack_columns(a[cuts[k]:cuts[k + 1]], low[cuts[k]:cuts[k + 1]]) for k in keep], pa.binary())})


def repeated_words(c: ChunkWords, ids: np.ndarray, known: np.ndarray, told: list[bytes]) -> np.ndarray:
    """Whether each word of the chunk lies in a window that starts in a smaller document."""
    cover = np.zeros(c.n + WINDOW + 1, np.int64)
    at = np.flatnonzero((c.rest >= WINDOW) & known[c.doc])
    if told and len(at):
        key, low = (np.concatenate(x) for x in zip(*(unpack_columns(x, _REPLY_COLUMNS) for x in told)))
        order = np.argsort(key)
        key, low = key[order], low[order]
        a = c.rolling(WINDOW, 0)[at]
        k = np.minimum(np.searchsorted(key, a), len(key) - 1)
        found = at[(key[k] == a) & (low[k] < ids[c.doc[at]])]
        np.add.at(cover, found, 1)
        np.add.at(cover, found + WINDOW, -1)
    return np.cumsum(cover)[:c.n] > 0


def _counts(n: int, size: int) -> tuple[int, int]:
    """Numbers of chunks and of hash buckets for ``size`` bytes of text on ``n`` partitions."""
    return max(n, size // CHUNK_BYTES + 1), min(max(4 * n, size // BUCKET_BYTES + 1), MOST_BUCKETS)


def dedup_substrings(docs: DataFrame) -> DataFrame:
    """``docs`` with text replaced by the kept words joined by one space, and
    n_words, n_removed, n_repeats (maximal repeats removed) added."""
    add = ["n_words", "n_removed", "n_repeats", "_chunk"]
    base = docs.drop(*[c for c in docs.columns if c in add])
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_chunks, n_buckets = _counts(partitions(docs.sparkSession), int(size))
    dealt = base.withColumn("_chunk", F.pmod(F.xxhash64("doc_id", "text"), F.lit(n_chunks)))
    probes = dealt.groupBy("_chunk").applyInArrow(_probe(n_buckets), _ROWS)
    hits = probes.groupBy("bucket").applyInArrow(_match, _ROWS)
    windows = dealt.groupBy("_chunk").cogroup(hits.groupBy("chunk")).applyInArrow(_extend(n_buckets), _ROWS)
    replies = windows.groupBy("bucket").applyInArrow(_smallest, _ROWS)

    def finish(t: pa.Table, told: pa.Table) -> pa.Table:
        c = ChunkWords(t["text"].to_pylist())
        ids, known = _ids(t)
        gone = repeated_words(c, ids, known, told["data"].to_pylist())
        starts = gone & ~(np.append(False, gone[:-1]) & (c.place > 0))
        removed, runs = (np.bincount(c.doc[x], minlength=c.n_docs) for x in (gone, starts))
        out = t.drop_columns(["_chunk"])
        out = out.set_column(out.column_names.index("text"), "text", c.texts(~gone))
        for name, v in (("n_words", c.lengths), ("n_removed", removed), ("n_repeats", runs)):
            out = out.append_column(name, pa.array(v, pa.int64()))
        return out

    schema = T.StructType([*[T.StructField(f.name, f.dataType) for f in base.schema],
                           *[T.StructField(c, T.LongType()) for c in ("n_words", "n_removed", "n_repeats")]])
    return dealt.groupBy("_chunk").cogroup(replies.groupBy("chunk")).applyInArrow(finish, schema)


def substring_digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 (and n_repeats) of every document."""
    d = dedup_substrings(docs.select("doc_id", "text"))
    return d.select("doc_id", "n_words", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"), "n_repeats")
