"""Packing documents into fixed windows: best-fit decreasing.

Every document is tokenised (ids, then one end id) and cut into full windows
plus a rest.  Rests are packed largest first, each into the open window with
the least room that still holds it; a segment tree over remaining capacities
finds that window in log2(capacity) steps.

Tokenising happens once, distributed, and yields one small row a piece (no
ids); the pieces are written, dealt by a hash of their row number into
buckets of about ``bucket_pieces`` and packed bucket by bucket.  A bucket's
size does not grow with the data, its number does; what is lost to padding is
the last few windows of a bucket.

Defined cases: null text is empty, so it yields the end id alone; rows with
equal or null doc_ids are packed as separate documents; an empty table gives no
rows; a text of any length is cut into whole windows.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import compiled_encoder, vocabulary_path
from .common import written

WINDOW = 2048
END_ID = 1
BUCKET_PIECES = 20_000


class OpenWindows:
    """Segment tree over remaining capacities 0..capacity; a leaf holds the
    open windows with that much room."""

    def __init__(self, capacity: int):
        self.width = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.width)
        self.windows: list[list[int]] = [[] for _ in range(capacity + 1)]

    def put(self, room: int, window: int) -> None:
        self.windows[room].append(window)
        self._add(room, 1)

    def take(self, need: int) -> tuple[int, int] | None:
        """Removes and returns (room, window) with the least room >= need."""
        i = need + self.width
        if not self.count[i]:
            while i > 1 and (i & 1 or not self.count[i + 1]):
                i >>= 1
            if i <= 1:
                return None
            i += 1
            while i < self.width:
                i = 2 * i if self.count[2 * i] else 2 * i + 1
        room = i - self.width
        self._add(room, -1)
        return room, self.windows[room].pop()

    def _add(self, room: int, by: int) -> None:
        i = room + self.width
        while i:
            self.count[i] += by
            i >>= 1


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(window, offset) of each piece; every length is 1..capacity."""
    window, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    tree, n = OpenWindows(capacity), 0
    for k in np.argsort(-lengths, kind="stable").tolist():
        need = int(lengths[k])
        found = tree.take(need)
        if found is None:
            found, n = (capacity, n), n + 1
        room, w = found
        window[k], offset[k] = w, capacity - room
        if room > need:
            tree.put(room - need, w)
    return window, offset


def token_pieces(docs: DataFrame, path: str | None = None, window: int = WINDOW, end_id: int = END_ID,
                 with_ids: bool = False) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens (and ``ids``, packed): every
    document's full windows and its rest."""
    path = path or vocabulary_path()
    src = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    schema = (f"doc_id {src.schema['doc_id'].dataType.simpleString()}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint"
              + ", ids binary" * with_ids)
    end = end_id.to_bytes(4, "little")

    def run(batches):
        bpe = compiled_encoder(path)
        for b in batches:
            rows, start, length, crc, total, ids = [], [], [], [], [], []
            for k, text in enumerate(b.column("text").to_pylist()):
                packed = bpe.encode(text) + end
                n = len(packed) // 4
                for s in range(0, n, window):
                    piece = packed[4 * s:4 * (s + window)]
                    rows.append(k)
                    start.append(s)
                    length.append(len(piece) // 4)
                    crc.append(zlib.crc32(piece))
                    total.append(n)
                    if with_ids:
                        ids.append(piece)
            cols = [b.column("doc_id").take(pa.array(rows, pa.int64())), *(pa.array(x, pa.int64()) for x in (start, length, crc, total))]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
            if with_ids:
                cols, names = [*cols, pa.array(ids, pa.binary())], [*names, "ids"]
            yield pa.record_batch(cols, names=names)

    return src.mapInArrow(run, schema)


def pack(pieces: DataFrame, window: int = WINDOW, bucket_pieces: int = BUCKET_PIECES) -> DataFrame:
    """``pieces`` (with ``length``) plus sequence_id and offset."""
    pieces = written(pieces.withColumn("_row", F.monotonically_increasing_id()), "pieces")
    n = max(1, -(-pieces.count() // bucket_pieces))
    dealt = pieces.withColumn("_bucket", F.pmod(F.xxhash64("_row"), F.lit(n)))

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by([("_row", "ascending")])
        w, at = best_fit_decreasing(t["length"].to_numpy(), window)
        base = t["_bucket"][0].as_py() << 32
        out = t.drop_columns(["_row", "_bucket"])
        return out.append_column("sequence_id", pa.array(w + base)).append_column("offset", pa.array(at))

    fields = [f"{f.name} {f.dataType.simpleString()}" for f in pieces.schema if f.name != "_row"]
    return dealt.groupBy("_bucket").applyInArrow(run, ", ".join([*fields, "sequence_id bigint", "offset bigint"]))


def pack_documents(docs: DataFrame, path: str | None = None, window: int = WINDOW, end_id: int = END_ID,
                   with_ids: bool = False) -> DataFrame:
    return pack(token_pieces(docs, path, window, end_id, with_ids), window)
