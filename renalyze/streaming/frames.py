"""T2 (streaming): rebuild MLLP frames from byte chunks per connection.

``transformWithStateInPandas`` keyed by connection.  The state holds only
the unfinished tail of the connection's byte stream (at most one frame) and
the number of frames emitted so far, so it stays small however much traffic
a connection carries.  Chunks of a connection are applied in ``seq`` order
within a micro-batch and are expected in order across batches (one TCP
stream).  A task holds a bounded part of a connection's micro-batch: sorted
runs of chunks beyond ``RUN_CHARS`` lie in temporary files and are merged, and
frames leave in frames of ``OUT_ROWS`` rows.  A frame is emitted at each end byte 0x1c: ``ok`` with the text
after ``^\\r?\\x0b``, else ``bad_framing``.  The batch form is
``operators.reassemble``.
"""

from __future__ import annotations

import heapq
import pickle
import re
import tempfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

OUTPUT_SCHEMA = "conn_id bigint, frame_no bigint, message string, status string"
_HEAD = re.compile(r"\r?\x0b")


RUN_CHARS = 1 << 25              # text of a connection's chunks that is sorted in memory
RUN_ROWS = 1 << 17
PAGE = 512                       # chunks of a run that are read back at once
OUT_CHARS, OUT_ROWS = 1 << 23, 10000


def _sorted_run(parts: list[pd.DataFrame]) -> list[tuple]:
    """((missing, seq), bytes) in the order of ``seq``, missing ones last; equal ones in order of arrival."""
    run = pd.concat(parts, ignore_index=True).sort_values("seq", kind="stable")
    return [((True, 0) if pd.isna(n) else (False, n), b) for n, b in zip(run["seq"].tolist(), run["bytes"].tolist())]


def _spilled(run: list[tuple]):
    f = tempfile.TemporaryFile()
    for k in range(0, len(run), PAGE):
        pickle.dump(run[k:k + PAGE], f, pickle.HIGHEST_PROTOCOL)
    f.seek(0)
    return f


def _read(f) -> Iterator[tuple]:
    while True:
        try:
            page = pickle.load(f)
        except EOFError:
            f.close()
            return
        yield from page


def in_order(batches: Iterator[pd.DataFrame], run_chars: int = RUN_CHARS, run_rows: int = RUN_ROWS) -> Iterator[str]:
    """The bytes of chunks in the order of their ``seq``."""
    runs, parts, chars, rows = [], [], 0, 0
    for b in batches:
        parts.append(b[["seq", "bytes"]])
        chars += int(b["bytes"].str.len().sum())
        rows += len(b)
        if chars >= run_chars or rows >= run_rows:
            runs.append(_spilled(_sorted_run(parts)))
            parts, chars, rows = [], 0, 0
    last = _sorted_run(parts) if parts else []
    for _, chunk in heapq.merge(*map(_read, runs), last, key=lambda x: x[0]):
        yield chunk


class FrameBuffer(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("buffer", "tail string, frames bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        st = self.state.get() if self.state.exists() else None
        tail, frames = (st[0], int(st[1])) if st is not None else ("", 0)
        out: dict[str, list] = {"frame_no": [], "message": [], "status": []}
        chars = 0
        for chunk in in_order(rows):
            parts = (tail + (chunk or "")).split("\x1c")
            for text in parts[:-1]:              # every part before an end byte is a frame
                m = _HEAD.match(text)
                out["frame_no"].append(frames)
                out["message"].append(text[m.end():] if m else None)
                out["status"].append("ok" if m else "bad_framing")
                frames += 1
                chars += len(text)
            tail = parts[-1]
            if chars >= OUT_CHARS or len(out["frame_no"]) >= OUT_ROWS:
                yield pd.DataFrame({"conn_id": key[0], **out})
                out, chars = {c: [] for c in out}, 0
        self.state.update((tail, frames))
        if out["frame_no"]:
            yield pd.DataFrame({"conn_id": key[0], **out})

    def close(self) -> None:
        pass


def frame_stream(chunks: DataFrame) -> DataFrame:
    """chunks(conn_id, seq, bytes) stream -> (conn_id, frame_no, message, status)."""
    return chunks.groupBy("conn_id").transformWithStateInPandas(
        statefulProcessor=FrameBuffer(), outputStructType=OUTPUT_SCHEMA, outputMode="Append", timeMode="None")
