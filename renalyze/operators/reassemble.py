"""T2 (batch): rebuild MLLP frames from byte chunks of connections.

Input ``chunks(conn_id, seq, bytes)``: a connection's byte stream cut
anywhere (a frame may span chunks, a chunk may hold several frames).

Plan, with no per-connection string ever built:

1. split every chunk on the end byte 0x1c (row-local ``posexplode``);
2. number the frames: a fragment belongs to frame ``k`` = end bytes before
   it in its connection.  The count is a prefix sum over chunks done in two
   levels -- per block of ``block`` chunks (partial aggregate), a small
   running sum over blocks, then a running sum inside each block -- so even
   a connection carrying a third of all bytes is split over many tasks;
3. ``groupBy(conn_id, frame)`` with an ordered concat of its fragments
   (a group is one frame);
4. strip ``^\\r?\\x0b``; the group after the last end byte must be a lone
   ``\\r`` (closed stream), anything else there is ``trailing_data``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

DEFAULT_BLOCK = 4096


def frame_numbers(chunks: DataFrame, block: int = DEFAULT_BLOCK) -> DataFrame:
    """(conn_id, seq, pos, frag, frame_no, total_ends)."""
    parts = chunks.select("conn_id", "seq", F.posexplode(F.split("bytes", "\x1c", -1)).alias("pos", "frag"))
    per_chunk = (chunks.select("conn_id", "seq", (F.size(F.split("bytes", "\x1c", -1)) - 1).alias("n_ends"))
                       .withColumn("blk", F.floor(F.col("seq") / block)))
    blocks = per_chunk.groupBy("conn_id", "blk").agg(F.sum("n_ends").alias("blk_ends"))
    wb = Window.partitionBy("conn_id").orderBy("blk").rowsBetween(Window.unboundedPreceding, -1)
    wt = Window.partitionBy("conn_id")
    blocks = blocks.select("conn_id", "blk",
                           F.coalesce(F.sum("blk_ends").over(wb), F.lit(0)).alias("blk_before"),
                           F.sum("blk_ends").over(wt).alias("total_ends"))
    wc = Window.partitionBy("conn_id", "blk").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    chunk_before = (per_chunk.withColumn("in_blk_before", F.coalesce(F.sum("n_ends").over(wc), F.lit(0)))
                             .join(blocks, ["conn_id", "blk"])
                             .select("conn_id", "seq", (F.col("blk_before") + F.col("in_blk_before")).alias("before"),
                                     "total_ends"))
    return (parts.join(chunk_before, ["conn_id", "seq"])
                 .select("conn_id", "seq", "pos", "frag",
                         (F.col("before") + F.col("pos")).alias("frame_no"), "total_ends"))


def reassemble(chunks: DataFrame, block: int = DEFAULT_BLOCK) -> DataFrame:
    """-> (conn_id, frame_no, message, status) with status ok / bad_framing /
    trailing_data; a cleanly closed stream yields no tail row."""
    fr = frame_numbers(chunks, block)
    grouped = fr.groupBy("conn_id", "frame_no").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "pos", "frag"))),
                                 lambda x: x["frag"]), "").alias("text"),
        F.first("total_ends").alias("total_ends"))
    is_tail = F.col("frame_no") == F.col("total_ends")
    body = F.regexp_extract("text", "^\\r?\\x0b([\\s\\S]*)$", 1)
    good = F.col("text").rlike("^\\r?\\x0b")
    status = (F.when(is_tail, F.lit("trailing_data"))
               .when(good, F.lit("ok"))
               .otherwise(F.lit("bad_framing")))
    out = grouped.where(~(is_tail & F.col("text").isin("\r", "")))
    return out.select("conn_id", "frame_no",
                      F.when(good & ~is_tail, body).alias("message"), status.alias("status"))
