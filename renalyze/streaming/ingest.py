"""Landing directory of MLLP captures -> parsed, routed message stream.

Stateless: the same row-local projections as the batch parser, so the
streaming plan has no shuffle until a stateful or keyed sink needs one.
A stream has no message number; the arrival order of a message is
``(MSH-7 time, control id)`` (then a hash of the text), carried as the struct
column ``msg_id`` so the batch operators (upserts, admission-before-result
checks) order by it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import parse as P
from ..sources import files


def parse_frames(frames: DataFrame, keep_bad: bool = False) -> DataFrame:
    """Good frames -> parsed messages (msg_id = arrival key (MSH-7 time,
    control id, hash of the text), taken from the parse itself: the text is
    split once); the MSH-7 text stands in for a missing OBR time.  With ``keep_bad`` the
    frames that are not good are routed to quarantine with their text and the
    framing step's status as the reason, so every frame is accounted for."""
    good = F.col("status") == "ok"
    src = (frames.select(F.col("message").alias("raw"), F.when(~good, F.col("frame")).alias("_frame"),
                         F.when(~good, F.col("status")).alias("_bad")) if keep_bad
           else frames.where(good).select(F.col("message").alias("raw")))
    parsed = P.parse_messages(src, default_to_msh_time=True)
    if keep_bad:
        bad = F.col("_bad").isNotNull()
        parsed = (parsed.withColumns({"raw": F.coalesce("raw", "_frame"), "reason": F.coalesce("_bad", "reason"),
                                      "route": F.when(bad, F.lit("quarantine")).otherwise(F.col("route"))})
                        .drop("_bad", "_frame"))
    return _keyed(parsed)


def parse_texts(texts: DataFrame) -> DataFrame:
    """Messages (``raw``) -> parsed messages, as ``parse_frames`` gives them."""
    return _keyed(P.parse_messages(texts.select("raw"), default_to_msh_time=True))


def _keyed(parsed: DataFrame) -> DataFrame:
    return parsed.withColumn("msg_id", F.struct("msg_time", "control_id", F.xxhash64("raw").alias("digest")))


def parsed_stream(spark: SparkSession, landing_dir: str, options: dict | None = None, keep_bad: bool = False) -> DataFrame:
    return parse_frames(files.stream_mllp_landing(spark, landing_dir, options), keep_bad)
