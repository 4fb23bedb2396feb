"""MLLP capture framing, frame reassembly, pager payload and ACK checks."""

import os
import tempfile

import pytest
from pyspark.sql import functions as F

from renalyze.functions import hl7
from renalyze.operators.reassemble import reassemble
from renalyze.sources import files

A01 = "MSH|^~\\&|LAB|WEST|||202403051500||ADT^A01|||2.5\rPID|1||90210||ANY ONE||19611130|F"
ORU = "MSH|^~\\&|LAB|WEST|||202403051517||ORU^R01|||2.5\rPID|1||90210\rOBR|1||||||202403051517\rOBX|1|SN|C||88.5"
A03 = "MSH|^~\\&|LAB|WEST|||202403060900||ADT^A03|||2.5\rPID|1||90210"


def frame(m):
    return "\x0b" + m + "\x1c\r"


def _capture(spark, content: str):
    d = tempfile.mkdtemp(prefix="renalyze-cap-")
    with open(os.path.join(d, "part-0.hl7"), "w", newline="") as fh:
        fh.write(content)
    return files.scan_mllp_capture(spark, d).collect()


def test_three_good_frames(spark):
    rows = _capture(spark, "".join(frame(m) for m in [A01, ORU, A03]))
    assert sorted(r.message for r in rows) == sorted([A01, ORU, A03])
    assert {r.status for r in rows} == {"ok"}


def test_open_last_frame_is_trailing_data(spark):
    rows = _capture(spark, frame(A01) + "\x0b" + ORU)
    assert sorted(r.status for r in rows) == ["ok", "trailing_data"]


def test_junk_before_first_start_byte(spark):
    rows = _capture(spark, "junk" + frame(A01))
    assert sorted(r.status for r in rows) == ["ok", "trailing_data"]


def test_strict_reader_sees_an_empty_frame(spark):
    d = tempfile.mkdtemp(prefix="renalyze-cap-")
    for name, text in (("a", frame(A01)), ("b", frame(A01) + "\x0b" + frame(ORU))):
        with open(os.path.join(d, name), "w", newline="") as fh:
            fh.write(text)
    assert files.scan_mllp_capture(spark, os.path.join(d, "a"), strict=True).count() == 1
    with pytest.raises(ValueError):
        files.scan_mllp_capture(spark, d, strict=True)


def test_capture_round_trip(spark):
    d = tempfile.mkdtemp(prefix="renalyze-cap-")
    src = spark.createDataFrame([(A01,), (ORU,), (A03,)], "raw string")
    files.write_capture(src, os.path.join(d, "c"))
    got = files.scan_mllp_capture(spark, os.path.join(d, "c")).collect()
    assert sorted(r.message for r in got) == sorted([A01, ORU, A03])


@pytest.mark.parametrize("cut_step", [1, 7, 50])
def test_reassembly_from_chunks_cut_anywhere(spark, cut_step):
    stream = "".join(frame(m) for m in [A01, ORU, A03])
    chunks = [(1, i, stream[p:p + cut_step]) for i, p in enumerate(range(0, len(stream), cut_step))]
    df = spark.createDataFrame(chunks, "conn_id long, seq long, bytes string")
    got = reassemble(df).orderBy("frame_no").collect()
    assert [r.message for r in got] == [A01, ORU, A03]
    assert {r.status for r in got} == {"ok"}


def test_reassembly_open_tail(spark):
    stream = frame(A01) + "\x0b" + ORU[:20]
    df = spark.createDataFrame([(9, 0, stream[:10]), (9, 1, stream[10:])], "conn_id long, seq long, bytes string")
    got = reassemble(df).orderBy("frame_no").collect()
    assert [r.status for r in got] == ["ok", "trailing_data"]


PAYLOADS = [
    ("8086", True, None),
    ("X77", False, "bad_mrn"),
    ("8086,202403051517", True, None),
    ("77,2024/03/05 15:17", False, "bad_time"),
    ("X77,202403051517", False, "bad_mrn"),
    ("8086,202403051517,more", False, "too_many_parts"),
]


def test_alert_payload_validation(spark):
    df = spark.createDataFrame([(p,) for p, _, _ in PAYLOADS], "payload string")
    got = [(r.v.ok, r.v.error) for r in df.select(hl7.validate_alert_payload(F.col("payload")).alias("v")).collect()]
    assert got == [(ok, err) for _, ok, err in PAYLOADS]


def test_alert_timestamp_and_payload(spark):
    df = spark.createDataFrame([("2024-11-19T04:05:06.789",), ("20240305 15:17",)], "t string")
    got = [r.p for r in df.select(hl7.alert_payload(F.lit(42), F.col("t")).alias("p")).collect()]
    assert got == ["42,20241119040506", "42,202403051517"]


ACKS = [
    ("MSH|^~\\&|||||20240306081500||ACK|||2.5\rMSA|AA", True, None),
    ("MSA|AA", False, "no_msh"),
    ("MSH|^~\\&|||||20240306081500||ACK|||2.5", False, "no_msa"),
    ("MSH|^~\\&|||||20240306081500||ACK|||2.5\rMSA", False, "short_msa"),
    ("MSH|^~\\&|||||20240306081500||ACK|||2.5\rMSA|AE", False, None),
]


def test_ack_validation(spark):
    df = spark.createDataFrame([(a,) for a, _, _ in ACKS], "a string")
    got = [(r.v.acked, r.v.error) for r in df.select(hl7.validate_ack(F.col("a")).alias("v")).collect()]
    assert got == [(ok, err) for _, ok, err in ACKS]


def test_streaming_reassembly_keeps_only_the_tail(spark):
    from renalyze.streaming.frames import frame_stream
    from renalyze.streaming.sinks import run_available_now

    stream = "".join(frame(m) for m in [A01, ORU, A03]) + "\x0b" + A01[:15]   # open last frame
    rows = [(5, i, stream[p:p + 11]) for i, p in enumerate(range(0, len(stream), 11))]
    d = tempfile.mkdtemp(prefix="renalyze-chunks-")
    df = spark.createDataFrame(rows, "conn_id long, seq long, bytes string")
    df.write.parquet(os.path.join(d, "in"))
    src = spark.readStream.schema(df.schema).parquet(os.path.join(d, "in"))
    run_available_now(frame_stream(src), os.path.join(d, "ck"), sink_path=os.path.join(d, "out"))
    got = spark.read.parquet(os.path.join(d, "out")).orderBy("frame_no").collect()
    assert [(r.frame_no, r.message, r.status) for r in got] == [(0, A01, "ok"), (1, ORU, "ok"), (2, A03, "ok")]


def test_strict_capture_scan_raises_on_bad_framing(spark):
    d = tempfile.mkdtemp(prefix="renalyze-cap-")
    with open(os.path.join(d, "part-0.hl7"), "w", newline="") as fh:
        fh.write(frame(A01) + "\x0b" + ORU)              # open last frame
    with pytest.raises(ValueError, match="badly framed"):
        files.scan_mllp_capture(spark, d, strict=True)
    good = tempfile.mkdtemp(prefix="renalyze-cap-")
    with open(os.path.join(good, "part-0.hl7"), "w", newline="") as fh:
        fh.write(frame(A01) + frame(A03))
    assert files.scan_mllp_capture(spark, good, strict=True).count() == 2
