"""The live tables: partial rewrites, batches that break off, held-back results."""

import os
import tempfile

import pytest
from pyspark.sql import functions as F

from renalyze.schemas import MEASUREMENTS, PATIENTS
from renalyze.streaming import ingest, sinks, tables

HEAD = "MSH|^~\\&|LAB|WEST WING|||{t}||{kind}|{cid}|2.5"


def adm(t, cid, mrn, sex="F"):
    return HEAD.format(t=t, kind="ADT^A01", cid=cid) + f"\rPID|1||{mrn}||ANY ONE||19700102|{sex}"


def res(t, cid, mrn, value, at=None):
    return HEAD.format(t=t, kind="ORU^R01", cid=cid) + f"\rPID|1||{mrn}\rOBR|1||||||{at or t}\rOBX|1|SN|CREATININE||{value}"


def parsed(spark, texts):
    return ingest.parse_texts(spark.createDataFrame([(t,) for t in texts], "raw string"))


def empty(spark):
    return spark.createDataFrame([], PATIENTS), spark.createDataFrame([], MEASUREMENTS)


def held_everything(spark, root, acks):
    """All that a run leaves: tables, quarantine, ACKs (without the clock)."""
    meas = sorted((r.mrn, str(r.creatinine_date), r.creatinine_result) for r in tables.snapshot(spark, root, "measurements").collect())
    pats = sorted(map(tuple, tables.snapshot(spark, root, "patients").collect()), key=str)
    held = sorted((r.control_id, r.reason, r.raw) for r in sinks.quarantined(spark, root).collect())
    sent = sorted(r.control_id for r in sinks._tagged(spark, acks, "msg_id string, control_id string, ack string").collect())
    return meas, pats, held, sent


BATCHES = [
    [res("20240101080000", "r1", 1, 50), adm("20240101090000", "a1", 1), res("20240101100000", "r2", 1, 60),
     res("20240101100000", "r3", 2, 70), "not a message", adm("20240101100000", "a9", 9, "U")],
    [adm("20240102080000", "a2", 2), res("20240102090000", "r4", 2, 75, "20240101100000"), res("20240102090000", "r5", 3, 80),
     res("20240102100000", "r6", 1, 61, "20240101100000"), res("20240102100000", "r7", 1, 9, "nodate")],
    [adm("20240103080000", "a3", 1, "M"), res("20240103090000", "r8", 1, 62)],
]


def run(spark, root, acks, batches=BATCHES):
    write = sinks.table_upsert_writer(root, *empty(spark), acks=acks, buckets=8)
    for k, texts in enumerate(batches):
        write(parsed(spark, texts), k)


@pytest.fixture(scope="module")
def clean(spark):
    d = tempfile.mkdtemp(prefix="renalyze-live-")
    run(spark, f"{d}/t", f"{d}/acks")
    return d, held_everything(spark, f"{d}/t", f"{d}/acks")


def test_batches_decide_every_message(spark, clean):
    meas, pats, held, sent = clean[1]
    assert meas == [("1", "2024-01-01 10:00:00", 61.0), ("1", "2024-01-03 09:00:00", 62.0), ("2", "2024-01-01 10:00:00", 75.0)]
    assert pats == [("1", 54, "M"), ("2", 54, "F")]
    assert [(c, r) for c, r, _ in held] == [("UNKNOWN", "unknown_type"), ("a9", "bad_sex"), ("r1", "unknown_patient"), ("r3", "unknown_patient"),
                                            ("r5", "unknown_patient"), ("r7", "bad_date")]
    assert {t for _, _, t in held} <= {t for b in BATCHES for t in b}
    assert len(held) + len(sent) == sum(map(len, BATCHES))


@pytest.mark.parametrize("step", ["table", "quarantine", "record", "commit", "acks", "done"])
@pytest.mark.parametrize("batch", [0, 1])
def test_a_batch_that_breaks_off_is_applied_once(spark, clean, monkeypatch, step, batch):
    """Stop at a step of a batch, apply it again, go on: as if nothing happened."""
    d = tempfile.mkdtemp(prefix="renalyze-crash-")
    root, acks = f"{d}/t", f"{d}/acks"
    write = sinks.table_upsert_writer(root, *empty(spark), acks=acks, buckets=8)
    for k in range(batch):
        write(parsed(spark, BATCHES[k]), k)

    class Stopped(Exception):
        pass

    def stop(*a, **k):
        raise Stopped

    own_json, own_changes = tables.write_json, sinks._write_changes

    def json_until(path_part):
        def write_json(s, path, value):
            if path_part in path:
                raise Stopped
            own_json(s, path, value)
        return write_json

    with monkeypatch.context() as m:
        tables.committed(spark, root) or tables.create(spark, root, *empty(spark), 8)
        if step == "table":                   # the first table is written, the second is not
            own_write, seen = tables.write_buckets, []

            def one(rows, r, table, version, buckets):
                if seen:
                    raise Stopped
                seen.append(table)
                own_write(rows, r, table, version, buckets)
            m.setattr(tables, "write_buckets", one)
        elif step == "quarantine":
            m.setattr(sinks, "_write_changes", lambda *a: own_changes(*a) and stop())
        elif step == "record":
            m.setattr(tables, "write_json", json_until("/_commits/"))
        elif step == "commit":
            m.setattr(tables, "commit", stop)
        elif step == "acks":
            m.setattr(sinks.scoring, "ack_outbox", stop)
        else:
            m.setattr(tables, "write_json", json_until(".done"))
        with pytest.raises(Stopped):
            write(parsed(spark, BATCHES[batch]), batch)
    for k in range(batch, len(BATCHES)):
        write(parsed(spark, BATCHES[k]), k)
    assert held_everything(spark, root, acks) == clean[1]


def test_replay_releases_results_of_admitted_patients(spark, clean):
    d = tempfile.mkdtemp(prefix="renalyze-replay-")
    root, acks = f"{d}/t", f"{d}/acks"
    run(spark, root, acks)
    assert sinks.replay_quarantine(spark, root, acks)
    meas, _, held, sent = held_everything(spark, root, acks)
    # r1 is stored late; r3's reading was corrected by r4 in the meantime and stays corrected
    assert meas == sorted([*clean[1][0], ("1", "2024-01-01 08:00:00", 50.0)])
    assert [c for c, _, _ in held] == ["UNKNOWN", "a9", "r5", "r7"]
    assert sorted(sent) == sorted([*clean[1][3], "r1", "r3"])
    assert not sinks.replay_quarantine(spark, root, acks)
    run(spark, root, acks, [[]] * 3 + [[adm("20240104080000", "a5", 3)]])
    assert sinks.replay_quarantine(spark, root, acks)
    assert [c for c, _, _ in held_everything(spark, root, acks)[2]] == ["UNKNOWN", "a9", "r7"]


def test_a_replay_that_breaks_off_has_no_further_effect(spark, clean, monkeypatch):
    d = tempfile.mkdtemp(prefix="renalyze-replay-")
    root, acks = f"{d}/t", f"{d}/acks"
    run(spark, root, acks)
    own = sinks.apply_batch
    with monkeypatch.context() as m:          # applied, but not marked as released
        def then_stop(*a, **k):
            own(*a, **k)
            raise RuntimeError
        m.setattr(sinks, "apply_batch", then_stop)
        with pytest.raises(RuntimeError):
            sinks.replay_quarantine(spark, root, acks)
    before = held_everything(spark, root, acks)[0]
    assert sinks.replay_quarantine(spark, root, acks)
    assert held_everything(spark, root, acks)[0] == before
    assert [c for c, _, _ in held_everything(spark, root, acks)[2]] == ["UNKNOWN", "a9", "r5", "r7"]


def test_untouched_buckets_keep_their_files(spark, clean):
    root = f"{clean[0]}/t"
    state = tables.committed(spark, root)
    assert state["version"] == len(BATCHES)
    one = tables.touched(spark.createDataFrame([("1",)], "mrn string"), 8)[0]
    two = tables.touched(spark.createDataFrame([("2",)], "mrn string"), 8)[0]
    assert one != two
    # the last batch is about patient 1 alone
    assert state["measurements"] == {str(one): 3, str(two): 2} and state["patients"] == {str(one): 3, str(two): 2}
    assert not os.path.exists(f"{root}/measurements/bucket={two}/version=3")


def test_expired_versions_go_and_readers_see_no_change(spark):
    d = tempfile.mkdtemp(prefix="renalyze-expire-")
    run(spark, f"{d}/t", f"{d}/acks")
    before = held_everything(spark, f"{d}/t", f"{d}/acks")
    assert tables.expire(spark, f"{d}/t", [tables.committed(spark, f"{d}/t")]) > 0
    assert held_everything(spark, f"{d}/t", f"{d}/acks") == before
    assert tables.expire(spark, f"{d}/t", [tables.committed(spark, f"{d}/t")]) == 0


def test_another_writer_in_between_moves_the_base(spark, monkeypatch):
    """A batch that broke off before its commit starts anew from what has been committed since."""
    d = tempfile.mkdtemp(prefix="renalyze-base-")
    root = f"{d}/t"
    tables.create(spark, root, *empty(spark), 8)
    with monkeypatch.context() as m:
        def stop(*a):
            raise RuntimeError
        m.setattr(sinks, "_write_changes", stop)
        with pytest.raises(RuntimeError):
            sinks.apply_batch(spark, root, parsed(spark, BATCHES[1]), "q/1")
    sinks.apply_batch(spark, root, parsed(spark, BATCHES[0]), "q/0")
    sinks.apply_batch(spark, root, parsed(spark, BATCHES[1]), "q/1")
    got = {r.mrn: r.creatinine_result for r in tables.snapshot(spark, root, "measurements").collect()}
    assert got == {"1": 61.0, "2": 75.0} and tables.latest_version(spark, root) == 2


def test_bad_frames_keep_their_text(spark):
    from renalyze.sources import files
    good = adm("20240101090000", "a1", 1)
    values = [good + "\x1c\r", "open " + good, "\x1c\rjunk", good + "\x1c\rjunk"]
    frames = files.frames(spark.createDataFrame([(v, "f") for v in values], "value string, source_file string"))
    rows = ingest.parse_frames(frames, keep_bad=True).select("raw", "route", "reason").collect()
    assert sorted((r.raw, r.route, r.reason) for r in rows) == sorted([
        (good, "admissions", None), ("open " + good, "quarantine", "trailing_data"),
        ("\x1c\rjunk", "quarantine", "bad_framing"), (good + "\x1c\rjunk", "quarantine", "bad_framing")])
    assert ingest.parse_frames(frames).count() == 1
    assert frames.where(F.col("status") == "ok").select("frame").first()[0] is None
