"""Results neither change with the number of readings nor get lost."""

import inspect
import statistics
import tempfile

from pyspark.sql import functions as F

from renalyze import bindings
from renalyze.operators.parse import parse_messages
from renalyze.plans import alerts as AL
from renalyze.sources import files
from renalyze.streaming import ingest, sinks, state
from tests.conftest import SF_SMALL


def _history_class():
    return next(c for _, c in inspect.getmembers(state, inspect.isclass)
                if c.__module__ == state.__name__ and hasattr(c, "upsert") and hasattr(c, "features"))


def test_std_after_correction_of_long_history():
    h = _history_class()([])
    values = [50.0 + (k * 37 % 151) for k in range(300)]
    for k, v in enumerate(values):
        h.upsert(k, 1e12 if k == 17 else v)
    h.upsert(17, values[17])
    f = h.features()
    assert abs(f["creatinine_std"] - statistics.stdev(values)) < 1e-9
    assert abs(f["creatinine_mean"] - statistics.fmean(values)) < 1e-9


def test_results_of_never_admitted_patients_are_quarantined(spark):
    raw = bindings.hl7_raw(spark, SF_SMALL).where(F.col("raw").contains("ORU^R01"))
    nobody = bindings.patients(spark, SF_SMALL).where(F.lit(False))
    a = AL.apply_messages(parse_messages(raw), nobody)
    assert a.measurements.count() == 0
    assert a.quarantine.where("reason = 'unknown_patient'").count() > 0


def test_stored_readings_begin_the_stream_state(spark):
    for k, v in state.STATE_CONF.items():
        spark.conf.set(k, v)
    d = tempfile.mkdtemp(prefix="renalyze-stored-")
    raw = bindings.hl7_raw(spark, SF_SMALL).limit(300)
    files.write_capture(raw, f"{d}/landing")
    pats = bindings.patients(spark, SF_SMALL)
    day = F.lit("1990-01-01").cast("timestamp")
    stored = pats.select("mrn", F.explode(F.array(F.lit(0), F.lit(1))).alias("k")).select(
        "mrn", F.date_add(day, F.col("k")).cast("timestamp").alias("creatinine_date"), F.lit(0.5).alias("creatinine_result"))
    got = {}
    for name, m in (("with", stored), ("without", None)):
        feats = state.history_stream(ingest.parsed_stream(spark, f"{d}/landing"), pats, m)
        sinks.run_available_now(feats, f"{d}/ck-{name}", sink_path=f"{d}/{name}")
        got[name] = {(r.mrn, r.control_id): r for r in spark.read.parquet(f"{d}/{name}").where("status = 'accepted'").collect()}
    assert got["with"].keys() == got["without"].keys() and got["with"]
    known = {r.mrn for r in pats.collect()}
    for key, r in got["with"].items():
        assert r.n_readings - got["without"][key].n_readings == (2 if key[0] in known else 0)
    assert any(key[0] in known for key in got["with"])
