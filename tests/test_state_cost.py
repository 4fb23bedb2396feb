"""What a message costs in the patient state: small generated methods, times as integers, sums without fractions."""

import random
import re
from fractions import Fraction

import numpy as np
import pandas as pd
import pytest

from renalyze.streaming import blocks, ingest, state

from .test_patient_cells import Kept, _rows

MESSAGES = ["MSH|^~\\&|A|B|||20240101100000||ADT^A01|M1|2.5\rPID|1||7||P||19800101|F",
            "MSH|^~\\&|A|B|||20240101110000||ORU^R01|M2|2.5\rPID|1||7\rOBR|1||||||202401011055\rOBX|1|SN|CREATININE||81.5",
            "MSH|^~\\&|A|B|||bad||ORU^R01|M3|2.5\rPID|1||8\rOBR|1||||||20240101105530\rOBX|1|SN|CREATININE||NEG",
            "MSH|^~\\&|A|B|||20240101120000||ORU^R01|M4|2.5\rPID|1||9\rOBR|1||||||never\rOBX|1|SN|CREATININE||5"]


def test_the_jit_compiles_what_the_state_reads(spark):
    """HotSpot runs methods of 8,000 bytes or more interpreted."""
    parsed = ingest.parse_texts(spark.createDataFrame([(m,) for m in MESSAGES], "raw string"))
    patients = spark.createDataFrame([("8", 40, "M")], "mrn string, age int, sex string")
    rows = state.keyed_inputs(parsed, patients)
    was = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        text = spark.sparkContext._jvm.PythonSQLUtils.explainString(rows.select("*")._jdf.queryExecution(), "codegen")
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", was)
    sizes = [int(x) for x in re.findall(r"maxMethodCodeSize:(\d+)", text)]
    assert sizes and max(sizes) < 8000, sizes
    got = {r.control_id: r for r in rows.collect()}
    assert sorted(got) == ["M1", "M2", "M3"]
    assert (got["M1"].kind, got["M1"].mrn, got["M1"].age, got["M1"].sex, got["M1"].sex_ok, got["M1"].creatinine_date) == ("adm", "7", 44, "F", True, None)
    assert (got["M2"].kind, got["M2"].mrn, str(got["M2"].creatinine_date), got["M2"].creatinine_result, got["M2"].age) == ("res", "7", "2024-01-01 10:55:00", 81.5, None)
    assert (got["M3"].msg_time, got["M3"].creatinine_result, got["M3"].base_known, got["M3"].base_age) == (None, None, True, 40)


def test_times_as_microseconds_give_the_same_rows():
    batch = _rows(random.Random(3), range(4), 0, 60)
    batch.loc[5, "msg_time"] = pd.NaT
    plain = batch.assign(**{c: batch[c].to_numpy("datetime64[us]").astype(np.int64) for c in ("msg_time", "creatinine_date")})
    got = []
    for b in (batch, plain):
        p = state.PatientHistory(True)
        p.state, p.dates, p.values = Kept(), Kept(), Kept()
        got.append((pd.concat(list(p.handleInputRows((0,), iter([b]), None)), ignore_index=True), p.state.value))
    pd.testing.assert_frame_equal(got[0][0], got[1][0])
    assert repr(got[0][1]) == repr(got[1][1])
    out = got[1][0].set_index("control_id")
    assert pd.isna(out.loc["C5", "msg_time"]) and out["creatinine_date"].dtype == "Int64"
    want = {r.control_id: r.creatinine_date.value // 1000 for r in batch.itertuples()}
    assert out["creatinine_date"].to_dict() == want


@pytest.mark.parametrize("scale", [1.0, 1e-300, 1e120])
def test_sums_are_exact_without_fractions(scale):
    rng, sums, kept = random.Random(5), blocks.ExactSums(), []
    for _ in range(200):
        if kept and rng.random() < 0.3:
            sums._count(kept.pop(rng.randrange(len(kept))), -1)
        else:
            kept.append(rng.choice([rng.random() * scale, float(rng.randint(-9, 9)), 0.1]))
            sums._count(kept[-1], 1)
        s1, s2, n = sum(map(Fraction, kept)), sum(Fraction(v) ** 2 for v in kept), len(kept)
        assert (sums.s1, sums.s2) == (s1, s2)
        if n > 1:
            assert sums._mean_std(n) == (float(s1 / n), float((s2 - s1 * s1 / n) / (n - 1)) ** 0.5)
        again = blocks.ExactSums()
        again._begin_sums(Fraction(str(sums.s1)), Fraction(str(sums.s2)))           # as the state keeps them
        assert (again.s1, again.s2) == (s1, s2)
