"""Patients that share a cell of the state: one state row, each replayed by itself."""

import random
import tempfile

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from renalyze import bindings as B
from renalyze.schemas import FEATURE_COLUMNS
from renalyze.streaming import state

from .conftest import SF_SMALL


class Kept:
    """A value or map state in memory, with the number of calls."""

    def __init__(self):
        self.value, self.map, self.calls = None, {}, 0

    def get(self):
        self.calls += 1
        return self.value

    def exists(self):
        self.calls += 1
        return self.value is not None

    def update(self, value):
        self.calls += 1
        self.value = value

    def getValue(self, k):
        return self.map[k]

    def containsKey(self, k):
        return k in self.map

    def updateValue(self, k, v):
        self.map[k] = v

    def removeKey(self, k):
        del self.map[k]


def _rows(rng, patients, first, n):
    rows = [(str(p), "res", pd.Timestamp("2024-01-01") + pd.Timedelta(minutes=first + k), f"C{first + k}", p % 3 > 0, True,
             pd.Timestamp("2024-01-01") + pd.Timedelta(hours=rng.randint(0, 40)), None if rng.random() < 0.1 else rng.randint(1, 900) / 10,
             None, None, 40, "F") for k, p in enumerate(rng.choice(patients) for _ in range(n))]
    return pd.DataFrame(rows, columns=["mrn", "kind", "msg_time", "control_id", "base_known", "sex_ok", "creatinine_date",
                                       "creatinine_result", "age", "sex", "base_age", "base_sex"])


@pytest.mark.parametrize("inline, block", [(512, 256), (3, 2)])
def test_patients_of_a_cell_do_not_mix(inline, block):
    rng = random.Random(inline)
    p = state.PatientHistory(False, inline, block)
    p.state, p.dates, p.values = Kept(), Kept(), Kept()
    stored = pd.DataFrame({"cell": 0, "mrn": ["1", "2", "2", "9"], "creatinine_date": pd.Timestamp("2023-01-01") + pd.to_timedelta([0, 0, 5, 1], "h"),
                           "creatinine_result": [4.0, 5.0, np.nan, 7.0]})
    p.handleInitialState((0,), stored, None)
    seen = {m: {} for m in map(str, range(12))}
    for r in stored.itertuples():
        seen[r.mrn][r.creatinine_date] = r.creatinine_result
    for turn in range(3):
        batch = _rows(rng, range(2 + 4 * turn, 6 + 3 * turn), 1000 * turn, 80)
        p.state.calls = 0
        got = pd.concat(list(p.handleInputRows((0,), iter([batch]), None)), ignore_index=True)
        assert p.state.calls == 2                           # read once and written once, whatever the number of patients
        got = {r["control_id"]: r for _, r in got.iterrows()}
        assert len(got) == len(batch)
        for r in batch.itertuples():
            g = got[r.control_id]
            assert g["mrn"] == r.mrn
            if not r.base_known:
                assert g["status"] == "unknown_patient" and pd.isna(g["n_readings"])
                continue
            seen[r.mrn][r.creatinine_date] = np.nan if r.creatinine_result is None else r.creatinine_result
            want = state.history_features(np.array([v for _, v in sorted(seen[r.mrn].items())], float))
            assert g["n_readings"] == want["n_readings"]
            for c in FEATURE_COLUMNS:
                assert g[c] == pytest.approx(want[c], rel=1e-9, abs=1e-9), c
    assert "9" in {e[0] for e in p.state.value[0]}          # a patient without messages keeps its readings


def test_the_number_of_cells_does_not_change_the_rows(spark):
    from renalyze.sources import files
    from renalyze.streaming import ingest, sinks
    d = tempfile.mkdtemp(prefix="renalyze-cells-")
    raw = B.hl7_raw(spark, SF_SMALL)
    for i, (a, b) in enumerate([(0, 500), (500, 10**9)]):
        files.write_capture(raw.where((F.col("msg_id") >= a) & (F.col("msg_id") < b)).coalesce(1), f"{d}/landing/part{i}")
    opts = {"maxFilesPerTrigger": "1", "recursiveFileLookup": "true"}
    nobody = B.patients(spark, SF_SMALL).where("false")
    runs = []
    for cells in (1, 1 << 14):
        feats = state.history_stream(ingest.parsed_stream(spark, f"{d}/landing", opts), nobody, defer=True, cells=cells)
        sinks.run_available_now(feats, f"{d}/ck{cells}", sink_path=f"{d}/out{cells}")
        runs.append(sorted((tuple(r) for r in spark.read.parquet(f"{d}/out{cells}").collect()), key=str))
    assert runs[0] == runs[1] and {r[4] for r in runs[0]} == {"released", "accepted", "unknown_patient"}
