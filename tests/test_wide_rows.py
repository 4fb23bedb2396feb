"""Wide histories with a fixed number of plan columns, and the training matrix in long form."""

import datetime as dt
import os
import random
import tempfile

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from renalyze import cli
from renalyze.operators import features as feat
from renalyze.operators import reshape as R
from renalyze.plans.load import history_tables
from renalyze.schemas import FEATURE_COLUMNS
from renalyze.sources import files
from renalyze.streaming import tables

T0 = dt.datetime(2024, 1, 1)
SCHEMA = "mrn string, creatinine_date timestamp, creatinine_result double"


def readings(rng, patients, longest, negative=False):
    out = []
    for m in range(patients):
        n = longest if m == 0 else rng.randint(1, longest)
        for k in range(n):
            v = None if rng.random() < 0.1 else rng.randint(-900 if negative else 0, 9000) / 100
            out.append((f"p{m}", T0 + dt.timedelta(hours=13 * k), v))
    return out


def test_wide_csv_round_trip(spark):
    rows = readings(random.Random(1), 8, 9)
    df = spark.createDataFrame(rows, SCHEMA)
    wide = R.history_rows(df).withColumn("age", F.lit(40)).unionByName(
        spark.createDataFrame([("empty", [], None)], R.history_rows(df).schema.add("age", "integer")))
    path = os.path.join(tempfile.mkdtemp(prefix="renalyze-wide-"), "h")
    files.write_wide_history(wide, path, ["age"])
    lines = [r.value for r in spark.read.text(path).collect()]
    assert len({x.count(",") for x in lines}) == 1                      # a rectangular file, without quotes
    assert not any('"' in x or "\x00" in x for x in lines)
    back = files.scan_wide_rows(spark, path)
    assert {(r.mrn, r.age) for r in back.collect()} == {(m, "40") for m, _, _ in rows} | {("empty", None)}
    long = R.unpivot_rows(back, keep_empty=True).where("creatinine_date IS NOT NULL")
    got = sorted((r.mrn, r.slot, r.creatinine_date, r.creatinine_result) for r in long.collect())
    place, want = {}, []
    for m, d, v in rows:
        place[m] = place.get(m, -1) + 1
        want.append((m, place[m], str(d), None if v is None else str(v)))
    assert got == sorted(want)
    same = spark.read.option("header", True).csv(path)                  # any CSV reader sees the same file
    assert same.count() == wide.count() and same.columns[-1] == "age"


def test_plan_width_does_not_grow_with_the_history(spark):
    plans = []
    for longest in (3, 60):
        path = os.path.join(tempfile.mkdtemp(prefix="renalyze-wide-"), "h")
        files.write_wide_history(R.history_rows(spark.createDataFrame(readings(random.Random(2), 3, longest), SCHEMA)), path)
        back = R.unpivot_rows(files.scan_wide_rows(spark, path))
        plans.append(len(back._jdf.queryExecution().optimizedPlan().toString().split("\n")))
        assert len(back.columns) == 4 and len(files.scan_wide_rows(spark, path).columns) == 2
    assert plans[0] == plans[1]


def write(lines):
    path = os.path.join(tempfile.mkdtemp(prefix="renalyze-wide-"), "h.csv")
    with open(path, "w") as f:
        f.write("\n".join(lines) + "\n")
    return path


HEADER = "mrn,creatinine_date_0,creatinine_result_0,creatinine_date_1,creatinine_result_1"


def test_bad_cells_are_set_aside(spark):
    path = write([HEADER, "1,2024-01-01 00:00:00,5.5,2024-01-02 00:00:00,x", "2,nodate,4,,", "3,2024-01-01 00:00:00,,2024-01-03 00:00:00,7",
                  '"4","2024-01-01 00:00:00","8",,', ",2024-01-01 00:00:00,1,,", "1,2024-01-01 00:00:00,6.5,,"])
    d = tempfile.mkdtemp(prefix="renalyze-load-")
    assert cli.load_history(spark, path, d)
    pats = [r.mrn for r in tables.snapshot(spark, d, "patients").collect()]
    assert sorted(pats) == ["1", "2", "3", "4"]
    got = {(r.mrn, str(r.creatinine_date), r.creatinine_result) for r in tables.snapshot(spark, d, "measurements").collect()}
    assert {g for g in got if g[0] != "1"} == {("3", "2024-01-03 00:00:00", 7.0), ("4", "2024-01-01 00:00:00", 8.0)}
    assert len([g for g in got if g[0] == "1"]) == 1
    bad = {(r.mrn, r.slot, r.reason) for r in spark.read.parquet(f"{d}/bad_cells").collect()}
    assert bad == {("1", 1, "bad_result"), ("2", 0, "bad_date")}
    assert not cli.load_history(spark, path, d)                         # the gate looks at both tables


def test_header_cases(spark):
    later = write(["age,mrn,creatinine_date_2,creatinine_result_2", "50,1,2024-01-01 00:00:00,3"])
    assert [(r.mrn, r.age, r.slot) for r in R.unpivot_rows(files.scan_wide_rows(spark, later), extra=["age"]).collect()] == [("1", "50", 2)]
    only = files.scan_wide_rows(spark, write([HEADER]))
    assert history_tables(only)[1].count() == 0
    for bad in (["mrn,x", "1,2"], ["mrn,creatinine_result_0,creatinine_date_0", "1,2,3"]):
        with pytest.raises(ValueError):
            files.scan_wide_rows(spark, write(bad))


def padded(rows):
    """The training matrix as the wide frame computes it."""
    by = {}
    for m, d, v in rows:
        by.setdefault(m, []).append((d, 0.0 if v is None else v))
    k = max(map(len, by.values()))
    out = {}
    for m, r in by.items():
        s = pd.Series([v for _, v in sorted(r)] + [0.0] * (k - len(r)))
        step = s.diff().max()
        out[m] = [s.mean(), s.median(), s.max(), s.min(), 0.0 if pd.isna(step) else step, s.std() if k > 1 else None, s.iloc[-1]]
    return out


@pytest.mark.parametrize("seed,patients,longest,negative", [(1, 12, 9, False), (2, 12, 8, True), (3, 5, 1, True), (4, 1, 7, True), (5, 20, 2, True)])
def test_training_statistics_equal_the_padded_frame(spark, seed, patients, longest, negative):
    rows = readings(random.Random(seed), patients, longest, negative)
    got = feat.training_statistics(spark.createDataFrame(rows, SCHEMA)).collect()
    want = padded(rows)
    assert len(got) == len(want)
    for r in got:
        for c, w in zip(FEATURE_COLUMNS, want[r.mrn]):
            assert (r[c] is None and w is None) or r[c] == pytest.approx(w, rel=1e-9, abs=1e-9), (r.mrn, c)
        n, d = r.most_recent, r.creatinine_min
        assert r.rv1_ratio == (pytest.approx(n / d) if d else None if n == 0 else np.copysign(np.inf, n))


def test_training_statistics_equal_the_wide_operator(spark):
    df = spark.createDataFrame(readings(random.Random(9), 10, 11), SCHEMA)
    wide = feat.features_training(R.pivot_history(df, 11))
    a = {r.mrn: r for r in wide.select("mrn", *FEATURE_COLUMNS).collect()}
    for r in feat.training_statistics(df).collect():
        for c in FEATURE_COLUMNS:
            assert r[c] == (None if a[r.mrn][c] is None else pytest.approx(a[r.mrn][c], rel=1e-9, abs=1e-9))
    slots = {(r.mrn, r.slot): r for r in feat.training_slots(df).collect()}
    for r in wide.collect():
        for i in range(50):
            s = slots.get((r.mrn, i))
            assert r[f"creatinine_date_{i}"] == (s.relative_seconds if s else 0.0)
            assert r[f"creatinine_result_{i}"] == (s.creatinine_result if s else 0.0)
    assert {r.width for r in slots.values()} == {50}
