"""Features as of each arrival, in one piece and in blocks, against plain Python."""

import datetime as dt
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from renalyze.operators import asof, vectors
from renalyze.operators import features as feat
from renalyze.schemas import FEATURE_COLUMNS
from renalyze.streaming.state import history_features

T0 = dt.datetime(2024, 1, 1)
SCHEMA = "mrn string, k long, d timestamp, v double, live boolean, n string"


def plain(rows):
    """Per arrival: the history is the last value of every date so far."""
    out, held = {}, {}
    for mrn, k, d, v, live, _ in sorted(rows, key=lambda r: (r[0], r[1])):
        h = held.setdefault(mrn, {})
        same = d in h and (h[d] == v or (h[d] is None and v is None))
        h[d] = v
        vals = np.array([math.nan if h[x] is None else h[x] for x in sorted(h)])
        if live:
            out[mrn, k] = (same, history_features(vals))
    return out


def check(got, rows):
    want = plain(rows)
    assert len(got) == len(want)
    for r in got:
        same, f = want[r.mrn, r.k]
        assert r.repeat == same and r.n == "own", (r, same)
        for c in ("n_readings", *FEATURE_COLUMNS):
            assert r[c] == pytest.approx(f[c], rel=1e-9, abs=1e-9), (r.mrn, r.k, c, r, f)


def history(rng, mrn, n, dates, order):
    """n arrivals on up to ``dates`` dates: late, overwriting, repeated, missing."""
    out = []
    for k in range(n):
        d = {"late": rng.randrange(dates), "up": k, "down": dates - k, "in and out": dates // 2 + (k if k % 2 else -k)}[order]
        v = None if rng.random() < 0.1 else float(rng.choice([rng.randint(1, 5), rng.randint(1, 90000) / 100]))
        out.append((mrn, k, T0 + dt.timedelta(hours=d), v, rng.random() < 0.9, "own"))
    return out


def as_of(spark, rows, block):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    return asof.features_as_of(df, F.col("k"), "d", "v", F.col("live"), block).collect()


def test_whole_patients(spark):
    rng = random.Random(2)
    rows = [r for m in range(40) for r in history(rng, f"p{m}", rng.randint(1, 40), 25, rng.choice(["late", "up", "down", "in and out"]))]
    check(as_of(spark, rows, 1000), rows)


def test_pieces_do_not_cut_patients(spark, monkeypatch):
    import pandas as pd
    monkeypatch.setattr(asof, "BATCH", 7)
    frames = [pd.DataFrame({"mrn": list(s)}) for s in ("aab", "bbb", "bbbbbbb", "ccdd", "d", "")]
    got = ["".join(p["mrn"]) for p in asof._pieces(iter(frames))]
    assert "".join(got) == "aabbbbbbbbbbbccddd"
    assert all(len(set(a[-1]) & set(b[0])) == 0 for a, b in zip(got, got[1:]))


@pytest.mark.parametrize("block,n,dates,order", [(4, 90, 30, "late"), (7, 120, 400, "late"), (8, 60, 70, "up"), (8, 60, 70, "down"),
                                                 (5, 70, 200, "in and out"), (3, 50, 3, "late"), (64, 65, 40, "late")])
def test_large_patients_in_blocks(spark, block, n, dates, order):
    rng = random.Random(block * n)
    rows = history(rng, "hot", n, dates, order)
    rows += [r for m in range(4) for r in history(rng, f"p{m}", rng.randint(1, block), 10, "late")]
    check(as_of(spark, rows, block), rows)


def test_odd_values(spark):
    inf = float("inf")
    vals = [5.0, inf, 3.0, -inf, 4.0, None, 2.0, 2.0, 2.0, 1e300, 0.0]
    rows = [("a", k, T0 + dt.timedelta(hours=k % 7), v, True, "own") for k, v in enumerate(vals)]
    rows += [("b", k, T0 + dt.timedelta(hours=k), 12.34, True, "own") for k in range(9)]
    rows += [("c", 0, T0, None, True, "own")]
    for block in (100, 4):
        got = {(r.mrn, r.k): r for r in as_of(spark, rows, block)}
        assert all(got["b", k].creatinine_std == 0.0 and got["b", k].creatinine_mean == 12.34 for k in range(9))
        assert got["a", 1].creatinine_mean == inf and got["a", 1].creatinine_max == inf
        assert got["a", 3].creatinine_mean is None and got["a", 3].creatinine_min == -inf
        assert got["a", 10].n_readings == 6 and got["a", 10].most_recent == 2.0
        assert got["c", 0].n_readings == 0 and got["c", 0].creatinine_max == 0.0


def test_empty(spark):
    assert as_of(spark, [], 5) == []


def test_running_features_in_blocks_equal_the_streamed_pass(spark, monkeypatch):
    rng = random.Random(4)
    rows = [("hot", T0 + dt.timedelta(minutes=7 * k), None if rng.random() < 0.1 else rng.randint(1, 9000) / 100) for k in range(400)]
    rows += [(f"p{m}", T0 + dt.timedelta(days=k), rng.randint(1, 9000) / 100) for m in range(9) for k in range(12)]
    df = spark.createDataFrame(rows, "mrn string, creatinine_date timestamp, creatinine_result double")
    want = {(r.mrn, r.creatinine_date): r for r in feat.running_features(df, "stream").collect()}
    for got in (feat.running_features(df), asof.features_as_of(df, F.col("creatinine_date"), "creatinine_date", "creatinine_result", None, 50)):
        got = got.collect()
        assert len(got) == len(rows)
        for r in got:
            w = want[r.mrn, r.creatinine_date]
            assert r.n_readings == w.n_readings
            assert all(r[c] == pytest.approx(w[c], rel=1e-9, abs=1e-9) for c in FEATURE_COLUMNS)


# --- the array kernels -------------------------------------------------------

def test_kth_in_prefix():
    rng = np.random.default_rng(1)
    for _ in range(100):
        rank, sign, alive, asked = [], [], [], []
        for i in range(int(rng.integers(1, 40))):
            if alive and rng.random() < 0.4:
                rank.append(alive.pop(int(rng.integers(len(alive)))))
                sign.append(-1)
            else:
                alive.append(int(rng.integers(0, 9)))
                rank.append(alive[-1])
                sign.append(1)
            if alive:
                k = int(rng.integers(len(alive)))
                asked.append((i + 1, k, sorted(alive)[k]))
        hi, k, want = map(np.array, zip(*asked))
        assert (vectors.kth_in_prefix(np.array(rank), np.array(sign), np.zeros(len(hi), int), hi, k) == want).all()


def test_covering_max_and_nearest_smaller():
    rng = np.random.default_rng(2)
    for _ in range(100):
        n, m = int(rng.integers(1, 30)), int(rng.integers(0, 20))
        s = rng.integers(0, n, m)
        e, v = np.minimum(n, s + rng.integers(0, n + 1, m)), rng.random(m)
        want = [max([v[j] for j in range(m) if s[j] <= i < e[j]], default=-1.0) for i in range(n)]
        assert np.array_equal(vectors.covering_max(n, s, e, v, -1.0), want)
        f, cuts = rng.permutation(n), sorted({0, *rng.integers(0, n, 3).tolist()})
        first = np.array([max(c for c in cuts if c <= i) for i in range(n)])
        want = [max([j for j in range(first[i], i) if f[j] < f[i]], default=-1) for i in range(n)]
        assert vectors.nearest_smaller(f, first).tolist() == want
