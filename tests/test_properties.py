"""Property and metamorphic checks: the Spark parse against a
plain-Python model of the sequential reader on generated messages, and
feature invariance under arrival permutations, frame reassembly against a
model of the framing rule on randomly cut streams."""

import datetime as dt
import random

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from renalyze.operators import features as feat
from renalyze.operators import parse as P
from renalyze.operators import store

DEFAULT = "20990101000000"


# ---------------------------------------------------------------- model

def _int_or_none(text):
    t = text.strip()
    if t[:1] in "+-":
        t = t[1:]
    return int(text) if t.isdigit() else None


def _float_or_none(text):
    t = text.strip().lower()
    body = t[1:] if t[:1] in "+-" else t
    if body in ("inf", "infinity"):
        return float(t)
    if body == "nan" or not body or "_" in body:
        return None
    try:
        return float(t)
    except ValueError:
        return None


REASONS = {          # the first that holds
    "bad_mrn": lambda m: None in m["numbers"].values(),
    "unknown_type": lambda m: m["type"] not in ROUTE,
    "no_mrn": lambda m: m["type"] == "ADT^A01" and m["mrn"] is None,
    "no_demographics": lambda m: m["type"] == "ADT^A01" and not m["demographics"],
    "no_result": lambda m: m["type"] == "ORU^R01" and not m["tests"],
}
ROUTE = {"ADT^A01": "admissions", "ADT^A03": "discharges", "ORU^R01": "results"}


def model(message: str):
    """(route, reason, mrn, [(value, time)]) of one message, as statements
    about places: what a segment means is given by the last segment of a kind before it."""
    rows = [s.split("|") for s in message.strip(" \t\n\r\x0b\x0c").split("\r")]
    places = {name: [i for i, r in enumerate(rows) if r[0] == name] for name in ("MSH", "PID", "OBR", "OBX")}

    def cell(i, k):
        return rows[i][k] if i is not None and len(rows[i]) > k else ""

    def last(candidates, before):
        return max((i for i in candidates if i < before), default=None)

    def type_before(i):
        return cell(last(places["MSH"], i), 8)

    end = len(rows)
    numbers = {i: _int_or_none(cell(i, 3)) for i in places["PID"] if cell(i, 3)}
    timed = [i for i in places["OBR"] if type_before(i) == "ORU^R01"]
    used = [i for i in places["OBX"] if type_before(i) == "ORU^R01" and last(numbers, i) is not None]
    m = {"numbers": numbers, "type": type_before(end), "mrn": numbers.get(last(numbers, end)),
         "demographics": [i for i in places["PID"] if type_before(i) == "ADT^A01"],
         "tests": [(_float_or_none(cell(i, 5)) if cell(i, 5) else None,
                    None if last(timed, i) is None else cell(last(timed, i), 7) or DEFAULT) for i in used]}
    reason = next((r for r, holds in REASONS.items() if holds(m)), None)
    return ("quarantine", reason, None, []) if reason else (ROUTE[m["type"]], None, m["mrn"], m["tests"])


# ---------------------------------------------------------------- generator

FIELD = st.sampled_from(["", "1", "x", "007", "12a", " 42 ", "-3", "1.5", "nan", "1e3", "abc", "1d", "inf", "3_0"])
MSH = st.builds(lambda t, c: f"MSH|^~\\&|A|B|||20240101120000||{t}|{c}|2.5",
                st.sampled_from(["ADT^A01", "ADT^A03", "ORU^R01", "ORU^R99", ""]), FIELD)
SHORT_MSH = st.just("MSH|^~\\&|A")
PID = st.builds(lambda m, n, d, s: f"PID|1||{m}||{n}||{d}|{s}", FIELD, FIELD, FIELD, FIELD)
OBR = st.builds(lambda t: f"OBR|1||||||{t}", st.sampled_from(["", "202401011200", "20240101120000"]))
OBX = st.builds(lambda v: f"OBX|1|SN|C||{v}", FIELD)
SHORT_OBX = st.just("OBX|1")
NK1 = st.just("NK1|1|X|Y")
MESSAGE = st.lists(st.one_of(MSH, SHORT_MSH, PID, OBR, OBX, SHORT_OBX, NK1), min_size=0, max_size=7) \
            .map(lambda segs: "\r".join(segs))


@settings(max_examples=40, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(MESSAGE, min_size=20, max_size=20))
def test_parse_matches_sequential_model(spark, messages):
    df = spark.createDataFrame(list(enumerate(messages)), "msg_id long, raw string")
    got = {r.msg_id: r for r in P.parse_messages(df, default_time=F.lit(DEFAULT)).collect()}
    for i, m in enumerate(messages):
        route, reason, mrn, tests = model(m)
        r = got[i]
        assert (r.route, r.reason) == (route, reason), m
        if route in ("admissions", "discharges"):
            assert r.mrn == (str(mrn) if mrn is not None else None), m
        if route == "results":
            assert [(t.test_value, t.test_time) for t in r.tests] == tests, m


# ---------------------------------------------------------------- metamorphic

def test_features_invariant_under_arrival_permutation(spark):
    """Distinct keys applied in any arrival order give the same table and
    the same serving features."""
    rnd = random.Random(23)
    t0 = dt.datetime(2024, 1, 1)
    rows = [(str(rnd.randint(0, 15)), t0 + dt.timedelta(minutes=rnd.randint(0, 10 ** 5)),
             float(rnd.randint(1, 50000)) / 100) for _ in range(400)]
    rows = list({(m, d): (m, d, v) for m, d, v in rows}.values())      # distinct keys
    patients = spark.createDataFrame([(str(i), 40, "F") for i in range(16)], "mrn string, age int, sex string")
    empty = spark.createDataFrame([], "mrn string, creatinine_date timestamp, creatinine_result double")
    results = []
    for seed in (1, 2, 3):
        order = list(range(len(rows)))
        random.Random(seed).shuffle(order)
        upd = spark.createDataFrame([(*rows[i], k) for k, i in enumerate(order)],
                                    "mrn string, creatinine_date timestamp, creatinine_result double, arrival long")
        table = store.upsert_measurements(empty, upd)
        f = feat.features_serving(patients, table)
        results.append(sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in f.collect()))
    assert results[0] == results[1] == results[2]


# ---------------------------------------------------------------- frames

def _frames_model(stream: str):
    """(frame_no, message, status) of a connection's byte stream, written
    from the framing rule: a frame ends at each 0x1c; its text after an
    optional CR and the 0x0b start byte is the message."""
    parts = stream.split("\x1c")
    out = []
    for i, text in enumerate(parts[:-1]):
        body = text[1:] if text.startswith("\r") else text
        ok = body.startswith("\x0b")
        out.append((i, body[1:] if ok else None, "ok" if ok else "bad_framing"))
    tail = parts[-1]
    if tail not in ("", "\r"):
        out.append((len(parts) - 1, None, "trailing_data"))
    return out


TEXT = st.text(alphabet="ABC|^\r 0123", min_size=0, max_size=12)
FRAME = st.one_of(TEXT.map(lambda t: "\x0b" + t + "\x1c\r"), TEXT.map(lambda t: t + "\x1c\r"))
STREAM = st.tuples(st.lists(FRAME, min_size=1, max_size=6), st.sampled_from(["", "\x0bopen"]))


@settings(max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(STREAM, st.lists(st.integers(1, 9), min_size=1, max_size=20)), min_size=1, max_size=3))
def test_reassembly_matches_model(spark, conns):
    from renalyze.operators.reassemble import reassemble
    rows, want = [], []
    for conn, ((frames, tail), cuts) in enumerate(conns):
        stream = "".join(frames) + tail
        pos, seq = 0, 0
        while pos < len(stream):
            step = cuts[seq % len(cuts)]
            rows.append((conn, seq, stream[pos:pos + step]))
            pos, seq = pos + step, seq + 1
        want += [(conn, *f) for f in _frames_model(stream)]
    df = spark.createDataFrame(rows, "conn_id long, seq long, bytes string")
    got = sorted((r.conn_id, r.frame_no, r.message, r.status) for r in reassemble(df, block=3).collect())
    assert got == sorted(want, key=lambda t: (t[0], t[1]))
