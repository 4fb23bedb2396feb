"""HL7 parsing, routing and ACK text against hand-typed messages."""

import pytest
from pyspark.sql import functions as F

from renalyze.functions import hl7
from renalyze.operators import parse as P

CR = "\r"
DEFAULT = "20990101000000"


def msg(*segs):
    return CR.join(segs)


MSH_A01 = "MSH|^~\\&|LAB|WEST WING|||20240311074500||ADT^A01|C-17|2.5"
MSH_ORU = "MSH|^~\\&|LAB|WEST WING|||20240311081000||ORU^R01|||2.5"

CASES = {
    1: msg(MSH_A01, "PID|||70031||Quill^Ada||19880229|M"),
    2: msg("MSH|^~\\&|LAB|WEST WING|||202403110930||ADT^A01|||2.5",
           "PID|1||70044||Moss^Iris||19840203|F", "NK1|1|Moss^Noor|SIBLING"),
    3: msg("MSH|^~\\&|LAB||||20240311101500||ADT^A03|C-18|2.5", "PID|||70052"),
    4: msg(MSH_ORU, "PID|1||70061", "OBR|1||||||20240311080500", "OBX|1|SN|CREATININE||87.30000000000001"),
    5: msg(MSH_ORU, "PID|1||70044", "OBR|1||||||202403111215", "OBX|1|SN|CREATININE||91.25"),
    6: msg("MSH|^~\\&|LAB||||20240311123000||ORU^R01|C-19|2.5", "PID|||70078", "OBR|||20240311122900"),
    7: msg("MSH|^~\\&|LAB||||20240311130000||ORU^R01|C-20|2.5", "PID|||70085", "OBR|||20240311125900",
           "OBX|||SMUDGED"),
    8: msg("MSH|^~\\&|LAB||||20240311131500||MADE_UP|C-21|2.5", "PID|||70099"),
    # edge rows from the parser's code paths
    9: msg(MSH_ORU, "PID|1||1", "OBR|1||||||20240311081000", "OBX|1|SN|C||abc"),
    10: msg(MSH_ORU, "PID|1||1", "OBR|1||||||20240311081000", "OBX|1|SN|C||1d"),
    11: msg(MSH_ORU, "PID|1||1", "OBR|1||||||20240311081000", "OBX|1|SN|C||nan"),
    12: msg(MSH_ORU, "PID|1||1", "OBR|1||||||20240311081000", "OBX|1|SN|C||1.5", "OBX|2|SN|C||2.5"),
    13: msg(MSH_ORU, "OBX|1|SN|C||9.9", "PID|1||1", "OBR|1||||||20240311081000", "OBX|2|SN|C||1.0"),
    14: msg(MSH_ORU, "PID|1||1", "OBR|1||||||202501010000", "OBR|1||||||202502020000", "OBX|1|SN|C||1.0"),
    15: msg("MSH|^~\\&|||||x||ADT^A01|A|2.5", "MSH|^~\\&|||||x||ORU^R01|B|2.5", "PID|1||7",
            "OBR|1||||||202501010000", "OBX|1|SN|C||2.0"),
    16: msg(MSH_A01, "PID|||||Reed^Sol||19900101|F"),
    17: msg(MSH_A01, "PID|||12x||Reed^Sol||19900101|F"),
    18: msg("PID|||42||Reed^Sol||19900101|F", MSH_A01),
    19: msg("MSH|^~\\&|||"),
    20: "",
    21: msg(MSH_ORU, "PID|1||5", "OBR|1", "OBX|1|SN|C||3.0"),
    22: "  \n" + msg(MSH_A01, "PID|||77||X||invalid|M") + "\n ",
}


@pytest.fixture(scope="module")
def parsed(spark):
    rows = [(k, v) for k, v in CASES.items()]
    df = spark.createDataFrame(rows, "msg_id long, raw string").withColumn("dt", F.lit(DEFAULT))
    out = P.parse_messages(df, default_time="dt", as_of=F.lit("2024-02-02"))
    return {r["msg_id"]: r for r in out.collect()}


def test_admission(parsed):
    r = parsed[1]
    assert (r.route, r.mrn, r.name, r.sex, r.age, r.control_id) == ("admissions", "70031", "Quill^Ada", "M", 35, "C-17")


def test_admission_without_control_id(parsed):
    r = parsed[2]
    assert (r.route, r.mrn, r.sex, r.control_id) == ("admissions", "70044", "F", "")
    assert r.age == 39  # 1984-02-03 -> 2024-02-02, birthday not yet reached


def test_discharge(parsed):
    assert (parsed[3].route, parsed[3].mrn) == ("discharges", "70052")


def test_result(parsed):
    r = parsed[4]
    assert r.route == "results" and len(r.tests) == 1
    t = r.tests[0]
    assert (t.mrn, t.test_value, t.test_time) == (70061, 87.30000000000001, "20240311080500")


def test_result_12_digit_time(parsed):
    t = parsed[5].tests[0]
    assert (t.test_value, t.test_time) == (91.25, "202403111215")


def test_result_without_obx_is_no_result(parsed):
    assert (parsed[6].route, parsed[6].reason, len(parsed[6].tests)) == ("quarantine", "no_result", 0)


def test_obx_without_field5_gives_null_and_default_time(parsed):
    t = parsed[7].tests[0]
    assert (t.test_value, t.test_time) == (None, DEFAULT)


def test_unknown_type(parsed):
    assert (parsed[8].route, parsed[8].reason) == ("quarantine", "unknown_type")


@pytest.mark.parametrize("k", [9, 10, 11])
def test_non_numeric_values_are_null(parsed, k):
    assert parsed[k].tests[0].test_value is None


def test_two_obx(parsed):
    assert [t.test_value for t in parsed[12].tests] == [1.5, 2.5]


def test_obx_before_pid_is_dropped(parsed):
    assert [t.test_value for t in parsed[13].tests] == [1.0]


def test_latest_obr_wins(parsed):
    assert parsed[14].tests[0].test_time == "202502020000"


def test_last_msh_wins(parsed):
    assert parsed[15].message_type == "ORU^R01" and parsed[15].tests[0].test_value == 2.0


def test_blank_pid3_is_no_mrn(parsed):
    assert (parsed[16].route, parsed[16].reason) == ("quarantine", "no_mrn")


def test_non_integer_mrn(parsed):
    assert (parsed[17].route, parsed[17].reason) == ("quarantine", "bad_mrn")


def test_pid_before_msh_has_no_demographics(parsed):
    assert (parsed[18].route, parsed[18].reason) == ("quarantine", "no_demographics")


@pytest.mark.parametrize("k", [19, 20])
def test_short_or_empty(parsed, k):
    assert (parsed[k].route, parsed[k].reason) == ("quarantine", "unknown_type")


def test_short_obr_uses_default_time(parsed):
    assert parsed[21].tests[0].test_time == DEFAULT


def test_whitespace_stripped_and_bad_dob(parsed):
    r = parsed[22]
    assert (r.route, r.mrn, r.age) == ("admissions", "77", None)


def test_age_valid(spark):
    r = spark.range(1).select(hl7.age_from_dob(F.lit("20000101"), F.lit("2024-06-01")).alias("a")).first()
    assert r.a == 24


def test_ack_text(spark):
    raw = msg("MSH|^~\\&|||||20240205120000||ORU^R01|C-22|2.5", "PID|||1")
    df = spark.createDataFrame([(raw,)], "raw string")
    r = df.select(hl7.ack_text(hl7.control_id(F.col("raw")),
                               F.lit("2024-02-05 12:00:00").cast("timestamp")).alias("ack")).first()
    assert r.ack == ("\x0bMSH|^~\\&|||||20240205120000||ACK^R01|C-22|2.5\rMSA|AA|C-22\r\x1c\r")


def test_ack_empty_id_stays_empty(spark):
    raw = msg("MSH|^~\\&|||||20240205120000||ORU^R01||2.5", "PID|||1")
    no_msh = "PID|||1"
    df = spark.createDataFrame([(raw,), (no_msh,)], "raw string")
    ids = [r.c for r in df.select(hl7.control_id(F.col("raw")).alias("c")).collect()]
    assert ids == ["", "UNKNOWN"]


def test_unparsable_result_time_is_quarantined(spark):
    from renalyze.plans import alerts as AL
    msgs = [(1, msg("MSH|^~\\&|||||20240205120000||ADT^A01|A|2.5", "PID|||77||X||19900101|M")),
            (2, msg("MSH|^~\\&|||||20240205120000||ORU^R01|B|2.5", "PID|||77", "OBR|1||||||2024-02-05",
                    "OBX|1|SN|C||1.0")),
            (3, msg("MSH|^~\\&|||||20240205120000||ORU^R01|C|2.5", "PID|||77", "OBR|1||||||20240205120100",
                    "OBX|1|SN|C||2.0"))]
    df = spark.createDataFrame(msgs, "msg_id long, raw string").withColumn("dt", F.lit(DEFAULT))
    parsed = P.parse_messages(df, default_time="dt")
    patients = spark.createDataFrame([], "mrn string, age int, sex string")
    ap = AL.apply_messages(parsed, patients)
    assert {(r.msg_id, r.reason) for r in ap.quarantine.collect()} == {(2, "bad_date")}
    assert [r.creatinine_result for r in ap.measurements.collect()] == [2.0]
