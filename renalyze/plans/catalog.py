"""Query catalog: every operator of the inventory as (Spark query, oracle SQL).

Each Spark query takes (spark, sf_dir) and reads the driver tables through
``renalyze.bindings``; each oracle is DuckDB SQL over the same tables.
Double results are rounded to 9 decimals on both sides (values carry two
decimals, per-patient means are exact to 8).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import bindings as B
from ..functions import hl7
from ..functions.dates import epoch_seconds
from ..functions.numeric import round9
from ..operators import features as feat
from ..operators import parse as P
from ..operators import scoring, store
from ..schemas import FEATURE_COLUMNS
from . import alerts as AL
from . import sql as S

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql.strip()
        return fn
    return deco


def _r9(df: DataFrame, cols=FEATURE_COLUMNS) -> DataFrame:
    return df.withColumns({c: round9(F.col(c)) for c in cols if c in df.columns})


def _parsed(spark, sf):
    return AL.parse_feed(B.hl7_raw(spark, sf))


def _meas(spark, sf, unit="second", types=None):
    return store.dedupe_last(B.measurement_rows(spark, sf, unit, types),
                             ["mrn", "creatinine_date"], ["creatinine_result"])


# --------------------------------------------------------------------------
# 2.4 projections over HL7 text
# --------------------------------------------------------------------------

@query("hl7_segments", f"""
WITH {S.MSG}
SELECT msg_id, CAST(CASE WHEN event_type = 'signup' THEN 3 WHEN event_type = 'error' THEN 2
                    WHEN odd = 1 THEN 5 WHEN odd = 2 THEN 3 ELSE 4 END AS INTEGER) AS n_segments,
       CASE WHEN event_type = 'signup' THEN 'MSH,PID,NK1' WHEN event_type = 'error' THEN 'MSH,PID'
            WHEN odd = 1 THEN 'MSH,PID,OBR,OBX,OBX' WHEN odd = 2 THEN 'MSH,PID,OBR'
            ELSE 'MSH,PID,OBR,OBX' END AS segment_names
FROM msg""")
def q_hl7_segments(spark, sf):
    raw = B.hl7_raw(spark, sf)
    f = hl7.fields(hl7.segments(F.col("raw")))
    return raw.select("msg_id", F.size(f).cast("int").alias("n_segments"),
                      F.array_join(F.transform(f, lambda x: x[0]), ",").alias("segment_names"))


@query("hl7_fields", f"""
WITH {S.MSG}
SELECT msg_id, CAST(11 AS INTEGER) AS msh_fields,
       CAST(CASE WHEN event_type = 'signup' THEN 9 ELSE 4 END AS INTEGER) AS pid_fields,
       CASE WHEN event_type = 'signup' AND adt_odd = 0 THEN '' WHEN odd = 3 THEN 'MRN' || CAST(user_id AS VARCHAR)
            WHEN event_type = 'error' AND adt_odd = 0 THEN '' ELSE CAST(user_id AS VARCHAR) END AS pid_3
FROM msg""")
def q_hl7_fields(spark, sf):
    raw = B.hl7_raw(spark, sf)
    f = hl7.fields(hl7.segments(F.col("raw")))
    return raw.select("msg_id", F.size(F.get(f, 0)).cast("int").alias("msh_fields"),
                      F.size(F.get(f, 1)).cast("int").alias("pid_fields"),
                      F.get(F.get(f, 1), 3).alias("pid_3"))


@query("hl7_message_type", f"WITH {S.MSG} SELECT msg_id, message_type FROM msg")
def q_message_type(spark, sf):
    raw = B.hl7_raw(spark, sf)
    return raw.select("msg_id", hl7.message_type(hl7.fields(hl7.segments(F.col("raw")))).alias("message_type"))


@query("route_messages", f"WITH {S.MSG} SELECT msg_id, message_type, route, reason FROM parsed")
def q_route(spark, sf):
    return P.route_messages(_parsed(spark, sf))


@query("parse_admissions", f"WITH {S.MSG}, {S.ADMISSIONS} SELECT msg_id, mrn, name, age, sex FROM adm")
def q_admissions(spark, sf):
    return P.admissions(_parsed(spark, sf))


@query("parse_discharges", f"WITH {S.MSG} SELECT msg_id, mrn FROM parsed WHERE route = 'discharges'")
def q_discharges(spark, sf):
    return P.discharges(_parsed(spark, sf))


@query("age_from_dob", f"""
WITH {S.MSG} SELECT msg_id, strftime(dob, '%Y%m%d') AS dob, {S.AGE} AS age
FROM msg WHERE event_type = 'signup'""")
def q_age(spark, sf):
    raw = B.hl7_raw(spark, sf)
    f = hl7.fields(hl7.segments(F.col("raw")))
    dob = F.get(F.get(f, 1), 7)
    msh_time = hl7.hl7_time(F.get(F.get(f, 0), 6))
    return (raw.where(hl7.message_type(f) == hl7.ADMISSION)
               .select("msg_id", dob.alias("dob"), hl7.age_from_dob(dob, msh_time).alias("age")))


@query("obr_test_time", f"""
WITH {S.MSG}, {S.RESULTS} SELECT msg_id, test_time FROM res WHERE obx_pos = 1""")
def q_obr_time(spark, sf):
    return P.first_results(_parsed(spark, sf)).select("msg_id", "test_time")


@query("obx_value", f"WITH {S.MSG}, {S.RESULTS} SELECT msg_id, obx_pos, test_value FROM res")
def q_obx_value(spark, sf):
    return P.results(_parsed(spark, sf)).select("msg_id", "obx_pos", "test_value")


@query("explode_results", f"WITH {S.MSG}, {S.RESULTS} SELECT msg_id, obx_pos, mrn, test_value, test_time FROM res")
def q_explode(spark, sf):
    return P.results(_parsed(spark, sf))


@query("control_id", f"WITH {S.MSG} SELECT msg_id, control_id FROM msg")
def q_control_id(spark, sf):
    return B.hl7_raw(spark, sf).select("msg_id", hl7.control_id(F.col("raw")).alias("control_id"))


@query("ack_text", f"""
WITH {S.MSG}
SELECT msg_id, chr(11) || 'MSH|^~\\&|||||' || ts14 || '||ACK^R01|' || control_id || '|2.5' || chr(13) ||
       'MSA|AA|' || control_id || chr(13) || chr(28) || chr(13) AS ack
FROM msg""")
def q_ack_text(spark, sf):
    raw = B.hl7_raw(spark, sf)
    return raw.select("msg_id", hl7.ack_text(hl7.control_id(F.col("raw")), F.col("sent_ts")).alias("ack"))


@query("alert_timestamp", f"""
WITH {S.MSG} SELECT msg_id, strftime(ts, '%Y%m%d%H%M%S') AS alert_ts FROM msg""")
def q_alert_ts(spark, sf):
    e = B.table(spark, sf, "events").select("event_id", "ts")
    iso = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    return e.select(F.col("event_id").alias("msg_id"), hl7.alert_timestamp(iso).alias("alert_ts"))


@query("alert_payload", f"""
WITH {S.MSG} SELECT msg_id, CAST(user_id AS VARCHAR) || ',' || strftime(ts, '%Y%m%d%H%M%S') AS payload FROM msg""")
def q_alert_payload(spark, sf):
    e = B.table(spark, sf, "events").select("event_id", "ts", "user_id")
    iso = F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS")
    return e.select(F.col("event_id").alias("msg_id"), hl7.alert_payload(F.col("user_id"), iso).alias("payload"))


def _payloads(spark, sf):
    e = B.table(spark, sf, "events").select("event_id", "ts", "user_id", "event_type")
    uid = F.col("user_id").cast("string")
    t14 = F.date_format("ts", "yyyyMMddHHmmss")
    body = (F.when(F.col("event_type") == "click", F.concat_ws(",", uid, t14))
             .when(F.col("event_type") == "view", uid)
             .when(F.col("event_type") == "purchase", F.concat(F.lit("NHS"), uid))
             .when(F.col("event_type") == "signup", F.concat_ws(",", uid, F.date_format("ts", "yyyy/MM/dd HH:mm")))
             .otherwise(F.concat_ws(",", uid, t14, F.lit("unused"))))
    return e.select("event_id", body.alias("payload"))


@query("validate_alert_payload", """
SELECT event_id,
  CASE WHEN event_type IN ('click', 'view') THEN true ELSE false END AS ok,
  CASE WHEN event_type = 'purchase' THEN 'bad_mrn'
       WHEN event_type = 'signup' THEN 'bad_time'
       WHEN event_type = 'error' THEN 'too_many_parts' END AS error
FROM events""")
def q_validate_payload(spark, sf):
    p = _payloads(spark, sf)
    v = hl7.validate_alert_payload(F.col("payload"))
    return p.select("event_id", v["ok"].alias("ok"), v["error"].alias("error"))


def _acks(spark, sf):
    e = B.table(spark, sf, "events").select("event_id", "ts", "event_type")
    cid = F.concat(F.lit("MSG"), F.col("event_id").cast("string"))
    msh = F.concat(F.lit("MSH|^~\\&|||||"), F.date_format("ts", "yyyyMMddHHmmss"), F.lit("||ACK|||2.5"))
    et = F.col("event_type")
    body = (F.when(et == "click", F.concat_ws("\r", msh, F.concat(F.lit("MSA|AA|"), cid)))
             .when(et == "view", F.concat_ws("\r", msh, F.concat(F.lit("MSA|AE|"), cid)))
             .when(et == "purchase", F.concat(F.lit("MSA|AA|"), cid))
             .when(et == "signup", msh)
             .otherwise(F.concat_ws("\r", msh, F.lit("MSA"))))
    return e.select(F.col("event_id").alias("msg_id"), body.alias("ack_raw"))


@query("validate_ack", """
SELECT event_id AS msg_id, event_type = 'click' AS acked,
  CASE WHEN event_type = 'purchase' THEN 'no_msh'
       WHEN event_type = 'signup' THEN 'no_msa'
       WHEN event_type = 'error' THEN 'short_msa' END AS error
FROM events""")
def q_validate_ack(spark, sf):
    a = _acks(spark, sf)
    v = hl7.validate_ack(F.col("ack_raw"))
    return a.select("msg_id", v["acked"].alias("acked"), v["error"].alias("error"))


@query("strip_frame", f"WITH {S.MSG} SELECT msg_id, message_type, control_id FROM msg")
def q_strip_frame(spark, sf):
    raw = B.hl7_raw(spark, sf)
    framed = F.concat(F.lit(hl7.START_BLOCK), F.col("raw"), F.lit(hl7.END_BLOCK))
    payload = hl7.strip_frame(framed)
    return raw.select("msg_id", hl7.message_type(hl7.fields(hl7.segments(payload))).alias("message_type"),
                      hl7.control_id(payload).alias("control_id"))


@query("epoch_seconds", f"""
WITH {S.MEASUREMENTS} SELECT mrn, creatinine_date, CAST(epoch(creatinine_date) AS BIGINT) AS epoch_seconds
FROM measurements_b""")
def q_epoch(spark, sf):
    m = _meas(spark, sf)
    return m.select("mrn", "creatinine_date", epoch_seconds(F.col("creatinine_date")).alias("epoch_seconds"))


@query("relative_seconds", f"""
WITH {S.MEASUREMENTS}
SELECT mrn, creatinine_date,
  CAST(epoch_us(creatinine_date) - epoch_us(min(creatinine_date) OVER (PARTITION BY mrn)) AS DOUBLE) / 1e6 AS relative_seconds
FROM measurements_b""")
def q_relative_seconds(spark, sf):
    return feat.relative_seconds(_meas(spark, sf)).select("mrn", "creatinine_date", "relative_seconds")


@query("ref_date", f"""
WITH {S.MEASUREMENTS} SELECT mrn, min(creatinine_date) AS ref_date FROM measurements_b GROUP BY mrn""")
def q_ref_date(spark, sf):
    return _meas(spark, sf).groupBy("mrn").agg(F.min("creatinine_date").alias("ref_date"))


@query("encode_sex", f"""
WITH {S.PATIENTS}
SELECT mrn, CAST(CASE sex WHEN 'F' THEN 0 WHEN 'M' THEN 1 WHEN 'Other' THEN 2 END AS INTEGER) AS sex_code,
       CAST(dense_rank() OVER (ORDER BY sex) - 1 AS INTEGER) AS sex_fitted
FROM patients_b""")
def q_encode_sex(spark, sf):
    p = B.patients(spark, sf)
    fitted = feat.encode_sex_fitted(p, "sex", "sex_fitted")
    return fitted.select("mrn", feat.encode_sex(F.col("sex")).alias("sex_code"), "sex_fitted")


@query("encode_label", """
SELECT doc_id, CASE WHEN toxic = 1 THEN 'y' ELSE 'n' END AS aki_text,
       CAST(toxic AS INTEGER) AS aki
FROM labels""")
def q_encode_label(spark, sf):
    lab = B.table(spark, sf, "labels")
    t = scoring.label_text(F.col("toxic"))
    return lab.select("doc_id", t.alias("aki_text"), scoring.encode_label(t).alias("aki"))


def _date_texts(spark, sf):
    """Measurement rows as text dates in several layouts (P21, P22 input)."""
    e = B.table(spark, sf, "events").select("event_id", "ts", "event_type")
    et = F.col("event_type")
    txt = (F.when(et == "click", F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
            .when(et == "view", F.date_format("ts", "MM/dd/yy HH:mm:ss"))
            .when(et == "purchase", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"))
            .when(et == "signup", F.lit("not a date"))
            .otherwise(F.date_format("ts", "yyyy/MM/dd HH:mm")))
    return e.select("event_id", txt.alias("date_text"))


@query("parse_date_strict", """
SELECT event_id, date_trunc('second', ts) AS parsed FROM events WHERE event_type = 'click'""")
def q_parse_date_strict(spark, sf):
    from ..functions.dates import parse_date_strict
    d = _date_texts(spark, sf)
    return d.select("event_id", parse_date_strict(F.col("date_text")).alias("parsed")).where("parsed IS NOT NULL")


@query("parse_date_coerce", """
SELECT event_id, CASE WHEN event_type IN ('click', 'view', 'purchase') THEN date_trunc('second', ts) END AS parsed
FROM events""")
def q_parse_date_coerce(spark, sf):
    from ..functions.dates import parse_date_coerce
    d = _date_texts(spark, sf)
    return d.select("event_id", parse_date_coerce(F.col("date_text")).alias("parsed"))


@query("fill_missing_zero", f"""
WITH {S.MSG}, {S.RESULTS} SELECT msg_id, obx_pos, coalesce(test_value, 0) AS test_value FROM res""")
def q_fill_zero(spark, sf):
    return P.results(_parsed(spark, sf)).select("msg_id", "obx_pos", "test_value").na.fill(0.0, ["test_value"])


@query("rename_long_columns", f"""
WITH {S.MEASUREMENTS} SELECT mrn, creatinine_date AS measurement_date, creatinine_result AS measurement_value
FROM measurements_b""")
def q_rename(spark, sf):
    return _meas(spark, sf).withColumnsRenamed({"creatinine_date": "measurement_date",
                                                "creatinine_result": "measurement_value"})


# the other parts register themselves on import
from . import catalog_features as _cf  # noqa: E402,F401
from . import catalog_tables as _ct  # noqa: E402,F401
from . import catalog_io as _cio  # noqa: E402,F401
from . import catalog_stream as _cs  # noqa: E402,F401
from . import catalog_ml as _cm  # noqa: E402,F401
