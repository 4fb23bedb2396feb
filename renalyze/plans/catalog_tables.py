"""Catalog part 2: table maintenance, filters, joins, checks (2.2, 2.3, 2.5, 2.6)."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import bindings as B
from ..operators import parse as P
from ..operators import store
from . import alerts as AL
from . import sql as S
from .catalog import _meas, _parsed, query

_VALID_SEX = "sex IN ('M', 'F', 'Other')"


def _good_adm(spark, sf):
    a = P.admissions(_parsed(spark, sf))
    return a.where(F.col("sex").isNull() | F.col("sex").isin("M", "F", "Other"))


@query("upsert_patients", f"""
WITH {S.PATIENTS}, {S.MSG}, {S.ADMISSIONS},
u AS (SELECT mrn, age, sex, 0 AS b, CAST(0 AS BIGINT) AS a FROM patients_b
      UNION ALL SELECT mrn, age, sex, 1, msg_id FROM adm WHERE {_VALID_SEX})
SELECT mrn, age, sex FROM u QUALIFY row_number() OVER (PARTITION BY mrn ORDER BY b DESC, a DESC) = 1""")
def q_upsert_patients(spark, sf):
    upd = _good_adm(spark, sf).withColumnRenamed("msg_id", "arrival")
    return store.upsert_patients(B.patients(spark, sf), upd)


_DAILY = (S.mrows("cur_rows", "day", ("click", "view")) + ",\n" +
          S.keyed("cur", "cur_rows") + ",\n" + S.mrows("new_rows", "day", ("purchase",)))


@query("upsert_measurements", f"""
WITH {_DAILY},
u AS (SELECT mrn, creatinine_date, creatinine_result, 0 AS b, CAST(0 AS BIGINT) AS a FROM cur
      UNION ALL SELECT mrn, creatinine_date, creatinine_result, 1, arrival FROM new_rows)
SELECT mrn, creatinine_date, creatinine_result FROM u
QUALIFY row_number() OVER (PARTITION BY mrn, creatinine_date ORDER BY b DESC, a DESC) = 1""")
def q_upsert_measurements(spark, sf):
    cur = _meas(spark, sf, "day", ["click", "view"])
    new = B.measurement_rows(spark, sf, "day", ["purchase"])
    return store.upsert_measurements(cur, new)


@query("append_strict", f"""
WITH {_DAILY},
n AS (SELECT *, count(*) OVER (PARTITION BY mrn, creatinine_date) AS k FROM new_rows)
SELECT mrn, creatinine_date, creatinine_result, arrival,
  CASE WHEN k > 1 OR EXISTS (SELECT 1 FROM cur c WHERE c.mrn = n.mrn AND c.creatinine_date = n.creatinine_date)
       THEN 'conflict' ELSE 'inserted' END AS status
FROM n""")
def q_append_strict(spark, sf):
    cur = _meas(spark, sf, "day", ["click", "view"])
    new = B.measurement_rows(spark, sf, "day", ["purchase"])
    _, conflicts = store.append_strict(cur, new, ["mrn", "creatinine_date"])
    fresh = new.join(conflicts.select("mrn", "creatinine_date").distinct(), ["mrn", "creatinine_date"], "left_anti")
    return (fresh.withColumn("status", F.lit("inserted"))
                 .unionByName(conflicts.withColumn("status", F.lit("conflict"))))


def _wide_long(spark, sf, types):
    """Long form of a wide history with empty slots up to the fixed width (mrn, slot, date, result)."""
    from ..operators import reshape as R
    long = R.pad_history(_meas(spark, sf, "second", types)).select(
        "mrn", "slot", "creatinine_date", F.when(~F.col("padded"), F.col("creatinine_result")).alias("creatinine_result"))
    # the stored wide table: written once, read by every branch of the append
    return store.write_snapshot(spark, long, "wide_long")


@query("append_slot", f"""
WITH {S.mrows("base", "second", ("click", "view"))}, {S.keyed("basek", "base")},
{S.mrows("new_rows", "second", ("purchase",))},
b AS (SELECT mrn, CAST(row_number() OVER (PARTITION BY mrn ORDER BY creatinine_date) - 1 AS INTEGER) AS slot,
             creatinine_date, creatinine_result FROM basek),
c AS (SELECT mrn, count(*) AS cnt FROM basek GROUP BY mrn),
n AS (SELECT r.mrn, CAST(coalesce(c.cnt, 0) + row_number() OVER (PARTITION BY r.mrn ORDER BY r.arrival) - 1 AS INTEGER) AS slot,
             r.creatinine_date, r.creatinine_result
      FROM new_rows r LEFT JOIN c ON r.mrn = c.mrn)
SELECT * FROM b UNION ALL SELECT * FROM n""")
def q_append_slot(spark, sf):
    long = _wide_long(spark, sf, ["click", "view"])
    new = B.measurement_rows(spark, sf, "second", ["purchase"])
    out = store.append_slot(long, new)
    return out.where(F.col("creatinine_date").isNotNull())


@query("table_counts", f"""
WITH {S.PATIENTS}, {S.MEASUREMENTS}
SELECT 'patients' AS table_name, count(*) AS n_rows FROM patients_b
UNION ALL SELECT 'measurements', count(*) FROM measurements_b
UNION ALL SELECT 'hl7_raw', count(*) FROM events""")
def q_table_counts(spark, sf):
    return store.table_counts({"patients": B.patients(spark, sf), "measurements": _meas(spark, sf),
                               "hl7_raw": B.hl7_raw(spark, sf)})


@query("is_populated", f"""
WITH {S.PATIENTS}, {S.MEASUREMENTS}
SELECT (SELECT count(*) FROM patients_b) + (SELECT count(*) FROM measurements_b) > 0 AS populated""")
def q_is_populated(spark, sf):
    return store.is_populated({"patients": B.patients(spark, sf), "measurements": _meas(spark, sf)})


@query("load_gate", f"""
WITH {S.PATIENTS}, {S.MEASUREMENTS}
SELECT mrn, creatinine_date, creatinine_result FROM measurements_b
WHERE NOT EXISTS (SELECT 1 FROM patients_b) AND NOT EXISTS (SELECT 1 FROM measurements_b)""")
def q_load_gate(spark, sf):
    rows = _meas(spark, sf)
    return store.load_gate(rows, {"patients": B.patients(spark, sf), "measurements": _meas(spark, sf)})


@query("load_gate_open", f"""
WITH {S.PATIENTS}, {S.MEASUREMENTS}
SELECT mrn, creatinine_date, creatinine_result, 'empty' AS targets FROM measurements_b
UNION ALL SELECT mrn, creatinine_date, creatinine_result, 'patients only' FROM measurements_b
WHERE NOT EXISTS (SELECT 1 FROM patients_b)""")
def q_load_gate_open(spark, sf):
    """The gate before a first load (both tables empty: every row passes) and
    with one of the two filled (none does)."""
    from ..schemas import MEASUREMENTS, PATIENTS
    rows, no_meas = _meas(spark, sf), spark.createDataFrame([], MEASUREMENTS)
    first = store.load_gate(rows, {"patients": spark.createDataFrame([], PATIENTS), "measurements": no_meas})
    half = store.load_gate(rows, {"patients": B.patients(spark, sf), "measurements": no_meas})
    return first.withColumn("targets", F.lit("empty")).unionByName(half.withColumn("targets", F.lit("patients only")))


@query("patient_history", f"""
WITH {S.PATIENTS}, {S.MEASUREMENTS}
SELECT p.mrn, p.age, p.sex, m.creatinine_date, m.creatinine_result
FROM patients_b p LEFT JOIN measurements_b m ON p.mrn = m.mrn""")
def q_patient_history(spark, sf):
    from ..operators.joins import patient_history
    return patient_history(B.patients(spark, sf), _meas(spark, sf))


@query("fk_check", f"""
WITH {S.PATIENTS}, {S.MEASUREMENTS}
SELECT mrn, creatinine_date, mrn IN (SELECT mrn FROM patients_b) AS has_patient FROM measurements_b""")
def q_fk_check(spark, sf):
    ok, orphan = store.fk_split(_meas(spark, sf), B.patients(spark, sf))
    return (ok.select("mrn", "creatinine_date", F.lit(True).alias("has_patient"))
              .unionByName(orphan.select("mrn", "creatinine_date", F.lit(False).alias("has_patient"))))


@query("cascade_delete", f"""
WITH {S.PATIENTS}, {S.MEASUREMENTS}, {S.MSG},
doomed AS (SELECT DISTINCT mrn FROM parsed WHERE route = 'discharges' AND mrn IS NOT NULL)
SELECT 'measurements' AS table_name, mrn, creatinine_date FROM measurements_b WHERE mrn NOT IN (SELECT mrn FROM doomed)
UNION ALL
SELECT 'patients', mrn, CAST(NULL AS TIMESTAMP) FROM patients_b WHERE mrn NOT IN (SELECT mrn FROM doomed)""")
def q_cascade_delete(spark, sf):
    doomed = P.discharges(_parsed(spark, sf)).where(F.col("mrn").isNotNull())
    pats, meas = store.cascade_delete(B.patients(spark, sf), _meas(spark, sf), doomed)
    return (meas.select(F.lit("measurements").alias("table_name"), "mrn", "creatinine_date")
                .unionByName(pats.select(F.lit("patients").alias("table_name"), "mrn",
                                         F.lit(None).cast("timestamp").alias("creatinine_date"))))


# Processed messages (not quarantined at any step) in SQL.
_PROCESSED = f"""{S.APPLIED},
processed AS (
  SELECT p.* FROM parsed p
  WHERE p.route <> 'quarantine'
    AND p.msg_id NOT IN (SELECT msg_id FROM adm WHERE NOT ({_VALID_SEX}))
    AND (p.route <> 'results' OR p.msg_id IN (SELECT msg_id FROM accepted)))"""


@query("ack_reconcile", f"""
WITH {_PROCESSED}
SELECT m.msg_id, m.control_id,
       m.control_id <> '' AND m.control_id IN (SELECT control_id FROM processed) AS acked
FROM msg m""")
def q_ack_reconcile(spark, sf):
    from ..operators.joins import ack_reconcile
    parsed = _parsed(spark, sf)
    applied = AL.apply_messages(parsed, B.patients(spark, sf))
    return ack_reconcile(parsed.select("msg_id", "control_id"), applied.processed.select("control_id"))


@query("ack_outbox", f"""
WITH {_PROCESSED}
SELECT msg_id, control_id,
       chr(11) || 'MSH|^~\\&|||||' || ts14 || '||ACK^R01|' || control_id || '|2.5' || chr(13) ||
       'MSA|AA|' || control_id || chr(13) || chr(28) || chr(13) AS ack
FROM processed""")
def q_ack_outbox(spark, sf):
    from ..operators.scoring import ack_outbox
    applied = AL.apply_messages(_parsed(spark, sf), B.patients(spark, sf))
    return ack_outbox(applied.processed)


@query("predictions_vs_labels", """
SELECT t.doc_id, t.quality AS label, p.toxic AS prediction
FROM labels t JOIN labels p ON t.doc_id = p.doc_id""")
def q_pred_vs_labels(spark, sf):
    lab = B.table(spark, sf, "labels")
    truth = lab.select("doc_id", F.col("quality").alias("label"))
    pred = lab.select("doc_id", F.col("toxic").alias("prediction"))
    return truth.join(pred, "doc_id")


@query("patient_lookup", f"""
WITH {S.PATIENTS}, {S.MEASUREMENTS}, {S.MSG}, {S.ADMISSIONS}
SELECT p.mrn, p.age, p.sex, m.creatinine_date, m.creatinine_result
FROM patients_b p LEFT JOIN measurements_b m ON p.mrn = m.mrn
WHERE p.mrn IN (SELECT mrn FROM adm)""")
def q_patient_lookup(spark, sf):
    from ..operators.joins import patient_history
    wanted = P.admissions(_parsed(spark, sf)).select("mrn")
    pats = B.patients(spark, sf).join(wanted, "mrn", "left_semi")
    return patient_history(pats, _meas(spark, sf))


@query("first_patient", f"""
WITH {S.PATIENTS}, {S.MSG}, {S.ADMISSIONS}
SELECT mrn, age, sex FROM patients_b WHERE mrn IN (SELECT mrn FROM adm)""")
def q_first_patient(spark, sf):
    wanted = P.admissions(_parsed(spark, sf)).select("mrn")
    pats = B.patients(spark, sf).join(wanted, "mrn", "left_semi")
    # mrn is the key: the first row per looked-up mrn is its only row
    return pats.groupBy("mrn").agg(F.first("age").alias("age"), F.first("sex").alias("sex"))


@query("unknown_patient_reject", f"""
WITH {S.APPLIED}
SELECT msg_id, mrn, 'unknown_patient' AS reason FROM first_res WHERE msg_id NOT IN (SELECT msg_id FROM accepted)""")
def q_unknown_patient(spark, sf):
    parsed = _parsed(spark, sf)
    applied = AL.apply_messages(parsed, B.patients(spark, sf))
    q = applied.quarantine.where(F.col("reason") == "unknown_patient")
    return q.join(P.first_results(parsed).select("msg_id", "mrn"), "msg_id").select("msg_id", "mrn", "reason")


@query("first_result_only", f"""
WITH {S.MSG}, {S.RESULTS} SELECT msg_id, mrn, test_value, test_time FROM res WHERE obx_pos = 1""")
def q_first_result(spark, sf):
    return P.first_results(_parsed(spark, sf)).drop("control_id")


@query("quarantine_unknown", f"""
WITH {S.MSG} SELECT msg_id, reason FROM parsed WHERE route = 'quarantine'""")
def q_quarantine(spark, sf):
    return P.quarantine(_parsed(spark, sf)).select("msg_id", "reason")


@query("admission_requires_mrn", f"""
WITH {S.MSG} SELECT msg_id, reason FROM parsed WHERE message_type = 'ADT^A01' AND reason IN ('no_mrn', 'no_demographics')""")
def q_adm_requires_mrn(spark, sf):
    q = _parsed(spark, sf)
    return q.where((F.col("message_type") == "ADT^A01") & F.col("reason").isin("no_mrn", "no_demographics")) \
            .select("msg_id", "reason")


@query("discharge_noop", f"""
WITH {S.MSG}
SELECT count(*) AS n_discharges, count(mrn) AS n_with_mrn FROM parsed WHERE route = 'discharges'""")
def q_discharge_noop(spark, sf):
    d = P.discharges(_parsed(spark, sf))
    return d.agg(F.count(F.lit(1)).alias("n_discharges"), F.count("mrn").alias("n_with_mrn"))


@query("enum_sex", f"""
WITH {S.MSG}, {S.ADMISSIONS} SELECT msg_id, mrn, sex, {_VALID_SEX} AS sex_ok FROM adm""")
def q_enum_sex(spark, sf):
    a = P.admissions(_parsed(spark, sf))
    return store.sex_check(a).select("msg_id", "mrn", "sex", "sex_ok")


@query("append_rows", f"""
WITH {S.PATIENTS}, {S.MSG}, {S.ADMISSIONS}
SELECT mrn, age, sex, CAST(NULL AS VARCHAR) AS name, CAST(NULL AS BIGINT) AS msg_id FROM patients_b
UNION ALL SELECT mrn, age, sex, name, msg_id FROM adm""")
def q_append_rows(spark, sf):
    return B.patients(spark, sf).unionByName(P.admissions(_parsed(spark, sf)), allowMissingColumns=True)


@query("what_if_history", f"""
WITH {S.PATIENTS}, {S.mrows("h_rows", "second", ("click", "view"))}, {S.keyed("hist", "h_rows")},
cand AS (SELECT CAST(user_id AS VARCHAR) AS mrn, arg_max(date_trunc('second', ts), event_id) AS creatinine_date,
                arg_max(value, event_id) AS creatinine_result
         FROM events WHERE event_type = 'purchase' GROUP BY user_id),
known AS (SELECT c.* FROM cand c WHERE c.mrn IN (SELECT mrn FROM patients_b)),
slots AS (SELECT k.mrn, CAST(count(h.mrn) AS INTEGER) AS next_slot FROM known k LEFT JOIN hist h ON h.mrn = k.mrn GROUP BY k.mrn),
merged AS (SELECT mrn, creatinine_date, creatinine_result FROM hist WHERE mrn IN (SELECT mrn FROM known)
           UNION ALL SELECT mrn, creatinine_date, creatinine_result FROM known),
pk AS (SELECT * FROM patients_b WHERE mrn IN (SELECT mrn FROM known)),
{S.serving('pk', 'merged')}
SELECT f.mrn, s.next_slot, f.n_readings, {S.r9()} FROM feat f JOIN slots s ON f.mrn = s.mrn""")
def q_what_if(spark, sf):
    """Each known patient's stored history plus one unsaved candidate
    reading (the latest purchase event) in the next slot, with the features
    of that combined history; unknown patients give no row."""
    from ..operators import features as feat
    from ..functions.numeric import round9
    hist = _meas(spark, sf, "second", ["click", "view"])
    rows = B.measurement_rows(spark, sf, "second", ["purchase"])
    cand = rows.groupBy("mrn").agg(F.max_by("creatinine_date", "arrival").alias("creatinine_date"),
                                   F.max_by("creatinine_result", "arrival").alias("creatinine_result"))
    pk = B.patients(spark, sf).join(cand.select("mrn"), "mrn", "left_semi")
    known = cand.join(pk.select("mrn"), "mrn", "left_semi")
    hk = hist.join(known.select("mrn"), "mrn", "left_semi")
    # written once: on rows that still lie by patient, every step of the features would run, and hold its memory, in one stage
    both = store.write_snapshot(spark, hk.withColumn("stored", F.lit(True)).unionByName(known.withColumn("stored", F.lit(False))), "what_if")
    hk, merged = both.where("stored"), both.drop("stored")
    slots = known.select("mrn").join(hk.groupBy("mrn").agg(F.count(F.lit(1)).alias("n")), "mrn", "left") \
                 .select("mrn", F.coalesce(F.col("n"), F.lit(0)).cast("int").alias("next_slot"))
    f = feat.features_serving(pk, merged, keep_counts=True)
    f = f.withColumns({c: round9(F.col(c)) for c in feat.FEATURE_COLUMNS})
    return f.join(slots, "mrn").select("mrn", "next_slot", "n_readings", *feat.FEATURE_COLUMNS)
