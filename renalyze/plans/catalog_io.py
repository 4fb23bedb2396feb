"""Catalog part 4: sources and sinks (2.1, 2.2) as write-then-read round trips.

Every file is written under the shared checkpoint root (``spark.checkpoint.dir``)
in a fresh folder, then read back with the source under test.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import bindings as B
from ..functions.numeric import ratio
from ..operators import evaluation as ev
from ..operators import reshape as R
from ..operators import scoring, store
from ..schemas import MEASUREMENTS, PATIENTS
from ..session import scratch_path
from ..sources import files
from . import sql as S
from .catalog import _meas, query
from .catalog_features import _rows
from .load import history_tables


_SLOTS_SQL = f"""
WITH {S.MEASUREMENTS}
SELECT mrn, CAST(row_number() OVER (PARTITION BY mrn ORDER BY creatinine_date) - 1 AS INTEGER) AS slot,
       creatinine_date, creatinine_result FROM measurements_b"""


def _history_csv(spark, sf, types=None):
    """The wide history CSV, as stored upstream."""
    path = scratch_path(spark, "history_csv")
    files.write_wide_history(_rows(spark, sf, types), path)
    return path


@query("scan_wide_history", _SLOTS_SQL)
def q_scan_wide(spark, sf):
    return files.typed_cells(R.unpivot_rows(files.scan_wide_rows(spark, _history_csv(spark, sf))))[0]


def _labelled(spark, sf):
    m = _meas(spark, sf)
    stats = m.groupBy("mrn").agg(
        F.min("creatinine_result").alias("mn"), F.percentile("creatinine_result", F.lit(0.5)).alias("med"),
        F.max_by("creatinine_result", "creatinine_date").alias("mr"))
    hit = (F.coalesce(ratio(F.col("mr"), F.col("mn")) >= 1.5, F.lit(False)) |
           F.coalesce(ratio(F.col("mr"), F.col("med")) >= 1.5, F.lit(False)))
    aki = stats.select("mrn", scoring.label_text(F.when(hit, 1).otherwise(0)).alias("aki"))
    return _rows(spark, sf).join(B.patients(spark, sf), "mrn", "left").join(aki, "mrn", "left")


@query("scan_labelled", f"""
WITH {S.PATIENTS}, {S.MEASUREMENTS},
a AS (SELECT mrn, count(*) AS n_readings, min(creatinine_result) AS mn, quantile_cont(creatinine_result, 0.5) AS med,
             arg_max(creatinine_result, creatinine_date) AS mr FROM measurements_b GROUP BY mrn)
SELECT a.mrn, p.age, p.sex,
  CAST(CASE WHEN coalesce({S.ratio('mr', 'mn')} >= 1.5, false) OR coalesce({S.ratio('mr', 'med')} >= 1.5, false)
       THEN 1 ELSE 0 END AS INTEGER) AS aki, a.n_readings
FROM a LEFT JOIN patients_b p ON a.mrn = p.mrn""")
def q_scan_labelled(spark, sf):
    path = scratch_path(spark, "labelled_csv")
    files.write_wide_history(_labelled(spark, sf), path, ["age", "sex", "aki"])
    long = R.unpivot_rows(files.scan_wide_rows(spark, path), extra=["age", "sex", "aki"])
    return long.groupBy("mrn").agg(
        F.first(F.col("age").try_cast("int")).alias("age"), F.first("sex").alias("sex"),
        F.first(scoring.encode_label(F.col("aki"))).alias("aki"),
        F.count(F.lit(1)).alias("n_readings"))


@query("sink_split_csv", f"""
WITH {S.MEASUREMENTS} SELECT mrn, creatinine_date AS measurement_date, creatinine_result AS measurement_value
FROM measurements_b""")
def q_sink_split(spark, sf):
    root = scratch_path(spark, "split_csv")
    _, m = files.sink_split_csv(B.patients(spark, sf), _meas(spark, sf), root)
    return files.scan_measurements_csv(spark, m)


@query("scan_patients_csv", f"WITH {S.PATIENTS} SELECT mrn, age, sex FROM patients_b")
def q_scan_patients(spark, sf):
    root = scratch_path(spark, "split_csv")
    p, _ = files.sink_split_csv(B.patients(spark, sf), _meas(spark, sf), root)
    return files.scan_patients_csv(spark, p)


@query("scan_tables", f"""
WITH {S.PATIENTS}, {S.MEASUREMENTS}
SELECT p.mrn, p.age, p.sex, m.creatinine_date, m.creatinine_result
FROM patients_b p LEFT JOIN measurements_b m ON p.mrn = m.mrn""")
def q_scan_tables(spark, sf):
    from ..operators.joins import patient_history
    root = scratch_path(spark, "tables")
    files.write_tables(B.patients(spark, sf), _meas(spark, sf), root)
    p, m = files.scan_tables(spark, root)
    return patient_history(p, m)


def _bulk_load(spark, sf, types=None):
    """Wide history CSV -> Patients (age, sex NULL) + Measurements, behind the
    empty-tables gate, into freshly created (empty) tables."""
    empty = {"patients": spark.createDataFrame([], PATIENTS), "measurements": spark.createDataFrame([], MEASUREMENTS)}
    pats, meas, _ = history_tables(files.scan_wide_rows(spark, _history_csv(spark, sf, types)))
    no_arrival = F.lit(0).cast("bigint").alias("arrival")
    return (store.upsert_patients(empty["patients"], store.load_gate(pats.select("*", no_arrival), empty)),
            store.upsert_measurements(empty["measurements"], store.load_gate(meas.select("*", no_arrival), empty)))


@query("bulk_load_history", f"""
WITH {S.mrows("r", "second", ("click", "view"))}, {S.keyed("k", "r")}
SELECT mrn, creatinine_date, creatinine_result FROM k""")
def q_bulk_load(spark, sf):
    return _bulk_load(spark, sf, ["click", "view"])[1]


@query("bulk_load_patients", """
SELECT DISTINCT CAST(user_id AS VARCHAR) AS mrn, CAST(NULL AS INTEGER) AS age, CAST(NULL AS VARCHAR) AS sex
FROM events WHERE event_type IN ('click', 'view')""")
def q_bulk_load_patients(spark, sf):
    return _bulk_load(spark, sf, ["click", "view"])[0]


@query("bulk_load_history_all", f"""
WITH {S.MEASUREMENTS} SELECT mrn, creatinine_date, creatinine_result FROM measurements_b""")
def q_bulk_load(spark, sf):
    return _bulk_load(spark, sf)[1]


@query("bulk_load_patients_all", f"""
WITH {S.MEASUREMENTS}
SELECT DISTINCT mrn, CAST(NULL AS INTEGER) AS age, CAST(NULL AS VARCHAR) AS sex FROM measurements_b""")
def q_bulk_load_patients_all(spark, sf):
    return _bulk_load(spark, sf)[0]


@query("sink_predictions", "SELECT doc_id, CASE WHEN toxic = 1 THEN 'y' ELSE 'n' END AS aki FROM labels")
def q_sink_predictions(spark, sf):
    path = scratch_path(spark, "predictions_csv")
    lab = B.table(spark, sf, "labels")
    files.write_csv(lab.select("doc_id", scoring.label_text(F.col("toxic")).alias("aki")), path)
    return spark.read.option("header", True).schema("doc_id bigint, aki string").csv(path)


@query("metrics_table", """
WITH c AS (SELECT count(*) FILTER (WHERE quality = 1 AND toxic = 1) AS tp, count(*) FILTER (WHERE quality = 0 AND toxic = 1) AS fp,
                  count(*) FILTER (WHERE quality = 1 AND toxic = 0) AS fn, count(*) FILTER (WHERE quality = toxic) AS eq,
                  count(*) AS n FROM labels)
SELECT round(CAST(eq AS DOUBLE) / n, 9) AS accuracy,
       round(CASE WHEN 10 * tp + 9 * fn + fp = 0 THEN 0 ELSE 10.0 * tp / (10 * tp + 9 * fn + fp) END, 9) AS f3,
       n AS n_rows FROM c""")
def q_metrics_table(spark, sf):
    from ..functions.numeric import round9
    row = ev.metrics(B.predictions(spark, sf), 3.0)
    path = scratch_path(spark, "metrics")
    row.select(round9(F.col("accuracy")).alias("accuracy"), round9(F.col("fbeta")).alias("f3"), "n_rows") \
       .write.mode("append").parquet(path)
    return spark.read.parquet(path)


@query("scan_mllp_capture", f"""
WITH {S.MSG} SELECT control_id, message_type, 'ok' AS status FROM msg""")
def q_scan_capture(spark, sf):
    from ..functions import hl7
    path = scratch_path(spark, "capture")
    files.write_capture(B.hl7_raw(spark, sf), path)
    fr = files.scan_mllp_capture(spark, path)
    m = F.col("message")
    return fr.select(hl7.control_id(m).alias("control_id"),
                     hl7.message_type(hl7.fields(hl7.segments(m))).alias("message_type"), "status")
