"""Catalog part 5: Structured Streaming (2.1 landing source, 2.9 T1-T5).

Each query writes the HL7 feed as MLLP capture files into a fresh landing
folder under the shared checkpoint root, runs the streaming query with
``trigger(availableNow=True)`` and returns what its sink wrote.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import bindings as B
from ..functions import hl7
from ..functions.numeric import round9
from ..schemas import FEATURE_COLUMNS, MEASUREMENTS, PATIENTS
from ..session import scratch_path
from ..sources import files
from ..streaming import ingest, sinks, state, tables
from . import sql as S
from .catalog import query


def _landing(spark, sf):
    path = scratch_path(spark, "landing")
    files.write_capture(B.hl7_raw(spark, sf), path)
    return path


@query("stream_mllp_landing", f"WITH {S.MSG} SELECT control_id, message_type, 'ok' AS status FROM msg")
def q_stream_landing(spark, sf):
    landing = _landing(spark, sf)
    out, ck = scratch_path(spark, "landing_out"), scratch_path(spark, "ckpt")
    fr = files.stream_mllp_landing(spark, landing)
    m = F.col("message")
    proj = fr.select(hl7.control_id(m).alias("control_id"),
                     hl7.message_type(hl7.fields(hl7.segments(m))).alias("message_type"), "status")
    sinks.run_available_now(proj, ck, sink_path=out)
    return spark.read.parquet(out)


@query("stream_ingest", f"WITH {S.MSG} SELECT control_id, message_type, route, reason FROM parsed")
def q_stream_ingest(spark, sf):
    landing = _landing(spark, sf)
    out, ck = scratch_path(spark, "ingest_out"), scratch_path(spark, "ckpt")
    parsed = ingest.parsed_stream(spark, landing)
    proj = parsed.select(F.col("msg_id.control_id").alias("control_id"), "message_type", "route", "reason")
    sinks.run_available_now(proj, ck, sink_path=out)
    return spark.read.parquet(out)


# Stream semantics in SQL: arrival order is (MSH-7 second, control id).
_STREAM_BASE = f"""{S.PATIENTS}, {S.MSG}, {S.ADMISSIONS}, {S.RESULTS},
ev AS (SELECT msg_id, date_trunc('second', ts) AS t, control_id FROM msg),
gadm AS (SELECT a.mrn, a.age, a.sex, e.t, e.control_id FROM adm a JOIN ev e USING (msg_id) WHERE a.sex IN ('M', 'F', 'Other')),
fres AS (SELECT r.msg_id, r.mrn, e.t, e.control_id, r.obr_ts AS d, r.test_value AS v
         FROM res r JOIN ev e USING (msg_id) WHERE r.obx_pos = 1),
acc AS (SELECT f.* FROM fres f
        WHERE f.mrn IN (SELECT mrn FROM patients_b)
           OR EXISTS (SELECT 1 FROM gadm a WHERE a.mrn = f.mrn AND (a.t < f.t OR (a.t = f.t AND a.control_id < f.control_id))))"""


@query("stream_upsert", f"""
WITH {_STREAM_BASE}
SELECT mrn, d AS creatinine_date, v AS creatinine_result FROM acc
QUALIFY row_number() OVER (PARTITION BY mrn, d ORDER BY t DESC, control_id DESC) = 1""")
def q_stream_upsert(spark, sf):
    landing = _landing(spark, sf)
    root, ck = scratch_path(spark, "tables"), scratch_path(spark, "ckpt")
    parsed = ingest.parsed_stream(spark, landing)
    writer = sinks.table_upsert_writer(root, B.patients(spark, sf), spark.createDataFrame([], MEASUREMENTS), buckets=8)
    sinks.run_available_now(parsed, ck, foreach_batch=writer)
    return tables.snapshot(spark, root, "measurements")


_IN_TURN = {"maxFilesPerTrigger": "1", "recursiveFileLookup": "true"}     # one landing file a micro-batch


def _landing_parts(spark, sf, parts):
    """The feed as one capture file for each of ``parts`` (conditions), in that order of arrival."""
    path = scratch_path(spark, "landing")
    raw = B.hl7_raw(spark, sf)
    for i, part in enumerate(parts):
        files.write_capture(raw.where(part).coalesce(1), f"{path}/part{i}")
    return path


def _quarters(spark, sf):
    """The feed cut at the quarters of its message numbers."""
    r = B.hl7_raw(spark, sf).agg(F.min("msg_id"), F.max("msg_id")).first()
    cuts = [r[0] + (r[1] - r[0] + 1) * k // 4 for k in range(5)]
    return [F.col("msg_id").between(a, b - 1) for a, b in zip(cuts, cuts[1:])]


@query("stream_upsert_batches", f"""
WITH {_STREAM_BASE}
SELECT mrn, d AS creatinine_date, v AS creatinine_result FROM acc
QUALIFY row_number() OVER (PARTITION BY mrn, d ORDER BY t DESC, control_id DESC) = 1""")
def q_stream_upsert_batches(spark, sf):
    """T3 over four micro-batches: each rewrites the buckets it touches only."""
    landing = _landing_parts(spark, sf, _quarters(spark, sf))
    root, ck = scratch_path(spark, "tables"), scratch_path(spark, "ckpt")
    writer = sinks.table_upsert_writer(root, B.patients(spark, sf), spark.createDataFrame([], MEASUREMENTS), buckets=8)
    sinks.run_available_now(ingest.parsed_stream(spark, landing, _IN_TURN), ck, foreach_batch=writer)
    return tables.snapshot(spark, root, "measurements")


# The feed on tables that are empty at the start: patients are known from their admission on.
_FRESH = f"""{S.MSG}, {S.ADMISSIONS}, {S.RESULTS},
ev AS (SELECT msg_id, date_trunc('second', ts) AS t, control_id, {S.RAW} AS raw FROM parsed),
gadm AS (SELECT a.mrn, a.age, a.sex, e.t, e.control_id FROM adm a JOIN ev e USING (msg_id) WHERE a.sex IN ('M', 'F', 'Other')),
fres AS (SELECT r.msg_id, r.mrn, e.t, e.control_id, r.obr_ts AS d, r.test_value AS v, e.raw
         FROM res r JOIN ev e USING (msg_id) WHERE r.obx_pos = 1)"""


@query("stream_quarantine", f"""
WITH {_FRESH}
SELECT control_id, mrn, raw, reason FROM (
  SELECT e.control_id, CASE WHEN p.event_type IN ('signup', 'error') OR p.odd IS NULL OR p.odd <> 3 THEN p.mrn END AS mrn, e.raw, p.reason
  FROM parsed p JOIN ev e USING (msg_id) WHERE p.reason IS NOT NULL
  UNION ALL SELECT e.control_id, a.mrn, e.raw, 'bad_sex' FROM adm a JOIN ev e USING (msg_id) WHERE a.sex NOT IN ('M', 'F', 'Other')
  UNION ALL SELECT control_id, mrn, raw, 'unknown_patient' FROM fres f
  WHERE NOT EXISTS (SELECT 1 FROM gadm a WHERE a.mrn = f.mrn AND (a.t < f.t OR (a.t = f.t AND a.control_id < f.control_id)))
  UNION ALL SELECT 'UNKNOWN', NULL, raw, 'trailing_data' FROM ev JOIN msg USING (msg_id) WHERE event_type = 'error')""")
def q_stream_quarantine(spark, sf):
    """everything held back on tables that begin empty, with its
    text; a second capture repeats the discharges in frames that do not end."""
    landing, discharge = _landing_parts(spark, sf, _quarters(spark, sf)), hl7.DISCHARGE
    raw = B.hl7_raw(spark, sf)
    (raw.where(hl7.message_type(hl7.fields(hl7.segments(F.col("raw")))) == discharge)
        .select(F.concat(F.lit(hl7.START_BLOCK), "raw").alias("value")).coalesce(1)
        .write.option("lineSep", hl7.START_BLOCK).text(f"{landing}/open"))
    root, ck = scratch_path(spark, "tables"), scratch_path(spark, "ckpt")
    writer = sinks.table_upsert_writer(root, spark.createDataFrame([], PATIENTS), spark.createDataFrame([], MEASUREMENTS), buckets=8)
    sinks.run_available_now(ingest.parsed_stream(spark, landing, _IN_TURN, keep_bad=True), ck, foreach_batch=writer)
    return sinks.quarantined(spark, root).select("control_id", "mrn", "raw", "reason")


@query("replay_quarantine", f"""
WITH {_FRESH},
sent AS (SELECT mrn, t, control_id, d, v, raw FROM fres UNION ALL
         SELECT o_custkey::VARCHAR, o_orderdate, 'ORD' || o_orderkey, o_orderdate, o_totalprice, {S.ORDER_RAW} FROM orders),
due AS (SELECT *, mrn IN (SELECT mrn FROM gadm) AS known FROM sent)
SELECT 'stored' AS status, mrn, d AS creatinine_date, v AS creatinine_result, NULL AS raw FROM due WHERE known
QUALIFY row_number() OVER (PARTITION BY mrn, d ORDER BY t DESC, control_id DESC) = 1
UNION ALL SELECT 'held', mrn, NULL, NULL, raw FROM due WHERE NOT known""")
def q_replay_quarantine(spark, sf):
    """All results (the feed's and one per order) arrive before any
    admission, so all are held back; after the admissions the replay stores
    those whose patient is known by then."""
    is_adm = hl7.message_type(hl7.fields(hl7.segments(F.col("raw")))) == hl7.ADMISSION
    landing = _landing_parts(spark, sf, [~is_adm, is_adm])
    files.write_capture(B.order_results(spark, sf).coalesce(1), f"{landing}/part0/orders")
    root, ck = scratch_path(spark, "tables"), scratch_path(spark, "ckpt")
    writer = sinks.table_upsert_writer(root, spark.createDataFrame([], PATIENTS), spark.createDataFrame([], MEASUREMENTS), buckets=8)
    sinks.run_available_now(ingest.parsed_stream(spark, landing, _IN_TURN), ck, foreach_batch=writer)
    sinks.replay_quarantine(spark, root)
    held = sinks.quarantined(spark, root).where("reason = 'unknown_patient'")
    none = F.lit(None)
    return (tables.snapshot(spark, root, "measurements").select(F.lit("stored").alias("status"), "*", none.cast("string").alias("raw"))
            .unionByName(held.select(F.lit("held").alias("status"), "mrn", none.cast("timestamp").alias("creatinine_date"),
                                     none.cast("double").alias("creatinine_result"), "raw")))


_W4 = f"""{_STREAM_BASE},
pairs AS (SELECT k.msg_id AS k, k.mrn, k.t AS kt, k.control_id AS kc, k.d AS kd, h.d, h.v, h.t, h.control_id AS hc
          FROM acc k JOIN acc h ON h.mrn = k.mrn AND (h.t < k.t OR (h.t = k.t AND h.control_id <= k.control_id))),
latest AS (SELECT * FROM pairs QUALIFY row_number() OVER (PARTITION BY k, d ORDER BY t DESC, hc DESC) = 1),
stepped AS (SELECT *, v - lag(v) OVER (PARTITION BY k ORDER BY d) AS step FROM latest),
agg AS (SELECT k, mrn, kt, kc, kd, count(v) AS n_readings, avg(v) AS m_mean, quantile_cont(v, 0.5) AS m_median,
               max(v) AS m_max, min(v) AS m_min, max(step) AS m_delta, stddev_samp(v) AS m_std,
               arg_max(v, d) FILTER (WHERE v IS NOT NULL) AS m_recent
        FROM stepped GROUP BY k, mrn, kt, kc, kd),
demo AS (
  SELECT agg.k,
    (SELECT arg_max(g.age, strftime(g.t, '%Y%m%d%H%M%S') || g.control_id) FROM gadm g
     WHERE g.mrn = agg.mrn AND (g.t < agg.kt OR (g.t = agg.kt AND g.control_id < agg.kc))) AS adm_age,
    (SELECT arg_max(g.sex, strftime(g.t, '%Y%m%d%H%M%S') || g.control_id) FROM gadm g
     WHERE g.mrn = agg.mrn AND (g.t < agg.kt OR (g.t = agg.kt AND g.control_id < agg.kc))) AS adm_sex
  FROM agg),
w4 AS (SELECT mrn, kc AS control_id, kd AS creatinine_date, 'accepted' AS status,
         CAST(coalesce(CASE WHEN d.adm_sex IS NOT NULL THEN d.adm_age ELSE p.age END, 0) AS INTEGER) AS age,
         CAST(coalesce(CASE coalesce(d.adm_sex, p.sex) WHEN 'F' THEN 0 WHEN 'M' THEN 1 WHEN 'Other' THEN 2 END, 0)
              AS INTEGER) AS sex,
         n_readings,
         coalesce(m_mean, 0) AS creatinine_mean, coalesce(m_median, 0) AS creatinine_median,
         coalesce(m_max, 0) AS creatinine_max, coalesce(m_min, 0) AS creatinine_min,
         coalesce(m_delta, 0) AS creatinine_max_delta, coalesce(m_std, 0) AS creatinine_std,
         coalesce(m_recent, 0) AS most_recent,
         coalesce({S.ratio('m_recent', 'm_min')}, 0) AS rv1_ratio,
         coalesce({S.ratio('m_recent', 'm_median')}, 0) AS rv2_ratio
       FROM agg JOIN demo d USING (k) LEFT JOIN patients_b p USING (mrn))"""


@query("stream_history_state", f"""
WITH {_W4}
SELECT mrn, control_id, creatinine_date, status, age, sex, n_readings, {S.r9()} FROM w4
UNION ALL
SELECT mrn, control_id, d, 'unknown_patient', NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL
FROM fres WHERE msg_id NOT IN (SELECT msg_id FROM acc)""")
def q_stream_history(spark, sf):
    for k, v in state.STATE_CONF.items():
        spark.conf.set(k, v)
    landing = _landing(spark, sf)
    out, ck = scratch_path(spark, "history_out"), scratch_path(spark, "ckpt")
    feats = state.history_stream(ingest.parsed_stream(spark, landing), B.patients(spark, sf))
    sinks.run_available_now(feats, ck, sink_path=out)
    got = spark.read.parquet(out).drop("msg_time", "repeat")
    return got.withColumns({c: round9(F.col(c)) for c in FEATURE_COLUMNS})


@query("stream_alerts", f"""
WITH {_W4}
SELECT DISTINCT mrn, strftime(creatinine_date, '%Y%m%d%H%M%S') AS alert_ts,
       mrn || ',' || strftime(creatinine_date, '%Y%m%d%H%M%S') AS payload
FROM w4 WHERE rv1_ratio >= 1.5 OR rv2_ratio >= 1.5""")
def q_stream_alerts(spark, sf):
    for k, v in state.STATE_CONF.items():
        spark.conf.set(k, v)
    landing = _landing(spark, sf)
    out, ck = scratch_path(spark, "alerts_out"), scratch_path(spark, "ckpt")
    feats = state.history_stream(ingest.parsed_stream(spark, landing), B.patients(spark, sf))
    sinks.run_available_now(feats, ck, foreach_batch=sinks.alert_writer(out))
    return spark.read.parquet(out).select("mrn", "alert_ts", "payload").dropDuplicates()


def _chunks(spark, sf):
    """All messages as one connection's byte stream (the hottest possible
    key), cut so that every chunk holds the second half of one frame and the
    first half of the next: chunk k = tail(frame k) + head(frame k+1), with
    head(frame 0) alone as chunk -1.  Built with an equi-join on the next
    message number, so no per-connection string is ever assembled."""
    raw = B.hl7_raw(spark, sf)
    fr = raw.select("msg_id", F.concat(F.lit(hl7.START_BLOCK), "raw", F.lit(hl7.END_BLOCK)).alias("f"))
    parts = fr.select("msg_id", F.expr("substring(f, 1, int(floor(length(f) / 2)))").alias("head"),
                      F.expr("substring(f, int(floor(length(f) / 2)) + 1)").alias("tail"))
    nxt = parts.select((F.col("msg_id") - 1).alias("msg_id"), F.col("head").alias("next_head"))
    body = parts.join(nxt, "msg_id", "left").select(
        F.lit(0).cast("bigint").alias("conn_id"), F.col("msg_id").alias("seq"),
        F.concat(F.col("tail"), F.coalesce(F.col("next_head"), F.lit(""))).alias("bytes"))
    first = parts.where(F.col("msg_id") == parts.agg(F.min("msg_id")).scalar()).select(
        F.lit(0).cast("bigint").alias("conn_id"), F.lit(-1).cast("bigint").alias("seq"), F.col("head").alias("bytes"))
    # the chunk table is the input of reassembly: written once, read by each branch
    from ..operators.store import write_snapshot
    return write_snapshot(spark, body.unionByName(first), "chunks")


@query("stream_reassemble", f"WITH {S.MSG} SELECT msg_id AS frame_no, control_id, message_type, 'ok' AS status FROM msg")
def q_reassemble(spark, sf):
    from ..operators.reassemble import reassemble
    fr = reassemble(_chunks(spark, sf), block=256)
    m = F.col("message")
    return fr.select(F.col("frame_no").cast("bigint").alias("frame_no"), hl7.control_id(m).alias("control_id"),
                     hl7.message_type(hl7.fields(hl7.segments(m))).alias("message_type"), "status")


@query("stream_dedupe", f"WITH {S.MSG} SELECT control_id, message_type, route FROM parsed")
def q_stream_dedupe(spark, sf):
    """The feed delivered twice (two landing files per part); exact
    repeats are dropped within a 1-hour watermark on the message time."""
    landing = scratch_path(spark, "landing")
    raw = B.hl7_raw(spark, sf)
    files.write_capture(raw, landing + "/first")
    files.write_capture(raw, landing + "/again")
    out, ck = scratch_path(spark, "dedupe_out"), scratch_path(spark, "ckpt")
    fr = (spark.readStream.option("lineSep", hl7.START_BLOCK).option("recursiveFileLookup", "true")
               .format("text").load(landing).withColumn("source_file", F.col("_metadata.file_path")))
    parsed = ingest.parse_frames(files.frames(fr))
    dedup = (parsed.withColumn("msg_time", F.col("msg_id.msg_time"))
                   .withWatermark("msg_time", "1 hour")
                   .dropDuplicatesWithinWatermark(["raw"]))
    proj = dedup.select(F.col("msg_id.control_id").alias("control_id"), "message_type", "route")
    sinks.run_available_now(proj, ck, sink_path=out)
    return spark.read.parquet(out)


# Stored readings (one per order), the feed, then a correction of every stored reading.
_STORED_W4 = (_W4
    .replace("WHERE r.obx_pos = 1),", """WHERE r.obx_pos = 1
         UNION ALL SELECT -1 - o_orderkey, o_custkey::VARCHAR, TIMESTAMP '2024-02-01', 'COR' || o_orderkey, o_orderdate, o_totalprice / 2000
         FROM orders),""")
    .replace("pairs AS (", """hist AS (SELECT mrn, t, control_id, d, v FROM acc
         UNION ALL SELECT o_custkey::VARCHAR, TIMESTAMP '1900-01-01', '', o_orderdate, o_totalprice / 1000 FROM orders
         QUALIFY row_number() OVER (PARTITION BY o_custkey, o_orderdate ORDER BY o_orderkey DESC) = 1),
pairs AS (""")
    .replace("FROM acc k JOIN acc h", "FROM acc k JOIN hist h"))
_STORED_ALERTS = f"""
WITH {_STORED_W4}
SELECT DISTINCT mrn, strftime(creatinine_date, '%Y%m%d%H%M%S') AS alert_ts,
       mrn || ',' || strftime(creatinine_date, '%Y%m%d%H%M%S') AS payload
FROM w4 WHERE rv1_ratio >= 1.5 OR rv2_ratio >= 1.5"""


def _stored(spark, sf):
    from ..operators.store import dedupe_last
    return dedupe_last(B.order_readings(spark, sf), ["mrn", "creatinine_date"], ["creatinine_result"])


@query("alerts_stored", _STORED_ALERTS)
def q_alerts_stored(spark, sf):
    """One decision per arriving message over stored readings, keys that are
    overwritten later, and patients who are never admitted."""
    from . import alerts as AL
    texts = B.hl7_raw(spark, sf).select("raw").unionByName(B.order_corrections(spark, sf).select("raw"))
    return AL.arrival_alerts(ingest.parse_texts(texts), B.patients(spark, sf), _stored(spark, sf))


@query("stream_alerts_stored", _STORED_ALERTS)
def q_stream_alerts_stored(spark, sf):
    """The same in the patient state: stored readings begin it, the feed and the corrections are two batches."""
    for k, v in state.STATE_CONF.items():
        spark.conf.set(k, v)
    landing = scratch_path(spark, "landing")
    out, ck = scratch_path(spark, "alerts_out"), scratch_path(spark, "ckpt")
    for part, raw in (("part0", B.hl7_raw(spark, sf)), ("part1", B.order_corrections(spark, sf))):
        # each part lands as many files; the query is stopped in between and goes on from its checkpoint
        files.write_capture(raw, f"{landing}/{part}")
        feats = state.history_stream(ingest.parsed_stream(spark, landing, {"recursiveFileLookup": "true"}), B.patients(spark, sf), _stored(spark, sf))
        sinks.run_available_now(feats, ck, foreach_batch=sinks.alert_writer(out))
    return spark.read.parquet(out).select("mrn", "alert_ts", "payload").dropDuplicates()


# Held-back results take effect with the patient's first admission, in the order they arrived in.
_DEFERRED = f"""{_FRESH},
first_a AS (SELECT mrn, t, control_id FROM gadm QUALIFY row_number() OVER (PARTITION BY mrn ORDER BY t, control_id) = 1),
placed AS (SELECT f.*, a.t < f.t OR (a.t = f.t AND a.control_id < f.control_id) AS direct, a.t AS adm_t, a.control_id AS adm_c
           FROM fres f JOIN first_a a USING (mrn)),
acc AS (SELECT msg_id, mrn, d, v, control_id, direct, CASE WHEN direct THEN t ELSE adm_t END AS et, CASE WHEN direct THEN control_id ELSE adm_c END AS ec,
               row_number() OVER (ORDER BY CASE WHEN direct THEN t ELSE adm_t END, CASE WHEN direct THEN control_id ELSE adm_c END, t, control_id) AS ord
        FROM placed),
latest AS (SELECT k.msg_id AS k, h.d, h.v FROM acc k JOIN acc h ON h.mrn = k.mrn AND h.ord <= k.ord
           QUALIFY row_number() OVER (PARTITION BY k.msg_id, h.d ORDER BY h.ord DESC) = 1),
stepped AS (SELECT *, v - lag(v) OVER (PARTITION BY k ORDER BY d) AS step FROM latest),
agg AS (SELECT k, count(v) AS n_readings, avg(v) AS m_mean, quantile_cont(v, 0.5) AS m_median, max(v) AS m_max, min(v) AS m_min,
               max(step) AS m_delta, stddev_samp(v) AS m_std, arg_max(v, d) FILTER (WHERE v IS NOT NULL) AS m_recent
        FROM stepped GROUP BY k),
w4 AS (SELECT a.mrn, a.control_id, a.d AS creatinine_date, CASE WHEN direct THEN 'accepted' ELSE 'released' END AS status,
         (SELECT CAST(coalesce(arg_max(g.age, strftime(g.t, '%Y%m%d%H%M%S') || g.control_id), 0) AS INTEGER) FROM gadm g
          WHERE g.mrn = a.mrn AND (g.t < a.et OR (g.t = a.et AND g.control_id <= a.ec))) AS age,
         (SELECT CAST(CASE arg_max(g.sex, strftime(g.t, '%Y%m%d%H%M%S') || g.control_id) WHEN 'F' THEN 0 WHEN 'M' THEN 1 ELSE 2 END AS INTEGER)
          FROM gadm g WHERE g.mrn = a.mrn AND (g.t < a.et OR (g.t = a.et AND g.control_id <= a.ec))) AS sex,
         n_readings,
         coalesce(m_mean, 0) AS creatinine_mean, coalesce(m_median, 0) AS creatinine_median,
         coalesce(m_max, 0) AS creatinine_max, coalesce(m_min, 0) AS creatinine_min,
         coalesce(m_delta, 0) AS creatinine_max_delta, coalesce(m_std, 0) AS creatinine_std,
         coalesce(m_recent, 0) AS most_recent,
         coalesce({S.ratio('m_recent', 'm_min')}, 0) AS rv1_ratio,
         coalesce({S.ratio('m_recent', 'm_median')}, 0) AS rv2_ratio
       FROM agg JOIN acc a ON a.msg_id = agg.k)"""


@query("stream_deferred", f"""
WITH {_DEFERRED}
SELECT mrn, control_id, creatinine_date, status, age, sex, n_readings, {S.r9()} FROM w4
UNION ALL
SELECT mrn, control_id, d, 'unknown_patient', NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL
FROM fres WHERE msg_id NOT IN (SELECT msg_id FROM acc WHERE direct)""")
def q_stream_deferred(spark, sf):
    """Nobody is known at the start; results that come before their
    patient's admission wait in the patient's state and are released with it."""
    for k, v in state.STATE_CONF.items():
        spark.conf.set(k, v)
    landing = _landing_parts(spark, sf, _quarters(spark, sf))
    out, ck = scratch_path(spark, "deferred_out"), scratch_path(spark, "ckpt")
    feats = state.history_stream(ingest.parsed_stream(spark, landing, _IN_TURN), spark.createDataFrame([], PATIENTS), defer=True)
    sinks.run_available_now(feats, ck, sink_path=out)
    got = spark.read.parquet(out).drop("msg_time", "repeat")
    return got.withColumns({c: round9(F.col(c)) for c in FEATURE_COLUMNS})


# Messages sent event_id % 7 hours after the reading: MSH-7 (the arrival time
# and the time ages are computed at) moves, the OBR reading time does not.
_SENT = "(ts + to_hours(CAST(msg_id % 7 AS BIGINT)))"
_LATE_BASE = (_STREAM_BASE
              .replace("ev AS (SELECT msg_id, date_trunc('second', ts) AS t, control_id FROM msg)",
                       f"ev AS (SELECT msg_id, date_trunc('second', {_SENT}) AS t, control_id FROM msg)")
              .replace(S.AGE, S.age_sql(_SENT)))
_LATE_W4 = _W4.replace(_STREAM_BASE, _LATE_BASE)


@query("late_results", f"""
WITH {_LATE_W4}
SELECT mrn, control_id, creatinine_date, status, age, sex, n_readings, {S.r9()} FROM w4
UNION ALL
SELECT mrn, control_id, d, 'unknown_patient', NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL
FROM fres WHERE msg_id NOT IN (SELECT msg_id FROM acc)""")
def q_late_results(spark, sf):
    """Messages sent 0-6 hours after their reading, so they arrive out of
    date order; each late reading is upserted into the patient's state and
    the history is re-sorted by date (never dropped)."""
    for k, v in state.STATE_CONF.items():
        spark.conf.set(k, v)
    landing = scratch_path(spark, "landing")
    files.write_capture(B.hl7_raw(spark, sf, delay_mod=7), landing)
    out, ck = scratch_path(spark, "late_out"), scratch_path(spark, "ckpt")
    feats = state.history_stream(ingest.parsed_stream(spark, landing), B.patients(spark, sf))
    sinks.run_available_now(feats, ck, sink_path=out)
    got = spark.read.parquet(out).drop("msg_time", "repeat")
    return got.withColumns({c: round9(F.col(c)) for c in FEATURE_COLUMNS})


@query("order_guarantee", f"""
WITH {S.APPLIED}
SELECT msg_id, mrn, EXISTS (SELECT 1 FROM first_adm a WHERE a.mrn = r.mrn AND a.adm_id < r.msg_id) AS admitted_before
FROM first_res r WHERE r.mrn NOT IN (SELECT mrn FROM patients_b)""")
def q_order_guarantee(spark, sf):
    """Results of patients absent from the table: accepted only if an
    admission came earlier in message order, else kept in quarantine."""
    from . import alerts as AL
    from ..operators import parse as P
    parsed = AL.parse_feed(B.hl7_raw(spark, sf))
    applied = AL.apply_messages(parsed, B.patients(spark, sf))
    res = P.first_results(parsed).join(B.patients(spark, sf).select("mrn"), "mrn", "left_anti")
    acc = applied.accepted_results.select("msg_id", F.lit(True).alias("ok"))
    return (res.join(acc, "msg_id", "left")
               .select("msg_id", "mrn", F.col("ok").isNotNull().alias("admitted_before")))


@query("stream_reassemble_state", f"WITH {S.MSG} SELECT msg_id AS frame_no, control_id, message_type, 'ok' AS status FROM msg")
def q_reassemble_state(spark, sf):
    """T2 in Structured Streaming: the chunk stream of ``_chunks`` (all
    traffic on one connection) written as Parquet files into a landing
    folder, reassembled by the per-connection buffer state."""
    from ..streaming.frames import frame_stream
    for k, v in state.STATE_CONF.items():
        spark.conf.set(k, v)
    chunks = _chunks(spark, sf)          # written once; its folder is the landing
    landing = chunks.inputFiles()[0].rsplit("/", 1)[0]
    out, ck = scratch_path(spark, "frames_out"), scratch_path(spark, "ckpt")
    stream = spark.readStream.schema(chunks.schema).parquet(landing)
    sinks.run_available_now(frame_stream(stream), ck, sink_path=out)
    fr = spark.read.parquet(out)
    m = F.col("message")
    return fr.select("frame_no", hl7.control_id(m).alias("control_id"),
                     hl7.message_type(hl7.fields(hl7.segments(m))).alias("message_type"), "status")
