"""Streaming sinks: table upserts (T3), quarantine and its replay (T8, F1),
and the alert outbox (T5) via foreachBatch.

A batch of messages is applied in five steps: a record that names the state it
starts from, the changed buckets, the quarantine, the commit of both tables,
the ACKs.  A batch that broke off at any point is applied again from the state
in its record, not from what it left behind, so its tables, quarantine and
ACKs come out as if it had run once.  There is one writer at a time.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import scoring
from ..plans import alerts as AL
from . import ingest, tables

QUARANTINE = "msg_id string, msg_time timestamp, control_id string, mrn string, raw string, reason string"


def _tagged(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """All batches of an outbox-like folder (an empty table before the first)."""
    if not tables.path_exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(path)


def apply_batch(spark: SparkSession, root: str, parsed: DataFrame, name: str, acks: str | None = None,
                buckets: int = tables.BUCKETS) -> None:
    """Apply parsed messages to the tables under ``root`` as the batch ``name``."""
    record, tag = f"{root}/_batches/{name}", name.replace("/", "-")
    if tables.path_exists(spark, f"{record}.done"):
        return
    begun = tables.read_json(spark, f"{record}.begun")
    taken = None if begun is None else tables.read_json(spark, f"{root}/_commits/{begun['base']['version'] + 1}")
    if begun is None or (taken is not None and taken["by"] != name):     # new, or another batch has been committed since
        begun = {"base": tables.committed(spark, root) or tables.nothing(buckets),
                 "at": dt.datetime.now(dt.timezone.utc).strftime("%Y-%m-%d %H:%M:%S")}
        tables.write_json(spark, f"{record}.begun", begun)
        taken = None
    base, target = begun["base"], begun["base"]["version"] + 1
    n = base["buckets"]
    parsed = parsed.persist()
    rows = None
    try:
        key = AL.message_mrn()
        near = tables.touched(parsed.select(key.alias("mrn")).where("mrn IS NOT NULL"), n)
        rows = AL.decided(parsed, tables.stored(spark, root, "patients", base, near).select("mrn")).persist()
        if taken is None:
            taken = {"by": name, "state": tables.advance(base, target, _write_changes(spark, root, rows, base, target))}
            rows.where(F.col("reason").isNotNull()).select(
                F.col("msg_id").cast("string").alias("msg_id"), "msg_id.msg_time", "msg_id.control_id", "mrn", "raw", "reason") \
                .write.mode("overwrite").parquet(f"{root}/quarantine/batch={tag}")
            tables.write_json(spark, f"{root}/_commits/{target}", taken)
        if (tables.latest_version(spark, root) or -1) < target:
            tables.commit(spark, root, taken["state"])
        if acks:
            scoring.ack_outbox(rows.where(F.col("reason").isNull()).withColumn("ack_ts", F.to_timestamp(F.lit(begun["at"]))), "ack_ts") \
                .select(F.col("msg_id").cast("string").alias("msg_id"), "control_id", "ack") \
                .write.mode("overwrite").parquet(f"{acks}/batch={tag}")
        tables.write_json(spark, f"{record}.done", {"version": target})
    finally:
        parsed.unpersist()
        if rows is not None:
            rows.unpersist()


def _write_changes(spark: SparkSession, root: str, rows: DataFrame, base: dict, target: int) -> dict[str, list[int]]:
    """Write the buckets that accepted messages touch, as version ``target``."""
    accepted = rows.where(F.col("reason").isNull()).withColumnRenamed("msg_id", "arrival")
    updates = {"patients": accepted.where(F.col("route") == "admissions").select("mrn", "age", "sex", "arrival"),
               "measurements": accepted.where(F.col("route") == "results").select("mrn", "creatinine_date", "creatinine_result", "arrival")}
    changed = {}
    for table, new in updates.items():
        changed[table] = tables.touched(new, base["buckets"])
        if changed[table]:
            old = tables.stored(spark, root, table, base, changed[table])
            tables.write_buckets(tables.merged(old, new, table), root, table, target, base["buckets"])
    return changed


def table_upsert_writer(root: str, patients0: DataFrame, measurements0: DataFrame, acks: str | None = None,
                        buckets: int = tables.BUCKETS, keep_old: bool = True):
    """foreachBatch function applying each batch of parsed messages to
    Patients / Measurements, with the batch's quarantine and (if ``acks`` is
    given) one ACK per processed message, written after the commit.

    Tables that do not exist yet begin as ``patients0`` / ``measurements0``.
    Batch ids restart with a new checkpoint, query ids do not repeat, so a new
    query's batches are never taken for old ones.  Without ``keep_old`` the bucket versions
    that neither the batch's state nor the one before it names are deleted.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        query = spark.sparkContext.getLocalProperty("sql.streaming.queryId") or "none"
        before = tables.committed(spark, root)
        if before is None:
            tables.create(spark, root, patients0, measurements0, buckets)
            before = tables.committed(spark, root)
        apply_batch(spark, root, batch, f"{query}/{batch_id}", acks, buckets)
        if not keep_old:
            tables.expire(spark, root, [before, tables.committed(spark, root)])
    return write


def quarantined(spark: SparkSession, root: str) -> DataFrame:
    """The messages still held back: quarantined and not released since."""
    held = _tagged(spark, f"{root}/quarantine", QUARANTINE)
    gone = _tagged(spark, f"{root}/released", "msg_id string, reason string")
    return held.join(gone, ["msg_id", "reason"], "left_anti").dropDuplicates(["msg_id", "reason"])


def replay_quarantine(spark: SparkSession, root: str, acks: str | None = None) -> bool:
    """Apply the held results of patients who are in Patients by now, from
    their text, as one more batch; they keep their own arrival, so a reading
    corrected in the meantime stays corrected.  What is released is marked after
    its batch; a replay that broke off in between is repeated without effect on the tables.
    Returns whether anything was released."""
    state = tables.committed(spark, root)
    if state is None:
        return False
    held = quarantined(spark, root).where(F.col("reason") == "unknown_patient")
    due = held.join(tables.stored(spark, root, "patients", state).select("mrn"), "mrn", "left_semi")
    due = AL.store.write_snapshot(spark, due, "replay")
    if due.isEmpty():
        return False
    name = f"replay/{state['version']}"
    apply_batch(spark, root, ingest.parse_texts(due.select("raw")), name, acks, state["buckets"])
    due.select("msg_id", "reason").write.mode("overwrite").parquet(f"{root}/released/batch={name.replace('/', '-')}")
    return True


def alert_writer(root: str, dedupe: bool = True, scorer=None):
    """T5: score feature rows, write positives as alerts.

    ``scorer`` maps feature rows to rows with an integer ``prediction``
    column: by default the deterministic rule (``scoring.rule_score``); pass
    ``lambda df: scoring.predict(model, df)`` to page from a trained model.
    ``dedupe`` skips results that repeat a stored reading exactly (a
    redelivered message: the state flags it, so this holds across
    micro-batches) and keeps one page per (mrn, alert_ts) within a batch;
    the upstream pages again on redelivery (``dedupe=False``)."""
    score = scorer or scoring.rule_score

    def write(batch: DataFrame, batch_id: int) -> None:
        features = batch.where(F.col("status").isin("accepted", "released"))
        if dedupe and "repeat" in batch.columns:
            features = features.where(~F.col("repeat"))
        scored = score(features).withColumn(
            "alert_time", F.date_format("creatinine_date", "yyyyMMddHHmmss"))
        out = scoring.alert_outbox(scored, "alert_time", dedupe=dedupe)
        query = batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId") or "none"
        out.write.mode("overwrite").parquet(f"{root}/batch={batch_id}-{query[:8]}")     # batch ids restart with a new checkpoint
    return write


def run_available_now(df: DataFrame, checkpoint: str, *, sink_path: str | None = None,
                      foreach_batch=None, fmt: str = "parquet") -> None:
    """Run a streaming query over everything available, then stop."""
    w = df.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True)
    if foreach_batch is not None:
        q = w.foreachBatch(foreach_batch).start()
    else:
        q = w.format(fmt).outputMode("append").option("path", sink_path).start()
    q.awaitTermination()
    if q.exception() is not None:
        raise RuntimeError(str(q.exception()))
