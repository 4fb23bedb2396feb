"""Joins of the data model (J1, J2, J4, J5) and a size-checked broadcast."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Largest side (bytes, as estimated by the optimizer) we hint to broadcast.
BROADCAST_LIMIT_BYTES = 64 * 1024 * 1024


def estimated_bytes(df: DataFrame) -> int | None:
    """Optimizer size estimate of a plan (None when unknown)."""
    try:
        stats = df._jdf.queryExecution().optimizedPlan().stats()
        return int(str(stats.sizeInBytes()))
    except Exception:  # noqa: BLE001 - estimate only
        return None


def maybe_broadcast(df: DataFrame, limit: int = BROADCAST_LIMIT_BYTES) -> DataFrame:
    """Broadcast ``df`` only when its estimated size is known and below
    ``limit``; otherwise leave the choice to the planner (sort-merge / AQE)."""
    size = estimated_bytes(df)
    return F.broadcast(df) if size is not None and size <= limit else df


def patient_history(patients: DataFrame, measurements: DataFrame) -> DataFrame:
    """Demographics + every measurement; patients without any are kept.

    Written as inner join + anti join rather than one left outer join: AQE
    can split a skewed partition of either side of an inner join (a patient
    with a huge history), but never the non-preserved side of an outer
    join.  The anti join runs against the distinct patient numbers of the
    readings (a partial aggregate: one row per patient)."""
    p = patients.select("mrn", "age", "sex")
    m = measurements.select("mrn", "creatinine_date", "creatinine_result")
    with_readings = p.join(m, "mrn", "inner")
    without = (p.join(m.select("mrn").distinct(), "mrn", "left_anti")
                .select("mrn", "age", "sex", F.lit(None).cast("timestamp").alias("creatinine_date"),
                        F.lit(None).cast("double").alias("creatinine_result")))
    return with_readings.unionByName(without)


def ack_reconcile(messages: DataFrame, acked_ids: DataFrame) -> DataFrame:
    """(msg_id, control_id, acked) for sent messages against ACKed ids.

    ACKs carry only the control id, so ids are made distinct first (no
    fan-out); an empty id cannot be matched and counts as not acknowledged.
    """
    ids = (acked_ids.where(F.col("control_id") != "").select("control_id").distinct()
                    .withColumn("_hit", F.lit(True)))
    return (messages.join(ids, "control_id", "left")
                    .select("msg_id", "control_id",
                            (F.col("_hit").isNotNull() & (F.col("control_id") != "")).alias("acked")))
