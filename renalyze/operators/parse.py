"""Parse and route HL7 messages.

``parse_messages`` adds one struct column computed row-locally from the raw
text; all outputs below are projections / filters of it, so routing a whole
message table is one narrow stage with no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import hl7

ROUTES = {hl7.ADMISSION: "admissions", hl7.DISCHARGE: "discharges", hl7.RESULT: "results"}


def parse_messages(raw: DataFrame, default_time: Column | str | None = None,
                   as_of: Column | str | None = None, default_to_msh_time: bool = False) -> DataFrame:
    """hl7_raw(msg_id, raw, ...) -> one row per message with parsed columns.

    ``default_time`` replaces an empty OBR-7 (the upstream uses the wall
    clock; here it is a column, e.g. the arrival time, so runs repeat).
    ``as_of`` is the date ages are computed at (default: the MSH-7 time).
    ``default_to_msh_time`` uses the message's own MSH-7 text for an empty
    OBR-7 (read from the already split fields).  The output also carries
    ``msg_time``, the MSH-7 time.
    """
    dt = F.col(default_time) if isinstance(default_time, str) else (
        default_time if default_time is not None else F.lit(None).cast("string"))
    # Evaluation boundaries: a one-element ``inline`` makes each stage's
    # struct a generated column, so the optimizer cannot substitute the
    # (large) fold into every later filter and projection that reads it.
    keep = [c for c in raw.columns]
    split_once = raw.select(*keep, F.inline(F.array(F.struct(
        hl7.fields(hl7.segments(F.col("raw"))).alias("_f"),
        hl7.default_time_text(dt).alias("_dt")))))
    msh = F.try_element_at(F.filter(F.col("_f"), lambda f: f[0] == F.lit("MSH")), F.lit(-1))
    msh_time = hl7.hl7_time(F.get(msh, 6))
    fallback = F.coalesce(F.col("_dt"), F.get(msh, 6)) if default_to_msh_time else F.col("_dt")
    df = split_once.select(*keep, F.inline(F.array(F.struct(
        hl7.parse_state(F.col("_f"), fallback).alias("_st"),
        # the ACK is built from the stripped message, as the receiver does
        hl7.control_id_from_fields(F.col("_f")).alias("_cid"),
        msh_time.alias("_msh_time")))))
    age_at = (F.col(as_of) if isinstance(as_of, str) else as_of) if as_of is not None else F.col("_msh_time")
    mtype = F.col("_st.mtype")
    reason = (F.when(F.col("_st.bad_mrn"), F.lit("bad_mrn"))
               .when(mtype.isNull() | ~mtype.isin(hl7.KNOWN_TYPES), F.lit("unknown_type"))
               .when((mtype == hl7.ADMISSION) & F.col("_st.mrn").isNull(), F.lit("no_mrn"))
               .when((mtype == hl7.ADMISSION) & ~F.col("_st.demo"), F.lit("no_demographics"))
               .when((mtype == hl7.RESULT) & (F.size("_st.tests") == 0), F.lit("no_result")))
    route = F.when(reason.isNull(), F.element_at(
        F.create_map(*[x for k, v in ROUTES.items() for x in (F.lit(k), F.lit(v))]), mtype)
    ).otherwise(F.lit("quarantine"))
    return df.select(
        *[c for c in raw.columns],
        mtype.alias("message_type"),
        F.col("_st.mrn").cast("string").alias("mrn"),
        F.col("_st.name").alias("name"),
        hl7.age_from_dob(F.col("_st.dob"), age_at).alias("age"),
        F.col("_st.sex").alias("sex"),
        F.col("_st.tests").alias("tests"),
        F.col("_cid").alias("control_id"),
        F.col("_msh_time").alias("msg_time"),
        route.alias("route"),
        reason.alias("reason"),
    )


def route_messages(parsed: DataFrame) -> DataFrame:
    """(msg_id, message_type, route, reason)."""
    return parsed.select("msg_id", "message_type", "route", "reason")


def admissions(parsed: DataFrame) -> DataFrame:
    """admissions(msg_id, mrn, name, age, sex)."""
    return (parsed.where(F.col("route") == "admissions")
                  .select("msg_id", "mrn", "name", "age", "sex"))


def discharges(parsed: DataFrame) -> DataFrame:
    """discharges(msg_id, mrn); mrn may be NULL (no state effect)."""
    return parsed.where(F.col("route") == "discharges").select("msg_id", "mrn")


def results(parsed: DataFrame) -> DataFrame:
    """One row per OBX with a patient number seen before it.

    ``posexplode`` of an array built row-locally: a narrow generator, the
    message never leaves its partition.
    """
    r = parsed.where(F.col("route") == "results").select("msg_id", F.inline("tests"))
    return r.select("msg_id", "obx_pos", F.col("mrn").cast("string").alias("mrn"),
                    "test_value", "test_time")


def first_results(parsed: DataFrame) -> DataFrame:
    """the first OBX row of each result message (the one that is used)."""
    t = F.get(F.col("tests"), 0)
    return (parsed.where(F.col("route") == "results")
                  .select("msg_id", t["mrn"].cast("string").alias("mrn"),
                          t["test_value"].alias("test_value"),
                          t["test_time"].alias("test_time"),
                          "control_id"))


def quarantine(parsed: DataFrame) -> DataFrame:
    """Messages that are not processed, with the reason."""
    return parsed.where(F.col("route") == "quarantine").select("msg_id", "raw", "reason")
