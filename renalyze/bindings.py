"""Deterministic bindings of the driver tables to the clinical data model.

The driver ships generic tables (``customer``, ``events``, ``labels``,
``documents``).  These functions derive the clinical tables from them with
plain projections and filters, so every query's work grows with the input:

* ``patients``      <- customer (custkey not a multiple of 10)
* ``measurements``  <- events of type click / view / purchase
* ``hl7_raw``       <- every event rendered as an HL7 v2 message
* ``predictions``   <- labels (quality = truth, toxic = prediction)

The same rules are restated in SQL in ``plans.catalog`` so that the DuckDB
oracle computes expected rows directly from the driver tables.
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .session import prepare, spread_for_cpu

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels",
          "conversations"]

# Fixed values of the binding.
RESULT_EVENT_TYPES = ["click", "view", "purchase"]
SEX_BY_MOD3 = ["F", "M", "Other"]          # key % 3 -> sex
DOB_ORIGIN = "1930-01-01"                  # dob = origin + (user_id * 7919) % 25000 days
DOB_MULT, DOB_SPAN = 7919, 25000
SENDER = "WARDFEED|EAST CLINIC"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def _sex_of(key: Column) -> Column:
    k = key % 3
    return (F.when(k == 0, F.lit(SEX_BY_MOD3[0]))
             .when(k == 1, F.lit(SEX_BY_MOD3[1]))
             .otherwise(F.lit(SEX_BY_MOD3[2])))


def patients(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Patients(mrn, age, sex) from customer; every 10th key is missing."""
    c = table(spark, sf_dir, "customer").select("c_custkey")
    return (c.where(F.col("c_custkey") % 10 != 0)
             .select(F.col("c_custkey").cast("string").alias("mrn"),
                     (F.lit(18) + F.col("c_custkey") % 70).cast("int").alias("age"),
                     _sex_of(F.col("c_custkey")).alias("sex")))


def measurement_rows(spark: SparkSession, sf_dir: str, unit: str = "second",
                     types: list[str] | None = None) -> DataFrame:
    """Measurement rows with an ``arrival`` order (event_id), possibly with
    repeated keys (mrn, creatinine_date) when ``unit`` is coarse."""
    e = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value")
    return (e.where(F.col("event_type").isin(types or RESULT_EVENT_TYPES))
             .select(F.col("user_id").cast("string").alias("mrn"),
                     F.date_trunc(unit, "ts").alias("creatinine_date"),
                     F.col("value").alias("creatinine_result"),
                     F.col("event_id").alias("arrival")))


def dob_text(user_id: Column) -> Column:
    days = ((user_id * DOB_MULT) % DOB_SPAN).cast("int")
    return F.date_format(F.date_add(F.lit(DOB_ORIGIN).cast("date"), days), "yyyyMMdd")


def hl7_raw(spark: SparkSession, sf_dir: str, delay_mod: int | None = None) -> DataFrame:
    """hl7_raw(msg_id, raw, sent_ts): one HL7 v2 message per event.

    signup -> ADT^A01 (with NK1), error -> ADT^A03, click/view -> ORU^R01.
    ADT messages with ``event_id % 5 == 0`` have a blank PID-3; admissions
    with ``event_id % 5 == 1`` carry sex ``U`` (outside the allowed set).
    purchase -> ORU^R01 made odd by ``event_id % 6``: 0 non-numeric OBX-5,
    1 two OBX, 2 no OBX, 3 bad MRN, 4 unknown type ORU^R99, 5 empty MSH-10.
    OBR-7 has 14 digits for odd ids and 12 digits for even ids.
    ``delay_mod``: the message is sent ``event_id % delay_mod`` hours after
    the reading (MSH-7 shifted), so arrival order differs from date order.
    """
    # rendering text is CPU work: spread a scan with fewer splits than cores
    e = spread_for_cpu(table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value"))
    eid, uid, et = F.col("event_id"), F.col("user_id"), F.col("event_type")
    odd = F.when(et == "purchase", eid % 6)
    sent = F.col("ts") + F.make_dt_interval(hours=(eid % delay_mod).cast("int")) if delay_mod else F.col("ts")
    ts14 = F.date_format("ts", "yyyyMMddHHmmss")
    obr_time = F.when(eid % 2 == 0, F.date_format("ts", "yyyyMMddHHmm")).otherwise(ts14)
    mtype = (F.when(et == "signup", F.lit("ADT^A01"))
              .when(et == "error", F.lit("ADT^A03"))
              .when(odd == 4, F.lit("ORU^R99"))
              .otherwise(F.lit("ORU^R01")))
    ctrl = F.when(odd == 5, F.lit("")).otherwise(F.concat(F.lit("MSG"), eid.cast("string")))
    msh = F.concat(F.lit("MSH|^~\\&|" + SENDER + "|||"), F.date_format(sent, "yyyyMMddHHmmss"), F.lit("||"), mtype,
                   F.lit("|"), ctrl, F.lit("|2.5"))
    adt_odd = F.when(et.isin("signup", "error"), eid % 5)
    mrn_txt = (F.when(odd == 3, F.concat(F.lit("MRN"), uid.cast("string")))
                .when(adt_odd == 0, F.lit(""))
                .otherwise(uid.cast("string")))
    sex_txt = F.when(adt_odd == 1, F.lit("U")).otherwise(_sex_of(uid))
    pid_short = F.concat(F.lit("PID|1||"), mrn_txt)
    pid_full = F.concat(F.lit("PID|1||"), mrn_txt, F.lit("||P^"), uid.cast("string"),
                        F.lit("||"), dob_text(uid), F.lit("|"), sex_txt)
    nk1 = F.concat(F.lit("NK1|1|KIN^"), uid.cast("string"), F.lit("|PARTNER"))
    obr = F.concat(F.lit("OBR|1||||||"), obr_time)
    value_txt = F.when(odd == 0, F.lit("NEG")).otherwise(F.col("value").cast("string"))
    obx1 = F.concat(F.lit("OBX|1|SN|CREATININE||"), value_txt)
    obx2 = F.concat(F.lit("OBX|2|SN|CREATININE||"), (F.col("value") * 2).cast("string"))
    body = (F.when(et == "signup", F.concat_ws("\r", msh, pid_full, nk1))
             .when(et == "error", F.concat_ws("\r", msh, pid_short))
             .when(odd == 2, F.concat_ws("\r", msh, pid_short, obr))
             .when(odd == 1, F.concat_ws("\r", msh, pid_short, obr, obx1, obx2))
             .otherwise(F.concat_ws("\r", msh, pid_short, obr, obx1)))
    return e.select(eid.alias("msg_id"), body.alias("raw"), sent.alias("sent_ts"))


def order_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """hl7_raw(msg_id, raw): one result message per order, of its customer, at
    its date with its price; most customers are never admitted by ``hl7_raw``."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_totalprice")
    t = F.date_format("o_orderdate", "yyyyMMddHHmmss")
    key = F.col("o_orderkey")
    raw = F.concat(F.lit("MSH|^~\\&|ARCHIVE|NORTH LAB|||"), t, F.lit("||ORU^R01|ORD"), key.cast("string"), F.lit("|2.5\rPID|1||"),
                   F.col("o_custkey").cast("string"), F.lit("\rOBR|1||||||"), t, F.lit("\rOBX|1|SN|CREATININE||"),
                   F.col("o_totalprice").cast("string"))
    return o.select(key.alias("msg_id"), raw.alias("raw"))


def order_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readings stored before the feed: one per order (mrn, creatinine_date,
    creatinine_result, arrival), its price in thousands."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_totalprice")
    return o.select(F.col("o_custkey").cast("string").alias("mrn"), F.col("o_orderdate").cast("timestamp").alias("creatinine_date"),
                    (F.col("o_totalprice") / 1000).alias("creatinine_result"), F.col("o_orderkey").alias("arrival"))


CORRECTED_AT = "20240201000000"            # after the feed


def order_corrections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """hl7_raw(msg_id, raw): after the feed, every stored reading is corrected
    to half its value, of patients known, admitted by the feed, or neither."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_totalprice")
    key = F.col("o_orderkey")
    raw = F.concat(F.lit(f"MSH|^~\\&|ARCHIVE|NORTH LAB|||{CORRECTED_AT}||ORU^R01|COR"), key.cast("string"), F.lit("|2.5\rPID|1||"),
                   F.col("o_custkey").cast("string"), F.lit("\rOBR|1||||||"), F.date_format("o_orderdate", "yyyyMMddHHmmss"),
                   F.lit("\rOBX|1|SN|CREATININE||"), (F.col("o_totalprice") / 2000).cast("string"))
    return o.select(key.alias("msg_id"), raw.alias("raw"))


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, label, prediction, score): quality is the truth, toxic the
    prediction, documents.n_chars the score (NULL when the doc is absent)."""
    lab = table(spark, sf_dir, "labels")
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    return (lab.join(docs, "doc_id", "left")
               .select("doc_id", F.col("quality").alias("label"),
                       F.col("toxic").alias("prediction"),
                       F.col("n_chars").cast("double").alias("score")))
