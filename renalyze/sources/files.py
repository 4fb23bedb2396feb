"""File sources and sinks: wide / split CSV, Parquet tables, MLLP captures.

CSV is read without type inference: every column is text as named by the
header, so a header-driven (dynamic) slot count costs one header read and
types are applied by explicit casts afterwards.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import hl7
from ..functions.dates import parse_date_strict
from ..operators.reshape import DATE_PREFIX, RESULT_PREFIX
from ..session import spread_for_cpu


# ---------------------------------------------------------------- CSV

def scan_wide_history(spark: SparkSession, path: str) -> DataFrame:
    """Wide history CSV (mrn, creatinine_date_i, creatinine_result_i, ...),
    all columns as text; width comes from the header."""
    return spark.read.option("header", True).option("inferSchema", False).csv(path)


def write_wide_history(rows: DataFrame, path: str, extra: list[str] | None = None) -> None:
    """Wide rows (mrn, slots, ...) as a wide history CSV.  A line is rendered
    from its row alone; only the header depends on the longest history."""
    extra = extra or []
    width = rows.agg(F.max(F.size("slots"))).first()[0] or 0
    names = ["mrn", *(c for i in range(width) for c in (f"{DATE_PREFIX}{i}", f"{RESULT_PREFIX}{i}")), *extra]
    cells = F.flatten(F.transform("slots", lambda s: F.array(
        F.coalesce(F.date_format(s["creatinine_date"], "yyyy-MM-dd HH:mm:ss"), F.lit("")),
        F.coalesce(s["creatinine_result"].cast("string"), F.lit("")))))
    # concat_ws skips NULLs only, so a patient without slots keeps its one cell
    line = F.concat(F.concat_ws(",", "mrn", F.when(F.size("slots") > 0, F.array_join(cells, ","))),
                    F.repeat(F.lit(","), 2 * (F.lit(width) - F.size("slots"))),
                    *[F.concat(F.lit(","), F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in extra])
    # one column named by the whole header: every part file begins with it
    (rows.select(line.alias(",".join(names))).write.mode("errorifexists")
         .option("header", True).option("sep", "\x01").option("quote", "").csv(path))


def scan_wide_rows(spark: SparkSession, path: str) -> DataFrame:
    """Wide history CSV as wide rows: its other columns (text) and ``slots``,
    an array of (creatinine_date, creatinine_result) texts.

    The plan has a fixed number of columns: a line is split into cells and the
    slots are cut from the array by place.  The header (one line, sent to the
    driver) says where they begin; blank cells are NULL.
    """
    text = spark.read.text(path)
    header = text.where(F.col("value").contains(DATE_PREFIX)).first()
    if header is None:
        raise ValueError(f"no wide history header in {path}")
    names = [c.strip().strip('"') for c in header[0].split(",")]
    numbers = sorted(int(c[len(DATE_PREFIX):]) for c in names if c.startswith(DATE_PREFIX))
    place = {c: k for k, c in enumerate(names)}
    base, n = place[f"{DATE_PREFIX}{numbers[0]}"], len(numbers)
    regular = all(place.get(f"{DATE_PREFIX}{numbers[0] + i}") == base + 2 * i
                  and place.get(f"{RESULT_PREFIX}{numbers[0] + i}") == base + 2 * i + 1 for i in range(n))
    if not regular:
        raise ValueError("the slots of a wide history must be neighbouring columns in order (see scan_wide_history)")
    quoted = F.transform(F.split("value", ',(?=(?:[^"]*"[^"]*")*[^"]*$)', -1), lambda c: F.regexp_replace(c, '^"|"$', ""))
    cells = F.when(F.col("value").contains('"'), quoted).otherwise(F.split("value", ",", -1))
    lines = text.where(F.col("value") != header[0]).select(F.transform(cells, lambda c: F.nullif(F.trim(c), F.lit(""))).alias("_c"))
    slots = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.struct(
        F.get(F.col("_c"), F.lit(base) + 2 * i).alias("creatinine_date"), F.get(F.col("_c"), F.lit(base + 1) + 2 * i).alias("creatinine_result")))
    first = F.slice(F.transform(F.array(F.lit(None)), lambda x: F.struct(F.lit(None).cast("string").alias("creatinine_date"),
                                                                         F.lit(None).cast("string").alias("creatinine_result"))), 1, 1)
    lead = F.array_repeat(F.get(first, 0), numbers[0])           # a file that begins at a later slot
    others = [c for c in names if not c.startswith((DATE_PREFIX, RESULT_PREFIX))]
    return lines.select(*[F.get(F.col("_c"), place[c]).alias(c) for c in others], F.concat(lead, slots).alias("slots"))


def typed_cells(long: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Long text cells (mrn, slot, creatinine_date, creatinine_result) ->
    (typed rows, cells that do not parse with the reason)."""
    date = parse_date_strict(F.col("creatinine_date"))
    value = F.col("creatinine_result").try_cast("double")
    reason = F.when(date.isNull(), "bad_date").when(value.isNull(), "bad_result")
    good = long.where(reason.isNull()).withColumns({"creatinine_date": date, "creatinine_result": value})
    return good, long.where(reason.isNotNull()).withColumn("reason", reason)


def scan_labelled(spark: SparkSession, path: str) -> DataFrame:
    """Labelled wide CSV (wide history + age, sex, aki), all text."""
    return scan_wide_history(spark, path)


def scan_patients_csv(spark: SparkSession, path: str) -> DataFrame:
    """patients.csv: mrn, age, sex."""
    return spark.read.option("header", True).schema("mrn string, age int, sex string").csv(path)


def scan_measurements_csv(spark: SparkSession, path: str) -> DataFrame:
    """measurements.csv: mrn, measurement_date, measurement_value."""
    df = spark.read.option("header", True).schema(
        "mrn string, measurement_date string, measurement_value double").csv(path)
    return df.withColumn("measurement_date", F.try_to_timestamp("measurement_date"))


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Header CSV, timestamps as ``yyyy-MM-dd HH:mm:ss``."""
    (df.write.mode(mode).option("header", True)
       .option("timestampFormat", "yyyy-MM-dd HH:mm:ss").csv(path))


def sink_split_csv(patients: DataFrame, measurements: DataFrame, root: str) -> tuple[str, str]:
    """patients.csv (mrn, age, sex) and measurements.csv (mrn,
    measurement_date, measurement_value) under ``root``."""
    p, m = f"{root}/patients.csv", f"{root}/measurements.csv"
    write_csv(patients.select("mrn", "age", "sex"), p)
    write_csv(measurements.select("mrn", F.col("creatinine_date").alias("measurement_date"),
                                  F.col("creatinine_result").alias("measurement_value")), m)
    return p, m


# ---------------------------------------------------------------- Parquet tables

def scan_tables(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """Patients and Measurements stored as Parquet under ``root``."""
    return (spark.read.parquet(f"{root}/patients"), spark.read.parquet(f"{root}/measurements"))


def scan_table_jdbc(spark: SparkSession, url: str, table: str, partition_column: str,
                    lower: int, upper: int, num_partitions: int, properties: dict | None = None) -> DataFrame:
    """Read a table from a relational database in ``num_partitions`` parallel
    range queries on a numeric column (the upstream keeps Patients and
    Measurements in MySQL).  Not exercised by the tests: no database runs
    here."""
    return spark.read.jdbc(url, table, column=partition_column, lowerBound=lower, upperBound=upper,
                           numPartitions=num_partitions, properties=properties or {})


def write_tables(patients: DataFrame, measurements: DataFrame, root: str) -> None:
    """Measurements are clustered by mrn within files so row-group min/max
    statistics skip most of a file for a patient lookup."""
    patients.write.mode("errorifexists").parquet(f"{root}/patients")
    (measurements.repartition("mrn").sortWithinPartitions("mrn", "creatinine_date")
                 .write.mode("errorifexists").parquet(f"{root}/measurements"))


# ---------------------------------------------------------------- MLLP capture

def write_capture(messages: DataFrame, path: str, text_col: str = "raw") -> None:
    """Write messages as MLLP frames: 0x0b + message + 0x1c 0x0d, back to back.

    Each row is written as ``0x0b message 0x1c`` with 0x0d as the record
    separator, which yields exactly the framed byte stream.
    """
    (messages.select(F.concat(F.lit(hl7.START_BLOCK), F.col(text_col), F.lit("\x1c")).alias("value"))
             .write.mode("errorifexists").option("lineSep", "\r").text(path))


def frames(records: DataFrame) -> DataFrame:
    """Classify records split on the start byte (one per frame).

    A record holds everything after a start byte up to the next one.  The
    empty record before the first start byte of a file is its head and is
    dropped.  A good frame ends with its only end block ``0x1c 0x0d``; a
    record with no end byte is an open frame (``trailing_data``); anything
    else is ``bad_framing``; ``frame`` keeps the text of those.  Every check is on the
    record alone, so the scan stays distributed.
    """
    v = F.col("value")
    n = F.length(v)
    first_end = F.instr(v, "\x1c")
    good = (first_end == n - 1) & v.endswith("\r")
    status = (F.when(good, F.lit("ok"))
               .when(first_end == 0, F.lit("trailing_data"))
               .otherwise(F.lit("bad_framing")))
    return (records.where(n > 0)
                   .select(F.when(good, F.expr("substring(value, 1, length(value) - 2)")).alias("message"),
                           status.alias("status"), "source_file", F.when(~good, v).alias("frame")))


def scan_mllp_capture(spark: SparkSession, path: str, strict: bool = False) -> DataFrame:
    """Framed capture files -> (message, status, source_file, frame).

    ``strict`` fails like a strict reader when any record is not a good
    frame, or a file holds an empty one beyond its head (one global count, a partial
    aggregate; only the first few bad file names come back to the driver)."""
    rec = (spark.read.option("lineSep", hl7.START_BLOCK).text(path)
                .withColumn("source_file", F.col("_metadata.file_path")))
    out = frames(spread_for_cpu(rec))
    if strict:
        # the one empty record before a file's first start byte is no frame; a second one is
        hollow = rec.where(F.length("value") == 0).groupBy("source_file").count().where("count > 1")
        bad = out.where(F.col("status") != "ok").select("source_file").unionByName(hollow.select("source_file"))
        n_bad = bad.agg(F.count(F.lit(1))).first()[0]
        if n_bad:
            where = [r.source_file for r in bad.select("source_file").distinct().limit(3).collect()]
            raise ValueError(f"{n_bad} badly framed records in {path} (e.g. in {where})")
    return out


def stream_mllp_landing(spark: SparkSession, path: str, options: dict | None = None) -> DataFrame:
    """Streaming read of a landing directory of capture files (same checks).
    ``options`` go to the file source (e.g. ``maxFilesPerTrigger``)."""
    reader = spark.readStream.option("lineSep", hl7.START_BLOCK)
    for k, v in (options or {}).items():
        reader = reader.option(k, v)
    rec = reader.format("text").load(path).withColumn("source_file", F.col("_metadata.file_path"))
    return frames(rec)
