"""Wide patient histories <-> long measurement tables."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ordered import DEFAULT_CHUNK_SECONDS, keyed_row_number

DATE_PREFIX = "creatinine_date_"
RESULT_PREFIX = "creatinine_result_"
PAD_WIDTH = 50  # fixed width the classifier's training matrix is padded to


def slot_numbers(columns: list[str]) -> list[int]:
    """Slot numbers present in a wide header (from the date columns)."""
    return sorted({int(m.group(1)) for c in columns
                   if (m := re.fullmatch(DATE_PREFIX + r"(\d+)", c))})


def unpivot_history(wide: DataFrame, first_slot: int = 0, keep_empty: bool = False,
                    extra: list[str] | None = None) -> DataFrame:
    """Wide (mrn, creatinine_date_i, creatinine_result_i, ...) -> long
    (mrn, slot, creatinine_date, creatinine_result) as text.

    A narrow ``inline`` over an array built per row: the slot count comes
    from the header (driver-side metadata only), rows never shuffle.
    ``first_slot=1`` reproduces the loader that skips slot 0.  Slots where
    either value is missing are dropped unless ``keep_empty`` (F2).
    """
    slots = [i for i in slot_numbers(wide.columns) if i >= first_slot]
    cols = set(wide.columns)
    entries = [F.struct(F.lit(i).alias("slot"),
                        F.col(f"{DATE_PREFIX}{i}").cast("string").alias("creatinine_date"),
                        (F.col(f"{RESULT_PREFIX}{i}").cast("string") if f"{RESULT_PREFIX}{i}" in cols
                         else F.lit(None).cast("string")).alias("creatinine_result"))
               for i in slots]
    keep = ["mrn"] + (extra or [])
    if not entries:
        return wide.select(*keep, F.lit(None).cast("int").alias("slot"),
                           F.lit(None).cast("string").alias("creatinine_date"),
                           F.lit(None).cast("string").alias("creatinine_result")).limit(0)
    long = wide.select(*keep, F.inline(F.array(*entries)))
    # blank CSV cells are read as NULL already; treat empty text the same
    long = (long.withColumn("creatinine_date", F.nullif(F.trim("creatinine_date"), F.lit("")))
                .withColumn("creatinine_result", F.nullif(F.trim("creatinine_result"), F.lit(""))))
    if not keep_empty:
        long = long.where(F.col("creatinine_date").isNotNull() & F.col("creatinine_result").isNotNull())
    return long


def slot_index(measurements: DataFrame, chunk_seconds: int | None = DEFAULT_CHUNK_SECONDS,
               chunk_rows: int | None = None) -> DataFrame:
    """0-based position by date within a patient (dates unique per
    patient, as the table key guarantees); a long history is numbered in
    time chunks on many tasks (``ordered.keyed_row_number``)."""
    return keyed_row_number(measurements, "mrn", "creatinine_date", "slot", chunk_seconds, chunk_rows)


def history_rows(measurements: DataFrame) -> DataFrame:
    """R2 with a fixed number of columns: (mrn, slots), one wide row a
    patient, slots its (creatinine_date, creatinine_result) in date order (the slot number is the
    place in the array).  A wide row holds its patient whole by definition; the plan
    does not grow with the longest history."""
    pair = F.struct("creatinine_date", "creatinine_result")
    return measurements.groupBy("mrn").agg(F.sort_array(F.collect_list(pair)).alias("slots"))


def unpivot_rows(rows: DataFrame, first_slot: int = 0, keep_empty: bool = False, extra: list[str] | None = None) -> DataFrame:
    """R1 on wide rows (mrn, slots, ...): (mrn, slot, creatinine_date,
    creatinine_result).  Slots where either value is missing are dropped unless
    ``keep_empty`` (F2)."""
    long = rows.select("mrn", *(extra or []), F.posexplode("slots").alias("slot", "_pair")).select(
        "mrn", *(extra or []), "slot", "_pair.creatinine_date", "_pair.creatinine_result").where(F.col("slot") >= first_slot)
    return long if keep_empty else long.where(F.col("creatinine_date").isNotNull() & F.col("creatinine_result").isNotNull())


def pivot_history(measurements: DataFrame, width: int, date_format: str | None = "yyyy-MM-dd HH:mm:ss",
                  patients: DataFrame | None = None) -> DataFrame:
    """R2: long -> wide ``creatinine_date_i, creatinine_result_i`` for i < width.

    Explicit pivot values (0..width-1) avoid the extra job that discovers
    them.  ``patients`` (mrn, age, sex), when given, is joined first so
    patients without measurements get a row.
    """
    s = slot_index(measurements)
    d = F.date_format("creatinine_date", date_format) if date_format else F.col("creatinine_date")
    # one struct per slot: a single pivot aggregate instead of one per field
    s = s.select("mrn", "slot", F.struct(d.alias("d"), F.col("creatinine_result").alias("r")).alias("v"))
    wide = s.groupBy("mrn").pivot("slot", list(range(width))).agg(F.first("v"))
    out = wide.select("mrn", *[c for i in range(width) for c in (
        F.col(f"`{i}`.d").alias(f"{DATE_PREFIX}{i}"), F.col(f"`{i}`.r").alias(f"{RESULT_PREFIX}{i}"))])
    if patients is not None:
        out = patients.join(out, "mrn", "left")
    return out


def pad_history(measurements: DataFrame, width: int = PAD_WIDTH) -> DataFrame:
    """R3 on the long form: (mrn, slot, creatinine_date, creatinine_result,
    padded), each patient with fewer than ``width`` readings filled up to it
    with slots of result 0 and no date; no reading is dropped and the columns
    do not depend on the longest history."""
    s = slot_index(measurements).select("mrn", F.col("slot").cast("int").alias("slot"), "creatinine_date",
                                        F.col("creatinine_result").cast("double").alias("creatinine_result"),
                                        F.lit(False).alias("padded"))
    short = measurements.groupBy("mrn").agg(F.count(F.lit(1)).cast("int").alias("n")).where(F.col("n") < width)
    added = short.select("mrn", F.explode(F.sequence("n", F.lit(width - 1))).alias("slot"),
                         F.lit(None).cast(s.schema["creatinine_date"].dataType).alias("creatinine_date"),
                         F.lit(0.0).alias("creatinine_result"), F.lit(True).alias("padded"))
    return s.unionByName(added)


def pad_wide(wide: DataFrame, width: int = PAD_WIDTH) -> DataFrame:
    """Add slots up to ``width`` filled with 0.

    Like the upstream, the first added slot is ``(number of columns - 2) // 2``
    (the frame is assumed to hold two non-slot columns); existing columns are
    never touched.
    """
    start = (len(wide.columns) - 2) // 2
    add = {}
    for i in range(start, width):
        add[f"{DATE_PREFIX}{i}"] = F.lit(0)
        add[f"{RESULT_PREFIX}{i}"] = F.lit(0)
    return wide.withColumns(add) if add else wide
