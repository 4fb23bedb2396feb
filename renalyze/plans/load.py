"""Bulk load: a wide history CSV as the Patients and Measurements tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import reshape as R
from ..operators import store
from ..sources import files


def history_tables(rows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Wide rows (``files.scan_wide_rows``) -> (patients with NULL age / sex,
    measurements, bad cells with their reason).  A cell that does not parse
    is set aside and the rest of its row is loaded; of one date's readings
    the last slot's stays."""
    good, bad = files.typed_cells(R.unpivot_rows(rows).where(F.col("mrn").isNotNull()))
    meas = store.dedupe_last(good.withColumn("arrival", F.col("slot").cast("bigint")), ["mrn", "creatinine_date"], ["creatinine_result"])
    pats = rows.where(F.col("mrn").isNotNull()).select("mrn").distinct().select(
        "mrn", F.lit(None).cast("int").alias("age"), F.lit(None).cast("string").alias("sex"))
    return pats, meas, bad
