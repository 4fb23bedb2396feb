"""Keyed table maintenance: upserts, strict append, slot append, gates.

Spark does not enforce keys on Parquet, so the operators do.  Every upsert
is ``groupBy(key).agg(max_by(row, order))``: the aggregate is partial, so
map-side combine collapses repeated (even very hot) keys before the one
shuffle on the key, and no group is ever materialised in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schemas import SEX_VALUES
from ..session import scratch_path


_SIDE = 1 << 62  # updates rank above every current row when arrival < 2**62


def _integral(df: DataFrame, col: str | None) -> bool:
    return col is None or isinstance(df.schema[col].dataType, (T.LongType, T.IntegerType, T.ShortType))


def upsert(current: DataFrame, updates: DataFrame, keys: list[str], values: list[str],
           order: str | None = "arrival", current_order: str | None = None) -> DataFrame:
    """Insert-or-overwrite by ``keys``; the last arrival wins, whole row.

    ``updates`` rows are newer than every ``current`` row; within a side
    ``order`` (arrival) breaks ties.  New NULLs overwrite old values, as an
    ``ON DUPLICATE KEY UPDATE`` does.

    With an integral arrival (>= 0, < 2**62) the rank is one BIGINT
    ``side * 2**62 + arrival`` and each value is a ``max_by`` on it: all
    buffers are fixed-width, so Spark runs a hash aggregate with map-side
    combine.  Any other orderable arrival (timestamp, struct of message time
    and control id) ranks by ``struct(side, arrival)``.
    """
    cur_cols = [*keys, *values, *([current_order] if current_order else [])]
    upd_cols = [*keys, *values, *([order] if order else [])]
    if _integral(updates, order) and _integral(current, current_order):
        c_rank = F.coalesce(F.col(current_order).cast("bigint"), F.lit(0)) if current_order else F.lit(0).cast("bigint")
        u_rank = F.lit(_SIDE) + (F.col(order).cast("bigint") if order else F.lit(0).cast("bigint"))
        both = (current.select(*cur_cols).select(*keys, *values, c_rank.alias("_rank"))
                .unionByName(updates.select(*upd_cols).select(*keys, *values, u_rank.alias("_rank"))))
        out = both.groupBy(*keys).agg(*[F.max_by(F.col(v), F.col("_rank")).alias(v) for v in values])
        return out.select(*keys, *values)
    order_type = updates.schema[order].dataType.simpleString()
    c_a = F.col(current_order).cast(order_type) if current_order else F.lit(None).cast(order_type)
    rank_c = F.struct(F.lit(0).alias("b"), c_a.alias("a"))
    rank_u = F.struct(F.lit(1).alias("b"), F.col(order).cast(order_type).alias("a"))
    both = (current.select(*cur_cols).select(*keys, *values, rank_c.alias("_rank"))
            .unionByName(updates.select(*upd_cols).select(*keys, *values, rank_u.alias("_rank"))))
    row = F.struct(*[F.col(v) for v in values])
    out = both.groupBy(*keys).agg(F.max_by(row, F.col("_rank")).alias("_row"))
    return out.select(*keys, *[F.col("_row")[v].alias(v) for v in values])


def upsert_patients(current: DataFrame, updates: DataFrame, order: str = "arrival") -> DataFrame:
    """Patients(mrn, age, sex): new values (NULLs too) replace old ones."""
    return upsert(current, updates, ["mrn"], ["age", "sex"], order)


def upsert_measurements(current: DataFrame, updates: DataFrame, order: str = "arrival",
                        current_order: str | None = None) -> DataFrame:
    """Measurements keyed (mrn, creatinine_date); last arrival's result wins."""
    return upsert(current, updates, ["mrn", "creatinine_date"], ["creatinine_result"], order,
                  current_order)


def dedupe_last(rows: DataFrame, keys: list[str], values: list[str], order: str = "arrival") -> DataFrame:
    """A keyed table from rows with repeated keys: last arrival wins."""
    empty = rows.select(*keys, *values).limit(0)
    return upsert(empty, rows, keys, values, order)


def append_strict(current: DataFrame, new: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Plain INSERT: rows whose key is new and unique are inserted; rows whose
    key exists already or repeats inside ``new`` are conflicts."""
    counts = new.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    unique_keys = counts.where("_n = 1").select(*keys)
    fresh = new.join(unique_keys, keys, "left_semi").join(current.select(*keys), keys, "left_anti")
    conflicts = new.join(fresh.select(*keys), keys, "left_anti")
    return current.unionByName(fresh.select(*current.columns)), conflicts


def append_slot(wide_long: DataFrame, new: DataFrame, order: str = "arrival",
                chunk_width: int | None = 1 << 16) -> DataFrame:
    """Put each new measurement in the first free slot of its patient.

    ``wide_long`` is the long form of a wide history:
    (mrn, slot, creatinine_date, creatinine_result); a slot is free when its
    date is NULL.  New rows (mrn, creatinine_date, creatinine_result, arrival)
    take the free slots in ascending order, then slots after the highest one.
    Unknown patients start at slot 0.  No key: repeats are kept.  Ranking
    free slots and new rows per patient runs in chunks of ``chunk_width``
    slot / arrival numbers (``ordered.keyed_row_number``), so a patient with
    very many new rows is not ranked in one task.
    """
    from .ordered import keyed_row_number

    free = keyed_row_number(wide_long.where(F.col("creatinine_date").isNull()).select("mrn", "slot"),
                            "mrn", "slot", "k", chunk_width)
    free = free.withColumn("k", F.col("k") + 1)
    stats = wide_long.groupBy("mrn").agg(
        F.max("slot").alias("max_slot"),
        F.count_if(F.col("creatinine_date").isNull()).alias("n_free"))
    ranked = keyed_row_number(new, "mrn", order, "k", chunk_width).withColumn("k", F.col("k") + 1)
    placed = (ranked
                 .join(stats, "mrn", "left")
                 .join(free, ["mrn", "k"], "left")
                 .withColumn("slot", F.coalesce(
                     F.col("slot"),
                     F.coalesce(F.col("max_slot"), F.lit(-1)) + F.col("k") - F.coalesce(F.col("n_free"), F.lit(0))))
                 .select("mrn", F.col("slot").cast("int").alias("slot"), "creatinine_date", "creatinine_result"))
    # the k-th free slot stays empty exactly when the patient has fewer than k new rows
    n_new = new.groupBy("mrn").agg(F.count(F.lit(1)).alias("_n_new"))
    still_free = (free.join(n_new, "mrn", "left")
                      .where(F.col("k") > F.coalesce(F.col("_n_new"), F.lit(0)))
                      .select("mrn", F.col("slot").cast("int").alias("slot"),
                              F.lit(None).cast("timestamp").alias("creatinine_date"),
                              F.lit(None).cast("double").alias("creatinine_result")))
    filled = wide_long.where(F.col("creatinine_date").isNotNull()).select(
        "mrn", F.col("slot").cast("int").alias("slot"), "creatinine_date", "creatinine_result")
    return filled.unionByName(still_free).unionByName(placed)


def cascade_delete(patients: DataFrame, measurements: DataFrame, doomed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Delete patients by mrn; their measurements go too."""
    keys = doomed.select("mrn").distinct()
    return (patients.join(keys, "mrn", "left_anti"),
            measurements.join(keys, "mrn", "left_anti"))


def fk_split(measurements: DataFrame, patients: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Measurements whose patient exists / does not exist."""
    keys = patients.select("mrn")
    return (measurements.join(keys, "mrn", "left_semi"),
            measurements.join(keys, "mrn", "left_anti"))


def sex_check(patients: DataFrame) -> DataFrame:
    """flag rows whose sex is outside the allowed set."""
    return patients.withColumn("sex_ok", F.col("sex").isNull() | F.col("sex").isin(SEX_VALUES))


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """COUNT(*) per table as one union of global aggregates."""
    parts = [df.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(name).alias("table_name"), "n_rows")
             for name, df in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def is_populated(tables: dict[str, DataFrame]) -> DataFrame:
    """True if any table has a row (each probe reads at most one row)."""
    probes = [df.select(F.lit(1).alias("x")).limit(1) for df in tables.values()]
    u = probes[0]
    for p in probes[1:]:
        u = u.unionByName(p)
    return u.agg((F.count(F.lit(1)) > 0).alias("populated"))


def load_gate(rows: DataFrame, targets: dict[str, DataFrame]) -> DataFrame:
    """Keep ``rows`` only if every target table is empty.

    The flag is a scalar subquery (each probe reads at most one row), so the
    rows are filtered in place: no join, no shuffle of ``rows``."""
    flag = is_populated(targets)
    return rows.where(~flag.scalar())


def write_snapshot(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """Write a new immutable version of a table under the checkpoint root and
    read it back; the caller switches to the returned frame.  Never writes
    over a path that is being read."""
    path = scratch_path(spark, name)
    df.write.mode("errorifexists").parquet(path)
    return spark.read.parquet(path)
