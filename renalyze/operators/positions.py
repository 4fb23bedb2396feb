"""Distributed positions: the place of every row in the sorted order of its group."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import scratch_path

PARTITION_BITS = 33              # monotonically_increasing_id: partition number above these bits


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared checkpoint folder: cuts lineage, fixes generated ids."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def same(left: DataFrame, right: DataFrame, cols: dict[str, str]) -> Column:
    """Null-safe equality of columns of ``left`` with columns of ``right``."""
    return reduce(lambda a, b: a & b, [left[a].eqNullSafe(right[b]) for a, b in cols.items()])


def ranked(df: DataFrame, group: list[str], order: list[Column], name: str, place: str = "pos", total: str = "n") -> DataFrame:
    """``df`` (a written table) with ``place`` (from 0, in ``order`` within
    ``group``, nulls first) and ``total`` (rows of the group).

    One range shuffle sorts the rows by (group, order), so a group of any size
    is spread over many partitions; a row's place is its place in its partition
    plus the group's rows in earlier partitions (one row a partition and group).
    """
    sort = [F.col(c).asc() for c in group] + order
    at = (df.repartitionByRange(*sort).sortWithinPartitions(*sort)
            .withColumn("_at", F.monotonically_increasing_id()))
    at = written(at, name).withColumn("_part", F.shiftright("_at", PARTITION_BITS))
    runs = at.groupBy("_part", *group).agg(F.min("_at").alias("_first"), F.count("*").alias("_rows"))
    whole = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))
    runs = runs.select(
        F.col("_part").alias("_p"), *[F.col(c).alias(f"_g{k}") for k, c in enumerate(group)],
        (F.coalesce(F.sum("_rows").over(whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
         - F.col("_first")).alias("_shift"),
        F.sum("_rows").over(whole).alias("_total"))
    on = same(at, runs, {"_part": "_p", **{c: f"_g{k}" for k, c in enumerate(group)}})
    return at.join(runs, on).select(*df.columns, (F.col("_at") + F.col("_shift")).alias(place), F.col("_total").alias(total))
