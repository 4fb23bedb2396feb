"""Per-key ordered operations that split a hot key across tasks.

``row_number`` / ``lag`` over ``partitionBy(key)`` sort a key's rows in one
task.  Here rows are first cut into time chunks (``key``, ``floor(t / w)``):
the ordered pass runs per chunk, and one summary row per chunk (row count,
last value) goes through a second, small ordered pass per key that supplies
each chunk's offset / predecessor.  Results are exact for any chunk width;
the width only sets how finely a hot key is split.  The order column must
be unique within a key (a table key, an arrival number).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

DEFAULT_CHUNK_SECONDS = 7 * 24 * 3600


def _order_number(df: DataFrame, order: str, micros: bool = False):
    o = F.col(order)
    if isinstance(df.schema[order].dataType, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return F.unix_micros(o.cast("timestamp")) if micros else F.unix_seconds(o.cast("timestamp"))
    return o


def hot_key_widths(df: DataFrame, key: str, order: str, chunk_rows: int) -> dict:
    """Chunk widths (in microseconds / order units) for keys with more than
    ``chunk_rows`` rows, sized for about ``chunk_rows`` rows per chunk if
    the key's rows were spread evenly over its range.  One partial
    aggregate per key; only the hot keys come back to the driver, and there
    are at most total_rows / chunk_rows of them."""
    o = _order_number(df, order, micros=True)
    stats = (df.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.min(o).alias("lo"), F.max(o).alias("hi"))
               .where(F.col("n") > chunk_rows))
    return {r[key]: max(1, int((r["hi"] - r["lo"] + 1) * chunk_rows // r["n"])) for r in stats.collect()}


def _chunk(df: DataFrame, order: str, width: int, key: str | None = None,
           chunk_rows: int | None = None) -> DataFrame:
    """Chunk id: ``width`` seconds of a timestamp order, or ``width`` units
    of a numeric one (e.g. an arrival number).  With ``chunk_rows``, keys
    with more rows than that get their own, finer width (microseconds for
    timestamps), so a patient whose readings come in a burst is still split
    into chunks of about ``chunk_rows`` rows; such chunk ids are negative so
    they never mix with the ordinary ones (only order within a key
    matters)."""
    base = F.floor(_order_number(df, order) / width)
    hot = hot_key_widths(df, key, order, chunk_rows) if (key and chunk_rows) else {}
    if not hot:
        return df.withColumn("_chunk", base)
    widths = F.create_map(*[x for k, w in hot.items() for x in (F.lit(k), F.lit(w))])
    w = F.element_at(widths, F.col(key))
    fine = -F.lit(1 << 62) + F.floor(_order_number(df, order, micros=True) / w)
    return df.withColumn("_chunk", F.when(w.isNotNull(), fine).otherwise(base))


def keyed_row_number(df: DataFrame, key: str, order: str, out: str = "slot",
                     chunk_seconds: int | None = DEFAULT_CHUNK_SECONDS,
                     chunk_rows: int | None = None) -> DataFrame:
    """0-based position of each row within its key in ``order`` order."""
    if not chunk_seconds:
        return df.withColumn(out, (F.row_number().over(Window.partitionBy(key).orderBy(order)) - 1).cast("int"))
    c = _chunk(df, order, chunk_seconds, key, chunk_rows)
    c = c.withColumn("_rn", F.row_number().over(Window.partitionBy(key, "_chunk").orderBy(order)))
    per = c.groupBy(key, "_chunk").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(key).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    offs = per.select(key, "_chunk", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    return (c.join(offs, [key, "_chunk"])
             .withColumn(out, (F.col("_off") + F.col("_rn") - 1).cast("int"))
             .drop("_chunk", "_rn", "_off"))


def keyed_last(df: DataFrame, key: str, order: list[str], value: Column, out: str,
               chunk_seconds: int = DEFAULT_CHUNK_SECONDS) -> DataFrame:
    """The last non-NULL ``value`` up to each row of its key, in ``order``
    (whose first column is a time, which cuts the chunks)."""
    c = df.withColumns({"_v": value, "_chunk": F.coalesce(F.floor(F.unix_seconds(order[0]) / chunk_seconds), F.lit(-1 << 62))})
    inside = Window.partitionBy(key, "_chunk").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    per = c.groupBy(key, "_chunk").agg(F.max_by("_v", F.when(F.col("_v").isNotNull(), F.struct(*order))).alias("_last"))
    before = Window.partitionBy(key).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    border = per.select(key, "_chunk", F.last("_last", ignorenulls=True).over(before).alias("_border"))
    return (c.withColumn("_in", F.last("_v", ignorenulls=True).over(inside)).join(border, [key, "_chunk"], "left")
             .withColumn(out, F.coalesce("_in", "_border")).drop("_v", "_chunk", "_in", "_border"))


def keyed_lag(df: DataFrame, key: str, order: str, value: str, out: str = "prev",
              chunk_seconds: int | None = DEFAULT_CHUNK_SECONDS, chunk_rows: int | None = None) -> DataFrame:
    """Value of the previous row of the same key in ``order`` order (NULL for
    the first row, and NULL when the previous value is NULL)."""
    if not chunk_seconds:
        return df.withColumn(out, F.lag(value).over(Window.partitionBy(key).orderBy(order)))
    c = _chunk(df, order, chunk_seconds, key, chunk_rows)
    w = Window.partitionBy(key, "_chunk").orderBy(order)
    c = c.withColumn("_rn", F.row_number().over(w)).withColumn("_lag", F.lag(value).over(w))
    # max_by keeps a NULL value of the last row (a NULL predecessor stays NULL)
    last = c.groupBy(key, "_chunk").agg(F.max_by(F.col(value), F.col(order)).alias("_last"))
    prev_chunk = Window.partitionBy(key).orderBy("_chunk")
    border = last.select(key, "_chunk", F.lag(F.col("_last")).over(prev_chunk).alias("_border"))
    return (c.join(border, [key, "_chunk"])
             .withColumn(out, F.when(F.col("_rn") == 1, F.col("_border")).otherwise(F.col("_lag")))
             .drop("_chunk", "_rn", "_lag", "_border"))
