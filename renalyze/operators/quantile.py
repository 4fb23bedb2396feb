"""Exact per-key median that splits a hot key across tasks.

``percentile`` keeps, for each key, one counter per distinct value and
merges them in one task; for a key holding a large share of the rows with
mostly distinct values, that task holds the whole key.  Here:

1. count per (key, value) -- a partial aggregate shuffled on both columns,
   so a hot key spreads over many tasks;
2. cut values into blocks (data-independent log-scale buckets, or global
   quantile bounds from ``approxQuantile`` -- a list whose length is a
   parameter) and compute, per (key, block), the
   number of rows below the block (small running sum per key over its
   blocks) and, per (key, block), a running count over the distinct values
   inside the block;
3. the middle ranks ``floor((n-1)/2)`` and ``ceil((n-1)/2)`` are found by
   range checks on those cumulative counts; a last per-key aggregate picks
   the two values and interpolates (as ``percentile(x, 0.5)`` does).

NULL values are skipped; keys without values get no row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def log_block(x, resolution: int = 1024):
    """Monotone, data-independent block id of a double: ``resolution``
    blocks per doubling of |x|, mirrored for negatives, one block for 0.
    Equal values share a block, larger values never get a smaller block, and
    no pass over the data is needed to choose bounds."""
    a = F.abs(x)
    mag = F.floor(F.log2(a) * resolution).cast("long") + F.lit(1075 * resolution + 1)
    return (F.when(x > 0, mag).when(x < 0, -mag).otherwise(F.lit(0))).cast("long")


def rank_ranges(df: DataFrame, key: str, value: str, blocks: int | None = None, resolution: int = 1024) -> DataFrame:
    """(key, _v, _n, _lt, _le): of every distinct value of a key, how many
    rows lie below it and how many at or below it, and the key's rows.
    ``blocks``: cut values at that many global quantiles (one extra pass
    over the data); default: data-independent ``log_block`` buckets."""
    v = df.select(key, F.col(value).cast("double").alias("_v")).where(F.col("_v").isNotNull())
    counts = v.groupBy(key, "_v").agg(F.count(F.lit(1)).alias("_c"))
    if blocks:
        probs = [i / blocks for i in range(1, blocks)]
        bounds = sorted(set(v.approxQuantile("_v", probs, 1.0 / (4 * blocks)))) if probs else []
        if bounds:
            arr = F.array(*[F.lit(float(b)) for b in bounds])
            blk = F.size(F.filter(arr, lambda b: b < F.col("_v")))
        else:
            blk = F.lit(0)
    else:
        blk = log_block(F.col("_v"), resolution)
    counts = counts.withColumn("_blk", blk.cast("long"))
    per_blk = counts.groupBy(key, "_blk").agg(F.sum("_c").alias("_bc"))
    before = Window.partitionBy(key).orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    offs = per_blk.select(key, "_blk", F.coalesce(F.sum("_bc").over(before), F.lit(0)).alias("_off"),
                          F.sum("_bc").over(Window.partitionBy(key)).alias("_n"))
    inside = Window.partitionBy(key, "_blk").orderBy("_v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (counts.withColumn("_in", F.sum("_c").over(inside))
                  .join(offs, [key, "_blk"])
                  .select(key, "_v", "_n", (F.col("_off") + F.col("_in")).alias("_le"),
                          (F.col("_off") + F.col("_in") - F.col("_c")).alias("_lt")))


def exact_median(df: DataFrame, key: str, value: str, out: str = "median",
                 blocks: int | None = None, resolution: int = 1024) -> DataFrame:
    """The median of every key, by ``rank_ranges``."""
    cum = rank_ranges(df, key, value, blocks, resolution)
    lo = F.floor((F.col("_n") - 1) / 2)
    hi = F.ceil((F.col("_n") - 1) / 2)
    hit_lo = (F.col("_lt") <= lo) & (lo < F.col("_le"))
    hit_hi = (F.col("_lt") <= hi) & (hi < F.col("_le"))
    picked = cum.where(hit_lo | hit_hi).groupBy(key).agg(
        F.max(F.when(hit_lo, F.col("_v"))).alias("_lo"), F.max(F.when(hit_hi, F.col("_v"))).alias("_hi"),
        F.first("_n").alias("_n"))
    frac = (F.col("_n") - 1) / 2 - F.floor((F.col("_n") - 1) / 2)
    return picked.select(key, (F.col("_lo") + (F.col("_hi") - F.col("_lo")) * frac).alias(out))
