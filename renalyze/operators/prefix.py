"""Exact running sums over a whole table without one global window.

A window with no partition key sorts every row in one task.  Here the order
column is cut into blocks that need no look at the data: log-scale buckets of
a number (``quantile.log_block``), the first characters of a text.  A larger
value never has a smaller block and equal values share one, so ties stay
together.  Each block's totals are a partial aggregate, the running sum over
them is a window over one row a block, and the running sum inside a block is a
window partitioned by block.  Nothing runs before the action, and the plan's
size does not depend on the number of blocks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .quantile import log_block

RESOLUTION = 1024                # blocks of numbers per doubling
TEXT_PREFIX = 3                  # characters that name a block of texts


def order_block(df: DataFrame, order_col: str, resolution: int = RESOLUTION, prefix: int = TEXT_PREFIX) -> Column:
    """The block of each value of ``order_col``: grows with the value, NaN last."""
    x = F.col(order_col)
    if isinstance(df.schema[order_col].dataType, T.StringType):
        return F.substring(x, 1, prefix)
    x = x.cast("double")
    far = 1 << 60
    return F.when(F.isnan(x), far + 1).when(x == float("inf"), far).when(x == -float("inf"), -far).otherwise(log_block(x, resolution))


def running_sums(df: DataFrame, order_col: str, value_cols: list[str], descending: bool = False,
                 resolution: int = RESOLUTION, prefix: int = TEXT_PREFIX) -> DataFrame:
    """Add ``cum_<v>`` = sum of ``v`` over rows at or before each row in
    ``order_col`` order (rows must have distinct, non-NULL order values, e.g. after a
    group-by on it)."""
    tagged = df.withColumn("_blk", order_block(df, order_col, resolution, prefix))

    def in_order(c: str) -> Column:
        return F.col(c).desc() if descending else F.col(c).asc()

    totals = tagged.groupBy("_blk").agg(*[F.sum(v).alias(f"_t_{v}") for v in value_cols])
    before = Window.orderBy(in_order("_blk")).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("_blk", *[F.coalesce(F.sum(f"_t_{v}").over(before), F.lit(0)).alias(f"_o_{v}") for v in value_cols])
    inside = Window.partitionBy("_blk").orderBy(in_order(order_col)).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inner = tagged.select("*", *[F.sum(v).over(inside).alias(f"_i_{v}") for v in value_cols])
    out = inner.join(offsets, "_blk")
    return out.select(*df.columns, *[(F.col(f"_i_{v}") + F.col(f"_o_{v}")).alias(f"cum_{v}") for v in value_cols])
