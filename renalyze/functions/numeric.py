"""Numeric helpers with the division rules of a pandas frame."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(num: Column, den: Column) -> Column:
    """num / den with pandas' float rules under ANSI mode.

    x/0 is +inf or -inf by the sign of x; 0/0 is NULL (pandas' NaN); NULL in,
    NULL out.  ANSI Spark would raise on a zero divisor, so it is cased out.
    """
    return (F.when(num.isNull() | den.isNull(), F.lit(None).cast("double"))
             .when(den == 0, F.when(num > 0, F.lit(float("inf")))
                              .when(num < 0, F.lit(float("-inf")))
                              .otherwise(F.lit(None).cast("double")))
             .otherwise(num.cast("double") / den.cast("double")))


def round9(c: Column) -> Column:
    """Rounding used for comparisons of double results (see README)."""
    return F.round(c, 9)
