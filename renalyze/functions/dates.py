"""Date text parsing (P21, P22) and time arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed layouts: the strict loader's and the lenient reader's.
STRICT_FORMAT = "yyyy-MM-dd HH:mm:ss"
COERCE_FORMATS = ["yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd", "MM/dd/yy HH:mm:ss"]


def parse_date_strict(text: Column) -> Column:
    """Only ``yyyy-MM-dd HH:mm:ss``; anything else NULL (the row is
    then skipped / quarantined by the caller)."""
    return F.try_to_timestamp(F.trim(text), F.lit(STRICT_FORMAT))


def parse_date_coerce(text: Column) -> Column:
    """First layout that parses, else NULL (row kept)."""
    t = F.trim(text)
    return F.coalesce(*[F.try_to_timestamp(t, F.lit(f)) for f in COERCE_FORMATS])


def epoch_seconds(ts: Column) -> Column:
    """Timestamp -> Unix seconds."""
    return F.unix_seconds(ts)
