"""Wide-history CSV edge cases: header-driven width, blank cells, loaders."""

import os
import tempfile

from pyspark.sql import functions as F

from renalyze.operators import reshape as R
from renalyze.operators import scoring
from renalyze.sources import files

CSV = (
    "mrn,creatinine_date_0,creatinine_result_0,creatinine_date_1,creatinine_result_1,creatinine_date_2\n"
    "189386394,2024-01-02 10:00:00,126.48, 2024-01-05 11:00:00 ,130.0,2024-01-09 09:00:00\n"
    "100005546,2024-01-24 15:41:00,96.22,,,\n"
    "555,,,2024-02-01 00:00:00,,\n"
)


def _write(tmp, text):
    path = os.path.join(tmp, "history.csv")
    with open(path, "w") as fh:
        fh.write(text)
    return path


def test_header_driven_width_and_blank_cells(spark):
    d = tempfile.mkdtemp(prefix="renalyze-csv-")
    wide = files.scan_wide_history(spark, _write(d, CSV))
    assert R.slot_numbers(wide.columns) == [0, 1, 2]
    assert all(t == "string" for _, t in wide.dtypes)        # no inference: all text
    long = {(r.mrn, r.slot): (r.creatinine_date, r.creatinine_result) for r in R.unpivot_history(wide).collect()}
    # complete pairs only; padded text is trimmed; slot 2 has no result column
    assert long == {("189386394", 0): ("2024-01-02 10:00:00", "126.48"),
                    ("189386394", 1): ("2024-01-05 11:00:00", "130.0"),
                    ("100005546", 0): ("2024-01-24 15:41:00", "96.22")}
    empty = R.unpivot_history(wide, keep_empty=True).where("mrn = '555'").count()
    assert empty == 3


def test_loader_that_skips_slot_zero(spark):
    d = tempfile.mkdtemp(prefix="renalyze-csv-")
    wide = files.scan_wide_history(spark, _write(d, CSV))
    got = sorted((r.mrn, r.slot) for r in R.unpivot_history(wide, first_slot=1).collect())
    assert got == [("189386394", 1)]


def test_label_encoding(spark):
    df = spark.createDataFrame([("y",), ("n",), ("maybe",), (None,)], "aki string")
    got = [r.a for r in df.select(scoring.encode_label(F.col("aki")).alias("a")).collect()]
    assert got == [1, 0, None, None]
    got0 = [r.a for r in df.select(scoring.encode_label(F.col("aki"), other_as_zero=True).alias("a")).collect()]
    assert got0 == [1, 0, 0, 0]
