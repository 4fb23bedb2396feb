"""The bulk load and the padding over every reading, whatever its event type."""

import datetime as dt

import duckdb
import pytest

import __spark_entry__ as E
from renalyze.operators import reshape as R

DAY = dt.datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    """Patient 1 has purchase readings alone, patient 2 has 60 readings of all types, patient 3 has none."""
    d = tmp_path_factory.mktemp("readings")
    rows = [(k, DAY + dt.timedelta(hours=k), 1, "purchase", float(k)) for k in range(5)]
    rows += [(100 + k, DAY + dt.timedelta(hours=k), 2, ("click", "view", "purchase")[k % 3], k / 2) for k in range(60)]
    rows += [(300, DAY, 3, "signup", 1.0)]
    spark.createDataFrame(rows, "event_id bigint, ts timestamp, user_id bigint, event_type string, value double") \
         .write.parquet(f"{d}/events.parquet")
    return str(d)


@pytest.mark.parametrize("name", ["bulk_load_history_all", "bulk_load_patients_all", "pad_to_50_all"])
def test_every_reading(spark, sf, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{sf}/events.parquet/*.parquet'")
    con.execute("SET TimeZone = 'UTC'")
    plain = lambda r: tuple(v.replace(tzinfo=None) if isinstance(v, dt.datetime) else v for v in r)
    want = sorted(map(plain, con.sql(E.oracle_sql()[name]).fetchall()), key=str)
    got = sorted((plain(r) for r in E.queries()[name](spark, sf).collect()), key=str)
    assert got == want
    assert len(got) == (65 if name == "bulk_load_history_all" else 2)


def test_padding_fills_short_patients_only(spark):
    m = spark.createDataFrame([("a", DAY, 0.0), ("a", DAY + dt.timedelta(days=9), 2.0)]
                              + [("b", DAY + dt.timedelta(days=k), 1.0) for k in range(4)],
                              "mrn string, creatinine_date timestamp, creatinine_result double")
    got = sorted((r.mrn, r.slot, r.creatinine_result, r.padded) for r in R.pad_history(m, 3).collect())
    assert got == [("a", 0, 0.0, False), ("a", 1, 2.0, False), ("a", 2, 0.0, True)] + [("b", k, 1.0, False) for k in range(4)]
