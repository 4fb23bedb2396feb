"""The command-line jobs on files Spark derives from the sf0.001 tables."""

import os
import tempfile

from pyspark.sql import functions as F

from renalyze import bindings as B
from renalyze import cli
from renalyze.operators import reshape as R
from renalyze.operators import scoring, store
from renalyze.sources import files
from renalyze.streaming import sinks
from renalyze.streaming import tables as live

from .conftest import SF_SMALL


def _history_csv(spark, d):
    m = store.dedupe_last(B.measurement_rows(spark, SF_SMALL), ["mrn", "creatinine_date"], ["creatinine_result"])
    width = m.groupBy("mrn").count().agg(F.max("count")).first()[0]
    path = os.path.join(d, "history.csv")
    files.write_csv(R.pivot_history(m, width), path)
    return path, m


def test_load_and_split_history(spark):
    d = tempfile.mkdtemp(prefix="renalyze-cli-")
    hist, m = _history_csv(spark, d)
    tables = os.path.join(d, "tables")
    assert cli.load_history(spark, hist, tables) is True
    assert cli.load_history(spark, hist, tables) is False          # gate: tables not empty
    got = live.snapshot(spark, tables, "measurements")
    assert got.count() == m.count()
    p, mm = cli.split_history(spark, hist, os.path.join(d, "split"))
    assert files.scan_measurements_csv(spark, mm).count() == m.count()
    assert files.scan_patients_csv(spark, p).count() == m.select("mrn").distinct().count()


def test_train_evaluate_predict(spark):
    d = tempfile.mkdtemp(prefix="renalyze-cli-")
    hist, m = _history_csv(spark, d)
    wide = files.scan_wide_history(spark, hist)
    stats = m.groupBy("mrn").agg(F.max("creatinine_result").alias("mx"), F.min("creatinine_result").alias("mn"))
    lab = (wide.join(B.patients(spark, SF_SMALL), "mrn", "left").join(stats, "mrn")
               .withColumn("aki", scoring.label_text((F.col("mx") >= 1.5 * F.col("mn")).cast("int")))
               .drop("mx", "mn"))
    labelled = os.path.join(d, "labelled.csv")
    files.write_csv(lab, labelled)
    model = os.path.join(d, "model")
    cli.train(spark, labelled, model)
    metrics = cli.evaluate(spark, labelled, model, os.path.join(d, "metrics")).collect()
    assert len(metrics) == 1 and 0.0 <= metrics[0].accuracy <= 1.0
    out = cli.predict(spark, labelled, model, os.path.join(d, "pred"))
    assert spark.read.option("header", True).csv(out).count() == wide.count()
    # the live path pages from the saved model
    landing = os.path.join(d, "landing")
    files.write_capture(B.hl7_raw(spark, SF_SMALL), landing)
    for q in cli.serve(spark, landing, os.path.join(d, "tables"), os.path.join(d, "served"), True, model):
        q.awaitTermination()
        assert q.exception() is None
    assert spark.read.parquet(os.path.join(d, "served", "alerts")).columns[:3] == ["mrn", "alert_ts", "payload"]


def test_serve_available_now(spark):
    d = tempfile.mkdtemp(prefix="renalyze-cli-")
    landing = os.path.join(d, "landing")
    files.write_capture(B.hl7_raw(spark, SF_SMALL), landing)
    tables, out = os.path.join(d, "tables"), os.path.join(d, "out")
    for q in cli.serve(spark, landing, tables, out, available_now=True):
        q.awaitTermination()
    assert live.latest_version(spark, tables) == 1
    frames = B.hl7_raw(spark, SF_SMALL).count()
    assert spark.read.parquet(f"{out}/acks").count() + sinks.quarantined(spark, tables).count() == frames
    assert spark.read.parquet(f"{out}/acks").count() > 0
    assert spark.read.parquet(f"{out}/alerts").columns[:3] == ["mrn", "alert_ts", "payload"]


def test_main_split_history(spark, capsys):
    d = tempfile.mkdtemp(prefix="renalyze-cli-")
    hist, m = _history_csv(spark, d)
    cli.main(["split-history", "--history", hist, "--out", os.path.join(d, "split")])
    assert "measurements.csv" in capsys.readouterr().out
    assert files.scan_measurements_csv(spark, os.path.join(d, "split", "measurements.csv")).count() == m.count()
