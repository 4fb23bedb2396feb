"""Command-line jobs: the upstream's entry points as Spark jobs.

    python -m renalyze.cli serve --landing DIR --tables DIR --out DIR [--available-now] [--model DIR]
    python -m renalyze.cli replay-quarantine --tables DIR --out DIR
    python -m renalyze.cli load-history --history CSV --tables DIR
    python -m renalyze.cli split-history --history CSV --out DIR
    python -m renalyze.cli train --labelled CSV --model DIR
    python -m renalyze.cli evaluate --labelled CSV --model DIR --metrics DIR
    python -m renalyze.cli predict --labelled CSV --model DIR --out DIR

Every path may be on shared storage (HDFS, object store); checkpoints go to
``spark.checkpoint.dir`` (set by the cluster) or ``--checkpoint``.
"""

from __future__ import annotations

import argparse
import os
import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import evaluation as ev
from .operators import features as feat
from .operators import reshape as R
from .operators import scoring
from .plans.load import history_tables
from .schemas import MEASUREMENTS, PATIENTS
from .session import checkpoint_root, get_session
from .sources import files
from .streaming import ingest, sinks, state
from .streaming import tables as live


# ---------------------------------------------------------------- jobs

def load_history(spark: SparkSession, history_csv: str, tables: str) -> bool:
    """Bulk load behind the gate: only while both tables are empty.  Cells that
    do not parse go to ``bad_cells`` beside the tables.  Returns whether the load ran."""
    if live.committed(spark, tables) is not None:
        return False
    pats, meas, bad = history_tables(files.scan_wide_rows(spark, history_csv))
    bad.write.mode("overwrite").parquet(f"{tables}/bad_cells")
    live.create(spark, tables, pats, meas)
    return True


def split_history(spark: SparkSession, history_csv: str, out: str) -> tuple[str, str]:
    """Wide history CSV -> patients.csv + measurements.csv."""
    pats, meas, _ = history_tables(files.scan_wide_rows(spark, history_csv))
    return files.sink_split_csv(pats, meas, out)


def labelled_features(spark: SparkSession, labelled_csv: str) -> DataFrame:
    """Labelled wide CSV (mrn, age, sex, aki, slots) -> serving features +
    label: the 11 inputs the model serves on."""
    wide = files.scan_wide_rows(spark, labelled_csv)
    meas = files.typed_cells(R.unpivot_rows(wide))[0].select("mrn", "creatinine_date", "creatinine_result")
    pats = wide.select("mrn", F.col("age").try_cast("int").alias("age"), "sex")
    labels = wide.select("mrn", scoring.encode_label(F.col("aki")).alias("label"))
    return feat.features_serving(pats, meas).join(labels, "mrn")


def train(spark: SparkSession, labelled_csv: str, model_dir: str):
    model = scoring.train_classifier(labelled_features(spark, labelled_csv), label="label")
    model.write().overwrite().save(model_dir)
    return model


def _load(model_dir: str):
    from pyspark.ml import PipelineModel
    return PipelineModel.load(model_dir)


def evaluate(spark: SparkSession, labelled_csv: str, model_dir: str, metrics: str) -> DataFrame:
    """Accuracy and F3 of a saved model, appended to the metrics table."""
    pred = scoring.predict(_load(model_dir), labelled_features(spark, labelled_csv))
    row = ev.metrics(pred.select("label", "prediction"), 3.0).withColumnRenamed("fbeta", "f3") \
            .withColumn("evaluated_at", F.current_timestamp())
    row.write.mode("append").parquet(metrics)
    return spark.read.parquet(metrics)


def predict(spark: SparkSession, labelled_csv: str, model_dir: str, out: str) -> str:
    """Predictions as an ``aki`` y/n CSV keyed by mrn."""
    pred = scoring.predict(_load(model_dir), labelled_features(spark, labelled_csv))
    files.write_csv(pred.select("mrn", scoring.label_text(F.col("prediction")).alias("aki")), out, mode="overwrite")
    return out


def serve(spark: SparkSession, landing: str, tables: str, out: str, available_now: bool = False,
          model_dir: str | None = None):
    """The live path as two streaming queries over the landing folder:
    tables + ACKs + quarantine (foreachBatch upserts, one version per batch)
    and alerts (per-patient state, outbox), scored by the rule or, with
    ``model_dir``, by a trained model compiled to a column."""
    scorer = None
    if model_dir:
        model = _load(model_dir)
        scorer = lambda df: scoring.compiled_predict(model, df)
    for k, v in state.STATE_CONF.items():
        spark.conf.set(k, v)
    # a restart with the same folders goes on; other folders are another service
    ck = os.path.join(checkpoint_root(spark), f"serve-{zlib.crc32(f'{landing}|{tables}|{out}'.encode()):08x}")
    if live.committed(spark, tables) is None:
        live.create(spark, tables, spark.createDataFrame([], PATIENTS), spark.createDataFrame([], MEASUREMENTS))
    pats0, meas0 = live.snapshot(spark, tables, "patients"), live.snapshot(spark, tables, "measurements")
    parsed = ingest.parsed_stream(spark, landing, keep_bad=True)
    trigger = {"availableNow": True} if available_now else {"processingTime": "5 seconds"}
    q1 = (parsed.writeStream.option("checkpointLocation", os.path.join(ck, "tables"))
                .trigger(**trigger)
                .foreachBatch(sinks.table_upsert_writer(tables, pats0, meas0, acks=f"{out}/acks"))
                .start())
    feats = state.history_stream(ingest.parsed_stream(spark, landing), pats0, meas0, defer=True)
    q2 = (feats.writeStream.option("checkpointLocation", os.path.join(ck, "alerts"))
               .trigger(**trigger).foreachBatch(sinks.alert_writer(f"{out}/alerts", scorer=scorer)).start())
    return q1, q2


# ---------------------------------------------------------------- CLI

def main(argv=None) -> None:
    ap = argparse.ArgumentParser(prog="renalyze")
    sub = ap.add_subparsers(dest="cmd", required=True)
    s = sub.add_parser("serve")
    s.add_argument("--landing", required=True)
    s.add_argument("--tables", required=True)
    s.add_argument("--out", required=True)
    s.add_argument("--available-now", action="store_true")
    s.add_argument("--model", default=None, help="page from this trained model instead of the rule")
    s = sub.add_parser("replay-quarantine")
    s.add_argument("--tables", required=True)
    s.add_argument("--out", required=True)
    s = sub.add_parser("load-history")
    s.add_argument("--history", required=True)
    s.add_argument("--tables", required=True)
    s = sub.add_parser("split-history")
    s.add_argument("--history", required=True)
    s.add_argument("--out", required=True)
    for name in ("train", "evaluate", "predict"):
        s = sub.add_parser(name)
        s.add_argument("--labelled", required=True)
        s.add_argument("--model", required=True)
        if name == "evaluate":
            s.add_argument("--metrics", required=True)
        if name == "predict":
            s.add_argument("--out", required=True)
    ap.add_argument("--checkpoint", default=None, help="used only when spark.checkpoint.dir is unset")
    a = ap.parse_args(argv)
    spark = get_session(app=f"renalyze-{a.cmd}")
    if a.checkpoint and not spark.conf.get("spark.checkpoint.dir", None):
        spark.stop()                                   # a static setting: needs a session built with it
        spark = get_session(app=f"renalyze-{a.cmd}", extra={"spark.checkpoint.dir": a.checkpoint})
    if a.cmd == "serve":
        for q in serve(spark, a.landing, a.tables, a.out, a.available_now, a.model):
            q.awaitTermination()
    elif a.cmd == "replay-quarantine":
        print("released" if sinks.replay_quarantine(spark, a.tables, f"{a.out}/acks") else "nothing to release")
    elif a.cmd == "load-history":
        print("loaded" if load_history(spark, a.history, a.tables) else "tables not empty: nothing loaded")
    elif a.cmd == "split-history":
        print(split_history(spark, a.history, a.out))
    elif a.cmd == "train":
        train(spark, a.labelled, a.model)
    elif a.cmd == "evaluate":
        evaluate(spark, a.labelled, a.model, a.metrics).show(truncate=False)
    elif a.cmd == "predict":
        print(predict(spark, a.labelled, a.model, a.out))


if __name__ == "__main__":
    main()
