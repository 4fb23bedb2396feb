"""Catalog part 6: classifier (M1-M4; rows-only, a trained model has no SQL
oracle) and the arrival-order features (W4) computed by the state processor."""

from __future__ import annotations

from . import training
from .catalog import query
from .catalog_stream import _W4
from . import sql as S


@query("train_classifier")
def q_train(spark, sf):
    """M1: gradient-boosted trees with the upstream settings; one row per
    input with its importance."""
    return training.feature_importances(spark, sf)


@query("predict")
def q_predict(spark, sf):
    """M2: class per patient."""
    return training.predictions(spark, sf).select("mrn", "prediction")


@query("predict_proba")
def q_predict_proba(spark, sf):
    """M3: probability of class 1 per patient."""
    return training.predictions(spark, sf).select("mrn", "probability_1")


@query("predict_agreement", f"""
WITH {S.PATIENTS} SELECT count(*) AS n_patients, CAST(0 AS BIGINT) AS mismatches FROM patients_b""")
def q_predict_agreement(spark, sf):
    """M2 / M3: the fitted model against its trees compiled to SQL, over every patient."""
    return training.agreement(spark, sf)


@query("evaluate")
def q_evaluate(spark, sf):
    """M4: accuracy and F3 of the model on the labelled rows."""
    return training.evaluate(spark, sf)


@query("arrival_features", f"""
WITH {_W4}
SELECT mrn, control_id, creatinine_date, status, age, sex, n_readings, {S.r9()} FROM w4
UNION ALL
SELECT mrn, control_id, d, 'unknown_patient', NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL
FROM fres WHERE msg_id NOT IN (SELECT msg_id FROM acc)""")
def q_arrival_features(spark, sf):
    """Features as of each message over what has arrived by then (latest
    value per date), as a batch replay per patient in arrival order (the
    state processor's logic over a sorted table); no pairwise self-join."""
    from pyspark.sql import functions as F

    from .. import bindings as B
    from ..functions.numeric import round9
    from ..schemas import FEATURE_COLUMNS
    from ..sources import files
    from ..streaming import ingest, state
    raw = B.hl7_raw(spark, sf)
    # records as the capture scan yields them: the text after a start byte
    frames = files.frames(raw.select(F.concat("raw", F.lit("\x1c\r")).alias("value"),
                                     F.lit("hl7_raw").alias("source_file")))
    got = state.history_batch(ingest.parse_frames(frames), B.patients(spark, sf)).drop("msg_time", "repeat")
    return got.withColumns({c: round9(F.col(c)) for c in FEATURE_COLUMNS})
