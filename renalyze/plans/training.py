"""Train / evaluate plan (M1-M4, metrics_table).

Labelled rows are the serving features of every known patient with the
rule label; the model sees the same 11 serving inputs at training and at
serving time (the upstream trained and served on different matrices).  One
patient in HELD_OUT, by a hash of the mrn, is kept out of the training rows and
is what M4 scores.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import bindings as B
from ..operators import evaluation as ev
from ..operators import features as feat
from ..operators import scoring, store
from ..session import scratch_path

HELD_OUT = 4
_MODELS: dict = {}


def labelled_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    meas = store.dedupe_last(B.measurement_rows(spark, sf_dir), ["mrn", "creatinine_date"], ["creatinine_result"])
    f = feat.features_serving(B.patients(spark, sf_dir), meas)
    return scoring.rule_score(f).withColumnRenamed("prediction", "label")


def held_out() -> Column:
    return F.pmod(F.xxhash64("mrn"), F.lit(HELD_OUT)) == 0


def trained_model(spark: SparkSession, sf_dir: str):
    """Fit once per application and input; saved under the checkpoint root."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _MODELS:
        model = scoring.train_classifier(labelled_features(spark, sf_dir).where(~held_out()), label="label")
        model.write().save(scratch_path(spark, "aki_model"))
        _MODELS[key] = model
    return _MODELS[key]


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    data = labelled_features(spark, sf_dir)
    return scoring.predict(trained_model(spark, sf_dir), data)


def agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M2 / M3 by two ways: the ML transformer and the trees compiled to a
    column, row by row."""
    model, data = trained_model(spark, sf_dir), labelled_features(spark, sf_dir)
    a = scoring.predict(model, data).select("mrn", F.col("prediction").alias("a"), F.col("probability_1").alias("pa"))
    b = scoring.compiled_predict(model, data).select("mrn", F.col("prediction").alias("b"), F.col("probability_1").alias("pb"))
    differ = (F.col("a") != F.col("b")) | (F.abs(F.col("pa") - F.col("pb")) > 1e-9)
    return a.join(b, "mrn").agg(F.count(F.lit(1)).alias("n_patients"), F.count_if(differ).alias("mismatches"))


def evaluate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M4: accuracy and F3 of the trained model on the patients it has not seen."""
    return ev.metrics(predictions(spark, sf_dir).where(held_out()).select("label", "prediction"), 3.0) \
             .withColumnRenamed("fbeta", "f3")


def feature_importances(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = trained_model(spark, sf_dir)
    gbt = model.stages[-1]
    imp = gbt.featureImportances.toArray().tolist()
    return spark.createDataFrame(list(zip(scoring.SERVING_INPUTS, [float(x) for x in imp])),
                                 "feature string, importance double") \
                .withColumn("trees", F.lit(gbt.getNumTrees).cast("int"))
