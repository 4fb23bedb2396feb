"""Scoring: deterministic rule (M5), gradient-boosted classifier (M1-M4),
label encodings (P20) and outboxes for alerts and ACKs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import hl7
from ..schemas import FEATURE_COLUMNS
from .positions import written

# Ratio of the latest reading to the lowest / median that flags a rise.
RULE_RATIO = 1.5

# Model settings of the upstream classifier: trees, depth, learning rate,
# weight of the positive class.
GBT_TREES, GBT_DEPTH, GBT_RATE, POSITIVE_WEIGHT = 100, 5, 0.05, 100.0

SERVING_INPUTS = ["age", "sex"] + FEATURE_COLUMNS


def rule_score(features: DataFrame) -> DataFrame:
    """M5: 1 when the latest reading is >= 1.5x the minimum or the median."""
    hit = (F.col("rv1_ratio") >= RULE_RATIO) | (F.col("rv2_ratio") >= RULE_RATIO)
    return features.withColumn("prediction", F.when(hit, 1).otherwise(0).cast("int"))


def encode_label(c: Column, other_as_zero: bool = False) -> Column:
    """P20: 'y' -> 1, 'n' -> 0, anything else NULL (or 0)."""
    e = F.when(c == "y", 1).when(c == "n", 0)
    return (e.otherwise(0) if other_as_zero else e).cast("int")


def label_text(c: Column) -> Column:
    """sink_predictions: 1 -> 'y', else 'n'."""
    return F.when(c == 1, F.lit("y")).otherwise(F.lit("n"))


# Stand-ins for non-finite inputs (x/0 ratios): tree learners take only
# finite values; any value above the real range splits the same way.
INF_STANDIN = 1.0e12


def finite_inputs(df: DataFrame, cols: list[str]) -> DataFrame:
    """+inf -> 1e12, -inf -> -1e12, NaN / NULL -> 0 for the model inputs."""
    fixed = {}
    for c in cols:
        x = F.col(c).cast("double")
        fixed[c] = (F.when(x == float("inf"), F.lit(INF_STANDIN))
                     .when(x == float("-inf"), F.lit(-INF_STANDIN))
                     .when(F.isnan(x) | x.isNull(), F.lit(0.0))
                     .otherwise(x))
    return df.withColumns(fixed)


def train_classifier(train: DataFrame, label: str = "label", seed: int = 7,
                     inputs: list[str] | None = None, max_iter: int = GBT_TREES):
    """M1: gradient-boosted trees with the upstream settings; positives are
    weighted 100.  Returns a fitted PipelineModel (assembler + GBT); inputs
    are made finite first (``finite_inputs``).

    Boosting runs some thousand stages, and every task of each answers to the
    driver: the training rows are written once and read as at most one
    partition a core, so that traffic does not grow with the rows."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler

    cols = inputs or SERVING_INPUTS
    data = finite_inputs(train.select(*cols, label), cols).withColumn(
        "_w", F.when(F.col(label) == 1, F.lit(POSITIVE_WEIGHT)).otherwise(F.lit(1.0)))
    data = written(data, "train-rows").coalesce(train.sparkSession.sparkContext.defaultParallelism)
    asm = VectorAssembler(inputCols=cols, outputCol="features", handleInvalid="keep")
    gbt = GBTClassifier(labelCol=label, featuresCol="features", weightCol="_w",
                        maxDepth=GBT_DEPTH, stepSize=GBT_RATE, maxIter=max_iter, seed=seed)
    return Pipeline(stages=[asm, gbt]).fit(data)


def predict(model, features: DataFrame) -> DataFrame:
    """M2 + M3: class (0/1) and probability of class 1 for feature rows."""
    from pyspark.ml.functions import vector_to_array

    cols = model.stages[0].getInputCols()
    out = model.transform(finite_inputs(features, cols))
    return (out.withColumn("probability_1", vector_to_array("probability")[1])
               .withColumn("prediction", F.col("prediction").cast("int"))
               .drop("features", "rawPrediction", "probability"))


def compiled(model) -> Column:
    """The fitted trees as one column over the model's inputs: the margin,
    whose sign is the class (M2) and whose logistic is the probability (M3).
    It scores inside any plan, a streaming one too, without an ML transformer."""
    assembler, gbt = model.stages
    inputs = [F.col(c).cast("double") for c in assembler.getInputCols()]

    def walk(node) -> Column:
        if node.getClass().getSimpleName() == "LeafNode":
            return F.lit(float(node.prediction()))
        split = node.split()
        x = inputs[split.featureIndex()]
        if split.getClass().getSimpleName() == "ContinuousSplit":
            goes_left = x <= float(split.threshold())
        else:
            goes_left = x.isin([float(c) for c in split.leftCategories()])
        return F.when(goes_left, walk(node.leftChild())).otherwise(walk(node.rightChild()))

    trees = [walk(t._java_obj.rootNode()) * F.lit(float(w)) for t, w in zip(gbt.trees, gbt.treeWeights)]
    return F.aggregate(F.array(*trees), F.lit(0.0), lambda a, x: a + x)


def compiled_predict(model, features: DataFrame) -> DataFrame:
    """``predict`` by the compiled trees."""
    cols = model.stages[0].getInputCols()
    out = finite_inputs(features, cols).withColumn("_margin", compiled(model))
    return out.withColumns({"probability_1": 1 / (1 + F.exp(-2 * F.col("_margin"))),
                            "prediction": F.when(F.col("_margin") > 0, 1).otherwise(0).cast("int")}).drop("_margin")


def alert_outbox(scored: DataFrame, ts_text: str = "alert_time", dedupe: bool = True) -> DataFrame:
    """Alerts for positive rows: (mrn, alert_ts, payload).  ``dedupe`` keeps
    one page per (mrn, alert_ts) when a message is delivered again."""
    pos = scored.where(F.col("prediction") == 1)
    out = pos.select("mrn", hl7.alert_timestamp(F.col(ts_text)).alias("alert_ts"),
                     hl7.alert_payload(F.col("mrn"), F.col(ts_text)).alias("payload"))
    return out.dropDuplicates(["mrn", "alert_ts"]) if dedupe else out


def ack_outbox(processed: DataFrame, ack_ts: str = "sent_ts") -> DataFrame:
    """One ACK per processed message: (msg_id, control_id, ack)."""
    return processed.select("msg_id", "control_id",
                            hl7.ack_text(F.col("control_id"), F.col(ack_ts)).alias("ack"))
