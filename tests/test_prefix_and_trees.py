"""Block-wise running sums, and fitted trees compiled to a column."""

import math
import random

import pytest
from pyspark.sql import functions as F

from renalyze.operators import features as feat
from renalyze.operators import scoring
from renalyze.operators.prefix import running_sums

INF = float("inf")


@pytest.mark.parametrize("resolution", [1, 16, 1024])
@pytest.mark.parametrize("descending", [False, True])
def test_running_sums_of_numbers(spark, resolution, descending):
    rng = random.Random(3)
    xs = list({rng.choice([rng.uniform(-9, 9), rng.uniform(-1e300, 1e300), float(rng.randint(-50, 50))]) for _ in range(300)} | {0.0, INF, -INF, 1e-310})
    rows = [(x, rng.randint(0, 9)) for x in xs]
    got = {r.x: r.cum_c for r in running_sums(spark.createDataFrame(rows, "x double, c long"), "x", ["c"], descending, resolution).collect()}
    total = 0
    for x, c in sorted(rows, reverse=descending):
        total += c
        assert got[x] == total


def test_running_sums_of_texts_and_the_plan(spark):
    rng = random.Random(5)
    names = list({"".join(rng.choice("abé日") for _ in range(rng.randint(0, 6))) for _ in range(200)})
    df = spark.createDataFrame([(n, 1) for n in names], "x string, c long")
    out = running_sums(df, "x", ["c"])
    got = {r.x: r.cum_c for r in out.collect()}
    assert [got[n] for n in sorted(names, key=lambda n: n.encode())] == list(range(1, len(names) + 1))
    sizes = [len(running_sums(spark.range(n).select(F.col("id").cast("double").alias("x"), "id"), "x", ["id"])
                 ._jdf.queryExecution().optimizedPlan().toString()) for n in (10, 100000)]
    assert abs(sizes[0] - sizes[1]) < 40
    codes = feat.encode_sex_fitted(spark.createDataFrame([("M",), ("F",), (None,), ("Other",), ("M",)], "sex string"))
    assert {(r.sex, r.sex_code) for r in codes.collect()} == {("F", 0), ("M", 1), ("Other", 2), (None, None)}


def test_compiled_trees_equal_the_model(spark):
    rng = random.Random(7)
    cols = scoring.SERVING_INPUTS
    rows = [(str(k), *[rng.choice([0.0, rng.uniform(0, 9), INF, None]) for _ in cols], rng.randint(0, 1)) for k in range(120)]
    df = spark.createDataFrame(rows, "mrn string, " + ", ".join(f"{c} double" for c in cols) + ", label int")
    model = scoring.train_classifier(df, max_iter=6)
    a = {r.mrn: r for r in scoring.predict(model, df).collect()}
    b = {r.mrn: r for r in scoring.compiled_predict(model, df).collect()}
    assert len(a) == len(b) == 120 and len({r.prediction for r in b.values()}) == 2
    for k, r in a.items():
        assert r.prediction == b[k].prediction and math.isclose(r.probability_1, b[k].probability_1, abs_tol=1e-12)
