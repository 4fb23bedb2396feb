"""Steps whose cost must not grow with the rows in one place."""

import random

import pandas as pd

from renalyze.operators import scoring
from renalyze.plans import catalog

from .conftest import SF_SMALL


def test_what_if_features_read_written_histories(spark):
    df = catalog.QUERIES["what_if_history"](spark, SF_SMALL)
    assert any("/what_if-" in f for f in df.inputFiles())


def test_boosting_runs_at_most_one_task_a_core(spark, monkeypatch):
    from pyspark.ml import Pipeline
    seen = {}
    fit = Pipeline.fit

    def watched(self, data, *a):
        seen["partitions"] = data.rdd.getNumPartitions()
        return fit(self, data, *a)
    monkeypatch.setattr(Pipeline, "fit", watched)
    rows = spark.range(400).selectExpr("double(id % 17) AS x", "int(id % 17 > 8) AS label").repartition(40)
    model = scoring.train_classifier(rows, inputs=["x"], max_iter=2)
    assert seen["partitions"] <= spark.sparkContext.defaultParallelism
    got = scoring.predict(model, rows)
    assert got.where("prediction = label").count() == 400


def test_a_hot_connection_is_not_held_whole(monkeypatch):
    """Chunks in any order, in many small runs: the same frames, few rows at a time."""
    from renalyze.streaming import frames
    rng = random.Random(5)
    text = "".join(f"\x0bframe {k} {'x' * rng.randint(0, 40)}\x1c\r" if k % 7 else "stray\x1c" for k in range(900)) + "\x0bopen"
    cuts = sorted(rng.sample(range(len(text)), 700))
    chunks = [(0, k, text[a:b]) for k, (a, b) in enumerate(zip([0, *cuts], [*cuts, len(text)]))]
    rng.shuffle(chunks)
    pdf = pd.DataFrame(chunks, columns=["conn_id", "seq", "bytes"])
    monkeypatch.setattr(frames, "OUT_ROWS", 50)
    monkeypatch.setattr(frames.in_order, "__defaults__", (300, 1 << 17))
    monkeypatch.setattr(frames, "PAGE", 3)

    class State:
        def exists(self):
            return False

        def update(self, value):
            self.value = value
    p = frames.FrameBuffer()
    p.state = State()
    got = list(p.handleInputRows((0,), iter([pdf.iloc[k:k + 20] for k in range(0, len(pdf), 20)]), None))
    assert len(got) > 10 and max(map(len, got)) <= 60
    got = pd.concat(got, ignore_index=True)
    parts = text.split("\x1c")
    assert got["frame_no"].tolist() == list(range(len(parts) - 1)) and p.state.value == (parts[-1], len(parts) - 1)
    for part, message, status in zip(parts, got["message"], got["status"]):
        head = next((h for h in ("\r\x0b", "\x0b") if part.startswith(h)), None)
        assert status == ("bad_framing" if head is None else "ok")
        assert message is None if head is None else message == part[len(head):]
