"""Long histories in the patient state: blocks against the plain history, the
cost of a message, and the stream with histories cut into tiny blocks."""

import random
import tempfile
import time

import pytest
from pyspark.sql import functions as F

from renalyze import bindings as B
from renalyze.streaming.state import BLOCK, BlockHistory, History, MemoryStore

from .conftest import SF_SMALL


def same(a, b):
    assert a.keys() == b.keys()
    for k in a:
        assert a[k] == pytest.approx(b[k], rel=1e-12, abs=1e-12, nan_ok=True), k


@pytest.mark.parametrize("block", [1, 2, 5, 50])
def test_blocks_equal_the_plain_history(block):
    rng = random.Random(block)
    for trial in range(12):
        plain, store = History([]), MemoryStore()
        blocks = BlockHistory(store, None, block)
        for _ in range(rng.randint(1, 150)):
            d, v = rng.randint(0, 60), None if rng.random() < 0.15 else rng.choice([float(rng.randint(1, 4)), rng.randint(1, 9000) / 100])
            assert plain.upsert(d, v) == blocks.upsert(d, v)
            same(plain.features(), blocks.features())
            if rng.random() < 0.2:                                # state written and read back
                blocks = BlockHistory(store, blocks.summary(), block)
        assert sum(blocks.dn) == len(plain.dates) and sum(blocks.vn) == len(plain.sorted_vals)
        assert max(blocks.dn) <= 2 * block and len(store.kept) == len(blocks.did) + len(blocks.vid)
        cut = BlockHistory.of(MemoryStore(), plain, block)
        same(plain.features(), cut.features())
        assert plain.upsert(30, 7.5) == cut.upsert(30, 7.5)
        same(plain.features(), cut.features())


def test_values_that_are_not_finite():
    plain, blocks = History([]), BlockHistory(MemoryStore(), None, 2)
    for k, v in enumerate([1.0, float("inf"), 3.0, None, -float("inf"), 2.0]):
        for h in (plain, blocks):
            h.upsert(k, v)
        same(plain.features(), blocks.features())
    for h in (plain, blocks):
        h.upsert(1, 5.0)
        h.upsert(4, 6.0)
    same(plain.features(), blocks.features())


def test_a_message_touches_few_blocks():
    """20,000 readings cost about as much a message as 200."""
    seconds = {}
    for n in (200, 20000):
        rng = random.Random(n)
        store = MemoryStore()
        h = BlockHistory.of(store, History([(k * 10, rng.randint(1, 9000) / 100) for k in range(n)]))
        store.reads = store.writes = 0
        best = 9.0
        for _ in range(5):
            t = time.perf_counter()
            for _ in range(100):
                h.upsert(rng.randrange(n * 10), rng.randint(1, 9000) / 100)
                h.features()
            best = min(best, time.perf_counter() - t)
        seconds[n] = best
        assert store.reads <= 500 * 5 and store.writes <= 500 * 5
        assert max(h.dn) <= 2 * BLOCK
    assert seconds[20000] < 6 * seconds[200]


def test_stream_with_tiny_blocks_equals_one_piece(spark):
    from renalyze.sources import files
    from renalyze.streaming import ingest, sinks, state
    raw = B.hl7_raw(spark, SF_SMALL)
    d = tempfile.mkdtemp(prefix="renalyze-blocks-")
    for i, (a, b) in enumerate([(0, 400), (400, 700), (700, 10**9)]):
        files.write_capture(raw.where((F.col("msg_id") >= a) & (F.col("msg_id") < b)).coalesce(1), f"{d}/landing/part{i}")
    opts = {"maxFilesPerTrigger": "1", "recursiveFileLookup": "true"}
    stored = spark.createDataFrame([(r.mrn, k, 5.0 + k) for r in B.patients(spark, SF_SMALL).limit(3).collect() for k in range(9)], "mrn string, k int, creatinine_result double") \
                  .select("mrn", F.timestamp_seconds(F.lit(1000000) + F.col("k")).alias("creatinine_date"), "creatinine_result")
    runs = []
    for inline, block in ((512, 256), (2, 1)):
        out = f"{d}/out{inline}"
        feats = state.history_stream(ingest.parsed_stream(spark, f"{d}/landing", opts), B.patients(spark, SF_SMALL), stored, inline=inline, block=block)
        sinks.run_available_now(feats, f"{d}/ck{inline}", sink_path=out)
        runs.append(sorted((tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in spark.read.parquet(out).collect()), key=str))
    assert runs[0] == runs[1] and len(runs[0]) > 100
