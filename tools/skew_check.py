"""Run the per-patient operators with one patient holding a third of all rows.

Usage: python tools/skew_check.py [sf_dir]

The readings binding is re-keyed so that every third event belongs to one
patient ("hot"), then upserts, serving features (split median, chunked
largest step), slot numbers, previous readings and running features are
timed against the unskewed binding.  Prints one line per operator:
seconds unskewed / seconds skewed, then, from Spark's event log (written to
a scratch folder), the longest and the median task of each run.
"""

from __future__ import annotations

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import functions as F  # noqa: E402

from renalyze import bindings as B  # noqa: E402
from renalyze.operators import features as feat  # noqa: E402
from renalyze.operators import asof, ordered, store  # noqa: E402
from renalyze.session import get_session  # noqa: E402


def rows(spark, sf, skew: bool):
    r = B.measurement_rows(spark, sf)
    if skew:
        r = r.withColumn("mrn", F.when(F.col("arrival") % 3 == 0, F.lit("hot")).otherwise(F.col("mrn")))
    return r


def timed(df) -> float:
    t = time.perf_counter()
    df.write.format("noop").mode("overwrite").save()
    return time.perf_counter() - t


def task_stats(log_dir: str) -> dict:
    """From the event log: per job group, (longest task, median task) in ms."""
    import glob
    import json
    import statistics
    stage_group, durations = {}, {}
    for path in sorted(glob.glob(os.path.join(log_dir, "**", "*"), recursive=True)):
        if os.path.isdir(path) or os.path.basename(path).startswith("appstatus"):
            continue
        with open(path) as fh:
            for line in fh:
                ev = json.loads(line)
                kind = ev.get("Event")
                if kind == "SparkListenerJobStart":
                    group = (ev.get("Properties") or {}).get("spark.jobGroup.id")
                    for sid in ev.get("Stage IDs", []):
                        stage_group[sid] = group
                elif kind == "SparkListenerTaskEnd":
                    info = ev["Task Info"]
                    durations.setdefault(ev["Stage ID"], []).append(info["Finish Time"] - info["Launch Time"])
    per_group = {}
    for sid, ds in durations.items():
        g = stage_group.get(sid)
        if g:
            per_group.setdefault(g, []).extend(ds)
    return {g: (max(ds), statistics.median(ds)) for g, ds in per_group.items()}


def main(argv):
    import tempfile
    sf = argv[1] if len(argv) > 1 else "/root/testdata/sf0.1"
    log_dir = tempfile.mkdtemp(prefix="renalyze-eventlog-")
    spark = get_session("local[8]", shuffle_partitions=16,
                        extra={"spark.eventLog.enabled": "true", "spark.eventLog.dir": log_dir,
                               "spark.eventLog.compress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    pats = B.patients(spark, sf).unionByName(
        spark.createDataFrame([("hot", 50, "F")], "mrn string, age int, sex string"))
    ops = {
        "upsert (dedupe by key)": lambda m: m,
        "features_serving": lambda m: feat.features_serving(pats, m),
        "slot numbers (chunked)": lambda m: ordered.keyed_row_number(m, "mrn", "creatinine_date"),
        "previous reading (chunked)": lambda m: ordered.keyed_lag(m, "mrn", "creatinine_date", "creatinine_result"),
        "running_features": lambda m: feat.running_features(m),
        "running_features (blocks of 4096)": lambda m: asof.features_as_of(
            m, F.col("creatinine_date"), "creatinine_date", "creatinine_result", None, 4096),
    }
    for name, op in ops.items():
        res = []
        for skew in (False, True):
            m = store.dedupe_last(rows(spark, sf, skew), ["mrn", "creatinine_date"], ["creatinine_result"])
            timed(op(m))  # warm-up
            spark.sparkContext.setJobGroup(f"{name}|{'skewed' if skew else 'plain'}", name)
            res.append(min(timed(op(m)) for _ in range(2)))
            spark.sparkContext.setJobGroup("other", "other")
        hot = rows(spark, sf, True).where("mrn = 'hot'").count()
        print(f"{name}: {res[0]:.2f} s / {res[1]:.2f} s with a hot patient of {hot} rows")
    spark.stop()   # flush the event log
    stats = task_stats(log_dir)
    print("longest / median task (ms), plain -> skewed:")
    for name in ops:
        p, q = stats.get(f"{name}|plain"), stats.get(f"{name}|skewed")
        if p and q:
            print(f"  {name}: {p[0]} / {p[1]:.0f} -> {q[0]} / {q[1]:.0f}")


if __name__ == "__main__":
    main(sys.argv)
