"""Patients and Measurements of the live path: bucketed, versioned, crash-safe.

A table is a folder of ``bucket=B/version=V`` partitions, B a hash of the mrn.
One small file, ``_committed``, names for both tables the version of every
bucket that readers see; it is replaced by one atomic rename, so both tables
change together or not at all.  A batch rewrites only the buckets it touches
(dynamic partition overwrite) under its own version number; the other buckets
keep their files.

Each row carries the ``arrival`` of the message that wrote it (message time,
control id, hash of the text; NULL for bulk-loaded rows, older than any
message).  The latest arrival wins, so what a table holds does not depend on how
messages are cut into batches, or on when a held-back one is released.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 64
KEYS = {"patients": ["mrn"], "measurements": ["mrn", "creatinine_date"]}
VALUES = {"patients": ["age", "sex"], "measurements": ["creatinine_result"]}
ARRIVAL = "struct<msg_time:timestamp,control_id:string,digest:bigint>"
SCHEMAS = {
    "patients": f"mrn string, age int, sex string, arrival {ARRIVAL}, bucket int, version int",
    "measurements": f"mrn string, creatinine_date timestamp, creatinine_result double, arrival {ARRIVAL}, bucket int, version int",
}


# --- small files, replaced atomically ---------------------------------------

def _path(spark: SparkSession, path: str):
    return spark._jvm.org.apache.hadoop.fs.Path(path)


def path_exists(spark: SparkSession, path: str) -> bool:
    p = _path(spark, path)
    return bool(p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p))


def read_json(spark: SparkSession, path: str) -> dict | None:
    p = _path(spark, path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(p):
        return None
    stream = fs.open(p)
    try:
        return json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def write_json(spark: SparkSession, path: str, value: dict) -> None:
    """Write beside the target and rename over it in one step."""
    jvm = spark._jvm
    tmp, dst = _path(spark, f"{path}.tmp"), _path(spark, path)
    fs = tmp.getFileSystem(spark._jsc.hadoopConfiguration())
    out = fs.create(tmp, True)
    try:
        out.write(bytearray(json.dumps(value).encode()))
    finally:
        out.close()
    rename = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
    how = spark.sparkContext._gateway.new_array(rename, 1)
    how[0] = rename.OVERWRITE
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(tmp.toUri(), spark._jsc.hadoopConfiguration()).rename(tmp, dst, how)


# --- versions -----------------------------------------------------------------

def committed(spark: SparkSession, root: str) -> dict | None:
    """{"version", "buckets", "patients": {bucket: version}, "measurements": ...} or None."""
    return read_json(spark, f"{root}/_committed")


def latest_version(spark: SparkSession, root: str) -> int | None:
    state = committed(spark, root)
    return None if state is None else state["version"]


def nothing(buckets: int = BUCKETS) -> dict:
    """The state before the first version."""
    return {"version": -1, "buckets": buckets, "patients": {}, "measurements": {}}


def commit(spark: SparkSession, root: str, state: dict) -> None:
    write_json(spark, f"{root}/_committed", state)


def bucket_of(mrn: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(mrn), F.lit(buckets)).cast("int")


def stored(spark: SparkSession, root: str, table: str, state: dict | None, buckets: list[int] | None = None) -> DataFrame:
    """Rows of a table as ``state`` names them, of some buckets or all, with their arrival."""
    cols = [*KEYS[table], *VALUES[table], "arrival"]
    named = (state or nothing())[table]
    wanted = [b for b in named if buckets is None or int(b) in buckets]
    if not wanted:
        return spark.createDataFrame([], SCHEMAS[table]).select(*cols)
    paths = [f"{root}/{table}/bucket={b}/version={named[b]}" for b in wanted]
    return spark.read.schema(SCHEMAS[table]).option("basePath", f"{root}/{table}").parquet(*paths).select(*cols)


def snapshot(spark: SparkSession, root: str, table: str) -> DataFrame:
    """What readers see of a table: its keys and values."""
    return stored(spark, root, table, committed(spark, root)).select(*KEYS[table], *VALUES[table])


def merged(current: DataFrame, updates: DataFrame, table: str) -> DataFrame:
    """One row a key: the one of the latest arrival (NULL is before any)."""
    cols = [*KEYS[table], *VALUES[table], "arrival"]
    both = current.select(*cols).unionByName(updates.select(*cols))
    rank = F.struct(F.col("arrival").isNotNull().alias("live"), "arrival")
    row = F.struct(*VALUES[table], "arrival")
    return (both.groupBy(*KEYS[table]).agg(F.max_by(row, rank).alias("_row"))
                .select(*KEYS[table], *[F.col("_row")[c].alias(c) for c in [*VALUES[table], "arrival"]]))


def write_buckets(rows: DataFrame, root: str, table: str, version: int, buckets: int) -> None:
    """Write ``rows`` as ``version`` of the buckets they lie in; no other partition is touched."""
    (rows.withColumn("bucket", bucket_of(F.col("mrn"), buckets)).withColumn("version", F.lit(version))
         .repartition("bucket").sortWithinPartitions("bucket", *KEYS[table])
         .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket", "version").parquet(f"{root}/{table}"))


def touched(rows: DataFrame, buckets: int) -> list[int]:
    """The buckets that ``rows`` lie in (at most ``buckets`` numbers)."""
    return sorted(r[0] for r in rows.select(bucket_of(F.col("mrn"), buckets)).distinct().collect())


def advance(state: dict, version: int, changed: dict[str, list[int]]) -> dict:
    """``state`` with the changed buckets at ``version``."""
    return {"version": version, "buckets": state["buckets"],
            **{t: {**state[t], **{str(b): version for b in changed.get(t, [])}} for t in KEYS}}


def create(spark: SparkSession, root: str, patients: DataFrame, measurements: DataFrame, buckets: int = BUCKETS) -> None:
    """Bulk load: version 0 of both tables.  Refuses a root that has a version."""
    if committed(spark, root) is not None:
        raise ValueError(f"{root} holds tables already")
    changed = {}
    for table, df in (("patients", patients), ("measurements", measurements)):
        rows = df.select(*KEYS[table], *VALUES[table]).where(F.col("mrn").isNotNull()).withColumn("arrival", F.lit(None).cast(ARRIVAL))
        write_buckets(rows, root, table, 0, buckets)
        changed[table] = touched(rows, buckets)
    commit(spark, root, advance(nothing(buckets), 0, changed))


def expire(spark: SparkSession, root: str, keep: list[dict]) -> int:
    """Delete the bucket versions that none of the states in ``keep`` names and
    that are not newer than all of them; returns how many went."""
    newest = max(s["version"] for s in keep)
    gone = 0
    for table in KEYS:
        named = {(b, v) for s in keep for b, v in s[table].items()}
        top = _path(spark, f"{root}/{table}")
        fs = top.getFileSystem(spark._jsc.hadoopConfiguration())
        for d in fs.globStatus(_path(spark, f"{root}/{table}/bucket=*/version=*")) or []:
            p = d.getPath()
            b, v = p.getParent().getName().split("=")[1], int(p.getName().split("=")[1])
            if v <= newest and (b, v) not in named:
                fs.delete(p, True)
                gone += 1
    return gone
