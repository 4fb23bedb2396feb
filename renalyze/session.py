"""Session helpers: one place for the settings every job relies on."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

# Settings the operators assume.  UTC keeps timestamps free of zone effects;
# AQE re-plans joins and coalesces small shuffle partitions at run time.
REQUIRED_CONF = {
    "spark.sql.session.timeZone": "UTC",
}

DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_session(master: str | None = None, app: str = "renalyze",
                shuffle_partitions: int | None = None,
                extra: dict | None = None) -> SparkSession:
    """Build (or reuse) a session with the settings the library expects."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    for k, v in {**DEFAULT_CONF, **REQUIRED_CONF}.items():
        b = b.config(k, v)
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in (extra or {}).items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    prepare(spark)
    return spark


_SHIPPED: dict = {}


def ship_package(spark: SparkSession) -> None:
    """Make ``renalyze`` importable in the Python workers.

    Pandas functions (``mapInPandas``, ``transformWithStateInPandas``) are
    pickled by reference to this package; executors (or local-mode workers
    started in another directory) must be able to import it.  The package is
    zipped once per process and added with ``addPyFile`` once per
    SparkContext -- what ``--py-files`` does for a cluster submission.
    """
    try:
        sc = spark.sparkContext
    except Exception:  # noqa: BLE001 - remote session: ship with the job instead
        return
    key = sc.applicationId
    if key in _SHIPPED:
        return
    import shutil
    pkg = os.path.dirname(os.path.abspath(__file__))
    if "zip" not in _SHIPPED:
        out = tempfile.mkdtemp(prefix="renalyze-pyfiles-")
        _SHIPPED["zip"] = shutil.make_archive(os.path.join(out, "renalyze"), "zip",
                                              root_dir=os.path.dirname(pkg), base_dir="renalyze")
    sc.addPyFile(_SHIPPED["zip"])
    # Python processes the JVM starts outside tasks (e.g. the streaming
    # runner that initialises a transformWithStateInPandas processor) read
    # PYTHONPATH from the functions' environment, not the task includes.
    paths = [p for p in sc.environment.get("PYTHONPATH", "").split(os.pathsep) if p]
    if _SHIPPED["zip"] not in paths:
        sc.environment["PYTHONPATH"] = os.pathsep.join([_SHIPPED["zip"], *paths])
    _SHIPPED[key] = True


def prepare(spark: SparkSession) -> SparkSession:
    """Apply the settings results depend on to an existing session and make
    the package importable in its Python workers."""
    for k, v in REQUIRED_CONF.items():
        if spark.conf.get(k, None) != v:
            spark.conf.set(k, v)
    ship_package(spark)
    return spark


def checkpoint_root(spark: SparkSession) -> str:
    """Shared folder for checkpoints and written intermediate tables.

    Uses the cluster's ``spark.checkpoint.dir``.  Only when it is unset (local
    tests) a fresh folder is made and registered, so lineage cuts and scratch
    tables always land in the folder the cluster names.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        try:
            jdir = spark.sparkContext._jsc.sc().getCheckpointDir()
            root = jdir.get() if jdir.isDefined() else None
        except Exception:  # noqa: BLE001 - no JVM context (remote session)
            root = None
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a shared folder when the session is built")
        root = tempfile.mkdtemp(prefix="renalyze-ckpt-")      # one machine: tests
    try:
        spark.sparkContext.setCheckpointDir(root)
    except Exception:  # noqa: BLE001 - remote session: the conf is enough
        pass
    return root


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new, unique path under the checkpoint root for a written table."""
    root = checkpoint_root(spark)
    return os.path.join(root, "tables", f"{name}-{uuid.uuid4().hex[:12]}")


def spread_for_cpu(df):
    """For a plain scan (anything with a shuffle would run it here): round-robin ``df`` over the cluster's cores when its scan yields fewer
    partitions than there are cores (e.g. one small unsplittable file), so
    CPU-heavy row-local work (HL7 parsing) uses every core.  Large inputs
    already have many splits and are returned unchanged: no extra shuffle
    at scale.  Streaming frames are left alone."""
    if df.isStreaming:
        return df
    try:
        cores = df.sparkSession.sparkContext.defaultParallelism
        n = df.rdd.getNumPartitions()
    except Exception:  # noqa: BLE001 - planning failure: leave as is
        return df
    return df.repartition(cores) if n < cores else df


def sized_conf(input_bytes: int, cores: int, target_partition_bytes: int = 128 * 1024 * 1024) -> dict[str, str]:
    """Settings sized to the input so shuffle partitions stay near
    ``target_partition_bytes`` (they must fit an executor task's memory with
    room for sort / aggregation buffers).

    * ``spark.sql.shuffle.partitions``: input / target, at least 2 x cores; AQE then coalesces small partitions and splits skewed ones,
      so this is the upper bound it works down from.
    * ``spark.sql.files.maxPartitionBytes``: scan splits of the same size.
    * advisory size for AQE coalescing and the skew-join thresholds follow
      the same target.

    At 100 TiB and 128 MiB this gives 819,200 for the first shuffle; later
    shuffles of partial aggregates are far smaller and are coalesced.
    """
    n = max(2 * cores, -(-int(input_bytes) // target_partition_bytes))
    t = str(target_partition_bytes)
    return {
        "spark.sql.shuffle.partitions": str(n),
        "spark.sql.files.maxPartitionBytes": t,
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": t,
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": str(4 * target_partition_bytes),
        "spark.sql.adaptive.coalescePartitions.minPartitionSize": str(target_partition_bytes // 8),
    }


def apply_conf(spark: SparkSession, conf: dict[str, str]) -> SparkSession:
    for k, v in conf.items():
        spark.conf.set(k, v)
    return spark
