"""Session helpers.

A cluster sets ``spark.checkpoint.dir`` to a shared folder; we only fill it in
when it is unset (local tests), never overriding what the cluster names.
"""

from __future__ import annotations

import atexit
import os
import re
import tempfile

from pyspark.sql import SparkSession

_CKPT_KEY = "spark.checkpoint.dir"
_WORKING: set[str] = set()


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app_name: str = "caliper") -> SparkSession:
    """A session with AQE on.  ``shuffle_partitions`` is set only if given."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    if shuffle_partitions is not None:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = (
        builder
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    checkpoint_dir(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared folder that the cluster names in ``spark.checkpoint.dir``.

    Only a local master, whose executors share the driver's disk, gets a folder of
    its own if none is named; on a cluster that would be a machine's own disk, so an
    unset folder is an error there."""
    current = spark.conf.get(_CKPT_KEY, None) or spark.sparkContext.getCheckpointDir()
    if current:
        if not spark.sparkContext.getCheckpointDir():
            spark.sparkContext.setCheckpointDir(current)
        return current
    master = spark.sparkContext.master
    if not re.fullmatch(r"local(\[.*\])?", master):
        raise ValueError(f"{_CKPT_KEY} must name a folder that all executors share (master {master})")
    local = tempfile.mkdtemp(prefix="caliper-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    spark.sparkContext.setCheckpointDir(local)
    return local


#: Bytes of an Arrow batch between the JVM and a Python worker.  Spark's own 64 MB stand several times
#: over in each task (the JVM's growing vectors, its buffers, the worker), with no gain for texts, and an
#: executor keeps what it once took outside its heap: 8 MB made over 100 MB of it with two tasks at once.
BATCH_BYTES = 2 << 20
_BATCH_CONF, _SPARKS_OWN = "spark.sql.execution.arrow.maxBytesPerBatch", 64 << 20
_OURS = "caliper.maxBytesPerBatch"          # what we set last


def bounded_batches(spark: SparkSession, most: int = BATCH_BYTES) -> None:
    """Hold Arrow batches to ``most`` bytes, unless the session has its own bound."""
    now = spark.conf.get(_BATCH_CONF, str(_SPARKS_OWN)).lower().rstrip("b")
    if now in ("-1", str(_SPARKS_OWN), spark.conf.get(_OURS, None)):
        spark.conf.set(_BATCH_CONF, str(most))
        spark.conf.set(_OURS, str(most))


def working_dir(spark: SparkSession) -> str:
    """This application's folder for intermediate tables, removed when Python ends."""
    sc = spark.sparkContext
    path = f"{checkpoint_dir(spark).rstrip('/')}/caliper-{sc.applicationId}"
    if path not in _WORKING:
        _WORKING.add(path)
        atexit.register(_remove, sc, path)
    return path


def _remove(sc, path: str) -> None:
    if sc._jsc is None:     # the session is stopped: its gateway may be gone
        return
    where = sc._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(sc._jsc.hadoopConfiguration()).delete(where, True)
