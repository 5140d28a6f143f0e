"""Session construction and lineage cuts.

On a cluster the session is created by the platform; ``ensure_checkpoint_dir`` only reads the
shared ``spark.checkpoint.dir`` it names.  A private scratch folder is chosen only for a local
master (tests, bench) when nothing is configured.
"""

from __future__ import annotations

import math
import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

# Sizing defaults for a large cluster.  Local runs override partitions to the core count.
CLUSTER_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Dimension-sized sides below this are broadcast after AQE has measured them;
    # anything larger stays a sort-merge join.
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "64MB",
    "spark.sql.files.maxPartitionBytes": "256MB",
    # Shuffle width: adaptive execution merges partitions down to the advisory size but never
    # splits those of an aggregate, so start wide; a job that shuffles more than a TB passes its
    # own width (input bytes / 256 MB), as the command-line jobs' --shuffle-partitions does.
    "spark.sql.adaptive.coalescePartitions.initialPartitionNum": "4096",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "256MB",
    "spark.sql.session.timeZone": "UTC",
}


def build_session(master: str | None = None, app_name: str = "supplyscope",
                  shuffle_partitions: int | None = None, extra: dict | None = None) -> SparkSession:
    """Create (or get) a session with the settings the library relies on."""
    b = SparkSession.builder.appName(app_name)
    if master:
        b = b.master(master)
    conf = dict(CLUSTER_DEFAULTS)
    conf["spark.ui.enabled"] = "false"
    conf["spark.ui.showConsoleProgress"] = "false"
    if shuffle_partitions is not None:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
        conf["spark.sql.adaptive.coalescePartitions.initialPartitionNum"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder; invent one only for a local master."""
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if configured:
        if not sc.getCheckpointDir():
            sc.setCheckpointDir(configured)
        return sc.getCheckpointDir() or configured
    if not sc.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
    path = tempfile.mkdtemp(prefix="supplyscope-ckpt-")
    sc.setCheckpointDir(path)
    return sc.getCheckpointDir() or path


# The folder of the run that this thread (and no other) is in.
_run: ContextVar[str | None] = ContextVar("run", default=None)


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A new folder name under the run's folder, or under the checkpoint folder outside of a run."""
    return os.path.join(_run.get() or ensure_checkpoint_dir(spark), f"{name}-{uuid.uuid4().hex}")


@contextmanager
def run_folder(spark: SparkSession, name: str) -> Iterator[str]:
    """A folder under the checkpoint folder that holds what ``materialize`` and the like write inside the
    ``with`` block, and is removed at its end, also after an error.

    Results must be stored elsewhere by then: a DataFrame that still reads intermediate tables fails
    afterwards.  Runs nest, and runs of several driver threads don't see each other's folders."""
    path = scratch_folder(spark, name)
    before = _run.set(path)
    try:
        yield path
    finally:
        _run.reset(before)
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def materialize(df: DataFrame, name: str, spark: SparkSession | None = None) -> DataFrame:
    """Write ``df`` as parquet under the checkpoint folder and read it back.

    This cuts the lineage (a lost executor re-reads the files instead of re-running the joins
    above) and lets several later jobs share one scan.
    """
    spark = spark or df.sparkSession
    path = scratch_folder(spark, name)
    df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """What runs inside the ``with`` block removes its shuffle files when it ends.  Else they stay until the
    driver happens to collect its garbage, and the shuffles of steps that follow one another add up on disk."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


# Lines that one task sorts, joins and groups; adaptive execution leaves a given number of partitions alone.
ROWS_PER_TASK = 250_000


def tasks_for(df: DataFrame) -> int:
    """How many tasks share the rows of ``df``, so that what a task holds in memory doesn't grow with the
    table.  A stored Parquet table is counted from its footers."""
    return max(1, math.ceil(df.count() / ROWS_PER_TASK))
