"""Tables as committed versions, so that a replace that fails leaves the old table readable.

A table's folder holds a folder for each version and ``_commits``, with an empty file for each version
whose write has ended.  Readers take the last committed one.  A commit is the creation of one file,
which every file system and object store does as a whole; nothing is renamed or deleted before it.
After it, versions older than the previous one are removed, so a reader that has just planned on the
previous version can finish."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

COMMITS = "_commits"


def _folder(spark: SparkSession, path: str):
    """The Hadoop path and its file system, as Spark's own readers and writers use them."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def names(spark: SparkSession, path: str) -> list[str]:
    """Names of what a folder holds, in order; none if it is absent."""
    at, fs = _folder(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(at)) if fs.exists(at) else []


def committed(spark: SparkSession, table: str) -> list[str]:
    """The committed versions of a table, oldest first."""
    return names(spark, f"{table}/{COMMITS}")


def current(spark: SparkSession, table: str) -> str:
    """The folder to read: the last committed version, or the table itself where it has no versions."""
    found = committed(spark, table)
    return f"{table}/{found[-1]}" if found else table


def new_version(spark: SparkSession, table: str) -> str:
    """The name of the next version: later than all that are there, committed or not."""
    numbers = [int(n[1:11]) for n in names(spark, table) if n.startswith("v")]
    return f"v{max(numbers, default=0) + 1:010d}-{uuid.uuid4().hex[:8]}"


def commit(spark: SparkSession, table: str, version: str) -> None:
    """Make a version that has been written the current one, and remove those before the previous one."""
    at, fs = _folder(spark, f"{table}/{COMMITS}/{version}")
    fs.create(at, False).close()
    found = committed(spark, table)
    for old in [n for n in names(spark, table) if n.startswith("v") and len(found) > 1 and n < found[-2]]:
        # The mark goes first: a version without files must not be read.
        fs.delete(_folder(spark, f"{table}/{COMMITS}/{old}")[0], False)
        fs.delete(_folder(spark, f"{table}/{old}")[0], True)


def write_version(df: DataFrame, table: str, fmt: str = "parquet", partition_by: list[str] | None = None,
                  **options) -> str:
    """Write ``df`` as a new version and commit it; the table's readers see the old one until then."""
    spark = df.sparkSession
    version = new_version(spark, table)
    writer = df.write.mode("error").format(fmt).options(**options)
    (writer.partitionBy(*partition_by) if partition_by else writer).save(f"{table}/{version}")
    commit(spark, table, version)
    return f"{table}/{version}"
