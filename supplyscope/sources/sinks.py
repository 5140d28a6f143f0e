"""Sinks: result tables (S4), JSON record files (S5), the executive summary (S6) and CSV folders."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame

from ..session import shuffles_removed
from .versions import write_version

#: Lines of a CSV file at most: a compressed one is read by one task.
CSV_LINES = 1_000_000
#: Hadoop's name of gzip's level: files a tenth smaller than by BEST_SPEED in twice the time; the next levels take twice that for little.
CSV_LEVEL = "FOUR"


def write_tables(tables: dict[str, DataFrame], path: str, fmt: str = "parquet",
                 partition_by: dict[str, list[str]] | None = None) -> dict[str, str]:
    """Write each table as a new version of ``<path>/<name>``, which replaces the one before.

    Readers (``read_table``) have the old table until the new one is whole; a write that fails
    changes nothing for them.  Returns the folder of each new version."""
    return {name: write_version(df, os.path.join(path, name), fmt, (partition_by or {}).get(name))
            for name, df in tables.items()}


def write_json(df: DataFrame, path: str) -> str:
    """Write records as JSON Lines, one file per task, replacing what was there.

    Missing values are written as ``null`` (the original wrote ``NaN``, which is not JSON)."""
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)
    return path


def write_summary(summary: DataFrame, path: str) -> str:
    """Write the one-row executive summary as a single JSON object, as a new version like a table."""
    return write_version(summary.coalesce(1), os.path.join(path, "exec_summary"), "json", ignoreNullFields=False)


def write_csv(df: DataFrame, path: str) -> str:
    """Add the rows to a folder of gzipped CSV files with a header.  Shuffle files of the write go at its end."""
    with shuffles_removed(df.sparkSession):
        (df.write.mode("append").option("header", True).option("compression", "gzip").option("zlib.compress.level", CSV_LEVEL)
         .option("maxRecordsPerFile", CSV_LINES).csv(path))
    return path
