"""Stored tables laid out for lookups by key.

A table is cut into ranges of its keys and sorted by them, so the smallest and largest value of each file
and row group tell most of them apart, and has Bloom filters on these and other asked-for columns, which
tell that a value within a group's bounds isn't there.  Spark's Parquet reader uses both for pushed
filters, so a lookup reads the row groups that hold the key and skips the rest."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .readers import read_table
from .versions import write_version


def _spread(df: DataFrame, keys: list[str]) -> DataFrame:
    """``df`` in key ranges, each sorted.  The other columns' hash cuts a key of many rows into several
    ranges; rows that are equal in all columns stay together."""
    rest = [F.col(f"`{f.name}`") for f in df.schema.fields
            if f.name not in keys and f.dataType.typeName() not in ("map", "variant")]
    by = [F.col(f"`{k}`").asc_nulls_last() for k in keys]
    return df.repartitionByRange(*by, *([F.xxhash64(*rest)] if rest else [])).sortWithinPartitions(*by)


def write_lookup_table(df: DataFrame, path: str, name: str, keys: list[str], also: list[str] | None = None,
                       **options) -> str:
    """Write ``df`` as a new version of ``<path>/<name>``, sorted by ``keys`` (missing ones last), with Bloom
    filters on ``keys`` and on the columns ``also``; returns the version's folder.  ``read_table`` and
    ``look_up`` read it."""
    blooms = {f"parquet.bloom.filter.enabled#{c}": "true" for c in [*keys, *(also or [])]}
    return write_version(_spread(df, keys), os.path.join(path, name),
                         **{"parquet.bloom.filter.adaptive.enabled": "true"} | blooms | options)


def look_up(spark: SparkSession, path: str, name: str, columns: list[str] | None = None, **values) -> DataFrame:
    """The rows of a stored table whose named columns have these values; ``None`` finds missing ones, and
    no rows mean not found."""
    df = read_table(spark, path, name)
    for column, value in values.items():
        c = F.col(f"`{column}`")
        df = df.filter(c.isNull() if value is None else c == F.lit(value))
    return df.select(*columns) if columns else df
