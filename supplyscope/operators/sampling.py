"""Reproducible fixed-size sample (G1) and train/test split.

Both draw from an md5 of the row keys, so the same rows come out under any partitioning,
after a lost executor is recomputed, and in DuckDB.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import md5_key
from ..session import materialize

# 48-bit prefix of the md5 hex digest used as a uniform draw.
_PREFIX_HEX = 12
_SPACE = 16 ** _PREFIX_HEX
# The train share: hex prefixes below "cccccccc" are 80 % of the space.
TRAIN_BELOW = "cccccccc"


# A bin with no more rows than this is looked at value by value.
_SMALL_BIN = 10_000


def _nth(df: DataFrame, hashed: str, n: int) -> tuple[str, int]:
    """The smallest value ``v`` of a hex hash column with at least ``n`` rows up to it, and how
    many of the rows that have ``v`` belong to the first ``n``.

    Histograms of two more hex digits each (at most 256 counts) narrow the place, so neither the
    rows nor the values pass through one task, however many rows share a value."""
    prefix = ""
    while True:
        mine = df.filter(F.substring(hashed, 1, len(prefix)) == prefix) if prefix else df
        bins = sorted(tuple(r) for r in mine.groupBy(F.substring(hashed, len(prefix) + 1, 2)
                                                     .alias("d")).count().collect())
        for digits, count in bins:
            if n <= count:
                break
            n -= count
        prefix += digits
        if count <= _SMALL_BIN or len(prefix) >= 32:
            break
    values = (df.filter(F.substring(hashed, 1, len(prefix)) == prefix).groupBy(hashed).count()
              .orderBy(hashed).collect())
    for value, count in values:
        if n <= count:
            return value, n
        n -= count
    raise ValueError("fewer rows than asked for")


def _first(df: DataFrame, hashed: str, n: int) -> tuple[DataFrame, DataFrame, int]:
    """Rows below the ``n``-th value, the rows that have it, and how many of these are wanted."""
    value, wanted = _nth(df, hashed, n)
    return df.filter(F.col(hashed) < value), df.filter(F.col(hashed) == value), wanted


def _copies(row, schema, n: int, spark) -> DataFrame:
    """``n`` equal rows, spread over tasks of a million."""
    values = [F.lit(row[f.name]).cast(f.dataType).alias(f.name) for f in schema.fields]
    return spark.range(0, n, 1, max(1, -(-n // 1_000_000))).select(*values)


def sample_n(df: DataFrame, n: int | None, keys: list[str], seed: int = 42,
             tie_keys: list[str] | None = None) -> DataFrame:
    """Exactly ``min(n, rows)`` rows: those with the smallest ``md5(keys | seed)``, then keys
    (missing ones last), then ``md5(tie_keys | seed)``, then a hash of all other columns.  Rows that
    are equal in all columns are interchangeable, and as many of them as are wanted are taken.
    ``n=None`` takes all rows.

    Neither the sample nor a group of ties goes through one task.  A threshold on the hash
    prefix keeps about ``n + 6·sqrt(n)`` candidates (raised until there are at least ``n``), which
    are written once to the checkpoint folder, so the later steps do not rescan the input; counts
    by hash digits then find the exact cut.  Without a cut the rows are written as well, so both
    ways end the lineage."""
    total = None if n is None else df.count()
    if total is None or n >= total:
        return materialize(df, "sample")
    if n <= 0:
        return df.limit(0)
    names = df.columns
    rest = [c for c in names if c not in keys]
    marked = df.withColumns({"_h": md5_key(keys, seed), "_t": md5_key(tie_keys or [], seed),
                             "_r": md5_key(rest, seed)})
    frac = min(1.0, (n + 6.0 * math.sqrt(n) + 64.0) / total)
    while True:
        limit_hex = format(min(_SPACE - 1, int(frac * _SPACE)), f"0{_PREFIX_HEX}x")
        cand = materialize(marked.filter(F.substring("_h", 1, _PREFIX_HEX) <= F.lit(limit_hex)),
                           "sample-candidates")
        if cand.count() >= n or frac >= 1.0:
            break
        frac = min(1.0, frac * 2.0)
    below, tied, wanted = _first(cand, "_h", n)
    parts = [below]
    # Keys that differ under one hash (a missing key leaves no mark in it): a few at most.
    fields = [f for i, k in enumerate(keys)
              for f in (F.col(f"`{k}`").isNull().alias(f"n{i}"), F.col(f"`{k}`").alias(f"k{i}"))]
    for row in tied.groupBy(*fields).count().orderBy(*[f"{c}{i}" for i in range(len(keys))
                                                       for c in "nk"]).collect():
        mine = tied
        for i, k in enumerate(keys):
            mine = mine.filter(F.col(f"`{k}`").eqNullSafe(F.lit(row[f"k{i}"])))
        if row["count"] <= wanted:
            parts.append(mine)
            wanted -= row["count"]
            continue
        if wanted:
            lower, mine, left = _first(mine, "_t", wanted)
            parts.append(lower)
            lower, equal, left = _first(mine, "_r", left)
            parts.append(lower)
            # Equal in every column (or but for the place of a missing value): a few kinds at most.
            kinds = equal.groupBy(*[F.col(f"`{c}`") for c in equal.columns]).count()
            for kind in kinds.orderBy(*[F.col(f"`{c}`") for c in equal.columns]).limit(left).collect():
                take = min(left, kind["count"])
                if take:
                    parts.append(_copies(kind, equal.schema, take, df.sparkSession))
                left -= take
        break
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select(*[F.col(f"`{c}`") for c in names])


def train_test_flag(keys: list[str], seed: int = 7) -> F.Column:
    """``True`` for the ~80 % training share (hash prefix below ``cccccccc``)."""
    return F.substring(md5_key(keys, seed), 1, len(TRAIN_BELOW)) < F.lit(TRAIN_BELOW)


def train_test_split(df: DataFrame, keys: list[str], seed: int = 7
                     ) -> tuple[DataFrame, DataFrame]:
    """Deterministic 80/20 split shared by both models (G4); sizes are ~80/20, not exact."""
    flag = train_test_flag(keys, seed)
    tagged = df.withColumn("_train", flag)
    return (tagged.filter("_train").drop("_train"), tagged.filter(~F.col("_train")).drop("_train"))
