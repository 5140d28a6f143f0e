"""CSV folders whose files differ in their headers, with the rows that can't be read kept aside.

Spark takes all files of a read for one layout.  Here files are grouped by their header, each group is read
with its own, and the groups are joined by column names.  A row that has too few or too many cells, or a cell
that isn't a value of its column's type, goes to a table of rejected rows instead of failing the load."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import scratch_folder
from .readers import cell_text
from .versions import names

REJECTED = T.StructType([T.StructField("file", T.StringType()), T.StructField("columns", T.ArrayType(T.StringType())),
                         T.StructField("line", T.StringType())])
#: Headers that are read at a time; each is one small Spark job.
HEADERS_AT_ONCE = 16


def _files(spark: SparkSession, path: str) -> list[str]:
    """The data files of a folder, or the one file that ``path`` is."""
    found = [n for n in names(spark, path) if not n.startswith(("_", "."))]
    if not found:
        return []
    return [path] if found == [path.rstrip("/").rsplit("/", 1)[-1]] else [f"{path.rstrip('/')}/{n}" for n in found]


def files_by_header(spark: SparkSession, path: str) -> dict[tuple[str, ...], list[str]]:
    """The files of a folder by their header's column names; a file without any text has none."""
    files = _files(spark, path)
    with ThreadPoolExecutor(HEADERS_AT_ONCE) as pool:
        headers = list(pool.map(lambda f: tuple(spark.read.option("header", True).csv(f).columns), files))
    groups: dict[tuple[str, ...], list[str]] = {}
    for header, file in zip(headers, files):
        if header:
            groups.setdefault(header, []).append(file)
    return groups


def _group(spark: SparkSession, header: tuple[str, ...], files: list[str], schema: T.StructType) -> DataFrame:
    """One group's rows: the schema's columns typed, and ``_file``, ``_columns`` (what is wrong) and ``_line``."""
    absent = [f.name for f in schema.fields if f.name not in header]
    if absent:
        raise ValueError(f"{files[0]} has no column {', '.join(absent)}")
    raw = T.StructType([T.StructField(n, T.StringType()) for n in (*header, "_corrupt")])
    cells = (spark.read.schema(raw).option("header", True).option("mode", "PERMISSIVE")
             .option("columnNameOfCorruptRecord", "_corrupt").csv(files))
    typed, wrong = [], []
    for f in schema.fields:
        text = cell_text(F.col(f"`{f.name}`"), f.dataType)
        value = text.try_cast(f.dataType)
        wrong.append(F.when(text.isNotNull() & value.isNull(), F.lit(f.name)))
        if isinstance(f.dataType, T.DoubleType):
            value = F.nanvl(value, F.lit(None).cast("double"))
        typed.append(value.alias(f.name))
    broken = F.col("_corrupt").isNotNull()
    found = F.when(broken, F.array().cast("array<string>")).otherwise(F.array_compact(F.array(*wrong)))
    line = F.when(broken, F.col("_corrupt")).when(F.size(found) > 0, F.to_json(F.struct(*[F.col(f"`{n}`") for n in header])))
    return cells.select(*typed, F.col("_metadata.file_path").alias("_file"), found.alias("_columns"), line.alias("_line"))


def read_csv_folder(spark: SparkSession, path: str, schema: T.StructType) -> tuple[DataFrame, DataFrame]:
    """The rows of a CSV file or folder with the schema's columns, found by each file's own header, and the
    rejected rows: ``file``, ``columns`` whose cells have no value of their type (none if the number of
    cells is wrong), and the ``line`` (its text if the number of cells is wrong, else its cells as JSON).

    Files are read once: both parts are written to the checkpoint folder in one job.  Empty cells are missing,
    columns that aren't in the schema are ignored, and a file that lacks one of the schema's raises.  Empty
    files and folders give no rows; a path that doesn't exist raises."""
    groups = files_by_header(spark, path)
    if not groups:
        spark.read.text(path)  # raises if it isn't there
        return spark.createDataFrame([], schema), spark.createDataFrame([], REJECTED)
    rows = reduce(DataFrame.unionByName, [_group(spark, h, files, schema) for h, files in sorted(groups.items())])
    out = scratch_folder(spark, "csv-rows")
    rows.withColumn("_rejected", F.col("_line").isNotNull()).write.partitionBy("_rejected").parquet(out)
    stored = spark.read.schema(T.StructType([*rows.schema.fields, T.StructField("_rejected", T.BooleanType())])).parquet(out)
    good = stored.filter(~F.col("_rejected")).select(*[F.col(f"`{f.name}`") for f in schema.fields])
    bad = stored.filter("_rejected").select(F.col("_file").alias("file"), F.col("_columns").alias("columns"),
                                            F.col("_line").alias("line"))
    return good, bad
