"""CSV folders with differing headers, and rows that can't be read."""

import json
import os

import pytest
from pyspark.sql import types as T

from supplyscope.sources import load_sources, read_csv_folder
from supplyscope import schemas

SCHEMA = T.StructType([T.StructField("Brand", T.LongType()), T.StructField("Name", T.StringType()),
                       T.StructField("Price", T.DoubleType()), T.StructField("Day", T.DateType())])


def write(folder, **files):
    os.makedirs(folder, exist_ok=True)
    for name, text in files.items():
        with open(os.path.join(folder, f"{name}.csv"), "w", encoding="utf-8") as f:
            f.write(text)
    return folder


def test_files_with_other_headers_and_bad_rows(spark, tmpdir_path):
    path = write(os.path.join(tmpdir_path, "in"),
                 a="Brand,Name,Price,Day\n1,one,1.5,2024-01-02\nx2,two,2.5,2024-01-03\n3.0,,nan,\n",
                 b="Day,Extra,Price,Brand,Name\n2024-02-01,?,4.5,4,\"fo,ur\"\nsoon,?,cheap,5,five\n2024-02-03,?,6\n",
                 c="Brand,Name,Price,Day\n7,seven,7,2024-03-01\n8,eight,8,2024-03-01,more\n",
                 d="Brand,Name,Price,Day\n", e="", _ignored="Nothing\n1\n")
    good, bad = read_csv_folder(spark, path, SCHEMA)
    assert good.schema.simpleString() == SCHEMA.simpleString()
    got = sorted((r.Brand, r.Name, r.Price, str(r.Day)) for r in good.collect())
    assert got == [(1, "one", 1.5, "2024-01-02"), (3, None, None, "None"), (4, "fo,ur", 4.5, "2024-02-01"),
                   (7, "seven", 7.0, "2024-03-01")]
    rows = {(os.path.basename(r.file), tuple(r.columns), r.line) for r in bad.collect()}
    texts = {(f, c): line for f, c, line in rows}
    assert len(rows) == 4
    assert json.loads(texts["a.csv", ("Brand",)]) == {"Brand": "x2", "Name": "two", "Price": "2.5", "Day": "2024-01-03"}
    assert json.loads(texts["b.csv", ("Price", "Day")])["Extra"] == "?"
    assert texts["b.csv", ()] == "2024-02-03,?,6" and texts["c.csv", ()] == "8,eight,8,2024-03-01,more"


def test_absent_columns_and_paths_raise_and_empty_folders_do_not(spark, tmpdir_path):
    path = write(os.path.join(tmpdir_path, "in"), a="Brand,Name,Price,Day\n", b="Brand,Name\n1,one\n")
    with pytest.raises(ValueError, match="Price, Day"):
        read_csv_folder(spark, path, SCHEMA)
    with pytest.raises(Exception):
        read_csv_folder(spark, os.path.join(tmpdir_path, "none"), SCHEMA)[0].count()
    good, bad = read_csv_folder(spark, write(os.path.join(tmpdir_path, "empty"), a=""), SCHEMA)
    assert good.count() == 0 and bad.count() == 0
    good, bad = read_csv_folder(spark, os.path.join(write(os.path.join(tmpdir_path, "one"), a="Day,Price,Name,Brand\n,1,n,2\n"), "a.csv"),
                                SCHEMA)
    assert [tuple(r) for r in good.collect()] == [(2, "n", 1.0, None)] and bad.count() == 0


def test_load_sources_keeps_bad_rows_aside(spark, tmpdir_path):
    for name, schema in schemas.SOURCES.items():
        header = [f.name for f in schema.fields]
        write(tmpdir_path, **{name: ",".join(header) + "\n" + ",".join("1" if not isinstance(f.dataType, T.DateType)
                                                                      else "2024-01-01" for f in schema.fields) + "\nonly one\n"})
    rejected = {}
    found = load_sources(spark, tmpdir_path, register_views=False, rejected=rejected)
    assert all(df.count() == 1 for df in found.values())
    assert {k: [r.line for r in v.collect()] for k, v in rejected.items()} == {k: ["only one"] for k in schemas.SOURCES}
