"""CSV inputs take little disk: compressed files, written share by share, whose shuffles go with each write."""

import datetime as dt
import glob
import gzip
import os

import pytest

import __spark_entry__ as E
from supplyscope import session
from supplyscope.session import shuffles_removed
from supplyscope.sources import fixture_shares, fixture_views, readers, sinks, write_csv

KEY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """400 orders of three lines each; the first order is there twice, some lines have no order, part, supplier or key."""
    at = str(tmp_path_factory.mktemp("tables"))
    day = dt.datetime(2024, 1, 1)
    orders = [(k, (k or 0) % 50, day + dt.timedelta(days=(k or 0) % 300)) for k in [0, None, *range(400)]]
    lines = [(k, j % 20 if j % 31 else None, j % 7, n, 2.0 + j % 5, 10.25 + j, 0.1, 0.05)
             for j, k in enumerate([*range(400), -1, None]) for n in range(3)]
    for name, rows, schema in (
            ("supplier", [(k, f"Supplier {k}") for k in range(6)], "s_suppkey long, s_name string"),
            ("part", [(k, f"part {k}", k, 1.0 + k) for k in range(20)], "p_partkey long, p_name string, p_size int, p_retailprice double"),
            ("orders", orders, "o_orderkey long, o_custkey long, o_orderdate timestamp_ntz"),
            ("lineitem", lines, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, "
                                "l_extendedprice double, l_discount double, l_tax double")):
        spark.createDataFrame(rows, schema).write.parquet(f"{at}/{name}.parquet")
    return at


def rows(df):
    return sorted(map(repr, df.collect()))


def files_of(name):
    return sorted(glob.glob(f"{name}/**/part-*", recursive=True))


@pytest.mark.parametrize("view", ["purchases", "vendor_invoice", "sales", "orders_to_score"])
def test_shares_hold_each_row_once(spark, tables, monkeypatch, view):
    monkeypatch.setattr(readers, "SHARE_ROWS", 300)
    shares = fixture_shares(spark, tables)
    assert len(shares) == 5
    each = [rows(s[view]) for s in shares]
    assert all(each) and sorted(sum(each, [])) == rows(fixture_views(spark, tables)[view])


def test_a_share_takes_its_own_tasks(spark, tables, monkeypatch):
    monkeypatch.setattr(session, "ROWS_PER_TASK", 50)
    monkeypatch.setattr(readers, "SHARE_ROWS", 300)
    assert max(s["purchases"].rdd.getNumPartitions() for s in fixture_shares(spark, tables)) < 12


def test_csv_scorecard_writes_compressed_shares(spark, tables, monkeypatch):
    whole = rows(E.q_csv_scorecard(spark, tables))
    monkeypatch.setattr(readers, "SHARE_ROWS", 300)
    written, settings = [], []
    write = E.write_csv
    monkeypatch.setattr(E, "write_csv", lambda df, path: (written.append(path), write(df, path))[1])
    kept = sinks.shuffles_removed
    monkeypatch.setattr(sinks, "shuffles_removed", lambda s: (settings.append(1), kept(s))[1])
    assert rows(E.q_csv_scorecard(spark, tables)) == whole
    names = [os.path.basename(p) for p in written]
    assert len(settings) == len(names) and [names.count(f"{n}.csv") for n in E.SOURCES] == [5, 5, 1, 1, 1, 1]
    found = files_of(written[0].removeprefix("file:"))
    assert found and all(f.endswith(".csv.gz") for f in found)
    with gzip.open(found[0], "rt") as f:
        assert f.readline().startswith("ReceivingDate,PODate,")


def test_written_csv_folders_hold_bounded_files_and_no_shuffles(spark, tmpdir_path, monkeypatch):
    monkeypatch.setattr(sinks, "CSV_LINES", 10)
    path = os.path.join(tmpdir_path, "numbers")
    df = spark.range(64).repartition(2, "id")
    seen = []
    monkeypatch.setattr(sinks, "shuffles_removed", lambda s: (seen.append(s.conf.get(KEY)), shuffles_removed(s))[1])
    assert write_csv(df, path) == path and write_csv(df, path) == path
    assert seen == ["false", "false"] and spark.conf.get(KEY) == "false"
    assert len(files_of(path)) >= 14
    assert sorted(int(r.id) for r in spark.read.option("header", True).csv(path).collect()) == sorted([*range(64)] * 2)


def test_the_setting_of_shuffles_comes_back_after_an_error(spark):
    with pytest.raises(ValueError), shuffles_removed(spark):
        assert spark.conf.get(KEY) == "true"
        raise ValueError
    assert spark.conf.get(KEY) == "false"
