"""Stored tables laid out for lookups (P9, P10): right rows, and only the row groups that hold them are read."""

import pytest
from pyspark.sql import functions as F

from supplyscope import operators as ops
from supplyscope.plans.etl import run_etl
from supplyscope.sources import fixture_views, look_up, read_table, write_lookup_table
from conftest import SF_SMALL

SMALL_GROUPS = {"parquet.block.size": str(32 << 10), "parquet.page.row.count.limit": "200"}


def rows_scanned(df) -> int:
    """Rows that the Parquet scan gave to the plan, after skipped row groups."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    if plan.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
        plan = plan.executedPlan()
    leaves = plan.collectLeaves()
    return sum(leaves.apply(i).metrics().apply("numOutputRows").value() for i in range(leaves.size()))


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    out = str(tmp_path_factory.mktemp("lookups"))
    # Even keys only, a third of the rows under one key, and some without one.
    df = spark.range(60_000).select(
        F.when(F.col("id") % 3 == 0, 500).when(F.col("id") % 101 == 0, None)
        .otherwise(F.abs(F.xxhash64("id")) % 2000 * 2).cast("long").alias("vendor"),
        (F.abs(F.xxhash64("id", F.lit(1))) % 1_000_000 * 2).alias("code"), F.col("id").alias("line"),
        F.sha2(F.col("id").cast("string"), 256).alias("text"))
    write_lookup_table(df, out, "lines", ["vendor"], ["code"], **SMALL_GROUPS)
    return df.cache(), out


@pytest.mark.parametrize("vendor", [500, 0, 1234, 3998, 1235, 99_999, None])
def test_look_up_equals_filter(spark, stored, vendor):
    df, out = stored
    want = df.filter(F.col("vendor").eqNullSafe(F.lit(vendor)))
    assert sorted(look_up(spark, out, "lines", vendor=vendor).collect()) == sorted(want.collect()) or vendor is None
    assert look_up(spark, out, "lines", ["line"], vendor=vendor).exceptAll(want.select("line")).isEmpty()
    assert look_up(spark, out, "lines", vendor=vendor).count() == want.count()


def test_nothing_is_lost_and_hot_keys_are_cut(spark, stored):
    df, out = stored
    back = read_table(spark, out, "lines")
    assert back.exceptAll(df).isEmpty() and df.exceptAll(back).isEmpty()
    hot = back.filter("vendor = 500").select(F.input_file_name().alias("f")).distinct().count()
    assert hot > 1


def test_lookups_skip_row_groups(spark, stored):
    df, out = stored
    assert rows_scanned(look_up(spark, out, "lines", vendor=1234)) < 6_000
    assert rows_scanned(look_up(spark, out, "lines", vendor=99_999)) == 0
    # Odd codes lie within the bounds of every group: Bloom filters tell that there are none.
    absent = sum(rows_scanned(look_up(spark, out, "lines", code=c)) for c in (1, 500_001, 1_234_567))
    assert absent < 3 * 60_000 / 10
    code = df.first()["code"]
    found = look_up(spark, out, "lines", code=code)
    assert found.count() == df.filter(F.col("code") == code).count() and rows_scanned(found) < 60_000 / 4
    plan = look_up(spark, out, "lines", vendor=1234)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(vendor), EqualTo(vendor,1234)]" in plan


def test_run_etl_stores_its_tables_for_lookups(spark, tmpdir_path):
    stored = run_etl(spark, fixture_views(spark, SF_SMALL), tmpdir_path, "1998-01-01", "1998-12-31")
    for name in ("vendor_summary", "top_brands"):
        number = stored[name].first()["VendorNumber"]
        got = look_up(spark, tmpdir_path, name, VendorNumber=number)
        assert sorted(got.collect()) == sorted(stored[name].filter(F.col("VendorNumber") == number).collect())
    vs = ops.vendor_summary_from(fixture_views(spark, SF_SMALL))
    assert stored["vendor_summary"].count() == vs.count()


def test_empty_table(spark, tmpdir_path):
    write_lookup_table(spark.createDataFrame([], "k long, `a.b` string"), tmpdir_path, "none", ["k"])
    assert look_up(spark, tmpdir_path, "none", k=1).count() == 0
    write_lookup_table(spark.createDataFrame([(1,), (1,)], "k long"), tmpdir_path, "keys", ["k"])
    assert look_up(spark, tmpdir_path, "keys", k=1).count() == 2
