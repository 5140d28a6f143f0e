"""One scan for several aggregates, mergeable loads, versioned tables, counts of dropped rows, exact sums."""

import os
import random
import re
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from supplyscope import operators as ops
from supplyscope.functions import exact_sum
from supplyscope.operators import states
from supplyscope.plans import incremental
from supplyscope.plans.training import load_models, save_models
from supplyscope.sources import fixture_views, read_table, versions, write_tables
from conftest import SF_SMALL

FROM, TO = "1998-01-01", "1998-12-31"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


# ---------------------------------------------------------------- sums
def total(spark, values):
    return spark.createDataFrame([(float(v),) for v in values], "x double").repartition(3).agg(exact_sum("x").alias("s")).first().s


def test_sums_keep_all_digits_at_every_size(spark):
    assert total(spark, [300000000.0000003] * 10_000) == float(10_000 * Fraction(300000000.0000003))
    rnd = random.Random(5)
    for size in (1e-3, 1.0, 1e6, 1e9, 1e13):
        values = [rnd.uniform(-size, size) for _ in range(500)]
        want = sum(map(Fraction, values))
        assert abs(Fraction(total(spark, values)) - want) <= max(abs(want) * Fraction(2, 2**53), Fraction(1, 10**15)), size


def test_products_of_money_add_up_as_decimals(spark):
    rnd = random.Random(6)
    triples = [(rnd.randrange(1, 10**7), rnd.randrange(0, 11), rnd.randrange(0, 6) * 25) for _ in range(2000)]
    values = [c / 100 * (1 - d / 100) * (1.0 + f / 100) for c, d, f in triples]
    assert total(spark, values) == sum(c * (100 - d) * (100 + f) for c, d, f in triples) / 10**6


# ---------------------------------------------------------------- one scan
def test_purchases_are_scanned_once_for_all_tables(spark):
    held = states.purchase_states(fixture_views(spark, SF_SMALL)["purchases"], list(states.GRAINS), FROM, TO)
    assert len(re.findall(r"FileScan parquet \[[^\]]*\bl_orderkey", plan(held))) == 1
    assert plan(held).count("Expand") == 1


def test_one_scan_equals_the_single_aggregates(spark):
    p = fixture_views(spark, SF_SMALL)["purchases"]
    t = ops.purchase_tables(p, FROM, TO, 50)
    assert rows(t["purchase_metrics"]) == rows(ops.purchase_metrics(p))
    assert rows(t["monthly_trends"]) == rows(ops.monthly_trends(p, FROM, TO))
    assert rows(t["top_brands"]) == rows(ops.top_brands(p, 50))


def test_no_exchange_carries_sums_per_order(spark):
    """Rows of the order grain hold keys alone when they are shuffled."""
    held = states.purchase_states(fixture_views(spark, SF_SMALL)["purchases"], ["vendor", "order"])
    orders = held.where("grain = 'order'")
    measures = [c for c in held.columns if c not in states.KEYS]
    assert orders.where(" OR ".join(f"{c} IS NOT NULL" for c in measures)).isEmpty()
    # Two exchanges of lines' keys, none of (vendor, PO, name) with sums: the wide grain has no PO.
    assert held.where("grain = 'vendor' AND k2 IS NOT NULL").isEmpty()
    assert "VendorName" not in plan(ops.vendor_summary_from(fixture_views(spark, SF_SMALL), sort=False, columns=ops.HISTOGRAM_COLUMNS))


def test_states_of_odd_lines(spark):
    d = lambda s: s and __import__("datetime").date.fromisoformat(s)
    lines = [(None, None, 1, 1.0, 2.5, 2.5, d("1998-01-01"), d("1998-01-03"), 7, "x"), (None, "N", None, 1.0, None, float("nan"), d("1998-02-01"), d("1998-02-12"), None, None),
             (1, "A", 5, 2.0, 3.0, 1.5, d("1998-01-05"), None, 7, "y"), (1, "B", 5, 2.0, 3.0, 1.5, None, None, 7, "y"),
             (1, None, 6, 4.0, 5.0, 1.5, d("1997-01-05"), d("1997-01-05"), 8, "y"), (1, "A", 6, 4.0, 5.0, 1.5, d("1997-01-05"), d("1997-01-09"), 8, "y")]
    df = spark.createDataFrame(lines, "VendorNumber int, VendorName string, PONumber long, Quantity double, Dollars double, PurchasePrice double, "
                                      "PODate date, ReceivingDate date, Brand int, Description string")
    vendors = {r.VendorNumber: r for r in ops.purchase_metrics(df).collect()}
    assert (vendors[None].VendorName, vendors[None].TotalPOs, vendors[None].TotalSpendDollars, vendors[None].AvgPurchaseUnitPrice) == ("N", 1, 2.5, 2.5)
    assert (vendors[1].VendorName, vendors[1].TotalPOs, vendors[1].TotalPurchaseRecords, vendors[1].AvgLeadTimeDays) == ("A", 1, 2, 2.0)
    months = {r.YearMonth: r for r in ops.monthly_trends(df, "1998-01-01", "1998-12-31").collect()}
    assert (months["1998-01"].ActiveVendors, months["1998-01"].MonthlySpendDollars, months["1998-01"].MonthlyAvgLeadTime) == (1, 5.5, 2.0)
    assert (months["1998-02"].ActiveVendors, months["1998-02"].MonthlySpendDollars) == (0, None)
    brands = {r.Brand: r for r in ops.brand_summary(df).collect()}
    assert (brands[7].Description, brands[7].VendorName, brands[7].TotalSpendDollars) == ("y", "B", 8.5) and None in brands
    assert ops.purchase_metrics(df.limit(0)).count() == ops.brand_summary(df.limit(0)).count() == 0


# ---------------------------------------------------------------- loads
def test_loads_merge_to_the_bits_of_one(spark, tmpdir_path):
    v = fixture_views(spark, SF_SMALL)
    one, three = os.path.join(tmpdir_path, "one"), os.path.join(tmpdir_path, "three")
    incremental.store_load(one, "all", v["purchases"], v["vendor_invoice"], v["sales"], FROM, TO)
    part = lambda df, i: df.where(F.pmod(F.xxhash64(*df.columns), F.lit(3)) == i)
    for i in (2, 0, 1):
        incremental.store_load(three, f"day-{i}", *[part(v[n], i) for n in ("purchases", "vendor_invoice", "sales")], FROM, TO)
    # A load that is stored again counts once.
    incremental.store_load(three, "day-0", *[part(v[n], 0) for n in ("purchases", "vendor_invoice", "sales")], FROM, TO)
    assert incremental.loads(spark, three) == ["day-0", "day-1", "day-2"]
    rest = (v["begin_inventory"], v["end_inventory"], v["purchase_prices"])
    assert rows(incremental.scorecard(spark, three, *rest)) == rows(incremental.scorecard(spark, one, *rest)) == rows(ops.vendor_summary_from(v))
    a, b = incremental.tables(spark, three, 20), incremental.tables(spark, one, 20)
    assert all(rows(a[k]) == rows(b[k]) for k in a)
    assert rows(a["monthly_trends"]) == rows(ops.monthly_trends(v["purchases"], FROM, TO))
    with pytest.raises(FileNotFoundError):
        incremental.scorecard(spark, os.path.join(tmpdir_path, "none"), *rest)


# ---------------------------------------------------------------- versions
def test_a_broken_write_leaves_the_old_table(spark, tmpdir_path):
    write_tables({"t": spark.range(10)}, tmpdir_path)
    broken = spark.range(100, 200, 1, 4).withColumn("id", F.when(F.col("id") > 180, F.raise_error(F.lit("lost")).cast("long")).otherwise(F.col("id")))
    with pytest.raises(Exception, match="lost"):
        write_tables({"t": broken}, tmpdir_path)
    # Files of the broken version may lie there; no reader sees them.
    assert read_table(spark, tmpdir_path, "t").count() == 10
    write_tables({"t": spark.range(7)}, tmpdir_path)
    assert read_table(spark, tmpdir_path, "t").count() == 7


def test_old_versions_are_removed_after_the_next_but_one(spark, tmpdir_path):
    table = os.path.join(tmpdir_path, "t")
    write_tables({"t": spark.range(3)}, tmpdir_path)
    early = read_table(spark, tmpdir_path, "t")
    write_tables({"t": spark.range(4)}, tmpdir_path)
    assert early.count() == 3  # planned on the previous version
    write_tables({"t": spark.range(5)}, tmpdir_path)
    assert read_table(spark, tmpdir_path, "t").count() == 5
    assert len(versions.committed(spark, table)) == 2 and len([n for n in os.listdir(table) if n.startswith("v")]) == 2
    spark.range(2).write.parquet(os.path.join(tmpdir_path, "plain"))
    assert read_table(spark, tmpdir_path, "plain").count() == 2  # a table without versions


def test_an_artifact_without_its_commit_is_not_loaded(spark, tmpdir_path):
    save_models({}, spark.range(1), tmpdir_path)
    version = versions.committed(spark, tmpdir_path)[0]
    with pytest.raises(FileNotFoundError, match=version):
        load_models(spark, tmpdir_path)
    save_models({}, None, tmpdir_path)
    at = versions.current(spark, tmpdir_path)
    assert at.endswith(versions.committed(spark, tmpdir_path)[-1])
    spark.createDataFrame([(["cls"], ["other"], False)], "models array<string>, features array<string>, metrics boolean") \
        .write.mode("overwrite").json(os.path.join(at, "manifest"))
    with pytest.raises(ValueError, match="other"):
        load_models(spark, tmpdir_path)
