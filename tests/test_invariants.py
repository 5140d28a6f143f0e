"""Output invariants on the stand-in data and exactness of money sums."""

from decimal import Decimal

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from supplyscope import operators as ops
from supplyscope.functions import exact_sum
from supplyscope.sources import fixture_views
from conftest import SF_MID


@pytest.fixture(scope="module")
def vs(spark):
    return ops.vendor_summary_from(fixture_views(spark, SF_MID)).cache()


def test_summary_identities(spark, vs):
    s = ops.exec_summary(vs).first()
    assert s.total_vendors == vs.count() == sum(s.tier_counts.values())
    assert abs(s.gross_profit - (s.total_sales - s.total_spend)) < 1e-6
    assert abs(s.overall_margin_pct - s.gross_profit / s.total_sales * 100) < 1e-9
    assert abs(s.overall_freight_ratio - s.total_freight / s.total_spend * 100) < 1e-9


def test_histogram_and_tiers_cover_every_vendor(vs):
    n = vs.count()
    assert sum(r.VendorCount for r in ops.lead_time_histogram(vs).collect()) == n
    assert sum(r.VendorCount for r in ops.tier_counts(vs).collect()) == n


def test_scores_bounded_and_tier_agrees(vs):
    bad = vs.filter((F.col("VPIScore") < 0) | (F.col("VPIScore") > 100)).count()
    assert bad == 0
    mismatch = vs.filter(ops.vendor_tier("VPIScore") != F.col("VendorTier")).count()
    assert mismatch == 0


def test_one_row_per_purchasing_vendor(spark, vs):
    v = fixture_views(spark, SF_MID)
    vendors = (v["purchases"].filter(F.col("ReceivingDate").isNotNull())
               .select("VendorNumber").distinct().count())
    assert vs.count() == vendors == vs.select("VendorNumber").distinct().count()


def test_sorted_by_spend(vs):
    spends = [r.TotalSpendDollars for r in vs.select("TotalSpendDollars").collect()]
    assert spends == sorted(spends, reverse=True)


@settings(max_examples=25, deadline=None)
@given(st.lists(st.integers(min_value=-10**9, max_value=10**9), min_size=1, max_size=40))
def test_exact_sum_equals_decimal_sum(spark, cents):
    vals = [c / 100 for c in cents]
    got = spark.createDataFrame([(x,) for x in vals], "x double").repartition(3) \
        .agg(exact_sum("x").alias("s")).first().s
    want = float(sum(Decimal(c) / 100 for c in cents))
    assert got == want
