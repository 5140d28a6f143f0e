"""Hand-made cases of FIXTURES.md §3 on the scorecard, summaries, directory and scoring."""

import datetime as dt

from pyspark.sql import functions as F

from supplyscope import operators as ops
from supplyscope import schemas
from supplyscope.plans.scoring import score_orders
from supplyscope.plans.training import training_features

D0 = dt.date(2024, 3, 1)


def p(vendor, po, dollars=100.0, lead=3, name=None, brand=1, qty=10.0, price=10.0, po_date=D0):
    rec = None if lead is None else po_date + dt.timedelta(days=lead)
    return (vendor, name or f"V{vendor}", po, brand, f"B{brand}", 1, 1, qty, dollars, price,
            po_date, rec)


def sources(spark, purchases, invoice=(), sales=(), begin=(), end=(), prices=()):
    mk = lambda rows, schema: spark.createDataFrame(list(rows), schema)
    return {
        "purchases": mk(purchases, schemas.PURCHASES),
        "vendor_invoice": mk(invoice, schemas.VENDOR_INVOICE),
        "sales": mk(sales, schemas.SALES),
        "begin_inventory": mk(begin, schemas.INVENTORY),
        "end_inventory": mk(end, schemas.INVENTORY),
        "purchase_prices": mk(prices, schemas.PURCHASE_PRICES),
    }


def rows_by_vendor(df):
    return {r.VendorNumber: r for r in df.collect()}


def test_null_spend_scores_missing_and_sorts_last(spark):
    src = sources(spark, [p(1, 10, dollars=None), p(2, 20, dollars=500.0)])
    vs = ops.vendor_summary_from(src)
    out = vs.collect()
    assert [r.VendorNumber for r in out] == [2, 1]
    assert out[1].TotalSpendDollars is None and out[1].VPIScore is None
    assert out[1].VendorTier == "Tier 4: High Risk"


def test_null_vendor_key_matches_across_inputs(spark):  # T9
    src = sources(spark, [p(None, 10), p(1, 11)],
                  sales=[(None, 2.0, 300.0, 150.0, 1.0), (1, 1.0, 50.0, 50.0, 0.5)])
    got = rows_by_vendor(ops.vendor_summary_from(src))
    assert got[None].TotalSalesDollars == 300.0
    assert got[1].TotalSalesDollars == 50.0


def test_inventory_null_brand_dropped_and_fan_out_kept(spark):  # T18
    begin = [(1, 10, 2.0), (None, 99, 1.0), (2, 5, 1.0)]
    prices = [(1, 7), (1, 8), (2, 7), (2, 7)]
    inv = rows_by_vendor(ops.inventory_metrics(
        spark.createDataFrame(begin, schemas.INVENTORY),
        spark.createDataFrame(prices, schemas.PURCHASE_PRICES), "Begin"))
    assert inv[7].BeginInventoryUnits == 10 + 5 + 5 and inv[7].BeginInventoryValue == 30.0
    assert inv[8].BeginInventoryUnits == 10 and inv[8].BeginInventoryValue == 20.0
    assert set(inv) == {7, 8}


def test_single_purchase_fills_std_and_zero_guards(spark):  # T8
    src = sources(spark, [p(1, 10, dollars=0.0)])
    r = ops.vendor_summary_from(src).first()
    assert r.StdLeadTimeDays == 0.0
    assert (r.GrossMarginPct, r.FreightRatioPct, r.InventoryTurnoverRatio,
            r.DaysSalesOfInventory) == (0.0, 0.0, 0.0, 999.0)


def test_receipt_filter_and_late_rate(spark):  # P1, A1b
    src = sources(spark, [p(1, 10, lead=10), p(1, 11, lead=11), p(1, 11, lead=None)])
    r = ops.purchase_metrics(src["purchases"]).first()
    assert (r.TotalPurchaseRecords, r.TotalPOs, r.LateDeliveriesCount) == (2, 2, 1)
    assert r.LateDeliveryRate == 50.0 and r.AvgLeadTimeDays == 10.5


def test_lead_time_bin_edges(spark):  # A10
    src = sources(spark, [p(v, v, lead=lt) for v, lt in [(1, 5), (2, 8), (3, 10), (4, 12), (5, 13)]])
    vs = ops.vendor_summary_from(src)
    hist = {r.LeadTimeBin: r.VendorCount for r in ops.lead_time_histogram(vs).collect()}
    assert hist == {"1-5 Days": 1, "6-8 Days": 1, "9-12 Days": 2, "13+ Days": 1}
    late = rows_by_vendor(vs)
    assert late[3].LateDeliveriesCount == 0 and late[4].LateDeliveriesCount == 1


def test_tier_thresholds_and_counts(spark):
    df = spark.createDataFrame([(80.0,), (79.9,), (68.0,), (55.0,), (54.9,), (None,)], "s double")
    tiers = [r.t for r in df.select(ops.vendor_tier("s").alias("t")).collect()]
    assert tiers == ["Tier 1: Strategic", "Tier 2: Preferred", "Tier 2: Preferred",
                     "Tier 3: Moderate Risk", "Tier 4: High Risk", "Tier 4: High Risk"]
    vs = df.select(ops.vendor_tier("s").alias("VendorTier"))
    counts = [(r.VendorTier, r.VendorCount) for r in ops.tier_counts(vs).collect()]
    assert counts[0] == ("Tier 2: Preferred", 2) and counts[1] == ("Tier 4: High Risk", 2)


def test_exec_summary_identities(spark):
    src = sources(spark, [p(1, 10, dollars=100.0), p(2, 20, dollars=300.0)],
                  sales=[(1, 1.0, 150.0, 150.0, 0.0), (2, 1.0, 250.0, 250.0, 0.0)],
                  invoice=[(1, D0, D0, 100.0, 4.0)])
    s = ops.exec_summary(ops.vendor_summary_from(src)).first()
    assert s.total_vendors == 2 and s.total_spend == 400.0 and s.total_sales == 400.0
    assert s.gross_profit == 0.0 and s.overall_margin_pct == 0.0
    assert s.overall_freight_ratio == 1.0
    assert sum(s.tier_counts.values()) == 2


def test_directory_filters_and_sorts(spark):
    src = sources(spark, [p(1, 10, dollars=100.0, lead=9, name="Acme (North)"),
                          p(2, 20, dollars=300.0, lead=2, name="Beta"),
                          p(12, 30, dollars=200.0, lead=5, name="Gamma")])
    vs = ops.vendor_summary_from(src)
    by_lead = [r.VendorNumber for r in ops.vendor_directory(vs, sort_by="AvgLeadTimeDays").collect()]
    assert by_lead == [2, 12, 1]
    unknown = [r.VendorNumber for r in ops.vendor_directory(vs, sort_by="Nope").collect()]
    assert unknown == [2, 12, 1]  # spend order
    found = [r.VendorNumber for r in ops.search_vendors(vs, " (north", literal=True).collect()]
    assert found == [1]
    assert sorted(r.VendorNumber for r in ops.search_vendors(vs, "2").collect()) == [2, 12]
    assert ops.vendor_detail(vs, 999).count() == 0
    assert ops.vendor_directory(vs, limit=2).count() == 2


def test_top_brands_per_vendor_matches_single_vendor(spark):
    rows = [p(1, i, dollars=float(100 + i), brand=i) for i in range(15)] + \
           [p(2, 100 + i, dollars=float(50 + i), brand=100 + i) for i in range(3)]
    brands = ops.brand_summary(spark.createDataFrame(rows, schemas.PURCHASES))
    per = ops.top_brands_per_vendor(brands, 10)
    for v in (1, 2):
        a = [r.Brand for r in per.filter(F.col("VendorNumber") == v).orderBy("BrandRank").collect()]
        b = [r.Brand for r in ops.vendor_top_brands(brands, v, 10).collect()]
        assert a == b
    assert per.filter(F.col("VendorNumber") == 1).count() == 10


def test_training_filter_edges_and_unknown_vendor_defaults(spark):
    src = sources(spark, [p(1, 1, lead=-1), p(1, 2, lead=0), p(1, 3, lead=60), p(1, 4, lead=61),
                          p(2, 5, lead=11)])
    vs = ops.vendor_summary_from(src).filter(F.col("VendorNumber") == 1)
    purchases = src["purchases"].withColumn("LineNumber", F.lit(1))
    feats = training_features(purchases, vs, n=100)
    got = {r.PONumber: r for r in feats.collect()}
    assert sorted(got) == [2, 3, 5]
    assert (got[5].AvgLeadTimeDays, got[5].LateDeliveryRate, got[5].VPIScore) == (7.5, 5.0, 70.0)
    assert got[5].IsDelayed == 1 and got[2].IsDelayed == 0


def test_rule_scoring_defaults_and_risk(spark):
    src = sources(spark, [p(1, 1, lead=3), p(1, 2, lead=13)])
    vs = ops.vendor_summary_from(src)
    orders = spark.createDataFrame([(1, None, None, 100.0, 10.0, None, 6, 2),
                                    (777, None, None, None, None, None, None, None)],
                                   schemas.ORDERS_TO_SCORE)
    out = {r.vendor_number: r for r in score_orders(orders, vs).collect()}
    known, unknown = out[1], out[777]
    assert known.predicted_lead_time_days == 8.0  # 8.0 + 0.01 → 8.0
    assert known.delay_probability_pct == min(95.0, 50.0 + 24.0)
    assert known.risk_level == "HIGH RISK" and known.total_dollars == 1000.0
    assert unknown.predicted_lead_time_days == 7.5 and unknown.vendor_historical_avg_lt == 7.5
    assert unknown.delay_probability_pct == 27.5 and unknown.risk_level == "LOW RISK"
    assert unknown.total_dollars == 1500.0 and unknown.quantity == 100.0


def test_combined_inventory_equals_separate(spark):
    begin = [(1, 10, 2.0), (2, 5, 1.5), (3, 1, 9.99), (None, 4, 1.0)]
    end = [(1, 3, 2.0), (4, 7, 0.25), (4, 1, 0.25)]
    prices = [(1, 7), (1, 8), (2, 7), (3, 9), (4, 9), (4, 9)]
    mk = lambda rows, schema: spark.createDataFrame(rows, schema)
    b, e = mk(begin, schemas.INVENTORY), mk(end, schemas.INVENTORY)
    pp = mk(prices, schemas.PURCHASE_PRICES)
    both = rows_by_vendor(ops.inventory_metrics_both(b, e, pp))
    sb = rows_by_vendor(ops.inventory_metrics(b, pp, "Begin"))
    se = rows_by_vendor(ops.inventory_metrics(e, pp, "End"))
    assert set(both) == set(sb) | set(se)
    for v, r in both.items():
        assert (r.BeginInventoryUnits, r.BeginInventoryValue) == (
            (sb[v].BeginInventoryUnits, sb[v].BeginInventoryValue) if v in sb else (None, None))
        assert (r.EndInventoryUnits, r.EndInventoryValue) == (
            (se[v].EndInventoryUnits, se[v].EndInventoryValue) if v in se else (None, None))
