"""A hot vendor (half of all lines, most brands): results equal a brute-force pandas
computation, and the plan reduces map-side before any shuffle on the vendor key."""

import datetime as dt
import random
from decimal import Decimal

import pandas as pd

from supplyscope import operators as ops
from supplyscope import schemas

D0 = dt.date(2024, 5, 1)


def skewed_rows(n=6000, seed=3):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        v = 1 if rnd.random() < 0.5 else rnd.randint(2, 40)
        b = rnd.randint(1, 300) if v == 1 else rnd.randint(301, 400)
        lead = rnd.randint(0, 20)
        rows.append((v, f"V{v}", i // 3, b, f"B{b}", 1, 1, float(rnd.randint(1, 9)),
                     rnd.randint(100, 99999) / 100, rnd.randint(100, 9999) / 100, D0,
                     D0 + dt.timedelta(days=lead)))
    return rows


def test_hot_vendor_metrics_and_top_k(spark):
    rows = skewed_rows()
    df = spark.createDataFrame(rows, schemas.PURCHASES).repartition(8)
    pm = {r.VendorNumber: r for r in ops.purchase_metrics(df).collect()}
    pdf = pd.DataFrame(rows, columns=schemas.PURCHASES.fieldNames())
    for v, g in pdf.groupby("VendorNumber"):
        r = pm[v]
        assert r.TotalPurchaseRecords == len(g) and r.TotalPOs == g.PONumber.nunique()
        assert r.TotalSpendDollars == float(sum(Decimal(str(x)) for x in g.Dollars))
        assert r.LateDeliveriesCount == int(((g.ReceivingDate - g.PODate).map(lambda d: d.days) > 10).sum())
    brands = ops.brand_summary(df)
    top = ops.top_brands_per_vendor(brands, 5).filter("VendorNumber = 1").orderBy("BrandRank")
    spend = pdf[pdf.VendorNumber == 1].groupby("Brand").Dollars.apply(
        lambda s: float(sum(Decimal(str(x)) for x in s)))
    want = sorted(spend.items(), key=lambda kv: (-kv[1], kv[0]))[:5]
    assert [(r.Brand, r.TotalSpendDollars) for r in top.collect()] == want


def test_vendor_aggregate_is_partial_before_shuffle(spark):
    df = spark.createDataFrame(skewed_rows(600), schemas.PURCHASES)
    p = ops.purchase_metrics(df)._jdf.queryExecution().executedPlan().toString()
    # The first operator above the scan is a map-side (partial) hash aggregate.
    first_exchange = p.rfind("Exchange")
    assert "HashAggregate" in p[first_exchange:]
