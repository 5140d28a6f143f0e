"""Exact cuts, exact sums, inputs by name, missing values, plans of the vendor lookup, model loading."""

import os
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from supplyscope import operators as ops
from supplyscope.functions import exact_avg, exact_sum, fixed
from supplyscope.plans.scoring import main as scoring_main, score_orders
from supplyscope.plans.training import load_models, predict, train_models, training_features
from supplyscope.sources import fixture_views, load_sources, read_orders
from conftest import SF_MID, SF_SMALL

INPUTS = ["purchases", "vendor_invoice", "sales", "begin_inventory", "end_inventory", "purchase_prices"]


# ---------------------------------------------------------------- sampling with ties
@pytest.mark.parametrize("n", [1, 10, 999])
def test_sample_of_one_key(spark, n):
    df = spark.createDataFrame([(1, i) for i in range(1000)], "k long, v long").repartition(5)
    got = ops.sample_n(df, n, ["k"]).collect()
    assert len(got) == n and len({r.v for r in got}) == n


@pytest.mark.parametrize("n", [101, 500, 501, 2999])
def test_sample_with_every_key_twice(spark, n):
    df = spark.createDataFrame([(i, c) for i in range(1500) for c in "ab"], "k long, c string")
    got = ops.sample_n(df.repartition(7), n, ["k"]).collect()
    again = ops.sample_n(df.repartition(2), n, ["k"]).collect()
    assert len(got) == n and sorted(got) == sorted(again)
    assert sum(v == 1 for v in Counter(r.k for r in got).values()) == n % 2


@pytest.mark.parametrize("n", [1, 7, 350, 699])
def test_sample_of_equal_rows(spark, n):
    df = spark.createDataFrame([(1, None, "x")] * 400 + [(1, None, "y")] * 300, "k long, m long, t string")
    got = ops.sample_n(df, n, ["k"])
    assert got.columns == df.columns and got.count() == n
    assert got.where("t IN ('x', 'y') AND k = 1 AND m IS NULL").count() == n


def test_sample_of_none_and_all(spark):
    df = spark.createDataFrame([(i,) for i in range(30)], "k long")
    assert ops.sample_n(df, 0, ["k"]).count() == 0
    assert ops.sample_n(df, None, ["k"]).count() == ops.sample_n(df, 30, ["k"]).count() == 30
    assert ops.sample_n(df.limit(0), 5, ["k"]).count() == 0


# ---------------------------------------------------------------- sums
def total(spark, values, fn=exact_sum):
    return spark.createDataFrame([(v,) for v in values], "x double").repartition(3).agg(fn("x").alias("s")).first().s


def test_exact_sum_keeps_small_digits(spark):
    assert total(spark, [1e-7] * 1000) == pytest.approx(1e-4, rel=1e-12)
    assert total(spark, [0.123456789, 1.0]) == pytest.approx(1.123456789, abs=1e-15)
    assert total(spark, [1e12 + 0.25, -1e12]) == 0.25
    assert total(spark, [12345.67] * 3 + [-0.01]) == 37037.0


def test_exact_sum_takes_nan_for_missing(spark):
    assert total(spark, [1.5, float("nan"), None]) == 1.5
    assert total(spark, [float("nan")]) is None
    assert total(spark, [1.5, float("nan"), 2.5], exact_avg) == 2.0


def test_exact_sum_equals_decimals(spark):
    rnd = random.Random(3)
    cents = [rnd.randrange(-10**9, 10**9) for _ in range(5000)]
    assert total(spark, [c / 100 for c in cents]) == sum(cents) / 100


def test_fixed_keeps_missing(spark):
    rows = spark.createDataFrame([(None,), (float("nan"),), (2.25,)], "x double").select(fixed("x", 1).alias("r")).collect()
    assert [r.r for r in rows] == [None, None, "2.3"]


# ---------------------------------------------------------------- inputs by name
def write_inputs(spark, path, change=lambda name, df: df):
    views = fixture_views(spark, SF_SMALL)
    for n in INPUTS:
        df = views[n].drop("LineNumber") if n == "purchases" else views[n]
        change(n, df).write.mode("overwrite").option("header", True).csv(os.path.join(path, f"{n}.csv"))


def same(a, b):
    drop = ["StdLeadTimeDays", "AvgSalesUnitPrice"]
    return a.drop(*drop).exceptAll(b.drop(*drop)).count() == 0 == b.drop(*drop).exceptAll(a.drop(*drop)).count()


def test_columns_are_found_by_name(spark, tmpdir_path):
    def shuffled(name, df):
        cols = list(reversed(df.columns))
        return df.select(cols[0], F.lit("extra").alias("Unused"), *cols[1:])
    write_inputs(spark, tmpdir_path, shuffled)
    src = load_sources(spark, tmpdir_path, register_views=False)
    want = {n: (v.drop("LineNumber") if n == "purchases" else v) for n, v in fixture_views(spark, SF_SMALL).items()}
    assert same(ops.vendor_summary_from(src), ops.vendor_summary_from(want))


def test_an_absent_column_is_named(spark, tmpdir_path):
    write_inputs(spark, tmpdir_path, lambda n, df: df.drop("Freight") if n == "vendor_invoice" else df)
    with pytest.raises(ValueError, match="Freight"):
        load_sources(spark, tmpdir_path, register_views=False)


def test_a_bad_value_fails(spark, tmpdir_path):
    write_inputs(spark, tmpdir_path, lambda n, df: df.withColumn("Price", F.lit("n/a")) if n == "begin_inventory" else df)
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        load_sources(spark, tmpdir_path, register_views=False)["begin_inventory"].collect()


def test_nan_inputs_are_missing(spark, tmpdir_path):
    money = {"purchases": "Dollars", "vendor_invoice": "Freight", "sales": "SalesDollars", "end_inventory": "Price"}
    key = {"purchases": "VendorNumber", "vendor_invoice": "VendorNumber", "sales": "VendorNo", "end_inventory": "Brand"}

    def holes(value):
        def change(n, df):
            return df.withColumn(money[n], F.when(F.col(key[n]) == 3, F.lit(value)).otherwise(F.col(money[n]))) if n in money else df
        return change
    a, b = os.path.join(tmpdir_path, "nan"), os.path.join(tmpdir_path, "null")
    write_inputs(spark, a, holes(float("nan")))
    write_inputs(spark, b, holes(None))
    assert same(ops.vendor_summary_from(load_sources(spark, a, register_views=False)),
                ops.vendor_summary_from(load_sources(spark, b, register_views=False)))


def test_empty_summary_sums_to_zero(spark):
    vs = ops.vendor_summary_from(fixture_views(spark, SF_SMALL), sort=False).limit(0)
    s = ops.exec_summary(vs).first()
    assert (s.total_vendors, s.total_spend, s.total_sales, s.gross_profit, s.total_freight) == (0, 0.0, 0.0, 0.0, 0.0)


# ---------------------------------------------------------------- plans
def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def scans(df, column: str) -> int:
    return len(re.findall(rf"FileScan parquet \[[^\]]*\b{column}", plan(df)))


def test_purchases_are_scanned_once(spark):
    v = fixture_views(spark, SF_SMALL)
    assert scans(ops.purchase_metrics(v["purchases"]), "l_orderkey") == 1
    vs = ops.vendor_summary_from(v, sort=False)
    assert scans(vs, "l_suppkey") <= 3  # purchases, the invoice stand-in, sales


def test_the_vendor_lookup_moves_neither_orders_nor_lines(spark):
    v = fixture_views(spark, SF_SMALL)
    vs = ops.vendor_summary_from(v, sort=False)
    scored = plan(score_orders(v["orders_to_score"], vs, None))
    assert "hashpartitioning(vendor_number" not in scored and "BroadcastHashJoin" in scored
    lines = plan(training_features(v["purchases"], vs, 500))
    assert "hashpartitioning(VendorNumber" not in lines and "BroadcastHashJoin" in lines


# ---------------------------------------------------------------- scoring and models
def test_orders_may_lack_columns(spark, tmpdir_path):
    vs = ops.vendor_summary_from(fixture_views(spark, SF_SMALL), sort=False)
    path = os.path.join(tmpdir_path, "orders.csv")
    with open(path, "w") as f:
        f.write("vendor_number,quantity\n3,5\n,\n")
    scored = {r.vendor_number: r for r in score_orders(read_orders(spark, path), vs).collect()}
    assert (scored[3].store, scored[3].quantity, scored[3].total_dollars) == (1, 5.0, 75.0)
    assert (scored[12546].quantity, scored[12546].total_dollars) == (100.0, 1500.0)
    bare = score_orders(spark.createDataFrame([(3,)], "vendor_number long"), vs).first()
    assert (bare.store, bare.quantity, bare.total_dollars) == (1, 100.0, 1500.0)


def test_absent_models_raise(spark, tmpdir_path):
    with pytest.raises(FileNotFoundError, match="reg"):
        load_models(spark, os.path.join(tmpdir_path, "nowhere"))
    vs = ops.vendor_summary_from(fixture_views(spark, SF_SMALL), sort=False)
    orders = fixture_views(spark, SF_SMALL)["orders_to_score"]
    for models in ({}, {"reg": None}):
        with pytest.raises(ValueError, match="cls"):
            score_orders(orders, vs, models)
    vs.write.parquet(os.path.join(tmpdir_path, "results", "vendor_summary"))
    orders.write.parquet(os.path.join(tmpdir_path, "orders"))
    with pytest.raises(FileNotFoundError):
        scoring_main([os.path.join(tmpdir_path, "orders"), os.path.join(tmpdir_path, "results"),
                      os.path.join(tmpdir_path, "out"), "--models", "/nowhere", "--format", "parquet"])


def test_models_beat_the_mean_and_the_majority(spark):  # G5, G6
    v = fixture_views(spark, SF_MID)
    vs = ops.vendor_summary_from(v, sort=False)
    models, metrics = train_models(v["purchases"], vs, n=5000, max_iter=20, test_all=True)
    m = metrics.first()
    keys = ["PONumber", "LineNumber", "Brand", "VendorNumber"]
    _, held = ops.train_test_split(training_features(v["purchases"], vs, None, keys), keys, 7)
    majority = held.agg(F.avg("IsDelayed")).first()[0]
    assert m.test_rows == held.count() > 10_000  # every held-out line, not those of the sample alone
    assert m.r2 > 0.3 and m.accuracy > max(majority, 1 - majority) + 0.02
    assert predict(models, held).where("pred_days IS NULL OR pred_delay IS NULL").count() == 0
