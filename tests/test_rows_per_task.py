"""What a task holds doesn't grow with the tables: lines meet their orders in tasks of a bounded number of rows."""

import datetime as dt
import re

import pytest
from pyspark.sql import functions as F

from supplyscope import operators as ops
from supplyscope import session
from supplyscope.sources import fixture_views

ORDERS, LINES_EACH = 3_000, 3


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Orders of three lines each; the first order is there twice, one line has no order and one no supplier."""
    at = str(tmp_path_factory.mktemp("tables"))
    day = dt.datetime(2024, 1, 1)
    orders = [(k, k % 50, day + dt.timedelta(days=k % 300)) for k in [0, *range(ORDERS)]]
    lines = [(k, k % 20, k % 7 if k != 5 else None, n, 2.0 + k % 5, 10.25 + k, 0.1, 0.05)
             for k in [*range(ORDERS), -1] for n in range(LINES_EACH)]
    for name, rows, schema in (
            ("supplier", [(k, f"Supplier {k}") for k in range(7)], "s_suppkey long, s_name string"),
            ("part", [(k, f"part {k}", k, 1.0 + k) for k in range(20)], "p_partkey long, p_name string, p_size int, p_retailprice double"),
            ("orders", orders, "o_orderkey long, o_custkey long, o_orderdate timestamp_ntz"),
            ("lineitem", lines, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, "
                                "l_extendedprice double, l_discount double, l_tax double")):
        spark.createDataFrame(rows, schema).write.parquet(f"{at}/{name}.parquet")
    return at


def most_in_a_task(df):
    return df.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]


@pytest.mark.parametrize("view", ["purchases", "orders_to_score"])
def test_lines_with_orders_in_bounded_tasks(spark, tables, monkeypatch, view):
    monkeypatch.setattr(session, "ROWS_PER_TASK", 500)
    got = fixture_views(spark, tables)[view]
    assert got.count() == (ORDERS + 1) * LINES_EACH - (LINES_EACH if view == "purchases" else 0)
    assert most_in_a_task(got) <= 1_000


def test_invoices_of_stored_purchases_in_bounded_tasks(spark, tables, monkeypatch):
    whole = fixture_views(spark, tables)["purchases"]
    stored = session.materialize(whole, "purchases")
    monkeypatch.setattr(session, "ROWS_PER_TASK", 500)
    got = fixture_views(spark, tables, purchases=stored)["vendor_invoice"]
    assert most_in_a_task(got) <= 500
    rows = lambda df: sorted(tuple(r) for r in df.collect())
    assert rows(got) == rows(fixture_views(spark, tables)["vendor_invoice"])


def test_pairs_of_vendor_and_po_are_told_apart_without_measures(spark, tmp_path):
    """A pair is two numbers in the aggregate that finds the distinct ones, not as wide as a vendor's sums."""
    day = dt.date(2024, 1, 1)
    at = str(tmp_path / "purchases")
    #       vendor, name, PO, receipt: a pair twice, under two names, without receipt, without PO, without vendor
    rows = [(1, "a", 10, day), (1, "a", 10, day), (1, "b", 10, day), (1, "a", 11, None), (1, "a", None, day), (1, "a", 12, day),
            (2, "c", None, day), (2, "c", 10, None), (None, "d", 10, day), (None, "d", 10, day), (3, "e", 10, None)]
    (spark.createDataFrame([(v, n, po, day, r, 1.0, 2.0, 2.0) for v, n, po, r in rows],
                           "VendorNumber long, VendorName string, PONumber long, PODate date, ReceivingDate date, "
                           "Quantity double, Dollars double, PurchasePrice double").write.parquet(at))
    got = ops.purchase_metrics(spark.read.parquet(at))
    found = {r["VendorNumber"]: (r["VendorName"], r["TotalPOs"], r["TotalPurchaseRecords"]) for r in got.collect()}
    assert found == {1: ("b", 2, 5), 2: ("c", 0, 1), None: ("d", 1, 2)}
    aggregates = re.findall(r"HashAggregate\(keys=\[([^\]]*)\], functions=\[([^\]]*)\]", got._jdf.queryExecution().executedPlan().toString())
    by_pair = [measures for keys, measures in aggregates if re.fullmatch(r"k1#\d+L?, k2#\d+L?", keys)]
    assert by_pair and not any(by_pair)
