"""Mergeable states of the line-level aggregates (A1, A2, A3, A6, A7): one pass over each input.

A line is expanded to one row for each grain that is asked for, with that grain's keys and only the
measures that the grain adds up:

=============  =================================  ====================================================
grain          keys                               measures
=============  =================================  ====================================================
``vendor``     vendor, name                       lines, units, spend, prices, lead times (dated lines)
``order``      vendor, PO                         none (dated lines): distinct POs
``month``      month                              units, spend, lead times (POs of the date window)
``active``     month, vendor                      none (POs of the date window): distinct vendors
``brand``      Brand, Description, vendor name    units, spend, prices, largest vendor number (all lines)
=============  =================================  ====================================================

and one hash aggregate with a map-side combine adds them up.  The bare grains carry keys alone, so the
distinct counts cost two narrow columns in the shuffle, not the sums of every PO.  All measures are
integers (money as ``money_parts``), maxima and minima, so states of several loads merge, in any order,
to the bits that one load of everything has.
"""

from __future__ import annotations

import datetime as dt
import functools
import operator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import MONEY_PARTS, combine_money, days_between, money_parts

LATE_AFTER_DAYS = 10
KEYS = ["grain", "k1", "k2", "s1", "s2"]


def _money(prefix: str) -> list[str]:
    return [prefix + p for p in MONEY_PARTS] + [prefix + "n"]


def _money_columns(column: str | Column, prefix: str) -> dict[str, Column]:
    parts = money_parts(column)
    return dict(zip(_money(prefix), [*parts, parts[0].isNotNull().cast("long")]))


_LEAD = ["ln", "ls", "lss", "lhi", "llo", "late"]
#: Measures of each grain; the keys are k1, k2 (longs) and s1, s2 (strings).
GRAINS = {
    "vendor": ["n", "q", *_money("d"), *_money("p"), *_LEAD],
    "order": [],
    "month": ["q", *_money("d"), *_LEAD],
    "active": [],
    "brand": ["q", *_money("d"), *_money("p"), "vn"],
}
MEASURES = ["n", "q", *_money("d"), *_money("p"), *_LEAD, "vn"]
_MERGE = {"lhi": F.max, "llo": F.min, "vn": F.max}


def merged(states: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """States with the same keys as one; also the way in which several loads become one."""
    measures = [c for c in states.columns if c not in keys]
    return states.groupBy(*keys).agg(*[_MERGE.get(c, F.sum)(c).alias(c) for c in measures])


def purchase_states(purchases: DataFrame, grains: list[str], date_from: str | dt.date | None = None,
                    date_to: str | dt.date | None = None, names: bool = True) -> DataFrame:
    """The states of the purchases for these grains, in one pass (module docstring).

    The date window (inclusive, on the PO date) is that of the monthly grains.  Without ``names`` the vendor
    grain is by vendor alone."""
    lead = days_between("PODate", "ReceivingDate").cast("long")
    po = F.col("PODate").cast("date")
    dated = F.col("PODate").isNotNull() & F.col("ReceivingDate").isNotNull()
    window = po.between(F.lit(date_from).cast("date"), F.lit(date_to).cast("date"))
    columns = {
        "vendor_k": F.col("VendorNumber").cast("long"), "name_k": F.col("VendorName"), "po_k": F.col("PONumber").cast("long"),
        "month_k": (F.year(po) * 12 + F.month(po) - 1).cast("long"), "brand_k": F.col("Brand").cast("long"),
        "text_k": F.col("Description"), "dated": dated, "inside": F.coalesce(window, F.lit(False)), "all": F.lit(True),
        "no_key": F.lit(None).cast("long"), "no_text": F.lit(None).cast("string"),
        "n": F.lit(1).cast("long"), "q": F.col("Quantity").cast("double"), "no_q": F.lit(None).cast("double"),
        **_money_columns("Dollars", "d"), **_money_columns("PurchasePrice", "p"),
        "ln": lead.isNotNull().cast("long"), "ls": lead, "lss": lead * lead, "lhi": lead, "llo": lead,
        "late": (lead > LATE_AFTER_DAYS).cast("long"), "vn": F.col("VendorNumber").cast("long"),
    }
    places = {
        "vendor": ("dated", "vendor_k", "no_key", "name_k" if names else "no_text", "no_text"), "order": ("dated", "vendor_k", "po_k", "no_text", "no_text"),
        "month": ("inside", "month_k", "no_key", "no_text", "no_text"), "active": ("inside", "month_k", "vendor_k", "no_text", "no_text"),
        "brand": ("all", "brand_k", "no_key", "text_k", "name_k"),
    }
    used = [m for m in MEASURES if any(m in GRAINS[g] for g in grains)]
    absent = lambda m: "no_q" if m == "q" else "no_key"
    sets = ", ".join(
        "({}) AS {}".format(", ".join(f"`{c}`" for c in (*places[g], *[m if m in GRAINS[g] else absent(m) for m in used])), g)
        for g in grains)
    needed = {c for g in grains for c in places[g]} | {*used} | {absent(m) for m in used} | {"no_key", "no_text"}
    # A line that no grain takes is left out before it is expanded, and the filter reaches the scan.
    takes = {"dated": dated, "inside": window}
    asked = {places[g][0] for g in grains}
    if "all" not in asked:
        purchases = purchases.where(functools.reduce(operator.or_, [takes[t] for t in sorted(asked)]))
    lines = purchases.select(*[c.alias(n) for n, c in columns.items() if n in needed])
    outputs = ", ".join(f"`_{c}`" for c in ("take", "k1", "k2", "s1", "s2", *used))
    rows = purchases.sparkSession.sql(
        f"SELECT * FROM {{lines}} UNPIVOT INCLUDE NULLS (({outputs}) FOR grain IN ({sets}))", lines=lines)
    rows = rows.where("_take").where("NOT (grain = 'order' AND _k2 IS NULL) AND NOT (grain = 'active' AND _k2 IS NULL)")
    return merged(rows.select("grain", *[F.col(f"_{c}").alias(c) for c in ("k1", "k2", "s1", "s2", *used)]))


def order_pairs(purchases: DataFrame) -> DataFrame:
    """The ``order`` grain by itself: each (vendor, PO) of the dated lines once, without measures.

    In the one pass of ``purchase_states`` a pair is as wide as a vendor's sums, all of them missing: these take
    no room in a shuffle, so its merged partitions hold millions of pairs, but all their room in the memory of
    the aggregate.  Lines that are already dealt by PO meet without a further shuffle."""
    dated = F.col("PODate").isNotNull() & F.col("ReceivingDate").isNotNull()
    pairs = purchases.where(dated).select(F.col("VendorNumber").cast("long").alias("k1"), F.col("PONumber").cast("long").alias("k2"))
    return pairs.where(F.col("k2").isNotNull()).distinct().withColumn("grain", F.lit("order"))


def money_total(prefix: str) -> Column:
    """The sum of a money column from merged states."""
    return combine_money([F.sum(prefix + p) for p in MONEY_PARTS])


def money_mean(prefix: str) -> Column:
    n = F.sum(prefix + "n")
    return F.when(n > 0, money_total(prefix) / n)


def spread(n: Column, total: Column, squares: Column) -> Column:
    """Sample standard deviation from counts and sums of integers; exact up to its last division and root."""
    big = "decimal(38,0)"
    numerator = (n.cast(big) * squares - total.cast(big) * total).cast("double")
    return F.when(n > 1, F.sqrt(numerator / (n * (n - 1.0))))


def vendor_table(states: DataFrame, orders: bool = True, names: bool = True) -> DataFrame:
    """Purchasing and lead-time metrics per vendor from the ``vendor`` and ``order`` grains."""
    wanted = states.where(F.col("grain").isin("vendor", "order") if orders else F.col("grain") == "vendor")
    is_order = (F.col("grain") == "order").cast("long")
    measures = GRAINS["vendor"]
    aggs = [_MERGE.get(c, F.sum)(c).alias(c) for c in measures]
    # Numbers first, in a hash aggregate; the names' maximum sees one row for each name of a vendor.
    by_name = wanted.groupBy("k1", "s1").agg(F.sum(is_order).alias("pos"), *aggs) if names else \
        wanted.groupBy("k1").agg(F.sum(is_order).alias("pos"), *aggs)
    n, s = F.sum("n"), F.sum("ls")
    out = [n.alias("TotalPurchaseRecords"), F.sum("q").alias("TotalUnitsPurchased"),
           money_total("d").alias("TotalSpendDollars"), money_mean("p").alias("AvgPurchaseUnitPrice"),
           (s / n).alias("AvgLeadTimeDays"), F.max("lhi").alias("MaxLeadTimeDays"),
           F.min("llo").alias("MinLeadTimeDays"), spread(n, s, F.sum("lss")).alias("StdLeadTimeDays"),
           F.sum("late").alias("LateDeliveriesCount")]
    if orders:
        out.insert(0, F.sum("pos").alias("TotalPOs"))
    if names:
        out.insert(0, F.max("s1").alias("VendorName"))
    return by_name.groupBy(F.col("k1").alias("VendorNumber")).agg(*out)


def month_table(states: DataFrame) -> DataFrame:
    """Active vendors, units, spend and mean lead time per month, in month order."""
    wanted = states.where(F.col("grain").isin("month", "active"))
    year, month = F.floor(F.col("k1") / 12).cast("int"), (F.col("k1") % 12 + 1).cast("int")
    n = F.sum("ln")
    return (wanted.groupBy("k1").agg(
                F.count_if(F.col("grain") == "active").alias("ActiveVendors"), F.sum("q").alias("MonthlyPurchasedUnits"),
                money_total("d").alias("MonthlySpendDollars"), F.when(n > 0, F.sum("ls") / n).alias("MonthlyAvgLeadTime"))
            .select(F.date_format(F.make_date(year, month, F.lit(1)), "yyyy-MM").alias("YearMonth"), "ActiveVendors",
                    "MonthlyPurchasedUnits", "MonthlySpendDollars", "MonthlyAvgLeadTime")
            .orderBy("YearMonth"))


def brand_table(states: DataFrame) -> DataFrame:
    """Per-Brand texts, units, spend and mean price from the ``brand`` grain."""
    return (states.where("grain = 'brand'").groupBy(F.col("k1").alias("Brand")).agg(
        F.max("s1").alias("Description"), F.max("s2").alias("VendorName"), F.max("vn").alias("VendorNumber"),
        F.sum("q").alias("TotalPurchasedUnits"), money_total("d").alias("TotalSpendDollars"),
        money_mean("p").alias("AvgPurchasePrice")))


# ------------------------------------------------------------------------- invoices and sales
def invoice_states(vendor_invoice: DataFrame) -> DataFrame:
    """Mergeable sums of dated invoices per vendor."""
    days = days_between("InvoiceDate", "PayDate").cast("long")
    lines = (vendor_invoice.where(F.col("InvoiceDate").isNotNull() & F.col("PayDate").isNotNull())
             .select("VendorNumber", *[c.alias(n) for n, c in {**_money_columns("Freight", "f"), **_money_columns("Dollars", "d")}.items()],
                     F.lit(1).cast("long").alias("n"), days.alias("days")))
    return merged(lines, ["VendorNumber"])


def invoice_table(states: DataFrame) -> DataFrame:
    """Freight, invoiced dollars and mean days from invoice to payment per vendor."""
    return states.groupBy("VendorNumber").agg(
        money_total("f").alias("TotalFreightDollars"), money_total("d").alias("TotalInvoiceDollars"),
        (F.sum("days") / F.sum("n")).alias("AvgPaymentLeadTimeDays"))


def sales_states(sales: DataFrame) -> DataFrame:
    """Mergeable sums of sales per vendor."""
    lines = sales.select(F.col("VendorNo").alias("VendorNumber"), F.col("SalesQuantity").cast("double").alias("q"),
                         *[c.alias(n) for n, c in {**_money_columns("SalesDollars", "d"), **_money_columns("SalesPrice", "p"),
                                                   **_money_columns("ExciseTax", "t")}.items()])
    return merged(lines, ["VendorNumber"])


def sales_table(states: DataFrame) -> DataFrame:
    """Units, revenue, mean unit price and excise tax per vendor."""
    return states.groupBy("VendorNumber").agg(
        F.sum("q").alias("TotalUnitsSold"), money_total("d").alias("TotalSalesDollars"),
        money_mean("p").alias("AvgSalesUnitPrice"), money_total("t").alias("TotalExciseTaxDollars"))
