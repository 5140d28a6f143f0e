"""Per-vendor, per-month and per-brand aggregates.

Line-level inputs are read in one pass and added up by hash aggregates with a map-side combine
(``states``), so the shuffle carries one row per (task, group) even when one vendor holds a third of
all rows.  Money sums are exact (``money_parts``: integer sums), so results do not depend on task order.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import MONEY_PARTS, combine_money, money_parts, safe_ratio
from ..session import materialize
from . import states


def with_late_rate(vendors: DataFrame) -> DataFrame:
    """Late deliveries in percent of the counted lines."""
    return vendors.withColumn("LateDeliveryRate", safe_ratio("LateDeliveriesCount", "TotalPurchaseRecords", 100.0))


def _as_in(lines: DataFrame, table: DataFrame, *keys: str) -> DataFrame:
    """States hold keys as longs; give them the type that they have in the lines."""
    return table.withColumns({k: F.col(k).cast(lines.schema[k].dataType) for k in keys})


def purchase_metrics(purchases: DataFrame, orders: bool = True, names: bool = True) -> DataFrame:
    """Purchasing and lead-time metrics per vendor (A1, A1a-c).

    Only lines with both a PO date and a receipt date count (P1).  One pass over the lines adds up the vendors'
    sums, one the bare (vendor, PO) pairs (``order_pairs``).  ``orders`` and ``names``: without TotalPOs or
    VendorName the pairs, or the names as keys, aren't made."""
    held = states.purchase_states(purchases, ["vendor"], names=names)
    if orders:
        held = held.unionByName(states.order_pairs(purchases), allowMissingColumns=True)
    return _as_in(purchases, with_late_rate(states.vendor_table(held, orders, names)), "VendorNumber")


def invoice_metrics(vendor_invoice: DataFrame) -> DataFrame:
    """Freight, invoiced dollars and mean days from invoice to payment per vendor."""
    return states.invoice_table(states.invoice_states(vendor_invoice))


def sales_metrics(sales: DataFrame) -> DataFrame:
    """Units, revenue, mean unit price and excise tax per vendor."""
    return states.sales_table(states.sales_states(sales))


def inventory_metrics(inventory: DataFrame, purchase_prices: DataFrame,
                      prefix: str = "Begin") -> DataFrame:
    """Inventory units and value per vendor through the Brand → vendor price list.

    Same result as ``inventory JOIN purchase_prices USING (Brand) GROUP BY VendorNumber``
    including the fan-out of a Brand listed several times, but both sides are first reduced
    to one row per Brand (resp. per Brand and vendor).  The join then never multiplies raw
    rows, and a Brand that holds many inventory rows (one per store) is not a hot key."""
    parts = money_parts(F.col("onHand") * F.col("Price"))
    inv = (inventory.filter(F.col("Brand").isNotNull())
           .groupBy("Brand")
           .agg(F.sum("onHand").alias("_units"),
                *[F.sum(p).alias(f"_v{i}") for i, p in enumerate(parts)]))
    links = (purchase_prices.filter(F.col("Brand").isNotNull())
             .groupBy("Brand", "VendorNumber")
             .agg(F.count(F.lit(1)).alias("_links")))
    units, value = f"{prefix}InventoryUnits", f"{prefix}InventoryValue"
    return (inv.join(links, "Brand", "inner")
            .groupBy("VendorNumber")
            .agg(F.sum(F.col("_units") * F.col("_links")).cast("double").alias(units),
                 combine_money([F.sum(F.col(f"_v{i}") * F.col("_links")) for i in range(len(MONEY_PARTS))])
                 .alias(value)))


def inventory_metrics_both(begin_inventory: DataFrame, end_inventory: DataFrame,
                           purchase_prices: DataFrame) -> DataFrame:
    """Opening and closing inventory per vendor in one pass (A4 and A5 together).

    Equal to ``inventory_metrics`` run twice, but the two snapshots are stacked and reduced
    per Brand together, so the price list is scanned, reduced and joined once.  A snapshot a
    Brand is absent from contributes missing (not zero) sums, as a missing join row would."""
    def side(df: DataFrame, tag: str) -> DataFrame:
        parts = money_parts(F.col("onHand") * F.col("Price"))
        cols = {f"_{t}{k}": F.lit(None).cast("long") for t in ("b", "e") for k in ["u", *range(len(MONEY_PARTS))]}
        cols[f"_{tag}u"] = F.col("onHand").cast("long")
        cols.update({f"_{tag}{i}": p for i, p in enumerate(parts)})
        return df.filter(F.col("Brand").isNotNull()).select("Brand", *[v.alias(k) for k, v in
                                                                        cols.items()])
    stacked = side(begin_inventory, "b").unionByName(side(end_inventory, "e"))
    inv = stacked.groupBy("Brand").agg(*[F.sum(c).alias(c) for c in stacked.columns[1:]])
    links = (purchase_prices.filter(F.col("Brand").isNotNull())
             .groupBy("Brand", "VendorNumber")
             .agg(F.count(F.lit(1)).alias("_links")))
    per = lambda c: F.sum(F.col(c) * F.col("_links"))
    return (inv.join(links, "Brand", "inner")
            .groupBy("VendorNumber")
            .agg(per("_bu").cast("double").alias("BeginInventoryUnits"),
                 combine_money([per(f"_b{i}") for i in range(len(MONEY_PARTS))]).alias("BeginInventoryValue"),
                 per("_eu").cast("double").alias("EndInventoryUnits"),
                 combine_money([per(f"_e{i}") for i in range(len(MONEY_PARTS))]).alias("EndInventoryValue")))


def monthly_trends(purchases: DataFrame, date_from: str | dt.date = "2024-01-01",
                   date_to: str | dt.date = "2024-12-31") -> DataFrame:
    """Active vendors, units, spend and mean lead time per ``YYYY-MM`` in an inclusive date
    window, in month order (A6, P3, L6).  Lines without a receipt still count, except in the
    mean lead time."""
    return states.month_table(states.purchase_states(purchases, ["month", "active"], date_from, date_to))


def brand_summary(purchases: DataFrame) -> DataFrame:
    """Per-Brand description, vendor name and number (independent maxima), units, spend and
    mean price over all lines (A7).

    Two aggregation levels, no join: first per (Brand, Description, VendorName) with mergeable sums
    (hash aggregate, map-side combine), then per Brand, where the string maxima, which Spark can only
    aggregate by sorting, see one row per distinct combination instead of every line."""
    return _as_in(purchases, states.brand_table(states.purchase_states(purchases, ["brand"])), "Brand", "VendorNumber")


def purchase_tables(purchases: DataFrame, date_from: str | dt.date = "2024-01-01",
                    date_to: str | dt.date = "2024-12-31", top: int = 100) -> dict[str, DataFrame]:
    """Purchase metrics, monthly trends and top brands (A1, A6, A7, L5) from one scan of the purchases.

    The states of all grains are stored once in the shared checkpoint folder; the three tables
    are read from there."""
    held = materialize(states.purchase_states(purchases, list(states.GRAINS), date_from, date_to), "purchase-states")
    return tables_of(held, top)


def tables_of(held: DataFrame, top: int = 100) -> dict[str, DataFrame]:
    """The three tables of (stored, perhaps merged) purchase states."""
    return {"purchase_metrics": with_late_rate(states.vendor_table(held)), "monthly_trends": states.month_table(held),
            "top_brands": top_brands(states.brand_table(held), top)}


def top_brands(purchases_or_brands: DataFrame, k: int = 100) -> DataFrame:
    """The ``k`` brands with the highest spend (L5).  Ties break on Brand; missing spend last.

    ``orderBy().limit()`` plans as a per-task top-k plus one merge of at most
    ``k × tasks`` rows, never a full sort."""
    df = purchases_or_brands
    if "Brand" in df.columns and "TotalPurchasedUnits" not in df.columns:
        df = brand_summary(df)
    return (df.orderBy(F.col("TotalSpendDollars").desc_nulls_last(),
                       F.col("Brand").asc_nulls_last())
            .limit(k))
