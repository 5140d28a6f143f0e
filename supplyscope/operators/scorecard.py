"""Vendor scorecard (K0-K13) and the summaries built on it.

The five metric tables each hold one row per vendor, so the merge is four joins of small
per-vendor tables; AQE broadcasts them once it has measured their size (the threshold is the
size check) and keeps a sort-merge join beyond it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import clip, exact_sum, floor_at, round1, safe_ratio
from .metrics import (inventory_metrics_both, invoice_metrics, purchase_metrics,
                      sales_metrics)

# Fixed values that must equal the original job ------------------------------------------
# Defaults for vendors missing from a metric table (AvgLeadTimeDays cannot be missing after
# the date filter but keeps its default).
FILL_DEFAULTS = {
    "TotalFreightDollars": 0.0,
    "TotalInvoiceDollars": 0.0,
    "AvgPaymentLeadTimeDays": 0.0,
    "TotalUnitsSold": 0.0,
    "TotalSalesDollars": 0.0,
    "AvgSalesUnitPrice": 0.0,
    "TotalExciseTaxDollars": 0.0,
    "BeginInventoryUnits": 0.0,
    "BeginInventoryValue": 0.0,
    "EndInventoryUnits": 0.0,
    "EndInventoryValue": 0.0,
    "StdLeadTimeDays": 0.0,
    "AvgLeadTimeDays": 7.0,
}
# Score weights: lead time, margin, freight, volume.
WEIGHTS = (0.30, 0.30, 0.20, 0.20)
# Tier thresholds on the rounded score, highest first; anything lower (or missing) is Tier 4.
TIERS = (
    (80.0, "Tier 1: Strategic"),
    (68.0, "Tier 2: Preferred"),
    (55.0, "Tier 3: Moderate Risk"),
)
LOWEST_TIER = "Tier 4: High Risk"
TIER_LABELS = tuple(t for _, t in TIERS) + (LOWEST_TIER,)
# Lead-time histogram bins over the per-vendor mean lead time: (label, lower exclusive, upper inclusive).
LEAD_TIME_BINS = (
    ("1-5 Days", None, 5.0),
    ("6-8 Days", 5.0, 8.0),
    ("9-12 Days", 8.0, 12.0),
    ("13+ Days", 12.0, None),
)
# ------------------------------------------------------------------------------------------

SUMMARY_COLUMNS = [
    "VendorNumber", "VendorName", "TotalPOs", "TotalPurchaseRecords", "TotalUnitsPurchased",
    "TotalSpendDollars", "AvgPurchaseUnitPrice", "AvgLeadTimeDays", "MaxLeadTimeDays",
    "MinLeadTimeDays", "StdLeadTimeDays", "LateDeliveriesCount", "LateDeliveryRate",
    "TotalFreightDollars", "TotalInvoiceDollars", "AvgPaymentLeadTimeDays",
    "TotalUnitsSold", "TotalSalesDollars", "AvgSalesUnitPrice", "TotalExciseTaxDollars",
    "BeginInventoryUnits", "BeginInventoryValue", "EndInventoryUnits", "EndInventoryValue",
    "GrossProfitDollars", "GrossMarginPct", "FreightRatioPct", "AvgInventoryValue",
    "InventoryTurnoverRatio", "DaysSalesOfInventory", "VPIScore", "VendorTier",
]


def kpi_columns(c: dict) -> dict:
    """Profit, margin, freight ratio, inventory value, turnover and days of inventory (K2-K7)
    as Column expressions over the merged metric columns ``c``."""
    gp = c["TotalSalesDollars"] - c["TotalSpendDollars"]
    avg_inv = (c["BeginInventoryValue"] + c["EndInventoryValue"]) / 2.0
    turnover = safe_ratio(c["TotalSpendDollars"], avg_inv)
    return {
        "GrossProfitDollars": gp,
        "GrossMarginPct": safe_ratio(gp, c["TotalSalesDollars"], 100.0),
        "FreightRatioPct": safe_ratio(c["TotalFreightDollars"], c["TotalSpendDollars"], 100.0),
        "AvgInventoryValue": avg_inv,
        "InventoryTurnoverRatio": turnover,
        "DaysSalesOfInventory": F.when(turnover > 0, F.lit(365.0) / turnover)
                                 .otherwise(F.lit(999.0)),
    }


def component_columns(c: dict) -> dict:
    """The four 0-100 component scores (K8-K11).  A missing input gives a missing score."""
    spend_log = F.log10(floor_at(c["TotalSpendDollars"], 1.0))
    return {
        "LeadTimeScore": clip(F.lit(100.0) - (c["AvgLeadTimeDays"] * 5
                                              + c["LateDeliveryRate"] * 0.5), 0, 100),
        "MarginScore": clip(c["GrossMarginPct"] * 2.5, 0, 100),
        "FreightScore": clip(F.lit(100.0) - c["FreightRatioPct"] * 30, 0, 100),
        "VolumeScore": clip(spend_log / 8.0 * 100, 0, 100),
    }


def vpi_column(comp: dict) -> Column:
    """Weighted score rounded to one decimal, ties to even."""
    w1, w2, w3, w4 = WEIGHTS
    return round1(comp["LeadTimeScore"] * w1 + comp["MarginScore"] * w2
                  + comp["FreightScore"] * w3 + comp["VolumeScore"] * w4)


def vendor_tier(score: Column | str) -> Column:
    """Tier label from the rounded score; a missing score falls through to the lowest tier."""
    s = F.col(score) if isinstance(score, str) else score
    expr = None
    for threshold, label in TIERS:
        expr = (F.when(s >= threshold, label) if expr is None
                else expr.when(s >= threshold, label))
    return expr.otherwise(LOWEST_TIER)


#: The columns that each derived one is made of.
_MADE_OF = {
    "GrossProfitDollars": ("TotalSalesDollars", "TotalSpendDollars"),
    "GrossMarginPct": ("GrossProfitDollars",), "FreightRatioPct": ("TotalFreightDollars", "TotalSpendDollars"),
    "AvgInventoryValue": ("BeginInventoryValue", "EndInventoryValue"),
    "InventoryTurnoverRatio": ("TotalSpendDollars", "AvgInventoryValue"), "DaysSalesOfInventory": ("InventoryTurnoverRatio",),
    "LeadTimeScore": ("AvgLeadTimeDays", "LateDeliveryRate"), "MarginScore": ("GrossMarginPct",),
    "FreightScore": ("FreightRatioPct",), "VolumeScore": ("TotalSpendDollars",),
    "VPIScore": ("LeadTimeScore", "MarginScore", "FreightScore", "VolumeScore"), "VendorTier": ("VPIScore",),
}
_INVOICE = {"TotalFreightDollars", "TotalInvoiceDollars", "AvgPaymentLeadTimeDays"}
_SALES = {"TotalUnitsSold", "TotalSalesDollars", "AvgSalesUnitPrice", "TotalExciseTaxDollars"}
_INVENTORY = {"BeginInventoryUnits", "BeginInventoryValue", "EndInventoryUnits", "EndInventoryValue"}


def needed_columns(columns: list[str]) -> set[str]:
    """The columns and all that they are made of."""
    todo, found = list(columns), set()
    while todo:
        c = todo.pop()
        if c not in found:
            found.add(c)
            todo += _MADE_OF.get(c, ())
    return found


def scorecard_of(purchases: DataFrame, invoices: DataFrame | None, sales: DataFrame | None, inventory: DataFrame | None,
                 columns: list[str] | None = None, sort: bool = True, with_components: bool = False) -> DataFrame:
    """The scorecard from its metric tables: A1 ⟕ A2 ⟕ A3 ⟕ (A4, A5) on VendorNumber, null-safe like a
    pandas merge (J3-J6), with the defaults of K1, the measures K2-K13, and the highest spend first
    (L1; ties by VendorNumber).  A table that no wanted column needs may be None.

    Everything after the joins is one projection of composed expressions, so the driver
    builds and analyses the plan once rather than once per derived column."""
    joined = purchases
    c = {n: purchases[n] for n in purchases.columns}
    for r in (invoices, sales, inventory):
        if r is not None:
            joined = joined.join(r, purchases["VendorNumber"].eqNullSafe(r["VendorNumber"]), "left")
            c.update({n: r[n] for n in r.columns if n != "VendorNumber"})
    c = {k: F.coalesce(v, F.lit(FILL_DEFAULTS[k])) if k in FILL_DEFAULTS else v for k, v in c.items()}
    # Columns of an absent table are only named by measures that aren't selected.
    absent = {n: F.lit(None).cast("double") for n in (*SUMMARY_COLUMNS, *FILL_DEFAULTS) if n not in c}
    c = {**absent, **c}
    c.update(kpi_columns(c))
    comp = component_columns(c)
    c["VPIScore"] = vpi_column(comp)
    c["VendorTier"] = vendor_tier(c["VPIScore"])
    c.update(comp)
    names = list(columns or SUMMARY_COLUMNS) + (list(comp) if with_components else [])
    out = joined.select(*[c[n].alias(n) for n in names])
    if sort:
        out = out.orderBy(F.col("TotalSpendDollars").desc_nulls_last(),
                          F.col("VendorNumber").asc_nulls_last())
    return out


def vendor_summary(purchases: DataFrame, vendor_invoice: DataFrame, sales: DataFrame,
                   begin_inventory: DataFrame, end_inventory: DataFrame,
                   purchase_prices: DataFrame, sort: bool = True,
                   with_components: bool = False, columns: list[str] | None = None) -> DataFrame:
    """The 32-column vendor scorecard (K0), highest spend first (L1; ties by VendorNumber).

    ``columns`` asks for some of them only (sorted ones must hold the sort columns): metric tables, names and
    distinct POs that they don't need are left out of the plan, which pruning alone can't do, as
    left joins and grouping keys decide on rows."""
    needed = needed_columns((columns or SUMMARY_COLUMNS)
                            + (["LeadTimeScore", "MarginScore", "FreightScore", "VolumeScore"] if with_components else []))
    pm = purchase_metrics(purchases, "TotalPOs" in needed, "VendorName" in needed)
    inventory = (inventory_metrics_both(begin_inventory, end_inventory, purchase_prices) if needed & _INVENTORY else None)
    return scorecard_of(pm, invoice_metrics(vendor_invoice) if needed & _INVOICE else None,
                        sales_metrics(sales) if needed & _SALES else None, inventory, columns, sort, with_components)


def vendor_summary_from(sources: dict[str, DataFrame], **kw) -> DataFrame:
    return vendor_summary(sources["purchases"], sources["vendor_invoice"], sources["sales"],
                          sources["begin_inventory"], sources["end_inventory"],
                          sources["purchase_prices"], **kw)


# Columns that the consumers of a scorecard read.
EXEC_COLUMNS = ["TotalSpendDollars", "TotalSalesDollars", "GrossProfitDollars", "TotalFreightDollars", "AvgLeadTimeDays",
                "VendorTier"]
HISTOGRAM_COLUMNS = ["AvgLeadTimeDays"]
HISTORY_COLUMNS = ["VendorNumber", "AvgLeadTimeDays", "LateDeliveryRate", "VPIScore"]
SCORE_COLUMNS = ["VendorNumber", "LeadTimeScore", "MarginScore", "FreightScore", "VolumeScore", "VPIScore", "VendorTier"]


def vpi_components(vs_with_components: DataFrame) -> DataFrame:
    """Per-vendor component scores next to the final score and tier."""
    return vs_with_components.select("VendorNumber", "LeadTimeScore", "MarginScore",
                                     "FreightScore", "VolumeScore", "VPIScore", "VendorTier")


def exec_summary(vs: DataFrame) -> DataFrame:
    """One-row executive summary (A8) with the tier counts as a map.

    A single ungrouped aggregate: vendor count, four sums, the unweighted mean of the vendors'
    lead times, two guarded ratios of sums, and one conditional count per tier (a tier with
    no vendor is left out of the map, like a value count)."""
    sums = {
        "total_spend": "TotalSpendDollars",
        "total_sales": "TotalSalesDollars",
        "gross_profit": "GrossProfitDollars",
        "total_freight": "TotalFreightDollars",
    }
    aggs = [F.count(F.lit(1)).alias("total_vendors")]
    # An empty scorecard sums to 0; one whose values are all missing does too, as in pandas.
    aggs += [F.coalesce(exact_sum(c), F.lit(0.0)).alias(k) for k, c in sums.items()]
    aggs.append(F.avg("AvgLeadTimeDays").alias("avg_lead_time_days"))
    aggs += [F.count_if(F.col("VendorTier") == t).alias(f"_t{i}")
             for i, t in enumerate(TIER_LABELS)]
    a = vs.agg(*aggs)
    # Tiers as (count, label), most common first, ties by label, empty tiers left out.
    pairs = F.array(*[F.struct(F.col(f"_t{i}").alias("n"), F.lit(t).alias("k"))
                      for i, t in enumerate(TIER_LABELS)])
    ordered = F.array_sort(F.filter(pairs, lambda e: e["n"] > 0),
                           lambda x, y: F.when(x["n"] > y["n"], -1).when(x["n"] < y["n"], 1)
                           .when(x["k"] < y["k"], -1).when(x["k"] > y["k"], 1).otherwise(0))
    tier_map = F.map_from_arrays(F.transform(ordered, lambda e: e["k"]),
                                 F.transform(ordered, lambda e: e["n"]))
    return a.select(
        "total_vendors", "total_spend", "total_sales", "gross_profit",
        safe_ratio("gross_profit", "total_sales", 100.0).alias("overall_margin_pct"),
        "avg_lead_time_days", "total_freight",
        safe_ratio("total_freight", "total_spend", 100.0).alias("overall_freight_ratio"),
        tier_map.alias("tier_counts"))


def tier_counts(vs: DataFrame) -> DataFrame:
    """Vendors per tier, most common first (A9; missing tiers dropped, ties by label)."""
    return (vs.filter(F.col("VendorTier").isNotNull())
            .groupBy("VendorTier").agg(F.count(F.lit(1)).alias("VendorCount"))
            .orderBy(F.col("VendorCount").desc(), F.col("VendorTier").asc()))


def lead_time_histogram(vs: DataFrame, bins=LEAD_TIME_BINS) -> DataFrame:
    """Vendor counts in the lead-time bins, one row per bin in bin order, empty bins as 0 (A10)."""
    lt = F.col("AvgLeadTimeDays")
    aggs = []
    for i, (_, lo, hi) in enumerate(bins):
        cond = F.lit(True)
        if lo is not None:
            cond = cond & (lt > lo)
        if hi is not None:
            cond = cond & (lt <= hi)
        aggs.append(F.count_if(cond).alias(f"_b{i}"))
    rows = ", ".join(f"{i + 1}, '{label}', _b{i}" for i, (label, _, _) in enumerate(bins))
    return (vs.agg(*aggs)
            .selectExpr(f"stack({len(bins)}, {rows}) AS (BinOrder, LeadTimeBin, VendorCount)"))
