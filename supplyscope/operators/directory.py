"""Directory, detail and chart datasets over the scorecard.

The scorecard has one row per vendor; filters are plain ``filter`` calls, so when the
scorecard is read back from parquet they reach the scan.  Sorts always end with the vendor
(or brand) key so ties are ordered the same on every run.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed, format_currency, matches, shorten

# Sortable directory columns and whether each sorts ascending.
SORTABLE = {
    "TotalSpendDollars": False,
    "VPIScore": False,
    "AvgLeadTimeDays": True,
    "GrossMarginPct": False,
    "FreightRatioPct": True,
}
DEFAULT_ORDER = ("TotalSpendDollars", False)


# Columns that the chart and report datasets read.
SCATTER_COLUMNS = ["VendorNumber", "VendorName", "GrossMarginPct", "AvgLeadTimeDays", "TotalSpendDollars", "VPIScore"]
REPORT_COLUMNS = [*SCATTER_COLUMNS, "VendorTier", "TotalSalesDollars", "FreightRatioPct"]


def filter_tier(vs: DataFrame, tier: str | None = "all", literal: bool = False) -> DataFrame:
    """Keep vendors whose tier label contains ``tier`` (case-insensitive; ``all`` keeps all).

    ``literal=False`` treats ``tier`` as a regular expression; an invalid one raises."""
    if tier is None or tier == "all":
        return vs
    return vs.filter(matches("VendorTier", tier.lower(), literal))


def search_vendors(vs: DataFrame, text: str | None, literal: bool = False) -> DataFrame:
    """Vendors whose name or number contains ``text`` (trimmed, case-insensitive)."""
    q = (text or "").strip().lower()
    if not q:
        return vs
    return vs.filter(matches("VendorName", q, literal) | matches("VendorNumber", q, literal))


def sort_vendors(vs: DataFrame, sort_by: str | None) -> DataFrame:
    """Sort by one of ``SORTABLE`` (lead time and freight ascending, others descending;
    missing values last).  Any other column keeps the scorecard order (spend, descending)."""
    col, ascending = (sort_by, SORTABLE[sort_by]) if sort_by in SORTABLE else DEFAULT_ORDER
    key = F.col(col).asc_nulls_last() if ascending else F.col(col).desc_nulls_last()
    return vs.orderBy(key, F.col("VendorNumber").asc_nulls_last())


def vendor_directory(vs: DataFrame, tier: str | None = "all", search: str | None = "",
                     sort_by: str | None = "TotalSpendDollars", limit: int | None = None,
                     literal: bool = False) -> DataFrame:
    """Filtered, searched and sorted directory (L2); ``limit=30`` is the vendor picker.
    The number of matches is ``.count()`` of the result without a limit."""
    out = sort_vendors(search_vendors(filter_tier(vs, tier, literal), search, literal), sort_by)
    return out.limit(limit) if limit is not None else out


def vendor_detail(vs: DataFrame, vendor_id: int) -> DataFrame:
    """The scorecard row of one vendor; an empty result means not found."""
    return vs.filter(F.col("VendorNumber") == F.lit(vendor_id))


def top_vendors_by_spend(vs: DataFrame, k: int = 10) -> DataFrame:
    """Top ``k`` vendors by spend with their revenue: the bar-chart dataset."""
    return (vs.select("VendorNumber", "VendorName", "TotalSpendDollars", "TotalSalesDollars")
            .orderBy(F.col("TotalSpendDollars").desc_nulls_last(),
                     F.col("VendorNumber").asc_nulls_last())
            .limit(k))


def vendor_top_brands(brands: DataFrame, vendor_id: int, k: int = 10) -> DataFrame:
    """Top ``k`` brands of one vendor by spend out of a brand table (L4, P10).

    Given the stored top-100 table this is the original vendor-detail list (only vendors with a
    brand in the global top 100 get any rows)."""
    return (brands.filter(F.col("VendorNumber") == F.lit(vendor_id))
            .orderBy(F.col("TotalSpendDollars").desc_nulls_last(), F.col("Brand").asc_nulls_last())
            .limit(k))


def top_brands_per_vendor(brands: DataFrame, k: int = 10) -> DataFrame:
    """``vendor_top_brands`` for every vendor at once (W1), with the rank as ``BrandRank``.

    ``row_number() <= k`` lets Spark place a partial per-task group limit before the shuffle,
    so a vendor owning a third of all brands sends at most ``k`` rows per task."""
    w = Window.partitionBy("VendorNumber").orderBy(F.col("TotalSpendDollars").desc_nulls_last(),
                                                  F.col("Brand").asc_nulls_last())
    return (brands.withColumn("BrandRank", F.row_number().over(w).cast("long"))
            .filter(F.col("BrandRank") <= k))


def margin_leadtime_points(vs: DataFrame) -> DataFrame:
    """Scatter dataset: name, margin, lead time, spend and score per vendor."""
    return vs.select(*SCATTER_COLUMNS)


def late_rate_by_vendor(vs: DataFrame, n: int = 10) -> DataFrame:
    """The ``n`` vendors with the highest late-delivery rate."""
    return (vs.select("VendorNumber", "VendorName", "LateDeliveryRate")
            .orderBy(F.col("LateDeliveryRate").desc_nulls_last(),
                     F.col("VendorNumber").asc_nulls_last())
            .limit(n))


def vendor_report_rows(vs: DataFrame) -> DataFrame:
    """Directory rows as displayed: money as compact labels, lead time and margin with one
    decimal, freight ratio with two, and the chart label cut to 18 characters (F12, F13)."""
    return vs.select(
        "VendorNumber", "VendorName", "VendorTier", "VPIScore",
        format_currency("TotalSpendDollars").alias("SpendLabel"),
        format_currency("TotalSalesDollars").alias("SalesLabel"),
        F.concat(fixed("AvgLeadTimeDays", 1), F.lit(" days")).alias("LeadTimeLabel"),
        F.concat(fixed("GrossMarginPct", 1), F.lit("%")).alias("MarginLabel"),
        F.concat(fixed("FreightRatioPct", 2), F.lit("%")).alias("FreightLabel"),
        shorten("VendorName", 18).alias("ChartLabel"),
    )
