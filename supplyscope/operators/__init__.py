"""DataFrame → DataFrame operators: metrics, scorecard, directory queries, sampling."""

from .directory import (REPORT_COLUMNS, SCATTER_COLUMNS, filter_tier, late_rate_by_vendor, margin_leadtime_points,
                        search_vendors, sort_vendors, top_brands_per_vendor,
                        top_vendors_by_spend, vendor_detail, vendor_directory,
                        vendor_report_rows, vendor_top_brands)
from .metrics import (brand_summary, inventory_metrics, inventory_metrics_both,
                      invoice_metrics, monthly_trends,
                      purchase_metrics, purchase_tables, sales_metrics, tables_of, top_brands,
                      with_late_rate)
from .sampling import sample_n, train_test_flag, train_test_split
from .scorecard import (EXEC_COLUMNS, HISTOGRAM_COLUMNS, HISTORY_COLUMNS, SCORE_COLUMNS, exec_summary,
                        lead_time_histogram, scorecard_of, tier_counts,
                        vendor_summary, vendor_summary_from, vendor_tier, vpi_components)

__all__ = [n for n in dir() if not n.startswith("_")]
