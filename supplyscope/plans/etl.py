"""The batch ETL job: inputs → scorecard, monthly trends, top brands, summary → stored tables.

Purchases are scanned once for the scorecard, the monthly trends and the top brands, whose states are
stored (``purchase_tables``).  Lineage is cut there, at the purchases input, which is stored once as
parquet (the training sample reads it too), and at the scorecard, which the summary reads back, so a
lost executor re-reads files instead of re-running the whole job.  Result tables are new versions that
replace the old ones when they are whole; what filters drop is counted in the same pass.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import (exec_summary, inventory_metrics_both, invoice_metrics, purchase_tables, sales_metrics,
                         scorecard_of)
from ..operators.dropped import counts_table, observed
from ..session import run_folder
from ..sources import read_table, write_json, write_lookup_table, write_summary, write_tables


def run_etl(spark: SparkSession, sources: dict[str, DataFrame], out_dir: str,
            month_from: str = "2024-01-01", month_to: str = "2024-12-31",
            top_k: int = 100, json_dir: str | None = None,
            materialize_purchases: bool = True) -> dict[str, DataFrame]:
    """Build and store ``vendor_summary``, ``monthly_trends``, ``top_brands``, ``filter_counts`` and the
    executive summary under ``out_dir``; returns the stored tables re-read (S4-S7).

    The purchases input is stored under ``out_dir`` as well, replacing the last run's copy, unless
    ``materialize_purchases=False`` says that it is a stored columnar table already.  Intermediate tables are
    removed at the end; the tables that are returned read ``out_dir``."""
    with run_folder(spark, "etl"):
        return _stored_tables(spark, sources, out_dir, month_from, month_to, top_k, json_dir, materialize_purchases)


def _stored_tables(spark: SparkSession, sources: dict[str, DataFrame], out_dir: str, month_from: str, month_to: str,
                   top_k: int, json_dir: str | None, materialize_purchases: bool) -> dict[str, DataFrame]:
    purchases = sources["purchases"]
    if materialize_purchases:
        write_tables({"purchases": purchases}, out_dir)
        purchases = read_table(spark, out_dir, "purchases")
    lines, of_lines = observed(purchases, "purchases")
    invoices, of_invoices = observed(sources["vendor_invoice"], "vendor_invoice")
    found = purchase_tables(lines, month_from, month_to, top_k)
    inventory = inventory_metrics_both(sources["begin_inventory"], sources["end_inventory"], sources["purchase_prices"])
    tables = {
        "vendor_summary": scorecard_of(found["purchase_metrics"], invoice_metrics(invoices), sales_metrics(sources["sales"]),
                                       inventory),
        "monthly_trends": found["monthly_trends"],
        "top_brands": found["top_brands"],
    }
    for name in ("vendor_summary", "top_brands"):  # looked up by vendor
        write_lookup_table(tables[name], out_dir, name, ["VendorNumber"])
    write_tables({"monthly_trends": tables["monthly_trends"]}, out_dir)
    tables["filter_counts"] = counts_table(spark, {"purchases": of_lines, "vendor_invoice": of_invoices})
    write_tables({"filter_counts": tables["filter_counts"]}, out_dir)
    stored = {k: read_table(spark, out_dir, k) for k in tables}
    summary = exec_summary(stored["vendor_summary"])
    write_summary(summary, out_dir)
    if json_dir:
        # Record files keep the tables' order (a re-read parquet table has none of its own).
        order = {
            "vendor_summary": [F.col("TotalSpendDollars").desc_nulls_last(),
                               F.col("VendorNumber").asc_nulls_last()],
            "monthly_trends": [F.col("YearMonth")],
            "top_brands": [F.col("TotalSpendDollars").desc_nulls_last(),
                           F.col("Brand").asc_nulls_last()],
        }
        for k, df in ((k, stored[k]) for k in order):
            write_json(df.orderBy(*order[k]), os.path.join(json_dir, k))
    stored["exec_summary"] = summary
    stored["purchases"] = purchases
    return stored


def main(argv: list[str] | None = None) -> None:
    """``python -m supplyscope.plans.etl INPUTS OUT [--format csv] [--from D] [--to D]``"""
    import argparse

    from ..session import build_session
    from ..sources import load_sources

    ap = argparse.ArgumentParser(prog="python -m supplyscope.plans.etl")
    ap.add_argument("inputs", help="folder with the six inputs <name>.<format>")
    ap.add_argument("out", help="folder for the result tables")
    ap.add_argument("--format", default="csv")
    ap.add_argument("--from", dest="date_from", default="2024-01-01")
    ap.add_argument("--to", dest="date_to", default="2024-12-31")
    ap.add_argument("--top-k", type=int, default=100)
    ap.add_argument("--json", dest="json_dir", default=None, help="also write JSON record files")
    ap.add_argument("--shuffle-partitions", type=int, default=None,
                    help="shuffle width before adaptive merging: input bytes / 256 MB")
    a = ap.parse_args(argv)
    spark = build_session(shuffle_partitions=a.shuffle_partitions)
    # A columnar input is scanned where it is; a row format is copied once.
    stored = run_etl(spark, load_sources(spark, a.inputs, a.format), a.out, a.date_from,
                     a.date_to, a.top_k, a.json_dir,
                     materialize_purchases=a.format not in ("parquet", "orc"))
    s = stored["exec_summary"].first()
    print(f"vendors={s.total_vendors} spend={s.total_spend:.2f} sales={s.total_sales:.2f} "
          f"avg_lead_time={s.avg_lead_time_days:.1f}")


if __name__ == "__main__":
    main()
