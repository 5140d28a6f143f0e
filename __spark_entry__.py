"""

Every query reads the driver tables of ``sf_dir`` through the stand-in views of FIXTURES.md §2
(``supplyscope.sources.fixture_views``) and runs over whole tables.  Columns whose last bits
depend on the summation algorithm are rounded to 6 decimals on both sides.
"""

from __future__ import annotations

import importlib
import os
import sys
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import oracle_sql as O  # noqa: E402
from supplyscope import operators as ops  # noqa: E402
from supplyscope.operators.dropped import counts_table, observed  # noqa: E402
from supplyscope.plans.scoring import (OUTPUT, from_predictions, score_orders,  # noqa: E402
                                       with_order_defaults, with_vendor_history)
from supplyscope.plans.training import (SAMPLE_SIZE, evaluate, fit_both, load_models, metrics_of,  # noqa: E402
                                        predict, save_models, training_features)
from supplyscope.plans import incremental  # noqa: E402
from supplyscope.plans.boosting import curve_table  # noqa: E402
from supplyscope.schemas import SOURCES  # noqa: E402
from supplyscope.session import materialize, scratch_folder  # noqa: E402
from supplyscope.sources import (fixture_etl_sources, fixture_shares, fixture_views, load_sources, look_up, read_csv_folder, read_summary, read_table,  # noqa: E402
                                 read_training_purchases, write_csv, write_json, write_lookup_table, write_summary,
                                 write_tables)
from pyspark.ml.functions import vector_to_array  # noqa: E402

SMOKE_DIR = "/root/testdata/sf0.001"
MONTH_FROM, MONTH_TO = O.MONTH_FROM, O.MONTH_TO
# Parameters of the directory-style queries.
TIER = "tier 2"
SEARCH = "0001"
DETAIL_VENDOR = 7
BRAND_VENDOR = 98
SAMPLE_N = O.SAMPLE_N
SAMPLE_KEYS = ["PONumber", "LineNumber", "Brand", "VendorNumber"]
SPLIT_SEED = 7


def _r6(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in cols})


def _views(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return fixture_views(spark, sf_dir)


def _vs(spark, sf_dir, **kw) -> DataFrame:
    return ops.vendor_summary_from(_views(spark, sf_dir), **kw)


def _history(spark, sf_dir) -> DataFrame:
    """What scoring and training look up of a vendor."""
    return _vs(spark, sf_dir, sort=False, columns=ops.HISTORY_COLUMNS)


def _vs_out(df: DataFrame) -> DataFrame:
    return _r6(df, "StdLeadTimeDays", "AvgSalesUnitPrice")


# ---------------------------------------------------------------------------- queries
def q_monthly_trends(spark, sf_dir):
    return ops.monthly_trends(_views(spark, sf_dir)["purchases"], MONTH_FROM, MONTH_TO)


def q_purchase_metrics(spark, sf_dir):
    return _r6(ops.purchase_metrics(_views(spark, sf_dir)["purchases"]), "StdLeadTimeDays")


def q_one_scan_tables(spark, sf_dir):
    """Purchase metrics, monthly trends and top brands of one scan, stacked."""
    t = ops.purchase_tables(_views(spark, sf_dir)["purchases"], MONTH_FROM, MONTH_TO)
    none, long = F.lit(None).cast("double"), "bigint"
    vendors = t["purchase_metrics"].select(
        F.lit("vendor").alias("dataset"), F.col("VendorNumber").cast("string").alias("entity"), F.col("VendorName").alias("label"),
        F.col("TotalPOs").cast(long).alias("counted"), F.col("TotalUnitsPurchased").alias("units"),
        F.col("TotalSpendDollars").alias("spend"), F.col("AvgPurchaseUnitPrice").alias("mean_price"),
        F.col("AvgLeadTimeDays").alias("mean_lead_time"), F.round("StdLeadTimeDays", 6).alias("std_lead_time"))
    months = t["monthly_trends"].select(
        F.lit("month"), "YearMonth", F.lit(None).cast("string"), F.col("ActiveVendors").cast(long), "MonthlyPurchasedUnits",
        "MonthlySpendDollars", none, "MonthlyAvgLeadTime", none)
    brands = t["top_brands"].select(
        F.lit("brand"), F.col("Brand").cast("string"), F.concat_ws("|", "Description", "VendorName"), F.col("VendorNumber").cast(long),
        "TotalPurchasedUnits", "TotalSpendDollars", "AvgPurchasePrice", none, none)
    return vendors.union(months).union(brands)


def q_filter_counts(spark, sf_dir):
    """What the date, amount and lead-time filters drop, counted in the jobs that build the states."""
    v = _views(spark, sf_dir)
    lines, of_lines = observed(v["purchases"], "purchases")
    invoices, of_invoices = observed(v["vendor_invoice"], "vendor_invoice")
    ops.purchase_tables(lines, MONTH_FROM, MONTH_TO)
    materialize(ops.invoice_metrics(invoices), "invoice-metrics")
    return counts_table(spark, {"purchases": of_lines, "vendor_invoice": of_invoices})


def q_invoice_metrics(spark, sf_dir):
    return ops.invoice_metrics(_views(spark, sf_dir)["vendor_invoice"])


def q_sales_metrics(spark, sf_dir):
    return _r6(ops.sales_metrics(_views(spark, sf_dir)["sales"]), "AvgSalesUnitPrice")


def q_inventory_begin(spark, sf_dir):
    v = _views(spark, sf_dir)
    return ops.inventory_metrics(v["begin_inventory"], v["purchase_prices"], "Begin")


def q_inventory_end(spark, sf_dir):
    v = _views(spark, sf_dir)
    return ops.inventory_metrics(v["end_inventory"], v["purchase_prices"], "End")


def q_brand_summary(spark, sf_dir):
    return ops.brand_summary(_views(spark, sf_dir)["purchases"])


def q_top_brands(spark, sf_dir):
    return ops.top_brands(_views(spark, sf_dir)["purchases"], 100)


def q_vendor_summary(spark, sf_dir):
    return _vs_out(_vs(spark, sf_dir))


def q_vpi_components(spark, sf_dir):
    return _r6(ops.vpi_components(_vs(spark, sf_dir, sort=False, columns=ops.SCORE_COLUMNS)),
               "LeadTimeScore", "MarginScore", "FreightScore", "VolumeScore")


def q_exec_summary(spark, sf_dir):
    # The tier map is compared as its compact JSON text (most common tier first).
    s = ops.exec_summary(_vs(spark, sf_dir, sort=False, columns=ops.EXEC_COLUMNS))
    return _r6(s.withColumn("tier_counts", F.to_json("tier_counts")), "avg_lead_time_days")


def q_tier_counts(spark, sf_dir):
    return ops.tier_counts(_vs(spark, sf_dir, sort=False, columns=["VendorTier"]))


def q_lead_time_histogram(spark, sf_dir):
    return ops.lead_time_histogram(_vs(spark, sf_dir, sort=False, columns=ops.HISTOGRAM_COLUMNS))


def q_directory_by_tier(spark, sf_dir):
    return _vs_out(ops.filter_tier(_vs(spark, sf_dir, sort=False), TIER))


def q_directory_search(spark, sf_dir):
    return _vs_out(ops.search_vendors(_vs(spark, sf_dir, sort=False), SEARCH))


def q_vendor_detail(spark, sf_dir):
    return _vs_out(ops.vendor_detail(_vs(spark, sf_dir, sort=False), DETAIL_VENDOR))


def q_vendor_directory(spark, sf_dir):
    return _vs_out(ops.vendor_directory(_vs(spark, sf_dir, sort=False), tier="tier",
                                        search="supplier", sort_by="AvgLeadTimeDays"))


def q_vendor_picker(spark, sf_dir):
    columns = ["VendorNumber", "VendorName", "TotalSpendDollars"]
    return (ops.vendor_directory(_vs(spark, sf_dir, sort=False, columns=columns), limit=30)
            .select("VendorNumber", "VendorName"))


def q_top_vendors_by_spend(spark, sf_dir):
    return ops.top_vendors_by_spend(_vs(spark, sf_dir, sort=False, columns=[
        "VendorNumber", "VendorName", "TotalSpendDollars", "TotalSalesDollars"]), 10)


def q_vendor_top_brands(spark, sf_dir):
    top = ops.top_brands(_views(spark, sf_dir)["purchases"], 100)
    return ops.vendor_top_brands(top, BRAND_VENDOR, 10)


def q_top_brands_per_vendor(spark, sf_dir):
    return ops.top_brands_per_vendor(ops.brand_summary(_views(spark, sf_dir)["purchases"]), 10)


def q_margin_leadtime_points(spark, sf_dir):
    return ops.margin_leadtime_points(_vs(spark, sf_dir, sort=False, columns=ops.SCATTER_COLUMNS))


def q_late_rate_by_vendor(spark, sf_dir):
    return ops.late_rate_by_vendor(_vs(spark, sf_dir, sort=False, columns=["VendorNumber", "VendorName", "LateDeliveryRate"]), 10)


def q_vendor_report_rows(spark, sf_dir):
    return ops.vendor_report_rows(_vs(spark, sf_dir, sort=False, columns=ops.REPORT_COLUMNS))


def q_sample_purchases(spark, sf_dir):
    return ops.sample_n(_views(spark, sf_dir)["purchases"], SAMPLE_N, SAMPLE_KEYS, seed=42)


def q_sample_tied_lines(spark, sf_dir):
    # The key repeats (about thirty lines a brand), so that the cut falls among equal keys.
    return ops.sample_n(_views(spark, sf_dir)["purchases"], SAMPLE_N + 1, ["Brand"], seed=42,
                        tie_keys=["PONumber", "LineNumber", "VendorNumber"])


def _training(spark, sf_dir, n=SAMPLE_N):
    v = _views(spark, sf_dir)
    return training_features(v["purchases"], _history(spark, sf_dir), n,
                             SAMPLE_KEYS, seed=42)


def q_training_features(spark, sf_dir):
    return _training(spark, sf_dir)


def q_train_test_split(spark, sf_dir):
    feats = _training(spark, sf_dir)
    return feats.withColumn("Split", F.when(ops.train_test_flag(SAMPLE_KEYS, SPLIT_SEED),
                                            "train").otherwise("test"))


def q_score_orders_rules(spark, sf_dir):
    v = _views(spark, sf_dir)
    return score_orders(v["orders_to_score"], _history(spark, sf_dir), None,
                        keep=["order_key", "line_number", "part_key"])


def q_score_orders_defaults(spark, sf_dir):
    v = _views(spark, sf_dir)
    keys = ["order_key", "line_number", "part_key"]
    orders = v["orders_to_score"].select(*keys, "vendor_number")
    return score_orders(orders, _history(spark, sf_dir), None, keep=keys)


def q_risk_from_predictions(spark, sf_dir):
    # Stand-in predictions from the row keys: what follows a prediction, without a model.
    v = _views(spark, sf_dir)
    base = with_vendor_history(with_order_defaults(v["orders_to_score"]), _history(spark, sf_dir))
    days, probability = (F.col("order_key") % 160) / 10.0, (F.col("part_key") % 97) / 97.0
    return from_predictions(base, days, probability).select("order_key", "line_number", "part_key", *OUTPUT)


def q_metrics_from_predictions(spark, sf_dir):
    """The metrics of stand-in predictions over all lines that pass the training filters."""
    scored = _training(spark, sf_dir, None).withColumns({
        "pred_days": F.col("ActualLeadTimeDays") + (F.col("Brand") % 7 - 3) * 0.5,
        "pred_delay": F.when(F.col("Brand") % 9 == 0, 1 - F.col("IsDelayed"))
        .otherwise(F.col("IsDelayed")).cast("double")})
    return _r6(metrics_of(scored), "r2", "mae", "rmse", "accuracy")


def q_stored_scorecard(spark, sf_dir):
    out = scratch_folder(spark, "stored-scorecard")
    write_tables({"vendor_summary": _vs(spark, sf_dir)}, out)
    return _vs_out(read_table(spark, out, "vendor_summary"))


def q_scorecard_after_merge(spark, sf_dir):
    """Two loads, split by date (sales, which have none, by vendor), stored and merged."""
    # The lines are joined once; both loads' states and invoices read them.
    v = fixture_etl_sources(spark, sf_dir)
    cut, out = F.lit(MONTH_FROM).cast("date"), scratch_folder(spark, "loads")
    sides = {"early": lambda c: F.coalesce(c < cut, F.lit(False)), "late": lambda c: F.coalesce(c >= cut, F.lit(True))}
    middle = v["sales"].agg(F.avg("VendorNo")).first()[0] or 0.0
    for load, side in sides.items():
        sold = F.col("VendorNo") < middle
        incremental.store_load(out, load, v["purchases"].where(side(F.col("PODate"))),
                               v["vendor_invoice"].where(side(F.col("InvoiceDate"))),
                               v["sales"].where(sold if load == "early" else ~sold | sold.isNull()), MONTH_FROM, MONTH_TO)
    return _vs_out(incremental.scorecard(spark, out, v["begin_inventory"], v["end_inventory"], v["purchase_prices"]))


def q_csv_scorecard(spark, sf_dir):
    """The six inputs as CSV files with their columns in another order, read by name."""
    out, v = scratch_folder(spark, "csv-inputs"), _views(spark, sf_dir)
    shares = fixture_shares(spark, sf_dir)
    for name, schema in SOURCES.items():
        columns = [f.name for f in schema.fields]
        # What joins lines and orders is written share by share.
        for part in shares if name in ("purchases", "vendor_invoice") else [v]:
            write_csv(part[name].select(*reversed(columns), F.lit("unused").alias("Remark")), f"{out}/{name}.csv")
    return _vs_out(ops.vendor_summary_from(load_sources(spark, out, register_views=False)))


def q_csv_training_lines(spark, sf_dir):
    """The training scan of a CSV file of purchases."""
    out = scratch_folder(spark, "csv-training")
    _views(spark, sf_dir)["purchases"].drop("LineNumber").write.option("header", True).csv(f"{out}/purchases.csv")
    return read_training_purchases(spark, out)


def q_mixed_csv_lines(spark, sf_dir):
    """Purchases as CSV files of two layouts, some with a cell that is no number: the lines that can be read
    and the rejected ones."""
    out = scratch_folder(spark, "csv-mixed")
    lines = _views(spark, sf_dir)["purchases"].select(*[f.name for f in SOURCES["purchases"].fields])
    texts = lines.withColumn("Quantity", F.when(F.col("Brand") % 7 == 0, F.concat(F.lit("about "), F.col("Quantity")))
                             .otherwise(F.col("Quantity").cast("string")))
    for odd, columns in ((True, lines.columns), (False, lines.columns[::-1])):
        side = F.col("PONumber") % 2 == (1 if odd else 0)
        texts.filter(side).select(*columns).write.mode("append").option("header", True).csv(out)
    good, bad = read_csv_folder(spark, out, SOURCES["purchases"])
    cell = lambda name: F.get_json_object("line", f"$.{name}").cast("long").alias(name)
    return (good.select("PONumber", "Brand", "VendorNumber", F.col("Quantity").cast("double"), F.lit("").alias("rejected_for"))
            .unionByName(bad.select(cell("PONumber"), cell("Brand"), cell("VendorNumber"),
                                    F.lit(None).cast("double").alias("Quantity"), F.concat_ws(",", "columns").alias("rejected_for"))))


def q_json_records(spark, sf_dir):
    """The scorecard as JSON records, read back."""
    out, vs = scratch_folder(spark, "json-records"), _vs(spark, sf_dir, sort=False)
    write_json(vs, out)
    return _vs_out(spark.read.schema(vs.schema).json(out))


def q_stored_projection(spark, sf_dir):
    """Three columns of the stored scorecard."""
    out = scratch_folder(spark, "stored-projection")
    write_tables({"vendor_summary": _vs(spark, sf_dir, sort=False)}, out)
    return read_table(spark, out, "vendor_summary", ["VendorNumber", "VPIScore", "VendorTier"])


def q_stored_vendor_detail(spark, sf_dir):
    """One vendor's scorecard out of the table stored for lookups."""
    out = scratch_folder(spark, "stored-detail")
    write_lookup_table(_vs(spark, sf_dir, sort=False), out, "vendor_summary", ["VendorNumber"])
    return _vs_out(look_up(spark, out, "vendor_summary", VendorNumber=DETAIL_VENDOR))


def q_stored_vendor_brands(spark, sf_dir):
    """All brands of one vendor out of the brand table stored for lookups."""
    out = scratch_folder(spark, "stored-brands")
    write_lookup_table(ops.brand_summary(_views(spark, sf_dir)["purchases"]), out, "brand_summary", ["VendorNumber"], ["Brand"])
    return look_up(spark, out, "brand_summary", VendorNumber=BRAND_VENDOR)


def q_stored_summary(spark, sf_dir):
    out = scratch_folder(spark, "stored-summary")
    write_summary(ops.exec_summary(_vs(spark, sf_dir, sort=False, columns=ops.EXEC_COLUMNS)), out)
    s = read_summary(spark, out)
    return _r6(s.withColumn("tier_counts", F.to_json("tier_counts")), "avg_lead_time_days")


_MODELS: dict = {}
_CURVES: dict = {}
_HISTORIES: dict = {}


def _models(spark, sf_dir):
    """Train both models once per session and data folder (the rows-only queries share them).

    The lines are joined and the vendors' history is computed once; the draw, the test share and the scoring read them."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _MODELS:
        lines = materialize(_views(spark, sf_dir)["purchases"].drop("VendorName", "Description"), "purchases")
        history = materialize(ops.vendor_summary_from(fixture_views(spark, sf_dir, purchases=lines), sort=False,
                                                      columns=ops.HISTORY_COLUMNS), "history")
        features = lambda n: training_features(lines, history, n, SAMPLE_KEYS, seed=42)
        # Fitted on a sample of fixed size; evaluated on every held-out line.
        train, _ = ops.train_test_split(features(SAMPLE_SIZE), SAMPLE_KEYS, SPLIT_SEED)
        _, test = ops.train_test_split(features(None), SAMPLE_KEYS, SPLIT_SEED)
        _HISTORIES[key] = history
        curves: dict = {}
        models = fit_both(train, keys=SAMPLE_KEYS, curves=curves)
        _MODELS[key] = (models, test)
        _CURVES[key] = curves
    return _MODELS[key]


def q_predict_lead_time(spark, sf_dir):
    models, test = _models(spark, sf_dir)
    return predict({"reg": models["reg"]}, test).select(*SAMPLE_KEYS, "ActualLeadTimeDays",
                                                        "pred_days")


def q_predict_delay(spark, sf_dir):
    models, test = _models(spark, sf_dir)
    return (predict({"cls": models["cls"]}, test)
            .select(*SAMPLE_KEYS, "IsDelayed", "pred_delay",
                    (vector_to_array("prob_delay")[1]).alias("p_delay")))


def q_model_metrics(spark, sf_dir):
    models, test = _models(spark, sf_dir)
    return evaluate(models, test)


def q_boosting_curve(spark, sf_dir):
    """Held-out loss after each boosting round of both models, and where the ensembles are cut."""
    _models(spark, sf_dir)
    return curve_table(spark, _CURVES[(spark.sparkContext.applicationId, sf_dir)])


def q_reloaded_predictions(spark, sf_dir):
    """Predictions of the held-out lines by the models after they were saved and loaded."""
    models, test = _models(spark, sf_dir)
    out = scratch_folder(spark, "models")
    save_models(models, None, out)
    again, _ = load_models(spark, out)
    return predict(again, test).select(*SAMPLE_KEYS, "pred_days", "pred_delay", vector_to_array("prob_delay")[1].alias("p_delay"))


def q_score_orders_model(spark, sf_dir):
    models, _ = _models(spark, sf_dir)
    v = _views(spark, sf_dir)
    history = _HISTORIES[(spark.sparkContext.applicationId, sf_dir)]
    return score_orders(v["orders_to_score"], history, models,
                        keep=["order_key", "line_number", "part_key"])


_EXEC_SUMMARY_SQL = O.with_vs(
        "SELECT total_vendors, total_spend, total_sales, gross_profit, "
        "CASE WHEN total_sales > 0 THEN gross_profit / total_sales * 100.0 ELSE 0.0 END AS overall_margin_pct, "
        "round(avg_lead_time_days, 6) AS avg_lead_time_days, total_freight, "
        "CASE WHEN total_spend > 0 THEN total_freight / total_spend * 100.0 ELSE 0.0 END AS overall_freight_ratio, "
        "(SELECT to_json(map_from_entries(list(struct_pack(k := VendorTier, v := n) ORDER BY n DESC, VendorTier))) "
        "FROM (SELECT VendorTier, COUNT(*) AS n FROM vs GROUP BY VendorTier)) AS tier_counts "
        "FROM (SELECT COUNT(*) AS total_vendors, "
        f"{O.xsum('TotalSpendDollars')} AS total_spend, {O.xsum('TotalSalesDollars')} AS total_sales, "
        f"{O.xsum('GrossProfitDollars')} AS gross_profit, AVG(AvgLeadTimeDays) AS avg_lead_time_days, "
        f"{O.xsum('TotalFreightDollars')} AS total_freight FROM vs)")

_QUERIES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {
    "monthly_trends": (q_monthly_trends, O.with_standins(O.MONTHLY_TRENDS)),
    "purchase_metrics": (q_purchase_metrics, O.with_standins(
        f"SELECT * REPLACE (round(StdLeadTimeDays, 6) AS StdLeadTimeDays) FROM ({O.PURCHASE_METRICS})")),
    "one_scan_tables": (q_one_scan_tables, O.with_standins(O.ONE_SCAN_TABLES)),
    "filter_counts": (q_filter_counts, O.with_standins(O.FILTER_COUNTS)),
    "invoice_metrics": (q_invoice_metrics, O.with_standins(O.INVOICE_METRICS)),
    "sales_metrics": (q_sales_metrics, O.with_standins(
        f"SELECT * REPLACE (round(AvgSalesUnitPrice, 6) AS AvgSalesUnitPrice) FROM ({O.SALES_METRICS})")),
    "inventory_begin": (q_inventory_begin, O.with_standins(O.inventory_sql("begin_inventory", "Begin"))),
    "inventory_end": (q_inventory_end, O.with_standins(O.inventory_sql("end_inventory", "End"))),
    "brand_summary": (q_brand_summary, O.with_standins(O.BRAND_SUMMARY)),
    "top_brands": (q_top_brands, O.with_standins(O.TOP_BRANDS)),
    "vendor_summary": (q_vendor_summary, O.with_vs(
        f"SELECT {O.SUMMARY_COLUMNS} FROM vs ORDER BY TotalSpendDollars DESC NULLS LAST, VendorNumber")),
    "stored_scorecard": (q_stored_scorecard, O.with_vs(f"SELECT {O.SUMMARY_COLUMNS} FROM vs")),
    "scorecard_after_merge": (q_scorecard_after_merge, O.with_vs(f"SELECT {O.SUMMARY_COLUMNS} FROM vs")),
    "csv_scorecard": (q_csv_scorecard, O.with_vs(f"SELECT {O.SUMMARY_COLUMNS} FROM vs")),
    "csv_training_lines": (q_csv_training_lines, O.with_standins(
        "SELECT VendorNumber, Store, Classification, Quantity, PurchasePrice, Dollars, PODate, ReceivingDate, "
        "PONumber, Brand FROM purchases")),
    "mixed_csv_lines": (q_mixed_csv_lines, O.with_standins(
        "SELECT PONumber, Brand, VendorNumber, CASE WHEN Brand % 7 <> 0 THEN CAST(Quantity AS DOUBLE) END AS Quantity, "
        "CASE WHEN Brand % 7 = 0 THEN 'Quantity' ELSE '' END AS rejected_for FROM purchases")),
    "json_records": (q_json_records, O.with_vs(f"SELECT {O.SUMMARY_COLUMNS} FROM vs")),
    "stored_projection": (q_stored_projection, O.with_vs("SELECT VendorNumber, VPIScore, VendorTier FROM vs")),
    "stored_vendor_detail": (q_stored_vendor_detail, O.with_vs(
        f"SELECT {O.SUMMARY_COLUMNS} FROM vs WHERE VendorNumber = {DETAIL_VENDOR}")),
    "stored_vendor_brands": (q_stored_vendor_brands, O.with_standins(
        f"SELECT * FROM ({O.BRAND_SUMMARY}) WHERE VendorNumber = {BRAND_VENDOR}")),
    "vpi_components": (q_vpi_components, O.with_vs(
        "SELECT VendorNumber, round(LeadTimeScore, 6) AS LeadTimeScore, round(MarginScore, 6) AS MarginScore, "
        "round(FreightScore, 6) AS FreightScore, round(VolumeScore, 6) AS VolumeScore, VPIScore, VendorTier FROM vs")),
    "exec_summary": (q_exec_summary, _EXEC_SUMMARY_SQL),
    "stored_summary": (q_stored_summary, _EXEC_SUMMARY_SQL),
    "tier_counts": (q_tier_counts, O.with_vs(
        "SELECT VendorTier, COUNT(*) AS VendorCount FROM vs WHERE VendorTier IS NOT NULL "
        "GROUP BY VendorTier ORDER BY VendorCount DESC, VendorTier")),
    "lead_time_histogram": (q_lead_time_histogram, O.with_vs(
        "SELECT * FROM (VALUES (1, '1-5 Days'), (2, '6-8 Days'), (3, '9-12 Days'), (4, '13+ Days')) b(BinOrder, LeadTimeBin) "
        "CROSS JOIN LATERAL (SELECT COUNT(*) FILTER (WHERE "
        "(b.BinOrder = 1 AND AvgLeadTimeDays <= 5) OR (b.BinOrder = 2 AND AvgLeadTimeDays > 5 AND AvgLeadTimeDays <= 8) OR "
        "(b.BinOrder = 3 AND AvgLeadTimeDays > 8 AND AvgLeadTimeDays <= 12) OR (b.BinOrder = 4 AND AvgLeadTimeDays > 12)"
        ") AS VendorCount FROM vs) ORDER BY BinOrder")),
    "directory_by_tier": (q_directory_by_tier, O.with_vs(
        f"SELECT {O.SUMMARY_COLUMNS} FROM vs WHERE regexp_matches(lower(VendorTier), '{TIER}')")),
    "directory_search": (q_directory_search, O.with_vs(
        f"SELECT {O.SUMMARY_COLUMNS} FROM vs WHERE coalesce(regexp_matches(lower(VendorName), '{SEARCH}'), false) "
        f"OR coalesce(regexp_matches(CAST(VendorNumber AS VARCHAR), '{SEARCH}'), false)")),
    "vendor_detail": (q_vendor_detail, O.with_vs(
        f"SELECT {O.SUMMARY_COLUMNS} FROM vs WHERE VendorNumber = {DETAIL_VENDOR}")),
    "vendor_directory": (q_vendor_directory, O.with_vs(
        f"SELECT {O.SUMMARY_COLUMNS} FROM vs WHERE regexp_matches(lower(VendorTier), 'tier') "
        "AND (coalesce(regexp_matches(lower(VendorName), 'supplier'), false) "
        "OR regexp_matches(CAST(VendorNumber AS VARCHAR), 'supplier')) "
        "ORDER BY AvgLeadTimeDays ASC NULLS LAST, VendorNumber")),
    "vendor_picker": (q_vendor_picker, O.with_vs(
        "SELECT VendorNumber, VendorName FROM vs "
        "ORDER BY TotalSpendDollars DESC NULLS LAST, VendorNumber LIMIT 30")),
    "top_vendors_by_spend": (q_top_vendors_by_spend, O.with_vs(
        "SELECT VendorNumber, VendorName, TotalSpendDollars, TotalSalesDollars FROM vs "
        "ORDER BY TotalSpendDollars DESC NULLS LAST, VendorNumber LIMIT 10")),
    "vendor_top_brands": (q_vendor_top_brands, O.with_standins(
        f"SELECT * FROM ({O.TOP_BRANDS}) WHERE VendorNumber = {BRAND_VENDOR} "
        "ORDER BY TotalSpendDollars DESC NULLS LAST, Brand LIMIT 10")),
    "top_brands_per_vendor": (q_top_brands_per_vendor, O.with_standins(
        f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY VendorNumber "
        f"ORDER BY TotalSpendDollars DESC NULLS LAST, Brand) AS BrandRank FROM ({O.BRAND_SUMMARY})) "
        "WHERE BrandRank <= 10")),
    "margin_leadtime_points": (q_margin_leadtime_points, O.with_vs(
        "SELECT VendorNumber, VendorName, GrossMarginPct, AvgLeadTimeDays, TotalSpendDollars, VPIScore FROM vs")),
    "late_rate_by_vendor": (q_late_rate_by_vendor, O.with_vs(
        "SELECT VendorNumber, VendorName, LateDeliveryRate FROM vs "
        "ORDER BY LateDeliveryRate DESC NULLS LAST, VendorNumber LIMIT 10")),
    "vendor_report_rows": (q_vendor_report_rows, O.with_vs(
        "SELECT VendorNumber, VendorName, VendorTier, VPIScore, "
        + ", ".join(
            f"CASE WHEN {c} IS NULL OR {c} = 0 OR isnan({c}) THEN '$0.00' "
            f"WHEN {c} >= 1e6 THEN printf('$%.2fM', round({c} / 1e6, 2)) "
            f"WHEN {c} >= 1e3 THEN printf('$%.1fK', round({c} / 1e3, 1)) "
            f"ELSE printf('$%.2f', round({c}, 2)) END AS {a}"
            for c, a in (("TotalSpendDollars", "SpendLabel"), ("TotalSalesDollars", "SalesLabel")))
        + ", printf('%.1f', round(AvgLeadTimeDays, 1)) || ' days' AS LeadTimeLabel"
        ", printf('%.1f', round(GrossMarginPct, 1)) || '%' AS MarginLabel"
        ", printf('%.2f', round(FreightRatioPct, 2)) || '%' AS FreightLabel"
        ", CASE WHEN length(VendorName) > 18 THEN substring(VendorName, 1, 18) || '...' "
        "ELSE VendorName END AS ChartLabel FROM vs")),
    "sample_purchases": (q_sample_purchases, O.with_standins(
        "SELECT * FROM purchases ORDER BY md5(concat_ws('|', PONumber, LineNumber, Brand, VendorNumber, '42')), "
        f"PONumber, LineNumber, Brand, VendorNumber LIMIT {SAMPLE_N}")),
    "training_features": (q_training_features, O.with_vs(O.TRAINING_FEATURES)),
    "train_test_split": (q_train_test_split, O.with_vs(
        f"SELECT *, CASE WHEN substr(md5(concat_ws('|', PONumber, LineNumber, Brand, VendorNumber, '{SPLIT_SEED}')), 1, 8) "
        f"< 'cccccccc' THEN 'train' ELSE 'test' END AS Split FROM ({O.TRAINING_FEATURES})")),
    "score_orders_rules": (q_score_orders_rules, O.with_vs(O.SCORE_ORDERS_RULES)),
    "score_orders_defaults": (q_score_orders_defaults, O.with_vs(O.SCORE_ORDERS_DEFAULTS)),
    "risk_from_predictions": (q_risk_from_predictions, O.with_vs(O.RISK_FROM_PREDICTIONS)),
    "metrics_from_predictions": (q_metrics_from_predictions, O.with_vs(O.METRICS_FROM_PREDICTIONS)),
    "sample_tied_lines": (q_sample_tied_lines, O.with_standins(O.SAMPLE_TIED_LINES)),
    "predict_lead_time": (q_predict_lead_time, None),
    "predict_delay": (q_predict_delay, None),
    "model_metrics": (q_model_metrics, None),
    "boosting_curve": (q_boosting_curve, None),
    "reloaded_predictions": (q_reloaded_predictions, None),
    "score_orders_model": (q_score_orders_model, None),
}


def _llm_queries() -> dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]]:
    """The corpus queries, if their subpackage and the pipeline are there (both can be left out)."""
    found = {}
    for module in ("supplyscope.llm.queries", "corpus_pipeline"):
        try:
            found |= importlib.import_module(module).QUERIES
        except ModuleNotFoundError as e:
            if e.name not in ("supplyscope.llm", "supplyscope.llm.queries", "corpus_pipeline"):
                raise
    return found


_QUERIES |= _llm_queries()


def entry(spark: SparkSession) -> DataFrame:
    """Flagship query: the vendor scorecard on sf0.001."""
    return ops.vendor_summary_from(fixture_views(spark, SMOKE_DIR))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: fn for k, (fn, _) in _QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: sql for k, (_, sql) in _QUERIES.items() if sql is not None}
