"""Sources and sinks (S1-S10), the ETL plan end to end, and model training / scoring."""

import os

from pyspark.sql import functions as F

from supplyscope import operators as ops
from supplyscope.plans.etl import run_etl
from supplyscope.plans.scoring import score_orders
from supplyscope.plans.training import load_models, save_models, train_models
from supplyscope.sources import (fixture_etl_sources, fixture_views, load_sources,
                                 read_summary, read_table, read_training_purchases, write_json,
                                 write_tables)
from conftest import SF_SMALL


def test_csv_round_trip_equals_views(spark, tmpdir_path):  # S1, S2, S4
    views = fixture_views(spark, SF_SMALL)
    names = ["purchases", "vendor_invoice", "sales", "begin_inventory", "end_inventory",
             "purchase_prices"]
    for n in names:
        df = views[n].drop("LineNumber") if n == "purchases" else views[n]
        df.write.mode("overwrite").option("header", True).csv(os.path.join(tmpdir_path, f"{n}.csv"))
    src = load_sources(spark, tmpdir_path, "csv")
    for n in names:
        orig = views[n].drop("LineNumber") if n == "purchases" else views[n]
        assert src[n].count() == orig.count()
    a = ops.vendor_summary_from(src).drop("StdLeadTimeDays", "AvgSalesUnitPrice")
    b = ops.vendor_summary_from({**views, "purchases": views["purchases"].drop("LineNumber")}) \
        .drop("StdLeadTimeDays", "AvgSalesUnitPrice")
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0
    assert spark.sql("SELECT count(*) AS n FROM purchases").first().n == src["purchases"].count()
    t = read_training_purchases(spark, tmpdir_path)
    assert "ReceivingDate" in t.columns and "VendorName" not in t.columns


def test_run_etl_writes_and_rereads(spark, tmpdir_path):  # S4-S9
    views = fixture_views(spark, SF_SMALL)
    out = os.path.join(tmpdir_path, "out")
    stored = run_etl(spark, views, out, "1998-01-01", "1998-12-31",
                     json_dir=os.path.join(tmpdir_path, "json"))
    vs = read_table(spark, out, "vendor_summary")
    assert vs.count() == views["purchases"].select("VendorNumber").distinct().count()
    assert read_table(spark, out, "top_brands").count() == 100
    months = [r.YearMonth for r in read_table(spark, out, "monthly_trends", ["YearMonth"]).collect()]
    assert sorted(months) == [f"1998-{m:02d}" for m in range(1, 13)]
    summ = read_summary(spark, out).first()
    assert summ.total_vendors == vs.count()
    assert spark.read.json(os.path.join(tmpdir_path, "json", "top_brands")).count() == 100
    assert stored["exec_summary"].first().total_vendors == vs.count()


def test_write_tables_partitioned(spark, tmpdir_path):  # S4
    views = fixture_views(spark, SF_SMALL)
    p = views["purchases"].withColumn("ym", F.date_format("PODate", "yyyy-MM"))
    write_tables({"purchases": p}, tmpdir_path, partition_by={"purchases": ["ym"]})
    back = read_table(spark, tmpdir_path, "purchases").filter(F.col("ym") == "1998-01")
    assert back.count() == p.filter(F.col("ym") == "1998-01").count()
    write_json(p.limit(3), os.path.join(tmpdir_path, "j"))
    assert spark.read.json(os.path.join(tmpdir_path, "j")).count() == 3


def test_models_train_save_load_and_score(spark, tmpdir_path):  # G5-G7, S10
    views = fixture_views(spark, SF_SMALL)
    vs = ops.vendor_summary_from(views, sort=False)
    models, metrics = train_models(views["purchases"], vs, n=100_000, max_iter=5)
    m = metrics.first()
    assert 0.0 < m.r2 <= 1.0 and m.mae >= 0 and m.rmse >= m.mae * 0.99
    assert 0.5 < m.accuracy <= 1.0 and m.test_rows > 0  # test_exactness holds it against the majority
    save_models(models, metrics, tmpdir_path)
    loaded, lm = load_models(spark, tmpdir_path)
    assert lm.first().r2 == m.r2
    orders = views["orders_to_score"]
    a = score_orders(orders, vs, models, keep=["order_key", "line_number", "part_key"])
    b = score_orders(orders, vs, loaded, keep=["order_key", "line_number", "part_key"])
    assert a.count() == orders.count()
    assert a.exceptAll(b).count() == 0
    row = a.first()
    assert row.predicted_lead_time_days >= 1.0 and 0.0 <= row.delay_probability_pct <= 100.0
    assert row.risk_level in {"HIGH RISK", "MODERATE RISK", "LOW RISK"}


def test_etl_on_stored_purchases_equals_views(spark, tmpdir_path):
    stored = run_etl(spark, fixture_etl_sources(spark, SF_SMALL), tmpdir_path, "1998-01-01",
                     "1998-12-31", materialize_purchases=False)
    a = stored["vendor_summary"].drop("StdLeadTimeDays", "AvgSalesUnitPrice")
    b = ops.vendor_summary_from(fixture_views(spark, SF_SMALL)).drop("StdLeadTimeDays",
                                                                     "AvgSalesUnitPrice")
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_training_on_csv_inputs_without_line_numbers(spark, tmpdir_path):
    views = fixture_views(spark, SF_SMALL)
    p = views["purchases"].drop("LineNumber")
    p.write.mode("overwrite").option("header", True).csv(os.path.join(tmpdir_path, "purchases.csv"))
    for n in ("vendor_invoice", "sales", "begin_inventory", "end_inventory", "purchase_prices"):
        views[n].write.mode("overwrite").option("header", True).csv(
            os.path.join(tmpdir_path, f"{n}.csv"))
    src = load_sources(spark, tmpdir_path, "csv")
    vs = ops.vendor_summary_from(src, sort=False)
    models, metrics = train_models(src["purchases"], vs, n=2000, max_iter=3)
    assert metrics.first().test_rows > 0 and set(models) == {"reg", "cls"}


def test_json_keeps_missing_values_as_null(spark, tmpdir_path):  # S5
    df = spark.createDataFrame([(1, None), (2, 3.5)], "k long, v double")
    write_json(df, os.path.join(tmpdir_path, "j"))
    text = "".join(r.value for r in spark.read.text(os.path.join(tmpdir_path, "j")).collect())
    assert '"v":null' in text


def test_load_sources_parquet_casts_to_schema(spark, tmpdir_path):  # S1 (any format)
    views = fixture_views(spark, SF_SMALL)
    for n in ("purchases", "vendor_invoice", "sales", "begin_inventory", "end_inventory",
              "purchase_prices"):
        views[n].write.mode("overwrite").parquet(os.path.join(tmpdir_path, f"{n}.parquet"))
    src = load_sources(spark, tmpdir_path, "parquet", register_views=False)
    assert src["purchases"].schema["Store"].dataType.typeName() == "integer"
    assert "LineNumber" not in src["purchases"].columns
    assert src["sales"].count() == views["sales"].count()


def test_command_line_jobs(spark, tmpdir_path, capsys):
    from supplyscope.plans import etl, scoring, training
    views = fixture_views(spark, SF_SMALL)
    inputs = os.path.join(tmpdir_path, "in")
    for n in ("purchases", "vendor_invoice", "sales", "begin_inventory", "end_inventory",
              "purchase_prices"):
        df = views[n].drop("LineNumber") if n == "purchases" else views[n]
        df.write.mode("overwrite").option("header", True).csv(os.path.join(inputs, f"{n}.csv"))
    views["orders_to_score"].drop("order_key", "line_number", "part_key").write \
        .mode("overwrite").option("header", True).csv(os.path.join(tmpdir_path, "orders"))
    results, models = os.path.join(tmpdir_path, "results"), os.path.join(tmpdir_path, "models")
    etl.main([inputs, results, "--from", "1998-01-01", "--to", "1998-12-31"])
    assert "vendors=" in capsys.readouterr().out
    training.main([inputs, results, models, "--rounds", "3", "--sample", "3000"])
    assert "accuracy=" in capsys.readouterr().out
    out = os.path.join(tmpdir_path, "scored")
    scoring.main([os.path.join(tmpdir_path, "orders"), results, out, "--models", models])
    scored = spark.read.parquet(out)
    assert scored.count() == views["orders_to_score"].count()
    assert scored.filter("predicted_lead_time_days < 1").count() == 0
