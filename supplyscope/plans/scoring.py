"""Bulk order scoring (G7): predicted lead time, delay probability and a risk class per order.

The original scored one order per request; here a whole table of proposed orders is scored
in one job.  The vendor history lookup is a left join of the orders with the per-vendor
scorecard columns, which are stored first: the planner knows the stored table's size and broadcasts
it under the threshold, so that the orders are not shuffled; beyond it the join is sort-merge.
"""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schemas
from ..functions import round1
from .training import predict, vendor_history

# Fixed values that must equal the original job ------------------------------------------
ORDER_DEFAULTS = {"vendor_number": 12546, "store": 1, "classification": 1, "quantity": 100.0,
                  "purchase_price": 15.0, "po_month": 6, "po_day_of_week": 2}
HISTORY_DEFAULTS = {"AvgLeadTimeDays": 7.5, "LateDeliveryRate": 5.0, "VPIScore": 70.0}
RULE_DAYS_PER_UNIT = 0.0001
RULE_DELAY_PER_DAY = 3.0
RULE_DELAY_CAP = 95.0
MIN_PREDICTED_DAYS = 1.0
# (delay % above, days above, level, badge, advice), checked in order; else the last row.
RISK_CLASSES = (
    (60.0, 12.0, "HIGH RISK", "risk-high",
     "Order placement requires expedited shipping buffer and vendor follow-up. "
     "Consider safety stock allocation."),
    (30.0, 8.0, "MODERATE RISK", "risk-medium",
     "Standard monitoring recommended. Lead time matches vendor baseline."),
    (None, None, "LOW RISK", "risk-low",
     "Optimal delivery conditions expected. High confidence on-time fulfillment."),
)
# ------------------------------------------------------------------------------------------


def with_order_defaults(orders: DataFrame) -> DataFrame:
    """Fill missing inputs, absent columns among them; dollars defaults to quantity × price."""
    orders = orders.withColumns({f.name: F.lit(None).cast(f.dataType)
                                 for f in schemas.ORDERS_TO_SCORE.fields
                                 if f.name not in orders.columns})
    nan = {f.name: F.nanvl(f.name, F.lit(None).cast("double")) for f in orders.schema.fields
           if f.dataType.typeName() == "double"}
    orders = orders.withColumns(nan)
    filled = orders.withColumns({k: F.coalesce(F.col(k), F.lit(v)).cast(
        "double" if isinstance(v, float) else orders.schema[k].dataType)
        for k, v in ORDER_DEFAULTS.items()})
    return filled.withColumn("dollars", F.coalesce(F.col("dollars").cast("double"),
                                                   F.col("quantity") * F.col("purchase_price")))


def with_vendor_history(orders: DataFrame, vs: DataFrame) -> DataFrame:
    """Vendor lead time, late rate and score; an unknown vendor gets the defaults."""
    hist = vendor_history(vs)
    j = orders.join(hist, orders["vendor_number"] == hist["_vn"], "left").drop("_vn")
    return j.withColumns({k: F.coalesce(F.col(k).cast("double"), F.lit(v))
                          for k, v in HISTORY_DEFAULTS.items()})


def _risk(prob, days, field: int):
    expr = None
    for p_hi, d_hi, *vals in RISK_CLASSES:
        if p_hi is None:
            return expr.otherwise(F.lit(vals[field]))
        cond = (prob > p_hi) | (days > d_hi)
        expr = F.when(cond, F.lit(vals[field])) if expr is None else expr.when(cond, F.lit(vals[field]))
    return expr


def _finish(df: DataFrame, days: F.Column, prob: F.Column) -> DataFrame:
    """Risk class, badge, advice and the echoed inputs."""
    d = df.withColumns({"predicted_lead_time_days": days, "_prob": prob})
    pd_, pr = F.col("predicted_lead_time_days"), F.col("_prob")
    return d.withColumns({
        "delay_probability_pct": round1(pr),
        "risk_level": _risk(pr, pd_, 0),
        "badge_class": _risk(pr, pd_, 1),
        "recommendation": _risk(pr, pd_, 2),
        "total_dollars": F.col("dollars"),
        "vendor_historical_avg_lt": round1(F.col("AvgLeadTimeDays")),
    }).drop("_prob")


def from_predictions(df: DataFrame, days, probability) -> DataFrame:
    """Scored orders from predicted days and the probability (0 to 1) of a delay."""
    return _finish(df, F.greatest(F.lit(MIN_PREDICTED_DAYS), round1(days)), probability * 100.0)


def _as_features(df: DataFrame) -> DataFrame:
    return df.withColumns({
        "VendorNumber": F.col("vendor_number"), "Store": F.col("store"),
        "Classification": F.col("classification"), "Quantity": F.col("quantity"),
        "PurchasePrice": F.col("purchase_price"), "Dollars": F.col("dollars"),
        "POMonth": F.col("po_month"), "PODayOfWeek": F.col("po_day_of_week")})


OUTPUT = ["predicted_lead_time_days", "delay_probability_pct", "risk_level", "badge_class",
          "recommendation", "vendor_number", "store", "quantity", "total_dollars",
          "vendor_historical_avg_lt"]


def score_orders(orders: DataFrame, vs: DataFrame, models: dict | None = None,
                 keep: list[str] | None = None) -> DataFrame:
    """Score every order (G7).  With ``models`` the two pipelines predict (G7a); without, the
    rule of thumb applies (G7b).  ``keep`` lists input columns to carry through (e.g. keys)."""
    base = with_vendor_history(with_order_defaults(orders), vs)
    if models is not None:
        absent = {"reg", "cls"} - set(models)
        if absent:
            raise ValueError(f"models lack {', '.join(sorted(absent))}; pass None for the rule of thumb")
        scored = predict(models, _as_features(base))
        out = from_predictions(scored, F.col("pred_days"), vector_to_array(F.col("prob_delay"))[1])
    else:
        days = round1(F.col("AvgLeadTimeDays") + F.col("quantity") * RULE_DAYS_PER_UNIT)
        base = base.withColumn("_days", days)
        prob = F.least(F.lit(RULE_DELAY_CAP),
                       round1(F.col("LateDeliveryRate") + F.col("_days") * RULE_DELAY_PER_DAY))
        out = _finish(base, F.col("_days"), prob)
    return out.select(*(keep or []), *OUTPUT)


def main(argv: list[str] | None = None) -> None:
    """``python -m supplyscope.plans.scoring ORDERS RESULTS OUT [--models M] [--format csv]``

    Scores a table of proposed orders (columns of ``schemas.ORDERS_TO_SCORE``; missing ones
    take the defaults) with the saved models, or with the rule of thumb without ``--models``."""
    import argparse

    from ..session import build_session, run_folder
    from ..sources import read_orders, read_table
    from .training import load_models

    ap = argparse.ArgumentParser(prog="python -m supplyscope.plans.scoring")
    ap.add_argument("orders")
    ap.add_argument("results")
    ap.add_argument("out")
    ap.add_argument("--models", default=None)
    ap.add_argument("--format", default="csv")
    ap.add_argument("--shuffle-partitions", type=int, default=None)
    a = ap.parse_args(argv)
    spark = build_session(shuffle_partitions=a.shuffle_partitions)
    orders = read_orders(spark, a.orders, a.format)
    vs = read_table(spark, a.results, "vendor_summary")
    models = load_models(spark, a.models)[0] if a.models else None
    print(f"scored by {'the saved models' if models else 'the rule of thumb'}")
    with run_folder(spark, "scoring"):
        score_orders(orders, vs, models).write.mode("overwrite").parquet(a.out)


if __name__ == "__main__":
    main()
