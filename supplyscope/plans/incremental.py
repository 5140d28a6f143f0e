"""Scorecards from loads: each load's states are stored once, and history isn't read again.

A load is a batch of purchase lines, invoices and sales (inventory and prices are snapshots, of which the
latest counts).  ``store_load`` reads the batch once and stores its mergeable states under the load's
name; storing a load again replaces it, so a repeated run counts nothing twice.  ``scorecard`` and
``tables`` merge the states of all loads: the same bits as one load of everything, whatever the number and
order of the loads, as all states are integers, maxima and minima."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators import states
from ..operators.metrics import inventory_metrics_both, tables_of, with_late_rate
from ..operators.scorecard import scorecard_of
from ..sources.versions import current, names, write_version

KINDS = ("purchases", "invoices", "sales")


def store_load(path: str, load: str, purchases: DataFrame, vendor_invoice: DataFrame, sales: DataFrame,
               date_from: str = "2024-01-01", date_to: str = "2024-12-31") -> None:
    """Store one load's states under ``path``; the date window is that of the monthly trends and has to be
    the same for all loads."""
    found = {"purchases": states.purchase_states(purchases, list(states.GRAINS), date_from, date_to),
             "invoices": states.invoice_states(vendor_invoice), "sales": states.sales_states(sales)}
    for kind in KINDS:
        write_version(found[kind], f"{path}/{kind}/{load}")


def loads(spark: SparkSession, path: str) -> list[str]:
    """The loads whose states of every kind are stored; one that broke off midway isn't among them."""
    whole = [{n for n in names(spark, f"{path}/{kind}") if names(spark, f"{path}/{kind}/{n}/_commits")} for kind in KINDS]
    return sorted(set.intersection(*whole))


def _stored(spark: SparkSession, path: str, kind: str) -> DataFrame:
    found = loads(spark, path)
    if not found:
        raise FileNotFoundError(f"no load is stored under {path}")
    return spark.read.parquet(*[current(spark, f"{path}/{kind}/{load}") for load in found])


def tables(spark: SparkSession, path: str, top: int = 100) -> dict[str, DataFrame]:
    """Purchase metrics, monthly trends and top brands of all loads."""
    return tables_of(distinct_states(_stored(spark, path, "purchases")), top)


def distinct_states(stored: DataFrame) -> DataFrame:
    """States of all loads as one: a PO, name or brand that several loads have is one row again."""
    return states.merged(stored)


def scorecard(spark: SparkSession, path: str, begin_inventory: DataFrame, end_inventory: DataFrame,
              purchase_prices: DataFrame, sort: bool = True) -> DataFrame:
    """The vendor scorecard of all loads with the given inventory snapshots."""
    held = distinct_states(_stored(spark, path, "purchases"))
    return scorecard_of(with_late_rate(states.vendor_table(held)),
                        states.invoice_table(_stored(spark, path, "invoices")),
                        states.sales_table(_stored(spark, path, "sales")),
                        inventory_metrics_both(begin_inventory, end_inventory, purchase_prices), sort=sort)
