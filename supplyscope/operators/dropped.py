"""Counts of the rows that filters leave out (P1, P2, P4, P5), taken in the job that reads the rows.

``observed`` hangs an Observation on an input: Spark counts while another action reads it, so no pass of
its own is needed.  A condition that is missing for a row leaves the row out, as in a filter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions import days_between

# Fixed values that must equal the original job: the longest lead time that training takes.
LONGEST_LEAD_DAYS = 60


def _present(*names: str) -> Column:
    c = F.col(names[0]).isNotNull()
    for n in names[1:]:
        c = c & F.col(n).isNotNull()
    return c


def conditions(table: str) -> dict[str, Column]:
    """The filters of a table's consumers by name; each is judged on all rows."""
    if table == "vendor_invoice":
        return {"dated": _present("InvoiceDate", "PayDate")}
    lead = days_between("PODate", "ReceivingDate")
    return {"dated": _present("PODate", "ReceivingDate"),
            "positive": (F.col("Quantity") > 0) & (F.col("Dollars") > 0),
            "lead_time_in_range": lead.between(0, LONGEST_LEAD_DAYS)}


def observed(df: DataFrame, table: str) -> tuple[DataFrame, Observation]:
    """``df`` with its counts, which are there once an action has read it."""
    seen = Observation(f"dropped-{table}")
    counts = [F.count(F.lit(1)).alias("rows")]
    counts += [F.count_if(~F.coalesce(c, F.lit(False))).alias(name) for name, c in conditions(table).items()]
    return df.observe(seen, *counts), seen


def counts_table(spark: SparkSession, seen: dict[str, Observation]) -> DataFrame:
    """input, filter, rows_in, rows_dropped: a row for each filter of each observed input."""
    rows = []
    for table, observation in seen.items():
        got = observation.get
        rows += [(table, name, got["rows"], got[name]) for name in conditions(table)]
    return spark.createDataFrame(rows, "input string, filter string, rows_in long, rows_dropped long")
