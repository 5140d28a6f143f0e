"""Readers: the six CSV inputs (S1, S2), stand-in views on the driver tables (S3), and
re-reads of stored result tables (S7-S9)."""

from __future__ import annotations

import math
import os
from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schemas
from ..functions import exact_sum
from ..session import materialize, tasks_for
from .versions import current

# Driver (star-schema) tables read by the stand-in views, with the columns they use.  Declaring
# the read schema skips the footer-reading inference job per table and prunes at the scan.
_L, _I, _D, _S, _TS = T.LongType(), T.IntegerType(), T.DoubleType(), T.StringType(), \
    T.TimestampNTZType()
DRIVER_SCHEMAS = {
    "supplier": T.StructType([T.StructField("s_suppkey", _L), T.StructField("s_name", _S)]),
    "part": T.StructType([T.StructField("p_partkey", _L), T.StructField("p_name", _S),
                          T.StructField("p_size", _I), T.StructField("p_retailprice", _D)]),
    "orders": T.StructType([T.StructField("o_orderkey", _L), T.StructField("o_custkey", _L),
                            T.StructField("o_orderdate", _TS)]),
    "lineitem": T.StructType([T.StructField(n, t) for n, t in (
        ("l_orderkey", _L), ("l_partkey", _L), ("l_suppkey", _L), ("l_linenumber", _I),
        ("l_quantity", _D), ("l_extendedprice", _D), ("l_discount", _D), ("l_tax", _D))]),
}
DRIVER_TABLES = tuple(DRIVER_SCHEMAS)
#: Lines of a share of the stand-ins (``fixture_shares``).
SHARE_ROWS = 32_000_000


def cell_text(c, kind: T.DataType):
    """A text cell as it is cast to ``kind``: trimmed, empty is missing, and whole numbers may be written
    as 12.0, as a float column would be.  Strings stay as they are."""
    if isinstance(kind, T.StringType):
        return c
    text = F.trim(c)
    text = F.when(text != "", text)
    return F.regexp_replace(text, r"\.0*$", "") if isinstance(kind, T.IntegralType) else text


def _conform(df: DataFrame, schema: T.StructType, what: str, optional: bool = False) -> DataFrame:
    """The schema's columns of ``df`` by name, cast to its types; NaN becomes missing.

    Other columns are ignored.  An absent column raises, or with ``optional`` is missing in every
    row.  A text that isn't a value of its type fails the query (ANSI cast); empty text is missing."""
    absent = [f.name for f in schema.fields if f.name not in df.columns]
    if absent and not optional:
        raise ValueError(f"{what} has no column {', '.join(absent)}")
    out = []
    for f in schema.fields:
        c = F.lit(None) if f.name in absent else F.col(f"`{f.name}`")
        if f.name not in absent and isinstance(df.schema[f.name].dataType, T.StringType):
            c = cell_text(c, f.dataType)
        c = c.cast(f.dataType)
        if isinstance(f.dataType, T.DoubleType):
            c = F.nanvl(c, F.lit(None).cast("double"))
        out.append(c.alias(f.name))
    return df.select(*out)


def read_csv_by_name(spark: SparkSession, path: str, schema: T.StructType,
                     optional: bool = False) -> DataFrame:
    """A CSV file with a header, its columns found by name.

    All columns are read as text (no inference pass; only the used ones are parsed) and cast.  Files of
    one folder that order their columns differently are not one table for Spark; ``read_csv_folder`` takes them."""
    return _conform(spark.read.option("header", True).option("mode", "FAILFAST").csv(path),
                    schema, path, optional)


def load_sources(spark: SparkSession, path: str, fmt: str = "csv",
                 register_views: bool = True, rejected: dict | None = None) -> dict[str, DataFrame]:
    """Read the six inputs ``<path>/<name>.<fmt>``, columns by name, with fixed types.

    CSV files carry a header row; dates are ``yyyy-MM-dd``.  Each input is also registered as a
    temporary view of the same name so SQL users can query it.

    Given a dict ``rejected``, CSV inputs may be folders whose files order their columns differently, and
    the rows that can't be read are put there by input, instead of failing the query (``read_csv_folder``)."""
    from .folders import read_csv_folder
    out = {}
    for name, schema in schemas.SOURCES.items():
        p = os.path.join(path, f"{name}.{fmt}")
        if fmt == "csv" and rejected is not None:
            df, rejected[name] = read_csv_folder(spark, p, schema)
        else:
            df = (read_csv_by_name(spark, p, schema) if fmt == "csv"
                  else _conform(spark.read.format(fmt).load(p), schema, p))
        if register_views:
            df.createOrReplaceTempView(name)
        out[name] = df
    return out


def read_training_purchases(spark: SparkSession, path: str, fmt: str = "csv") -> DataFrame:
    """Direct scan of the purchases file for training, projected to what training reads."""
    cols = ["VendorNumber", "Store", "Classification", "Quantity", "PurchasePrice", "Dollars",
            "PODate", "ReceivingDate", "PONumber", "Brand"]
    p = os.path.join(path, f"purchases.{fmt}")
    df = (read_csv_by_name(spark, p, schemas.PURCHASES) if fmt == "csv"
          else _conform(spark.read.format(fmt).load(p), schemas.PURCHASES, p))
    return df.select(*cols)


def read_orders(spark: SparkSession, path: str, fmt: str = "csv") -> DataFrame:
    """Orders to score; columns that the file lacks are missing in every row (defaults apply)."""
    if fmt == "csv":
        return read_csv_by_name(spark, path, schemas.ORDERS_TO_SCORE, optional=True)
    return _conform(spark.read.format(fmt).load(path), schemas.ORDERS_TO_SCORE, path, optional=True)


def driver_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return {t: spark.read.schema(schema).parquet(os.path.join(sf_dir, f"{t}.parquet"))
            for t, schema in DRIVER_SCHEMAS.items()}


class LazyViews(Mapping):
    """A read-only mapping whose DataFrames are built on first access (each build is a few
    DataFrame calls on the driver; a query touching two views pays for two)."""

    def __init__(self, builders: dict[str, Callable[[], DataFrame]]):
        self._builders, self._built = builders, {}

    def __getitem__(self, k: str) -> DataFrame:
        if k not in self._built:
            self._built[k] = self._builders[k]()
        return self._built[k]

    def __iter__(self):
        return iter(self._builders)

    def __len__(self) -> int:
        return len(self._builders)


def _cents(c):
    return F.rint(F.col(c) * 100).cast("long")


def _purchase_price(price_col: str, qty_col: str):
    # round(price / qty, 2), half-up, computed on whole cents so every engine agrees
    cents, q = _cents(price_col), F.col(qty_col).cast("long")
    return F.when(q > 0, F.floor((cents * 2 + q) / (q * 2)) / 100.0)


def fixture_views(spark: SparkSession, sf_dir: str, register_views: bool = False,
                  purchases: DataFrame | None = None, share: tuple[int, int] | None = None) -> Mapping[str, DataFrame]:
    """Stand-ins for the six inputs (plus orders to score) derived from the driver tables (S3).

    The mapping is documented in FIXTURES.md §2.  Keys stay ``long``; quantities ``double``.
    Dates in the driver data are random, so receipt, invoice and pay dates are deterministic
    functions of the keys.  ``purchases`` replaces the purchases stand-in (e.g. a stored copy)
    and the invoice stand-in is then derived from it.  ``share`` (a number, out of how many) takes the lines
    and orders of one share of the orders.  Views are built on first access.

    Lines meet their orders last, dealt by the order into tasks of a bounded number of lines (``tasks_for``):
    merged shuffle partitions hold more lines the larger the tables are, and sorting them and grouping them by
    vendor and PO took memory in proportion.  The groups of an order are whole in its task."""
    t = driver_tables(spark, sf_dir)
    if share is not None:
        number, shares = share
        t |= {name: t[name].where(F.pmod(F.xxhash64(key), F.lit(shares)) == number)
              for name, key in (("lineitem", "l_orderkey"), ("orders", "o_orderkey"))}
    po_date = F.col("o_orderdate").cast("date")
    store = (F.col("o_custkey") % 80 + 1).cast("int")
    klass = (F.col("p_size") % 2 + 1).cast("int")

    def with_orders(lines: DataFrame) -> DataFrame:
        tasks, o = tasks_for(t["lineitem"]), t["orders"]
        return (lines.repartition(tasks, "l_orderkey")
                .join(o.repartition(tasks, "o_orderkey"), F.col("l_orderkey") == F.col("o_orderkey"), "inner"))

    def build_purchases() -> DataFrame:
        if purchases is not None:
            return purchases
        li, sup, part = t["lineitem"], t["supplier"], t["part"]
        lead = (F.lit(1) + F.col("l_suppkey") % 12 + F.col("l_linenumber") % 3).cast("int")
        described = (li.join(sup, li.l_suppkey == sup.s_suppkey, "inner")
                     .join(part, li.l_partkey == part.p_partkey, "inner"))
        return (with_orders(described)
                .select(
                    F.col("l_suppkey").alias("VendorNumber"),
                    F.col("s_name").alias("VendorName"),
                    F.col("l_orderkey").alias("PONumber"),
                    F.col("l_partkey").alias("Brand"),
                    F.col("p_name").alias("Description"),
                    F.col("l_linenumber").alias("LineNumber"),
                    store.alias("Store"),
                    klass.alias("Classification"),
                    F.col("l_quantity").alias("Quantity"),
                    F.col("l_extendedprice").alias("Dollars"),
                    _purchase_price("l_extendedprice", "l_quantity").alias("PurchasePrice"),
                    po_date.alias("PODate"),
                    F.when(F.col("l_orderkey") % 101 == 0, F.lit(None).cast("date"))
                     .otherwise(F.date_add(po_date, lead)).alias("ReceivingDate")))

    def build_invoice() -> DataFrame:
        first_po = F.min("PODate")
        lines = views["purchases"]
        if purchases is not None:
            lines = lines.repartition(tasks_for(lines), "PONumber")
        return (lines.filter(F.col("VendorNumber") % 17 != 0)
                .groupBy("VendorNumber", "PONumber")
                .agg(F.date_add(first_po, 7).alias("InvoiceDate"),
                     F.date_add(first_po, (F.col("VendorNumber") % 10 + 37).cast("int"))
                      .alias("PayDate"),
                     exact_sum("Dollars").alias("Dollars"))
                .select("VendorNumber", "InvoiceDate", "PayDate", "Dollars",
                        (F.col("Dollars") * (F.col("VendorNumber") % 5) * 0.005)
                        .alias("Freight")))

    def build_sales() -> DataFrame:
        k6 = (F.col("l_suppkey") % 6).cast("double")
        sales_dollars = (F.col("l_extendedprice") * (1 - F.col("l_discount"))
                         * (F.lit(1.0) + k6 * 0.25))
        return (t["lineitem"].filter(F.col("l_suppkey") % 13 != 0)
                .select(F.col("l_suppkey").alias("VendorNo"),
                        F.col("l_quantity").alias("SalesQuantity"),
                        sales_dollars.alias("SalesDollars"),
                        (sales_dollars / F.col("l_quantity")).alias("SalesPrice"),
                        (F.col("l_extendedprice") * F.col("l_tax")).alias("ExciseTax")))

    def build_prices() -> DataFrame:
        n_suppliers = t["supplier"].select(F.count(F.lit(1))).scalar()
        return (t["part"].filter(F.col("p_partkey") % 100 != 7)
                .select(F.col("p_partkey").alias("Brand"),
                        (F.col("p_partkey") % n_suppliers).alias("VendorNumber")))

    def build_inventory(on_hand) -> Callable[[], DataFrame]:
        return lambda: t["part"].select(F.col("p_partkey").alias("Brand"),
                                        on_hand.cast("long").alias("onHand"),
                                        F.col("p_retailprice").alias("Price"))

    def build_orders() -> DataFrame:
        li, part = t["lineitem"], t["part"]
        return (with_orders(li.join(part, li.l_partkey == part.p_partkey, "inner"))
                .select(F.col("l_suppkey").alias("vendor_number"),
                        store.alias("store"),
                        klass.alias("classification"),
                        F.col("l_quantity").alias("quantity"),
                        _purchase_price("l_extendedprice", "l_quantity").alias("purchase_price"),
                        F.lit(None).cast("double").alias("dollars"),
                        F.month(po_date).alias("po_month"),
                        (F.dayofweek(po_date) - 1).alias("po_day_of_week"),
                        F.col("l_orderkey").alias("order_key"),
                        F.col("l_linenumber").alias("line_number"),
                        F.col("l_partkey").alias("part_key")))

    views = LazyViews({
        "purchases": build_purchases, "vendor_invoice": build_invoice, "sales": build_sales,
        "begin_inventory": build_inventory(F.col("p_size")),
        "end_inventory": build_inventory((F.col("p_size") * 7) % 50),
        "purchase_prices": build_prices, "orders_to_score": build_orders})
    if register_views:
        for k in views:
            views[k].createOrReplaceTempView(k)
    return views


def fixture_shares(spark: SparkSession, sf_dir: str) -> list[Mapping[str, DataFrame]]:
    """The stand-ins once for each share of the orders, of about ``SHARE_ROWS`` lines at most.  All shares
    together hold each purchase, invoice and sale once; one share's joins take disk for its lines alone."""
    shares = max(1, math.ceil(driver_tables(spark, sf_dir)["lineitem"].count() / SHARE_ROWS))
    return [fixture_views(spark, sf_dir, share=(i, shares) if shares > 1 else None) for i in range(shares)]


def fixture_etl_sources(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Stand-ins for ``run_etl``: the purchases join is written once to the checkpoint folder
    and every view derived from purchases reads that copy."""
    stored = materialize(fixture_views(spark, sf_dir)["purchases"], "purchases", spark)
    return fixture_views(spark, sf_dir, purchases=stored)


def read_table(spark: SparkSession, path: str, name: str, columns: list[str] | None = None,
               fmt: str = "parquet") -> DataFrame:
    """Re-read a stored result table whole (S7) or projected (S8; pruned at the scan)."""
    df = spark.read.format(fmt).load(current(spark, os.path.join(path, name)))
    return df.select(*columns) if columns else df


def read_summary(spark: SparkSession, path: str) -> DataFrame:
    """Re-read the stored executive summary."""
    return spark.read.schema(schemas.EXEC_SUMMARY).json(current(spark, os.path.join(path, "exec_summary")))
