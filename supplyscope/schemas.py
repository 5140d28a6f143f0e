"""Explicit schemas of the six inputs (no inference pass, no type flips)."""

from pyspark.sql import types as T

PURCHASES = T.StructType([
    T.StructField("VendorNumber", T.LongType()),
    T.StructField("VendorName", T.StringType()),
    T.StructField("PONumber", T.LongType()),
    T.StructField("Brand", T.LongType()),
    T.StructField("Description", T.StringType()),
    T.StructField("Store", T.IntegerType()),
    T.StructField("Classification", T.IntegerType()),
    T.StructField("Quantity", T.DoubleType()),
    T.StructField("Dollars", T.DoubleType()),
    T.StructField("PurchasePrice", T.DoubleType()),
    T.StructField("PODate", T.DateType()),
    T.StructField("ReceivingDate", T.DateType()),
])

VENDOR_INVOICE = T.StructType([
    T.StructField("VendorNumber", T.LongType()),
    T.StructField("InvoiceDate", T.DateType()),
    T.StructField("PayDate", T.DateType()),
    T.StructField("Dollars", T.DoubleType()),
    T.StructField("Freight", T.DoubleType()),
])

SALES = T.StructType([
    T.StructField("VendorNo", T.LongType()),
    T.StructField("SalesQuantity", T.DoubleType()),
    T.StructField("SalesDollars", T.DoubleType()),
    T.StructField("SalesPrice", T.DoubleType()),
    T.StructField("ExciseTax", T.DoubleType()),
])

INVENTORY = T.StructType([
    T.StructField("Brand", T.LongType()),
    T.StructField("onHand", T.LongType()),
    T.StructField("Price", T.DoubleType()),
])

PURCHASE_PRICES = T.StructType([
    T.StructField("Brand", T.LongType()),
    T.StructField("VendorNumber", T.LongType()),
])

ORDERS_TO_SCORE = T.StructType([
    T.StructField("vendor_number", T.LongType()),
    T.StructField("store", T.IntegerType()),
    T.StructField("classification", T.IntegerType()),
    T.StructField("quantity", T.DoubleType()),
    T.StructField("purchase_price", T.DoubleType()),
    T.StructField("dollars", T.DoubleType()),
    T.StructField("po_month", T.IntegerType()),
    T.StructField("po_day_of_week", T.IntegerType()),
])

EXEC_SUMMARY = T.StructType([
    T.StructField("total_vendors", T.LongType()),
    T.StructField("total_spend", T.DoubleType()),
    T.StructField("total_sales", T.DoubleType()),
    T.StructField("gross_profit", T.DoubleType()),
    T.StructField("overall_margin_pct", T.DoubleType()),
    T.StructField("avg_lead_time_days", T.DoubleType()),
    T.StructField("total_freight", T.DoubleType()),
    T.StructField("overall_freight_ratio", T.DoubleType()),
    T.StructField("tier_counts", T.MapType(T.StringType(), T.LongType())),
])

SOURCES = {
    "purchases": PURCHASES,
    "vendor_invoice": VENDOR_INVOICE,
    "sales": SALES,
    "begin_inventory": INVENTORY,
    "end_inventory": INVENTORY,
    "purchase_prices": PURCHASE_PRICES,
}
