"""DuckDB oracle SQL for every query in ``__spark_entry__.queries()``.

Each string runs on the driver tables (pre-registered views) and first rebuilds the stand-in
inputs of FIXTURES.md §2 as CTEs.  Money sums are added as decimals on both sides so the two
engines agree to the last bit; values whose last bits depend on the summation algorithm
(sample standard deviation, means of unrounded doubles) are rounded to 6 decimals on both
sides, as noted per query.
"""

from __future__ import annotations

# Lines that the sampling queries draw; fewer than the stand-in has at every scale from 0.01 on.
SAMPLE_N = 10_000
MONTH_FROM, MONTH_TO = "1998-01-01", "1998-12-31"

STANDINS = """
purchases AS (
  SELECT l.l_suppkey AS VendorNumber, s.s_name AS VendorName, l.l_orderkey AS PONumber,
         l.l_partkey AS Brand, p.p_name AS Description, l.l_linenumber AS LineNumber,
         CAST(o.o_custkey % 80 + 1 AS INTEGER) AS Store,
         CAST(p.p_size % 2 + 1 AS INTEGER) AS Classification,
         l.l_quantity AS Quantity, l.l_extendedprice AS Dollars,
         CASE WHEN CAST(l.l_quantity AS BIGINT) > 0 THEN
           floor((CAST(round(l.l_extendedprice * 100) AS BIGINT) * 2 + CAST(l.l_quantity AS BIGINT))
                 / (CAST(l.l_quantity AS BIGINT) * 2)) / 100.0 END AS PurchasePrice,
         CAST(o.o_orderdate AS DATE) AS PODate,
         CASE WHEN l.l_orderkey % 101 = 0 THEN NULL
              ELSE CAST(o.o_orderdate AS DATE)
                   + CAST(1 + l.l_suppkey % 12 + l.l_linenumber % 3 AS INTEGER) END AS ReceivingDate
  FROM lineitem l
  JOIN orders o ON l.l_orderkey = o.o_orderkey
  JOIN supplier s ON l.l_suppkey = s.s_suppkey
  JOIN part p ON l.l_partkey = p.p_partkey
),
vendor_invoice AS (
  SELECT VendorNumber, InvoiceDate, PayDate, Dollars,
         Dollars * (VendorNumber % 5) * 0.005 AS Freight
  FROM (SELECT VendorNumber, PONumber, min(PODate) + 7 AS InvoiceDate,
               min(PODate) + CAST(VendorNumber % 10 + 37 AS INTEGER) AS PayDate,
               CAST(SUM(CAST(Dollars AS DECIMAL(18,2))) AS DOUBLE) AS Dollars
        FROM purchases WHERE VendorNumber % 17 <> 0 GROUP BY VendorNumber, PONumber)
),
sales AS (
  SELECT l_suppkey AS VendorNo, l_quantity AS SalesQuantity,
         l_extendedprice * (1 - l_discount) * (1.0 + CAST(l_suppkey % 6 AS DOUBLE) * 0.25) AS SalesDollars,
         l_extendedprice * (1 - l_discount) * (1.0 + CAST(l_suppkey % 6 AS DOUBLE) * 0.25) / l_quantity AS SalesPrice,
         l_extendedprice * l_tax AS ExciseTax
  FROM lineitem WHERE l_suppkey % 13 <> 0
),
purchase_prices AS (
  SELECT p_partkey AS Brand, p_partkey % (SELECT count(*) FROM supplier) AS VendorNumber
  FROM part WHERE p_partkey % 100 <> 7
),
begin_inventory AS (
  SELECT p_partkey AS Brand, CAST(p_size AS BIGINT) AS onHand, p_retailprice AS Price FROM part
),
end_inventory AS (
  SELECT p_partkey AS Brand, CAST((p_size * 7) % 50 AS BIGINT) AS onHand, p_retailprice AS Price
  FROM part
),
orders_to_score AS (
  SELECT l.l_suppkey AS vendor_number, CAST(o.o_custkey % 80 + 1 AS INTEGER) AS store,
         CAST(p.p_size % 2 + 1 AS INTEGER) AS classification, l.l_quantity AS quantity,
         CASE WHEN CAST(l.l_quantity AS BIGINT) > 0 THEN
           floor((CAST(round(l.l_extendedprice * 100) AS BIGINT) * 2 + CAST(l.l_quantity AS BIGINT))
                 / (CAST(l.l_quantity AS BIGINT) * 2)) / 100.0 END AS purchase_price,
         CAST(NULL AS DOUBLE) AS dollars,
         CAST(month(CAST(o.o_orderdate AS DATE)) AS INTEGER) AS po_month,
         CAST(dayofweek(CAST(o.o_orderdate AS DATE)) AS INTEGER) AS po_day_of_week,
         l.l_orderkey AS order_key, l.l_linenumber AS line_number, l.l_partkey AS part_key
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN part p ON l.l_partkey = p.p_partkey
)"""


def xsum(c: str) -> str:
    return f"CAST(SUM(CAST({c} AS DECIMAL(38,6))) AS DOUBLE)"


def xavg(c: str) -> str:
    return f"({xsum(c)} / COUNT({c}))"


LT = "date_diff('day', PODate, ReceivingDate)"

PURCHASE_METRICS = f"""
SELECT VendorNumber, MAX(VendorName) AS VendorName, COUNT(DISTINCT PONumber) AS TotalPOs,
       COUNT(*) AS TotalPurchaseRecords, CAST(SUM(Quantity) AS DOUBLE) AS TotalUnitsPurchased,
       {xsum('Dollars')} AS TotalSpendDollars, {xavg('PurchasePrice')} AS AvgPurchaseUnitPrice,
       AVG({LT}) AS AvgLeadTimeDays, MAX({LT}) AS MaxLeadTimeDays, MIN({LT}) AS MinLeadTimeDays,
       STDDEV_SAMP({LT}) AS StdLeadTimeDays,
       CAST(SUM(CASE WHEN {LT} > 10 THEN 1 ELSE 0 END) AS BIGINT) AS LateDeliveriesCount,
       CASE WHEN COUNT(*) > 0 THEN CAST(SUM(CASE WHEN {LT} > 10 THEN 1 ELSE 0 END) AS BIGINT)
            / COUNT(*) * 100.0 ELSE 0.0 END AS LateDeliveryRate
FROM purchases WHERE PODate IS NOT NULL AND ReceivingDate IS NOT NULL
GROUP BY VendorNumber"""

INVOICE_METRICS = f"""
SELECT VendorNumber, {xsum('Freight')} AS TotalFreightDollars,
       {xsum('Dollars')} AS TotalInvoiceDollars,
       AVG(date_diff('day', InvoiceDate, PayDate)) AS AvgPaymentLeadTimeDays
FROM vendor_invoice WHERE InvoiceDate IS NOT NULL AND PayDate IS NOT NULL
GROUP BY VendorNumber"""

SALES_METRICS = f"""
SELECT VendorNo AS VendorNumber, CAST(SUM(SalesQuantity) AS DOUBLE) AS TotalUnitsSold,
       {xsum('SalesDollars')} AS TotalSalesDollars, AVG(SalesPrice) AS AvgSalesUnitPrice,
       {xsum('ExciseTax')} AS TotalExciseTaxDollars
FROM sales GROUP BY VendorNo"""


def inventory_sql(table: str, prefix: str) -> str:
    return f"""
SELECT pp.VendorNumber, CAST(SUM(b.onHand) AS DOUBLE) AS {prefix}InventoryUnits,
       CAST(SUM(CAST(b.onHand * b.Price AS DECIMAL(38,6))) AS DOUBLE) AS {prefix}InventoryValue
FROM {table} b JOIN purchase_prices pp ON b.Brand = pp.Brand
GROUP BY pp.VendorNumber"""


MONTHLY_TRENDS = f"""
SELECT strftime(PODate, '%Y-%m') AS YearMonth, COUNT(DISTINCT VendorNumber) AS ActiveVendors,
       CAST(SUM(Quantity) AS DOUBLE) AS MonthlyPurchasedUnits,
       {xsum('Dollars')} AS MonthlySpendDollars, AVG({LT}) AS MonthlyAvgLeadTime
FROM purchases
WHERE PODate IS NOT NULL AND PODate >= DATE '{MONTH_FROM}' AND PODate <= DATE '{MONTH_TO}'
GROUP BY 1 ORDER BY YearMonth"""

BRAND_SUMMARY = f"""
SELECT Brand, MAX(Description) AS Description, MAX(VendorName) AS VendorName,
       MAX(VendorNumber) AS VendorNumber, CAST(SUM(Quantity) AS DOUBLE) AS TotalPurchasedUnits,
       {xsum('Dollars')} AS TotalSpendDollars, {xavg('PurchasePrice')} AS AvgPurchasePrice
FROM purchases GROUP BY Brand"""

TOP_BRANDS = f"""
SELECT * FROM ({BRAND_SUMMARY}) ORDER BY TotalSpendDollars DESC NULLS LAST, Brand LIMIT 100"""

# Rows that filters drop; a missing condition drops its row.
FILTER_COUNTS = " UNION ALL ".join(
    f"SELECT '{table}' AS input, '{name}' AS filter, COUNT(*) AS rows_in, "
    f"COUNT(*) FILTER (WHERE NOT coalesce({condition}, false)) AS rows_dropped FROM {table}"
    for table, name, condition in (
        ("purchases", "dated", "PODate IS NOT NULL AND ReceivingDate IS NOT NULL"),
        ("purchases", "positive", "Quantity > 0 AND Dollars > 0"),
        ("purchases", "lead_time_in_range", f"{LT} BETWEEN 0 AND 60"),
        ("vendor_invoice", "dated", "InvoiceDate IS NOT NULL AND PayDate IS NOT NULL")))

# The three tables of one scan, stacked.
ONE_SCAN_TABLES = f"""
SELECT 'vendor' AS dataset, CAST(VendorNumber AS VARCHAR) AS entity, VendorName AS label, CAST(TotalPOs AS BIGINT) AS counted,
       TotalUnitsPurchased AS units, TotalSpendDollars AS spend, AvgPurchaseUnitPrice AS mean_price,
       AvgLeadTimeDays AS mean_lead_time, round(StdLeadTimeDays, 6) AS std_lead_time FROM ({PURCHASE_METRICS})
UNION ALL
SELECT 'month', YearMonth, NULL, CAST(ActiveVendors AS BIGINT), MonthlyPurchasedUnits, MonthlySpendDollars, NULL,
       MonthlyAvgLeadTime, NULL FROM ({MONTHLY_TRENDS})
UNION ALL
SELECT 'brand', CAST(Brand AS VARCHAR), concat_ws('|', Description, VendorName), CAST(VendorNumber AS BIGINT),
       TotalPurchasedUnits, TotalSpendDollars, AvgPurchasePrice, NULL, NULL FROM ({TOP_BRANDS})"""


# One row per vendor: the full scorecard (K0-K13) as the original job computes it.
VENDOR_SUMMARY_BODY = f"""
pm AS ({PURCHASE_METRICS}),
im AS ({INVOICE_METRICS}),
sm AS ({SALES_METRICS}),
bm AS ({inventory_sql('begin_inventory', 'Begin')}),
em AS ({inventory_sql('end_inventory', 'End')}),
m AS (
  SELECT pm.*,
    COALESCE(im.TotalFreightDollars, 0.0) AS TotalFreightDollars,
    COALESCE(im.TotalInvoiceDollars, 0.0) AS TotalInvoiceDollars,
    COALESCE(im.AvgPaymentLeadTimeDays, 0.0) AS AvgPaymentLeadTimeDays,
    COALESCE(sm.TotalUnitsSold, 0.0) AS TotalUnitsSold,
    COALESCE(sm.TotalSalesDollars, 0.0) AS TotalSalesDollars,
    COALESCE(sm.AvgSalesUnitPrice, 0.0) AS AvgSalesUnitPrice,
    COALESCE(sm.TotalExciseTaxDollars, 0.0) AS TotalExciseTaxDollars,
    COALESCE(bm.BeginInventoryUnits, 0.0) AS BeginInventoryUnits,
    COALESCE(bm.BeginInventoryValue, 0.0) AS BeginInventoryValue,
    COALESCE(em.EndInventoryUnits, 0.0) AS EndInventoryUnits,
    COALESCE(em.EndInventoryValue, 0.0) AS EndInventoryValue
  FROM pm
  LEFT JOIN im ON pm.VendorNumber IS NOT DISTINCT FROM im.VendorNumber
  LEFT JOIN sm ON pm.VendorNumber IS NOT DISTINCT FROM sm.VendorNumber
  LEFT JOIN bm ON pm.VendorNumber IS NOT DISTINCT FROM bm.VendorNumber
  LEFT JOIN em ON pm.VendorNumber IS NOT DISTINCT FROM em.VendorNumber
),
k1 AS (
  SELECT * REPLACE (COALESCE(StdLeadTimeDays, 0.0) AS StdLeadTimeDays,
                    COALESCE(AvgLeadTimeDays, 7.0) AS AvgLeadTimeDays),
    TotalSalesDollars - TotalSpendDollars AS GrossProfitDollars,
    (BeginInventoryValue + EndInventoryValue) / 2.0 AS AvgInventoryValue
  FROM m
),
k2 AS (
  SELECT *,
    CASE WHEN TotalSalesDollars > 0 THEN GrossProfitDollars / TotalSalesDollars * 100.0 ELSE 0.0 END AS GrossMarginPct,
    CASE WHEN TotalSpendDollars > 0 THEN TotalFreightDollars / TotalSpendDollars * 100.0 ELSE 0.0 END AS FreightRatioPct,
    CASE WHEN AvgInventoryValue > 0 THEN TotalSpendDollars / AvgInventoryValue ELSE 0.0 END AS InventoryTurnoverRatio
  FROM k1
),
k3 AS (
  SELECT *,
    CASE WHEN InventoryTurnoverRatio > 0 THEN 365.0 / InventoryTurnoverRatio ELSE 999.0 END AS DaysSalesOfInventory,
    CASE WHEN AvgLeadTimeDays IS NULL OR LateDeliveryRate IS NULL THEN NULL
         ELSE least(greatest(100.0 - (AvgLeadTimeDays * 5 + LateDeliveryRate * 0.5), 0.0), 100.0) END AS LeadTimeScore,
    CASE WHEN GrossMarginPct IS NULL THEN NULL
         ELSE least(greatest(GrossMarginPct * 2.5, 0.0), 100.0) END AS MarginScore,
    CASE WHEN FreightRatioPct IS NULL THEN NULL
         ELSE least(greatest(100.0 - FreightRatioPct * 30, 0.0), 100.0) END AS FreightScore,
    CASE WHEN TotalSpendDollars IS NULL THEN NULL
         ELSE least(greatest(log10(greatest(TotalSpendDollars, 1.0)) / 8.0 * 100, 0.0), 100.0) END AS VolumeScore
  FROM k2
),
k4 AS (
  SELECT *, round_even((LeadTimeScore * 0.3 + MarginScore * 0.3 + FreightScore * 0.2
                        + VolumeScore * 0.2) * 10.0, 0) / 10.0 AS VPIScore
  FROM k3
),
vs AS (
  SELECT *, CASE WHEN VPIScore >= 80.0 THEN 'Tier 1: Strategic'
                 WHEN VPIScore >= 68.0 THEN 'Tier 2: Preferred'
                 WHEN VPIScore >= 55.0 THEN 'Tier 3: Moderate Risk'
                 ELSE 'Tier 4: High Risk' END AS VendorTier
  FROM k4
)"""

SUMMARY_COLUMNS = (
    "VendorNumber, VendorName, TotalPOs, TotalPurchaseRecords, TotalUnitsPurchased, "
    "TotalSpendDollars, AvgPurchaseUnitPrice, AvgLeadTimeDays, MaxLeadTimeDays, MinLeadTimeDays, "
    "round(StdLeadTimeDays, 6) AS StdLeadTimeDays, LateDeliveriesCount, LateDeliveryRate, "
    "TotalFreightDollars, TotalInvoiceDollars, AvgPaymentLeadTimeDays, TotalUnitsSold, "
    "TotalSalesDollars, round(AvgSalesUnitPrice, 6) AS AvgSalesUnitPrice, TotalExciseTaxDollars, "
    "BeginInventoryUnits, BeginInventoryValue, EndInventoryUnits, EndInventoryValue, "
    "GrossProfitDollars, GrossMarginPct, FreightRatioPct, AvgInventoryValue, "
    "InventoryTurnoverRatio, DaysSalesOfInventory, VPIScore, VendorTier")


def with_vs(select: str) -> str:
    """A query over the scorecard view ``vs``."""
    return f"WITH {STANDINS},{VENDOR_SUMMARY_BODY}\n{select}"


def with_standins(select: str) -> str:
    return f"WITH {STANDINS}\n{select}"


def _features(lines: str) -> str:
    """The features of all lines of a table expression."""
    return f"""
SELECT l.PONumber, l.LineNumber, l.Brand, l.VendorNumber, l.Store, l.Classification, l.Quantity,
       l.PurchasePrice, l.Dollars, l.POMonth, l.PODayOfWeek, l.ActualLeadTimeDays,
       COALESCE(v.AvgLeadTimeDays, 7.5) AS AvgLeadTimeDays,
       COALESCE(v.LateDeliveryRate, 5.0) AS LateDeliveryRate,
       COALESCE(v.VPIScore, 70.0) AS VPIScore,
       CAST(l.ActualLeadTimeDays > 10 AS INTEGER) AS IsDelayed
FROM (SELECT PONumber, LineNumber, Brand, VendorNumber, Store, Classification, Quantity,
             PurchasePrice, Dollars, month(PODate) AS POMonth, dayofweek(PODate) AS PODayOfWeek,
             date_diff('day', PODate, ReceivingDate) AS ActualLeadTimeDays
      FROM {lines}
      WHERE PODate IS NOT NULL AND ReceivingDate IS NOT NULL AND Quantity > 0 AND Dollars > 0) l
LEFT JOIN vs v ON l.VendorNumber IS NOT DISTINCT FROM v.VendorNumber
WHERE l.ActualLeadTimeDays BETWEEN 0 AND 60"""


#: The drawn lines.
DRAWN = f"""(SELECT * FROM purchases
            ORDER BY md5(concat_ws('|', PONumber, LineNumber, Brand, VendorNumber, '42')),
                     PONumber, LineNumber, Brand, VendorNumber
            LIMIT {SAMPLE_N})"""
TRAINING_FEATURES = _features(DRAWN)

# Fixed values that must equal the original job: risk levels, badges and advice.
_RISK = """
       CASE WHEN prob > 60.0 OR predicted_lead_time_days > 12.0 THEN 'HIGH RISK'
            WHEN prob > 30.0 OR predicted_lead_time_days > 8.0 THEN 'MODERATE RISK'
            ELSE 'LOW RISK' END AS risk_level,
       CASE WHEN prob > 60.0 OR predicted_lead_time_days > 12.0 THEN 'risk-high'
            WHEN prob > 30.0 OR predicted_lead_time_days > 8.0 THEN 'risk-medium'
            ELSE 'risk-low' END AS badge_class,
       CASE WHEN prob > 60.0 OR predicted_lead_time_days > 12.0 THEN
              'Order placement requires expedited shipping buffer and vendor follow-up. Consider safety stock allocation.'
            WHEN prob > 30.0 OR predicted_lead_time_days > 8.0 THEN
              'Standard monitoring recommended. Lead time matches vendor baseline.'
            ELSE 'Optimal delivery conditions expected. High confidence on-time fulfillment.' END
         AS recommendation"""


def _score(predicted: str, orders: str = "orders_to_score") -> str:
    """Scored orders; ``predicted`` adds predicted_lead_time_days and prob to the filled orders."""
    return f"""
SELECT order_key, line_number, part_key, predicted_lead_time_days,
       round_even(prob * 10.0, 0) / 10.0 AS delay_probability_pct,{_RISK},
       vendor_number, store, quantity, total_dollars,
       round_even(avg_lt * 10.0, 0) / 10.0 AS vendor_historical_avg_lt
FROM ({predicted} FROM (
      SELECT o.order_key, o.line_number, o.part_key,
             COALESCE(o.vendor_number, 12546) AS vendor_number,
             COALESCE(o.store, 1) AS store,
             COALESCE(CAST(o.quantity AS DOUBLE), 100.0) AS quantity,
             COALESCE(o.dollars, COALESCE(CAST(o.quantity AS DOUBLE), 100.0)
                                 * COALESCE(CAST(o.purchase_price AS DOUBLE), 15.0)) AS total_dollars,
             COALESCE(v.AvgLeadTimeDays, 7.5) AS avg_lt,
             COALESCE(v.LateDeliveryRate, 5.0) AS late_rate
      FROM {orders} o
      LEFT JOIN vs v ON COALESCE(o.vendor_number, 12546) = v.VendorNumber))"""


_RULE_DAYS = "round_even((avg_lt + quantity * 0.0001) * 10.0, 0) / 10.0"
_RULES = (f"SELECT *, {_RULE_DAYS} AS predicted_lead_time_days, least(95.0, "
          f"round_even((late_rate + {_RULE_DAYS} * 3.0) * 10.0, 0) / 10.0) AS prob")
SCORE_ORDERS_RULES = _score(_RULES)
# Orders that only name a vendor; all else takes the defaults.
SCORE_ORDERS_DEFAULTS = _score(_RULES, """(SELECT order_key, line_number, part_key, vendor_number,
  CAST(NULL AS INTEGER) AS store, CAST(NULL AS DOUBLE) AS quantity, CAST(NULL AS DOUBLE) AS purchase_price,
  CAST(NULL AS DOUBLE) AS dollars FROM orders_to_score)""")
# Stand-in predictions from the row keys, to check what follows a prediction without a model.
RISK_FROM_PREDICTIONS = _score(
    "SELECT *, greatest(1.0, round_even((order_key % 160) / 10.0 * 10.0, 0) / 10.0) AS predicted_lead_time_days, "
    "(part_key % 97) / 97.0 * 100.0 AS prob")
METRICS_FROM_PREDICTIONS = f"""
SELECT round(1 - avg((y - p) * (y - p)) / var_pop(y), 6) AS r2, round(avg(abs(y - p)), 6) AS mae,
       round(sqrt(avg((y - p) * (y - p))), 6) AS rmse, round(avg(CAST(d = IsDelayed AS INTEGER)), 6) AS accuracy,
       count(*) AS test_rows
FROM (SELECT CAST(ActualLeadTimeDays AS DOUBLE) AS y, ActualLeadTimeDays + (Brand % 7 - 3) * 0.5 AS p, IsDelayed,
             CASE WHEN Brand % 9 = 0 THEN 1 - IsDelayed ELSE IsDelayed END AS d
      FROM ({_features('purchases')}))"""
SAMPLE_TIED_LINES = f"""
SELECT * EXCLUDE (place) FROM (
  SELECT *, row_number() OVER (ORDER BY md5(concat_ws('|', Brand, '42')), Brand,
    md5(concat_ws('|', PONumber, LineNumber, VendorNumber, '42'))) AS place FROM purchases)
WHERE place <= {SAMPLE_N + 1}"""
