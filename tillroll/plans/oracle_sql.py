"""Independent SQL formulations of the registered queries, for DuckDB.

The verification harness runs each Spark query and the SQL text of the same
name over the same Parquet tables and compares row count, schema and an
order-insensitive hash of the values. The SQL is written from the
definitions of the operators, not generated from the Spark plans; only the
exact-rounding template and the fixed rule texts are shared.

Every statement starts from the invoice-line view derived from the star
schema (tables lineitem, orders, customer, nation, part are pre-registered).
"""

from __future__ import annotations

from tillroll.functions.exact import HALF_EVEN, HALF_UP, ratio_round_sql
from tillroll.operators import playbook


def rr(num: str, den: str, scale: int = 2, mode: str = HALF_UP, num_scale: int = 0) -> str:
    return ratio_round_sql(num, den, scale, mode, num_scale, dialect="duckdb")


def fixed_mean(c: str) -> str:
    """Mean of a floating column over its values at six decimal places."""
    return rr(f"SUM(CAST({c} AS DECIMAL(20,6)))", f"COUNT({c})", 2, HALF_EVEN, 6)


TX = """
online_retail AS (
    SELECT CAST(o_orderkey AS VARCHAR) AS InvoiceNo,
           CAST(l_partkey AS VARCHAR) AS StockCode,
           p_name AS Description,
           CAST(CASE WHEN l_returnflag = 'R' THEN -l_quantity ELSE l_quantity END AS INTEGER) AS Quantity,
           o_orderdate + to_minutes(CAST(o_orderkey * 37 % 1440 AS INTEGER)) AS InvoiceDate,
           CAST(p_retailprice AS DECIMAL(12,4)) AS UnitPrice,
           CASE WHEN o_orderpriority = '4-NOT SPECIFIED' THEN NULL ELSE o_custkey END AS CustomerID,
           n_name AS Country
    FROM lineitem
    JOIN orders ON l_orderkey = o_orderkey
    JOIN customer ON o_custkey = c_custkey
    JOIN nation ON c_nationkey = n_nationkey
    JOIN part ON l_partkey = p_partkey
)"""

CLEAN = TX + """,
clean AS (
    SELECT *, Quantity * UnitPrice AS TotalAmount
    FROM online_retail
    WHERE Quantity > 0 AND CustomerID IS NOT NULL
)"""


def _with(ctes: str, body: str) -> str:
    return f"WITH {ctes}\n{body}"


REVENUE_BY_COUNTRY = _with(TX, """
SELECT Country,
       CAST(ROUND(SUM(Quantity * UnitPrice), 2) AS DOUBLE) AS TotalRevenue,
       COUNT(DISTINCT CustomerID) AS NumberOfCustomers,
       COUNT(DISTINCT InvoiceNo) AS NumberOfOrders
FROM online_retail
WHERE Quantity > 0
GROUP BY Country
ORDER BY TotalRevenue DESC, Country""")

MONTHLY_REVENUE = _with(TX, """
SELECT strftime(InvoiceDate, '%Y-%m') AS Month,
       CAST(ROUND(SUM(Quantity * UnitPrice), 2) AS DOUBLE) AS MonthlyRevenue,
       COUNT(DISTINCT InvoiceNo) AS NumberOfOrders,
       COUNT(DISTINCT CustomerID) AS NumberOfCustomers
FROM online_retail
WHERE Quantity > 0
GROUP BY 1
ORDER BY Month NULLS FIRST""")

TOP_PRODUCTS = _with(TX, """
SELECT StockCode, Description,
       CAST(SUM(Quantity) AS BIGINT) AS TotalQuantitySold,
       CAST(ROUND(SUM(Quantity * UnitPrice), 2) AS DOUBLE) AS TotalRevenue,
       COUNT(DISTINCT CustomerID) AS NumberOfUniqueCustomers
FROM online_retail
WHERE Quantity > 0
GROUP BY StockCode, Description
ORDER BY TotalQuantitySold DESC, StockCode, Description NULLS FIRST
LIMIT 10""")

CUSTOMER_FREQUENCY = _with(TX, f"""
SELECT CustomerID,
       COUNT(DISTINCT InvoiceNo) AS NumberOfOrders,
       CAST(ROUND(SUM(Quantity * UnitPrice), 2) AS DOUBLE) AS TotalSpent,
       {rr('SUM(Quantity * UnitPrice)', 'COUNT(Quantity * UnitPrice)', 2, HALF_UP, 4)} AS AverageOrderValue,
       COUNT(DISTINCT substr(strftime(InvoiceDate, '%Y-%m-%d'), 6, 2)) AS NumberOfActiveMonths
FROM online_retail
WHERE Quantity > 0 AND CustomerID IS NOT NULL
GROUP BY CustomerID
ORDER BY TotalSpent DESC, CustomerID""")

CATEGORY_REVENUE = _with(TX + """,
categories AS (
    SELECT split_part(Description, ' ', 1) AS Category,
           COUNT(*) AS ProductCount,
           CAST(ROUND(SUM(Quantity * UnitPrice), 2) AS DOUBLE) AS CategoryRevenue
    FROM online_retail
    WHERE Quantity > 0
    GROUP BY 1
)""", """
SELECT * FROM categories
ORDER BY CategoryRevenue DESC, Category NULLS FIRST
LIMIT 15""")

CLEAN_TRANSACTIONS = _with(CLEAN, """
SELECT InvoiceNo, StockCode, Description, Quantity, InvoiceDate,
       CAST(UnitPrice AS DOUBLE) AS UnitPrice, CustomerID, Country,
       CAST(TotalAmount AS DOUBLE) AS TotalAmount
FROM clean""")

# Per-customer features, written the direct way: a LAG over all orders of a
# customer (fine for an oracle; the Spark plan avoids it for skew).
FEATURES = CLEAN + """,
ord AS (
    SELECT CustomerID, InvoiceNo, SUM(TotalAmount) AS OrderTotal, SUM(Quantity) AS OrderUnits,
           MIN(InvoiceDate) AS OrderDate, MAX(InvoiceDate) AS LastDate
    FROM clean GROUP BY CustomerID, InvoiceNo
),
maxd AS (SELECT MAX(InvoiceDate) AS MaxDate FROM clean),
rfm AS (
    SELECT CustomerID,
           date_sub('day', MAX(InvoiceDate), (SELECT MaxDate FROM maxd) + INTERVAL 1 DAY) AS Recency,
           COUNT(DISTINCT InvoiceNo) + MAX(CASE WHEN InvoiceNo IS NULL THEN 1 ELSE 0 END) AS Frequency,
           SUM(TotalAmount) AS Monetary
    FROM clean GROUP BY CustomerID
    HAVING SUM(TotalAmount) > 0
),
gaps AS (
    SELECT CustomerID,
           date_sub('day', LAG(OrderDate) OVER (PARTITION BY CustomerID ORDER BY OrderDate), OrderDate) AS g
    FROM ord WHERE InvoiceNo IS NOT NULL
),
reg AS (
    SELECT CustomerID, CAST(COUNT(g) AS HUGEINT) AS n, CAST(COALESCE(SUM(g), 0) AS HUGEINT) AS s1,
           CAST(COALESCE(SUM(g * g), 0) AS HUGEINT) AS s2
    FROM gaps GROUP BY CustomerID
),
metrics AS (
    SELECT o.CustomerID,
           CAST(SUM(OrderTotal) FILTER (WHERE InvoiceNo IS NOT NULL) AS DOUBLE) / COUNT(InvoiceNo) AS AvgOrderValue,
           CAST(SUM(OrderUnits) FILTER (WHERE InvoiceNo IS NOT NULL) AS DOUBLE) / COUNT(InvoiceNo) AS AvgItemsPerOrder,
           MIN(OrderDate) AS FirstPurchase
    FROM ord o GROUP BY o.CustomerID
),
diversity AS (
    SELECT CustomerID,
           COUNT(DISTINCT StockCode) + MAX(CASE WHEN StockCode IS NULL THEN 1 ELSE 0 END) AS ProductDiversity
    FROM clean GROUP BY CustomerID
),
features AS (
    SELECT r.CustomerID, r.Recency, r.Frequency, CAST(r.Monetary AS DOUBLE) AS Monetary,
           r.Monetary AS MonetaryDec,
           m.AvgOrderValue, d.ProductDiversity, m.AvgItemsPerOrder,
           CASE WHEN g.n > 0 THEN sqrt(CAST(g.n * g.s2 - g.s1 * g.s1 AS DOUBLE) / CAST(g.n * g.n AS DOUBLE))
                ELSE 0.0 END AS PurchaseRegularity,
           m.FirstPurchase
    FROM rfm r
    LEFT JOIN metrics m USING (CustomerID)
    LEFT JOIN diversity d USING (CustomerID)
    LEFT JOIN reg g USING (CustomerID)
),
proj AS (
    SELECT f.*, date_sub('day', FirstPurchase, (SELECT MaxDate FROM maxd)) AS DaysSinceFirst
    FROM features f
),
proj2 AS (
    SELECT *, DaysSinceFirst / 30.44 AS MonthsActive FROM proj
),
proj3 AS (
    SELECT *, Frequency / greatest(MonthsActive, 1.0) AS PurchaseRate,
           Monetary / Frequency AS AvgTransactionValue,
           (1.0 / ln(1 + Recency)) * ln(1 + Frequency) * ln(1 + Monetary) AS GrowthPotential
    FROM proj2
),
projected AS (
    SELECT *, PurchaseRate * 3 AS QuarterlyRate, PurchaseRate * 3 * AvgTransactionValue AS PredictedQuarterlyValue,
           (GrowthPotential - MIN(GrowthPotential) OVER ())
             / NULLIF(MAX(GrowthPotential) OVER () - MIN(GrowthPotential) OVER (), 0) * 100 AS GrowthPotentialScore
    FROM proj3
)"""

RFM = _with(FEATURES, """
SELECT CustomerID, Recency, Frequency, CAST(Monetary AS DOUBLE) AS Monetary FROM rfm""")

BEHAVIOUR_METRICS = _with(FEATURES, """
SELECT CustomerID, Recency, Frequency, Monetary, AvgOrderValue, ProductDiversity,
       AvgItemsPerOrder, PurchaseRegularity
FROM features""")

VALUE_PROJECTION = _with(FEATURES, """
SELECT CustomerID, Recency, Frequency, Monetary, AvgOrderValue, ProductDiversity,
       AvgItemsPerOrder, PurchaseRegularity, FirstPurchase, DaysSinceFirst, MonthsActive,
       PurchaseRate, QuarterlyRate, AvgTransactionValue, PredictedQuarterlyValue,
       round(GrowthPotential, 6) AS GrowthPotential, round(GrowthPotentialScore, 6) AS GrowthPotentialScore
FROM projected""")

# ---- stand-in clustering (Cluster = CustomerID % 5) and what consumes it ----
SEGMENTED = FEATURES + f""",
standin AS (SELECT *, CAST(CustomerID % 5 AS INTEGER) AS Cluster FROM projected),
means AS (
    SELECT Cluster,
           CAST(SUM(Recency) AS DOUBLE) / COUNT(*) AS Recency,
           CAST(SUM(Frequency) AS DOUBLE) / COUNT(*) AS Frequency,
           CAST(SUM(MonetaryDec) AS DOUBLE) / COUNT(*) AS Monetary,
           SUM(AvgOrderValue) / COUNT(*) AS AvgOrderValue,
           CAST(SUM(ProductDiversity) AS DOUBLE) / COUNT(*) AS ProductDiversity,
           SUM(AvgItemsPerOrder) / COUNT(*) AS AvgItemsPerOrder
    FROM standin GROUP BY Cluster
),
qs AS (
    SELECT quantile_cont(Recency, 0.25) AS r25, quantile_cont(Recency, 0.5) AS r50,
           quantile_cont(Frequency, 0.5) AS f50, quantile_cont(Frequency, 0.75) AS f75,
           quantile_cont(Monetary, 0.5) AS m50, quantile_cont(Monetary, 0.75) AS m75
    FROM means
),
labels AS (
    SELECT m.*,
           (CASE WHEN Recency < r25 THEN 'Active' WHEN Recency < r50 THEN 'Recent' ELSE 'Inactive' END)
           || ' ' ||
           (CASE WHEN Frequency > f75 THEN 'Loyal' WHEN Frequency > f50 THEN 'Regular' ELSE 'Occasional' END)
           || ' ' ||
           (CASE WHEN Monetary > m75 THEN 'High-Value' WHEN Monetary > m50 THEN 'Mid-Value' ELSE 'Low-Value' END)
           AS Segment
    FROM means m CROSS JOIN qs
),
final AS (SELECT s.*, l.Segment FROM standin s LEFT JOIN labels l USING (Cluster)),
ins AS (
    SELECT Segment,
           {rr('SUM(Recency)', 'COUNT(Recency)', 2, HALF_EVEN)} AS Recency,
           {rr('SUM(Frequency)', 'COUNT(Frequency)', 2, HALF_EVEN)} AS Frequency,
           {rr('SUM(MonetaryDec)', 'COUNT(MonetaryDec)', 2, HALF_EVEN, 4)} AS Monetary,
           {fixed_mean('AvgOrderValue')} AS AvgOrderValue,
           {rr('SUM(ProductDiversity)', 'COUNT(ProductDiversity)', 2, HALF_EVEN)} AS ProductDiversity,
           {fixed_mean('PredictedQuarterlyValue')} AS PredictedQuarterlyValue,
           {fixed_mean('GrowthPotentialScore')} AS GrowthPotentialScore,
           COUNT(*) AS CustomerCount
    FROM final GROUP BY Segment
),
tot AS (SELECT SUM(CustomerCount) AS total FROM ins),
insights AS (
    SELECT ins.*, {rr('CustomerCount * 100', 'total', 2, HALF_EVEN)} AS PercentOfCustomers
    FROM ins CROSS JOIN tot
)"""

CLUSTER_LABELS = _with(SEGMENTED, """
SELECT Cluster, Recency, Frequency, Monetary, round(AvgOrderValue, 6) AS AvgOrderValue,
       ProductDiversity, round(AvgItemsPerOrder, 6) AS AvgItemsPerOrder, Segment
FROM labels""")

SEGMENT_INSIGHTS = _with(SEGMENTED, "\nSELECT * FROM insights")

SEGMENT_SUMMARY = _with(SEGMENTED + """,
base AS (
    SELECT Segment, CustomerCount, PercentOfCustomers AS PercentOfTotal,
           Monetary * CustomerCount AS TotalRevenue, Monetary AS AvgMonetary,
           Frequency AS AvgFrequency, Recency AS AvgRecency, AvgOrderValue, ProductDiversity,
           PredictedQuarterlyValue * CustomerCount AS PredictedValue, GrowthPotentialScore AS GrowthScore
    FROM insights
),
med AS (SELECT median(CustomerCount) AS mc, median(AvgMonetary) AS mm FROM base)""", """
SELECT base.*,
       CASE WHEN CustomerCount < mc / 2 AND AvgMonetary < mm / 2 AND GrowthScore < 25 THEN 'Low'
            WHEN CustomerCount > mc OR AvgMonetary > mm OR GrowthScore > 50 THEN 'High'
            ELSE 'Medium' END AS Priority
FROM base CROSS JOIN med""")

DATE_DIMENSION = _with(SEGMENTED + """,
span AS (SELECT MIN(FirstPurchase) AS lo, MAX(FirstPurchase) AS hi FROM final),
days AS (SELECT unnest(generate_series(lo, hi + INTERVAL 90 DAY, INTERVAL 1 DAY)) AS Date FROM span)""", """
SELECT Date, year(Date) AS Year, quarter(Date) AS Quarter, month(Date) AS Month,
       strftime(Date, '%B') AS MonthName, weekofyear(Date) AS Week, day(Date) AS Day,
       isodow(Date) - 1 AS Weekday, strftime(Date, '%A') AS WeekdayName,
       CASE WHEN isodow(Date) IN (6, 7) THEN 1 ELSE 0 END AS IsWeekend
FROM days""")

_PROFILE = ["Recency", "Frequency", "Monetary", "AvgOrderValue", "ProductDiversity", "AvgItemsPerOrder"]

CLUSTER_PROFILE = _with(SEGMENTED, "\nSELECT Cluster, " + ",\n       ".join(
    f"round(({c} - MIN({c}) OVER ()) / NULLIF(MAX({c}) OVER () - MIN({c}) OVER (), 0), 6) AS {c}"
    for c in _PROFILE) + "\nFROM means")

CUSTOMER_SAMPLE = _with(SEGMENTED, """
SELECT CustomerID, Recency, Frequency, Monetary, Cluster, Segment, Monetary / 100 AS PointSize
FROM final
ORDER BY ((CAST(CustomerID AS HUGEINT) * 2654435761 + 42) % 4294967291 + 4294967291) % 4294967291, CustomerID
LIMIT 1000""")

SEGMENT_SIZES = _with(SEGMENTED, """
SELECT 'Cluster' AS Level, CAST(Cluster AS VARCHAR) AS Name, COUNT(*) AS CustomerCount FROM final GROUP BY Cluster
UNION ALL
SELECT 'Segment' AS Level, Segment AS Name, COUNT(*) AS CustomerCount FROM final GROUP BY Segment""")

SEGMENT_CONTRIBUTION = _with(SEGMENTED + """,
sums AS (SELECT Segment, COUNT(*) AS Customers, SUM(MonetaryDec) AS Revenue FROM final GROUP BY Segment),
alls AS (SELECT SUM(Customers) AS c, SUM(Revenue) AS r FROM sums)""", f"""
SELECT Segment, Customers, CAST(Revenue AS DOUBLE) AS Revenue, {rr('Customers', 'c', 4)} AS CustomerShare,
       {rr('Revenue * 10000', 'r * 10000', 4)} AS RevenueShare, {rr('Revenue', 'Customers', 2, HALF_UP, 4)} AS RevenuePerCustomer
FROM sums CROSS JOIN alls""")

_RANKED = ["Monetary", "Frequency", "PredictedQuarterlyValue", "GrowthPotentialScore",
           "AvgOrderValue", "ProductDiversity"]

SEGMENT_RANKING = _with(SEGMENTED + ",\nlong AS (\n" + "\n    UNION ALL\n".join(
    f"    SELECT '{m}' AS Metric, Segment, CAST({m} AS DOUBLE) AS Value FROM insights" for m in _RANKED)
    + "\n)", """
SELECT Metric, Segment, Value,
       ROW_NUMBER() OVER (PARTITION BY Metric ORDER BY Value DESC, Segment) AS Rank
FROM long""")

HEADLINE_KPIS = _with(SEGMENTED, """
SELECT CAST(SUM(CustomerCount) AS BIGINT) AS TotalCustomers,
       CAST(SUM(CAST(Monetary AS DECIMAL(18,2)) * CustomerCount) AS DOUBLE) AS TotalRevenue,
       CAST(SUM(CAST(Monetary AS DECIMAL(18,2)) * CustomerCount) AS DOUBLE)
           / CAST(SUM(CustomerCount) AS DOUBLE) AS AvgCustomerValue,
       CAST(SUM(CAST(PredictedQuarterlyValue AS DECIMAL(18,2)) * CustomerCount) AS DOUBLE)
           AS PredictedQuarterlyRevenue
FROM insights""")


DASHBOARD_TEXT = _with(SEGMENTED + """,
kpi AS (
    SELECT SUM(CustomerCount) AS tc,
           CAST(SUM(CAST(Monetary AS DECIMAL(18,2)) * CustomerCount) AS DOUBLE) AS rev,
           CAST(SUM(CAST(PredictedQuarterlyValue AS DECIMAL(18,2)) * CustomerCount) AS DOUBLE) AS pqr
    FROM insights
),
body AS (
    SELECT string_agg(
             chr(10) || Segment || ':'
             || chr(10) || '  • ' || format('{:,.0f}', CAST(CustomerCount AS DOUBLE)) || ' customers ('
             || format('{:.1f}', PercentOfCustomers) || '%)'
             || chr(10) || '  • $' || format('{:,.0f}', Monetary) || ' avg. spend'
             || chr(10) || '  • ' || format('{:.1f}', Frequency) || ' avg. purchases'
             || chr(10) || '  • Growth potential: ' || format('{:.1f}', GrowthPotentialScore) || '/100',
             chr(10) ORDER BY Segment) AS txt
    FROM insights
)""", """
SELECT 'Total Customers: ' || format('{:,.0f}', CAST(tc AS DOUBLE)) || chr(10)
       || 'Total Revenue: $' || format('{:,.0f}', rev) || chr(10)
       || 'Average Customer Value: $' || format('{:,.0f}', rev / CAST(tc AS DOUBLE)) || chr(10)
       || 'Predicted Quarterly Revenue: $' || format('{:,.0f}', pqr) || chr(10)
       || chr(10) || 'Segment Breakdown:' || chr(10) || txt AS Summary
FROM kpi CROSS JOIN body""")


# ---- playbook: the rule texts as tables, first matching rule by number ----

def _lit(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, (int, float)):
        return repr(v)
    return "'" + str(v).replace("'", "''") + "'"


def _values(rows: list[tuple], names: list[str]) -> str:
    body = ",\n        ".join("(" + ", ".join(_lit(v) for v in r) + ")" for r in rows)
    return f"(VALUES\n        {body}) AS t({', '.join(names)})"


def _words(words: tuple, n: int = 3) -> tuple:
    return tuple(list(words) + [None] * (n - len(words)))


def _match(rules_cte: str) -> str:
    return f"""
matched AS (
    SELECT s.Segment, MIN(r.rule_no) AS rule_no
    FROM segs s JOIN {rules_cte} r
      ON contains(s.Segment, r.w1)
     AND (r.w2 IS NULL OR contains(s.Segment, r.w2))
     AND (r.w3 IS NULL OR contains(s.Segment, r.w3))
    GROUP BY s.Segment
)"""


_char_rows = []
for _g, _intro, _details in playbook.CHARACTERISTICS:
    for _w, _text in _details:
        _char_rows.append((len(_char_rows) + 1, *_words((_g, *_w)),
                           playbook.CHARACTERISTICS_HEADER + _intro + _text))

_rec_rows, _act_rows = [], []
for _g, _branches in playbook.RECOMMENDATIONS:
    for _w, _prio, _focus, _actions in _branches:
        _no = len(_rec_rows) + 1
        _rec_rows.append((_no, *_words((_g, *_w)), _prio, _focus))
        for _i, (_t, _d) in enumerate(_actions):
            _act_rows.append((_no, _i + 1, _t, _d))

_kpi_rules, _kpi_rows = [], []


def _add_kpis(words: tuple, specific: list[str]) -> None:
    no = len(_kpi_rules) + 1
    _kpi_rules.append((no, *_words(words)))
    items = [("Universal", k) for k in playbook.UNIVERSAL_KPIS] + [("Segment-Specific", k) for k in specific]
    for i, (grp, k) in enumerate(items):
        _kpi_rows.append((no, i + 1, grp, k))


for _g, _common, _extras in playbook.SEGMENT_KPIS:
    for _w, _extra in _extras:
        _add_kpis((_g, *_w), _common + _extra)
    _add_kpis((_g,), _common)
_KPI_FALLBACK = len(_kpi_rules) + 1
for _i, _k in enumerate(playbook.UNIVERSAL_KPIS):
    _kpi_rows.append((_KPI_FALLBACK, _i + 1, "Universal", _k))

_W = ["rule_no", "w1", "w2", "w3"]

SEGMENT_INTERPRETATION = _with(SEGMENTED + f""",
segs AS (SELECT * FROM insights),
char_rules AS (SELECT * FROM {_values(_char_rows, _W + ['txt'])}),""" + _match("char_rules") + """,
blocks AS (
    SELECT s.Segment,
           '### ' || s.Segment || ' Segment Analysis' || chr(10) || chr(10)
           || '**Customer Base:** ' || format('{:,.0f}', CAST(CustomerCount AS DOUBLE)) || ' customers '
           || '(' || format('{:.1f}', PercentOfCustomers) || '% of total)' || chr(10) || chr(10)
           || '**Key Metrics:**' || chr(10)
           || '- **Recency:** ' || format('{:.1f}', Recency) || ' days since last purchase' || chr(10)
           || '- **Frequency:** ' || format('{:.1f}', Frequency) || ' purchases on average' || chr(10)
           || '- **Monetary:** $' || format('{:,.2f}', Monetary) || ' average total spend' || chr(10)
           || '- **Average Order Value:** $' || format('{:,.2f}', AvgOrderValue) || chr(10)
           || '- **Product Diversity:** ' || format('{:.1f}', ProductDiversity)
           || ' unique products purchased' || chr(10)
           || '- **Predicted Quarterly Value:** $' || format('{:,.2f}', PredictedQuarterlyValue) || chr(10)
           || '- **Growth Potential Score:** ' || format('{:.1f}', GrowthPotentialScore) || '/100'
           || chr(10) || chr(10) AS block
    FROM segs s
)""", """
SELECT b.Segment, r.txt AS Characteristics, b.block || COALESCE(r.txt, '') AS Interpretation
FROM blocks b LEFT JOIN matched m USING (Segment) LEFT JOIN char_rules r USING (rule_no)""")

_ACTION_CTES = f""",
rec_rules AS (SELECT * FROM {_values(_rec_rows, _W + ['ActionPriority', 'Focus'])}),
actions AS (SELECT * FROM {_values(_act_rows, ['rule_no', 'Rank', 'Action', 'Detail'])}),"""

SEGMENT_ACTIONS = _with(SEGMENTED + ",\nsegs AS (SELECT Segment FROM insights)" + _ACTION_CTES
                        + _match("rec_rules"), """
SELECT s.Segment, r.ActionPriority, r.Focus, a.Rank, a.Action, a.Detail
FROM segs s LEFT JOIN matched m USING (Segment) LEFT JOIN rec_rules r USING (rule_no)
LEFT JOIN actions a USING (rule_no)""")

CUSTOMER_ACTIONS = _with(SEGMENTED + ",\nsegs AS (SELECT DISTINCT Segment FROM final)" + _ACTION_CTES
                         + _match("rec_rules"), """
SELECT f.CustomerID, f.Segment, r.ActionPriority, a.Rank, a.Action
FROM final f LEFT JOIN matched m USING (Segment) LEFT JOIN rec_rules r USING (rule_no)
LEFT JOIN actions a USING (rule_no)""")

SEGMENT_KPIS = _with(SEGMENTED + f""",
segs AS (SELECT Segment FROM insights),
kpi_rules AS (SELECT * FROM {_values(_kpi_rules, _W)}),
kpis AS (SELECT * FROM {_values(_kpi_rows, ['rule_no', 'Rank', 'KpiGroup', 'Kpi'])}),""" + _match("kpi_rules"), f"""
SELECT s.Segment, k.KpiGroup, k.Rank, k.Kpi
FROM segs s LEFT JOIN matched m USING (Segment)
JOIN kpis k ON k.rule_no = COALESCE(m.rule_no, {_KPI_FALLBACK})""")

PIPELINE_EXPORT = _with(SEGMENTED, """
SELECT CustomerID, Recency, Frequency, Monetary, AvgOrderValue, ProductDiversity, AvgItemsPerOrder, PurchaseRegularity,
       Cluster, Segment, FirstPurchase, DaysSinceFirst, MonthsActive, PurchaseRate, QuarterlyRate, AvgTransactionValue,
       PredictedQuarterlyValue, round(GrowthPotential, 6) AS GrowthPotential, round(GrowthPotentialScore, 6) AS GrowthPotentialScore
FROM final""")

# ---- scaling, cluster scores, Lloyd iterations, PCA: written out in SQL ----
_CLUSTERED = ["Recency", "Frequency", "Monetary", "AvgOrderValue", "ProductDiversity", "AvgItemsPerOrder", "PurchaseRegularity"]


def _scaled_cte(name: str, features: list[str], source: str, extra: str = "") -> str:
    raw = {c: f"ln(1 + CAST({c} AS DOUBLE))" if c in ("Monetary", "AvgOrderValue") else f"CAST({c} AS DOUBLE)" for c in features}
    cols = ",\n           ".join(
        f"({x} - AVG({x}) OVER ()) / (CASE WHEN STDDEV_POP({x}) OVER () > 0 THEN STDDEV_POP({x}) OVER () ELSE 1 END) AS {c}"
        for c, x in raw.items())
    return f""",
{name} AS (
    SELECT CustomerID{extra},
           {cols}
    FROM {source}
)"""


SCALED = FEATURES + _scaled_cte("scaled", _CLUSTERED, "features")
SCALED_FEATURES = _with(SCALED, "\nSELECT CustomerID, " + ", ".join(f"round({c}, 6) AS {c}" for c in _CLUSTERED) + "\nFROM scaled")

_SQUARE = " + ".join(f"{c} * {c}" for c in _CLUSTERED)
_STATS = SCALED + f""",
p AS (SELECT *, CAST(CustomerID % 5 AS INTEGER) AS Cluster, {_SQUARE} AS xx FROM scaled),
st AS (SELECT Cluster, COUNT(*) AS n, SUM(xx) AS q, {', '.join(f'SUM({c}) AS s_{c}' for c in _CLUSTERED)} FROM p GROUP BY Cluster)"""

STANDIN_INERTIA = _with(_STATS + """,
means5 AS (SELECT Cluster, n, """ + ", ".join(f"s_{c} / n AS m_{c}" for c in _CLUSTERED) + """ FROM st)""", """
SELECT p.Cluster, COUNT(*) AS CustomerCount, round(SUM(""" + " + ".join(f"(p.{c} - m_{c}) * (p.{c} - m_{c})" for c in _CLUSTERED)
    + """), 6) AS Inertia
FROM p JOIN means5 USING (Cluster) GROUP BY p.Cluster""")

STANDIN_SILHOUETTE = _with(_STATS + """,
d AS (
    SELECT p.CustomerID, p.Cluster AS own, st.Cluster AS other, st.n AS n,
           p.xx + st.q / st.n - 2 * (""" + " + ".join(f"p.{c} * st.s_{c}" for c in _CLUSTERED) + """) / st.n AS dist
    FROM p CROSS JOIN st
),
ab AS (
    SELECT CustomerID, MAX(CASE WHEN own = other THEN n END) AS n,
           MAX(CASE WHEN own = other THEN dist * n / greatest(n - 1, 1) END) AS a, MIN(CASE WHEN own <> other THEN dist END) AS b
    FROM d GROUP BY CustomerID
)""", """
SELECT round(AVG(CASE WHEN n <= 1 THEN 0 ELSE (b - a) / greatest(a, b) END), 6) AS Silhouette FROM ab""")


def _lloyd(k: int, iterations: int, p: str = "") -> str:
    """Lloyd's iterations, one after the other: centres c0.., assignments a0.. (the nearest centre, the smaller number on ties)."""
    ctes = f""",
{p}c0 AS (SELECT row_number() OVER (ORDER BY CustomerID) - 1 AS g, {', '.join(_CLUSTERED)} FROM scaled ORDER BY CustomerID LIMIT {k})"""
    dist = " + ".join(f"(s.{c} - c.{c}) * (s.{c} - c.{c})" for c in _CLUSTERED)
    for i in range(iterations + 1):
        ctes += f""",
{p}a{i} AS (SELECT s.CustomerID, arg_min(c.g, {{'d': {dist}, 'g': c.g}}) AS g FROM scaled s CROSS JOIN {p}c{i} c GROUP BY s.CustomerID)"""
        if i < iterations:
            ctes += f""",
{p}m{i} AS (SELECT g, {', '.join(f'AVG({c}) AS {c}' for c in _CLUSTERED)} FROM scaled JOIN {p}a{i} USING (CustomerID) GROUP BY g),
{p}c{i + 1} AS (SELECT o.g, {', '.join(f'COALESCE(m.{c}, o.{c}) AS {c}' for c in _CLUSTERED)} FROM {p}c{i} o LEFT JOIN {p}m{i} m USING (g))"""
    return ctes


KMEANS_FIXED_START = _with(SCALED + _lloyd(3, 4), "\nSELECT CustomerID, CAST(g AS INTEGER) AS Cluster FROM a4")



def _sweep_score(k: int, iterations: int) -> str:
    """Inertia and silhouette of the clusters that ``iterations`` from the first k customers end in."""
    p = f"k{k}"
    square = " + ".join(f"s.{c} * s.{c}" for c in _CLUSTERED)
    to_center = " + ".join(f"(s.{c} - c.{c}) * (s.{c} - c.{c})" for c in _CLUSTERED)
    return _lloyd(k, iterations, p) + f""",
{p}own AS (SELECT s.*, a.g, {square} AS xx FROM scaled s JOIN {p}a{iterations} a USING (CustomerID)),
{p}st AS (SELECT g, COUNT(*) AS n, SUM(xx) AS q, {', '.join(f'SUM({c}) AS s_{c}' for c in _CLUSTERED)} FROM {p}own GROUP BY g),
{p}d AS (
    SELECT s.CustomerID, s.g AS own, t.g AS other, t.n AS n, s.xx + t.q / t.n - 2 * ({' + '.join(f's.{c} * t.s_{c}' for c in _CLUSTERED)}) / t.n AS dist
    FROM {p}own s CROSS JOIN {p}st t
),
{p}ab AS (
    SELECT CustomerID, MAX(CASE WHEN own = other THEN n END) AS n, MAX(CASE WHEN own = other THEN dist * n / greatest(n - 1, 1) END) AS a,
           MIN(CASE WHEN own <> other THEN dist END) AS b
    FROM {p}d GROUP BY CustomerID
),
{p}score AS (
    SELECT {k} AS k, (SELECT AVG(CASE WHEN n <= 1 THEN 0 ELSE (b - a) / greatest(a, b) END) FROM {p}ab) AS silhouette,
           (SELECT SUM({to_center}) FROM {p}own s JOIN {p}c{iterations} c USING (g)) AS inertia
)"""


K_SELECTION_FIXED_STARTS = _with(SCALED + "".join(_sweep_score(k, 3) for k in (2, 3, 4, 5)) + """,
curve AS (""" + " UNION ALL ".join(f"SELECT * FROM k{k}score" for k in (2, 3, 4, 5)) + ")", """
SELECT k, round(silhouette, 6) AS silhouette, round(inertia, 6) AS inertia, k = (SELECT arg_max(k, {'s': silhouette, 'k': -k}) FROM curve) AS chosen
FROM curve""")

_Z = [f"z.{c}" for c in _PROFILE]
_MATRIX = "[" + ", ".join("[" + ", ".join(f"SUM({a} * {b}) / (COUNT(*) - 1)" for b in _Z) + "]" for a in _Z) + "]"
_SQUARED = "[[list_dot_product(r, s) / t for s in m] for r in m]"


def _leading(name: str, source: str) -> str:
    """The leading eigenvector of a symmetric matrix, by squaring it again and again (scaled by its trace)."""
    trace = " + ".join(f"list_dot_product(m[{i}], m[{i}])" for i in range(1, 7))
    largest = "greatest(" + ", ".join(f"m[{i}][{i}]" for i in range(1, 7)) + ")"
    column = "CASE " + " ".join(f"WHEN m[{i}][{i}] = {largest} THEN m[{i}]" for i in range(1, 7)) + " END"
    return f""",
{name}_pow AS (
    SELECT 0 AS step, m FROM {source}
    UNION ALL
    SELECT step + 1, {_SQUARED} FROM (SELECT step, m, {trace} AS t FROM {name}_pow WHERE step < 16)
),
{name}_col AS (SELECT {column} AS v FROM {name}_pow WHERE step = 16),
{name}_unit AS (SELECT [x / sqrt(list_dot_product(v, v)) for x in v] AS v FROM {name}_col),
{name}_sign AS (SELECT CASE WHEN list_max(v) >= -list_min(v) THEN v ELSE [-x for x in v] END AS v FROM {name}_unit),
{name} AS (SELECT v, list_dot_product(v, [list_dot_product(r, v) for r in m]) AS ev FROM {name}_sign CROSS JOIN {source})"""


PCA = "RECURSIVE " + SEGMENTED.lstrip() + _scaled_cte("z", _PROFILE, "final", ", Cluster") + f""",
cov AS (SELECT {_MATRIX} AS m FROM z)""" + _leading("e1", "cov") + """,
rest AS (SELECT [[m[i][j] - ev * v[i] * v[j] for j in [1, 2, 3, 4, 5, 6]] for i in [1, 2, 3, 4, 5, 6]] AS m FROM cov CROSS JOIN e1)""" \
    + _leading("e2", "rest") + """,
total AS (SELECT """ + " + ".join(f"m[{i}][{i}]" for i in range(1, 7)) + """ AS t FROM cov)"""

PCA_COMPONENTS = _with(PCA, "\nUNION ALL\n".join(
    f"SELECT 'PC{p}' AS Component, '{c}' AS Feature, round(v[{i}], 6) AS Loading, round(ev / t, 6) AS ExplainedVarianceRatio"
    f" FROM e{p} CROSS JOIN total" for p in (1, 2) for i, c in enumerate(_PROFILE, 1)))

PCA_PROJECTION = _with(PCA, "\nSELECT CustomerID, " + ", ".join(
    f"round(list_dot_product([{', '.join(_Z)}], e{p}.v), 6) AS PC{p}" for p in (1, 2)) + ", Cluster\nFROM z CROSS JOIN e1 CROSS JOIN e2")

PIPELINE_RUN = "\nUNION ALL\n".join(
    f"SELECT '{name}' AS \"Table\", COUNT(*) AS \"Rows\", CAST({total} AS DOUBLE) AS \"Total\" FROM ({sql})" for name, total, sql in (
        ("customers", "SUM(CAST(Monetary AS DECIMAL(20,4)))", PIPELINE_EXPORT),
        ("segment_profiles", "SUM(CAST(Monetary AS DECIMAL(20,2)) + CustomerCount)", SEGMENT_INSIGHTS),
        ("date_dimension", "SUM(Day + Weekday)", DATE_DIMENSION),
        ("segment_summary", "SUM(CAST(TotalRevenue AS DECIMAL(20,2)))", SEGMENT_SUMMARY),
        ("segment_interpretations", "SUM(LENGTH(Interpretation))", SEGMENT_INTERPRETATION),
        ("segment_recommendations", "SUM(LENGTH(Action) + LENGTH(Detail))", SEGMENT_ACTIONS),
        ("segment_kpis", "SUM(LENGTH(Kpi))", SEGMENT_KPIS)))

# ---- purchase patterns and customer lifecycle ----

BASKETS = CLEAN + """,
items AS (SELECT DISTINCT InvoiceNo, StockCode AS Item FROM clean WHERE InvoiceNo IS NOT NULL AND StockCode IS NOT NULL),
support AS (SELECT Item, COUNT(*) AS n FROM items GROUP BY Item)"""

PRODUCT_AFFINITY = _with(BASKETS + """,
pairs AS (
    SELECT a.Item AS ItemA, b.Item AS ItemB, COUNT(*) AS Together
    FROM items a JOIN items b ON a.InvoiceNo = b.InvoiceNo AND a.Item < b.Item
    GROUP BY ALL HAVING COUNT(*) >= 2
),
total AS (SELECT COUNT(DISTINCT InvoiceNo) AS Baskets FROM items)""", f"""
SELECT ItemA, ItemB, Together, a.n AS SupportA, b.n AS SupportB, Baskets,
       {rr('Together', 'a.n', 4)} AS ConfidenceAB, {rr('Together', 'b.n', 4)} AS ConfidenceBA,
       {rr('CAST(Together AS HUGEINT) * Baskets', 'CAST(a.n AS HUGEINT) * b.n', 4)} AS Lift
FROM pairs JOIN support a ON a.Item = ItemA JOIN support b ON b.Item = ItemB CROSS JOIN total""")

CATEGORY_SETS = _with(CLEAN + """,
items AS (SELECT DISTINCT InvoiceNo, split_part(Description, ' ', 1) AS Item FROM clean WHERE InvoiceNo IS NOT NULL AND Description IS NOT NULL),
sets AS (
    SELECT a.Item || ', ' || b.Item AS Items, 2 AS Size FROM items a JOIN items b ON a.InvoiceNo = b.InvoiceNo AND a.Item < b.Item
    UNION ALL
    SELECT a.Item || ', ' || b.Item || ', ' || c.Item AS Items, 3 AS Size
    FROM items a JOIN items b ON a.InvoiceNo = b.InvoiceNo AND a.Item < b.Item JOIN items c ON a.InvoiceNo = c.InvoiceNo AND b.Item < c.Item
)""", """
SELECT Items, Size, COUNT(*) AS Together FROM sets GROUP BY ALL HAVING COUNT(*) >= 10""")

# The orders, a customer's months with orders, and the last month of the data.
MONTHLY = FEATURES + """,
known AS (SELECT *, 12 * year(OrderDate) + month(OrderDate) - 1 AS Month FROM ord WHERE InvoiceNo IS NOT NULL),
monthly AS (SELECT CustomerID, Month, COUNT(*) AS Orders, SUM(OrderTotal) AS Spend, MAX(LastDate) AS LastDate FROM known GROUP BY ALL),
lastm AS (SELECT MAX(Month) AS LastMonth FROM monthly),
firstm AS (SELECT CustomerID, MIN(Month) AS First FROM monthly GROUP BY CustomerID)"""


def month_text(c: str) -> str:
    return f"lpad(CAST({c} // 12 AS VARCHAR), 4, '0') || '-' || lpad(CAST({c} % 12 + 1 AS VARCHAR), 2, '0')"


COHORT_RETENTION = _with(MONTHLY + """,
cells AS (
    SELECT CustomerID, First, unnest(range(0, (SELECT LastMonth FROM lastm) - First + 1)) AS k FROM firstm
),
states AS (
    SELECT c.First, c.k, now.Month IS NOT NULL AS here, before.Month IS NOT NULL AS there
    FROM cells c
    LEFT JOIN monthly now ON now.CustomerID = c.CustomerID AND now.Month = c.First + c.k
    LEFT JOIN monthly before ON before.CustomerID = c.CustomerID AND before.Month = c.First + c.k - 1
),
counts AS (
    SELECT First, k, COUNT(*) AS Customers, COUNT(*) FILTER (WHERE here) AS Active, COUNT(*) FILTER (WHERE here AND there) AS Retained,
           COUNT(*) FILTER (WHERE there AND NOT here) AS Churned, COUNT(*) FILTER (WHERE here AND NOT there AND k > 0) AS Returned
    FROM states GROUP BY ALL
)""", f"""
SELECT {month_text('First')} AS Cohort, CAST(k AS INTEGER) AS "Offset", Customers, Active, Retained, Churned, Returned,
       {rr('Active', 'Customers', 4)} AS RetentionRate, {rr('Churned', 'Churned + Retained', 4)} AS ChurnRate
FROM counts""")

VALUE_GROWTH = _with(MONTHLY + """,
series AS (
    SELECT f.CustomerID, f.First, g.Month - f.First AS x, COALESCE(m.Orders, 0) AS Orders, COALESCE(m.Spend, 0) AS Spend,
           CAST(CAST(m.Spend AS DOUBLE) / m.Orders AS DECIMAL(20,6)) AS Value
    FROM (SELECT CustomerID, First, unnest(range(First, (SELECT LastMonth FROM lastm) + 1)) AS Month FROM firstm) g
    JOIN firstm f USING (CustomerID) LEFT JOIN monthly m ON m.CustomerID = g.CustomerID AND m.Month = g.Month
)""", f"""
SELECT CustomerID, {month_text('MIN(First)')} AS FirstMonth, COUNT(*) AS Months, COUNT(Value) AS ActiveMonths, CAST(SUM(Orders) AS BIGINT) AS Orders,
       round(regr_slope(CAST(Orders AS DOUBLE), CAST(x AS DOUBLE)), 6) AS FrequencyGrowth,
       round(regr_slope(CAST(Spend AS DOUBLE), CAST(x AS DOUBLE)), 6) AS SpendGrowth,
       round(regr_slope(CAST(Value AS DOUBLE), CAST(x AS DOUBLE)), 6) AS OrderValueGrowth
FROM series GROUP BY CustomerID""")


def _label(state: str, month: str) -> str:
    recency = f"date_sub('day', {state}_last, make_timestamp(({month} + 1) // 12, ({month} + 1) % 12 + 1, 1, 0, 0, 0))"
    return (f"CASE WHEN {state}_orders IS NULL THEN '(new)' ELSE "
            f"CASE WHEN {recency} < 90 THEN 'Active' WHEN {recency} < 180 THEN 'Recent' ELSE 'Inactive' END || ' ' || "
            f"CASE WHEN {state}_orders > 8 THEN 'Loyal' WHEN {state}_orders > 4 THEN 'Regular' ELSE 'Occasional' END || ' ' || "
            f"CASE WHEN {state}_spend > 100000 THEN 'High-Value' WHEN {state}_spend > 40000 THEN 'Mid-Value' ELSE 'Low-Value' END END")


SEGMENT_MIGRATION = _with(MONTHLY + f""",
states AS (
    SELECT CustomerID, LastMonth,
           COUNT(*) AS a_orders, SUM(OrderTotal) AS a_spend, MAX(LastDate) AS a_last,
           NULLIF(COUNT(*) FILTER (WHERE Month <= LastMonth - 12), 0) AS b_orders,
           SUM(OrderTotal) FILTER (WHERE Month <= LastMonth - 12) AS b_spend, MAX(LastDate) FILTER (WHERE Month <= LastMonth - 12) AS b_last
    FROM known CROSS JOIN lastm GROUP BY ALL
),
moves AS (
    SELECT {_label('b', '(LastMonth - 12)')} AS FromSegment, {_label('a', 'LastMonth')} AS ToSegment, COUNT(*) AS Customers,
           CAST(COALESCE(SUM(b_spend), 0) AS DOUBLE) AS MonetaryBefore, CAST(SUM(a_spend) AS DOUBLE) AS MonetaryNow
    FROM states GROUP BY ALL
)""", f"""
SELECT m.*, {rr('Customers', 'n', 4)} AS ShareOfFrom
FROM moves m JOIN (SELECT FromSegment, SUM(Customers) AS n FROM moves GROUP BY ALL) t USING (FromSegment)""")

CATEGORY_PENETRATION = _with(SEGMENTED + """,
own AS (SELECT CustomerID, Segment FROM final),
bought AS (
    SELECT CustomerID, Segment, COALESCE(split_part(Description, ' ', 1), '(none)') AS Category, TotalAmount
    FROM clean JOIN own USING (CustomerID)
),
cube AS (
    SELECT GROUPING(Segment, Category) AS g, Segment, Category, COUNT(DISTINCT CustomerID) AS Customers, SUM(TotalAmount) AS Revenue
    FROM bought GROUP BY CUBE (Segment, Category)
),
sizes AS (SELECT Segment, COUNT(*) AS Size FROM own GROUP BY Segment),
grid AS (
    SELECT 0 AS Level, Segment, Category, Size FROM sizes CROSS JOIN (SELECT DISTINCT Category FROM bought)
    UNION ALL SELECT 1, Segment, NULL, Size FROM sizes
    UNION ALL SELECT 2, NULL, Category, SUM(Size) FROM sizes CROSS JOIN (SELECT DISTINCT Category FROM bought) GROUP BY Category
    UNION ALL SELECT 3, NULL, NULL, SUM(Size) FROM sizes
)""", f"""
SELECT Level, g.Segment, g.Category, COALESCE(Customers, 0) AS Customers, CAST(Size AS BIGINT) AS SegmentCustomers,
       {rr('COALESCE(Customers, 0)', 'Size', 4)} AS Penetration, CAST(COALESCE(Revenue, 0) AS DOUBLE) AS Revenue
FROM grid g LEFT JOIN cube c
  ON c.g = CASE Level WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 2 ELSE 3 END
 AND c.Segment IS NOT DISTINCT FROM g.Segment AND c.Category IS NOT DISTINCT FROM g.Category""")

SECOND_PURCHASE = _with(SEGMENTED + """,
placed AS (
    SELECT CustomerID, OrderDate, ROW_NUMBER() OVER (PARTITION BY CustomerID ORDER BY OrderDate, InvoiceNo) AS no FROM ord WHERE InvoiceNo IS NOT NULL
),
two AS (
    SELECT CustomerID, MIN(OrderDate) FILTER (WHERE no = 1) AS first, MIN(OrderDate) FILTER (WHERE no = 2) AS second FROM placed GROUP BY CustomerID
),
days AS (SELECT Segment, second, date_sub('day', first, second) AS d FROM two JOIN final USING (CustomerID)),
per AS (
    SELECT Segment, COUNT(*) AS Customers, COUNT(second) AS RepeatCustomers, SUM(d) AS Days,
           COUNT(*) FILTER (WHERE d <= 30) AS Within30, COUNT(*) FILTER (WHERE d <= 90) AS Within90, COUNT(*) FILTER (WHERE d <= 365) AS Within365
    FROM days GROUP BY Segment
)""", f"""
SELECT Segment, Customers, RepeatCustomers, {rr('RepeatCustomers', 'Customers', 4)} AS RepeatRate, {rr('Days', 'RepeatCustomers', 2)} AS MeanDaysToSecond,
       Within30, Within90, Within365, {rr('Within30', 'Customers', 4)} AS Within30Rate, {rr('Within90', 'Customers', 4)} AS Within90Rate,
       {rr('Within365', 'Customers', 4)} AS Within365Rate
FROM per""")

TIME_BETWEEN_PURCHASES = _with(SEGMENTED, f"""
SELECT Segment, COUNT(g) AS Gaps, {rr('SUM(g)', 'COUNT(g)', 2)} AS MeanDays, MIN(g) AS MinDays, MAX(g) AS MaxDays, quantile_disc(g, 0.5) AS MedianDays
FROM gaps JOIN final USING (CustomerID) WHERE g IS NOT NULL GROUP BY Segment""")

CSV_QUARANTINE = _with(TX + """,
marked AS (
    SELECT *, CASE (CAST(InvoiceNo AS BIGINT) * 31 + CAST(StockCode AS BIGINT)) % 17
                WHEN 0 THEN 'InvoiceDate is in none of the known layouts' WHEN 1 THEN 'Quantity is no whole number'
                WHEN 2 THEN 'UnitPrice has more than 4 decimal places' WHEN 3 THEN 'UnitPrice is no number'
                WHEN 4 THEN 'CustomerID is no whole number' ELSE 'good' END AS Outcome
    FROM online_retail
)""", """
SELECT Outcome, COUNT(*) AS Lines, CAST(COALESCE(SUM(Quantity) FILTER (WHERE Outcome = 'good'), 0) AS BIGINT) AS Units,
       CAST(COALESCE(SUM(Quantity * UnitPrice) FILTER (WHERE Outcome = 'good'), 0) AS DOUBLE) AS Revenue
FROM marked GROUP BY Outcome
UNION ALL SELECT 'all', COUNT(*), 0, 0 FROM marked""")

CUSTOMER_ALIGNMENT = _with(TX + """,
known AS (SELECT *, Quantity * UnitPrice AS Value, year(InvoiceDate) AS Year FROM online_retail WHERE CustomerID IS NOT NULL),
bounds AS (SELECT MIN(Year) AS FirstYear, MAX(Year) AS LastYear FROM known),
early AS (SELECT CustomerID, CAST(SUM(Value) AS DOUBLE) AS EarlySpend FROM known, bounds WHERE Year = FirstYear AND Quantity > 0 GROUP BY CustomerID),
late AS (SELECT CustomerID, CAST(SUM(Value) AS DOUBLE) AS LateSpend FROM known, bounds WHERE Year = LastYear AND Quantity > 0 GROUP BY CustomerID),
returns AS (SELECT CustomerID, COUNT(*) AS ReturnLines, CAST(SUM(Value) AS DOUBLE) AS Returned FROM known WHERE Quantity < 0 GROUP BY CustomerID)""", """
SELECT CustomerID, EarlySpend, LateSpend, COALESCE(ReturnLines, 0) AS ReturnLines, Returned, e.CustomerID IS NOT NULL AS InEarly, l.CustomerID IS NOT NULL AS InLate,
       r.CustomerID IS NOT NULL AS InReturns
FROM early e FULL OUTER JOIN late l USING (CustomerID) FULL OUTER JOIN returns r USING (CustomerID)""")

ORACLES: dict[str, str] = {
    "revenue_by_country": REVENUE_BY_COUNTRY,
    "monthly_revenue": MONTHLY_REVENUE,
    "top_products": TOP_PRODUCTS,
    "customer_frequency": CUSTOMER_FREQUENCY,
    "category_revenue": CATEGORY_REVENUE,
    "clean_transactions": CLEAN_TRANSACTIONS,
    "rfm": RFM,
    "behaviour_metrics": BEHAVIOUR_METRICS,
    "value_projection": VALUE_PROJECTION,
    "cluster_labels": CLUSTER_LABELS,
    "segment_insights": SEGMENT_INSIGHTS,
    "segment_summary": SEGMENT_SUMMARY,
    "date_dimension": DATE_DIMENSION,
    "cluster_profile": CLUSTER_PROFILE,
    "segment_sizes": SEGMENT_SIZES,
    "segment_ranking": SEGMENT_RANKING,
    "segment_contribution": SEGMENT_CONTRIBUTION,
    "headline_kpis": HEADLINE_KPIS,
    "customer_sample": CUSTOMER_SAMPLE,
    "csv_quarantine": CSV_QUARANTINE,
    "bucketed_customer_frequency": CUSTOMER_FREQUENCY,
    "customer_alignment": CUSTOMER_ALIGNMENT,
    "product_affinity": PRODUCT_AFFINITY,
    "category_sets": CATEGORY_SETS,
    "cohort_retention": COHORT_RETENTION,
    "segment_migration": SEGMENT_MIGRATION,
    "value_growth": VALUE_GROWTH,
    "category_penetration": CATEGORY_PENETRATION,
    "second_purchase": SECOND_PURCHASE,
    "time_between_purchases": TIME_BETWEEN_PURCHASES,
    "dashboard_text": DASHBOARD_TEXT,
    "segment_interpretation": SEGMENT_INTERPRETATION,
    "segment_actions": SEGMENT_ACTIONS,
    "customer_actions": CUSTOMER_ACTIONS,
    "segment_kpis": SEGMENT_KPIS,
    "csv_roundtrip": CLEAN_TRANSACTIONS,
    "pipeline_export": PIPELINE_EXPORT,
    "scaled_features": SCALED_FEATURES,
    "standin_silhouette": STANDIN_SILHOUETTE,
    "standin_inertia": STANDIN_INERTIA,
    "kmeans_fixed_start": KMEANS_FIXED_START,
    "k_selection_fixed_starts": K_SELECTION_FIXED_STARTS,
    "pipeline_run": PIPELINE_RUN,
    "pca_components": PCA_COMPONENTS,
    "pca_projection": PCA_PROJECTION,
}

__all__ = ["ORACLES", "HALF_EVEN", "HALF_UP", "rr"]
