"""Sales reports over invoice lines.

Each report is one filter + one hash aggregate (partial aggregation on the
map side, so a hot group key - one country with a third of all lines - is
combined before the shuffle). Several ``COUNT(DISTINCT ...)`` in one report
are rewritten by Catalyst into an Expand + two-level aggregate keyed on
(group, distinct value): the distinct values of a hot group are spread over
all reducers rather than sent to one.

Reference behaviours kept on purpose:

* U1, U2, U3 and U5 keep lines of guest customers (NULL CustomerID); only
  U4 drops them. NULL is not counted by COUNT(DISTINCT).
* U4's ``AverageOrderValue`` is the mean *line* value, not the mean order.
* U4's ``NumberOfActiveMonths`` counts calendar months ignoring the year.
* U5's ``ProductCount`` counts lines, not products.

Money is DECIMAL until the final rounding, which is exact and half away
from zero (SQL ``ROUND``); results are returned as DOUBLE. Every ORDER BY
carries a unique tie-break so that top-k results are deterministic.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillroll.functions.columns import HALF_UP, MONEY_SCALE, first_word, round_ratio

LINE_VALUE_SQL = "(Quantity * UnitPrice)"


def _line_value() -> Column:
    return F.col("Quantity") * F.col("UnitPrice")


def _revenue(alias: str) -> Column:
    return F.round(F.sum(_line_value()), 2).cast("double").alias(alias)


def _sold(tx: DataFrame) -> DataFrame:
    return tx.filter(F.col("Quantity") > 0)


def revenue_by_country(tx: DataFrame) -> DataFrame:
    """Revenue, customers and orders per country, by revenue."""
    return (
        _sold(tx)
        .groupBy("Country")
        .agg(
            _revenue("TotalRevenue"),
            F.count_distinct("CustomerID").alias("NumberOfCustomers"),
            F.count_distinct("InvoiceNo").alias("NumberOfOrders"),
        )
        .orderBy(F.desc("TotalRevenue"), F.asc("Country"))
    )


def monthly_revenue(tx: DataFrame) -> DataFrame:
    """Revenue, orders and customers per calendar month ('yyyy-MM')."""
    return (
        _sold(tx)
        .groupBy(F.date_format("InvoiceDate", "yyyy-MM").alias("Month"))
        .agg(
            _revenue("MonthlyRevenue"),
            F.count_distinct("InvoiceNo").alias("NumberOfOrders"),
            F.count_distinct("CustomerID").alias("NumberOfCustomers"),
        )
        .orderBy(F.asc_nulls_first("Month"))
    )


def top_products(tx: DataFrame, n: int = 10) -> DataFrame:
    """The ``n`` best-selling (StockCode, Description) pairs by units.

    ``orderBy(...).limit(n)`` plans as TakeOrderedAndProject: each task
    keeps its own top ``n`` and only those reach the final merge.
    """
    return (
        _sold(tx)
        .groupBy("StockCode", "Description")
        .agg(
            F.sum("Quantity").cast("long").alias("TotalQuantitySold"),
            _revenue("TotalRevenue"),
            F.count_distinct("CustomerID").alias("NumberOfUniqueCustomers"),
        )
        .orderBy(F.desc("TotalQuantitySold"), F.asc("StockCode"), F.asc_nulls_first("Description"))
        .limit(n)
    )


def customer_frequency(tx: DataFrame) -> DataFrame:
    """U4: orders, spend, mean line value and active months per customer."""
    return (
        _sold(tx)
        .filter(F.col("CustomerID").isNotNull())
        .groupBy("CustomerID")
        .agg(
            F.count_distinct("InvoiceNo").alias("NumberOfOrders"),
            _revenue("TotalSpent"),
            round_ratio(f"sum{LINE_VALUE_SQL}", f"count{LINE_VALUE_SQL}", 2, HALF_UP, num_scale=MONEY_SCALE)
            .alias("AverageOrderValue"),
            # a bit for each calendar month: a second distinct count would double the rows
            F.coalesce(F.bit_count(F.bit_or(F.call_function("shiftleft", F.lit(1), F.month("InvoiceDate")))).cast("long"), F.lit(0).cast("long"))
            .alias("NumberOfActiveMonths"),
        )
        .orderBy(F.desc("TotalSpent"), F.asc("CustomerID"))
    )


def category_revenue(tx: DataFrame, n: int = 15) -> DataFrame:
    """Lines and revenue per category (first word of Description), top ``n``."""
    return (
        _sold(tx)
        .groupBy(first_word(F.col("Description")).alias("Category"))
        .agg(F.count(F.lit(1)).alias("ProductCount"), _revenue("CategoryRevenue"))
        .orderBy(F.desc("CategoryRevenue"), F.asc_nulls_first("Category"))
        .limit(n)
    )


REPORTS = {
    "revenue_by_country": revenue_by_country,
    "monthly_revenue": monthly_revenue,
    "top_products": top_products,
    "customer_frequency": customer_frequency,
    "category_revenue": category_revenue,
}


def run_report(spark, name: str, view: str = "online_retail") -> DataFrame:
    """Run a report against a registered table or view (named-table scan)."""
    return REPORTS[name](spark.table(view))
