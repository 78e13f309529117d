"""Segment-level results.

Input is the per-customer table after value projection (one row per
customer with Segment, Cluster and the projected metrics). Segment tables
have at most 27 rows (3 x 3 x 3 labels); whatever is computed *over
segments* (shares, medians, rankings) runs on that small table after one
partial aggregate over the customers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tillroll.functions.columns import HALF_EVEN, MONEY_SCALE, round_ratio
from tillroll.functions.dates import date_attributes

# Means rounded like a pandas ``.round(2)``: half to even. Exact for integer
# and DECIMAL features (see tillroll.functions.exact); floating features are
# brought to six decimal places first, so their sums are exact as well and no
# row order moves a half cent.
_EXACT_MEANS = {"Recency": 0, "Frequency": 0, "Monetary": MONEY_SCALE, "ProductDiversity": 0}
FLOAT_SCALE = 6
INSIGHT_METRICS = ["Recency", "Frequency", "Monetary", "AvgOrderValue", "ProductDiversity",
                   "PredictedQuarterlyValue", "GrowthPotentialScore"]
RANKED_METRICS = ["Monetary", "Frequency", "PredictedQuarterlyValue", "GrowthPotentialScore",
                  "AvgOrderValue", "ProductDiversity"]


def segment_insights(final: DataFrame) -> DataFrame:
    """Rounded means per segment, CustomerCount and PercentOfCustomers
    (share of all customers, rounded half-even to 2 places)."""
    aggs = []
    for name in INSIGHT_METRICS:
        if name in _EXACT_MEANS:
            aggs.append(round_ratio(f"sum(`{name}`)", f"count(`{name}`)", 2, HALF_EVEN,
                                    _EXACT_MEANS[name]).alias(name))
        else:
            fixed = f"cast(`{name}` as decimal(20,{FLOAT_SCALE}))"
            aggs.append(round_ratio(f"sum({fixed})", f"count({fixed})", 2, HALF_EVEN, FLOAT_SCALE).alias(name))
    per_segment = final.groupBy("Segment").agg(*aggs, F.count(F.lit(1)).alias("CustomerCount"))
    total = per_segment.agg(F.sum("CustomerCount").alias("__total"))
    return (
        per_segment.crossJoin(F.broadcast(total))
        .withColumn("PercentOfCustomers",
                    round_ratio("CustomerCount * 100", "__total", 2, HALF_EVEN))
        .drop("__total")
        .orderBy("Segment")  # at most 27 rows
    )


def segment_summary(insights: DataFrame) -> DataFrame:
    """Export summary with a median-based ``Priority``.

    High: CustomerCount > median OR AvgMonetary > median OR GrowthScore > 50.
    Low (wins over High, as it is assigned last): CustomerCount < median/2
    AND AvgMonetary < median/2 AND GrowthScore < 25. Else Medium. Medians
    are over the segments. Totals use the *rounded* insight means.
    """
    base = insights.select(
        "Segment", "CustomerCount",
        F.col("PercentOfCustomers").alias("PercentOfTotal"),
        (F.col("Monetary") * F.col("CustomerCount")).alias("TotalRevenue"),
        F.col("Monetary").alias("AvgMonetary"),
        F.col("Frequency").alias("AvgFrequency"),
        F.col("Recency").alias("AvgRecency"),
        "AvgOrderValue", "ProductDiversity",
        (F.col("PredictedQuarterlyValue") * F.col("CustomerCount")).alias("PredictedValue"),
        F.col("GrowthPotentialScore").alias("GrowthScore"),
    )
    med = base.agg(F.median("CustomerCount").alias("__mc"), F.median("AvgMonetary").alias("__mm"))
    high = ((F.col("CustomerCount") > F.col("__mc")) | (F.col("AvgMonetary") > F.col("__mm"))
            | (F.col("GrowthScore") > 50))
    low = ((F.col("CustomerCount") < F.col("__mc") / 2) & (F.col("AvgMonetary") < F.col("__mm") / 2)
           & (F.col("GrowthScore") < 25))
    return (
        base.crossJoin(F.broadcast(med))
        .withColumn("Priority", F.when(low, "Low").when(high, "High").otherwise("Medium"))
        .drop("__mc", "__mm")
    )


def date_dimension(final: DataFrame, lead_days: int = 90) -> DataFrame:
    """One row per day from the first FirstPurchase to the last
    FirstPurchase + ``lead_days``, keeping the time of day of the start
    (a daily range stops at or before the end), with calendar attributes.
    The range comes from a 1-row min/max; its length is bounded by the
    calendar span, not by the data volume."""
    span = final.agg(F.min("FirstPurchase").alias("lo"), F.max("FirstPurchase").alias("hi"))
    days = span.select(
        F.explode(
            F.sequence(F.col("lo"), F.col("hi") + F.make_dt_interval(F.lit(lead_days)),
                       F.expr("INTERVAL 1 DAY"))
        ).alias("Date")
    )
    return days.select("Date", *date_attributes(F.col("Date")))


def segment_sizes(final: DataFrame) -> DataFrame:
    """Customers per cluster and per segment, in one long table
    (Level = 'Cluster' | 'Segment') from one pass over the customers:
    clusters by id, then segments by size (largest first), then name."""
    sizes = final.groupingSets([["Cluster"], ["Segment"]], "Cluster", "Segment").agg(
        F.count(F.lit(1)).alias("CustomerCount"), F.grouping("Cluster").alias("by_segment"))
    by_segment = F.col("by_segment") == 1
    return (
        sizes.orderBy(  # at most 37 rows
            "by_segment", F.when(~by_segment, F.col("Cluster")), F.when(by_segment, -F.col("CustomerCount")), "Segment")
        .select(
            F.when(by_segment, "Segment").otherwise("Cluster").alias("Level"),
            F.when(by_segment, F.col("Segment")).otherwise(F.col("Cluster").cast("string")).alias("Name"),
            "CustomerCount",
        )
    )


def segment_contribution(final: DataFrame) -> DataFrame:
    """Customers and revenue of each segment, their shares of all (exact, four places) and the revenue per customer.
    The totals are a window over the segments, at most 27 rows."""
    per = final.groupBy("Segment").agg(F.count(F.lit(1)).alias("Customers"), F.sum("Monetary").alias("Revenue"))
    whole = Window.partitionBy(F.lit(1))
    totals = per.withColumns({"AllCustomers": F.sum("Customers").over(whole), "AllRevenue": F.sum("Revenue").over(whole)})
    scaled = f"cast({{}} * {10 ** MONEY_SCALE} as decimal(32,0))"
    return totals.select(
        "Segment", "Customers", "Revenue", round_ratio("Customers", "AllCustomers", 4).alias("CustomerShare"),
        round_ratio(scaled.format("Revenue"), scaled.format("AllRevenue"), 4).alias("RevenueShare"),
        round_ratio("Revenue", "Customers", 2, num_scale=MONEY_SCALE).alias("RevenuePerCustomer"))


def segment_ranking(insights: DataFrame) -> DataFrame:
    """Segments ranked by each of six metrics (1 = highest value, ties
    by segment name), one long table (Metric, Segment, Value, Rank)."""
    stack = ", ".join(f"'{m}', cast(`{m}` as double)" for m in RANKED_METRICS)
    long = insights.select("Segment", F.expr(f"stack({len(RANKED_METRICS)}, {stack}) as (Metric, Value)"))
    w = Window.partitionBy("Metric").orderBy(F.desc("Value"), F.asc("Segment"))
    return long.select("Metric", "Segment", "Value", F.row_number().over(w).alias("Rank"))


def headline_kpis(insights: DataFrame) -> DataFrame:
    """Total customers, total revenue (rounded mean spend x count),
    average customer value and predicted quarterly revenue. The rounded
    means are 2-place values, so the weighted sums are exact in DECIMAL."""
    money = "decimal(38,2)"
    agg = insights.agg(
        F.sum("CustomerCount").alias("TotalCustomers"),
        F.sum(F.col("Monetary").cast(money) * F.col("CustomerCount")).alias("rev"),
        F.sum(F.col("PredictedQuarterlyValue").cast(money) * F.col("CustomerCount")).alias("pqr"),
    )
    return agg.select(
        "TotalCustomers",
        F.col("rev").cast("double").alias("TotalRevenue"),
        F.try_divide(F.col("rev").cast("double"), F.col("TotalCustomers").cast("double")).alias("AvgCustomerValue"),
        F.col("pqr").cast("double").alias("PredictedQuarterlyRevenue"),
    )


# The sampling key is (CustomerID * SAMPLE_MULTIPLIER + seed)
# mod SAMPLE_MODULUS, with Knuth's multiplicative-hash constant floor(2^32 / phi)
# and the largest prime below 2^32.
SAMPLE_MULTIPLIER = 2654435761
SAMPLE_MODULUS = 4294967291


def sample_key(customer_id, seed: int = 42):
    """Repeatable pseudo-random rank of a customer id. The ids map like a
    golden-ratio sequence, so the smallest keys are spread evenly over the
    id range. Exact DECIMAL arithmetic: no overflow at any id, and another
    engine can compute the same key (the SQL oracle does)."""
    scaled = customer_id.cast("decimal(20,0)") * F.lit(SAMPLE_MULTIPLIER) + F.lit(seed)
    return F.pmod(scaled, F.lit(SAMPLE_MODULUS))


def customer_sample(final: DataFrame, n: int = 1000, seed: int = 42) -> DataFrame:
    """A fixed-size, repeatable sample of customers for plotting
    (all of them when there are at most ``n``), with the plot's point size
    Monetary / 100. Ordering by :func:`sample_key` and taking ``n`` plans
    as TakeOrderedAndProject: each task keeps only its own top ``n``."""
    return (
        final.select("CustomerID", "Recency", "Frequency", "Monetary", "Cluster", "Segment",
                     (F.col("Monetary").cast("double") / 100).alias("PointSize"))
        .orderBy(sample_key(F.col("CustomerID"), seed), F.col("CustomerID"))
        .limit(n)
    )


def dashboard_text(insights: DataFrame) -> DataFrame:
    """U20 text block (one row, column ``Summary``; its wording is a fixed value): the four headline
    figures and a breakdown per segment in segment-name order, lines joined
    with newlines. Built from the <= 27-row insights table with
    ``collect_list`` + ``array_sort``; numbers formatted like Python's
    ``{:,.0f}`` / ``{:.1f}``."""

    def fmt(c, places, grouping=True):
        s = F.format_number(c.cast("double"), places)
        return s if grouping else F.regexp_replace(s, ",", "")

    kpis = headline_kpis(insights)
    head = kpis.select(F.concat_ws(
        "\n",
        F.concat(F.lit("Total Customers: "), fmt(F.col("TotalCustomers"), 0)),
        F.concat(F.lit("Total Revenue: $"), fmt(F.col("TotalRevenue"), 0)),
        F.concat(F.lit("Average Customer Value: $"), fmt(F.col("AvgCustomerValue"), 0)),
        F.concat(F.lit("Predicted Quarterly Revenue: $"), fmt(F.col("PredictedQuarterlyRevenue"), 0)),
        F.lit("\nSegment Breakdown:"),
    ).alias("head"))
    entries = insights.select(F.struct(
        F.col("Segment").alias("k"),
        F.concat(
            F.lit("\n"), F.col("Segment"), F.lit(":"),
            F.lit("\n  • "), fmt(F.col("CustomerCount"), 0), F.lit(" customers ("),
            fmt(F.col("PercentOfCustomers"), 1, False), F.lit("%)"),
            F.lit("\n  • $"), fmt(F.col("Monetary"), 0), F.lit(" avg. spend"),
            F.lit("\n  • "), fmt(F.col("Frequency"), 1, False), F.lit(" avg. purchases"),
            F.lit("\n  • Growth potential: "), fmt(F.col("GrowthPotentialScore"), 1, False), F.lit("/100"),
        ).alias("v"),
    ).alias("e"))
    body = entries.agg(F.array_sort(F.collect_list("e")).alias("es"))
    return head.crossJoin(body).select(
        F.concat_ws("\n", F.col("head"), F.concat_ws("\n", F.transform("es", lambda e: e["v"]))).alias("Summary")
    )
