"""Customer lifecycle: retention and churn (X6), second purchase (X2), time between purchases (X3),
growth of order value and frequency (X5), segment migration (X8).

All of them read the orders of :func:`tillroll.operators.customers.customer_base`
(one row per customer and invoice, from one pass over the lines). Orders without
an invoice number are none, as in the order metrics. Months are numbered
``12 * year + month - 1``. Every aggregate is partial; the only
windows run over the months of a customer or the days of a segment, whose
number the calendar bounds.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillroll.functions.columns import round_ratio, whole_days
from tillroll.operators.customers import gap_rows
from tillroll.session import materialize

WORD = 64  # months in a word of an activity bitmap


def month_number(c: str) -> Column:
    return F.year(c) * 12 + F.month(c) - 1


def month_name(number: Column) -> Column:
    """``yyyy-MM`` of a month number."""
    return F.concat_ws("-", F.lpad(F.floor(number / 12).cast("string"), 4, "0"), F.lpad((number % 12 + 1).cast("string"), 2, "0"))


def _known(orders: DataFrame) -> DataFrame:
    return orders.where(F.col("InvoiceNo").isNotNull())


# ---------------------------------------------------------------- X6: retention, churn, reactivation

def activity_bitmaps(orders: DataFrame) -> DataFrame:
    """CustomerID, Cohort (number of the first active month) and Active: bit k of the words says whether
    the customer bought in month Cohort + k.

    Bits are set by ``bit_or`` per customer and calendar word, then shifted so that the cohort month is bit 0.
    """
    month = month_number("OrderDate")
    words = _known(orders).groupBy("CustomerID", F.floor(month / WORD).cast("int").alias("Word")).agg(
        F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(month, F.lit(WORD)).cast("int"))).alias("Bits"),
        F.min(month).alias("First"))
    customers = words.groupBy("CustomerID").agg(
        F.min("First").alias("Cohort"), F.max("Word").alias("LastWord"), F.map_from_entries(F.collect_list(F.struct("Word", "Bits"))).alias("Words"))
    first_word, shift = F.floor(F.col("Cohort") / WORD).cast("int"), F.pmod("Cohort", F.lit(WORD)).cast("int")
    bits = lambda w: F.coalesce(F.try_element_at("Words", w), F.lit(0).cast("long"))
    right = lambda x, n: F.call_function("shiftrightunsigned", x, n)
    left = lambda x, n: F.call_function("shiftleft", x, n)
    shifted = F.transform(F.sequence(first_word, F.col("LastWord")), lambda w: F.when(shift == 0, bits(w)).otherwise(
        right(bits(w), shift).bitwiseOR(left(bits(w + 1), F.lit(WORD) - shift))))
    return customers.select("CustomerID", "Cohort", shifted.alias("Active"))


def cohort_retention(orders: DataFrame) -> DataFrame:
    """The cohort triangle. One row per first month and number of months since, up to the last month of the data.

    Active bought in that month; Retained also did in the month before, Returned did not (but earlier), Churned did in the
    month before only. RetentionRate = Active / Customers, ChurnRate = Churned / those active in the month before.
    Customers with equal bitmaps are counted once; the events come from shifts of the words against each other.
    """
    bitmaps = activity_bitmaps(orders).groupBy("Cohort", "Active").agg(F.count(F.lit(1)).alias("n"))
    bitmaps = materialize(bitmaps, "activity")
    word = lambda c, i: F.coalesce(F.get(c, i), F.lit(0).cast("long"))
    left = lambda x, n: F.call_function("shiftleft", x, F.lit(n))
    carry = lambda i: F.call_function("shiftrightunsigned", word("Active", i - 1), F.lit(WORD - 1))
    last = bitmaps.select("Cohort", F.explode(F.sequence(F.lit(0), F.size("Active") * WORD - 1)).alias("k"), "Active").where(
        _bit("Active", F.col("k")) == 1).agg(F.max(F.col("Cohort") + F.col("k")).alias("LastMonth"))
    cells = bitmaps.crossJoin(F.broadcast(last)).withColumn("Span", F.floor((F.col("LastMonth") - F.col("Cohort")) / WORD).cast("int"))
    # bit k of Before: active in month k - 1
    before = F.transform(F.sequence(F.lit(0), "Span"), lambda i: left(word("Active", i), 1).bitwiseOR(carry(i)))
    active = F.transform(F.sequence(F.lit(0), "Span"), lambda i: word("Active", i))
    cells = cells.select("Cohort", "n", "LastMonth", active.alias("Active"), before.alias("Before"))
    both = F.zip_with("Active", "Before", lambda a, b: a.bitwiseAND(b))
    gone = F.zip_with("Active", "Before", lambda a, b: F.bitwise_not(a).bitwiseAND(b))
    back = F.zip_with("Active", "Before", lambda a, b: a.bitwiseAND(F.bitwise_not(b)))
    events = cells.select("Cohort", "n", "Active", both.alias("Both"), gone.alias("Gone"), back.alias("Back"),
                          F.explode(F.sequence(F.lit(0), F.col("LastMonth") - F.col("Cohort"))).alias("Offset"))
    count = lambda c: F.sum(F.col("n") * _bit(c, F.col("Offset")))
    triangle = events.groupBy("Cohort", "Offset").agg(
        F.sum("n").alias("Customers"), count("Active").alias("Active"), count("Both").alias("Retained"), count("Gone").alias("Churned"),
        F.when(F.col("Offset") > 0, count("Back")).otherwise(F.lit(0).cast("long")).alias("Returned"))
    return triangle.select(
        month_name(F.col("Cohort")).alias("Cohort"), F.col("Offset").cast("int").alias("Offset"), "Customers", "Active", "Retained", "Churned", "Returned",
        round_ratio("Active", "Customers", 4).alias("RetentionRate"), round_ratio("Churned", "Churned + Retained", 4).alias("ChurnRate"))


def _bit(words: str, k: Column) -> Column:
    word = F.coalesce(F.get(words, F.floor(k / WORD).cast("int")), F.lit(0).cast("long"))
    return F.call_function("shiftrightunsigned", word, F.pmod(k, F.lit(WORD)).cast("int")).bitwiseAND(F.lit(1).cast("long"))


# ---------------------------------------------------------------- X2: second purchase

def first_two_orders(orders: DataFrame) -> DataFrame:
    """CustomerID, Orders, FirstOrder, SecondOrder (null after a single order) and DaysToSecond (whole days).

    The two smallest orders by (date, invoice) without a sort: the least per
    customer, then the least of the others. Both are partial minimums, and the
    join between them carries one row per customer, so a hot customer's orders stay spread.
    """
    known = _known(orders).select("CustomerID", F.struct("OrderDate", "InvoiceNo").alias("Placed"))
    first = known.groupBy("CustomerID").agg(F.min("Placed").alias("First"), F.count(F.lit(1)).alias("Orders"))
    first = materialize(first, "first-orders")
    again = first.where("Orders > 1").select("CustomerID", "First")
    second = (known.join(again, "CustomerID").where(F.col("Placed") != F.col("First"))
              .groupBy("CustomerID").agg(F.min("Placed").alias("Second")))
    both = first.join(second, "CustomerID", "left")
    return both.select("CustomerID", "Orders", F.col("First.OrderDate").alias("FirstOrder"), F.col("Second.OrderDate").alias("SecondOrder"),
                       whole_days(F.col("First.OrderDate"), F.col("Second.OrderDate")).alias("DaysToSecond"))


def second_purchase(orders: DataFrame, segments: DataFrame, within: tuple[int, ...] = (30, 90, 365)) -> DataFrame:
    """X2, per Segment: Customers, RepeatCustomers, RepeatRate, the mean days to the second order (exact, two places),
    and for each window how many ordered again within so many days, and their share."""
    rows = first_two_orders(orders).join(segments.select("CustomerID", "Segment"), "CustomerID")
    counts = [F.count(F.when(F.col("DaysToSecond") <= d, 1)).alias(f"Within{d}") for d in within]
    per = rows.groupBy("Segment").agg(
        F.count(F.lit(1)).alias("Customers"), F.count("SecondOrder").alias("RepeatCustomers"),
        F.sum("DaysToSecond").alias("Days"), *counts)
    return per.select(
        "Segment", "Customers", "RepeatCustomers", round_ratio("RepeatCustomers", "Customers", 4).alias("RepeatRate"),
        round_ratio("Days", "RepeatCustomers", 2).alias("MeanDaysToSecond"), *[f"Within{d}" for d in within],
        *[round_ratio(f"Within{d}", "Customers", 4).alias(f"Within{d}Rate") for d in within])


# ---------------------------------------------------------------- X3: time between purchases

def time_between_purchases(orders: DataFrame, segments: DataFrame) -> DataFrame:
    """X3, per Segment: Gaps (pairs of consecutive orders of a customer), MeanDays (exact, two places), MinDays, MaxDays
    and MedianDays (the lower of two middle gaps).

    Gaps are whole days, so their distribution has a row per day at most and gives exact order statistics;
    :func:`gap_sketches` is the form for further merging (by week, by region).
    """
    days = (gap_rows(_known(orders)).join(segments.select("CustomerID", "Segment"), "CustomerID")
            .groupBy("Segment", "GapDays").agg(F.sum("n").alias("n")))
    upto = Window.partitionBy("Segment").orderBy("GapDays")
    whole = Window.partitionBy("Segment")
    ranked = days.withColumns({"Upto": F.sum("n").over(upto), "All": F.sum("n").over(whole)})
    return ranked.groupBy("Segment").agg(
        F.sum("n").alias("Gaps"), round_ratio("sum(n * GapDays)", "sum(n)", 2).alias("MeanDays"), F.min("GapDays").alias("MinDays"),
        F.max("GapDays").alias("MaxDays"), F.min(F.when(2 * F.col("Upto") >= F.col("All"), F.col("GapDays"))).alias("MedianDays"))


def gap_sketches(orders: DataFrame, segments: DataFrame, k: int = 400) -> DataFrame:
    """Per Segment a KLL sketch of the gaps, mergeable with others (``kll_merge_agg_bigint``), its number of gaps and the exact mean.

    ``k`` sets the size: the rank of a quantile is off by about 0.9 % of the gaps at 400 (with 99 % confidence), whatever their number.
    """
    rows = gap_rows(_known(orders)).join(segments.select("CustomerID", "Segment"), "CustomerID")
    each = rows.select("Segment", "GapDays", F.explode(F.sequence(F.lit(1).cast("long"), "n")))
    sketches = each.groupBy("Segment").agg(F.kll_sketch_agg_bigint("GapDays", F.lit(k)).alias("Sketch"))
    means = rows.groupBy("Segment").agg(F.sum("n").alias("Gaps"), round_ratio("sum(n * GapDays)", "sum(n)", 2).alias("MeanDays"))
    return means.join(sketches, "Segment")


# ---------------------------------------------------------------- X5: growth of order value and frequency

def monthly_orders(orders: DataFrame) -> DataFrame:
    """CustomerID, Month, Orders, Spend and LastDate of the months with orders."""
    return _known(orders).groupBy("CustomerID", month_number("OrderDate").alias("Month")).agg(
        F.count(F.lit(1)).alias("Orders"), F.sum("OrderTotal").alias("Spend"), F.max("LastDate").alias("LastDate"))


def calendar_series(monthly: DataFrame, last_month: Column) -> DataFrame:
    """Each customer's months from the first with orders to ``last_month``: X (0, 1, ...), Orders and Spend, 0 where there are none."""
    spans = monthly.groupBy("CustomerID").agg(F.min("Month").alias("First"))
    months = spans.select("CustomerID", "First", F.explode(F.sequence(F.col("First"), last_month)).alias("Month"))
    return months.join(monthly, ["CustomerID", "Month"], "left").select(
        "CustomerID", "Month", (F.col("Month") - F.col("First")).alias("X"), F.coalesce("Orders", F.lit(0).cast("long")).alias("Orders"),
        F.coalesce("Spend", F.lit(0)).alias("Spend"))


def _slope(n: Column, sx: Column, sxx: Column, sy: Column, sxy: Column) -> Column:
    """Least-squares slope from exact sums; null for a single x."""
    return F.try_divide((n * sxy - sx * sy).cast("double"), (n * sxx - sx * sx).cast("double"))


def value_growth(orders: DataFrame) -> DataFrame:
    """X5, per customer: the trend per month of orders (frequency growth), spend and average order value.

    Orders and spend are series over the whole calendar from the customer's
    first month to the last of the data, empty months as 0; the order value has
    a value only where there are orders. The slopes come from sums that merge
    (n, Σx, Σx², Σy, Σxy), one aggregate a customer. An empty month adds only to the sums of x, which are known from
    n, so the filled series (:func:`calendar_series`) is never built.
    """
    monthly = materialize(monthly_orders(orders), "monthly-orders")
    last = monthly.agg(F.max("Month").alias("LastMonth"))
    exact, month = "decimal(38,6)", F.col("Month").cast("long")
    series = {"Orders": F.col("Orders"), "Spend": F.col("Spend"), "Value": (F.col("Spend").cast("double") / F.col("Orders")).cast("decimal(20,6)")}
    sums = monthly.groupBy("CustomerID").agg(
        F.min(month).alias("First"), F.count(F.lit(1)).alias("ActiveMonths"), F.sum(month).alias("m"), F.sum(month * month).alias("mm"),
        *[F.sum(y).cast(exact).alias(f"{c}_y") for c, y in series.items()], *[F.sum(y * month).cast(exact).alias(f"{c}_my") for c, y in series.items()])
    # the sums count months from year 0; from here on x counts them from the customer's first
    n, active, first = F.col("Months"), F.col("ActiveMonths"), F.col("First")
    whole = lambda c: c.cast("decimal(18,0)")
    y = lambda c: F.col(f"{c}_y").cast("decimal(24,6)")
    xy = lambda c: (F.col(f"{c}_my") - first.cast("decimal(9,0)") * F.col(f"{c}_y").cast("decimal(27,6)")).cast("decimal(26,6)")
    sx, sxx = whole(n * (n - 1) / 2), whole(n * (n - 1) * (2 * n - 1) / 6)
    ax, axx = whole(F.col("m") - active * first), whole(F.col("mm") - 2 * first * F.col("m") + active * first * first)
    trend = lambda c: _slope(n.cast("decimal(9,0)"), sx, sxx, y(c), xy(c))
    value_trend = _slope(active.cast("decimal(9,0)"), ax, axx, y("Value"), xy("Value"))
    return sums.crossJoin(F.broadcast(last)).withColumn("Months", (F.col("LastMonth") - first + 1).cast("long")).select(
        "CustomerID", month_name(first).alias("FirstMonth"), "Months", "ActiveMonths", F.col("Orders_y").cast("long").alias("Orders"),
        trend("Orders").alias("FrequencyGrowth"), trend("Spend").alias("SpendGrowth"), value_trend.alias("OrderValueGrowth"))


# ---------------------------------------------------------------- X8: segment migration

class Rules(NamedTuple):
    """Limits of the customer segments at a date: recency in whole days, number of orders, money spent."""

    active_days: int = 90
    recent_days: int = 180
    loyal_orders: int = 8
    regular_orders: int = 4
    high_value: int = 100_000
    mid_value: int = 40_000


NEW = "(new)"


def monthly_state(orders: DataFrame) -> DataFrame:
    """CustomerID, Month and the state at its end: Frequency, Monetary and LastDate over all months so far.
    A window over a customer's months, whose number the calendar bounds."""
    so_far = Window.partitionBy("CustomerID").orderBy("Month").rowsBetween(Window.unboundedPreceding, 0)
    return monthly_orders(orders).select(
        "CustomerID", "Month", F.sum("Orders").over(so_far).alias("Frequency"), F.sum("Spend").over(so_far).alias("Monetary"),
        F.max("LastDate").over(so_far).alias("LastDate"))


def state_as_of(states: DataFrame, months: dict[str, Column]) -> DataFrame:
    """Per customer one struct (Month, Frequency, Monetary, LastDate) for each named month: the state at its end, null before
    the first order. All of them come from one aggregate over ``states``."""
    state = F.struct("Month", "Frequency", "Monetary", "LastDate")
    return states.groupBy("CustomerID").agg(*[F.max(F.when(F.col("Month") <= m, state)).alias(name) for name, m in months.items()])


def state_label(state: str, month: Column, rules: Rules) -> Column:
    """The segment of a state at the end of ``month``: the words of the cluster labels, by fixed limits."""
    end = F.make_timestamp_ntz(F.floor((month + 1) / 12).cast("int"), ((month + 1) % 12 + 1).cast("int"), F.lit(1), F.lit(0), F.lit(0), F.lit(0))
    recency = whole_days(F.col(f"{state}.LastDate"), end)
    frequency, monetary = F.col(f"{state}.Frequency"), F.col(f"{state}.Monetary")
    words = F.concat_ws(
        " ", F.when(recency < rules.active_days, "Active").when(recency < rules.recent_days, "Recent").otherwise("Inactive"),
        F.when(frequency > rules.loyal_orders, "Loyal").when(frequency > rules.regular_orders, "Regular").otherwise("Occasional"),
        F.when(monetary > rules.high_value, "High-Value").when(monetary > rules.mid_value, "Mid-Value").otherwise("Low-Value"))
    return F.when(F.col(state).isNull(), NEW).otherwise(words)


def segment_migration(orders: DataFrame, months_back: int = 12, rules: Rules = Rules()) -> DataFrame:
    """How many customers moved from one segment to another between the end of the month ``months_back`` before the last and the last.

    Customers without an order at the first date come from ``(new)``. Monetary sums are those at each date; ShareOfFrom is the part of
    the customers of FromSegment that moved to ToSegment.
    """
    states = materialize(monthly_state(orders), "monthly-state")
    last = states.agg(F.max("Month").alias("LastMonth"))
    dated = states.crossJoin(F.broadcast(last))
    at = {"Before": F.col("LastMonth") - months_back, "Now": F.col("LastMonth")}
    both = state_as_of(dated, at).crossJoin(F.broadcast(last))
    moved = both.select(
        state_label("Before", at["Before"], rules).alias("FromSegment"), state_label("Now", at["Now"], rules).alias("ToSegment"),
        F.coalesce(F.col("Before.Monetary"), F.lit(0)).alias("b"), F.col("Now.Monetary").alias("a"))
    matrix = moved.groupBy("FromSegment", "ToSegment").agg(
        F.count(F.lit(1)).alias("Customers"), F.sum("b").alias("MonetaryBefore"), F.sum("a").alias("MonetaryNow"))
    of = Window.partitionBy("FromSegment")  # at most 28 segments a side
    return matrix.withColumn("All", F.sum("Customers").over(of)).select(
        "FromSegment", "ToSegment", "Customers", "MonetaryBefore", "MonetaryNow", round_ratio("Customers", "All", 4).alias("ShareOfFrom"))
