"""Per-customer metrics: RFM (U7), behaviour metrics (U8), value projection.

Plan shape
----------
Everything is derived from one pass over the lines that aggregates two
grouping sets at once: orders (CustomerID, InvoiceNo) - the reference
groups by that pair three times - and products (CustomerID, StockCode).
The aggregate is hash partitioned on all keys, so the invoices of a hot
customer spread over all reducers. Customer-level
aggregates on top of it are partial (map-side) aggregates too. The only
order-dependent step, the gaps between consecutive purchases, is computed
without a per-customer window (see :func:`purchase_regularity`).

Global scalars (the latest invoice date, the growth-score range) are 1-row
aggregates cross-joined as broadcasts; no window without a partition key.

Exactness: money stays DECIMAL (order-independent sums), day counts and
gap moments are integers, so recomputing any stage after an executor loss
gives bit-identical results.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tillroll.functions.columns import whole_days
from tillroll.session import materialize as _materialize

DAYS_PER_MONTH = 30.44  # fixed value: mean month length used by the projection
QUARTER_MONTHS = 3


class CustomerBase(NamedTuple):
    """The two per-customer building blocks derived from the lines:

    orders    one row per (CustomerID, InvoiceNo): OrderTotal (DECIMAL),
              OrderUnits, OrderDate (first line), LastDate (last line)
    products  one row per (CustomerID, StockCode) bought
    """

    orders: DataFrame
    products: DataFrame


ORDER_SET, PRODUCT_SET = 1, 2  # grouping_id values of the two grouping sets


def line_rollup(clean: DataFrame) -> DataFrame:
    """Both building blocks in one pass over the lines:
    ``GROUP BY GROUPING SETS ((CustomerID, InvoiceNo), (CustomerID, StockCode))``.
    One scan, one Expand, partial aggregation, one shuffle on all keys (a
    hot customer's invoices and products spread over the reducers)."""
    return clean.groupingSets(
        [["CustomerID", "InvoiceNo"], ["CustomerID", "StockCode"]], "CustomerID", "InvoiceNo", "StockCode"
    ).agg(
        F.sum("TotalAmount").alias("OrderTotal"),
        F.sum("Quantity").alias("OrderUnits"),
        F.min("InvoiceDate").alias("OrderDate"),
        F.max("InvoiceDate").alias("LastDate"),
        F.grouping_id().alias("gid"),
    )


def customer_base(clean: DataFrame, materialize: bool = True) -> CustomerBase:
    """Split the rollup into orders and products. The rollup is written once,
    partitioned by grouping set: the transaction joins run once, and a step
    that needs only one of the two reads only that one."""
    rollup = line_rollup(clean)
    if materialize:
        rollup = _materialize(rollup, "line_rollup", partition_by=["gid"])
    orders = rollup.filter(F.col("gid") == ORDER_SET).select(
        "CustomerID", "InvoiceNo", "OrderTotal", "OrderUnits", "OrderDate", "LastDate")
    products = rollup.filter(F.col("gid") == PRODUCT_SET).select("CustomerID", "StockCode")
    return CustomerBase(orders, products)


def _base(src: DataFrame | CustomerBase) -> CustomerBase:
    return src if isinstance(src, CustomerBase) else customer_base(src)


def latest_invoice(customers: DataFrame) -> DataFrame:
    """1-row frame with the latest invoice timestamp, from the last purchase of every customer."""
    return customers.agg(F.max("LastPurchase").alias("MaxDate"))


def _recency(last: str = "LastPurchase") -> F.Column:
    return whole_days(F.col(last), F.col("MaxDate") + F.expr("INTERVAL 1 DAY"))


def rfm(src: DataFrame | CustomerBase) -> DataFrame:
    """Recency (whole days from the last purchase to one day after the
    latest invoice), Frequency (distinct invoices, NULL counted once),
    Monetary (sum of line amounts); customers with Monetary <= 0 dropped.
    ``src`` is the cleaned lines or their :class:`CustomerBase`. One pass over
    the lines: the per-customer table is written, and the latest invoice read from it."""
    if isinstance(src, CustomerBase):
        orders = src.orders
    else:
        orders = src.groupBy("CustomerID", "InvoiceNo").agg(
            F.sum("TotalAmount").alias("OrderTotal"), F.max("InvoiceDate").alias("LastDate"))
    per_customer = _materialize(orders.groupBy("CustomerID").agg(
        F.max("LastDate").alias("LastPurchase"),
        F.count(F.lit(1)).alias("Frequency"),
        F.sum("OrderTotal").alias("Monetary"),
    ), "customers")
    return (
        per_customer.crossJoin(F.broadcast(latest_invoice(per_customer)))
        .select("CustomerID", _recency().alias("Recency"), "Frequency", "Monetary")
        .filter(F.col("Monetary") > 0)
    )


def _gaps_in_buckets(orders: DataFrame, bucket: str) -> DataFrame:
    """Distinct order instants with their number of orders ``k`` and the ``gap`` to the one before in the same bucket."""
    instants = (
        orders.filter(F.col("InvoiceNo").isNotNull())
        .groupBy("CustomerID", "OrderDate")
        .agg(F.count(F.lit(1)).alias("k"))
        .withColumn("Bucket", F.date_trunc(bucket, "OrderDate"))
    )
    inner = Window.partitionBy("CustomerID", "Bucket").orderBy("OrderDate")
    return instants.withColumn("gap", whole_days(F.lag("OrderDate").over(inner), F.col("OrderDate")))


def _edge() -> F.Column:
    """Whole days from the last instant of the customer's bucket before to the first of this one."""
    across = Window.partitionBy("CustomerID").orderBy("Bucket")
    return whole_days(F.lag("LastAt").over(across), F.col("FirstAt"))


def gap_rows(orders: DataFrame, bucket: str = "hour") -> DataFrame:
    """CustomerID, GapDays and ``n``: how often so many whole days lie between consecutive orders of the customer.
    Taken as in :func:`purchase_regularity`, without a window over all orders of a customer."""
    gaps = _materialize(_gaps_in_buckets(orders, bucket), "order-gaps")
    edges = gaps.groupBy("CustomerID", "Bucket").agg(F.min("OrderDate").alias("FirstAt"), F.max("OrderDate").alias("LastAt")).select(
        "CustomerID", _edge().alias("GapDays"), F.lit(1).cast("long").alias("n"))
    inside = gaps.select("CustomerID", F.explode(F.array(
        F.struct(F.col("gap").alias("GapDays"), F.lit(1).cast("long").alias("n")),
        F.struct(F.lit(0).cast("long").alias("GapDays"), (F.col("k") - 1).alias("n")))).alias("g")).select("CustomerID", "g.GapDays", "g.n")
    return edges.union(inside).where("GapDays IS NOT NULL AND n > 0").groupBy("CustomerID", "GapDays").agg(F.sum("n").alias("n"))


def purchase_regularity(orders: DataFrame, bucket: str = "hour") -> DataFrame:
    """Population standard deviation of the whole-day gaps between a
    customer's consecutive purchases (0 with fewer than two gaps).

    The reference sorts each customer's order dates in one place. Here a
    customer's orders are first collapsed to distinct instants with a
    multiplicity (k orders at one instant add k-1 gaps of 0), lags are taken
    inside (customer, ``bucket``) partitions, and the first instant of each
    bucket is joined to the last of the previous bucket with a window over
    the *buckets* of a customer. Window partitions are therefore bounded by
    the distinct instants in one bucket and by the number of buckets in the
    calendar, never by a customer's order count. Gap count, sum and sum of
    squares are integers, so the variance ``(n*S2 - S1^2) / n^2`` is exact
    up to the final division and square root.
    """
    per_bucket = _gaps_in_buckets(orders, bucket).groupBy("CustomerID", "Bucket").agg(
        F.min("OrderDate").alias("FirstAt"),
        F.max("OrderDate").alias("LastAt"),
        (F.sum("k") - F.count(F.lit(1)) + F.count("gap")).alias("n"),
        F.coalesce(F.sum("gap"), F.lit(0)).alias("s1"),
        F.coalesce(F.sum(F.col("gap") * F.col("gap")), F.lit(0)).alias("s2"),
    )
    edged = per_bucket.withColumn("edge", _edge())
    moments = edged.groupBy("CustomerID").agg(
        (F.sum("n") + F.count("edge")).cast("decimal(38,0)").alias("n"),
        (F.sum("s1") + F.coalesce(F.sum("edge"), F.lit(0))).cast("decimal(38,0)").alias("s1"),
        (F.sum("s2") + F.coalesce(F.sum(F.col("edge") * F.col("edge")), F.lit(0)))
        .cast("decimal(38,0)")
        .alias("s2"),
    )
    variance = (F.col("n") * F.col("s2") - F.col("s1") * F.col("s1")).cast("double") / (
        F.col("n") * F.col("n")
    ).cast("double")
    return moments.select(
        "CustomerID",
        F.when(F.col("n") > 0, F.sqrt(variance)).otherwise(F.lit(0.0)).alias("PurchaseRegularity"),
    )


BEHAVIOUR_COLUMNS = ["CustomerID", "Recency", "Frequency", "Monetary", "AvgOrderValue",
                     "ProductDiversity", "AvgItemsPerOrder", "PurchaseRegularity"]


def customer_features(src: DataFrame | CustomerBase) -> DataFrame:
    """:func:`behaviour_metrics`, with the FirstPurchase and DaysSinceFirst that U11 needs.

    One aggregate over the written orders gives RFM, the order means and the
    first and last purchase; diversity and regularity are aggregates of their
    own. All three come out hash partitioned on CustomerID, so the joins need no
    further shuffle. The per-customer aggregate is written, as the latest invoice is read from it too.
    """
    base = _base(src)
    known = F.col("InvoiceNo").isNotNull()
    n_known = F.count("InvoiceNo").cast("double")
    per_customer = _materialize(base.orders.groupBy("CustomerID").agg(
        F.min("OrderDate").alias("FirstPurchase"),
        F.max("LastDate").alias("LastPurchase"),
        F.count(F.lit(1)).alias("Frequency"),
        F.sum("OrderTotal").alias("Monetary"),
        (F.sum(F.when(known, F.col("OrderTotal"))).cast("double") / n_known).alias("AvgOrderValue"),
        (F.sum(F.when(known, F.col("OrderUnits"))).cast("double") / n_known).alias("AvgItemsPerOrder"),
    ), "customers")
    diversity = base.products.groupBy("CustomerID").agg(F.count(F.lit(1)).alias("ProductDiversity"))
    return (
        per_customer.filter(F.col("Monetary") > 0)
        .crossJoin(F.broadcast(latest_invoice(per_customer)))
        .join(diversity, "CustomerID", "left")
        .join(purchase_regularity(base.orders), "CustomerID", "left")
        .select(
            "CustomerID", _recency().alias("Recency"), "Frequency", "Monetary", "AvgOrderValue",
            "ProductDiversity", "AvgItemsPerOrder",
            F.coalesce(F.col("PurchaseRegularity"), F.lit(0.0)).alias("PurchaseRegularity"),
            "FirstPurchase", whole_days(F.col("FirstPurchase"), F.col("MaxDate")).alias("DaysSinceFirst"),
        )
    )


def behaviour_metrics(src: DataFrame | CustomerBase) -> DataFrame:
    """U8: RFM plus AvgOrderValue (mean order total), ProductDiversity
    (distinct StockCode, NULL counted), AvgItemsPerOrder (mean order units)
    and PurchaseRegularity. Order means skip a NULL InvoiceNo, as a pandas
    group-by does."""
    return customer_features(src).select(*BEHAVIOUR_COLUMNS)


def value_projection(customers: DataFrame, src: DataFrame | CustomerBase | None = None) -> DataFrame:
    """Next-quarter value and a 0-100 growth score per customer.

    DaysSinceFirst counts whole days from the first purchase to the latest
    invoice (no extra day, unlike Recency). ``customers`` has it already if it
    comes from :func:`customer_features`; otherwise it is joined from ``src``.
    The projection is written, then the score min-max normalises
    GrowthPotential = log1p(F) * log1p(M) / log1p(R) over all customers via
    a broadcast 1-row min/max; it is NULL when all potentials are equal.
    """
    own = ["FirstPurchase", "DaysSinceFirst"]
    if not set(own) <= set(customers.columns):
        if src is None:
            raise ValueError("value_projection needs FirstPurchase and DaysSinceFirst, or the lines")
        first = customer_features(src).select("CustomerID", *own)
        customers = customers.drop(*own).join(first, "CustomerID", "left")
    monetary = F.col("Monetary").cast("double")
    months_active = F.col("DaysSinceFirst") / F.lit(DAYS_PER_MONTH)
    purchase_rate = F.col("Frequency") / F.greatest(F.col("MonthsActive"), F.lit(1.0))
    projected = (
        customers.select(*[c for c in customers.columns if c not in own], *own)
        .withColumn("MonthsActive", months_active)
        .withColumn("PurchaseRate", purchase_rate)
        .withColumn("QuarterlyRate", F.col("PurchaseRate") * QUARTER_MONTHS)
        .withColumn("AvgTransactionValue", monetary / F.col("Frequency"))
        .withColumn("PredictedQuarterlyValue", F.col("QuarterlyRate") * F.col("AvgTransactionValue"))
        .withColumn(
            "GrowthPotential",
            (F.lit(1.0) / F.log1p(F.col("Recency"))) * F.log1p(F.col("Frequency")) * F.log1p(monetary),
        )
    )
    projected = _materialize(projected, "projection")
    bounds = projected.agg(
        F.min("GrowthPotential").alias("gmin"), F.max("GrowthPotential").alias("gmax")
    )
    return (
        projected.crossJoin(F.broadcast(bounds))
        .withColumn(
            "GrowthPotentialScore",
            F.try_divide(F.col("GrowthPotential") - F.col("gmin"), F.col("gmax") - F.col("gmin")) * 100,
        )
        .drop("gmin", "gmax")
    )
