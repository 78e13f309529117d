"""Invoice-line transactions: schema, readers and the cleaning step.

The one input of every operator is a flat table of invoice lines with the
columns of :data:`TRANSACTION_SCHEMA`. It can come from

* a CSV export (:func:`read_transactions_csv`, Latin-1, columns by header
  name, no inference pass over the data),
* Parquet (:func:`read_transactions_parquet`),
* the TPC-H-like star schema used in tests and benchmarks
  (:func:`transactions_from_star`), a declarative join that Catalyst prunes
  and AQE re-plans.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillroll.functions.columns import MONEY, MONEY_SCALE, nan_to_null

TRANSACTION_SCHEMA = T.StructType([
    T.StructField("InvoiceNo", T.StringType(), False),
    T.StructField("StockCode", T.StringType(), False),
    T.StructField("Description", T.StringType(), True),
    T.StructField("Quantity", T.IntegerType(), False),
    T.StructField("InvoiceDate", T.TimestampNTZType(), False),
    T.StructField("UnitPrice", T.DecimalType(12, MONEY_SCALE), False),
    T.StructField("CustomerID", T.LongType(), True),
    T.StructField("Country", T.StringType(), False),
])

TRANSACTION_COLUMNS = [f.name for f in TRANSACTION_SCHEMA.fields]

# Text layouts of dates in CSV exports, tried in this order.
CSV_TIMESTAMP_FORMATS = (
    "M/d/yyyy H:mm", "M/d/yyyy H:mm:ss", "yyyy-MM-dd H:mm:ss", "yyyy-MM-dd H:mm", "yyyy-MM-dd'T'H:mm:ss[.SSS]", "yyyy-MM-dd",
)
#: Every column as text, for readers that need the columns before they see a file.
CSV_TEXT_SCHEMA = T.StructType([T.StructField(c, T.StringType()) for c in TRANSACTION_COLUMNS])


def _no_nan(df: DataFrame, name: str):
    """A floating column with NaN as NULL (T5); other columns as they are."""
    floating = isinstance(df.schema[name].dataType, (T.DoubleType, T.FloatType))
    return nan_to_null(F.col(name)) if floating else F.col(name)


def _price(raw):
    """The price as DECIMAL; a price with more decimal places than it holds stops the job rather than lose them."""
    price = raw.cast(MONEY)
    lost = raw.cast("decimal(38,18)") != price
    message = F.concat(F.lit(f"UnitPrice has more than {MONEY_SCALE} decimal places: "), raw.cast("string"))
    return F.when(lost, F.raise_error(message).cast(MONEY)).otherwise(price)


def conform(df: DataFrame) -> DataFrame:
    """Cast a frame with the transaction columns to the canonical types. NaN
    in a floating column is missing; digits of a price are never cut."""
    return df.select(
        F.col("InvoiceNo").cast("string").alias("InvoiceNo"),
        F.col("StockCode").cast("string").alias("StockCode"),
        F.col("Description").cast("string").alias("Description"),
        _no_nan(df, "Quantity").cast("int").alias("Quantity"),
        F.col("InvoiceDate").cast("timestamp_ntz").alias("InvoiceDate"),
        _price(_no_nan(df, "UnitPrice")).alias("UnitPrice"),
        _no_nan(df, "CustomerID").cast("long").alias("CustomerID"),
        F.col("Country").cast("string").alias("Country"),
    )


def csv_options(reader, encoding: str = "ISO-8859-1", multi_line: bool = False):
    """Options of a CSV reader: quotes are doubled inside quotes, a malformed line stops the job."""
    return (reader.option("header", True).option("encoding", encoding).option("mode", "FAILFAST")
            .option("quote", '"').option("escape", '"').option("multiLine", multi_line))


def read_transactions_csv(
    spark: SparkSession,
    path: str,
    timestamp_formats: tuple[str, ...] = CSV_TIMESTAMP_FORMATS,
    encoding: str = "ISO-8859-1",
    multi_line: bool = False,
) -> DataFrame:
    """Read a CSV export (header row, Latin-1).

    Columns are found by their header name, in any order, beside others. A
    quoted field may hold commas and doubled quotes. Line breaks inside quotes need
    ``multi_line=True``; such a file is read by one task (it cannot be
    split), so it is off by default. Dates may come in any of
    ``timestamp_formats``; text that fits none stops the job, as
    ``pandas.to_datetime`` does. A number that is NaN or blank becomes NULL.
    """
    raw = csv_options(spark.read, encoding, multi_line).csv(path)
    missing = [c for c in TRANSACTION_COLUMNS if c not in raw.columns]
    if missing:
        raise ValueError(f"the CSV header has no column {missing}")
    return parse_csv_columns(raw, timestamp_formats)


def parse_csv_columns(raw: DataFrame, timestamp_formats: tuple[str, ...] = CSV_TIMESTAMP_FORMATS) -> DataFrame:
    """Typed transaction columns from text columns (batch or stream)."""
    text = F.col("InvoiceDate")
    parsed = F.coalesce(*[F.try_to_timestamp(text, F.lit(f)).cast("timestamp_ntz") for f in timestamp_formats])
    wrong = F.raise_error(F.concat(F.lit("InvoiceDate is in none of the known layouts: "), text)).cast("timestamp_ntz")
    number = lambda c: nan_to_null(F.col(c).cast("double"))
    price = F.when(F.lower("UnitPrice") != "nan", F.col("UnitPrice"))
    return conform(raw.withColumns({
        "InvoiceDate": F.when(text.isNotNull(), F.coalesce(parsed, wrong)),
        "Quantity": number("Quantity"), "CustomerID": number("CustomerID"), "UnitPrice": price,
    }))


def read_transactions_parquet(spark: SparkSession, path: str) -> DataFrame:
    return conform(spark.read.parquet(path))


def register(df: DataFrame, name: str = "online_retail") -> DataFrame:
    """Expose the frame as the temp view the SQL reports query."""
    df.createOrReplaceTempView(name)
    return df


def transactions_from_star(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Invoice lines derived from the star schema (lineitem, orders, ...).

    Returns are the lines with ``l_returnflag = 'R'`` (negative Quantity),
    guest orders are ``o_orderpriority = '4-NOT SPECIFIED'`` (NULL
    CustomerID), and the order key spreads orders over the minutes of the
    day so whole-day arithmetic is exercised.

    Join order: orders are enriched with customer and nation first (an
    order-sized join), then joined to the line items, then to part. Only
    the columns a query needs survive pruning; AQE picks broadcast for any
    side whose measured size is under the threshold and splits skewed
    partitions (a hot customer or part) otherwise.
    """
    def t(name: str) -> DataFrame:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")

    li = t("lineitem").select("l_orderkey", "l_partkey", "l_quantity", "l_returnflag")
    orders = t("orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority")
    cust = t("customer").select("c_custkey", "c_nationkey")
    nation = t("nation").select("n_nationkey", "n_name")
    part = t("part").select("p_partkey", "p_name", "p_retailprice")

    order_dim = (
        orders.join(cust, orders.o_custkey == cust.c_custkey)
        .join(nation, cust.c_nationkey == nation.n_nationkey)
        .select("o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority", "n_name")
    )
    lines = li.join(order_dim, li.l_orderkey == order_dim.o_orderkey).join(
        part, li.l_partkey == part.p_partkey
    )
    minute_of_day = (F.col("o_orderkey") * 37 % 1440).cast("int")
    return lines.select(
        F.col("o_orderkey").cast("string").alias("InvoiceNo"),
        F.col("l_partkey").cast("string").alias("StockCode"),
        F.col("p_name").alias("Description"),
        F.when(F.col("l_returnflag") == "R", -F.col("l_quantity"))
        .otherwise(F.col("l_quantity"))
        .cast("int")
        .alias("Quantity"),
        (F.col("o_orderdate").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(0), minute_of_day))
        .alias("InvoiceDate"),
        F.col("p_retailprice").cast(MONEY).alias("UnitPrice"),
        F.when(F.col("o_orderpriority") == "4-NOT SPECIFIED", F.lit(None).cast("long"))
        .otherwise(F.col("o_custkey"))
        .alias("CustomerID"),
        F.col("n_name").alias("Country"),
    )


def clean_transactions(tx: DataFrame) -> DataFrame:
    """Cleaning step of the customer pipeline.

    Adds ``TotalAmount = Quantity * UnitPrice`` (exact DECIMAL), keeps lines
    with ``Quantity > 0`` (returns and cancellations go; NULL quantity too)
    and a known customer. Both predicates reach the scan / join inputs via
    Catalyst's filter pushdown.
    """
    return (
        tx.filter((F.col("Quantity") > 0) & F.col("CustomerID").isNotNull())
        .withColumn("TotalAmount", F.col("Quantity") * F.col("UnitPrice"))
    )
