"""CSV loading that sets bad rows aside instead of stopping (the strict reader is ``read_transactions_csv``)."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillroll.functions.columns import MONEY, MONEY_SCALE
from tillroll.session import materialize
from tillroll.sources.transactions import CSV_TIMESTAMP_FORMATS, TRANSACTION_COLUMNS, csv_options, parse_csv_columns

#: Columns of the rejected rows beside the transaction columns (as text).
LINE, REASON = "Line", "Reason"


class Loaded(NamedTuple):
    """``good`` transactions, ``rejected`` rows (all columns as text, the raw Line if it was malformed, Reason) and the
    number of ``lines`` read."""

    good: DataFrame
    rejected: DataFrame
    lines: int


def _blank(c: str) -> Column:
    return F.col(c).isNull() | (F.trim(c) == "") | (F.lower(F.trim(c)) == "nan")


def reject_reason(timestamp_formats: tuple[str, ...] = CSV_TIMESTAMP_FORMATS) -> Column:
    """Why a row of text columns is no transaction (the first reason), or null. What the strict reader
    takes as missing (blank or NaN numbers, a blank date) is no reason."""
    dates = F.coalesce(*[F.try_to_timestamp("InvoiceDate", F.lit(f)) for f in timestamp_formats])

    def number(c: str) -> Column:
        return F.col(c).try_cast("double")

    def whole(c: str, limit: float) -> Column:
        return ~_blank(c) & ~F.coalesce((number(c) == F.floor(number(c))) & (F.abs(number(c)) < limit), F.lit(False))

    price = F.col("UnitPrice").try_cast("decimal(38,18)")
    return (
        F.when(F.col(LINE).isNotNull(), "malformed line")
        .when(F.col("InvoiceNo").isNull(), "InvoiceNo is missing")
        .when(F.col("StockCode").isNull(), "StockCode is missing")
        .when(F.col("InvoiceDate").isNotNull() & dates.isNull(), "InvoiceDate is in none of the known layouts")
        .when(whole("Quantity", 2.0 ** 31), "Quantity is no whole number")
        .when(~_blank("UnitPrice") & price.isNull(), "UnitPrice is no number")
        .when(~_blank("UnitPrice") & F.col("UnitPrice").try_cast(MONEY).isNull(), "UnitPrice is too large")
        .when(~_blank("UnitPrice") & (price != F.col("UnitPrice").try_cast(MONEY)), f"UnitPrice has more than {MONEY_SCALE} decimal places")
        .when(whole("CustomerID", 2.0 ** 53), "CustomerID is no whole number"))


def load_transactions_csv(spark: SparkSession, path: str, timestamp_formats: tuple[str, ...] = CSV_TIMESTAMP_FORMATS,
                          encoding: str = "ISO-8859-1", multi_line: bool = False) -> Loaded:
    """Read a CSV export once and split it: good rows and rejected ones with their reason.

    The files are parsed in one job that writes both parts side by side (a
    table partitioned by the outcome); an observation of that job counts the lines
    read, and the load fails if the two parts do not add up to them. Lines with too few or too many
    fields are kept whole in ``Line``.
    """
    header = csv_options(spark.read, encoding, multi_line).csv(path).columns
    missing = [c for c in TRANSACTION_COLUMNS if c not in header]
    if missing:
        raise ValueError(f"the CSV header has no column {missing}")
    schema = T.StructType([T.StructField(c, T.StringType()) for c in [*header, LINE]])
    raw = (csv_options(spark.read, encoding, multi_line).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", LINE)
           .schema(schema).csv(path))
    seen = Observation("lines")
    marked = raw.select(*TRANSACTION_COLUMNS, LINE).withColumn(REASON, reject_reason(timestamp_formats)).observe(
        seen, F.count(F.lit(1)).alias("lines"), F.count(REASON).alias("rejected"))
    both = materialize(marked.withColumn("Rejected", F.col(REASON).isNotNull()), "loaded", partition_by=["Rejected"])
    good, rejected = both.where("NOT Rejected"), both.where("Rejected").drop("Rejected")
    counted = {r.Rejected: r.n for r in both.groupBy("Rejected").agg(F.count(F.lit(1)).alias("n")).collect()}
    lines = seen.get["lines"] if seen.get else 0
    if counted.get(True, 0) != seen.get["rejected"] or sum(counted.values()) != lines:
        raise RuntimeError(f"{lines} lines were read, but {counted} written")
    return Loaded(parse_csv_columns(good.select(*TRANSACTION_COLUMNS), timestamp_formats), rejected, lines)
