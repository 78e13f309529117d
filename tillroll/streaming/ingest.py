"""Incremental ingestion of invoice-line files with Structured Streaming.

New CSV (or Parquet) files dropped into a folder are parsed with the
transaction schema and appended to a Parquet table partitioned by invoice
month. The file sink plus the query checkpoint give exactly-once appends:
a restarted or retried run never adds a file twice, and a lost executor
only re-runs its micro-batch. Reports and the customer pipeline then read
the table with :func:`tillroll.sources.read_transactions_parquet`; filters
on ``InvoiceMonth`` prune whole partitions.

Lines are stored as they arrive (returns and guest orders included): the
reports need them, and cleaning stays a read-time step.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tillroll.sources.transactions import (
    CSV_TEXT_SCHEMA,
    CSV_TIMESTAMP_FORMATS,
    TRANSACTION_SCHEMA,
    conform,
    csv_options,
    parse_csv_columns,
)

PARTITION_COLUMN = "InvoiceMonth"


def stream_transactions(
    spark: SparkSession,
    source_dir: str,
    fmt: str = "csv",
    max_files_per_trigger: int | None = None,
    timestamp_formats: tuple[str, ...] = CSV_TIMESTAMP_FORMATS,
    encoding: str = "ISO-8859-1",
) -> DataFrame:
    """A streaming DataFrame of typed invoice lines from files in ``source_dir``.

    CSV files must have the transaction columns in their order: a file with
    another header stops the query, as does a malformed line."""
    reader = spark.readStream
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    if fmt == "csv":
        raw = csv_options(reader, encoding).option("enforceSchema", False).schema(CSV_TEXT_SCHEMA).csv(source_dir)
        return parse_csv_columns(raw, timestamp_formats)
    return conform(reader.schema(TRANSACTION_SCHEMA).format(fmt).load(source_dir))


def ingest(
    spark: SparkSession,
    source_dir: str,
    table_dir: str,
    fmt: str = "csv",
    checkpoint_location: str | None = None,
    available_now: bool = True,
    processing_time: str | None = None,
) -> StreamingQuery:
    """Start the ingestion query; returns the running :class:`StreamingQuery`.

    ``available_now=True`` processes every file present and stops (a
    scheduled incremental load); otherwise the query keeps running with a
    ``processing_time`` trigger. The query's checkpoint, by which later runs
    and other sessions know the files that are in the table, belongs to the table: it
    lies beside it, in ``<table_dir>_checkpoint``, unless another place is given.
    """
    location = checkpoint_location or f"{table_dir.rstrip('/')}_checkpoint"
    lines = stream_transactions(spark, source_dir, fmt).withColumn(
        PARTITION_COLUMN, F.date_format("InvoiceDate", "yyyy-MM"))
    writer = (
        lines.writeStream.format("parquet")
        .option("checkpointLocation", location)
        .partitionBy(PARTITION_COLUMN)
        .outputMode("append")
    )
    if available_now:
        writer = writer.trigger(availableNow=True)
    elif processing_time:
        writer = writer.trigger(processingTime=processing_time)
    return writer.start(table_dir)
