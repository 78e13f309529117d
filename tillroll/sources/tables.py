"""Invoice lines as a named catalog table, bucketed by customer.

Joins and aggregates on CustomerID read such a table without a shuffle.
Guests (no CustomerID) would all fall into one bucket; they are written by
tasks of their own, as several files of it, and reports on customers skip
them by the files' statistics. A known customer is in one bucket whatever its size: where
one customer holds a large part of all lines, the plain Parquet layout (and the
library's hash on all keys) is the better one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillroll.session import tune


def save_bucketed(tx: DataFrame, name: str = "online_retail", buckets: int = 64, path: str | None = None) -> str:
    """Write the lines as the table ``name`` (at ``path``, or where the catalog puts it), a file per bucket, and several for guests."""
    known = tx.where("CustomerID IS NOT NULL").repartition(buckets, "CustomerID")
    guests = tx.where("CustomerID IS NULL").repartition(buckets, "InvoiceNo")
    writer = known.unionByName(guests).write.mode("overwrite").format("parquet").bucketBy(buckets, "CustomerID").sortBy("CustomerID")
    (writer.option("path", path) if path else writer).saveAsTable(name)
    return name


def bucketed_table(spark: SparkSession, name: str = "online_retail") -> DataFrame:
    """The table, in a session that accepts the buckets as the partitioning of any keys that include CustomerID.

    The library's own sessions hash on all keys of an aggregate, so that a hot customer spreads; that would shuffle the table again.
    """
    session = spark.newSession()
    for key, value in spark.conf.getAll.items():
        if session.conf.isModifiable(key):
            session.conf.set(key, value)
    tune(session)
    session.conf.set("spark.sql.requireAllClusterKeysForDistribution", "false")
    return session.table(name)
