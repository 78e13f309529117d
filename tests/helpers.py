"""Literal invoice-line frames for unit tests."""

from __future__ import annotations

from datetime import datetime
from decimal import Decimal

from pyspark.sql import types as T

from tillroll.sources.transactions import TRANSACTION_SCHEMA

# Unit tests also feed NULL keys (bad real-world rows), so every field is nullable here.
NULLABLE_SCHEMA = T.StructType([T.StructField(f.name, f.dataType, True) for f in TRANSACTION_SCHEMA.fields])


def ts(s: str) -> datetime:
    return datetime.fromisoformat(s)


def lines(spark, rows):
    """rows: (InvoiceNo, StockCode, Description, Quantity, 'iso date',
    price, CustomerID, Country)."""
    data = [
        (inv, sc, desc, q, ts(d), None if p is None else Decimal(str(p)), cid, country)
        for inv, sc, desc, q, d, p, cid, country in rows
    ]
    return spark.createDataFrame(data, NULLABLE_SCHEMA)
