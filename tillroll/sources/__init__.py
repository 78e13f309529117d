"""Readers and writers for invoice-line data and result tables."""

from tillroll.sources.quarantine import load_transactions_csv
from tillroll.sources.sinks import write_table, write_tables
from tillroll.sources.tables import bucketed_table, save_bucketed
from tillroll.sources.transactions import (
    TRANSACTION_COLUMNS,
    TRANSACTION_SCHEMA,
    clean_transactions,
    conform,
    read_transactions_csv,
    read_transactions_parquet,
    register,
    transactions_from_star,
)

__all__ = [
    "bucketed_table",
    "load_transactions_csv",
    "save_bucketed",
    "TRANSACTION_COLUMNS",
    "TRANSACTION_SCHEMA",
    "clean_transactions",
    "conform",
    "read_transactions_csv",
    "read_transactions_parquet",
    "register",
    "transactions_from_star",
    "write_table",
    "write_tables",
]
