"""Incremental ingestion of invoice-line files (Structured Streaming)."""

from tillroll.streaming.ingest import ingest, stream_transactions

__all__ = ["ingest", "stream_transactions"]
