"""Structured Streaming forms of the ingestion path."""

from tablesync.streaming.ingest import compact_ingested, ingest_counts, ingest_stream, read_ingested, stream_dedupe

__all__ = ["compact_ingested", "ingest_counts", "ingest_stream", "read_ingested", "stream_dedupe"]
