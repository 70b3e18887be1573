"""Incremental ingest and stateful conversation memory."""
