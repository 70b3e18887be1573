"""End-to-end plans: ingest, retrieval, and the query catalogue."""
