"""Incremental ingest. The engine's queries are batch; this only keeps a store up to date."""
