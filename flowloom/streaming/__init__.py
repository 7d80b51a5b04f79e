"""Incremental ingest of arriving flow files."""
