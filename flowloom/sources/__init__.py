"""Readers and writers of flow tables, run tables and JSON documents."""
