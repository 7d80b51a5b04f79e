"""Relational, graph and evaluation operators; each takes and returns DataFrames."""
