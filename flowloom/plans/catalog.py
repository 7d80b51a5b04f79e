"""All core queries."""

from __future__ import annotations

from flowloom.plans import audit, graph, models, results, skew, splitting, storage, validation

FLAGSHIP = "g4_layer1_agg"
MODULES = (skew, validation, splitting, audit, graph, results, models, storage)
QUERIES = {k: f for m in MODULES for k, f in m.QUERIES.items()}
SQL = {k: s for m in MODULES for k, s in m.SQL.items()}
