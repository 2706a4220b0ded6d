"""All queries of the core, by name, and their SQL."""

from __future__ import annotations

from docketforge.plans import corpus, evaluation, exchange, grounding, quality

FLAGSHIP = "verify_failure_rates"
_MODULES = (grounding, corpus, evaluation, quality, exchange)
QUERIES: dict = {name: query for m in _MODULES for name, query in m.QUERIES.items()}
SQL: dict = {name: text for m in _MODULES for name, text in m.SQL.items()}
