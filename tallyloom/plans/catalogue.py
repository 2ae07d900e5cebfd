"""All registered queries of the reconciliation library and their SQL."""

from __future__ import annotations

from . import aggregates, desk, joins, resolution, scoring, serving

FLAGSHIP = "a7_outcome_accounting"
QUERIES: dict = {}
ORACLES: dict[str, str] = {}
for theme in (joins, aggregates, resolution, serving, scoring, desk):
    QUERIES |= theme.QUERIES
    ORACLES |= theme.ORACLES
