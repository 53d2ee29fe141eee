"""All registered queries in one place."""

from __future__ import annotations

from dyadflow.plans import evidence, ingestion, landing, prediction, records

_PLANS = (prediction, evidence, ingestion, landing, records)

QUERIES = {name: fn for plan in _PLANS for name, fn in plan.QUERIES.items()}
ORACLE = {name: sql for plan in _PLANS for name, sql in plan.ORACLE.items()}
