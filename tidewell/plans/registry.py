"""All registered queries and their SQL twins."""

from __future__ import annotations

from . import calibration, decisions, evolution, extraction, forms, history, library, lineage, prefetch, retrieval, sessions, traces, usage

_PLANS = (retrieval, usage, sessions, extraction, decisions, library, prefetch, lineage, history, evolution, traces, calibration, forms)
QUERIES = {name: f for plan in _PLANS for name, f in plan.QUERIES.items()}
SQL = {name: sql for plan in _PLANS for name, sql in plan.SQL.items()}
