"""Collects the queries and oracles of all plan modules."""

from __future__ import annotations

from palimpsest.plans import detection, evidence, governance, overlaps, payloads, streams, submissions

_MODULES = (detection, evidence, governance, overlaps, streams, payloads, submissions)
QUERIES: dict = {name: query for m in _MODULES for name, query in m.QUERIES.items()}
ORACLES: dict = {name: sql for m in _MODULES for name, sql in m.ORACLES.items()}
