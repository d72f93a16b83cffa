"""Registered queries of the engine's own operators over the fixed tables, and the same in SQL."""

from __future__ import annotations

from . import catalogue, curves, frames, more, numeric, requests, scans, session, text

MODULES = (numeric, curves, frames, catalogue, text, scans, more, session, requests)
QUERIES = {name: query for module in MODULES for name, query in module.QUERIES.items()}
ORACLES = {name: sql for module in MODULES for name, sql in module.ORACLES.items()}
