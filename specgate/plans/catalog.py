"""All registered queries and their DuckDB answers."""

from __future__ import annotations

import importlib

FAMILIES = ["judging", "reporting", "guarding", "recovering", "layouting", "gridding", "ingesting", "certify"]

QUERIES: dict = {}
ORACLES: dict = {}
for _family in FAMILIES:
    QUERIES.update(importlib.import_module(f"specgate.plans.{_family}").QUERIES)
    ORACLES.update(importlib.import_module(f"specgate.oracle.{_family}").SQL)
