"""All registered queries of the core and the SQL each is checked against."""

from __future__ import annotations

import importlib

MODULES = ("events", "scalars", "resolution", "fusion", "evaluation", "extraction", "profiles")

QUERIES: dict = {}
SQL: dict[str, str] = {}
for _name in MODULES:
    _module = importlib.import_module(f"amalgam.plans.{_name}")
    QUERIES |= _module.QUERIES
    SQL |= _module.SQL
