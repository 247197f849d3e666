"""All registered queries of the training-data operators."""

from __future__ import annotations

import importlib

MODULES = ("p01_pairs", "p02_matches", "p03_survivors", "p04_splits", "p05_overlaps", "p06_groups", "p07_addresses", "p08_containers", "p09_mix", "p10_spans")

QUERIES: dict = {}
SQL: dict[str, str] = {}
for _name in MODULES:
    _module = importlib.import_module(f"amalgam.llm.{_name}")
    QUERIES |= _module.QUERIES
    SQL |= _module.SQL
