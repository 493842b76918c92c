"""Registered queries of the engine's own operators, each with its equivalent in DuckDB's SQL.

The tables at hand hold no statutes. Adapters present them as such, alike in both engines; the operators run over them whole.
"""

from __future__ import annotations

from lexmill.catalog import folds, relations, search, text
from lexmill.catalog.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES", "folds", "relations", "search", "text"]
