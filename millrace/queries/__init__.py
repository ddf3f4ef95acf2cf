"""Registered queries, by section of the operator inventory."""

from __future__ import annotations

from . import aggregation, expressions, functions, joining, scans, sorting, statements, streams, tables, windowing  # noqa: F401
from .registry import ORACLES, QUERIES

ENTRY = "flagship"
__all__ = ["ENTRY", "ORACLES", "QUERIES"]
