"""All queries of the engine by name, with the DuckDB SQL that gives the same rows."""

from __future__ import annotations

from siltstone import queries_scan, queries_structure

QUERIES: dict = queries_scan.QUERIES | queries_structure.QUERIES
ORACLES: dict[str, str] = queries_scan.ORACLES | queries_structure.ORACLES
