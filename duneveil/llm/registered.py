"""QUERIES and ORACLE_SQL of this subpackage."""

from __future__ import annotations

from . import oracle, queries

QUERIES = {name: getattr(queries, name) for name in sorted(vars(queries)) if name.startswith("op") and name[2].isdigit()}
ORACLE_SQL = {name: sql for name, sql in oracle.SQL.items() if name in QUERIES}
