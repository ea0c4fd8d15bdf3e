"""The queries of the library by name, and the SQL each is held against."""

from __future__ import annotations

from . import oracle, queries

QUERIES = queries.QUERIES
ORACLE_SQL = {name: sql for name, sql in oracle.SQL.items() if name in QUERIES}
flagship = queries.flagship
