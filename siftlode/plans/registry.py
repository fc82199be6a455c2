"""Registered queries and their SQL over the driver's tables."""

from siftlode.plans import queries_catalog, queries_runs

_ALL = (queries_catalog, queries_runs)
QUERIES: dict = {k: v for m in _ALL for k, v in m.QUERIES.items()}
ORACLE_SQL: dict = {k: v for m in _ALL for k, v in m.ORACLE_SQL.items()}
