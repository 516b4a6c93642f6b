"""The registered queries and their SQL, by name."""

from __future__ import annotations

from terraframe.plans import file_queries

# both modules register with the same decorator
QUERIES = dict(file_queries.QUERIES)
ORACLE = dict(file_queries.ORACLE)
