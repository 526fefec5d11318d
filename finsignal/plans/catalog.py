"""Queries over the given tables and the DuckDB SQL each is held against."""

from __future__ import annotations

from . import landed, macro_queries, market, news, reports, streams

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
for _part in (news, market, macro_queries, reports, streams, landed):
    QUERIES.update(_part.QUERIES)
    ORACLE.update(_part.ORACLE)
