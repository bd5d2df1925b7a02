"""All registered queries by name."""

from __future__ import annotations

from . import audience_queries, operations_queries, stored_queries, trading_queries
from .base import Query

QUERIES: dict[str, Query] = {**audience_queries.QUERIES, **trading_queries.QUERIES, **operations_queries.QUERIES,
                             **stored_queries.QUERIES}
