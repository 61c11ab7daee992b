"""All queries of the library."""

from . import check_queries, function_queries, generate_queries, graph_queries, profile_queries, relation_queries, scale_queries  # noqa: F401  (they register their queries)
from .registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
