"""Named query plans."""

from docloom.plans import catalog_queries, change_queries, search_queries, stream_queries, text_queries  # noqa: F401
from docloom.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
