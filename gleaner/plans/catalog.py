"""All registered queries."""

from . import cleaning_queries, corpus_queries, report_queries, search_queries, stream_queries  # noqa: F401 - registers the queries
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
