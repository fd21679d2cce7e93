"""All queries of this folder."""

from . import queries  # noqa: F401 - registers the queries
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
