"""Registered queries and their SQL."""

from . import queries_events, queries_issues, queries_lexicon, queries_streams, queries_text  # noqa: F401
from .registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
