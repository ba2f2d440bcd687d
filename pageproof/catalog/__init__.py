"""Registered queries; importing the package fills the registry."""

from pageproof.catalog import check_queries, content_queries, history_queries, page_queries, sheet_queries, stream_queries  # noqa: F401
from pageproof.catalog.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
