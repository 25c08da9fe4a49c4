"""Importing this registers every query."""

from . import assembly_queries, more_queries, report_queries, risk_queries, scan_queries, text_queries  # noqa: F401
from .queries import QUERIES, SQL  # noqa: F401
