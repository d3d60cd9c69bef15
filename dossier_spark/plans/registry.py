"""All registered queries of the library proper."""

from __future__ import annotations

from .base import ORACLES, QUERIES
from . import file_queries, job_queries, retrieval_queries, scan_queries, section_queries  # noqa: F401


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
