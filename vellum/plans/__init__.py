"""Registered queries by area."""

from __future__ import annotations

from . import corpus_queries, job_queries, model_queries, usage_queries
from .registry import ORACLES, QUERIES

__all__ = ["all_oracles", "all_queries", "corpus_queries", "job_queries", "model_queries", "usage_queries"]


def all_queries() -> dict:
    return dict(QUERIES)


def all_oracles() -> dict[str, str]:
    return dict(ORACLES)
