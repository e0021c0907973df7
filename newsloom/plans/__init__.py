"""Whole flows, and the registered queries with their SQL twins."""

from __future__ import annotations


def all_queries():
    """All registered queries and their SQL twins."""
    from newsloom.plans import (  # noqa: F401
        article_queries,
        corpus_queries,
        extract_queries,
        functions_queries,
        log_queries,
        scoring_queries,
        store_queries,
    )
    from newsloom.plans.registry import ORACLES, QUERIES

    return QUERIES, ORACLES
