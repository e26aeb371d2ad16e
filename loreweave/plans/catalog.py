"""The registry of named queries and of their SQL twins."""

from __future__ import annotations

from loreweave.plans import knowledge_queries, projection_queries, published_queries, search_queries, serving_queries


def queries() -> dict:
    return {**search_queries.QUERIES, **knowledge_queries.QUERIES, **serving_queries.QUERIES, **projection_queries.QUERIES, **published_queries.QUERIES}


def oracle_sql() -> dict:
    return {**search_queries.ORACLE, **knowledge_queries.ORACLE, **serving_queries.ORACLE, **projection_queries.ORACLE, **published_queries.ORACLE}
