"""All queries of the library, gathered from their packs."""

from __future__ import annotations

from . import fact_queries, html_queries, phrase_queries, rank_queries, service_queries, source_queries, state_queries, text_queries, url_queries, value_queries
from .tables import Query

PACKS = [url_queries.PACK, html_queries.PACK, text_queries.PACK, rank_queries.PACK, fact_queries.PACK, state_queries.PACK, source_queries.PACK, phrase_queries.PACK, value_queries.PACK, service_queries.PACK]


def queries() -> dict[str, Query]:
    return {k: f for p in PACKS for k, f in p.queries.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for p in PACKS for k, s in p.sql.items()}
