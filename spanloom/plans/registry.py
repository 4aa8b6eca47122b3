"""All queries of the timeline engine and their SQL."""

from __future__ import annotations

from . import agreement_queries, parsing_queries, relational_queries, rule_queries, streaming_queries, timeline_queries

MODULES = (agreement_queries, parsing_queries, relational_queries, rule_queries, streaming_queries, timeline_queries)
QUERIES = {name: query for module in MODULES for name, query in module.QUERIES.items()}
ORACLE_SQL = {name: text for module in MODULES for name, text in module.SQL.items()}
ENTRY = "pairwise_agreement"
