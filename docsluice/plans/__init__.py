"""Registered queries: each pairs a Spark job over the given tables with the SQL that checks it."""

from docsluice.plans import assembly_queries, card_queries, corpus_queries, file_queries, message_queries, policy_queries, prompt_queries, requirement_queries, search_queries, source_queries
from docsluice.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
