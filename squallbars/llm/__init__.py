"""Operators of a training-data pipeline, and their queries."""

from squallbars.llm import conversation_queries, fingerprint_queries, language_queries, mixing_queries, private_queries, repeat_queries, search_queries, similar_queries, token_queries, vector_queries  # noqa: F401
from squallbars.llm.registry import CHECKS, QUERIES  # noqa: F401
