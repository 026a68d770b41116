"""All core queries with their oracle SQL."""

from __future__ import annotations

from quillstone.plans import code_queries, corpus_queries, description_queries, frame_queries, label_queries, relational_queries, skew_queries, store_queries, text_queries, trace_queries, vocabulary_queries

QUERIES: dict = {}
ORACLE: dict = {}
for _m in (relational_queries, frame_queries, label_queries, corpus_queries, description_queries, trace_queries, text_queries, skew_queries, vocabulary_queries, code_queries, store_queries):
    QUERIES.update(_m.QUERIES)
    ORACLE.update(_m.ORACLE)
