"""Registry of the queries over the driver tables, each with its SQL where SQL can express it."""

from __future__ import annotations

from velora.plans import clip_queries, corpus_queries, evaluation_queries, pose_queries, sequence_queries, vector_queries

FLAGSHIP = "clean_dedup_split"
_PARTS = (corpus_queries, vector_queries, sequence_queries, clip_queries, evaluation_queries, pose_queries)
QUERIES = {name: query for part in _PARTS for name, query in part.QUERIES.items()}
ORACLES = {name: sql for part in _PARTS for name, sql in part.ORACLES.items()}
