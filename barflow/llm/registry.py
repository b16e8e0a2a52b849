"""The queries of this subpackage and their oracle SQL."""

from __future__ import annotations

import corpus_pipeline
from barflow.llm import row_queries, text_queries, vector_queries

MODULES = [text_queries, row_queries, vector_queries]


def all_queries():
    queries, oracles = {}, {}
    for module in MODULES:
        queries |= module.QUERIES
        oracles |= module.ORACLES
    queries["pipeline"] = corpus_pipeline.run
    if corpus_pipeline.ORACLE_SQL:
        oracles["pipeline"] = corpus_pipeline.ORACLE_SQL
    return queries, oracles
