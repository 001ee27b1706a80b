"""The queries of the retrieval operators and their SQL."""

from __future__ import annotations

from granary.plans import answer_queries, evidence_queries, graph_queries, match_queries, retrieval_queries, source_queries, text_queries
from granary.plans.base import Entry, Query

FLAGSHIP = "bm25_topk"
PARTS = (text_queries, match_queries, retrieval_queries, graph_queries, evidence_queries, answer_queries, source_queries)


def entries() -> dict[str, Entry]:
    out: dict[str, Entry] = {}
    for part in PARTS:
        if both := out.keys() & part.R.entries.keys():
            raise ValueError(f"registered twice: {sorted(both)}")
        out |= part.R.entries
    return out


def queries() -> dict[str, Query]:
    return {k: e.run for k, e in entries().items()}


def oracle_sql() -> dict[str, str]:
    return {k: e.sql for k, e in entries().items() if e.sql is not None}
