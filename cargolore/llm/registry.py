"""The corpus queries and the SQL they are compared with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from cargolore.llm import (
    centroid_clustering,
    conversation_repair,
    decontaminate,
    embedding_dedup,
    exact_search,
    jaccard_join,
    language_id,
    line_dedup,
    mixing,
    pii,
    substring_dedup,
    token_counts,
    toxicity,
)

_QUERIES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {
    "op1_pii": (pii.query, None),
    "op2_substring_dedup": (substring_dedup.query, substring_dedup.SQL),
    "op3_line_dedup": (line_dedup.query, line_dedup.SQL),
    "op4_decontaminate": (decontaminate.query, decontaminate.SQL),
    "op5_token_counts": (token_counts.query, None),
    "op6_embedding_dedup": (embedding_dedup.query, embedding_dedup.SQL),
    "op7_toxicity": (toxicity.query, None),
    "op8_jaccard_join": (jaccard_join.query, jaccard_join.SQL),
    "op9_language_id": (language_id.query, None),
    "op10_mixing": (mixing.query, mixing.SQL),
    "op11_conversation_repair": (conversation_repair.query, conversation_repair.SQL),
    "op12_centroid_clustering": (centroid_clustering.query, centroid_clustering.SQL),
    "op13_exact_search": (exact_search.query, exact_search.SQL),
    "llm_word_totals": (token_counts.words_query, token_counts.WORDS_SQL),
    "llm_overlap_mixing": (mixing.overlap_query, None),
    "llm_page_language": (language_id.pages_query, None),
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: run for name, (run, _) in _QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _QUERIES.items() if sql}
