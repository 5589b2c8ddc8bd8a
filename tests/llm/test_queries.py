"""The operators' registered queries: SQL where there is some, else shape and whole tables."""

import pytest

from impactlake.llm import queries

from ..oracle import SF, same

COLUMNS = {
    "op1_sentencepiece": ("documents", {"doc_id", "n_tokens", "round_trip"}),
    "op3_language_id": ("documents", {"doc_id", "held_out", "lang_pred", "score"}),
    "op4_quality_rules": ("documents", {"doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"}),
    "op5_source_mixing": ("documents", {"doc_id", "size", "source_size", "target", "taken"}),
    "op6_toxicity": ("documents", {"doc_id", "held_out", "score", "predicted"}),
}


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_its_sql(spark, name):
    same(spark, queries.QUERIES[name], queries.ORACLE_SQL[name])


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_query_returns_all_rows(spark, name):
    table, columns = COLUMNS[name]
    out = queries.QUERIES[name](spark, SF)
    assert columns <= set(out.columns)
    assert out.count() == spark.read.parquet(f"{SF}/{table}.parquet").count()
