"""op12: two public tokenizers aligned over all documents."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from packlens.llm.align import document_scores, linked, pair_scores
from packlens.sources.tables import spread, table

BYTE_LEVEL, PIECES = "byte_bpe_50k.json", "piece_bpe_32k.model"


def op12_tokenizer_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of every document."""
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    parts = linked(docs, public_tokenizers.path(BYTE_LEVEL), public_tokenizers.path(PIECES))
    return document_scores(parts, pair_scores(parts))


QUERIES = {"op12_tokenizer_links": op12_tokenizer_links}
SQL: dict[str, str] = {}
