"""op13: every document encoded by a public vocabulary and decoded again."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from packlens.llm.bpe import digests
from packlens.sources.tables import spread, table

VOCABULARY = "word_bpe_49k.json"


def op13_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every document; null and empty texts have no tokens."""
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    done = digests(F.col("text"), public_tokenizers.path(VOCABULARY))
    return docs.select("doc_id", done.alias("x")).select("doc_id", "x.n_tokens", "x.ids_sha256", "x.decoded_sha256")


QUERIES = {"op13_bpe": op13_bpe}
SQL: dict[str, str] = {}
