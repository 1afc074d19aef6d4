"""op9: language of every document."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from packlens.llm.common import fold
from packlens.llm.langid import identify, train
from packlens.sources.tables import table


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    net = train(docs.filter(fold(F.col("doc_id")) != 0))
    return docs.select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), identify(spark, net, F.col("text")).alias("x")).select(
        "doc_id", "held_out", F.col("x.lang").alias("lang_pred"), F.col("x.score").alias("score")
    )


QUERIES = {"op9_language_id": op9_language_id}
SQL: dict[str, str] = {}
