"""op5: quality of every document."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from packlens.llm.common import fold
from packlens.llm.quality import score, train
from packlens.sources.tables import table

THRESHOLD = 0.3


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels")
    machine = train(docs, labels.filter(fold(F.col("doc_id")) != 0))
    scored = docs.select(
        "doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), score(spark, machine, F.col("text"), [F.col("n_chars")]).alias("score")
    )
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


QUERIES = {"op5_quality": op5_quality}
SQL: dict[str, str] = {}
