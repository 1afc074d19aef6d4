"""op6: all documents mixed to the targets of their sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from packlens.llm.common import staged
from packlens.llm.mixing import mix, water_targets, word_count
from packlens.sources.tables import table


def op6_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = staged(table(spark, sf_dir, "documents").select("doc_id", "source", word_count(F.col("text")).alias("size")), "counted")
    targets = staged(water_targets(docs.groupBy("source").agg(F.sum("size").alias("source_size"))), "targets")
    mixed = mix(docs.withColumn("sources", F.array("source")), targets.select("source", "target"))
    named = targets.select(F.col("source").alias("name"), "source_size", "target")
    return mixed.join(named, F.col("source").eqNullSafe(F.col("name"))).select(
        "doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken")
    )


QUERIES = {"op6_source_mix": op6_source_mix}
SQL: dict[str, str] = {}
