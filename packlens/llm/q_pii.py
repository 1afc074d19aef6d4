"""op2: personal data in every document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from packlens.llm.pii import BASE, find, train
from packlens.sources.tables import table


def op2_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = docs.select("doc_id", find(spark, train(docs), F.col("text")).alias("x")).select("doc_id", F.col("x.spans").alias("all"))
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def count(kind: str) -> Column:
        return F.size(F.filter("all", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select(
        "doc_id",
        *(count(k) for k in BASE),
        F.sha2(joined(F.filter("all", lambda s: s["base"])), 256).alias("base_sha256"),
        joined(F.col("all")).alias("spans"),
    )


QUERIES = {"op2_personal_data": op2_personal_data}
SQL: dict[str, str] = {}
