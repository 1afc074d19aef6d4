"""Logged model replies, built from the assistant rows that follow each question."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from packlens.sources.passages import questions
from packlens.sources.tables import spread, table

# Expressions that Spark SQL and DuckDB read alike.
VEC_ID = "conv_id+3*turn"
VARIANT = "(conv_id*7+turn*3)%10"
CONFIDENCE = "((conv_id*31+turn*17)%13)/1e1"
ANSWER = (
    "CASE WHEN (conv_id+turn)%2=0 OR passage IS NULL THEN reply"
    " WHEN (conv_id+turn)%4=1 THEN concat(passage, ' ', reply) ELSE passage END"
)


def question_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Questions with the id of the vector that stands for their embedding."""
    return questions(spark, folder).withColumn("vec_id", F.expr(VEC_ID))


def replies(spark: SparkSession, folder: str) -> DataFrame:
    """(conv_id, turn) of the question, the assistant's reply to it, and a related passage."""
    rows = spread(table(spark, folder, "conversations"))
    reply = rows.where("role = 'assistant'").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("reply")
    )
    asked = rows.where("role = 'user'").select("conv_id", "turn").withColumn("vec_id", F.expr(VEC_ID))
    passage = table(spark, folder, "documents").select(F.col("doc_id").alias("vec_id"), F.col("text").alias("passage"))
    return asked.join(reply, ["conv_id", "turn"]).join(passage, "vec_id", "left")


def attempts(spark: SparkSession, folder: str) -> DataFrame:
    """One or two attempts per reply: good, unreadable, or stopped before a model was reached."""
    said = replies(spark, folder).withColumns({"v": F.expr(VARIANT), "answer": F.expr(ANSWER)})
    mix = (F.col("conv_id") + F.col("turn")) % 4
    sources = (
        F.when(mix == 0, F.array(F.lit(1), F.lit(99), F.lit(0)))
        .when(mix == 1, F.array(F.lit(1), F.lit(1)))
        .when(mix == 2, F.array().cast("array<int>"))
        .otherwise(F.array(F.lit(2), F.lit(1)))
    )
    good = F.to_json(F.struct("answer", F.expr(CONFIDENCE).alias("confidence"), sources.alias("sources")))
    bad_first = F.col("v").isin(6, 7, 9)
    first = F.struct(
        F.lit(1).cast("bigint").alias("attempt"),
        F.when(bad_first, F.col("reply")).otherwise(good).alias("raw"),
        F.when(F.col("v") == 8, F.lit(503)).alias("status_code"),
        F.lit(None).cast("string").alias("error_module"),
    )
    second = F.struct(
        F.lit(2).cast("bigint").alias("attempt"),
        F.when(F.col("v") == 6, good).otherwise(F.col("reply")).alias("raw"),
        F.lit(None).cast("int").alias("status_code"),
        F.when(F.col("v") == 9, F.lit("httpx._exceptions")).alias("error_module"),
    )
    tried = F.when(bad_first, F.array(first, second)).otherwise(F.array(first))
    return said.select("conv_id", "turn", F.explode(tried).alias("a")).select("conv_id", "turn", "a.*")
