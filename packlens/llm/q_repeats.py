"""op7: documents without repeated passages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from packlens.llm.repeats import without_repeats
from packlens.sources.tables import table


def op7_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_repeats(table(spark, sf_dir, "documents"))


QUERIES = {"op7_repeated_passages": op7_repeated_passages}
SQL: dict[str, str] = {}
