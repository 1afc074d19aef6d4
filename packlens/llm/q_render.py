"""op8: visible text of every page."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from packlens.llm.render import rendered
from packlens.sources.tables import table


def op8_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", rendered(F.col("html")).alias("text"))
    return pages.select("page_id", "text", F.length("text").cast("long").alias("n_chars"))


QUERIES = {"op8_html_text": op8_html_text}
SQL: dict[str, str] = {}
