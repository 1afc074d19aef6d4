"""Text corpora: files below a folder, or rows that carry a source name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from packlens.functions.text import is_blank

# What counts as a text file.
TEXT_SUFFIXES = ("md", "markdown", "txt")


def has_text_suffix(source: Column) -> Column:
    return F.lower(F.regexp_extract(source, r"\.([^./]+)$", 1)).isin(*TEXT_SUFFIXES)


def usable(documents: DataFrame) -> DataFrame:
    """Documents of a text type that are not blank."""
    return documents.where(has_text_suffix(F.col("source")) & ~is_blank(F.col("text")))


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """(source, text) of the text files at ``path``, a file or a folder with subfolders.

    ``source`` is the path below the folder; of a single file it is the file's name.
    """
    files = (
        spark.read.format("text")
        .option("wholetext", "true")
        .option("recursiveFileLookup", "true")
        .load(path)
        .select(F.col("value").alias("text"), F.col("_metadata.file_path").alias("uri"))
    )
    # The path comes percent-encoded; a plus sign in it is literal.
    full = F.url_decode(F.replace("uri", F.lit("+"), F.lit("%2B")))
    root = path.rstrip("/") + "/"
    start = F.instr("full", root)
    below = F.when(start > 0, F.substring("full", start + len(root), F.length("full"))).otherwise(
        F.substring_index("full", "/", -1)
    )
    placed = files.withColumn("full", full)
    return usable(placed.select(below.alias("source"), "text"))
