"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from packlens.session import staging_path

#: The characters between words: space and the ASCII controls 9 to 13. Fixed value.
WORD = "[^\\x20\\x09-\\x0D]+"
_SPACES = "\t\n\x0b\x0c\r "


def words_of(text: str) -> list[str]:
    """The words of a text: ASCII white space separates, nothing else does."""
    if text.isascii() and not any(c in text for c in "\x1c\x1d\x1e\x1f"):
        return text.split()
    for c in _SPACES[:-1]:
        text = text.replace(c, " ")
    return [w for w in text.split(" ") if w]


def lower_ascii(text: str) -> str:
    """``text`` with A-Z in lower case and every other character as it is."""
    return text.lower() if text.isascii() else text.translate(_LOWER)


_LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}


def fold(key: Column) -> Column:
    """The remainder of crc32 of a key as text by five; 0 marks the held-out rows. Null keys are held out."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 5, F.lit(0))


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` written below the shared folder and read back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = staging_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
