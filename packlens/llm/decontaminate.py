"""Benchmark decontamination: short test items inside long documents, found by containment MinHash.

The Jaccard similarity of a short item and a long document is near zero even where the document
holds the whole item, so the min-hash values of the document say nothing. The containment form
takes min-hash values of the small side only and asks whether the large side holds those shingles;
the expected share of hits is the containment itself.

Items are partitioned by size. An item with n shingles, of which ``need`` must be present, posts its
n - need + 1 least hashes: whatever holds ``need`` of n shingles must hold one of these, so no leak
is missed. Documents are partitioned by size too (powers of two): an item is looked for only in
partitions whose documents can hold ``need`` shingles. Candidates are then verified exactly, on
the shingles themselves. Everything is DataFrame functions; Spark broadcasts the posted values or
the candidates where they are below its own size threshold, and joins by shuffle beyond.
"""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame, functions as F

from packlens.llm.common import staged

SHINGLE = 5
PERCENT = 80
_GAP = "[\\x20\\x09-\\x0D]+"


def word_array(text: Column) -> Column:
    """Words of a text, A-Z in lower case; a null text has none."""
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), ascii_uppercase, ascii_lowercase), _GAP), "")


def _kept(rows: DataFrame, name: str, value: Column) -> DataFrame:
    """``rows`` with a column that is computed once a row: the optimizer would else repeat it inside each lambda."""
    return rows.withColumn(name, F.explode(F.array(value)))


def _shingled(rows: DataFrame, size: int) -> DataFrame:
    """Replaces ``words`` by the distinct shingles' texts, ``shingles``; with fewer words the whole sequence is one."""
    n = F.size("words")
    return rows.withColumn(
        "shingles",
        F.when(
            n >= size,
            F.array_distinct(F.transform(F.sequence(F.lit(1), n - (size - 1)), lambda i: F.array_join(F.slice("words", i, size), " "))),
        )
        .when(n > 0, F.array(F.array_join("words", " ")))
        .otherwise(F.array().cast("array<string>")),
    ).drop("words")


def _hashed(rows: DataFrame, size: int) -> DataFrame:
    """Replaces ``words`` by ``hashes``, one 64-bit number for each distinct shingle."""
    rows = _kept(rows, "each", F.transform("words", lambda w: F.xxhash64(w))).drop("words")
    n = F.size("each")
    return rows.withColumn(
        "hashes",
        F.when(
            n >= size,
            F.array_distinct(
                F.transform(F.sequence(F.lit(0), n - size), lambda i: F.xxhash64(*[F.get("each", i + j) for j in range(size)]))
            ),
        )
        .when(n > 0, F.array(F.xxhash64(F.lit(0), "each")))
        .otherwise(F.array().cast("array<bigint>")),
    ).drop("each")


def leaks(
    docs: DataFrame, items: DataFrame, *, doc: str = "doc_id", doc_text: str = "text", item: str = "item_id", item_text: str = "text",
    size: int = SHINGLE, percent: int = PERCENT,
) -> DataFrame:
    """Pairs (doc, item, item_shingles, shared) where a document holds ``percent`` of an item's distinct shingles.

    Rows with a null key take no part, and neither do texts without words. Rows with one key are
    read as one text side by side: their shingles count together. Items with the same text are
    reported each.
    """
    texts = docs.filter(F.col(doc).isNotNull()).select(F.col(doc).alias("d"), F.col(doc_text).alias("t"))
    tests = items.filter(F.col(item).isNotNull()).select(F.col(item).alias("i"), F.col(item_text).alias("t"))
    words = lambda rows, key: _kept(rows.select(key, "t"), "words", word_array(F.col("t"))).select(key, "words")

    size_of = F.size("hashes")
    need = F.floor((size_of * percent + 99) / 100).cast("int")
    posted = staged(
        _hashed(words(tests, "i"), size).filter(size_of > 0)
        .select(F.explode(F.slice(F.sort_array("hashes"), F.lit(1), size_of - need + 1)).alias("hash"), need.alias("need"))
        .groupBy("hash").agg(F.min(_partition(F.col("need"))).alias("least_partition")),
        "posted",
    )
    probes = _hashed(words(texts, "d"), size).select("d", _partition(size_of).alias("partition"), F.explode("hashes").alias("hash"))
    found = staged(probes.join(posted, "hash").filter("partition >= least_partition").select("d").distinct(), "candidates")

    whole = _shingled(words(texts.join(found, "d", "left_semi"), "d"), size).select("d", F.explode("shingles").alias("shingle"))
    wanted = staged(
        _shingled(words(tests, "i"), size).select("i", F.size("shingles").alias("n"), F.explode("shingles").alias("shingle")), "wanted"
    )
    return (
        whole.join(wanted, "shingle").groupBy("d", "i", "n").agg(F.countDistinct("shingle").alias("shared"))
        .filter(F.col("shared") * 100 >= F.col("n") * percent)
        .select(F.col("d").alias(doc), F.col("i").alias(item), F.col("n").cast("long").alias("item_shingles"), "shared")
    )


def _partition(size: Column) -> Column:
    """Sizes from 2^p to 2^(p+1) - 1 form partition p."""
    return F.floor(F.log2(F.greatest(size, F.lit(1)))).cast("int")
