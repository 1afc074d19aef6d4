"""A corpus from raw documents: language, near copies, benchmark leaks, personal data, source mix.

Each stage takes the documents its predecessor kept and returns the columns of ``documents``; the
last one adds ``copies``, how often the mix takes a document, and leaves out those it takes never.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from packlens.llm import decontaminate, langid, mixing, neardup, pii
from packlens.llm.common import staged
from packlens.sources.tables import table

#: A text whose windows agree on no language to this degree is rejected.
LEAST_LANGUAGE_SCORE = 0.3
#: Similarity of word shingles, in percent, from which documents are near copies.
NEAR_PERCENT = 80


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects texts that are null, have no letter, or have no clear language among those of the labels.

    Where no document has a label there is nothing to learn, and all texts with a letter stay.
    """
    network = langid.train(docs)
    if network is None:
        return docs.filter(F.col("text").rlike(r"\p{L}"))
    found = docs.withColumn("_language", langid.identify(spark, network, F.col("text")))
    sure = (F.col("_language.lang") != langid.UNKNOWN) & (F.col("_language.score") >= LEAST_LANGUAGE_SCORE)
    return found.filter(sure).select(*[F.col(f"`{c}`") for c in docs.columns])


def near_copy_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of least doc_id of each group, once. Rows without a doc_id stay.

    Groups link at a similarity of ``NEAR_PERCENT``; texts that are null or have no word are in no group.
    """
    groups = staged(neardup.near_groups(docs, percent=NEAR_PERCENT), "groups").filter("doc_id is not null")
    gone = groups.groupBy("doc_id").agg(F.max("kept").alias("any")).filter("not any").select("doc_id")
    left = docs.join(gone.hint("shuffle_hash"), "doc_id", "left_anti").select(*docs.columns)
    repeated = staged(groups.groupBy("doc_id").count().filter("count > 1").select("doc_id"), "repeated")
    if repeated.isEmpty():
        return left
    once = left.join(repeated, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return left.join(repeated, "doc_id", "left_anti").select(*docs.columns).unionByName(once.select(*docs.columns))


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes documents that hold a benchmark item, all rows of such a doc_id; rows without a doc_id or text stay."""
    found = staged(decontaminate.leaks(docs, table(spark, sf_dir, "benchmark")).select("doc_id").distinct(), "leaks")
    return docs.join(found.hint("shuffle_hash"), "doc_id", "left_anti").select(*docs.columns)


def personal_data_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data by marks; texts without any, null and empty ones stay as they are. No row goes."""
    found = docs.withColumn("_pii", pii.find(spark, pii.train(docs), F.col("text")))
    changed = F.col("_pii.redacted")
    new = {"text": F.coalesce(changed, F.col("text")), "n_chars": F.when(changed.isNotNull(), F.length(changed).cast("long")).otherwise(F.col("n_chars"))}
    return found.select(*[new[c].alias(c) if c in new else F.col(f"`{c}`") for c in docs.columns])


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes documents up to twice, so that sources come near their targets; adds ``copies``.

    A null source is a source; documents without a word cost nothing and are never taken. Repeated rows are
    documents of their own.
    """
    sized = docs.withColumns({"_sources": F.array("source"), "_size": mixing.word_count(F.col("text"))})
    targets = staged(mixing.water_targets(sized.groupBy("source").agg(F.sum("_size").alias("source_size"))), "targets")
    mixed = mixing.mix(sized, targets.select("source", "target"), sources="_sources", size="_size")
    return mixed.filter("copies > 0").drop("_sources", "_size")


STAGES = [
    ("language_id", language_stage),
    ("near_dedup", near_copy_stage),
    ("decontamination", benchmark_stage),
    ("personal_data", personal_data_stage),
    ("source_mix", mixing_stage),
]

#: The language network has no counterpart in SQL; tests compare the pipeline with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages applied to ``documents``, each written to the shared folder and read by the next one."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
