"""Writing a chunk index: reset or append, publishing only what verifies, and taking in only what changed."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from packlens.operators.retrieval import self_retrieval
from packlens.session import staging_path
from packlens.settings import SELF_RETRIEVAL_FLOOR
from packlens.sources.sinks import append_rows, replace_table


class IndexProblems(RuntimeError):
    """A staged index in which some chunks do not find themselves."""

    def __init__(self, total: int, examples: list[str], path: str) -> None:
        self.total = total
        self.examples = examples
        self.path = path
        super().__init__(f"{total} chunk(s) failed verification, all listed in {path}, among them:\n  " + "\n  ".join(examples))


def write_index(spark: SparkSession, chunks: DataFrame, path: str, reset: bool = True) -> DataFrame:
    """Replace the index, so that running again changes nothing, or append to it."""
    if reset:
        return replace_table(spark, chunks, "index", path)
    append_rows(chunks, path)
    return spark.read.schema(chunks.schema).parquet(path)


class VersionConflict(RuntimeError):
    """Another publisher took the version number."""


def publish_verified(
    spark: SparkSession,
    chunks: DataFrame,
    queries: DataFrame,
    path: str,
    floor: float = SELF_RETRIEVAL_FLOOR,
    after: int | None = None,
) -> DataFrame:
    """Write (chunk_id, source, text, embedding) rows as a version, check it, and publish it if all are sound.

    ``queries`` holds the vectors recomputed from the texts, with qid = chunk_id. A version is
    written once, below ``path``; publishing creates the manifest of the next number, which points to it,
    so readers see the old index or the new one. The version that a publisher builds on, ``after`` (the newest
    one when it starts by default), must still be the newest when it publishes: else ``VersionConflict``.
    Nothing is published when a chunk fails; the error says how many did, names a few and tells where all are listed.
    """
    after = _newest(spark, path) if after is None else after
    version = f"{path}/versions/{uuid.uuid4().hex}"
    staged = replace_table(spark, chunks, "index", version)
    checked = self_retrieval(staged, queries, staged.select("chunk_id", "embedding"), floor)
    # Staged as well: the search behind it runs once for the count and the examples.
    listed = staging_path(spark, "index-problems")
    problems = replace_table(spark, checked.where(F.col("problem").isNotNull()), "index-problems", listed)
    found = problems.count()
    if found:
        examples = [f"{r['chunk_id']}: {r['problem']}" for r in problems.orderBy("chunk_id").limit(10).collect()]
        raise IndexProblems(found, examples, listed)
    _claim(spark, path, after + 1, {"version": after + 1, "location": version, "n_chunks": staged.count()})
    return published_index(spark, path)


def _manifest(spark: SparkSession, path: str, number: int | None = None) -> tuple:
    """The manifest folder, or the manifest of a version, and the file system it is on."""
    jvm = spark.sparkContext._jvm
    name = f"{path}/manifest" if number is None else f"{path}/manifest/{number:012d}.json"
    place = jvm.org.apache.hadoop.fs.Path(name)
    return place, place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _newest(spark: SparkSession, path: str) -> int:
    """The newest published version, 0 if there is none."""
    place, files = _manifest(spark, path)
    names = [f.getPath().getName() for f in files.listStatus(place)] if files.exists(place) else []
    return max([int(n.removesuffix(".json")) for n in names if n.endswith(".json")], default=0)


def _claim(spark: SparkSession, path: str, number: int, facts: dict) -> None:
    """Creates the manifest of a version, which only one publisher can."""
    place, files = _manifest(spark, path, number)
    try:
        out = files.create(place, False)
    except Exception as error:
        if files.exists(place):
            raise VersionConflict(f"version {number} of {path} is taken") from error
        raise
    try:
        out.write(bytearray(json.dumps(facts).encode("utf-8")))
    finally:
        out.close()


def index_versions(spark: SparkSession, path: str) -> DataFrame:
    """(version, location, n_chunks, current) of every published version; those that are not current may expire."""
    listed = spark.read.schema("version bigint, location string, n_chunks bigint").json(f"{path}/manifest")
    return listed.withColumn("current", F.col("version") == _newest(spark, path))


def published_index(spark: SparkSession, path: str) -> DataFrame:
    """The version of the index that was published last."""
    newest = index_versions(spark, path).where("current").first()
    if newest is None:
        raise RuntimeError(f"no version is published below {path}")
    return spark.read.parquet(newest["location"])


# ------------------------------------------------------------------ only what changed

STATE = "source string, digest string, gone boolean, batch int"


def _known(spark: SparkSession, path: str) -> DataFrame:
    """(source, digest) of the documents that are in the index: the last word of the state on each source."""
    if not _has(spark, f"{path}/state"):
        return spark.createDataFrame([], "source string, digest string, batch int")
    state = spark.read.schema(STATE).parquet(f"{path}/state")
    last = state.groupBy("source").agg(F.max_by(F.struct("digest", "gone", "batch"), "batch").alias("x"))
    return last.where("not x.gone").select("source", "x.digest", "x.batch")


def ingest_changes(spark: SparkSession, documents: DataFrame, path: str, chunk: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(status, n_documents, n_chunks): takes (source, text) documents into the chunk store at ``path``.

    Documents are known by source and told apart by the digest of their text. Only ``new`` and ``changed`` ones are
    given to ``chunk`` and written; ``gone`` ones leave a tombstone; ``same`` ones cost a comparison of digests. Equal
    rows count once; of several texts of one source that of the greatest digest counts. A null source or text is no
    document. A run that finds nothing new writes nothing. Chunks are written before the state that names them, so a run
    that broke off is repeated by the next one.
    """
    digest = F.sha2("text", 256)
    given = documents.where("source is not null and text is not null").withColumn("digest", digest)
    newest = given.groupBy("source").agg(F.max("digest").alias("digest"))
    known = replace_table(spark, _known(spark, path), "known")
    old = known.select("source", F.col("digest").alias("old"))
    status = (
        F.when(F.col("old").isNull(), "new").when(F.col("digest").isNull(), "gone").when(F.col("old") == F.col("digest"), "same").otherwise("changed")
    )
    changes = replace_table(spark, newest.join(old, "source", "full").select("source", "digest", status.alias("status")), "changes")
    counted = changes.groupBy("status").agg(F.count(F.lit(1)).alias("n_documents"))
    moved = changes.where("status <> 'same'")
    if moved.isEmpty():
        return counted.withColumn("n_chunks", F.lit(0).cast("bigint"))
    number = 1 + (spark.read.schema(STATE).parquet(f"{path}/state").agg(F.max("batch")).first()[0] if _has(spark, f"{path}/state") else 0)
    fresh = changes.where("status in ('new', 'changed')")
    texts = given.join(fresh, ["source", "digest"]).dropDuplicates(["source", "digest"])
    # A chunk carries its document's source and digest, not its whole text.
    chunks = chunk(texts.select("source", "digest", "status", "text")).drop("text")
    written = replace_table(spark, chunks, "chunks", f"{path}/chunks/batch={number}")
    state = moved.select("source", F.when(F.col("status") != "gone", F.col("digest")).alias("digest"), (F.col("status") == "gone").alias("gone"))
    state.write.mode("overwrite").parquet(f"{path}/state/batch={number}")
    sizes = written.groupBy("status").agg(F.count(F.lit(1)).alias("n_chunks"))
    return counted.join(sizes, "status", "left").select("status", "n_documents", F.coalesce("n_chunks", F.lit(0)).cast("bigint").alias("n_chunks"))


def _has(spark: SparkSession, path: str) -> bool:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)


def current_chunks(spark: SparkSession, path: str) -> DataFrame:
    """The chunks of the documents that are in the index now, each as its last batch wrote it."""
    chunks = spark.read.option("basePath", f"{path}/chunks").parquet(f"{path}/chunks")
    return chunks.join(_known(spark, path), ["source", "digest", "batch"], "left_semi")
