"""Corpus, chunking and index-writing queries with their SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from packlens.operators import chunking, ingest
from packlens.plans.oracle_views import with_views
from packlens.session import staging_path
from packlens.settings import CHUNK_OVERLAP, CHUNK_SIZE
from packlens.sources import corpus, passages as views
from packlens.sources.sinks import staged
from packlens.sources.tables import spread, table

# File names and blank texts given to the documents. Same text in both engines.
FILE_NAME = (
    "concat(source, '/', cast(doc_id as string),"
    " CASE doc_id%5 WHEN 0 THEN '.md' WHEN 1 THEN '.TXT' WHEN 2 THEN '.markdown' WHEN 3 THEN '.json' ELSE '.txt' END)"
)
SOME_BLANK = "CASE WHEN doc_id%29=3 THEN concat(chr(10), '   ', chr(9)) ELSE text END"


def _named(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").selectExpr(
        "doc_id", "source AS collection", f"{FILE_NAME} AS source", f"{SOME_BLANK} AS text"
    )


def corpus_scan(spark: SparkSession, folder: str) -> DataFrame:
    return corpus.usable(_named(spark, folder)).groupBy("collection").agg(
        F.count(F.lit(1)).alias("n_documents"),
        F.sum(F.length("text").cast("bigint")).alias("n_chars"),
        F.count_if(F.col("source").endswith(".md")).alias("n_md"),
    )


def _digested(chunks: DataFrame) -> DataFrame:
    return chunks.select(
        "doc_id",
        F.col("start_index").cast("bigint").alias("start_index"),
        F.length("chunk").cast("bigint").alias("n_chars"),
        F.md5("chunk").alias("digest"),
    )


def chunk_fixed(spark: SparkSession, folder: str) -> DataFrame:
    return _digested(chunking.fixed_chunks(spread(table(spark, folder, "documents").select("doc_id", "text"))))


def chunk_boundary(spark: SparkSession, folder: str) -> DataFrame:
    return _digested(chunking.boundary_chunks(spread(table(spark, folder, "documents").select("doc_id", "text"))))


def chunk_recursive(spark: SparkSession, folder: str) -> DataFrame:
    return _digested(chunking.recursive_chunks(spread(table(spark, folder, "documents").select("doc_id", "text"))))


def ingest_idempotent(spark: SparkSession, folder: str) -> DataFrame:
    """Chunks held after writing twice with a reset, and after writing once more without."""
    # A chunk carries its own text, not its document's as well.
    chunks = chunking.fixed_chunks(corpus.usable(_named(spark, folder))).drop("text")
    path = staging_path(spark, "chunks")
    ingest.write_index(spark, chunks, path)
    index = ingest.write_index(spark, chunks, path)
    once = index.agg(F.lit("reset").alias("mode"), F.count(F.lit(1)).alias("n_chunks"))
    appended = staging_path(spark, "chunks")
    ingest.write_index(spark, chunks, appended)
    both = ingest.write_index(spark, chunks, appended, reset=False)
    return once.unionByName(both.agg(F.lit("append").alias("mode"), F.count(F.lit(1)).alias("n_chunks")))


def ingest_verified(spark: SparkSession, folder: str) -> DataFrame:
    """Publish the sound index after its self-retrieval check."""
    vectors = views.vectors(spark, folder)
    chunks = views.passages(spark, folder).join(vectors, "chunk_id")
    queries = vectors.withColumnRenamed("chunk_id", "qid")
    published = ingest.publish_verified(spark, chunks, queries, staging_path(spark, "published"))
    return published.groupBy("lang").agg(
        F.count(F.lit(1)).alias("n_chunks"), F.sum(F.length("text").cast("bigint")).alias("n_chars")
    )


# Which documents the second run leaves out, changes, and sees first. Same text in both engines.
_LATE, _LEFT, _EDITED = "doc_id%13 = 2", "doc_id%7 = 0", "doc_id%11 = 1"


def ingest_changes(spark: SparkSession, folder: str) -> DataFrame:
    """Three runs over a corpus that loses, changes and gains documents, then nothing; last what is held."""
    named = corpus.usable(_named(spark, folder)).select("doc_id", "source", "text")
    second = named.where(f"NOT {_LEFT}").withColumn("text", F.expr(f"CASE WHEN {_EDITED} THEN concat(text, ' v2') ELSE text END"))
    path = staging_path(spark, "store")
    runs = []
    for number, docs in enumerate((named.where(f"NOT {_LATE}"), second, second), 1):
        done = ingest.ingest_changes(spark, docs.select("source", "text"), path, chunking.fixed_chunks)
        runs.append(staged(done.select(F.lit(number).alias("run"), "status", "n_documents", "n_chunks"), "runs"))
    held = ingest.current_chunks(spark, path).agg(
        F.lit(4).alias("run"), F.lit("held").alias("status"), F.count_distinct("source").alias("n_documents"), F.count(F.lit(1)).alias("n_chunks")
    )
    return reduce(DataFrame.unionByName, runs).unionByName(held)


def index_history(spark: SparkSession, folder: str) -> DataFrame:
    """Two versions published one after the other: the first one's even chunks, then all; the newest is current."""
    vectors = views.vectors(spark, folder)
    chunks = views.passages(spark, folder).join(vectors, "chunk_id")
    queries = vectors.withColumnRenamed("chunk_id", "qid")
    path = staging_path(spark, "published")
    ingest.publish_verified(spark, chunks.where("chunk_id % 2 = 0"), queries.where("qid % 2 = 0"), path)
    ingest.publish_verified(spark, chunks, queries, path)
    return ingest.index_versions(spark, path).select("version", "n_chunks", "current")


QUERIES = {
    "ingest_changes": ingest_changes,
    "index_history": index_history,
    "corpus_scan": corpus_scan,
    "chunk_fixed": chunk_fixed,
    "chunk_boundary": chunk_boundary,
    "chunk_recursive": chunk_recursive,
    "ingest_idempotent": ingest_idempotent,
    "ingest_verified": ingest_verified,
}

_STRIDE = CHUNK_SIZE - CHUNK_OVERLAP
_NAMED = f"named AS (SELECT doc_id, source AS collection, {FILE_NAME} AS source, {SOME_BLANK} AS text FROM documents)"
_USABLE = r"""usable AS (SELECT * FROM named WHERE regexp_matches(text, '[^\s\p{Z}]')
    AND lower(regexp_extract(source, '\.([^./]+)$', 1)) IN ('md','markdown','txt'))"""
_STARTS = f"range(0, greatest(1, ceil((length(text)-{CHUNK_OVERLAP})/{_STRIDE}::DOUBLE)::BIGINT)) "


def _last(separator: str) -> str:
    """Characters up to the last separator in the second half of window ``w``, else NULL."""
    at = f"strpos(reverse(substr(w, {CHUNK_SIZE // 2 + 1})), {separator})"
    return f"CASE WHEN {at} > 0 THEN {CHUNK_SIZE}-{at}+1 END"


_ENDS = ", ".join(_last(separator) for separator in ("chr(10)||chr(10)", "chr(10)", "chr(32)"))
_TAKEN = f"CASE WHEN p+{CHUNK_SIZE} >= n THEN n-p ELSE coalesce({_ENDS}, {CHUNK_SIZE}) END"

def _cut(level: int, separator: str) -> str:
    """Views of one level: its parts' pieces, each from a separator to the next one, and the long pieces as parts of the next level."""
    return f"""w{level} AS (SELECT doc_id, p, unnest(a) AS w, generate_subscripts(a, 1) AS k
        FROM (SELECT doc_id, p, string_split(t, {separator}) AS a FROM part{level})),
      v{level} AS (SELECT doc_id, p, k, CASE WHEN k = 1 THEN w ELSE {separator} || w END AS t FROM w{level}),
      piece{level} AS (SELECT doc_id, {level} AS level, p AS part, t, length(t) AS n,
          (p + sum(length(t)) OVER o - length(t))::BIGINT AS s,
          count(*) FILTER (WHERE length(t) >= {CHUNK_SIZE}) OVER o AS n_long
        FROM v{level} WINDOW o AS (PARTITION BY doc_id, p ORDER BY k)),
      part{level + 1} AS (SELECT doc_id, s AS p, t FROM piece{level} WHERE n >= {CHUNK_SIZE})"""


_WHITE = r"[\s\x0B\x1C-\x1F\x{85}\p{Z}]*"
# Runs of short pieces, as their starts and ends; chunks of each run, one after the other; white space off both ends.
_RECURSIVE = f"""WITH RECURSIVE part1 AS (SELECT doc_id, 0::BIGINT AS p, text AS t FROM documents WHERE length(text) > 0),
    {_cut(1, "chr(10)||chr(10)")}, {_cut(2, "chr(10)")}, {_cut(3, "chr(32)")},
    runs AS (
      SELECT doc_id, list(s ORDER BY s) AS starts, max(s + n) AS stop FROM (
        SELECT doc_id, level, part, n_long, s, n FROM piece1 WHERE n BETWEEN 1 AND {CHUNK_SIZE - 1}
        UNION ALL SELECT doc_id, level, part, n_long, s, n FROM piece2 WHERE n BETWEEN 1 AND {CHUNK_SIZE - 1}
        UNION ALL SELECT doc_id, level, part, n_long, s, n FROM piece3 WHERE n BETWEEN 1 AND {CHUNK_SIZE - 1})
      GROUP BY doc_id, level, part, n_long
      UNION ALL SELECT doc_id, range(p, p + length(t)), p + length(t) FROM part4),
    run AS (SELECT row_number() OVER () AS id, doc_id, starts, list_append(starts[2:], stop) AS ends, stop FROM runs),
    c AS (
      SELECT id, starts[1] AS s, list_max(list_filter(ends, lambda x: x <= starts[1] + {CHUNK_SIZE})) AS e FROM run
      UNION ALL
      SELECT id, s, list_max(list_filter(ends, lambda x: x <= s + {CHUNK_SIZE})) FROM (
        SELECT id, ends, list_min(list_filter(starts, lambda x: x >= greatest(e - {CHUNK_OVERLAP}, p - {CHUNK_SIZE}))) AS s FROM (
          SELECT id, e, starts, ends, list_min(list_filter(ends, lambda x: x > e)) AS p FROM c JOIN run USING (id) WHERE e < stop))),
    inner_ AS (SELECT doc_id, s, e, substr(text, s + 1, e - s) AS t FROM c JOIN run USING (id) JOIN documents USING (doc_id)),
    stripped AS (SELECT doc_id, e, s + length(regexp_extract(t, '^{_WHITE}')) AS start_index,
        regexp_replace(regexp_replace(t, '^{_WHITE}', ''), '{_WHITE}$', '') AS t FROM inner_),
    kept AS (SELECT *, start_index + length(t) AS stop, max(start_index + length(t)) OVER (
        PARTITION BY doc_id ORDER BY e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reached FROM stripped WHERE t <> '')
    SELECT doc_id, start_index, length(t) AS n_chars, md5(t) AS digest FROM kept WHERE reached IS NULL OR stop > reached"""

_CHUNKS_OF = "greatest(1, ceil((length({t})-" + f"{CHUNK_OVERLAP})/{_STRIDE}::DOUBLE)::BIGINT)"
_CHANGES = f"""{_NAMED}, {_USABLE},
    docs AS (SELECT doc_id, text, CASE WHEN {_EDITED} THEN concat(text, ' v2') ELSE text END AS later, NOT {_LATE} AS first, NOT {_LEFT} AS second FROM usable),
    runs AS (SELECT 1 AS run, 'new' AS status, {_CHUNKS_OF.format(t='text')} AS k FROM docs WHERE first
      UNION ALL SELECT 2, CASE WHEN NOT first THEN 'new' WHEN NOT second THEN 'gone' WHEN text = later THEN 'same' ELSE 'changed' END,
        CASE WHEN second AND (NOT first OR text <> later) THEN {_CHUNKS_OF.format(t='later')} ELSE 0 END FROM docs WHERE first OR second
      UNION ALL SELECT 3, 'same', 0 FROM docs WHERE second
      UNION ALL SELECT 4, 'held', {_CHUNKS_OF.format(t='later')} FROM docs WHERE second)"""

ORACLES = {
    "ingest_changes": f"WITH {_CHANGES} SELECT run, status, count(*) AS n_documents, sum(k)::BIGINT AS n_chunks FROM runs GROUP BY run, status",
    "index_history": with_views(
        ["passages"],
        """n AS (SELECT count(*) AS a, count(*) FILTER (WHERE chunk_id % 2 = 0) AS b FROM passages JOIN embeddings ON vec_id = chunk_id)
        SELECT 1::BIGINT AS version, b AS n_chunks, false AS "current" FROM n UNION ALL SELECT 2, a, true FROM n""",
    ),
    "corpus_scan": f"""WITH {_NAMED}, {_USABLE} SELECT collection, count(*) AS n_documents,
        sum(length(text))::BIGINT AS n_chars, count(*) FILTER (WHERE ends_with(source,'.md')) AS n_md FROM usable GROUP BY collection""",
    "chunk_fixed": f"""WITH s AS (SELECT doc_id, text, unnest({_STARTS})*{_STRIDE} AS start_index FROM documents
        WHERE length(text) > 0)
        SELECT doc_id, start_index, length(substr(text, start_index+1, {CHUNK_SIZE})) AS n_chars,
          md5(substr(text, start_index+1, {CHUNK_SIZE})) AS digest FROM s""",
    "chunk_boundary": f"""WITH RECURSIVE t AS (SELECT doc_id, text, length(text) AS n FROM documents WHERE length(text) > 0),
        c AS (
          SELECT doc_id, p, {_TAKEN} AS k FROM (SELECT doc_id, n, 0::BIGINT AS p, substr(text, 1, {CHUNK_SIZE}) AS w FROM t)
          UNION ALL
          SELECT doc_id, p, {_TAKEN} FROM (
            SELECT doc_id, n, p, substr(text, p+1, {CHUNK_SIZE}) AS w FROM (
              SELECT t.doc_id, t.text, t.n, c.p+c.k-{CHUNK_OVERLAP} + CASE WHEN
                length(regexp_extract(substr(t.text, c.p+c.k-{CHUNK_OVERLAP}+1, {CHUNK_OVERLAP}), '^[^ \n]*')) + 1
                  BETWEEN 1 AND {CHUNK_OVERLAP - 1}
                THEN length(regexp_extract(substr(t.text, c.p+c.k-{CHUNK_OVERLAP}+1, {CHUNK_OVERLAP}), '^[^ \n]*')) + 1
                ELSE 0 END AS p
              FROM c JOIN t USING (doc_id) WHERE c.p+c.k < t.n)))
        SELECT doc_id, p AS start_index, length(substr(text, p+1, k)) AS n_chars, md5(substr(text, p+1, k)) AS digest
        FROM c JOIN t USING (doc_id)""",
    "chunk_recursive": _RECURSIVE,
    "ingest_idempotent": f"""WITH {_NAMED}, {_USABLE},
        n AS (SELECT sum(len({_STARTS}))::BIGINT AS n FROM usable)
        SELECT 'reset' AS mode, n AS n_chunks FROM n UNION ALL SELECT 'append', 2*n FROM n""",
    "ingest_verified": with_views(
        ["passages"],
        """SELECT lang, count(*) AS n_chunks, sum(length(text))::BIGINT AS n_chars
        FROM passages JOIN embeddings ON vec_id = chunk_id GROUP BY lang""",
    ),
}
