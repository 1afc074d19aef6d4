"""op10: near-duplicate groups of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from packlens.llm.neardup import near_groups
from packlens.llm.q_decontaminate import shingle_sql
from packlens.sources.tables import table


def op10_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(table(spark, sf_dir, "documents"))


OP10 = f"""
WITH RECURSIVE {shingle_sql("d", "documents", "doc_id")},
n AS (SELECT doc_id, count(*) AS n_shingles FROM d GROUP BY doc_id),
c AS (SELECT a.doc_id AS i, b.doc_id AS j, count(*) AS common FROM d a JOIN d b USING (s) WHERE a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT i, j FROM c JOIN n x ON x.doc_id = i JOIN n y ON y.doc_id = j WHERE 100 * common >= 85 * (x.n_shingles + y.n_shingles - common)),
r AS (SELECT i, j FROM l UNION SELECT r.i, l.j FROM r JOIN l ON r.j = l.i),
m AS (SELECT i, min(j) AS least FROM r GROUP BY i)
SELECT doc_id, coalesce(n_shingles, 0) AS n_shingles, least(doc_id, coalesce(least, doc_id)) AS component_id,
  doc_id <= coalesce(least, doc_id) AS kept
FROM documents LEFT JOIN n USING (doc_id) LEFT JOIN m ON i = doc_id
"""

QUERIES = {"op10_near_duplicates": op10_near_duplicates}
SQL = {"op10_near_duplicates": OP10}
