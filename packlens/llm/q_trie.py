"""op11: the prefix trie of the rebuilt conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from packlens.llm.trie import prefix_trie
from packlens.sources.tables import spread, table


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per node of the trie of all rebuilt conversations."""
    return prefix_trie(spread(table(spark, sf_dir, "conversations")))


#: crc32 of a decimal number, bit by bit; 3988292384 is its polynomial.
_CRC = (
    "xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), [CAST(ord(x) AS BIGINT) FOR x IN string_split(CAST(conv_id AS VARCHAR), '')]), "
    "lambda c, b: list_reduce(list_prepend(xor(c, b), [CAST(0 AS BIGINT) FOR i IN range(8)]), lambda d, z: xor(d // 2, (d % 2) * 3988292384))))"
)
OP11 = f"""
WITH o AS (
  SELECT conv_id, sha256(concat(length(coalesce(role, '')), ':', coalesce(role, ''), coalesce(text, ''))) AS g, length(coalesce(text, '')) AS size, turn
  FROM conversations WHERE conv_id IS NOT NULL
), t AS (SELECT conv_id, g, size, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, g) AS pos FROM o),
c AS (SELECT conv_id, conv_id - conv_id % 100 AS base, {_CRC} % 6 AS h FROM (SELECT DISTINCT conv_id FROM o)),
b AS (SELECT c.conv_id, t.pos, t.g, t.size FROM c JOIN t ON t.conv_id = c.base AND t.pos <= c.h),
w AS (SELECT conv_id, pos, g, size FROM b UNION ALL SELECT t.conv_id, 10 + t.pos, t.g, t.size FROM t JOIN c USING (conv_id) WHERE t.pos > c.h),
d AS (SELECT conv_id, g, size, row_number() OVER (PARTITION BY conv_id ORDER BY pos) AS depth FROM w),
p AS (
  SELECT conv_id, depth, size, sha256(string_agg(g, '') OVER (PARTITION BY conv_id ORDER BY depth)) AS k FROM d
  UNION ALL SELECT conv_id, 0, 0, 'root' FROM c
), n AS (SELECT depth, k, min(conv_id) AS v, count(*) AS n_convs, (count(*) - 1) * min(size) AS saved FROM p GROUP BY depth, k),
u AS (SELECT n.*, q.k AS pk, m.v AS pv FROM n LEFT JOIN p q ON q.conv_id = n.v AND q.depth = n.depth - 1 LEFT JOIN n m ON m.k = q.k),
f AS (SELECT pk AS k, count(*) AS n_children FROM u WHERE pk IS NOT NULL GROUP BY pk),
s AS (
  SELECT a.k, count(*) FILTER (WHERE f.k IS NULL) AS n_leaves, CAST(sum(n.saved) AS BIGINT) AS saved_tokens
  FROM n JOIN p a ON a.conv_id = n.v AND a.depth <= n.depth LEFT JOIN f ON f.k = n.k GROUP BY a.k
), l AS (SELECT conv_id, arg_max(k, depth) AS k FROM p GROUP BY conv_id),
e AS (SELECT k, string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) AS ids FROM l GROUP BY k)
SELECT u.v AS conv_id, u.depth, u.pv AS parent_conv_id, u.n_convs, coalesce(f.n_children, 0) AS n_children, s.n_leaves, s.saved_tokens,
  sha256(coalesce(e.ids, '')) AS ends_sha256
FROM u JOIN s USING (k) LEFT JOIN f USING (k) LEFT JOIN e USING (k)
"""

QUERIES = {"op11_prefix_trie": op11_prefix_trie}
SQL = {"op11_prefix_trie": OP11}
