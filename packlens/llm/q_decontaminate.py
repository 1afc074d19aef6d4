"""op4: documents that hold benchmark items."""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import DataFrame, SparkSession

from packlens.llm.decontaminate import leaks
from packlens.sources.tables import table


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def shingle_sql(name: str, table_: str, key: str) -> str:
    """Common table expressions that end in ``name`` (key, s): the distinct five-word shingles of a table's texts."""
    words = f"[w for w in regexp_split_to_array(translate(coalesce(text, ''), '{ascii_uppercase}', '{ascii_lowercase}'), '[\\x20\\x09-\\x0D]+') if w <> '']"
    next_ = ", ".join(f"lead(w, {j}) OVER o AS w{j}" for j in range(1, 5))
    return (
        f"{name}_list AS (SELECT {key}, {words} AS l FROM {table_} WHERE {key} IS NOT NULL), "
        f"{name}_words AS (SELECT {key}, len(l) AS n, unnest(l) AS w, unnest(range(1, len(l) + 1)) AS p FROM {name}_list), "
        f"{name}_runs AS (SELECT {key}, n, w, p, {next_} FROM {name}_words WINDOW o AS (PARTITION BY {key} ORDER BY p)), "
        f"{name} AS (SELECT DISTINCT {key}, CASE WHEN n >= 5 THEN concat_ws(' ', w, w1, w2, w3, w4) ELSE concat_ws(' ', w, w1, w2, w3) END AS s "
        f"FROM {name}_runs WHERE p <= greatest(1, n - 4))"
    )


OP4 = f"""
WITH {shingle_sql("d", "documents", "doc_id")}, {shingle_sql("b", "benchmark", "item_id")},
n AS (SELECT item_id, count(*) AS item_shingles FROM b GROUP BY item_id),
m AS (SELECT doc_id, item_id, count(*) AS shared FROM d JOIN b USING (s) GROUP BY doc_id, item_id)
SELECT doc_id, item_id, item_shingles, shared FROM m JOIN n USING (item_id) WHERE shared * 100 >= item_shingles * 80
"""

QUERIES = {"op4_decontamination": op4_decontamination}
SQL = {"op4_decontamination": OP4}
