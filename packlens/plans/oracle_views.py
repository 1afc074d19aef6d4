"""DuckDB twins of the adapter views, as WITH clauses."""

from __future__ import annotations

from packlens.sources.cells import (
    CELL_EXPRESSIONS,
    REQUEST_EXPRESSIONS,
    SOH_EXPRESSION,
    UNCHECKED_EXPRESSIONS,
)
from packlens.sources.passages import KEPT_COORDINATES, PLANTED_QUESTION, TURNED
from packlens.sources.replies import ANSWER, CONFIDENCE, VARIANT, VEC_ID


def _select(expressions, source: str) -> str:
    return f"SELECT {', '.join(expressions)} FROM {source}"


_GOOD_REPLY = f"""to_json({{'answer': {ANSWER}, 'confidence': {CONFIDENCE}, 'sources': CASE (conv_id+turn)%4
    WHEN 0 THEN [1,99,0] WHEN 1 THEN [1,1] WHEN 2 THEN [] ELSE [2,1] END}})::VARCHAR"""

_BLANKED = f"list_transform(embedding, lambda x, i: CASE WHEN i-1 < {KEPT_COORDINATES} THEN x ELSE 0 END)"
_TURNED = f"list_transform(embedding, lambda x, j: CASE WHEN {TURNED.replace('i*11', '(j-1)*11')} THEN -x ELSE x END)"

VIEWS = {
    "cell_samples": _select(CELL_EXPRESSIONS, "lineitem"),
    "labelled_cells": f"SELECT *, {SOH_EXPRESSION} AS soh FROM cell_samples",
    "score_requests": _select(REQUEST_EXPRESSIONS, "events"),
    "unchecked_requests": _select(UNCHECKED_EXPRESSIONS, "events"),
    "vector_queries": f"SELECT vec_id AS qid, {_TURNED} AS embedding, label % 3 <> 0 AS answerable, label FROM embeddings",
    "hits": """SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, chunk_id) AS rank FROM (
        SELECT qid, vec_id AS chunk_id,
          round(coalesce(list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]),0),10) AS score
        FROM vector_queries q CROSS JOIN embeddings v)""",
    "corrupt_vectors": f"""SELECT vec_id AS chunk_id, CASE WHEN vec_id % 97 = 0 THEN list_reverse(embedding)
        WHEN vec_id % 13 = 0 THEN {_BLANKED} ELSE embedding END AS embedding FROM embeddings""",
    "passages": "SELECT doc_id AS chunk_id, source || '/' || doc_id AS source, text, lang FROM documents",
    "questions": f"SELECT conv_id, turn, {PLANTED_QUESTION} AS question FROM conversations WHERE role='user'",
    "replies": f"""SELECT q.*, a.text AS reply, d.text AS passage FROM
        (SELECT conv_id, turn, {VEC_ID} AS vec_id FROM conversations WHERE role='user') q
        JOIN conversations a ON a.role='assistant' AND a.conv_id=q.conv_id AND a.turn=q.turn+1
        LEFT JOIN documents d ON d.doc_id=q.vec_id""",
    "attempts": f"""SELECT conv_id, turn, 1 AS attempt, CASE WHEN {VARIANT} IN (6,7,9) THEN reply ELSE {_GOOD_REPLY} END AS raw,
          CASE WHEN {VARIANT}=8 THEN 503 END AS status_code, NULL::VARCHAR AS error_module FROM replies
        UNION ALL SELECT conv_id, turn, 2, CASE WHEN {VARIANT}=6 THEN {_GOOD_REPLY} ELSE reply END, NULL,
          CASE WHEN {VARIANT}=9 THEN 'httpx._exceptions' END FROM replies WHERE {VARIANT} IN (6,7,9)""",
}


def with_views(names: list[str], body: str, recursive: bool = False) -> str:
    """``body`` after a WITH clause of the named views, in the order given.

    ``body`` may start with further ``name AS (...),`` definitions before its SELECT.
    """
    clauses = ", ".join(f"{name} AS ({VIEWS[name]})" for name in names)
    word = "WITH RECURSIVE" if recursive else "WITH"
    body = body.strip()
    joiner = " " if body.upper().startswith(("SELECT", "FROM")) else ", "
    return f"{word} {clauses}{joiner}{body}" if clauses else f"{word} {body}"
