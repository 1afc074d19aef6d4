"""Golden-set and gate queries with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from packlens.operators import answers as graded, evalgate as ops, retrieval
from packlens.plans.answering import _ANSWER_VIEWS, _ANSWERS, KEYS, _answers, _grounded
from packlens.plans.oracle_views import with_views
from packlens.settings import JUDGED_METRICS, MIN_COVERAGE, MIN_RELEVANCE, SCORE_GATES, TOP_K
from packlens.sources import golden, passages as views, replies as logged
from packlens.session import staging_path
from packlens.sources.sinks import staged, write_report


def _hits(spark: SparkSession, folder: str) -> DataFrame:
    return retrieval.nearest(views.vector_queries(spark, folder), views.vectors(spark, folder))


def _recall(spark: SparkSession, folder: str, hits: DataFrame) -> DataFrame:
    items = golden.golden_items(spark, folder)
    kept = retrieval.above_floor(hits).join(views.passages(spark, folder), "chunk_id")
    return ops.chunk_recall(items, golden.expected_chunks(spark, folder), kept, "qid")


def retrieval_recall(spark: SparkSession, folder: str) -> DataFrame:
    return _recall(spark, folder, _hits(spark, folder)).select("qid", F.round("recall", 6).alias("recall"))


def golden_rot(spark: SparkSession, folder: str) -> DataFrame:
    corpus = views.passages(spark, folder)
    return ops.rotten_truth(golden.rotting_truth(spark, folder), corpus).select("doc_id", "source", "problem")


def golden_composition(spark: SparkSession, folder: str) -> DataFrame:
    return ops.composition(golden.golden_items(spark, folder), golden.expected_chunks(spark, folder))


def _records(spark: SparkSession, folder: str) -> DataFrame:
    """The answers as evaluation records, with the class of the question and its recall."""
    asked = logged.question_rows(spark, folder).select(*KEYS, "vec_id")
    classes = views.vector_queries(spark, folder).select(F.col("qid").alias("vec_id"), "answerable")
    # One search serves the recall and the answers.
    hits = staged(_hits(spark, folder), "hits")
    recall = _recall(spark, folder, hits).select(F.col("qid").alias("vec_id"), "recall")
    found = asked.join(classes, "vec_id", "left").join(recall, "vec_id", "left").select(
        *KEYS, F.coalesce("answerable", F.lit(False)).alias("answerable"), F.coalesce("recall", F.lit(0.0)).alias("recall")
    )
    answered = _answers(spark, folder, hits).select(*KEYS, "refused", "refusal_reason")
    # Read by the scores and by the roll-up: computed once.
    return staged(found.join(answered, KEYS), "records")


def _scores(spark: SparkSession, folder: str, records: DataFrame) -> DataFrame:
    return ops.scored_items(records, golden.judged_scores(spark, folder), KEYS)


def _rolled(spark: SparkSession, folder: str) -> DataFrame:
    records = _records(spark, folder)
    return ops.roll_up(records, _scores(spark, folder, records))


def eval_rollup(spark: SparkSession, folder: str) -> DataFrame:
    rolled = _rolled(spark, folder)
    return rolled.withColumns({"score": F.round("score", 6), "scored": F.coalesce("scored", F.lit(-1))})


def eval_gate(spark: SparkSession, folder: str) -> DataFrame:
    # The few rows of the roll-up are read by both gates.
    rolled = staged(_rolled(spark, folder), "rollup")
    failed = ops.release_gate(rolled, golden.gates(spark))
    return failed.withColumn("actual", F.round("actual", 6))


def item_scores_long(spark: SparkSession, folder: str) -> DataFrame:
    records = _records(spark, folder)
    published = ops.published_scores(records, _scores(spark, folder, records), KEYS)
    return published.withColumn("value", F.round("value", 6))


def context_precision(spark: SparkSession, folder: str) -> DataFrame:
    """Label-based precision of the ranking, and how far the kept passages cover the item's own text."""
    queries = views.vector_queries(spark, folder)
    hits = staged(_hits(spark, folder), "hits")
    labels = spark.read.parquet(f"{folder}/embeddings.parquet").select(
        F.col("vec_id").alias("chunk_id"), F.col("label").alias("chunk_label")
    )
    ranked = hits.join(labels, "chunk_id").join(queries.select("qid", "label"), "qid").select(
        "qid", "rank", (F.col("label") == F.col("chunk_label")).alias("relevant")
    )
    precision = ops.average_precision(ranked, "qid")
    texts = views.passages(spark, folder)
    kept = graded.gather_passages(retrieval.above_floor(hits), texts).select(
        "qid", F.transform("kept", lambda p: p["text"]).alias("contexts")
    )
    reference = texts.select(F.col("chunk_id").alias("qid"), F.col("text").alias("reference"))
    covered = graded.with_groundedness(kept.join(reference, "qid"), "reference", "contexts")
    return precision.join(covered.select("qid", "groundedness"), "qid", "left").select(
        "qid",
        F.round("context_precision", 6).alias("context_precision"),
        F.round(F.coalesce("groundedness", F.lit(0.0)), 6).alias("context_recall"),
    )


def report_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    """The report of the evaluation, written as JSON and read back: one row per metric."""
    path = staging_path(spark, "report")
    write_report(golden.report_of(staged(_rolled(spark, folder), "rollup")), path)
    read = golden.read_report(spark, path).select(F.explode("scores").alias("metric", "score"), "coverage", "n_answerable")
    return read.select("metric", F.round("score", 6).alias("score"), F.coalesce(F.try_element_at("coverage", "metric"), F.lit(-1)).alias("scored"), "n_answerable")


def golden_files(spark: SparkSession, folder: str) -> DataFrame:
    """The golden set, written as JSON files and read back: what each expected chunk must hold."""
    chunks = golden.expected_chunks(spark, folder).groupBy("qid").agg(
        F.transform(
            F.sort_array(F.collect_list(F.struct("position", "source", "must_contain"))), lambda c: F.struct(c["source"].alias("source"), c["must_contain"].alias("must_contain"))
        ).alias("expected_chunks")
    )
    items = golden.golden_items(spark, folder).join(chunks, "qid", "left").withColumns({"query": F.concat(F.lit("query "), F.col("qid").cast("string")), "reference_answer": F.lit("")})
    path = staging_path(spark, "golden")
    golden.write_items(items, path, "qid", golden.GOLDEN_SCHEMA, corpus="documents", description="derived from the vectors")
    read = golden.read_golden(spark, path)
    held = golden.expected_of(read).withColumn("must", F.md5(F.array_join("must_contain", "|")))
    return read.select("id", "query", "category", "answerable").join(held.select("id", "position", "source", "must"), "id", "left").select(
        "query", "id", "category", "answerable", F.coalesce("position", F.lit(-1)).cast("bigint").alias("position"), F.coalesce("source", F.lit("")).alias("source"), F.coalesce("must", F.lit("")).alias("must")
    )


QUERIES = {
    "report_roundtrip": report_roundtrip,
    "golden_files": golden_files,
    "retrieval_recall": retrieval_recall,
    "golden_rot": golden_rot,
    "golden_composition": golden_composition,
    "eval_rollup": eval_rollup,
    "eval_gate": eval_gate,
    "item_scores_long": item_scores_long,
    "context_precision": context_precision,
}

_GOLDEN = """golden AS (SELECT qid, 'g' || CASE WHEN qid%50=0 AND qid>0 THEN qid-1 ELSE qid END AS id, answerable,
      CASE WHEN answerable THEN CASE WHEN label%2=0 THEN 'factual' ELSE 'synthesis' END WHEN label%9=0 THEN 'vague'
        WHEN label%9=3 THEN 'out_of_scope' ELSE 'insufficient_context' END AS category FROM vector_queries),
    wanted AS (SELECT qid, 0 AS position, qid AS chunk_id FROM golden WHERE answerable
      UNION ALL SELECT qid, 1, qid+1 FROM golden WHERE answerable AND category='synthesis'),
    expected AS (SELECT qid, position, source, lower(substr(text,1,30)) AS m1, lower(substr(text,41,20)) AS m2
      FROM wanted JOIN passages USING (chunk_id))"""
_RECALL = f"""shown AS (SELECT qid, source, lower(text) AS text FROM hits JOIN passages USING (chunk_id)
      WHERE rank <= {TOP_K} AND score >= {MIN_RELEVANCE}),
    foundit AS (SELECT e.qid, e.position, coalesce(bool_or(ends_with(r.source, e.source) AND contains(r.text, m1)
        AND contains(r.text, m2)), false) AS f FROM expected e LEFT JOIN shown r ON r.qid = e.qid GROUP BY ALL),
    shares AS (SELECT qid, avg(f::INT) AS recall FROM foundit GROUP BY qid),
    recalls AS (SELECT g.qid, coalesce(recall, 1) AS recall FROM golden g LEFT JOIN shares USING (qid))"""
_JUDGED = " UNION ALL ".join(
    f"""SELECT conv_id, turn, '{m}' AS metric, CASE WHEN (conv_id*3+turn+{i})%7=0 THEN 'nan'::DOUBLE
        ELSE ((conv_id*13+turn*5+{i})%11)/1e1 END AS value FROM questions WHERE (conv_id+turn*2+{i})%13 <> 0"""
    for i, m in enumerate(JUDGED_METRICS)
)
_METRICS = ", ".join(f"('{m}')" for m in JUDGED_METRICS)
_VEC = logged.VEC_ID.replace("conv_id", "l.conv_id").replace("turn", "l.turn")
_RECORDS = (
    f"{_ANSWERS}, {_GOLDEN}, {_RECALL},"
    f""" records AS (SELECT l.conv_id, l.turn, refused, CASE WHEN refused THEN outcome ELSE '' END AS reason,
        coalesce(v.answerable, false) AS answerable, coalesce(r.recall, 0) AS recall
      FROM leveled l LEFT JOIN vector_queries v ON v.qid = {_VEC} LEFT JOIN recalls r ON r.qid = {_VEC}),
    judged_log AS ({_JUDGED}),
    scores AS (SELECT conv_id, turn, metric, 0e0 AS value FROM records, (VALUES {_METRICS}) m(metric) WHERE answerable AND refused
      UNION ALL SELECT j.* FROM judged_log j JOIN records USING (conv_id, turn)
        WHERE answerable AND NOT refused AND NOT isnan(value)),
    overall AS (SELECT count(*) AS n_items, count(*) FILTER (WHERE answerable) AS n_answerable,
        count(*) FILTER (WHERE NOT answerable) AS n_unanswerable, count(*) FILTER (WHERE reason='provider_error') AS n_provider_errors,
        coalesce(avg(recall) FILTER (WHERE answerable),0) AS rr,
        coalesce(avg((refused AND reason <> 'invalid_output')::INT) FILTER (WHERE NOT answerable),0) AS ra,
        coalesce(avg((reason <> 'invalid_output')::INT) FILTER (WHERE reason <> 'provider_error'),0) AS ov FROM records),
    metrics AS (SELECT 'retrieval_recall' AS metric, rr AS score, NULL::BIGINT AS scored FROM overall
      UNION ALL SELECT 'refusal_accuracy', ra, NULL FROM overall UNION ALL SELECT 'output_validity', ov, NULL FROM overall
      UNION ALL SELECT m.metric, coalesce(avg(value),0), count(value) FROM (VALUES {_METRICS}) m(metric)
        LEFT JOIN scores s ON s.metric = m.metric GROUP BY m.metric),
    rolled AS (SELECT metric, score, scored, n_items, n_answerable, n_unanswerable, n_provider_errors FROM metrics, overall)"""
)
_GATES = ", ".join(f"('{m}', {t}::DOUBLE)" for m, t in SCORE_GATES.items())

ORACLES = {
    "report_roundtrip": with_views(
        _ANSWER_VIEWS, f"{_RECORDS} SELECT metric, round(score,6) AS score, coalesce(scored,-1) AS scored, n_answerable FROM rolled"
    ),
    "golden_files": with_views(
        ["vector_queries", "passages"],
        f"""{_GOLDEN}, e AS (SELECT g.id, w.position, p.source, md5(substr(text,1,30) || '|' || lower(substr(text,41,20))) AS must
          FROM wanted w JOIN golden g USING (qid) JOIN passages p ON p.chunk_id = w.chunk_id)
        SELECT 'query ' || qid AS query, g.id, category, answerable, coalesce(position,-1)::BIGINT AS position, coalesce(source,'') AS source,
          coalesce(must,'') AS must FROM golden g LEFT JOIN e ON e.id = g.id""",
    ),
    "retrieval_recall": with_views(
        ["vector_queries", "hits", "passages"], f"{_GOLDEN}, {_RECALL} SELECT qid, round(recall,6) AS recall FROM recalls"
    ),
    "golden_rot": with_views(
        ["passages"],
        """e AS (SELECT doc_id, CASE WHEN toxic=1 THEN 'gone/' || source ELSE source END AS source,
          translate(substr(text, length(text)//2 + 1, 60), 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ')
            || CASE WHEN quality=0 THEN ' (revised)' ELSE '' END AS m, substr(text, 1, 20) AS m2, doc_id % 31 = 3 AS bare
          FROM labels JOIN passages ON chunk_id = doc_id),
        f AS (SELECT doc_id, e.source, CASE WHEN bare OR m = '' OR m2 = '' THEN 'no text required' WHEN p.text IS NULL THEN 'unknown source'
          WHEN NOT (contains(lower(p.text), lower(m)) AND contains(lower(p.text), lower(m2))) THEN 'text not found' END AS problem
        FROM e LEFT JOIN passages p USING (source))
        SELECT * FROM f WHERE problem IS NOT NULL""",
    ),
    "golden_composition": with_views(
        ["vector_queries", "passages"],
        f"""{_GOLDEN}, f AS (SELECT g.*, (SELECT count(*) FROM expected e WHERE e.qid = g.qid) AS n FROM golden g),
        c AS (SELECT count(*) AS n_items, count(*) FILTER (WHERE answerable) AS n_answerable,
          count(*) FILTER (WHERE NOT answerable) AS n_unanswerable, count(DISTINCT category) AS n_categories,
          count(DISTINCT CASE WHEN category IN ('vague','out_of_scope','insufficient_context') THEN category END) AS n_edge_categories,
          (SELECT count(*) FROM expected WHERE m1 = '' OR m2 = '') AS n_empty_required,
          count(*) - count(DISTINCT id) AS n_repeated_ids,
          count(*) FILTER (WHERE answerable <> (category IN ('factual','synthesis'))) AS n_class_mismatch,
          count(*) FILTER (WHERE answerable <> (n > 0)) AS n_expected_mismatch FROM f)
        SELECT *, n_items >= 20 AND n_answerable >= 15 AND n_unanswerable >= 5 AS large_enough,
          n_edge_categories = 3 AS edge_categories, n_repeated_ids = 0 AS ids_unique FROM c""",
    ),
    "eval_rollup": with_views(
        _ANSWER_VIEWS,
        f"""{_RECORDS} SELECT metric, round(score,6) AS score, coalesce(scored,-1) AS scored, n_items, n_answerable,
          n_unanswerable, n_provider_errors FROM rolled""",
    ),
    "eval_gate": with_views(
        _ANSWER_VIEWS,
        f"""{_RECORDS} SELECT metric, round(coalesce(score,0),6) AS actual, threshold, 'score' AS kind
          FROM (VALUES {_GATES}) g(metric, threshold) LEFT JOIN rolled USING (metric) WHERE coalesce(score,0) < threshold
        UNION ALL SELECT metric, round(scored/n_answerable::DOUBLE,6), {MIN_COVERAGE}::DOUBLE, 'coverage' FROM rolled
          WHERE scored IS NOT NULL AND n_answerable > 0 AND scored/n_answerable::DOUBLE < {MIN_COVERAGE}::DOUBLE""",
    ),
    "item_scores_long": with_views(
        _ANSWER_VIEWS,
        f"""{_RECORDS} SELECT conv_id, turn, metric, round(value,6) AS value FROM scores
        UNION ALL SELECT conv_id, turn, CASE WHEN answerable THEN 'retrieval_recall' ELSE 'refused_correctly' END,
          round(CASE WHEN answerable THEN recall ELSE refused::INT END,6) FROM records""",
    ),
    "context_precision": with_views(
        ["vector_queries", "hits", "passages"],
        f"""r AS (SELECT h.qid, h.rank, (q.label = e.label)::INT AS rel FROM hits h JOIN vector_queries q USING (qid)
          JOIN embeddings e ON e.vec_id = h.chunk_id
          WHERE rank <= {TOP_K}),
        w AS (SELECT *, sum(rel) OVER (PARTITION BY qid ORDER BY rank ROWS UNBOUNDED PRECEDING) AS c FROM r),
        prec AS (SELECT qid, coalesce(avg(CASE WHEN rel=1 THEN c/rank::DOUBLE END),0) AS p FROM w GROUP BY qid),
        ctxs AS (SELECT qid, string_agg(text, ' ' ORDER BY rank) AS ctx FROM hits JOIN passages USING (chunk_id)
          WHERE rank <= {TOP_K} AND score >= {MIN_RELEVANCE} GROUP BY qid),
        told AS (SELECT qid, ctx, text AS reference FROM ctxs JOIN passages ON chunk_id = qid),
        {_grounded("told", "qid", "reference", "ctx", "true")}
        SELECT qid, round(p,6) AS context_precision, round(coalesce(share,0),6) AS context_recall
        FROM prec LEFT JOIN graded USING (qid)""",
    ),
}
