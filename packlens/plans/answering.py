"""Screening, grounding and answer queries with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from packlens import api
from packlens.functions import screening as rules
from packlens.functions.text import STOPWORDS
from packlens.operators import answers as ops, screening
from packlens.plans.oracle_views import with_views
from packlens.settings import MIN_RELEVANCE, PHONE_DIGITS, TOP_K
from packlens.sources import passages as views, replies as logged, sinks
from packlens.sources.tables import spread, table

KEYS = ["conv_id", "turn"]


def input_screening(spark: SparkSession, folder: str) -> DataFrame:
    screened = screening.screen_questions(views.questions(spark, folder))
    sql_labels = F.filter("pii_labels", lambda x: x.isin("EMAIL", "IBAN", "IP"))
    return screened.select(
        *KEYS,
        "allowed",
        "reason",
        "message",
        "intent",
        "estimated_tokens",
        F.round("injection_score", 4).alias("injection_score"),
        F.array_join("injection_patterns", "|").alias("injection_patterns"),
        F.array_join(sql_labels, "|").alias("pii_labels"),
        F.when(F.col("allowed"), F.lit("")).otherwise(F.md5("query")).alias("refused_query"),
    )


def _texts(spark: SparkSession, folder: str) -> DataFrame:
    asked = views.questions(spark, folder).select(F.lit("questions").alias("origin"), F.col("question").alias("text"))
    documents = table(spark, folder, "documents").select(F.concat(F.lit("documents-"), "lang").alias("origin"), "text")
    return asked.unionByName(spread(documents))


def injection_scan(spark: SparkSession, folder: str) -> DataFrame:
    return screening.injection_totals(_texts(spark, folder), "text", ["origin"])


def intent_routing(spark: SparkSession, folder: str) -> DataFrame:
    return screening.intent_totals(_texts(spark, folder), "text", ["origin"])


def pii_redaction(spark: SparkSession, folder: str) -> DataFrame:
    """The labels whose patterns SQL can repeat."""
    totals = screening.personal_data_totals(_texts(spark, folder), "text", ["origin"])
    return totals.where(F.col("label").isin("EMAIL", "IBAN", "IP"))


def pii_redaction_full(spark: SparkSession, folder: str) -> DataFrame:
    """All labels, and the redacted texts themselves."""
    scrubbed = rules.scrub(spread(table(spark, folder, "documents").select("doc_id", "text")), "text")
    return scrubbed.select("doc_id", F.md5("pii_text").alias("digest"), F.array_join("pii_labels", "|").alias("labels"))


def _audited(spark: SparkSession, folder: str) -> DataFrame:
    """Each reply graded against the related passage and its question."""
    said = logged.replies(spark, folder).withColumn("answer", F.expr(logged.ANSWER))
    asked = table(spark, folder, "conversations").where("role = 'user'").select(*KEYS, "text")
    contexts = F.when(
        (F.col("conv_id") + F.col("turn")) % 5 == 0, F.array().cast("array<string>")
    ).otherwise(F.array_compact(F.array("text", "passage")))
    paired = said.join(asked, KEYS).withColumn("contexts", contexts)
    return ops.with_groundedness(paired, "answer", "contexts")


def groundedness(spark: SparkSession, folder: str) -> DataFrame:
    return _audited(spark, folder).select(
        *KEYS,
        F.col("n_sentences").cast("bigint").alias("n_sentences"),
        F.size("unsupported").cast("bigint").alias("n_unsupported"),
        F.round("groundedness", 6).alias("groundedness"),
        F.md5(F.array_join("unsupported", "|")).alias("unsupported"),
    )


def uncertainty(spark: SparkSession, folder: str) -> DataFrame:
    best = F.when((F.col("conv_id") + F.col("turn")) % 7 != 0, F.expr("((conv_id*3+turn)%11)/1e1"))
    graded = _audited(spark, folder).withColumn(
        "reasons", ops.uncertainty_reasons(F.expr(logged.CONFIDENCE), best, F.col("groundedness"))
    )
    return graded.select(
        *KEYS, F.array_join("reasons", "|").alias("reasons"), ops.uncertainty_level(F.col("reasons")).alias("level")
    )


def output_resolution(spark: SparkSession, folder: str) -> DataFrame:
    resolved = ops.resolve_outputs(logged.attempts(spark, folder), KEYS)
    return resolved.select(
        *KEYS,
        "attempts",
        F.coalesce("failure", F.lit("")).alias("failure"),
        F.coalesce(F.round("raw_confidence", 4), F.lit(-1.0)).alias("confidence"),
        F.coalesce(F.array_join(F.transform("sources", lambda s: s.cast("string")), ","), F.lit("")).alias("sources"),
        F.md5(F.coalesce("answer", F.lit(""))).alias("answer"),
    )


def _answers(spark: SparkSession, folder: str, hits: DataFrame | None = None) -> DataFrame:
    """All questions answered; ``hits`` may bring the search results of all vector queries."""
    return answered(spark, folder, logged.question_rows(spark, folder), logged.attempts(spark, folder), hits)


def answered(spark: SparkSession, folder: str, asked: DataFrame, attempts: DataFrame, hits: DataFrame | None = None) -> DataFrame:
    """Questions (keys, question, vec_id) answered from the attempts given."""
    queries = views.vector_queries(spark, folder).select(F.col("qid").alias("query_id"), "embedding")
    questions = asked.withColumnRenamed("vec_id", "query_id").join(queries, "query_id", "left")
    return api.ask_docs(questions, views.vectors(spark, folder), views.passages(spark, folder), attempts, KEYS, hits=hits)


def answers(spark: SparkSession, folder: str) -> DataFrame:
    return answer_rows(_answers(spark, folder))


def answer_rows(answers: DataFrame) -> DataFrame:
    """Answers in the form that is compared: texts and citations as digests."""
    cited = F.transform("citations", lambda c: F.concat(c["source"], F.lit(":"), c["snippet"]))
    return answers.select(
        *KEYS,
        "outcome",
        "refused",
        F.round("confidence", 4).alias("confidence"),
        "uncertainty_level",
        F.array_join("uncertainty_reasons", "|").alias("uncertainty_reasons"),
        F.round("groundedness", 6).alias("groundedness"),
        F.size("citations").cast("bigint").alias("n_citations"),
        F.md5(F.array_join(cited, "|")).alias("citations"),
        F.md5(F.when(F.col("refused"), F.lit("")).otherwise(F.col("answer"))).alias("answer"),
    )


def citations(spark: SparkSession, folder: str) -> DataFrame:
    listed = _answers(spark, folder).select(*KEYS, F.posexplode_outer("citations").alias("i", "c"))
    return listed.where("c is not null").select(
        *KEYS, (F.col("i") + 1).cast("bigint").alias("position"), F.col("c.source").alias("source"),
        F.col("c.snippet").alias("snippet"),
    )


def guardrail_outcomes(spark: SparkSession, folder: str) -> DataFrame:
    totals = ops.outcome_totals(_answers(spark, folder))
    means = ("mean_groundedness", "mean_confidence", "mean_best_relevance")
    return totals.withColumns({m: F.round(m, 8) for m in means})


def answers_json(spark: SparkSession, folder: str) -> DataFrame:
    return sinks.as_json(_answers(spark, folder))


QUERIES = {
    "input_screening": input_screening,
    "injection_scan": injection_scan,
    "intent_routing": intent_routing,
    "pii_redaction": pii_redaction,
    "pii_redaction_full": pii_redaction_full,
    "groundedness": groundedness,
    "uncertainty": uncertainty,
    "output_resolution": output_resolution,
    "answers": answers,
    "citations": citations,
    "guardrail_outcomes": guardrail_outcomes,
    "answers_json": answers_json,
}


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _injection_list(column: str) -> str:
    entries = []
    for name, pattern, weight, *exact in rules.INJECTION_FAMILIES:
        folded = "" if exact else ", 'i'"
        entries.append(
            f"CASE WHEN regexp_matches({column}, {_quoted(pattern)}{folded})"
            f" THEN {{'name': '{name}', 'weight': {weight}::DOUBLE}} END"
        )
    return f"list_filter([{', '.join(entries)}], lambda h: h IS NOT NULL)"


def _intent_case(column: str) -> str:
    terms = ", ".join(_quoted(t) for t in rules.DOMAIN_TERMS)
    off = " OR ".join(f"regexp_matches({column}, {_quoted(p)}, 'i')" for _, p in rules.OUT_OF_SCOPE)
    return (
        f"CASE WHEN list_has_any(regexp_extract_all(lower({column}), {_quoted(rules.DOMAIN_WORD)}), [{terms}])"
        f" THEN 'in_domain' WHEN {off} THEN 'out_of_scope' ELSE 'unknown' END"
    )


# Patterns with word classes spelled out: the SQL engine's own classes are ASCII.
_PII = {
    "EMAIL": r"[\p{L}\p{N}_.+-]+@[\p{L}\p{N}_-]+\.[\p{L}\p{N}_.-]{2,}",
    "IBAN": r"\b[A-Z]{2}\d{2}[A-Z0-9]{10,30}\b",
    "IP": r"\b(?:\d{1,3}\.){3}\d{1,3}\b",
}


def _pii_steps(source: str, column: str, keep: str) -> str:
    """CTEs p1..p4 replacing one label after another; n_<label> counts the matches."""
    out, current, counts = [], source, ""
    text = column
    for i, (label, pattern) in enumerate(_PII.items(), 1):
        out.append(
            f"p{i} AS (SELECT {keep}{counts}, len(regexp_extract_all({text}, {_quoted(pattern)})) AS n_{label},"
            f" regexp_replace({text}, {_quoted(pattern)}, '[{label}]', 'g') AS t FROM {current})"
        )
        counts += f", n_{label}"
        current, text = f"p{i}", "t"
    return ", ".join(out)


def _runs_replaced(step: int, label: str, counts: str, run: str, lengths: tuple[int, int], first: str, around: str, digits: tuple[int, int]) -> str:
    """CTEs up to p<step>: runs of a pattern that SQL can only test with all neighbours at hand.

    At each character that may be first, the longest run is taken whose neighbours are none of ``around``; of
    overlapping runs the leftmost stays, and those with a number of digits outside ``digits`` stay as they are.
    """
    x, near = f"x{step}", _quoted(around)
    part = "array_to_string(ch[i:i+n-1], '')"
    gap = "coalesce(array_to_string(ch[CASE WHEN k = 1 THEN 1 ELSE hits[k-1].e END:hits[k].s-1], ''), '')"
    return f"""{x} AS (SELECT *, string_split(t, '') AS ch FROM p{step - 1}),
      {x}_start AS (SELECT doc_id, ch, unnest(list_filter(range(1, len(ch) + 1), lambda i:
          regexp_matches(ch[i], {_quoted(first)}) AND NOT (i > 1 AND regexp_matches(ch[i-1], {near})))) AS i FROM {x}),
      {x}_run AS (SELECT doc_id, ch, i, list_max(list_filter(range({lengths[0]}, {lengths[1] + 1}), lambda n: i + n - 1 <= len(ch)
          AND regexp_full_match({part}, {_quoted(run)}) AND (i + n > len(ch) OR NOT regexp_matches(ch[i+n], {near})))) AS n FROM {x}_start),
      {x}_all AS (SELECT doc_id, list({{'s': i, 'e': i + n, 'run': {part}}} ORDER BY i) AS hits FROM {x}_run WHERE n IS NOT NULL GROUP BY doc_id),
      {x}_left AS (SELECT doc_id, hits, hits[1] AS h FROM {x}_all UNION ALL SELECT * FROM (
          SELECT doc_id, hits, list_filter(hits, lambda o: o.s >= h.e)[1] AS h FROM {x}_left) WHERE h IS NOT NULL),
      {x}_hits AS (SELECT doc_id, list(struct_insert(h, good := length(regexp_replace(h.run, '\\P{{Nd}}', '', 'g'))
          BETWEEN {digits[0]} AND {digits[1]}) ORDER BY h.s) AS hits FROM {x}_left GROUP BY doc_id),
      p{step} AS (SELECT doc_id{counts}, coalesce(len(list_filter(hits, lambda h: h.good)), 0) AS n_{label}, CASE WHEN hits IS NULL THEN t ELSE
          array_to_string(list_transform(range(1, len(hits) + 1), lambda k: {gap} || CASE WHEN hits[k].good THEN '[{label}]' ELSE hits[k].run END), '')
          || coalesce(array_to_string(ch[hits[len(hits)].e:], ''), '') END AS t FROM {x} LEFT JOIN {x}_hits USING (doc_id))"""


_PII_COUNTS = "".join(f", n_{label}" for label in _PII)
_CARDS = _runs_replaced(4, "CREDIT_CARD", _PII_COUNTS, r"(?:\p{Nd}[ -]?){13,19}", (13, 38), r"\p{Nd}", r"[\p{Nd}.]", (13, 19))
_PHONES = _runs_replaced(
    5, "PHONE", f"{_PII_COUNTS}, n_CREDIT_CARD", r"\+?\p{Nd}[\p{Nd}\s\x0B\x{85}\p{Z}.\-()]{7,18}\p{Nd}", (9, 21),
    r"[\p{Nd}+]", r"[\p{L}\p{M}\p{N}\p{Pc}.]", PHONE_DIGITS,
)
_ALL_LABELS = ", ".join(f"CASE WHEN n_{label} > 0 THEN '{label}' END" for label in sorted([*_PII, "CREDIT_CARD", "PHONE"]))

_TEXTS = """texts AS (SELECT 'questions' AS origin, question AS text FROM questions
    UNION ALL SELECT 'documents-' || lang, text FROM documents)"""
_TOKENS = r"greatest(length(question)//4, len(regexp_extract_all(question, '[^\s\p{Z}]+')))"
_BLANK = r"NOT regexp_matches(coalesce(question, ''), '[^\s\p{Z}]')"
_STOP = ", ".join(_quoted(w) for w in STOPWORDS)


def _words(text: str) -> str:
    return (
        f"list_distinct(list_filter(regexp_extract_all(lower({text}), '[a-z][a-z\\-]+'),"
        f" lambda w: length(w) > 2 AND NOT list_contains([{_STOP}], w)))"
    )


def _numbers(text: str) -> str:
    return f"list_distinct(regexp_extract_all({text}, '\\p{{Nd}}+(?:[.,]\\p{{Nd}}+)?'))"


def _strip(text: str) -> str:
    return f"regexp_replace({text}, '^[\\s\\p{{Z}}]+|[\\s\\p{{Z}}]+$', '', 'g')"


def _grounded(source: str, keys: str, answer: str, context: str, has_context: str) -> str:
    """CTEs from ``source`` to ``graded`` (keys, n, bad, share)."""
    return rf"""
    sents AS (SELECT {keys}, ({context}) AS ctx, ({has_context}) AS has_context, unnest(list_filter(list_transform(
        string_split(regexp_replace({_strip(answer)}, '([.!?])[\s\p{{Z}}]+', '\1' || chr(1), 'g'), chr(1)),
        lambda s: {_strip('s')}), lambda s: s <> '')) AS s,
        generate_subscripts(list_filter(list_transform(
        string_split(regexp_replace({_strip(answer)}, '([.!?])[\s\p{{Z}}]+', '\1' || chr(1), 'g'), chr(1)),
        lambda s: {_strip('s')}), lambda s: s <> ''), 1) AS i FROM {source}),
    vocab AS (SELECT {keys}, {_words('ctx')} AS cw, {_numbers('ctx')} AS cn FROM
        (SELECT {keys}, ({context}) AS ctx FROM {source})),
    marked AS (SELECT *, {_words('s')} AS sw, {_numbers('s')} AS sn FROM sents JOIN vocab USING ({keys})),
    verdicts AS (SELECT *, NOT has_context OR (len(sw) > 0 AND len(list_intersect(sw, cw))::DOUBLE/len(sw) < 6e-1)
        OR NOT list_has_all(cn, sn) AS bad FROM marked),
    graded AS (SELECT {keys}, count(*) AS n, count(*) FILTER (WHERE bad) AS n_bad,
        (count(*) FILTER (WHERE NOT bad))/count(*)::DOUBLE AS share,
        coalesce(string_agg(s, '|' ORDER BY i) FILTER (WHERE bad), '') AS bad_text FROM verdicts GROUP BY {keys})
    """


_AUDIT = f"""said AS (SELECT r.*, {logged.ANSWER} AS answer, q.text AS asked FROM replies r JOIN
    (SELECT conv_id, turn, text FROM conversations WHERE role='user') q USING (conv_id, turn)),""" + _grounded(
    "said", "conv_id, turn", "answer", "concat_ws(' ', asked, passage)", "(conv_id+turn)%5 <> 0"
)
_AUDIT_ROWS = """rows AS (SELECT s.conv_id, s.turn, coalesce(n,0) AS n, coalesce(n_bad,0) AS n_bad,
    coalesce(share,0) AS share, coalesce(bad_text,'') AS bad_text FROM said s LEFT JOIN graded USING (conv_id, turn))"""

_SCREENED = f"""screened0 AS (SELECT *, {_TOKENS} AS tokens, {_BLANK} AS blank, {_injection_list('question')} AS hits,
      {_intent_case('question')} AS routed FROM questions),
    screened1 AS (SELECT *, least(1e0, coalesce(list_sum(list_transform(hits, lambda h: h.weight)),0)) AS score FROM screened0),
    screened AS (SELECT *, CASE WHEN blank THEN 'empty' WHEN tokens > 512 THEN 'too_long'
      WHEN score >= 5e-1 THEN 'prompt_injection' WHEN routed = 'out_of_scope' THEN 'out_of_scope' ELSE 'ok' END AS reason
      FROM screened1)"""

_RESOLVED = """judged AS (SELECT *, CASE
        WHEN status_code IS NOT NULL OR split_part(error_module,'.',1) IN ('anthropic','openai','ollama','httpx','httpcore')
          THEN 'provider_error'
        WHEN json_valid(raw) AND json_extract_string(raw,'$.answer') IS NOT NULL
          AND json_extract(raw,'$.confidence') IS NOT NULL THEN 'ok' END AS outcome FROM attempts WHERE attempt <= 2),
    firsts AS (SELECT conv_id, turn, min(attempt) FILTER (WHERE outcome IS NOT NULL) AS attempt FROM judged GROUP BY ALL),
    resolved AS (SELECT f.conv_id, f.turn, coalesce(f.attempt,2) AS attempts,
        CASE WHEN j.outcome = 'ok' THEN '' ELSE coalesce(j.outcome,'invalid_output') END AS failure,
        CASE WHEN j.outcome = 'ok' THEN json_extract_string(raw,'$.answer') END AS answer,
        CASE WHEN j.outcome = 'ok' THEN json_extract(raw,'$.confidence')::DOUBLE END AS raw_confidence,
        CASE WHEN j.outcome = 'ok' THEN json_extract(raw,'$.sources')::BIGINT[] END AS sources
      FROM firsts f LEFT JOIN judged j USING (conv_id, turn, attempt))"""

_ANSWERS = (
    _SCREENED
    + ", "
    + _RESOLVED
    + f""",
    passed AS (SELECT qid AS vec_id, rank, source, text, round(score,4) AS relevance FROM hits JOIN passages USING (chunk_id)
      WHERE rank <= {TOP_K} AND score >= {MIN_RELEVANCE}),
    kept AS (SELECT vec_id, list({{'rank': rank, 'source': source, 'text': text, 'relevance': relevance}} ORDER BY rank) AS kept,
      max(relevance) AS best, string_agg(text, ' ' ORDER BY rank) AS ctx FROM passed GROUP BY vec_id),
    joined AS (SELECT s.conv_id, s.turn, k.kept, k.best, k.ctx, r.answer AS said, r.sources,
        greatest(0e0, least(1e0, r.raw_confidence)) AS conf,
        CASE WHEN s.reason <> 'ok' THEN s.reason WHEN k.kept IS NULL THEN 'no_relevant_context'
          WHEN r.attempts IS NULL THEN 'provider_error' WHEN r.failure <> '' THEN r.failure
          WHEN greatest(0e0, least(1e0, r.raw_confidence)) < 3e-1 THEN 'low_confidence' ELSE 'answered' END AS outcome
      FROM screened s LEFT JOIN kept k ON k.vec_id = {logged.VEC_ID.replace('conv_id', 's.conv_id').replace('turn', 's.turn')}
      LEFT JOIN resolved r ON r.conv_id = s.conv_id AND r.turn = s.turn),
    told AS (SELECT * FROM joined WHERE outcome = 'answered'),"""
    + _grounded("told", "conv_id, turn", "said", "ctx", "true")
    + r""",
    cites0 AS (SELECT conv_id, turn, pos, kept[idx] AS p FROM (SELECT conv_id, turn, kept, unnest(picked) AS idx,
        generate_subscripts(picked, 1) AS pos FROM (SELECT conv_id, turn, kept,
          CASE WHEN len(list_filter(sources, lambda i: i BETWEEN 1 AND len(kept))) > 0
            THEN list_filter(sources, lambda i: i BETWEEN 1 AND len(kept)) ELSE range(1, len(kept)+1) END AS picked FROM told))),
    cites1 AS (SELECT conv_id, turn, pos, p.source AS source,
        substr(trim(regexp_replace(p.text, '[\s\p{Z}]+', ' ', 'g')), 1, 240) AS snippet FROM cites0),
    cites2 AS (SELECT conv_id, turn, source, snippet, min(pos) AS pos FROM cites1 GROUP BY ALL),
    cites AS (SELECT conv_id, turn, source, snippet, row_number() OVER (PARTITION BY conv_id, turn ORDER BY pos) AS position
      FROM cites2),
    cited AS (SELECT conv_id, turn, count(*) AS n_citations, string_agg(source || ':' || snippet, '|' ORDER BY position) AS c
      FROM cites GROUP BY ALL),
    final AS (SELECT j.conv_id, j.turn, outcome, outcome <> 'answered' AS refused,
        CASE WHEN outcome IN ('answered','low_confidence') THEN conf ELSE 0 END AS confidence,
        CASE WHEN outcome = 'answered' THEN coalesce(share,0) ELSE 0 END AS groundedness,
        CASE WHEN outcome = 'answered' THEN concat_ws('|', CASE WHEN conf < 6e-1 THEN 'low_confidence' END,
          CASE WHEN best < 6e-1 THEN 'weak_retrieval' END, CASE WHEN coalesce(share,0) < 6e-1 THEN 'weak_grounding' END)
          ELSE outcome END AS uncertainty_reasons,
        coalesce(n_citations,0) AS n_citations, md5(coalesce(c,'')) AS citations,
        md5(CASE WHEN outcome = 'answered' THEN said ELSE '' END) AS answer,
        coalesce(best,0) AS best
      FROM joined j LEFT JOIN graded g USING (conv_id, turn) LEFT JOIN cited USING (conv_id, turn)),
    leveled AS (SELECT *, CASE WHEN outcome <> 'answered' THEN 'high' WHEN uncertainty_reasons = '' THEN 'low'
        WHEN contains(uncertainty_reasons, '|') THEN 'high' ELSE 'medium' END AS uncertainty_level FROM final)"""
)
_ANSWER_VIEWS = ["questions", "replies", "attempts", "vector_queries", "hits", "passages"]

ORACLES = {
    "input_screening": with_views(
        ["questions"],
        f"""{_SCREENED}, {_pii_steps("screened", "question", "conv_id, turn")}
        SELECT conv_id, turn, reason = 'ok' AS allowed, reason,
          CASE reason WHEN 'ok' THEN '' WHEN 'too_long' THEN 'That question is ' || tokens || ' tokens; the limit is 512. Please shorten it.'
            WHEN 'empty' THEN {_quoted(screening.MESSAGES['empty'])}
            WHEN 'prompt_injection' THEN {_quoted(screening.MESSAGES['prompt_injection'])}
            ELSE {_quoted(screening.MESSAGES['out_of_scope'])} END AS message,
          CASE WHEN reason IN ('ok','out_of_scope') THEN routed ELSE 'unknown' END AS intent,
          CASE WHEN blank THEN 0 ELSE tokens END AS estimated_tokens,
          CASE WHEN reason IN ('ok','prompt_injection') THEN round(score,4) ELSE 0 END AS injection_score,
          CASE WHEN reason IN ('ok','prompt_injection') THEN array_to_string(list_transform(hits, lambda h: h.name),'|') ELSE '' END
            AS injection_patterns,
          CASE WHEN reason = 'ok' THEN concat_ws('|', CASE WHEN n_EMAIL>0 THEN 'EMAIL' END, CASE WHEN n_IBAN>0 THEN 'IBAN' END,
            CASE WHEN n_IP>0 THEN 'IP' END) ELSE '' END AS pii_labels,
          CASE reason WHEN 'ok' THEN '' WHEN 'too_long' THEN md5(substr(question,1,200))
            WHEN 'prompt_injection' THEN md5('[REDACTED]') ELSE md5(question) END AS refused_query
        FROM screened JOIN p3 USING (conv_id, turn)""",
    ),
    "injection_scan": with_views(
        ["questions"],
        f"""{_TEXTS}, h AS (SELECT origin, unnest({_injection_list('text')}) AS hit FROM texts)
        SELECT origin, hit.name AS family, count(*) AS n, max(hit.weight) AS weight FROM h GROUP BY ALL""",
    ),
    "intent_routing": with_views(
        ["questions"], f"{_TEXTS} SELECT origin, {_intent_case('text')} AS intent, count(*) AS n FROM texts GROUP BY ALL"
    ),
    "pii_redaction": with_views(
        ["questions"],
        f"""{_TEXTS}, {_pii_steps("texts", "text", "origin")},
        u AS (SELECT origin, unnest([{{'l':'EMAIL','n':n_EMAIL}},{{'l':'IBAN','n':n_IBAN}},{{'l':'IP','n':n_IP}}]) AS x FROM p3)
        SELECT origin, x.l AS label, count(*) FILTER (WHERE x.n > 0) AS n_texts, sum(x.n)::BIGINT AS n_hits FROM u GROUP BY ALL""",
    ),
    "pii_redaction_full": with_views(
        [],
        f"""{_pii_steps("documents", "text", "doc_id")}, {_CARDS}, {_PHONES}
        SELECT doc_id, md5(t) AS digest, concat_ws('|', {_ALL_LABELS}) AS labels FROM p5""",
        recursive=True,
    ),
    "groundedness": with_views(
        ["replies"],
        f"""{_AUDIT}, {_AUDIT_ROWS} SELECT conv_id, turn, n AS n_sentences, n_bad AS n_unsupported,
          round(share,6) AS groundedness, md5(bad_text) AS unsupported FROM rows""",
    ),
    "uncertainty": with_views(
        ["replies"],
        f"""{_AUDIT}, {_AUDIT_ROWS}, r AS (SELECT conv_id, turn, concat_ws('|',
          CASE WHEN {logged.CONFIDENCE} < 6e-1 THEN 'low_confidence' END,
          CASE WHEN (conv_id+turn)%7 = 0 OR ((conv_id*3+turn)%11)/1e1 < 6e-1 THEN 'weak_retrieval' END,
          CASE WHEN share < 6e-1 THEN 'weak_grounding' END) AS reasons FROM rows)
        SELECT conv_id, turn, reasons, CASE WHEN reasons = '' THEN 'low' WHEN contains(reasons,'|') THEN 'high' ELSE 'medium' END
          AS level FROM r""",
    ),
    "output_resolution": with_views(
        ["replies", "attempts"],
        f"""{_RESOLVED} SELECT conv_id, turn, attempts, failure, coalesce(round(raw_confidence,4),-1) AS confidence,
          coalesce(array_to_string(sources,','),'') AS sources, md5(coalesce(answer,'')) AS answer FROM resolved""",
    ),
    "answers": with_views(
        _ANSWER_VIEWS,
        f"""{_ANSWERS} SELECT conv_id, turn, outcome, refused, round(confidence,4) AS confidence, uncertainty_level,
          uncertainty_reasons, round(groundedness,6) AS groundedness, n_citations, citations, answer FROM leveled""",
    ),
    "citations": with_views(
        _ANSWER_VIEWS, f"{_ANSWERS} SELECT conv_id, turn, position, source, snippet FROM cites"
    ),
    "guardrail_outcomes": with_views(
        _ANSWER_VIEWS,
        f"""{_ANSWERS} SELECT outcome, uncertainty_level, count(*) AS n, count(*) FILTER (WHERE refused) AS n_refused,
          round(avg(groundedness),8) AS mean_groundedness, round(avg(confidence),8) AS mean_confidence,
          round(avg(CASE WHEN outcome IN ('empty','too_long','prompt_injection','out_of_scope') THEN 0 ELSE best END),8)
            AS mean_best_relevance
        FROM leveled GROUP BY ALL""",
    ),
}
