"""Answer assembly and audit from logged model attempts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from packlens.functions.numeric import clamp, ratio
from packlens.functions.text import bind, content_words, numbers, sentences, snippet
from packlens.operators.cells import reasons
from packlens.settings import (
    MIN_CONFIDENCE,
    MIN_GROUNDEDNESS,
    OUTPUT_RETRIES,
    UNCERTAIN_CONFIDENCE,
    UNCERTAIN_RELEVANCE,
)

REPLY_SCHEMA = "answer string, confidence double, sources array<bigint>"

# Modules whose errors mean that no model was reached.
PROVIDER_MODULES = ("anthropic", "openai", "ollama", "httpx", "httpcore")

# What a caller reads with a refusal or a shaky answer.
REFUSAL_TEXT = {
    "no_relevant_context": "I don't know — I couldn't find relevant information in the documents.",
    "low_confidence": "I don't know — I couldn't find relevant information in the documents.",
    "invalid_output": (
        "I couldn't produce a reliable answer just now — the model's response was malformed. Please try again."
    ),
    "provider_error": (
        "I couldn't reach the language model — the request failed before it produced anything. "
        "This is a configuration or account problem, not a question you can rephrase."
    ),
}
DISCLOSURE = {
    "medium": "This answer is only partly supported by the documentation — verify it before acting on it.",
    "high": (
        "Low confidence: the documentation does not clearly support this answer. "
        "Treat it as a lead, not a fact."
    ),
}


def _lookup(values: dict[str, str], key: Column) -> Column:
    """The text for ``key``, empty when there is none."""
    table = F.create_map(*[F.lit(x) for pair in values.items() for x in pair])
    return F.coalesce(F.try_element_at(table, key), F.lit(""))


def resolve_outputs(attempts: DataFrame, keys: list[str], retries: int = OUTPUT_RETRIES) -> DataFrame:
    """One row per request from its attempts: parsed reply, attempts used, failure.

    ``attempts`` holds the keys and (attempt, raw, status_code, error_module). The first
    attempt that parses, or that failed before reaching a model, decides.
    """
    reply = F.from_json("raw", REPLY_SCHEMA)
    # Sources may be absent; where they are given they must be a list of numbers.
    named = F.coalesce(F.map_contains_key(F.from_json("raw", "map<string,string>"), "sources"), F.lit(False))
    sound = ~named | F.coalesce(F.forall("reply.sources", lambda s: s.isNotNull()), F.lit(False))
    unreached = F.col("status_code").isNotNull() | F.coalesce(
        F.substring_index("error_module", ".", 1).isin(*PROVIDER_MODULES), F.lit(False)
    )
    parsed = F.col("reply.answer").isNotNull() & F.col("reply.confidence").isNotNull() & sound
    judged = attempts.withColumn("reply", reply).withColumn(
        "outcome", F.when(unreached, F.lit("provider_error")).when(parsed, F.lit("ok"))
    )
    within = judged.where(F.col("attempt") <= retries + 1)
    decisive = F.when(F.col("outcome").isNotNull(), F.col("attempt"))
    first = F.min_by(F.struct("outcome", "reply", "attempt"), decisive)
    resolved = within.groupBy(*keys).agg(first.alias("first"))
    answered = F.col("first.outcome") == "ok"
    return resolved.select(
        *keys,
        F.when(answered, F.col("first.reply.answer")).alias("answer"),
        F.when(answered, F.col("first.reply.confidence")).alias("raw_confidence"),
        F.when(answered, F.coalesce(F.col("first.reply.sources"), F.array().cast("array<bigint>"))).alias("sources"),
        F.coalesce(F.col("first.attempt"), F.lit(retries + 1)).cast("bigint").alias("attempts"),
        F.when(F.col("first.outcome") == "ok", F.lit(None).cast("string"))
        .otherwise(F.coalesce(F.col("first.outcome"), F.lit("invalid_output")))
        .alias("failure"),
    )


def citations(sources: Column, kept: Column) -> Column:
    """The passages cited by 1-based number, each (source, snippet) once, in citation order.

    Numbers outside the list are dropped; when none is left, every passage is cited.
    ``kept`` is the array of (rank, source, text, ...) in rank order.
    """

    def cited(passage: Column) -> Column:
        return F.struct(passage["source"].alias("source"), snippet(passage["text"]).alias("snippet"))

    known = F.filter(F.coalesce(sources, F.array().cast("array<bigint>")), lambda i: i.between(1, F.size(kept)))
    chosen = F.transform(known, lambda i: cited(F.element_at(kept, i.cast("int"))))
    everything = F.transform(kept, cited)
    return F.array_distinct(F.when(F.size(known) > 0, chosen).otherwise(everything))


def with_groundedness(
    answers: DataFrame, answer: str, contexts: str, support: float = MIN_GROUNDEDNESS
) -> DataFrame:
    """Add ``unsupported`` sentences and ``groundedness``, the share of supported ones.

    A sentence is supported when enough of its content words, and all of its numbers, occur
    in the contexts (an array of texts). Without contexts or sentences the share is 0.
    """
    joined = F.array_join(contexts, " ")
    # Only what the answer itself says can matter: its words are split once into those the
    # contexts know and those they do not, and sentences are compared with the shorter list.
    words_of = {
        "_sentences": sentences(F.coalesce(F.col(answer), F.lit(""))),
        "_words": content_words(F.col(answer)),
        "_context_words": content_words(joined),
        "_unknown_figures": F.array_except(numbers(F.col(answer)), numbers(joined)),
        "_no_context": F.coalesce(F.size(F.col(contexts)) <= 0, F.lit(True)),
    }
    said = answers.withColumns(words_of).withColumn("_unknown", F.array_except("_words", "_context_words"))
    said = said.withColumn("_mostly_known", F.size("_unknown") * 2 < F.size("_words")).withColumn(
        "_shorter",
        F.when(F.col("_mostly_known"), F.col("_unknown")).otherwise(F.array_except("_words", "_unknown")),
    )

    def lacks_support(sentence: Column) -> Column:
        def too_few(words: Column) -> Column:
            listed = F.size(F.array_intersect(words, F.col("_shorter")))
            shared = F.when(F.col("_mostly_known"), F.size(words) - listed).otherwise(listed)
            overlap = F.try_divide(shared.cast("double"), F.size(words).cast("double"))
            return F.coalesce(overlap, F.lit(1.0)) < support

        strange = F.size(F.array_intersect(numbers(sentence), F.col("_unknown_figures"))) > 0
        return strange | bind(content_words(sentence), too_few)

    unsupported = F.when(F.col("_no_context"), F.col("_sentences")).otherwise(
        F.filter("_sentences", lacks_support)
    )
    graded = said.withColumn("unsupported", unsupported).withColumn("n_sentences", F.size("_sentences"))
    share = ratio(F.col("n_sentences") - F.size("unsupported"), F.col("n_sentences"))
    return graded.withColumn("groundedness", share).drop(
        *words_of, "_unknown", "_mostly_known", "_shorter"
    )


def uncertainty_reasons(confidence: Column, best_relevance: Column, grounding: Column) -> Column:
    """Which of the three signals are weak; no relevance at all counts as weak."""
    return reasons(
        ("low_confidence", confidence < UNCERTAIN_CONFIDENCE),
        ("weak_retrieval", F.coalesce(best_relevance < UNCERTAIN_RELEVANCE, F.lit(True))),
        ("weak_grounding", grounding < MIN_GROUNDEDNESS),
    )


def uncertainty_level(found: Column) -> Column:
    count = F.size(found)
    return F.when(count == 0, F.lit("low")).when(count == 1, F.lit("medium")).otherwise(F.lit("high"))


def gather_passages(hits: DataFrame, passages: DataFrame) -> DataFrame:
    """Per query the passages that cleared the floor, at most k, as an array in rank order."""
    texts = hits.join(passages, "chunk_id")
    ordered = F.sort_array(F.collect_list(F.struct("rank", "source", "text", "relevance")))
    return texts.groupBy("qid").agg(ordered.alias("kept"))


def assemble(screened: DataFrame, retrieved: DataFrame, resolved: DataFrame, keys: list[str], retrieval_key: str) -> DataFrame:
    """The final answer of every question.

    ``screened`` comes from ``screen_questions``, ``retrieved`` from ``gather_passages`` and
    ``resolved`` from ``resolve_outputs``. The first stage that declines decides the reason:
    the screening verdict, no_relevant_context, provider_error, invalid_output,
    low_confidence; otherwise the question is answered. A request with no attempt on record
    never reached a model.
    """
    empty = F.array().cast("array<struct<rank:int,source:string,text:string,relevance:double>>")
    # Refused questions carry no passages. Their keys are replaced by negative ones that match
    # nothing and differ, so that they do not gather in one task as equal or null keys would.
    apart = -1 - F.pmod(F.xxhash64(*keys), F.lit(1 << 31))
    joined = (
        screened.withColumn(
            retrieval_key, F.when(F.col("allowed") & F.col(retrieval_key).isNotNull(), F.col(retrieval_key)).otherwise(apart)
        )
        .join(retrieved.withColumnRenamed("qid", retrieval_key), retrieval_key, "left")
        .join(resolved, keys, "left")
        .withColumn("kept", F.coalesce(F.col("kept"), empty))
    )
    confidence = clamp(F.col("raw_confidence"), 0.0, 1.0)
    reason = (
        F.when(~F.col("allowed"), F.col("reason"))
        .when(F.size("kept") == 0, F.lit("no_relevant_context"))
        .when(F.col("attempts").isNull(), F.lit("provider_error"))
        .when(F.col("failure").isNotNull(), F.col("failure"))
        .when(confidence < MIN_CONFIDENCE, F.lit("low_confidence"))
        .otherwise(F.lit("answered"))
    )
    decided = joined.withColumn("outcome", reason)
    answered = F.col("outcome") == "answered"
    audited = with_groundedness(
        decided.withColumns(
            {
                "_said": F.when(answered, F.col("answer")),
                "_contexts": F.when(answered, F.transform("kept", lambda p: p["text"])),
            }
        ),
        "_said",
        "_contexts",
    )
    best = F.element_at(F.col("kept"), 1)["relevance"]
    doubts = F.when(
        answered, uncertainty_reasons(confidence, F.when(F.size("kept") > 0, best), F.col("groundedness"))
    ).otherwise(F.array(F.col("outcome")))
    level = F.when(answered, uncertainty_level(F.col("uncertainty_reasons"))).otherwise(F.lit("high"))
    no_citations = F.array().cast("array<struct<source:string,snippet:string>>")
    message = F.when(F.col("allowed"), _lookup(REFUSAL_TEXT, F.col("outcome"))).otherwise(F.col("message"))
    return audited.withColumn("uncertainty_reasons", doubts).withColumn("uncertainty_level", level).select(
        *keys,
        "query",
        F.when(answered, F.col("answer")).otherwise(message).alias("answer"),
        F.when(answered, citations(F.col("sources"), F.col("kept"))).otherwise(no_citations).alias("citations"),
        F.when(F.col("outcome").isin("answered", "low_confidence"), confidence).otherwise(F.lit(0.0)).alias("confidence"),
        (~answered).alias("refused"),
        F.when(~answered, F.col("outcome")).alias("refusal_reason"),
        "outcome",
        "uncertainty_level",
        "uncertainty_reasons",
        F.when(answered, _lookup(DISCLOSURE, F.col("uncertainty_level"))).otherwise(F.lit("")).alias("uncertainty_note"),
        F.when(answered, F.col("groundedness")).otherwise(F.lit(0.0)).alias("groundedness"),
        F.transform("kept", lambda p: p["relevance"]).alias("relevance_scores"),
        F.transform("kept", lambda p: p["source"]).alias("context_sources"),
    )


def outcome_totals(answers: DataFrame) -> DataFrame:
    """Answers by outcome and uncertainty level, with mean scores."""
    return answers.groupBy("outcome", "uncertainty_level").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if("refused").alias("n_refused"),
        F.avg("groundedness").alias("mean_groundedness"),
        F.avg("confidence").alias("mean_confidence"),
        F.avg(F.coalesce(F.try_element_at("relevance_scores", F.lit(1)), F.lit(0.0))).alias("mean_best_relevance"),
    )
