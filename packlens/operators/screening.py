"""Screening of question tables before anything is retrieved."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from packlens.functions.screening import (
    INJECTION_FAMILIES,
    PERSONAL_DATA,
    injection_hits,
    injection_score,
    intent,
    scrub,
)
from packlens.functions.text import estimate_tokens, is_blank
from packlens.settings import INJECTION_THRESHOLD, MAX_INPUT_TOKENS

# What a refused caller reads.
MESSAGES = {
    "empty": "Ask a question.",
    "prompt_injection": (
        "That request looks like an attempt to change how this assistant works. "
        "Ask a question about the battery documentation instead."
    ),
    "out_of_scope": (
        "This assistant only answers from the indexed battery energy-storage "
        "documentation, and that question is outside it."
    ),
}


def screen_questions(
    questions: DataFrame,
    text: str = "question",
    max_tokens: int = MAX_INPUT_TOKENS,
    threshold: float = INJECTION_THRESHOLD,
    router: bool = True,
) -> DataFrame:
    """Add the verdict on each question; the first rule that applies decides.

    empty, too_long, prompt_injection, out_of_scope, ok. ``query`` is what may be logged and
    passed on: cut when too long, hidden on injection, scrubbed when allowed.
    """
    column = F.col(text)
    counted = questions.withColumns(
        {
            "_tokens": estimate_tokens(column),
            "_blank": is_blank(column),
            "_hits": injection_hits(column),
            "_intent": intent(column),
        }
    ).withColumn("_score", injection_score(F.col("_hits")))
    reason = (
        F.when(F.col("_blank"), F.lit("empty"))
        .when(F.col("_tokens") > max_tokens, F.lit("too_long"))
        .when(F.col("_score") >= threshold, F.lit("prompt_injection"))
        .when((F.col("_intent") == "out_of_scope") & F.lit(router), F.lit("out_of_scope"))
        .otherwise(F.lit("ok"))
    )
    judged = counted.withColumn("reason", reason)
    allowed = F.col("reason") == "ok"
    scrubbed = scrub(judged.withColumn("_allowed_text", F.when(allowed, column)), "_allowed_text", "scrubbed")
    none = F.array().cast("array<string>")
    scored = F.col("reason").isin("prompt_injection", "ok")
    too_long = F.concat(
        F.lit("That question is "),
        F.col("_tokens").cast("string"),
        F.lit(f" tokens; the limit is {max_tokens}. Please shorten it."),
    )
    return scrubbed.withColumns(
        {
            "allowed": allowed,
            "message": F.when(F.col("reason") == "too_long", too_long)
            .when(allowed, F.lit(""))
            .otherwise(F.element_at(F.create_map(*[F.lit(x) for kv in MESSAGES.items() for x in kv]), F.col("reason"))),
            "query": F.when(allowed, F.col("scrubbed_text"))
            .when(F.col("reason") == "too_long", F.substring(column, 1, 200))
            .when(F.col("reason") == "prompt_injection", F.lit("[REDACTED]"))
            .otherwise(column),
            "intent": F.when(F.col("reason").isin("out_of_scope", "ok"), F.col("_intent")).otherwise(F.lit("unknown")),
            "injection_score": F.when(scored, F.col("_score")).otherwise(F.lit(0.0)),
            "injection_patterns": F.when(scored, F.transform("_hits", lambda h: h["name"])).otherwise(none),
            "estimated_tokens": F.when(F.col("_blank"), F.lit(0).cast("bigint")).otherwise(F.col("_tokens")),
            "pii_labels": F.when(allowed, F.col("scrubbed_labels")).otherwise(none),
        }
    ).drop(
        "_tokens", "_blank", "_hits", "_intent", "_score", "_allowed_text",
        "scrubbed_text", "scrubbed_labels", "scrubbed_hits",
    )


def injection_totals(texts: DataFrame, text: str, by: list[str]) -> DataFrame:
    """Hits per injection family and ``by``; families without a hit are left out."""
    found = texts.select(*by, F.transform(injection_hits(F.col(text)), lambda h: h["name"]).alias("names"))
    counts = found.groupBy(*by).agg(
        *[F.count_if(F.array_contains("names", name)).alias(name) for name, *_ in INJECTION_FAMILIES]
    )
    lines = [
        F.struct(F.lit(name).alias("family"), F.col(name).alias("n"), F.lit(weight).alias("weight"))
        for name, _, weight, *_ in INJECTION_FAMILIES
    ]
    return counts.select(*by, F.explode(F.array(*lines)).alias("line")).select(*by, "line.*").where(F.col("n") > 0)


def intent_totals(texts: DataFrame, text: str, by: list[str]) -> DataFrame:
    return texts.groupBy(*by, intent(F.col(text)).alias("intent")).agg(F.count(F.lit(1)).alias("n"))


def personal_data_totals(texts: DataFrame, text: str, by: list[str]) -> DataFrame:
    """Texts with, and occurrences of, each label per ``by``."""
    labels = [label for label, _ in PERSONAL_DATA]
    hits = {label: F.element_at("pii_hits", F.lit(label)) for label in labels}
    counts = scrub(texts, text).select(*by, "pii_hits").groupBy(*by).agg(
        *[F.count_if(n > 0).alias(f"texts_{label}") for label, n in hits.items()],
        *[F.sum(n).alias(f"hits_{label}") for label, n in hits.items()],
    )
    lines = [
        F.struct(F.lit(x).alias("label"), F.col(f"texts_{x}").alias("n_texts"), F.col(f"hits_{x}").alias("n_hits"))
        for x in labels
    ]
    return counts.select(*by, F.explode(F.array(*lines)).alias("line")).select(*by, "line.*")
