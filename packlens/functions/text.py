"""Text column expressions: blanks, tokens, sentences, words, snippets."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, functions as F

from packlens.settings import SNIPPET_CHARS

# Words that carry no evidence.
STOPWORDS = (
    "the a an and or but if then than that this these those is are was were be been being "
    "it its of in on at to for from by with as not no nor so such can could may might must "
    "will would shall should do does did have has had which who whom what when where why how "
    "there here also very more most much many some any each per about into over under"
).split()

# How sentences, words and numbers are recognised.
SENTENCE_BREAK = r"(?U)(?<=[.!?])\s+"
WORD = r"[a-z][a-z\-]+"
NUMBER = r"(?U)\d+(?:[.,]\d+)?"


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once, also inside a higher-order function."""
    return F.element_at(F.transform(F.array(value), use), 1)


def word_list(words: Iterable[str]) -> Column:
    """A constant array of words without blanks, folded by the optimizer."""
    return F.split(F.lit(" ".join(words)), " ")


def is_blank(text: Column) -> Column:
    """Nothing but whitespace of any kind; null is blank too."""
    return ~F.coalesce(text, F.lit("")).rlike(r"(?U)\S")


def estimate_tokens(text: Column) -> Column:
    """Larger of a quarter of the characters and the number of words."""
    quarter = F.floor(F.length(text) / 4)
    return F.greatest(quarter, F.regexp_count(text, F.lit(r"(?U)\S+")).cast("bigint"))


def collapse_whitespace(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def snippet(text: Column) -> Column:
    return F.substring(collapse_whitespace(text), 1, SNIPPET_CHARS)


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def sentences(text: Column) -> Column:
    stripped = F.transform(F.split(strip(text), SENTENCE_BREAK), strip)
    return F.filter(stripped, lambda s: s != "")


def content_words(text: Column) -> Column:
    """Distinct words of three letters or more that are not stop words."""
    words = F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))
    long = F.filter(words, lambda w: F.length(w) > 2)
    return F.array_except(long, word_list(STOPWORDS))


def numbers(text: Column) -> Column:
    """Distinct numbers as written: 1,500 and 1500 differ."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(NUMBER), F.lit(0)))


# Characters of a batch whose results are held at once.
HELD_CHARS = 1 << 20


def few_at_once(texts: pd.Series, most: int = HELD_CHARS) -> Iterator[pd.Series]:
    """Stretches of a batch of at most ``most`` characters, or of one longer text; an empty batch is one of them.

    What a function makes of a stretch leaves the task before the next one is begun.
    """
    start, held = 0, 0
    for i, text in enumerate(texts):
        size = len(text) if isinstance(text, str) else 0
        if i > start and held + size > most:
            yield texts.iloc[start:i]
            start, held = i, 0
        held += size
    yield texts.iloc[start:]
