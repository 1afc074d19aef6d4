"""Personal data in texts: fixed patterns, and candidates selected by boosted trees.

The base kinds are exact patterns and always stay. Beyond them, generators with high recall propose
spans, which may overlap: phone numbers without a plus sign, spelled-out mail addresses, account
and identity numbers, IPv6 addresses, long numbers. Each candidate is described by its format
(digits, groups, separators, check sums) and its context (words before it, characters at its
borders), and boosted trees give it a probability. Those at or above a calibrated threshold are
taken, the likeliest first, unless they overlap a span already taken.

The trees are trained on labelled examples drawn from a seeded generator of formats, with and without
a word that names them, set into words of a bounded sample of the documents (``SAMPLE_TEXTS`` texts,
``SAMPLE_CHARS`` characters of each). Candidates found in that sample itself teach nothing: what they
are is not known.

Null and empty texts have no spans. Repeated rows have the same spans. Time is in proportion to a text's
length and the logarithm of the number of its spans.
"""

from __future__ import annotations

import re
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from packlens.functions.text import few_at_once
from packlens.llm.boost import Boosted, fit

#: The base kinds, in the order in which spans are listed.
BASE = ("email", "ip", "card", "phone")
#: Kinds that the model adds.
ADDED = ("phone_plain", "email_spelled", "iban", "national_id", "ip6", "number")
#: Texts drawn for the training contexts, and the characters taken of each.
SAMPLE_TEXTS = 400
SAMPLE_CHARS = 4000
CONTEXT = 32

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")

_GENERATORS = {
    "phone_plain": re.compile(r"(?<![0-9A-Za-z+])(?:\([0-9]{2,4}\)|[0-9]{2,4})[ .-]?[0-9]{2,4}(?:[ .-][0-9]{2,4}){1,3}(?![0-9A-Za-z])"),
    "iban": re.compile(r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![0-9A-Za-z])"),
    "national_id": re.compile(r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])"),
    "ip6": re.compile(r"(?<![0-9A-Za-z:])[0-9A-Fa-f]{1,4}(?::{1,2}[0-9A-Fa-f]{1,4}){3,7}(?![0-9A-Za-z:])"),
    "number": re.compile(r"(?<![0-9A-Za-z])[0-9](?:[ -]?[0-9]){8,18}(?![0-9A-Za-z])"),
}
_SPELLED = re.compile(
    r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64} ?(?:\(at\)|\[at\]| at ) ?[A-Za-z0-9-]{1,63}(?: ?(?:\(dot\)|\[dot\]| dot ) ?[A-Za-z0-9-]{1,63}){1,4}"
)
_SPELLED_MARKS = ("(at)", "[at]", " dot ", "(dot)", "[dot]")
_HINTS = {
    "phone": ("phone", "tel", "call", "fax", "mobile", "whatsapp", "dial"),
    "bank": ("iban", "account", "konto", "bank", "compte", "cuenta"),
    "identity": ("ssn", "social", "security", "passport", "identity", "tax"),
    "mail": ("mail", "contact", "write", "reach", "e-mail"),
    "net": ("ip", "host", "address", "server", "login"),
    "against": ("version", "order", "invoice", "ref", "page", "total", "id", "token", "date", "license", "isbn"),
}


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost non-overlapping addresses; each @ is looked at once, so a text costs linear time."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            yield start, found.end()
            end = found.end()
        at = text.find("@", max(at + 1, end))


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        n = ord(c) - 48
        if k % 2:
            n = n * 2 - 9 if n > 4 else n * 2
        total += n
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of the base kinds, by kind and start. Matches that fail a kind's test are dropped, not retried."""
    out = [("email", s, e) for s, e in emails(text)]
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(p := part.lstrip("0")) <= 3 and int(p or "0") <= 255 for part in m[0].split(".")):
                out.append(("ip", *m.span()))
        for m in _CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", *m.span()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 9 <= len(_DIGIT.findall(m[0])) <= 15:
                    out.append(("phone", *m.span()))
    return out


def candidates(text: str) -> list[tuple[str, int, int]]:
    """Everything the generators propose; spans may overlap, one span may come from several."""
    out = []
    if _DIGIT.search(text):
        out = [(kind, *m.span()) for kind, p in _GENERATORS.items() for m in p.finditer(text)]
    if any(mark in text for mark in _SPELLED_MARKS):
        out += [("email_spelled", *m.span()) for m in _SPELLED.finditer(text)]
    return out


def described(text: str, kind: str, start: int, end: int) -> list[float]:
    """Format and context of a candidate as numbers."""
    span = text[start:end]
    digits = "".join(c for c in span if c in "0123456789")
    groups = [g for g in re.split(r"[^0-9A-Za-z]+", span) if g]
    before = text[max(0, start - CONTEXT) : start].lower()
    near = re.findall(r"[a-z-]+", before)
    plain = re.sub(r"[^0-9A-Za-z]", "", span)
    return [
        *(float(kind == k) for k in ADDED),
        float(len(span)), float(len(digits)), len(digits) / max(1, len(span)), float(len(groups)),
        float(len(groups[0]) if groups else 0), float(len(groups[-1]) if groups else 0),
        float(max((len(g) for g in groups), default=0)), float(min((len(g) for g in groups), default=0)),
        float(span.count("-")), float(span.count(" ")), float(span.count(".")), float(span.count(":")), float("(" in span),
        float(bool(digits) and luhn(digits)), float(kind == "iban" and _mod97(plain)),
        float(len(set(digits)) / max(1, len(digits))),
        *(float(any(h in near for h in hints)) for hints in _HINTS.values()),
        float(start > 0 and not text[start - 1].isspace()), float(end < len(text) and not text[end].isspace()),
        float(bool(re.search(r"[$#=/\"']\s*$", before))), float("[" in span or "(at" in span or "(dot" in span),
    ]


def _mod97(account: str) -> bool:
    turned = account[4:] + account[:4]
    return turned.isalnum() and turned.isascii() and int("".join(str(int(c, 36)) for c in turned)) % 97 == 1


def _example(rng: np.random.Generator) -> tuple[str, str, str | None]:
    """(hint, text, kind) of one drawn format; no kind for numbers that are no personal data."""
    d = lambda n: "".join(map(str, rng.integers(0, 10, n)))
    pick = lambda *a: a[int(rng.integers(len(a)))]
    hint = lambda kind: pick(*_HINTS[kind]) + pick(" ", ": ", " is ") if rng.random() < 0.7 else ""
    word = lambda: pick("ada", "grace", "j.smith", "info", "mail7", "office", "example", "north")
    which = int(rng.integers(12))
    if which == 0:
        return hint("phone"), f"({d(3)}) {d(3)}-{d(4)}", "phone_plain"
    if which == 1:
        return hint("phone"), pick(f"{d(3)}-{d(3)}-{d(4)}", f"{d(3)} {d(3)} {d(4)}", f"{d(3)}.{d(3)}.{d(4)}", f"0{d(2)} {d(4)} {d(4)}"), "phone_plain"
    if which == 2:
        at, dot = pick((" (at) ", " (dot) "), ("[at]", "[dot]"), (" at ", " dot "))
        return hint("mail"), f"{word()}{at}{word()}{dot}com", "email_spelled"
    if which == 3:
        land, body = pick("DE", "FR", "ES", "GB"), d(18)
        check = 98 - int("".join(str(int(c, 36)) for c in body + land + "00")) % 97
        whole = f"{land}{check:02d}{body}"
        return hint("bank"), pick(whole, " ".join(whole[i : i + 4] for i in range(0, len(whole), 4))), "iban"
    if which == 4:
        return hint("identity"), f"{rng.integers(100, 899)}-{rng.integers(10, 99)}-{d(4)}", "national_id"
    if which == 5:
        return hint("net"), ":".join(f"{x:x}" for x in rng.integers(0, 65536, 8)), "ip6"
    if which == 6:
        if rng.random() < 0.5:
            return pick("account", "konto", "compte", "cuenta", "bank", "passport", "tax") + pick(" ", ": ", " no "), d(int(rng.integers(9, 19))), "number"
        return hint("against") if rng.random() < 0.5 else "", d(int(rng.integers(9, 20))), None
    if which == 7:
        return hint("against"), f"{rng.integers(1990, 2030)}-{rng.integers(10, 13)}-{rng.integers(10, 29)} {rng.integers(10, 24)}", None
    if which == 8:
        return hint("against"), f"{d(2)}.{d(2)}.{d(3)}", None
    if which == 9:
        return "", f"{d(2)}:{d(2)}:{d(2)}:{d(2)}", None
    if which == 10:
        return hint("against"), pick(f"{d(3)} {d(3)} {d(3)}", f"{d(2)}-{d(3)}-{d(4)}", f"{d(4)} {d(4)} {d(4)} {d(3)}"), None
    return "", f"{pick('GB', 'XX')}{d(2)} {d(4)} {d(4)}", None


def train(docs: DataFrame, *, key: str = "doc_id", text: str = "text", examples: int = 3000, seed: int = 2) -> Boosted:
    """Trees fitted to drawn formats in contexts of a bounded sample of the texts. The same rows give the same trees."""
    named = docs.filter(F.col(key).isNotNull())
    # A hash limit leaves about twice the sample in all, so each task sends the driver next to nothing.
    limit = int((1 << 30) * min(1.0, (2 * SAMPLE_TEXTS + 100) / max(1, named.count())))
    drawn = (
        named.withColumn("_h", F.pmod(F.xxhash64(key), F.lit(1 << 30))).filter((F.col("_h") < limit) & F.col(text).isNotNull())
        .select(F.col("_h").alias("h"), F.col(key).alias("k"), F.substring(text, 1, SAMPLE_CHARS).alias("t"))
        .orderBy("h", "k", "t").limit(SAMPLE_TEXTS).select("t").collect()
    )
    texts = [r["t"] for r in drawn] or ["the and of"]
    words = [w for t in texts for w in t.split()] or ["the"]
    rng = np.random.default_rng(seed)
    x, y = [], []
    for _ in range(examples):
        hint, span, wanted = _example(rng)
        at = int(rng.integers(len(words)))
        before, after = " ".join(words[at : at + 6]), " ".join(words[at + 6 : at + 10])
        whole = f"{before} {hint}{span} {after}"
        start = len(before) + 1 + len(hint)
        for kind, s, e in candidates(whole):
            if s < start + len(span) and e > start:
                x.append(described(whole, kind, s, e))
                y.append(float(kind == wanted and s == start and e == start + len(span)))
    return fit(np.array(x), np.array(y))


class Taken:
    """Stretches of a text that do not overlap, in order."""

    def __init__(self) -> None:
        self.held: list[tuple[int, int]] = []

    def meets(self, start: int, end: int) -> bool:
        at = bisect_left(self.held, (end,)) - 1
        return at >= 0 and self.held[at][1] > start

    def add(self, start: int, end: int) -> None:
        insort(self.held, (start, end))

    def widen(self, start: int, end: int) -> None:
        """Adds a stretch that begins at or after the last one; overlapping ones become one."""
        if self.held and start < self.held[-1][1]:
            self.held[-1] = (self.held[-1][0], max(end, self.held[-1][1]))
        else:
            self.held.append((start, end))


def all_spans(text: str | None, model: Boosted) -> list[tuple[str, int, int, float, bool]]:
    """(kind, start, end, probability, base) of a text, by kind, then start. Empty for a null text."""
    if not text:
        return []
    base = base_spans(text)
    out = [(*s, 1.0, True) for s in base]
    fixed = Taken()
    for _, s, e in sorted(base, key=lambda b: (b[1], -b[2])):
        fixed.widen(s, e)
    found = [c for c in candidates(text) if not fixed.meets(c[1], c[2])]
    if found:
        p = model.probability(np.array([described(text, *c) for c in found]))
        taken = Taken()
        for i in sorted(range(len(found)), key=lambda i: (-p[i], found[i][1], -found[i][2])):
            kind, s, e = found[i]
            if p[i] >= model.threshold and not taken.meets(s, e):
                taken.add(s, e)
                out.append((kind, s, e, float(p[i]), False))
    order = {k: i for i, k in enumerate((*BASE, *ADDED))}
    return sorted(out, key=lambda s: (order[s[0]], s[1]))


def redacted(text: str, spans: list[tuple[str, int, int, float, bool]]) -> str:
    """The text with each span replaced by its kind in brackets; of overlapping spans one mark remains."""
    out, end = [], 0
    for kind, s, e, _, _ in sorted(spans, key=lambda s: (s[1], -s[2])):
        if s >= end:
            out += [text[end:s], f"[{kind.upper()}]"]
        end = max(end, e)
    return "".join([*out, text[end:]])


SPANS = "array<struct<kind:string,start:int,end:int,score:double,base:boolean>>"


def found_in(batches: Iterator[pd.Series], trees: Boosted) -> Iterator[pd.DataFrame]:
    """Spans and redacted text of each text of the batches; those of a few texts are held at once."""
    for batch in batches:
        for texts in few_at_once(batch):
            spans = [all_spans(t if isinstance(t, str) else None, trees) for t in texts]
            yield pd.DataFrame({
                "spans": [[dict(zip(("kind", "start", "end", "score", "base"), s, strict=True)) for s in row] for row in spans],
                "redacted": [redacted(t, row) if row else None for t, row in zip(texts, spans, strict=True)],
            })


def find(spark: SparkSession, model: Boosted, text: Column) -> Column:
    """Struct (spans, redacted) of a text; ``redacted`` is null where nothing was found."""
    shared = spark.sparkContext.broadcast(model)

    def found(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        yield from found_in(batches, shared.value)

    return F.pandas_udf(found, f"spans {SPANS}, redacted string").asNondeterministic()(text)
