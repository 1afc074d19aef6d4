"""Column expressions that screen a question: injection, scope, personal data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from packlens.functions.text import word_list
from packlens.settings import PHONE_DIGITS

# Fixed values: (family, pattern, weight), matched without regard to case unless the weight
# is followed by False.
INJECTION_FAMILIES = (
    (
        "instruction_override",
        r"\b(ignore|disregard|forget|override)\b[^.?!]{0,40}\b(previous|prior|above|preceding|earlier|all)\b"
        r"[^.?!]{0,20}\b(instruction|prompt|rule|direction|context)",
        0.6,
    ),
    (
        "system_prompt_exfiltration",
        r"\b(reveal|show|print|repeat|output|display|tell me)\b[^.?!]{0,30}\b(your |the )?"
        r"(system prompt|initial instruction|original instruction|system message)",
        0.6,
    ),
    (
        "repeat_everything_above",
        r"\brepeat\b[^.?!]{0,20}\b(everything|all|text)\b[^.?!]{0,20}\babove\b",
        0.6,
    ),
    (
        "role_reassignment",
        r"\b(you are now|from now on,? you|act as if you|pretend (to be|you are)|roleplay as|"
        r"new (system )?instructions?:)",
        0.5,
    ),
    (
        "guardrail_bypass",
        r"\b(without any (restrictions?|filters?|rules?|limits?)|bypass\b[^.?!]{0,20}"
        r"(guardrail|filter|restriction|safety)|no longer (bound|restricted))",
        0.5,
    ),
    ("jailbreak_persona", r"\b(DAN mode|developer mode|jailbreak|unfiltered mode)\b", 0.5),
    (
        "delimiter_smuggling",
        r"(</?(system|instructions?|im_start|im_end)>|\[/?INST\]|###\s*(system|instruction))",
        0.5,
    ),
    ("encoded_payload", r"\b[A-Za-z0-9+/]{60,}={0,2}\b", 0.4, False),
)

# Requests the service does not serve.
OUT_OF_SCOPE = (
    (
        "code_generation",
        r"\b(write|generate|create|give me|show me)\b[^.?!]{0,30}\b"
        r"(script|program|function|code|snippet|class|query|regex)\b",
    ),
    ("code_literal", r"(```|\bdef \w+\(|\bimport \w+|SELECT .+ FROM )"),
    ("translation", r"\btranslate\b[^.?!]{0,30}\b(to|into)\b\s+\w+"),
    ("chitchat", r"^\s*(hi|hello|hey|thanks|thank you|good (morning|evening)|how are you)\b"),
    ("live_data", r"\b(today'?s|current|latest|live)\b[^.?!]{0,20}\b(price|quote|weather|news|stock|rate today)"),
)

# Vocabulary of the documentation.
DOMAIN_TERMS = (
    "battery batteries cell cells bess pack module rack "
    "soh soc dod state-of-health state-of-charge capacity nameplate "
    "degradation degrade ageing aging calendar lifetime end-of-life eol stressor plating sei "
    "lithium li-ion nmc lfp electrode electrolyte anode cathode "
    "charge charging discharge discharging cycle cycles cycling "
    "c-rate crate current voltage contactor bms balancing protection estimation "
    "thermal temperature cooling coolant runaway exothermic venting deflagration fusing "
    "enclosure efficiency round-trip storage grid energy"
).split()
DOMAIN_WORD = r"[a-z0-9][a-z0-9\-]*"

# Personal data, replaced in this order.
PERSONAL_DATA = (
    ("EMAIL", r"[\w.+-]+@[\w-]+\.[\w.-]{2,}"),
    ("IBAN", r"\b[A-Z]{2}\d{2}[A-Z0-9]{10,30}\b"),
    ("IP", r"\b(?:\d{1,3}\.){3}\d{1,3}\b"),
    ("CREDIT_CARD", r"(?<![\d.])(?:\d[ -]?){13,19}(?![\d.])"),
    ("PHONE", r"(?<![\w.])\+?\d[\d\s.\-()]{7,18}\d(?![\w.])"),
)

# Unicode classes, and a dot that stops at newlines only; case folding where asked for.
_EXACT = "(?Ud)"
_FOLDED = "(?iuUd)"


def injection_hits(text: Column) -> Column:
    """Array of (name, weight) of the families found, in table order."""
    found = []
    for name, pattern, weight, *exact in INJECTION_FAMILIES:
        flags = _EXACT if exact else _FOLDED
        found.append(
            F.when(text.rlike(flags + pattern), F.struct(F.lit(name).alias("name"), F.lit(weight).alias("weight")))
        )
    return F.filter(F.array(*found), lambda h: h.isNotNull())


def injection_score(hits: Column) -> Column:
    """Sum of the weights, at most 1."""
    return F.least(F.lit(1.0), F.aggregate(hits, F.lit(0.0), lambda total, h: total + h["weight"]))


def intent(text: Column) -> Column:
    """in_domain, out_of_scope or unknown. A domain term keeps a question in scope."""
    words = F.regexp_extract_all(F.lower(text), F.lit(DOMAIN_WORD), F.lit(0))
    on_topic = F.arrays_overlap(words, word_list(DOMAIN_TERMS))
    off_topic = F.lit(False)
    for _, pattern in OUT_OF_SCOPE:
        off_topic = off_topic | text.rlike(_FOLDED + pattern)
    return F.when(on_topic, F.lit("in_domain")).when(off_topic, F.lit("out_of_scope")).otherwise(F.lit("unknown"))


def _phone_digits_ok(run: Column) -> Column:
    digits = F.length(F.regexp_replace(run, r"(?U)\D", ""))
    return digits.between(*PHONE_DIGITS)


def scrub(df: DataFrame, text: str, prefix: str = "pii") -> DataFrame:
    """Add ``<prefix>_text`` with personal data replaced, ``<prefix>_labels`` (sorted) and
    ``<prefix>_hits`` (label -> count).

    The patterns run one after another, so that a card number is gone before phone numbers
    are looked for. A phone-like run is replaced only with a plausible number of digits: the
    text is split at the runs and put together again around the replaced ones.
    """
    current = F.col(text)
    for label, pattern in PERSONAL_DATA[:-1]:
        step = f"_{prefix}_{label.lower()}"
        # A text without the character that every match needs is passed on unsearched.
        needed = F.contains(current, F.lit("@")) if label == "EMAIL" else current.rlike(r"(?U)\d")
        df = df.withColumn(
            step, F.when(needed, F.regexp_replace(current, _EXACT + pattern, f"[{label}]")).otherwise(current)
        )
        # No match is its own replacement: equal texts had none, and only the rest are counted.
        count = F.when(current == F.col(step), F.lit(0)).otherwise(F.regexp_count(current, F.lit(_EXACT + pattern)))
        df = df.withColumn(f"{step}_n", count)
        current = F.col(step)
    label, pattern = PERSONAL_DATA[-1]
    step = f"_{prefix}_{label.lower()}"
    runs = F.regexp_extract_all(current, F.lit(_EXACT + pattern), F.lit(0))
    between = F.split(current, _EXACT + pattern, -1)
    df = df.withColumns({f"{step}_runs": runs, f"{step}_between": between})
    marked = F.transform(F.col(f"{step}_runs"), lambda r: F.when(_phone_digits_ok(r), F.lit(f"[{label}]")).otherwise(r))
    df = df.withColumn(
        f"{step}_n", F.size(F.filter(F.col(f"{step}_runs"), _phone_digits_ok))
    ).withColumn(
        f"{prefix}_text",
        F.array_join(
            F.zip_with(F.col(f"{step}_between"), F.concat(marked, F.array(F.lit(""))), lambda t, r: F.concat(t, r)), ""
        ),
    )
    labels = [label for label, _ in PERSONAL_DATA]
    number = {label: F.col(f"_{prefix}_{label.lower()}_n") for label in labels}
    found = F.filter(
        F.array(*[F.when(number[label] > 0, F.lit(label)) for label in labels]), lambda x: x.isNotNull()
    )
    hits = F.map_from_arrays(
        F.array(*[F.lit(label) for label in labels]), F.array(*[number[label].cast("bigint") for label in labels])
    )
    df = df.withColumns({f"{prefix}_labels": F.sort_array(found), f"{prefix}_hits": hits})
    return df.drop(*[c for c in df.columns if c.startswith(f"_{prefix}_")])
