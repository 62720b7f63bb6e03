"""Text functions as Spark column expressions.

Patterns with explicit ranges are ASCII on purpose; where letters of any script
count, the pattern carries the ``(?U)`` flag.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evidentia import tables

# Patterns that decide results.
NUMBER = r"\d[\d,._]*\d|\d"
TOKEN = r"[A-Za-z][A-Za-z0-9_-]{3,}"
EMBED_TOKEN = r"[A-Za-z0-9_%-]{2,}"
SUBJECT = (
    r"(?i)^(?:the\s+|our\s+|a\s+|an\s+)?([A-Za-z0-9][A-Za-z0-9 _./+-]{1,60}?)"
    r"\s+(?:is|are|was|were|reaches|reached|achieves|achieved|uses|used|contains|contained"
    r"|outperforms|improves|reports|shows|provides)\b"
)
VALUE = r"\d+(?:[.,]\d+)?\s*%?"
HYPOTHESIS = (
    r"(?i)\b(hypothes(?:is|ize|es|ized)|we expect|we aim to|we propose to|if .* then"
    r"|we conjecture|it remains to be seen)\b"
)
COMPARATIVE = (
    r"(?i)\b(outperform\w*|beat\w*|surpass\w*|better than|exceed\w*|improv\w* over"
    r"|superior to|state[- ]of[- ]the[- ]art)\b"
)
BUDGET_DISPARITY = (
    r"(?i)\b(\d+\s*(?:×|x)\s*(?:more|larger|bigger|compute|budget))\b"
    r"|\b(\d+\s*(?:GPUs?|A100s?|H100s?|V100s?))\b"
    r"|\b(budget mismatch|unequal (?:training )?(?:budget|compute))\b"
    r"|\b(\d+\s*×\s*\d+\s*(?:epochs?|steps?))\b"
)
NOVELTY = r"(?i)\b(novel|novelty|first|unprecedented|new method|new approach)\b"
REFUSAL = (
    r"(?i)\b(i cannot|i can't|i'm unable to|as an ai language model|i'm sorry, but"
    r"|i apologize, but|cannot assist|cannot help)\b"
)
FAILURE_WORDS = ("fails", "failed", "does not ", "no improvement", "unable to")
SECRETS = (
    (r"sk-[A-Za-z0-9_\-]{8,}", "[REDACTED_API_KEY]"),
    (r"(?i)bearer\s+[A-Za-z0-9._\-]{8,}", "Bearer [REDACTED]"),
    (
        r"(?i)(api[_-]?key|token|password|secret)\"?\s*[:=]\s*\"?[^\s\",}]{4,}",
        "$1: [REDACTED]",
    ),
)
SENSITIVE_KEYS = (
    "api_key",
    "apikey",
    "authorization",
    "headers",
    "token",
    "password",
    "secret",
    "credentials",
    "env",
    "request_headers",
)
SENSITIVE_MARKERS = [
    "apikey",
    "secret",
    "password",
    "credential",
    "authorization",
    "cookie",
    "accesstoken",
    "refreshtoken",
    "accesskey",
    "csrftoken",
]


def all_matches(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def statement_numbers(text: Column) -> Column:
    """Distinct numeric literals without thousands separators, sorted."""
    raw = all_matches(text, NUMBER)
    cleaned = F.transform(raw, lambda v: F.regexp_replace(F.replace(v, F.lit(",")), r"\.+$", ""))
    return F.array_sort(F.array_distinct(cleaned))


def significant_tokens(text: Column) -> Column:
    """Distinct lower-case words of four or more characters, no stop words, sorted."""
    words = F.transform(all_matches(text, TOKEN), F.lower)
    stop = F.array(*[F.lit(w) for w in tables.STOP_WORDS])
    return F.array_sort(F.array_except(words, stop))


def claim_subject(statement: Column) -> Column:
    """Subject phrase before the claim's verb, or null."""
    phrase = F.regexp_extract(F.trim(statement), SUBJECT, 1)
    phrase = F.regexp_replace(phrase, r"^[ .,:;]+|[ .,:;]+$", "")
    return F.nullif(phrase, F.lit(""))


def metric_phrase(statement: Column) -> Column:
    """Up to four words that follow the first number, else the first 60 characters."""
    head = F.substring(statement, 1, 60)
    first = F.regexp_extract(statement, f"({VALUE})", 1)
    tail = F.substr(statement, F.instr(statement, first) + F.length(first))
    tail = F.regexp_replace(tail, r"^[ ,.;:]+|[ ,.;:]+$", "")
    words = F.slice(F.split(F.trim(F.regexp_replace(tail, r"\s+", " ")), " "), 1, 4)
    return F.when(first == "", head).otherwise(
        F.coalesce(F.nullif(F.array_join(words, " "), F.lit("")), head)
    )


def one_character_apart(a: Column, b: Column) -> Column:
    """Same length and exactly one differing character."""
    return (F.length(a) == F.length(b)) & (F.levenshtein(a, b) == 1)


def category_namespace(category: Column) -> Column:
    return F.substring_index(category, ".", 1)


def first_prefix(category: Column, table: tuple[tuple[str, str], ...]) -> Column:
    """Value of the first prefix in ``table`` that ``category`` starts with."""
    out = F.lit(None).cast("string")
    for prefix, value in reversed(table):
        out = F.when(category.startswith(prefix), value).otherwise(out)
    return out


def entity_type_for(category: Column) -> Column:
    return first_prefix(category, tables.CATEGORY_ENTITY)


def relation_for(category: Column) -> Column:
    return F.coalesce(first_prefix(category, tables.CATEGORY_RELATION), F.lit("RELATED_TO"))


def unit_quality(method: Column, confidence: Column) -> Column:
    """OCR text without a confidence of at least 0.6 is degraded."""
    weak = (method == "OCR") & (confidence.isNull() | (confidence < 0.6))
    return F.when(weak, "DEGRADED").otherwise("GOOD")


@F.pandas_udf(T.StringType())
def nfkc_casefold(text: pd.Series) -> pd.Series:
    """Compatibility composition and full case folding; Spark has no builtin."""
    return text.map(lambda s: None if s is None else unicodedata.normalize("NFKC", s).casefold())


@F.pandas_udf(T.StringType())
def casefold(text: pd.Series) -> pd.Series:
    return text.map(lambda s: None if s is None else s.casefold())


def squeeze(text: Column) -> Column:
    """Runs of white space become one space; ends are trimmed."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def normalize_title(title: Column) -> Column:
    return squeeze(F.regexp_replace(nfkc_casefold(title), r"(?U)[^\w\s]", " "))


def normalize_tag(name: Column) -> Column:
    value = F.regexp_replace(casefold(F.trim(name)), r"(?U)[^\w\s-]", " ")
    value = F.regexp_replace(value, r"(?U)[\s_/\\]+", "-")
    return F.regexp_replace(F.regexp_replace(value, "-{2,}", "-"), "^-+|-+$", "")


def normalize_entity(name: Column) -> Column:
    """Letters a-z and digits kept, everything else a single space."""
    return F.trim(F.regexp_replace(casefold(F.trim(name)), "[^a-z0-9]+", " "))


def normalize_statement(statement: Column) -> Column:
    return squeeze(F.lower(statement))


def redact(text: Column) -> Column:
    for pattern, replacement in SECRETS:
        text = F.regexp_replace(text, pattern, replacement)
    return text


def is_sensitive_key(key: Column) -> Column:
    flat = F.regexp_replace(F.lower(key), "[^a-z0-9]", "")
    return F.lower(key).isin(*SENSITIVE_KEYS) | flat.rlike("|".join(SENSITIVE_MARKERS))


def redact_map(data: Column) -> Column:
    return F.transform_values(
        data, lambda k, v: F.when(is_sensitive_key(k), "[REDACTED]").otherwise(redact(v))
    )


def short_hash(*parts: Column, length: int = 16) -> Column:
    return F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, length)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity in double precision; null for a missing or zero vector."""

    def dot(x: Column, y: Column) -> Column:
        products = F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double"))
        return F.aggregate(products, F.lit(0.0), lambda acc, v: acc + v)

    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return dot(a, b) / F.nullif(norms, F.lit(0.0))


def observed_state(value: Column, samples: Column, observed_at: Column, now: Column) -> Column:
    """UNKNOWN without data, STALE when undated or over 300 s old, else FRESH."""
    age = F.unix_micros(now) - F.unix_micros(observed_at)
    return (
        F.when(value.isNull() | (samples == 0), "UNKNOWN")
        .when(observed_at.isNull() | (age > 300 * 1_000_000), "STALE")
        .otherwise("FRESH")
    )
