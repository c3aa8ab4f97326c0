"""Detection and redaction of personal data by fixed patterns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The patterns, which Java, Python and RE2 read alike.
PATTERNS = {
    "email": r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b",
    "phone": r"\b(?:\+?1[-.]?)?\(?\d{3}\)?[-.]?\d{3}[-.]?\d{4}\b",
    "ssn": r"\b\d{3}-\d{2}-\d{4}\b",
    "credit_card": r"\b\d{4}[-\s]?\d{4}[-\s]?\d{4}[-\s]?\d{4}\b",
    "ip_address": r"\b(?:\d{1,3}\.){3}\d{1,3}\b",
}
#: Kinds that are redacted, in this order, and what stands in their place.
REDACTED = {"email": "EMAIL", "phone": "PHONE", "ssn": "SSN", "credit_card": "CARD"}


def matches(text: Column, kind: str) -> Column:
    return F.regexp_extract_all(text, F.lit(PATTERNS[kind]), F.lit(0))


def counts(text: Column) -> dict[str, Column]:
    return {kind: F.size(matches(text, kind)).cast("long") for kind in PATTERNS}


def has_any(text: Column) -> Column:
    found = F.lit(False)
    for pattern in PATTERNS.values():
        found = found | text.rlike(pattern)
    return found


def redact(text: Column, placeholder: str = "[REDACTED]") -> Column:
    for kind, label in REDACTED.items():
        text = F.regexp_replace(text, PATTERNS[kind], f"{placeholder}:{label}")
    return text
