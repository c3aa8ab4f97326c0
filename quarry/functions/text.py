"""Text functions over columns: built-in expressions, but for Unicode normalisation and stemming."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

WHITE = r"[ \t\n\x0B\f\r]"

#: The words that name a topic.
TOPIC_KEYWORDS = [
    "meeting", "notes", "presentation", "report", "analysis", "research",
    "design", "specification", "requirements", "proposal", "review",
    "budget", "finance", "legal", "contract", "policy", "procedure",
    "technical", "documentation", "tutorial", "guide", "manual",
    "email", "correspondence", "memo", "announcement", "minutes",
]


def _column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def word_count(text: Column | str) -> Column:
    """Runs of characters other than ASCII white space; null counts as none."""
    return F.regexp_count(F.coalesce(_column(text), F.lit("")), F.lit(r"[^ \t\n\x0B\f\r]+"))


def token_estimates(text: Column | str) -> dict[str, Column]:
    """The estimators in use: by words (two factors) and by characters (with and without a floor of 1)."""
    words, chars = word_count(text), F.length(F.coalesce(_column(text), F.lit("")))
    return {
        "by_words": F.floor(words * F.lit(1.3)).cast("long"),
        "by_words_floor": F.greatest(F.lit(1), F.floor(words / F.lit(0.75))).cast("long"),
        "by_chars": F.floor(chars / 4).cast("long"),
        "by_chars_floor": F.greatest(F.lit(1), F.floor(chars / 4)).cast("long"),
    }


def truncate_text(text: Column | str, most: int, suffix: str = "...") -> Column:
    """At most ``most`` characters with the suffix, cut after a whole word."""
    text = _column(text)
    cut = F.substring(text, 1, most - len(suffix))
    return F.when(F.length(text) <= most, text).otherwise(F.concat(F.regexp_replace(cut, r"(?s)^(.+) [^ ]*$", "$1"), F.lit(suffix)))


def squeeze_whitespace(text: Column | str) -> Column:
    """One space between words, paragraphs kept, empty ones dropped."""
    paragraphs = F.transform(F.split(_column(text), "\n\n"), lambda p: F.trim(F.regexp_replace(p, WHITE + "+", " ")))
    return F.array_join(F.filter(paragraphs, lambda p: p != ""), "\n\n")


def simple_sentences(text: Column | str) -> Column:
    """Parts after ``.``, ``!`` or ``?`` and white space."""
    parts = F.transform(F.split(_column(text), r"(?<=[.!?])\s+"), lambda s: F.trim(F.regexp_replace(s, r"^\s+|\s+$", "")))
    return F.filter(parts, lambda s: s != "")


def sentences(text: Column | str) -> Column:
    """Sentences that end before an ASCII capital, initials and short abbreviations aside."""
    parts = F.transform(F.split(_column(text), r"(?<!\w\.\w.)(?<![A-Z][a-z]\.)(?<=\.|\?|!)\s+(?=[A-Z])"), lambda s: F.regexp_replace(s, r"^\s+|\s+$", ""))
    return F.filter(parts, lambda s: s != "")


def topic_keywords(text: Column | str) -> Column:
    """Topic words in a text, sorted; an underscore joins words, so ``meeting_notes`` has none."""
    words = F.regexp_extract_all(F.lower(F.coalesce(_column(text), F.lit(""))), F.lit(r"\b([a-z]{4,})\b"), F.lit(1))
    return F.array_sort(F.array_intersect(words, F.array(*map(F.lit, TOPIC_KEYWORDS))))


def title_case(text: Column | str) -> Column:
    return F.initcap(F.replace(_column(text), F.lit("_"), F.lit(" ")))


def content_hash(data: Column | str) -> Column:
    """An opaque digest: only its equality counts."""
    return F.sha2(_column(data), 256)


def cache_key(text: Column | str, provider: Column, model: Column) -> Column:
    """The key of a stored vector; texts that differ only in case or outer blanks share one."""
    return F.sha2(F.concat_ws("|", F.lower(F.regexp_replace(_column(text), r"^\s+|\s+$", "")), provider, model), 256)


@pandas_udf(StringType())
def nfc(text: pd.Series) -> pd.Series:
    return text.map(lambda t: unicodedata.normalize("NFC", t) if t is not None else None)


def normalize_text(text: Column | str) -> Column:
    """NFC, control characters removed (not newline and tab), blanks and newlines squeezed, ends stripped."""
    text = F.regexp_replace(nfc(_column(text)), r"[\p{C}&&[^\n\t]]", "")
    text = F.regexp_replace(text, r"[ \t]+", " ")
    return F.regexp_replace(F.regexp_replace(text, r"\n{3,}", "\n\n"), r"^\s+|\s+$", "")


def search_terms(text: Column | str) -> Column:
    """Lower-case runs of letters and digits."""
    return F.filter(F.split(F.lower(F.coalesce(_column(text), F.lit(""))), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def basename(path: Column | str) -> Column:
    return F.element_at(F.split(_column(path), "/"), -1)


def iso_week(day: Column | str) -> dict[str, Column]:
    """ISO year and week, Monday and Sunday."""
    day = _column(day)
    monday = F.date_trunc("week", day)
    return {
        "iso_year": F.date_part(F.lit("YEAROFWEEK"), day).cast("long"),
        "iso_week": F.weekofyear(day).cast("long"),
        "week_start": F.date_format(monday, "yyyy-MM-dd"),
        "week_end": F.date_format(monday + F.expr("INTERVAL 6 DAYS"), "yyyy-MM-dd"),
    }


def iso_text(ts: Column | str) -> Column:
    return F.date_format(_column(ts), "yyyy-MM-dd'T'HH:mm:ss")


def tags(json: Column | str) -> Column:
    """Strings of a JSON array, trimmed; anything else gives none."""
    parsed = F.coalesce(F.from_json(_column(json), "array<string>"), F.array().cast("array<string>"))
    return F.filter(F.transform(F.filter(parsed, lambda t: t.isNotNull()), lambda t: F.trim(t)), lambda t: t != "")


def citation(doc_id: Column | str, seq: Column | str, page: Column | None = None, scheme: str = "kb") -> Column:
    uri = F.concat(F.lit(f"{scheme}://doc/"), _column(doc_id).cast("string"), F.lit("#chunk="), _column(seq).cast("string"))
    return uri if page is None else F.concat(uri, F.when(page.isNotNull(), F.concat(F.lit("&page="), page.cast("string"))).otherwise(F.lit("")))


def chunk_header(title: Column, page: Column, section: Column, score: Column, text: Column) -> Column:
    """``[Source | Page | Section | Relevance]`` and the text below; parts that are missing are left out."""
    parts = F.concat_ws(
        " | ",
        F.concat(F.lit("Source: "), F.coalesce(title, F.lit("Unknown"))),
        F.concat(F.lit("Page "), page.cast("string")),
        F.when(section != "", F.concat(F.lit("Section: "), section)),
        F.concat(F.lit("Relevance: "), F.format_string("%.2f", score)),
    )
    return F.concat(F.lit("["), parts, F.lit("]\n"), text)


def prompt_block(number: Column, source: Column, page: Column, content: Column) -> Column:
    where = F.concat(F.lit("[source: "), source, F.coalesce(F.concat(F.lit(" p."), page.cast("string")), F.lit("")), F.lit("]"))
    return F.concat(F.lit("["), number.cast("string"), F.lit("] "), where, F.lit("\n"), content)


def context_block(number: Column, source: Column, score: Column, content: Column) -> Column:
    head = F.concat(F.lit("[Context "), number.cast("string"), F.lit("] (Source: "), source, F.lit(", Relevance: "), F.format_string("%.2f", score), F.lit(")"))
    return F.concat(head, F.lit("\n"), content)
