"""Text queries: scalars, personal data, hashing, chunking, parsing."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import personal as P
from ..functions import text as T
from ..operators import chunking
from ..sources import parsers
from .registry import query, table

_WORDS = r"len([w for w in regexp_split_to_array(text, '[ \t\n\x0B\f\r]+') if w <> ''])"


def _documents(spark, sf):
    return table(spark, sf, "documents")


@query(
    "x03_sentences",
    r"""WITH w AS (SELECT doc_id, [x for x in regexp_split_to_array(coalesce(text, ''), '[ \t\n\x0B\f\r]+') if x <> ''] AS ws FROM documents)
    SELECT doc_id, CASE WHEN len(ws) = 0 THEN 0 ELSE 1 + len([i for i in range(1, len(ws)) if regexp_matches(ws[i], '[.?!]$') AND regexp_matches(ws[i + 1], '^[A-Z]')
      AND NOT regexp_matches(ws[i], '[A-Za-z0-9_]\.[A-Za-z0-9_].$') AND NOT regexp_matches(ws[i], '[A-Z][a-z]\.$')]) END AS n FROM w""",
)
def sentences(spark, sf):
    return _documents(spark, sf).select("doc_id", F.size(T.sentences("text")).cast("long").alias("n"))


@query(
    "x04_truncate",
    r"""SELECT doc_id, CASE WHEN length(text) <= 80 THEN text ELSE regexp_replace(substring(text, 1, 77), '^(.+) [^ ]*$', '\1', 's') || '...' END AS short FROM documents""",
)
def truncate(spark, sf):
    return _documents(spark, sf).select("doc_id", T.truncate_text("text", 80).alias("short"))


@query(
    "x05_whitespace",
    r"""SELECT doc_id, array_to_string([p for p in [trim(regexp_replace(x, '[ \t\n\x0B\f\r]+', ' ', 'g')) for x in string_split(text, chr(10) || chr(10))] if p <> ''], chr(10) || chr(10)) AS text FROM documents""",
)
def whitespace(spark, sf):
    return _documents(spark, sf).select("doc_id", T.squeeze_whitespace("text").alias("text"))


@query(
    "x06_token_estimates",
    f"""SELECT doc_id, floor(w * 1.3::DOUBLE)::BIGINT AS by_words, greatest(1, floor(w / 0.75::DOUBLE))::BIGINT AS by_words_floor, (length(text) // 4)::BIGINT AS by_chars, greatest(1, length(text) // 4)::BIGINT AS by_chars_floor
    FROM (SELECT doc_id, text, {_WORDS} AS w FROM documents)""",
)
def token_estimates(spark, sf):
    return _documents(spark, sf).select("doc_id", *[c.alias(n) for n, c in T.token_estimates("text").items()])


def _counts(t: str) -> str:
    return ", ".join(f"len(regexp_extract_all({t}, '{p}'))::BIGINT AS {k}" for k, p in P.PATTERNS.items())


@query("x07_pii_detect", f"SELECT doc_id, {_counts('text')} FROM documents")
def pii_detect(spark, sf):
    return _documents(spark, sf).select("doc_id", *[c.alias(k) for k, c in P.counts(F.col("text")).items()])


@query("a22_pii_counts", "SELECT " + ", ".join(f"sum({k})::BIGINT AS {k}" for k in P.PATTERNS) + f" FROM (SELECT {_counts('text')} FROM conversations)")
def pii_totals(spark, sf):
    rows = table(spark, sf, "conversations").select(*[c.alias(k) for k, c in P.counts(F.col("text")).items()])
    return rows.agg(*[F.sum(k).alias(k) for k in P.PATTERNS])


def _redacted(t: str) -> str:
    for kind, label in P.REDACTED.items():
        t = f"regexp_replace({t}, '{P.PATTERNS[kind]}', '[REDACTED]:{label}', 'g')"
    return t


@query("x08_pii_redact", f"SELECT doc_id, {_redacted('text')} AS text FROM documents")
def pii_redact(spark, sf):
    return _documents(spark, sf).select("doc_id", P.redact(F.col("text")).alias("text"))


@query("x09_has_pii", "SELECT doc_id, " + " OR ".join(f"regexp_matches(text, '{p}')" for p in P.PATTERNS.values()) + " AS has_pii FROM documents")
def has_pii(spark, sf):
    return _documents(spark, sf).select("doc_id", P.has_any(F.col("text")).alias("has_pii"))


@query("x10_content_hash_dups", "SELECT sha256(text) AS hash, count(*) AS n, min(doc_id) AS first FROM documents GROUP BY 1 HAVING count(*) > 1")
def content_dups(spark, sf):
    by = _documents(spark, sf).groupBy(T.content_hash("text").alias("hash")).agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first"))
    return by.where("n > 1")


@query("x11_cache_key", r"SELECT doc_id, sha256(lower(regexp_replace(text, '^[ \t\n\x0B\f\r]+|[ \t\n\x0B\f\r]+$', '', 'g')) || '|' || lang || '|' || source) AS key FROM documents")
def cache_key(spark, sf):
    return _documents(spark, sf).select("doc_id", T.cache_key("text", F.col("lang"), F.col("source")).alias("key"))


@query("x14_tags", "SELECT event_id, len([t for t in [trim(x) for x in (['a ', event_type, '']::VARCHAR[])] if t <> ''])::BIGINT AS n_tags, array_to_string([t for t in [trim(x) for x in (['a ', event_type, '']::VARCHAR[])] if t <> ''], '|') AS tags FROM events")
def tags(spark, sf):
    json = F.to_json(F.array(F.lit("a "), F.col("event_type"), F.lit("")))
    found = T.tags(json)
    return table(spark, sf, "events").select("event_id", F.size(found).cast("long").alias("n_tags"), F.array_join(found, "|").alias("tags"))


_KEYWORDS = "[" + ", ".join(f"'{k}'" for k in T.TOPIC_KEYWORDS) + "]"
#: A title for the part of a conversation, with a topic word in some.
_TITLE = "CASE turn % 5 WHEN 0 THEN 'Budget review' WHEN 1 THEN 'meeting_notes' WHEN 2 THEN 'the guide, design' ELSE 'other' END"


@query("x15_keywords", rf"SELECT conv_id, turn, array_to_string(list_sort(list_distinct([w for w in regexp_extract_all(lower({_TITLE}), '\b[a-z]{{4,}}\b') if list_contains({_KEYWORDS}, w)])), ',') AS words FROM conversations")
def keywords(spark, sf):
    title = F.expr(f"CASE turn % 5 WHEN 0 THEN 'Budget review' WHEN 1 THEN 'meeting_notes' WHEN 2 THEN 'the guide, design' ELSE 'other' END")
    return table(spark, sf, "conversations").select("conv_id", "turn", F.array_join(T.topic_keywords(title), ",").alias("words"))


@query("x18_basename", "SELECT page_id, string_split(url, '/')[-1] AS name FROM pages")
def basename(spark, sf):
    return table(spark, sf, "pages").select("page_id", T.basename("url").alias("name"))


@query("x19_iso_text", "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS at FROM events")
def iso_text(spark, sf):
    return table(spark, sf, "events").select("event_id", T.iso_text("ts").alias("at"))


@query("x23_html_title_raw", r"SELECT page_id, regexp_extract(html, '(?i)<title[^>]*>([^<]+)</title>', 1) AS title FROM pages")
def html_title_raw(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.regexp_extract("html", r"(?i)<title[^>]*>([^<]+)</title>", 1).alias("title"))


@query("x25_tag_strip", r"SELECT page_id, trim(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '[ \t\n\x0B\f\r]+', ' ', 'g')) AS text FROM pages")
def tag_strip(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.trim(F.regexp_replace(F.regexp_replace("html", "<[^>]+>", " "), T.WHITE + "+", " ")).alias("text"))


@query("s13_html_blocks")
def html_blocks(spark, sf):
    pages = table(spark, sf, "pages").select(F.concat(F.lit("/pages/"), F.col("page_id").cast("string"), F.lit(".html")).alias("path"), F.encode("html", "UTF-8").alias("content"))
    return parsers.parse_files(pages).select("path", "title", "seq", "kind", "text", "offset_start", "offset_end")


@query("s10_text_blocks", r"""SELECT doc_id, CASE WHEN length(t) < 100 THEN t END AS title, strlen(text)::BIGINT AS bytes FROM (SELECT doc_id, text, trim(string_split(trim(text, E' \t\n\r\f\v'), chr(10))[1], E' \t\n\r\f\v') AS t FROM documents)""")
def text_blocks(spark, sf):
    blank = F.lit(" \t\n\r\f\x0b")  # no regex: its $ also matches before a last U+0085 or U+2028, and long runs of blanks take it quadratic time
    first = F.btrim(F.substring_index(F.btrim("text", blank), "\n", 1), blank)
    return _documents(spark, sf).select("doc_id", F.when(F.length(first) < 100, first).alias("title"), F.octet_length("text").cast("long").alias("bytes"))


@query("s11_markdown_sections")
def markdown_sections(spark, sf):
    body = F.concat(F.lit("---\ntitle: "), "source", F.lit("\n---\n# "), "lang", F.lit("\n"), "text", F.lit("\n## End\n"), "source")
    files = _documents(spark, sf).select(F.concat(F.col("doc_id").cast("string"), F.lit(".md")).alias("path"), F.encode(body, "UTF-8").alias("content"))
    return parsers.parse_files(files).select("path", "title", "seq", "section", "offset_start", "offset_end")


@query(
    "x28_code_definitions",
    "SELECT n_name AS path, 'run_' || n_nationkey AS section, 'def run_' || n_nationkey || '(a, b):' AS signature FROM nation",
)
def code_definitions(spark, sf):
    code = F.concat(F.lit("import os\n\ndef run_"), F.col("n_nationkey").cast("string"), F.lit("(a, b):\n    return a\n"))
    rows = table(spark, sf, "nation").select(F.concat("n_name", F.lit(".py")).alias("path"), F.encode(code, "UTF-8").alias("content"))
    found = parsers.parse_files(rows)
    return found.select(F.regexp_replace("path", r"\.py$", "").alias("path"), "section", F.col("text").alias("signature"))


@query("q16_chunks")
def chunks(spark, sf):
    return chunking.chunk_documents(_documents(spark, sf), "doc_id", "text", 200, 50)


@query("a17_chunk_statistics")
def chunk_statistics(spark, sf):
    return chunking.chunk_statistics(chunking.chunk_documents(_documents(spark, sf), "doc_id", "text", 200, 50))
