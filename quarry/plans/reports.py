"""Report queries: digests, topics, trends."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import reports
from .registry import query, table

_WEEK = "ts >= TIMESTAMP '2024-01-08 00:00:00' AND ts <= TIMESTAMP '2024-01-14 23:59:59'"
#: A title for an event, with topic words in some.
_TITLE = "CASE user_id % 4 WHEN 0 THEN 'Budget review' WHEN 1 THEN 'meeting_notes' WHEN 2 THEN 'the guide, design' ELSE 'other' END"
_KEYWORDS = "[" + ", ".join(f"'{k}'" for k in T.TOPIC_KEYWORDS) + "]"
_TOPICS = rf"""w AS (SELECT *, {_TITLE} AS title, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE {_WEEK} AND value < 90),
k AS (SELECT *, list_sort([x for x in regexp_extract_all(lower(title), '\b[a-z]{{4,}}\b') if list_contains({_KEYWORDS}, x)])[1] AS word, upper(event_type[1]) || event_type[2:] AS kind FROM w),
g AS (SELECT *, CASE WHEN n <= 300 THEN kind ELSE kind || ' - ' || coalesce(upper(word[1]) || word[2:], 'Other') END AS topic FROM k)"""


def _period(spark, sf):
    start, end = F.lit("2024-01-08 00:00:00").cast("timestamp_ntz"), F.lit("2024-01-14 23:59:59").cast("timestamp_ntz")
    rows = table(spark, sf, "events").where(reports.in_period(F.col("ts"), F.col("ts"), start, end) & (F.col("value") < 90))
    return rows.withColumn("title", F.expr(_TITLE))


@query("x16_topic_buckets", f"WITH {_TOPICS} SELECT event_id, topic FROM g")
def topic_buckets(spark, sf):
    return reports.topic_groups(_period(spark, sf), "event_type", "title", most=300).select("event_id", "topic")


@query("q06_weekly_digest", f"WITH {_TOPICS} SELECT topic, count(*) AS n_docs FROM g GROUP BY topic")
def weekly_digest(spark, sf):
    return reports.digest(_period(spark, sf), "event_type", "title", most=300)


@query("q07_digest_facts", f"WITH {_TOPICS} SELECT count(*) AS total_documents, count(DISTINCT topic) AS n_groups, (SELECT event_type FROM g GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) AS top_type, (SELECT count(*) FROM g GROUP BY event_type ORDER BY 1 DESC LIMIT 1) AS top_count FROM g")
def digest_facts(spark, sf):
    return reports.digest_facts(_period(spark, sf), "event_type", "title", most=300)


@query("q08_latest_digest", "SELECT strftime(max(ts), '%Y-%m-%d') AS period_end, count(*) AS n FROM events")
def latest_digest(spark, sf):
    return table(spark, sf, "events").agg(F.date_format(F.max("ts"), "yyyy-MM-dd").alias("period_end"), F.count(F.lit(1)).alias("n"))


@query("q09_digest_by_week", "SELECT strftime(date_trunc('week', ts), '%Y-%m-%d') AS week_start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def digest_by_week(spark, sf):
    start = F.date_format(F.date_trunc("week", "ts"), "yyyy-MM-dd")
    return table(spark, sf, "events").groupBy(start.alias("week_start"), "event_type").agg(F.count(F.lit(1)).alias("n"))


@query("x17_iso_week", "SELECT event_id, isoyear(ts) AS iso_year, week(ts) AS iso_week, strftime(date_trunc('week', ts), '%Y-%m-%d') AS week_start, strftime(date_trunc('week', ts) + INTERVAL 6 DAY, '%Y-%m-%d') AS week_end FROM events")
def iso_week(spark, sf):
    return table(spark, sf, "events").select("event_id", *[c.alias(n) for n, c in T.iso_week("ts").items()])


@query("q10_trends", "SELECT coalesce(nullif(event_type, 'click'), 'unknown') AS kind, count(*) FILTER (ts >= TIMESTAMP '2024-01-31 00:00:00' - INTERVAL 14 DAY) AS new_documents, count(*) AS total_documents FROM events GROUP BY 1")
def trends(spark, sf):
    rows = table(spark, sf, "events").withColumn("kind0", F.nullif("event_type", F.lit("click")))
    return reports.trends(rows, F.col("ts"), F.lit("2024-01-31 00:00:00").cast("timestamp_ntz"), 14, "kind0")


@query("f11_created_since", "SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-31 00:00:00' - INTERVAL 3 DAY")
def created_since(spark, sf):
    return table(spark, sf, "events").where(F.col("ts") >= F.lit("2024-01-31 00:00:00").cast("timestamp_ntz") - F.expr("INTERVAL 3 DAYS")).select("event_id")


@query("q11_reflection_list", "SELECT event_id, ts FROM events WHERE event_type = 'purchase' ORDER BY ts DESC, event_id LIMIT 100")
def reflection_list(spark, sf):
    return reports.recent(table(spark, sf, "events").where("event_type = 'purchase'").select("event_id", "ts"), [F.desc("ts"), "event_id"], 100)


@query("t11_sample_titles", "SELECT source, array_to_string(list(doc_id ORDER BY doc_id)[1:5], ',') AS first_five FROM documents WHERE n_chars > 10 GROUP BY source")
def sample_titles(spark, sf):
    ids = F.slice(F.array_sort(F.collect_list("doc_id")), 1, 5)
    return table(spark, sf, "documents").where("n_chars > 10").groupBy("source").agg(F.array_join(ids.cast("array<string>"), ",").alias("first_five"))
