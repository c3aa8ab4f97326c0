"""Metadata queries: counts, listings, mutations, caches, profiles, set operations."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import profile, reports, tables
from .registry import query, table


def _n():
    return F.count(F.lit(1))


@query("a01_global_counts", "SELECT (SELECT count(*) FROM documents) AS documents, (SELECT count(*) FROM embeddings) AS chunks, (SELECT count(*) FROM events) AS tasks")
def global_counts(spark, sf):
    one = lambda t, name: table(spark, sf, t).agg(_n().alias(name))
    return one("documents", "documents").crossJoin(F.broadcast(one("embeddings", "chunks"))).crossJoin(F.broadcast(one("events", "tasks")))  # one row each


@query("a02_status_counts", "SELECT event_type AS status, count(*) AS n FROM events GROUP BY event_type")
def status_counts(spark, sf):
    return table(spark, sf, "events").groupBy(F.col("event_type").alias("status")).agg(_n().alias("n"))


@query("a03_type_counts", "SELECT coalesce(nullif(source, 'src0'), 'unknown') AS kind, count(*) AS n FROM documents GROUP BY 1")
def type_counts(spark, sf):
    kind = F.coalesce(F.nullif("source", F.lit("src0")), F.lit("unknown"))
    return table(spark, sf, "documents").groupBy(kind.alias("kind")).agg(_n().alias("n"))


@query("a04_chunks_per_document", "SELECT round((SELECT count(*) FROM lineitem) / (SELECT count(*) FROM orders)::DOUBLE, 4) AS average")
def chunks_per_document(spark, sf):
    items = table(spark, sf, "lineitem").agg(_n().alias("a"))
    return items.crossJoin(F.broadcast(table(spark, sf, "orders").agg(_n().alias("b")))).select(F.round(F.col("a") / F.col("b"), 4).alias("average"))


@query("a05_distinct_counts", "SELECT count(DISTINCT event_type) AS kinds, count(DISTINCT user_id) AS users, count(DISTINCT props) AS props FROM events")
def distinct_counts(spark, sf):
    return table(spark, sf, "events").agg(F.countDistinct("event_type").alias("kinds"), F.countDistinct("user_id").alias("users"), F.countDistinct("props").alias("props"))


@query("a06_blob_bytes", "SELECT sum(strlen(text))::BIGINT AS bytes, count(*) AS entries FROM documents")
def blob_bytes(spark, sf):
    return table(spark, sf, "documents").agg(F.sum(F.octet_length("text").cast("long")).alias("bytes"), _n().alias("entries"))


@query("a07_cache_stats", "SELECT lang AS provider, source AS model, count(*) AS n, sum(strlen(text))::BIGINT AS bytes FROM documents GROUP BY 1, 2 ORDER BY n DESC")
def cache_stats(spark, sf):
    by = table(spark, sf, "documents").groupBy(F.col("lang").alias("provider"), F.col("source").alias("model"))
    return by.agg(_n().alias("n"), F.sum(F.octet_length("text").cast("long")).alias("bytes")).orderBy(F.desc("n"))


@query("a08_time_range", "SELECT min(ts) AS oldest, max(ts) AS newest FROM events")
def time_range(spark, sf):
    return table(spark, sf, "events").agg(F.min("ts").alias("oldest"), F.max("ts").alias("newest"))


@query("a09_top_type", "SELECT event_type AS top_type, count(*) AS top_count FROM events GROUP BY 1 ORDER BY top_count DESC, top_type LIMIT 1")
def top_type(spark, sf):
    return reports.top_kind(table(spark, sf, "events"), "event_type")


@query(
    "a10_topic_frequency",
    "SELECT k AS topic, count(*) AS n FROM (SELECT json_extract_string(props, '$.k') AS k FROM events) WHERE k IS NOT NULL GROUP BY k ORDER BY n DESC, topic LIMIT 10",
)
def topic_frequency(spark, sf):
    k = F.get_json_object("props", "$.k")
    return table(spark, sf, "events").select(k.alias("topic")).where("topic is not null").groupBy("topic").agg(_n().alias("n")).orderBy(F.desc("n"), "topic").limit(10)


_NUMERIC = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
_STACK = "UNPIVOT (SELECT {cols} FROM {t}) ON COLUMNS(*) INTO NAME column_name VALUE value"


@query(
    "a13_numeric_profile",
    "WITH s AS (" + " UNION ALL ".join(f"SELECT '{c}' AS column_name, {c} AS v FROM lineitem" for c in _NUMERIC) + """)
    SELECT column_name, count(v) AS n, round(avg(v), 4) AS mean, round(quantile_cont(v, 0.5), 4) AS median, round(stddev_samp(v), 4) AS std, round(min(v), 4) AS min, round(max(v), 4) AS max,
           round(quantile_cont(v, 0.25), 4) AS q1, round(quantile_cont(v, 0.75), 4) AS q3 FROM s GROUP BY column_name""",
)
def numeric_profile(spark, sf):
    return profile.numeric_statistics(table(spark, sf, "lineitem"), _NUMERIC)


@query(
    "a23_scan_percent",
    """SELECT source, count(*) AS n_pages, count(*) FILTER (length(trim(coalesce(text, ''))) < 50) AS n_scanned,
       round(100.0 * count(*) FILTER (length(trim(coalesce(text, ''))) < 50) / count(*), 2)::DOUBLE AS scan_percent FROM documents GROUP BY source""",
)
def scan_percent(spark, sf):
    return profile.scan_share(table(spark, sf, "documents"), "source")


@query(
    "a14_null_distinct",
    "WITH s AS (" + " UNION ALL ".join(f"SELECT '{c}' AS column_name, {c}::VARCHAR AS v FROM part" for c in ("p_partkey", "p_name", "p_brand", "p_type", "p_size")) + ") SELECT column_name, count(v) AS non_null, count(*) - count(v) AS nulls, count(DISTINCT v) AS distinct_values FROM s GROUP BY column_name",
)
def null_distinct(spark, sf):
    return profile.column_counts(table(spark, sf, "part"), ["p_partkey", "p_name", "p_brand", "p_type", "p_size"])


_TYPED = ["l_orderkey", "l_quantity", "l_returnflag", "l_linestatus", "l_day"]


@query(
    "a15_type_inference",
    "WITH b AS (SELECT *, strftime(l_shipdate, '%Y-%m-%d') AS l_day FROM lineitem), s AS (" + " UNION ALL ".join(f"SELECT '{c}' AS column_name, {c}::VARCHAR AS v FROM b" for c in _TYPED) + r""")
    SELECT column_name, CASE WHEN count(v) = 0 THEN 'unknown' WHEN bool_and(try_cast(v AS DOUBLE) IS NOT NULL) THEN CASE WHEN bool_and(regexp_matches(v, '^[01]$')) THEN 'boolean' ELSE 'numeric' END
      WHEN bool_and(regexp_matches(v, '^\d{4}-\d{2}-\d{2}$')) THEN 'datetime' WHEN bool_and(lower(v) IN ('true','false','yes','no','1','0','t','f','y','n')) THEN 'boolean' ELSE 'text' END AS inferred_type
    FROM s WHERE v IS NOT NULL GROUP BY column_name""",
)
def type_inference(spark, sf):
    rows = table(spark, sf, "lineitem").withColumn("l_day", F.date_format("l_shipdate", "yyyy-MM-dd"))
    return profile.column_types(rows, _TYPED)


@query("q14_csv_sample", "SELECT s_suppkey, s_name || ' | ' || s_nationkey || ' | ' || s_suppkey AS line FROM supplier ORDER BY s_suppkey LIMIT 100")
def csv_sample(spark, sf):
    return table(spark, sf, "supplier").select("s_suppkey", profile.row_text(["s_name", "s_nationkey", "s_suppkey"]).alias("line")).orderBy("s_suppkey").limit(100)


_COUNTS = "SELECT o_orderkey, o_orderstatus, count(l_orderkey) AS chunks FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1, 2"


def _with_counts(spark, sf):
    counts = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(_n().alias("chunks"))
    return table(spark, sf, "orders").join(counts, "o_orderkey", "left").withColumn("chunks", F.coalesce("chunks", F.lit(0)))


@query("j07_chunk_counts", _COUNTS)
def chunk_counts(spark, sf):
    return _with_counts(spark, sf).select("o_orderkey", "o_orderstatus", "chunks")


@query(
    "q03_document_list",
    f"WITH c AS ({_COUNTS}), f AS (SELECT o_orderkey, o_orderdate, chunks FROM orders JOIN c USING (o_orderkey) WHERE orders.o_orderstatus = 'F' AND o_orderpriority ILIKE '%urg%') SELECT *, (SELECT count(*) FROM f) AS total, ceil((SELECT count(*) FROM f) / 25.0)::BIGINT AS pages FROM f ORDER BY o_orderdate DESC, o_orderkey LIMIT 25 OFFSET 25",
)
def document_list(spark, sf):
    rows = _with_counts(spark, sf).where((F.col("o_orderstatus") == "F") & F.col("o_orderpriority").ilike("%urg%")).select("o_orderkey", "o_orderdate", "chunks")
    return reports.page(rows, [F.desc("o_orderdate"), "o_orderkey"], 2, 25)


@query("t04_pagination", "SELECT o_orderkey, o_totalprice, (SELECT count(*) FROM orders) AS total, ceil((SELECT count(*) FROM orders) / 40.0)::BIGINT AS pages FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 40 OFFSET 40")
def pagination(spark, sf):
    return reports.page(table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), [F.desc("o_totalprice"), "o_orderkey"], 2, 40)


@query("q04_document_detail", f"SELECT * FROM ({_COUNTS}) WHERE o_orderkey = 7")
def document_detail(spark, sf):
    items = table(spark, sf, "lineitem").where("l_orderkey = 7").agg(_n().alias("chunks"))
    return table(spark, sf, "orders").where("o_orderkey = 7").select("o_orderkey", "o_orderstatus").crossJoin(F.broadcast(items))  # one row each


@query("f06_status_equality", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority LIKE '1%'")
def status_equality(spark, sf):
    return table(spark, sf, "orders").where((F.col("o_orderstatus") == "F") & F.col("o_orderpriority").startswith("1")).select("o_orderkey")


@query("f07_substring_search", "SELECT p_partkey FROM part WHERE p_name ILIKE '%part%1%' OR p_type ILIKE '%steel%'")
def substring_search(spark, sf):
    return table(spark, sf, "part").where(F.col("p_name").ilike("%part%1%") | F.col("p_type").ilike("%steel%")).select("p_partkey")


@query("f08_status_set", "SELECT event_id FROM events WHERE event_type IN ('click', 'view')")
def status_set(spark, sf):
    return table(spark, sf, "events").where(F.col("event_type").isin("click", "view")).select("event_id")


@query("f09_not_deleted", "SELECT event_id, user_id FROM events WHERE event_type <> 'click' ORDER BY event_id DESC LIMIT 50")
def not_deleted(spark, sf):
    return reports.recent(table(spark, sf, "events").where("event_type <> 'click'").select("event_id", "user_id"), [F.desc("event_id")], 50)


@query("f14_in_list", "SELECT doc_id, source FROM documents WHERE doc_id IN (SELECT vec_id FROM embeddings WHERE label = 3)")
def in_list(spark, sf):
    ids = table(spark, sf, "embeddings").where("label = 3").select(F.col("vec_id").alias("doc_id"))
    return table(spark, sf, "documents").join(ids, "doc_id", "left_semi").select("doc_id", "source")


@query("f16_required_fields", "SELECT doc_id FROM (SELECT doc_id, nullif(lang, 'fr') AS lang, nullif(source, 'src1') AS source FROM documents) WHERE lang IS NOT NULL AND source IS NOT NULL")
def required_fields(spark, sf):
    rows = table(spark, sf, "documents").select("doc_id", F.nullif("lang", F.lit("fr")).alias("lang"), F.nullif("source", F.lit("src1")).alias("source"))
    return rows.na.drop(subset=["lang", "source"]).select("doc_id")


@query("j02_chunks_documents", "SELECT l_orderkey, l_linenumber, l_partkey, o_orderstatus FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_returnflag = 'R'")
def chunks_documents(spark, sf):
    items = table(spark, sf, "lineitem").where("l_returnflag = 'R'").select("l_orderkey", "l_linenumber", "l_partkey")
    orders = table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderstatus")
    return items.join(orders, "l_orderkey")


@query("j05_left_with_default", "SELECT e.vec_id, coalesce(l.quality, -1) AS quality FROM embeddings e LEFT JOIN labels l ON e.vec_id = l.doc_id")
def left_with_default(spark, sf):
    labels = table(spark, sf, "labels").select(F.col("doc_id").alias("vec_id"), "quality")
    return table(spark, sf, "embeddings").select("vec_id").join(labels, "vec_id", "left").select("vec_id", F.coalesce("quality", F.lit(-1)).alias("quality"))


@query("j09_deleted_paths", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def deleted_paths(spark, sf):
    return tables.missing(table(spark, sf, "documents").select("doc_id"), table(spark, sf, "labels"), ["doc_id"])


@query("j10_missing_index", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)")
def missing_index(spark, sf):
    return tables.missing(table(spark, sf, "documents").select("doc_id"), table(spark, sf, "embeddings").withColumnRenamed("vec_id", "doc_id"), ["doc_id"])


@query("j14_cache_hits", "SELECT c.conv_id, c.turn, b.item_id IS NOT NULL AS hit FROM conversations c LEFT JOIN (SELECT lower(trim(text)) AS t, min(item_id) AS item_id FROM benchmark GROUP BY 1) b ON lower(trim(c.text)) = b.t")
def cache_hits(spark, sf):
    cache = table(spark, sf, "benchmark").groupBy(F.lower(F.trim("text")).alias("t")).agg(F.min("item_id").alias("item_id"))
    chunks = table(spark, sf, "conversations").withColumn("t", F.lower(F.trim("text")))
    return chunks.join(cache, "t", "left").select("conv_id", "turn", F.col("item_id").isNotNull().alias("hit"))


@query("a19_hit_rate", "SELECT round(100.0 * sum((b.t IS NOT NULL)::INT) / count(*), 2)::DOUBLE AS hit_rate FROM documents d LEFT JOIN (SELECT DISTINCT doc_id AS t FROM labels) b ON d.doc_id = b.t")
def hit_rate(spark, sf):
    rows = table(spark, sf, "documents").join(table(spark, sf, "labels").select("doc_id", F.lit(1).alias("h")).distinct(), "doc_id", "left")
    return rows.agg(F.round(100.0 * F.count("h") / F.count(F.lit(1)), 2).alias("hit_rate"))


@query(
    "k01_upsert",
    "SELECT vec_id, label FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM labels) UNION ALL SELECT doc_id AS vec_id, 100 + quality AS label FROM labels",
)
def upsert(spark, sf):
    changes = table(spark, sf, "labels").select(F.col("doc_id").alias("vec_id"), (F.lit(100) + F.col("quality")).cast("int").alias("label"))
    return tables.upsert(table(spark, sf, "embeddings").select("vec_id", "label"), changes, ["vec_id"], ["vec_id", "label"])


@query("k02_delete_by_document", "SELECT vec_id FROM embeddings WHERE label <> 4")
def delete_by_document(spark, sf):
    e = table(spark, sf, "embeddings").select("vec_id", "label")
    return tables.delete(e, spark.createDataFrame([(4,)], "label int"), ["label"]).select("vec_id")


@query("k04_cascade_delete", "SELECT l_orderkey, count(*) AS n FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F') GROUP BY 1")
def cascade_delete(spark, sf):
    gone = table(spark, sf, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"))
    return tables.delete(table(spark, sf, "lineitem"), gone, ["l_orderkey"]).groupBy("l_orderkey").agg(_n().alias("n"))


@query("k05_soft_delete", "SELECT d.doc_id, CASE WHEN l.doc_id IS NULL THEN 'deleted' ELSE 'embedded' END AS status FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def soft_delete(spark, sf):
    seen = table(spark, sf, "labels").select("doc_id", F.lit(True).alias("seen"))
    rows = table(spark, sf, "documents").select("doc_id").join(seen, "doc_id", "left")
    return rows.select("doc_id", F.when(F.col("seen").isNull(), "deleted").otherwise("embedded").alias("status"))


@query("k08_index_sync", "SELECT doc_id FROM documents")
def index_sync(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id")
    index = docs.join(table(spark, sf, "labels").select("doc_id"), "doc_id", "left_semi")
    return index.unionAll(tables.missing(docs, index, ["doc_id"]))


@query("k11_cache_put", "SELECT user_id, max(event_id) AS event_id FROM events GROUP BY user_id")
def cache_put(spark, sf):
    return tables.latest(table(spark, sf, "events"), ["user_id"], "event_id").select("user_id", "event_id")


@query("k12_cache_touch", "SELECT user_id, max(ts) AS accessed FROM events GROUP BY user_id")
def cache_touch(spark, sf):
    return table(spark, sf, "events").groupBy("user_id").agg(F.max("ts").alias("accessed"))


@query("k13_cache_evict", "SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-31 00:00:00' - INTERVAL 10 DAY")
def cache_evict(spark, sf):
    cutoff = F.lit("2024-01-31 00:00:00").cast("timestamp_ntz") - F.expr("INTERVAL 10 DAYS")
    return tables.evict(table(spark, sf, "events"), "ts", cutoff).select("event_id")


@query("k15_usage_upsert", "SELECT strftime(ts, '%Y-%m-%d') AS day, sum(event_id % 50)::BIGINT AS tokens FROM events GROUP BY 1")
def usage_upsert(spark, sf):
    return table(spark, sf, "events").groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.sum(F.col("event_id") % 50).alias("tokens"))


@query("a20_daily_usage", "SELECT day, used, greatest(0, 12000 - used) AS remaining, round(used * 100.0::DOUBLE / 12000, 4) AS percent FROM (SELECT strftime(ts, '%Y-%m-%d') AS day, sum(event_id % 50)::BIGINT AS used FROM events GROUP BY 1)")
def daily_usage(spark, sf):
    log = table(spark, sf, "events").select(F.date_format("ts", "yyyy-MM-dd").alias("day"), (F.col("event_id") % 50).alias("tokens"))
    return tables.daily_usage(log, "day", "tokens", 12000)


@query(
    "z07_daily_quota",
    "SELECT event_id, used, used <= 8000 AS accepted FROM (SELECT event_id, sum(event_id % 50) OVER (PARTITION BY strftime(ts, '%Y-%m-%d') ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS used FROM events)",
)
def daily_quota(spark, sf):
    log = table(spark, sf, "events").select("event_id", "ts", F.date_format("ts", "yyyy-MM-dd").alias("day"), (F.col("event_id") % 50).alias("tokens"))
    return tables.running_quota(log, "day", ["ts", "event_id"], "tokens", 8000).select("event_id", "used", "accepted")


_NOW = "SELECT doc_id, md5(text) AS hash FROM documents WHERE doc_id % 7 <> 0"
_WAS = "SELECT doc_id, md5(CASE WHEN doc_id % 5 = 0 THEN text || '.' ELSE text END) AS hash, CASE WHEN doc_id % 11 = 0 THEN 'error' WHEN doc_id % 13 = 0 THEN 'deleted' ELSE 'embedded' END AS status FROM documents WHERE doc_id % 3 <> 0"
_DIFF = f"""SELECT * FROM (SELECT coalesce(n.doc_id, w.doc_id) AS doc_id, CASE WHEN w.doc_id IS NULL THEN 'new' WHEN n.doc_id IS NULL THEN CASE WHEN w.status = 'deleted' THEN NULL ELSE 'deleted' END
  WHEN w.status IN ('deleted', 'error') OR n.hash <> w.hash THEN 'modified' ELSE 'unchanged' END AS outcome FROM ({_NOW}) n FULL OUTER JOIN ({_WAS}) w ON n.doc_id = w.doc_id) WHERE outcome IS NOT NULL"""


def _diff(spark, sf):
    docs = table(spark, sf, "documents")
    now = docs.where("doc_id % 7 <> 0").select("doc_id", F.sha2("text", 256).alias("hash"))
    was = docs.where("doc_id % 3 <> 0").select(
        "doc_id", F.sha2(F.when(F.col("doc_id") % 5 == 0, F.concat("text", F.lit("."))).otherwise(F.col("text")), 256).alias("hash"),
        F.when(F.col("doc_id") % 11 == 0, "error").when(F.col("doc_id") % 13 == 0, "deleted").otherwise("embedded").alias("status"),
    )
    return tables.snapshot_diff(now, was, "doc_id", "hash", "status")


@query("z06_snapshot_diff", _DIFF)
def snapshot_diff(spark, sf):
    return _diff(spark, sf)


@query(
    "a18_scan_stats",
    f"WITH o AS (SELECT source AS root, outcome FROM ({_DIFF}) JOIN documents USING (doc_id)) SELECT root, " + ", ".join(f"count(*) FILTER (outcome = '{x}') AS {x}" for x in ("new", "modified", "unchanged", "deleted")) + ", count(*) FILTER (outcome <> 'deleted') AS scanned FROM o GROUP BY ROLLUP (root)",
)
def scan_stats(spark, sf):
    roots = table(spark, sf, "documents").select("doc_id", F.col("source").alias("root"))
    return tables.scan_statistics(_diff(spark, sf).join(roots, "doc_id"), "root")


@query("t05_recent", "SELECT event_id, ts FROM events ORDER BY ts DESC, event_id DESC LIMIT 5")
def recent(spark, sf):
    return reports.recent(table(spark, sf, "events").select("event_id", "ts"), [F.desc("ts"), F.desc("event_id")], 5)


@query("t06_latest_by_period", "SELECT event_type, max(event_id) AS event_id FROM (SELECT event_type, event_id, ts, max(ts) OVER (PARTITION BY event_type) AS last FROM events) WHERE ts = last GROUP BY 1")
def latest_by_period(spark, sf):
    rows = table(spark, sf, "events").groupBy("event_type").agg(F.max(F.struct("ts", "event_id")).alias("m"))
    return rows.select("event_type", F.col("m.event_id").alias("event_id"))


@query("t10_group_overflow", "SELECT doc_id, source, rank, more FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS rank, greatest(0, count(*) OVER (PARTITION BY source) - 10) AS more FROM documents) WHERE rank <= 10")
def group_overflow(spark, sf):
    return reports.grouped_overflow(table(spark, sf, "documents").select("doc_id", "source", "n_chars"), "source", [F.desc("n_chars"), "doc_id"], 10).select("doc_id", "source", "rank", "more")


@query("q01_health", "SELECT 'documents' AS name, count(*) AS n FROM documents UNION ALL SELECT 'embeddings', count(*) FROM embeddings UNION ALL SELECT 'events', count(*) FROM events")
def health(spark, sf):
    parts = [table(spark, sf, t).agg(F.lit(t).alias("name"), _n().alias("n")) for t in ("documents", "embeddings", "events")]
    return parts[0].unionAll(parts[1]).unionAll(parts[2])


@query("q02_task_list", "SELECT event_id, event_type, ts FROM events WHERE event_type = 'view' ORDER BY ts DESC, event_id LIMIT 20")
def task_list(spark, sf):
    rows = table(spark, sf, "events").where("event_type = 'view'").select("event_id", "event_type", "ts")
    return reports.recent(rows, [F.desc("ts"), "event_id"], 20)


@query("q05_statistics", "SELECT count(*) AS documents, sum(n_chars)::BIGINT AS chars, round(avg(n_chars), 4) AS avg_chars, count(DISTINCT source) AS sources, count(DISTINCT lang) AS langs FROM documents")
def statistics(spark, sf):
    return table(spark, sf, "documents").agg(_n().alias("documents"), F.sum("n_chars").alias("chars"), F.round(F.avg("n_chars"), 4).alias("avg_chars"), F.countDistinct("source").alias("sources"), F.countDistinct("lang").alias("langs"))


@query("q13_cache_summary", "SELECT count(*) AS entries, count(DISTINCT lang) AS providers, sum(strlen(text))::BIGINT AS bytes, min(doc_id) AS first, max(doc_id) AS last FROM documents")
def cache_summary(spark, sf):
    return table(spark, sf, "documents").agg(_n().alias("entries"), F.countDistinct("lang").alias("providers"), F.sum(F.octet_length("text").cast("long")).alias("bytes"), F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))


@query("u01_union", "SELECT doc_id FROM documents UNION SELECT vec_id FROM embeddings")
def union(spark, sf):
    return table(spark, sf, "documents").select("doc_id").union(table(spark, sf, "embeddings").select("vec_id")).distinct()


@query("u02_intersect", "SELECT doc_id FROM documents INTERSECT SELECT doc_id FROM labels")
def intersect(spark, sf):
    return table(spark, sf, "documents").select("doc_id").intersect(table(spark, sf, "labels").select("doc_id"))


@query("u03_difference", "SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels")
def difference(spark, sf):
    return table(spark, sf, "documents").select("doc_id").exceptAll(table(spark, sf, "labels").select("doc_id"))


@query("w04_ordinals", "SELECT doc_id, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) AS ordinal FROM documents")
def ordinals(spark, sf):
    rank = F.row_number().over(W.partitionBy("lang").orderBy(F.desc("n_chars"), "doc_id"))
    return table(spark, sf, "documents").select("doc_id", rank.cast("long").alias("ordinal"))


@query("w05_running_offset", "SELECT doc_id, coalesce(sum(strlen(text) + 1) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM documents")
def running_offset(spark, sf):
    before = W.partitionBy("source").orderBy("doc_id").rowsBetween(W.unboundedPreceding, -1)
    return table(spark, sf, "documents").select("doc_id", F.coalesce(F.sum((F.octet_length("text") + 1).cast("long")).over(before), F.lit(0)).alias("start"))


@query("w06_carry_forward", "SELECT conv_id, turn, last_value(CASE WHEN role = 'user' THEN turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn) AS section FROM conversations")
def carry_forward(spark, sf):
    heading = F.last(F.when(F.col("role") == "user", F.col("turn")), ignorenulls=True).over(W.partitionBy("conv_id").orderBy("turn"))
    return table(spark, sf, "conversations").select("conv_id", "turn", heading.alias("section"))
