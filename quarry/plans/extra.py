"""Further filters, joins, sinks, sorts and functions of the inventory, each by its own name."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import fusion, reports, store, tables
from .registry import query, table


def _d(spark, sf):
    return table(spark, sf, "documents")


def _e(spark, sf):
    return table(spark, sf, "events")


@query("f01_path_equality", "SELECT page_id FROM pages WHERE url = (SELECT url FROM pages WHERE page_id = 3)")
def path_equality(spark, sf):
    pages = table(spark, sf, "pages")
    url = pages.where("page_id = 3").select("url").first()[0]
    return fusion.apply(pages, fusion.filters(path=url, path_col="url")).select("page_id")


@query("f02_doc_equality", "SELECT doc_id, lang FROM documents WHERE doc_id = 42")
def doc_equality(spark, sf):
    return fusion.apply(_d(spark, sf), fusion.filters(doc_id=42)).select("doc_id", "lang")


@query("f10_period_or", "SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_shipdate >= TIMESTAMP '1998-06-01 00:00:00' OR o_orderdate >= TIMESTAMP '1998-06-01 00:00:00'")
def period_or(spark, sf):
    cut = F.lit("1998-06-01 00:00:00").cast("timestamp_ntz")
    orders = table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderdate")
    rows = table(spark, sf, "lineitem").join(orders, "l_orderkey")
    return rows.where((F.col("l_shipdate") >= cut) | (F.col("o_orderdate") >= cut)).select("l_orderkey", "l_linenumber", "l_partkey")


@query("f12_period_equality", "SELECT event_id FROM events WHERE ts = (SELECT max(ts) FROM events)")
def period_equality(spark, sf):
    last = _e(spark, sf).agg(F.max("ts").alias("ts"))
    return _e(spark, sf).join(F.broadcast(last), "ts", "left_semi").select("event_id")  # one row


@query("f15_change_predicate", "SELECT doc_id, md5(text) = md5(CASE WHEN doc_id % 4 = 0 THEN text || ' ' ELSE text END) AS unchanged FROM documents")
def change_predicate(spark, sf):
    before = F.when(F.col("doc_id") % 4 == 0, F.concat("text", F.lit(" "))).otherwise(F.col("text"))
    return _d(spark, sf).select("doc_id", T.content_hash("text").eqNullSafe(T.content_hash(before)).alias("unchanged"))


@query("f17_threshold", "SELECT event_id FROM events WHERE value >= 55.5")
def threshold(spark, sf):
    return _e(spark, sf).where("value >= 55.5").select("event_id")


@query("j01_filtered_join", "SELECT d.doc_id, l.quality FROM documents d JOIN labels l ON d.doc_id = l.doc_id WHERE d.source = 'src3' AND contains(d.text, 'the')")
def filtered_join(spark, sf):
    rows = _d(spark, sf).where((F.col("source") == "src3") & F.col("text").contains("the")).select("doc_id")
    return rows.join(table(spark, sf, "labels").select("doc_id", "quality"), "doc_id")


@query("j04_overlay_merge", "SELECT coalesce(a.doc_id, b.vec_id) AS doc_id, CASE WHEN a.doc_id IS NOT NULL AND b.vec_id IS NOT NULL THEN (a.n_chars + b.label) / 2.0::DOUBLE ELSE coalesce(a.n_chars, b.label)::DOUBLE END AS merged FROM (SELECT * FROM documents WHERE doc_id % 2 = 0) a FULL OUTER JOIN embeddings b ON a.doc_id = b.vec_id")
def overlay_merge(spark, sf):
    a = _d(spark, sf).where("doc_id % 2 = 0").select("doc_id", "n_chars")
    b = table(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"), "label")
    both = F.col("n_chars").isNotNull() & F.col("label").isNotNull()
    return a.join(b, "doc_id", "full_outer").select("doc_id", F.when(both, (F.col("n_chars") + F.col("label")) / F.lit(2.0)).otherwise(F.coalesce("n_chars", "label").cast("double")).alias("merged"))


@query("j06_left_unknown", "SELECT e.vec_id, coalesce(d.source, 'Unknown') AS source FROM embeddings e LEFT JOIN (SELECT * FROM documents WHERE doc_id % 3 = 0) d ON e.vec_id = d.doc_id")
def left_unknown(spark, sf):
    docs = _d(spark, sf).where("doc_id % 3 = 0").select(F.col("doc_id").alias("vec_id"), "source")
    return table(spark, sf, "embeddings").select("vec_id").join(docs, "vec_id", "left").select("vec_id", F.coalesce("source", F.lit("Unknown")).alias("source"))


@query("j08_files_left_documents", "SELECT p.page_id, d.lang FROM pages p LEFT JOIN documents d ON p.page_id = d.doc_id AND d.lang <> 'en'")
def files_left(spark, sf):
    docs = _d(spark, sf).where("lang <> 'en'").select(F.col("doc_id").alias("page_id"), "lang")
    return table(spark, sf, "pages").select("page_id").join(docs, "page_id", "left")


@query("k03_reset", "SELECT count(*) AS n FROM embeddings WHERE false")
def reset(spark, sf):
    return table(spark, sf, "embeddings").limit(0).agg(F.count(F.lit(1)).alias("n"))


@query("k06_hard_delete", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def hard_delete(spark, sf):
    return tables.delete(_d(spark, sf), table(spark, sf, "labels").where("toxic = 1"), ["doc_id"]).select("doc_id")


@query("k07_replace_chunks", "SELECT l_orderkey, count(*) AS n FROM (SELECT l_orderkey FROM lineitem WHERE l_orderkey % 5 <> 0 UNION ALL SELECT o_orderkey FROM orders WHERE o_orderkey % 5 = 0) GROUP BY 1")
def replace_chunks(spark, sf):
    fresh = table(spark, sf, "orders").where("o_orderkey % 5 = 0").select(F.col("o_orderkey").alias("l_orderkey"))
    items = table(spark, sf, "lineitem").select("l_orderkey")
    kept = tables.delete(items, fresh, ["l_orderkey"]).where("l_orderkey % 5 <> 0")
    return kept.unionAll(fresh).groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"))


@query("k09_index_rebuild", r"SELECT term, count(*) AS n_chunks, sum(tf)::BIGINT AS n FROM (SELECT conv_id, turn, term, count(*) AS tf FROM (SELECT conv_id, turn, unnest([t for t in regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+') if t <> '']) AS term FROM conversations) GROUP BY ALL) GROUP BY term")
def index_rebuild(spark, sf):
    rows = table(spark, sf, "conversations").select("conv_id", "turn", F.explode(T.search_terms("text")).alias("term"))
    return rows.groupBy("conv_id", "turn", "term").agg(F.count(F.lit(1)).alias("tf")).groupBy("term").agg(F.count(F.lit(1)).alias("n_chunks"), F.sum("tf").alias("n"))


@query("k16_usage_prune", "SELECT day, count(*) AS n FROM (SELECT strftime(ts, '%Y-%m-%d') AS day FROM events) WHERE day >= '2024-01-11' GROUP BY day")
def usage_prune(spark, sf):
    days = _e(spark, sf).groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    return days.where("day >= '2024-01-11'")


@query("k19_watch_paths", "SELECT source AS path, max(doc_id) AS doc_id FROM documents WHERE source <> 'src5' GROUP BY source")
def watch_paths(spark, sf):
    rows = tables.latest(_d(spark, sf).select(F.col("source").alias("path"), "doc_id"), ["path"], "doc_id")
    return tables.delete(rows, spark.createDataFrame([("src5",)], "path string"), ["path"])


@query("k20_task_details", """SELECT 'pending' AS status, '{"doc_id":' || doc_id || ',"lang":"' || lang || '"}' AS details FROM documents""")
def task_details(spark, sf):
    return store.task_details(_d(spark, sf), "doc_id", "lang")


@query("t01_top_k", "SELECT doc_id, n_chars FROM documents ORDER BY n_chars DESC, doc_id LIMIT 20")
def top_k(spark, sf):
    return _d(spark, sf).select("doc_id", "n_chars").orderBy(F.desc("n_chars"), "doc_id").limit(20)


@query("t02_oversample", "SELECT doc_id FROM (SELECT doc_id, n_chars, lang FROM documents ORDER BY n_chars DESC, doc_id LIMIT 60) WHERE lang = 'en' ORDER BY n_chars DESC, doc_id LIMIT 20")
def oversample(spark, sf):
    leg = _d(spark, sf).select("doc_id", "n_chars", "lang").orderBy(F.desc("n_chars"), "doc_id").limit(60)
    return leg.where("lang = 'en'").orderBy(F.desc("n_chars"), "doc_id").limit(20).select("doc_id")


@query("t08_sorted_groups", "SELECT lang, row_number() OVER (ORDER BY n DESC, lang) AS place FROM (SELECT lang, count(*) AS n FROM documents GROUP BY lang)")
def sorted_groups(spark, sf):
    sizes = _d(spark, sf).groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    return sizes.select("lang", F.row_number().over(W.orderBy(F.desc("n"), "lang")).cast("long").alias("place"))  # a row for each language


@query("t09_head_sample", "SELECT p_partkey, substring(p_name, 1, 200) AS p_name FROM part ORDER BY p_partkey LIMIT 100")
def head_sample(spark, sf):
    return table(spark, sf, "part").orderBy("p_partkey").limit(100).select("p_partkey", F.substring("p_name", 1, 200).alias("p_name"))


@query("u04_tag_union", "SELECT DISTINCT unnest([lang, source]) AS tag FROM documents")
def tag_union(spark, sf):
    return _d(spark, sf).select(F.explode(F.array("lang", "source")).alias("tag")).distinct()


@query("u05_vocabulary", "SELECT doc_id, array_to_string(list_sort(list_intersect(list_distinct(string_split(text, ' ')), ['the', 'of', 'und', 'der', 'la', 'de'])), ',') AS words FROM documents")
def vocabulary(spark, sf):
    known = F.array(*map(F.lit, ["the", "of", "und", "der", "la", "de"]))
    return _d(spark, sf).select("doc_id", F.array_join(F.array_sort(F.array_intersect(F.split("text", " "), known)), ",").alias("words"))


@query("x21_prompt_blocks", "SELECT conv_id, string_agg('[' || (turn + 1) || '] [source: ' || role || ']' || chr(10) || text, chr(10) || chr(10) ORDER BY turn) AS prompt FROM conversations GROUP BY conv_id")
def prompt_blocks(spark, sf):
    block = T.prompt_block(F.col("turn") + 1, F.col("role"), F.lit(None).cast("string"), F.col("text"))
    parts = F.array_sort(F.collect_list(F.struct("turn", block.alias("b"))))
    return table(spark, sf, "conversations").groupBy("conv_id").agg(F.array_join(F.transform(parts, lambda p: p["b"]), "\n\n").alias("prompt"))


@query("x27_headings", r"SELECT conv_id, turn, regexp_matches(repeat('#', turn::INT) || ' ' || role, '^#{1,6}\s+\S') AS heading FROM conversations")
def headings(spark, sf):
    line = F.concat(F.expr("repeat('#', cast(turn as int))"), F.lit(" "), F.col("role"))
    return table(spark, sf, "conversations").select("conv_id", "turn", line.rlike(r"^#{1,6}\s+\S").alias("heading"))


@query("x30_line_offsets", "SELECT doc_id, i - 1 AS line, coalesce(sum(strlen(s) + 1) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS s, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents)")
def line_offsets(spark, sf):
    lines = _d(spark, sf).select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "s"))
    before = W.partitionBy("doc_id").orderBy("line").rowsBetween(W.unboundedPreceding, -1)
    return lines.select("doc_id", F.col("line").cast("long").alias("line"), F.coalesce(F.sum((F.octet_length("s") + 1).cast("long")).over(before), F.lit(0)).alias("start"))


@query("x31_line_blocks", "SELECT doc_id, (i - 1) // 50 AS block, count(*) AS n_lines, 'lines_' || (((i - 1) // 50) * 50 + 1) || '-' || (((i - 1) // 50) * 50 + count(*)) AS section FROM (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents) GROUP BY doc_id, (i - 1) // 50")
def line_blocks(spark, sf):
    lines = _d(spark, sf).select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "s")).withColumn("block", F.floor(F.col("i") / 50))
    rows = lines.groupBy("doc_id", "block").agg(F.count(F.lit(1)).alias("n_lines"))
    return rows.withColumn("section", F.concat(F.lit("lines_"), (F.col("block") * 50 + 1).cast("string"), F.lit("-"), (F.col("block") * 50 + F.col("n_lines")).cast("string")))


@query("x33_json_metadata", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_metadata(spark, sf):
    return _e(spark, sf).select("event_id", F.from_json("props", "k bigint")["k"].alias("k"))


@query("x35_row_text", "SELECT c_custkey, c_name || ' | ' || c_mktsegment || ' | ' || c_nationkey AS line FROM customer")
def row_text(spark, sf):
    from ..operators.profile import row_text as rendered

    return table(spark, sf, "customer").select("c_custkey", rendered(["c_name", "c_mktsegment", "c_nationkey"]).alias("line"))


@query("z02_event_filter", "SELECT event_id FROM events WHERE event_type IN ('view', 'click') AND user_id < 100")
def event_filter(spark, sf):
    return _e(spark, sf).where(F.col("event_type").isin("view", "click") & (F.col("user_id") < 100)).select("event_id")


@query("z05_still_there", "SELECT user_id, arg_max(event_type, event_id) AS last_kind FROM events GROUP BY user_id HAVING arg_max(event_type, event_id) <> 'logout'")
def still_there(spark, sf):
    rows = _e(spark, sf).groupBy("user_id").agg(F.max_by("event_type", "event_id").alias("last_kind"))
    return rows.where("last_kind <> 'logout'")


@query("z08_chat_quota", "SELECT conv_id, turn, used, used <= 3000 AS accepted FROM (SELECT conv_id, turn, sum(greatest(1, length(text) // 4)) OVER (PARTITION BY conv_id % 10 ORDER BY conv_id, turn ROWS UNBOUNDED PRECEDING)::BIGINT AS used FROM conversations)")
def chat_quota(spark, sf):
    log = table(spark, sf, "conversations").select("conv_id", "turn", (F.col("conv_id") % 10).alias("day"), T.token_estimates("text")["by_chars_floor"].alias("tokens"))
    return tables.running_quota(log, "day", ["conv_id", "turn"], "tokens", 3000).select("conv_id", "turn", "used", "accepted")


@query("q15_scan_report", "SELECT lang AS root, count(*) AS scanned, sum(n_chars)::BIGINT AS chars FROM documents GROUP BY ROLLUP (lang)")
def scan_report(spark, sf):
    return _d(spark, sf).rollup(F.col("lang").alias("root")).agg(F.count(F.lit(1)).alias("scanned"), F.sum("n_chars").alias("chars"))


@query("s21_vectors_by_ids", "SELECT vec_id, label FROM embeddings WHERE vec_id IN (1, 5, 9, 400)")
def vectors_by_ids(spark, sf):
    return table(spark, sf, "embeddings").where(F.col("vec_id").isin(1, 5, 9, 400)).select("vec_id", "label")


@query("t07_newest_first", "SELECT event_id, event_type FROM events ORDER BY ts DESC, event_id LIMIT 100")
def newest_first(spark, sf):
    return reports.recent(_e(spark, sf).select("event_id", "event_type", "ts"), [F.desc("ts"), "event_id"], 100).select("event_id", "event_type")
