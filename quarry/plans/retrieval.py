"""Retrieval queries over documents (as chunks), embeddings (as their vectors) and benchmark (as questions)."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vectors as V
from ..operators import context, fusion, keyword, vector_search
from ..operators.index import KeywordIndex
from ..operators.store import Store
from ..session import shared_folder
from .registry import query, query_vector, table

TERMS = ["this", "with", "have"]
LIKE = "the with"

_TOKENS = r"""tok AS (
  SELECT doc_id, [t for t in regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+') if t <> ''] AS terms FROM documents
)"""
_BM25 = _TOKENS + """, tf AS (
  SELECT doc_id, len(terms) AS dl, len([t for t in terms if t = 'this']) AS f0, len([t for t in terms if t = 'with']) AS f1, len([t for t in terms if t = 'have']) AS f2 FROM tok
), st AS (
  SELECT count(*) AS n, avg(dl) AS avgdl, sum((f0 > 0)::INT) AS d0, sum((f1 > 0)::INT) AS d1, sum((f2 > 0)::INT) AS d2 FROM tf
), sc AS (
  SELECT doc_id,
    greatest(1e-6, ln((n - d0 + 0.5) / (d0 + 0.5))) * f0 * 2.2 / (f0 + 1.2 * (0.25 + 0.75 * dl / avgdl)) +
    greatest(1e-6, ln((n - d1 + 0.5) / (d1 + 0.5))) * f1 * 2.2 / (f1 + 1.2 * (0.25 + 0.75 * dl / avgdl)) +
    greatest(1e-6, ln((n - d2 + 0.5) / (d2 + 0.5))) * f2 * 2.2 / (f2 + 1.2 * (0.25 + 0.75 * dl / avgdl)) AS bm25
  FROM tf, st WHERE f0 > 0 AND f1 > 0 AND f2 > 0
)"""
_NEAR = """q AS (SELECT embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id = 0), nn AS (
  SELECT vec_id, 1 - list_cosine_similarity(embedding::DOUBLE[], v) AS distance FROM embeddings, q
)"""
_LEGS = f"""WITH {_BM25}, kw0 AS (SELECT doc_id, bm25 FROM sc ORDER BY bm25 DESC, doc_id LIMIT 60),
kw AS (SELECT doc_id, bm25 / max(bm25) OVER () AS score FROM kw0),
{_NEAR}, sem AS (SELECT vec_id AS doc_id, greatest(0, 1 - distance / 2) AS score FROM (SELECT * FROM nn ORDER BY distance, vec_id LIMIT 60)),
fused AS (
  SELECT coalesce(kw.doc_id, sem.doc_id) AS doc_id, 0.3 * coalesce(kw.score, 0) + 0.7 * coalesce(sem.score, 0) AS raw,
         CASE WHEN coalesce(kw.score, 0) > 0 AND coalesce(sem.score, 0) > 0 THEN 'both' WHEN coalesce(kw.score, 0) > 0 THEN 'keyword' ELSE 'semantic' END AS match
  FROM kw FULL OUTER JOIN sem ON kw.doc_id = sem.doc_id
), best AS (SELECT doc_id, round(raw, 4) AS score, match FROM fused ORDER BY score DESC, doc_id LIMIT 20)"""


def _documents(spark, sf):
    return table(spark, sf, "documents")


def _vectors(spark, sf):
    return table(spark, sf, "embeddings").withColumnRenamed("vec_id", "doc_id")


@query("r05_hybrid_search", f"{_LEGS} SELECT doc_id, score, match, lang, source FROM best JOIN documents USING (doc_id)")
def hybrid(spark, sf):
    vector = query_vector(spark, sf)
    fused = fusion.fuse_sum(keyword.keyword_search(_documents(spark, sf), "doc_id", TERMS, 60), vector_search.semantic_search(_vectors(spark, sf), "doc_id", vector, 60), "doc_id")
    best = fusion.top(fused.withColumnRenamed("source", "match"), "doc_id", 20)
    return fusion.enrich(best, _documents(spark, sf), "doc_id", ["lang", "source"])


@query("r01_bm25", f"WITH {_BM25} SELECT doc_id, round(bm25, 6) AS bm25 FROM sc")
def bm25(spark, sf):
    return keyword.bm25(_documents(spark, sf), "doc_id", TERMS).select("doc_id", F.round("bm25", 6).alias("bm25"))


@query("k10_index_ensured", f"WITH {_BM25} SELECT doc_id, round(bm25, 6) AS bm25 FROM sc")
def index_ensured(spark, sf):
    """An index that has lost the French documents is brought up to date, then answers as a search over the texts does."""
    held = KeywordIndex(Store(spark, shared_folder(spark, "index")), "documents", "doc_id")
    documents = _documents(spark, sf)
    held.ensure(documents)
    held.remove(documents.where("lang = 'fr'"))
    held.ensure(documents)
    return held.bm25(TERMS).select("doc_id", F.round("bm25", 6).alias("bm25"))


@query("r01_keyword_search", f"WITH {_BM25}, t AS (SELECT doc_id, bm25 FROM sc ORDER BY bm25 DESC, doc_id LIMIT 100) SELECT doc_id, round(bm25 / max(bm25) OVER (), 6) AS score FROM t")
def keyword_leg(spark, sf):
    return keyword.keyword_search(_documents(spark, sf), "doc_id", TERMS, 100).select("doc_id", F.round("score", 6).alias("score"))


_BATCH = rf"""{_TOKENS}, wanted AS (
  SELECT DISTINCT item_id, unnest([t for t in regexp_split_to_array(lower(text), '[^\p{{L}}\p{{N}}]+') if t <> '']) AS term FROM benchmark
), post AS (
  SELECT doc_id, len(terms) AS dl, unnest(terms) AS term FROM tok
), tf AS (SELECT doc_id, dl, term, count(*) AS f FROM post WHERE term IN (SELECT term FROM wanted) GROUP BY ALL),
df AS (SELECT term, count(*) AS d FROM tf GROUP BY term), st AS (SELECT count(*) AS n, avg(len(terms)) AS avgdl FROM tok),
s AS (
  SELECT item_id, doc_id, round(sum(CASE WHEN ln((n - d + 0.5) / (d + 0.5)) <= 0 THEN 1e-6 ELSE ln((n - d + 0.5) / (d + 0.5)) END * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * dl / avgdl))), 6) AS score
  FROM wanted JOIN tf USING (term) JOIN df USING (term), st GROUP BY item_id, doc_id
), ranked AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s)"""


@query("r01_bm25_batch", f"WITH {_BATCH} SELECT item_id, doc_id, score, rank FROM ranked WHERE rank <= 5")
def bm25_batch(spark, sf):
    return keyword.bm25_batch(_documents(spark, sf), "doc_id", table(spark, sf, "benchmark"), "item_id", "text", 5)


@query("r02_vector_topk", f"WITH {_NEAR} SELECT vec_id, round(distance, 6) AS distance FROM nn ORDER BY nn.distance, vec_id LIMIT 25")
def vector_topk(spark, sf):
    return vector_search.nearest(table(spark, sf, "embeddings"), "vec_id", query_vector(spark, sf), 25).withColumn("distance", F.round("distance", 6))


@query("r03_semantic_search", f"WITH {_NEAR} SELECT vec_id, round(greatest(0, 1 - distance / 2), 6) AS score FROM (SELECT * FROM nn ORDER BY distance, vec_id LIMIT 100)")
def semantic(spark, sf):
    return vector_search.semantic_search(table(spark, sf, "embeddings"), "vec_id", query_vector(spark, sf)).withColumn("score", F.round("score", 6))


@query("r04_fusion_sum", f"{_LEGS} SELECT doc_id, round(raw, 6) AS score, match AS source FROM fused")
def fusion_sum(spark, sf):
    semantic = vector_search.semantic_search(_vectors(spark, sf), "doc_id", query_vector(spark, sf), 60)
    return fusion.fuse_sum(keyword.keyword_search(_documents(spark, sf), "doc_id", TERMS, 60), semantic, "doc_id").withColumn("score", F.round("score", 6))


@query(
    "r06_cli_similarity",
    f"WITH {_NEAR} SELECT vec_id, round(greatest(0, 1 - distance), 6) AS similarity, substring(coalesce(text, 'Unknown'), 1, 300) AS excerpt FROM (SELECT * FROM nn ORDER BY distance, vec_id LIMIT 5) LEFT JOIN documents ON vec_id = doc_id",
)
def cli_similarity(spark, sf):
    found = vector_search.nearest(table(spark, sf, "embeddings"), "vec_id", query_vector(spark, sf), 5)
    docs = _documents(spark, sf).select(F.col("doc_id").alias("vec_id"), "text")
    rows = found.join(docs, "vec_id", "left")
    return rows.select("vec_id", F.round(V.full_similarity(F.col("distance")), 6).alias("similarity"), F.substring(F.coalesce("text", F.lit("Unknown")), 1, 300).alias("excerpt"))


@query("r07_like_search", "SELECT doc_id, 1.0::DOUBLE AS score FROM documents WHERE lower(text) LIKE '%the%' AND lower(text) LIKE '%with%'")
def like(spark, sf):
    return keyword.like_search(_documents(spark, sf), "doc_id", LIKE)


@query(
    "r07_like_title_search",
    """SELECT doc_id, ((contains(lower(text), 'the')::INT + contains(lower(text), 'src1')::INT) / 2.0)::DOUBLE AS score FROM documents
       WHERE (contains(lower(text), 'the') OR contains(source, 'the')) AND (contains(lower(text), 'src1') OR contains(source, 'src1'))""",
)
def like_title(spark, sf):
    return keyword.like_search(_documents(spark, sf), "doc_id", "the src1", title="source")


@query(
    "r08_semantic_paths",
    f"WITH {_NEAR} SELECT vec_id, round(1 - distance / 2, 6) AS score, coalesce('/' || source || '/' || doc_id, 'Unknown') AS path FROM (SELECT * FROM nn ORDER BY distance, vec_id LIMIT 20) LEFT JOIN documents ON vec_id = doc_id",
)
def semantic_paths(spark, sf):
    found = vector_search.nearest(table(spark, sf, "embeddings"), "vec_id", query_vector(spark, sf), 20)
    docs = _documents(spark, sf).select(F.col("doc_id").alias("vec_id"), F.concat(F.lit("/"), "source", F.lit("/"), F.col("doc_id").cast("string")).alias("path"))
    return found.join(docs, "vec_id", "left").select("vec_id", F.round(V.half_similarity(F.col("distance"), clamp=False), 6).alias("score"), F.coalesce("path", F.lit("Unknown")).alias("path"))


@query(
    "r09_hybrid_search_avg",
    f"""WITH kw AS (SELECT doc_id, 0.3 AS s FROM (SELECT doc_id FROM documents WHERE lower(text) LIKE '%the%' AND lower(text) LIKE '%with%' ORDER BY doc_id LIMIT 20)),
{_NEAR}, sem AS (SELECT vec_id AS doc_id, (1 - distance / 2) * 0.7 AS s FROM (SELECT * FROM nn ORDER BY distance, vec_id LIMIT 20))
SELECT doc_id, round(CASE WHEN a IS NOT NULL AND b IS NOT NULL THEN (a + b) / 2 ELSE coalesce(a, b) END, 4)::DOUBLE AS score,
       CASE WHEN a IS NOT NULL AND b IS NOT NULL THEN 'both' WHEN a IS NOT NULL THEN 'keyword' ELSE 'semantic' END AS source
FROM (SELECT coalesce(kw.doc_id, sem.doc_id) AS doc_id, kw.s::DOUBLE AS a, sem.s::DOUBLE AS b FROM kw FULL OUTER JOIN sem ON kw.doc_id = sem.doc_id)
ORDER BY score DESC, doc_id LIMIT 20""",
)
def hybrid_average(spark, sf):
    return fusion.hybrid_search_average(_documents(spark, sf), _vectors(spark, sf), "doc_id", LIKE, query_vector(spark, sf), 20)


@query(
    "r10_enrich",
    f"{_LEGS} SELECT doc_id, score, text, n_chars, 'kb://doc/' || doc_id || '#chunk=0' AS citation FROM best JOIN documents USING (doc_id)",
)
def enrich(spark, sf):
    found = fusion.hybrid_search(_documents(spark, sf), _vectors(spark, sf), "doc_id", TERMS, query_vector(spark, sf), 20, ["text", "n_chars"])
    return fusion.cited(found, "doc_id").select("doc_id", "score", "text", "n_chars", "citation")


@query(
    "r11_search_with_totals",
    f"{_LEGS} SELECT doc_id, score, (SELECT count(*) FROM documents) AS total_documents, (SELECT count(*) FROM embeddings) AS total_chunks FROM best JOIN documents USING (doc_id)",
)
def search_totals(spark, sf):
    docs, vectors = _documents(spark, sf), _vectors(spark, sf)
    found = fusion.hybrid_search(docs, vectors, "doc_id", TERMS, query_vector(spark, sf), 20)
    totals = docs.agg(F.count(F.lit(1)).alias("total_documents")).crossJoin(F.broadcast(vectors.agg(F.count(F.lit(1)).alias("total_chunks"))))  # one row each
    return found.select("doc_id", "score").crossJoin(F.broadcast(totals))


@query(
    "r12_citations",
    "SELECT turn, conv_id, 'kb://doc/' || conv_id || '#chunk=' || turn || CASE WHEN role <> 'system' THEN '&page=' || turn ELSE '' END AS uri FROM conversations",
)
def citations(spark, sf):
    page = F.when(F.col("role") != "system", F.col("turn"))
    return table(spark, sf, "conversations").select("turn", "conv_id", T.citation("conv_id", "turn", page).alias("uri"))


@query(
    "r13_index_stats",
    """SELECT n AS total_documents, v AS with_vector, round(100.0 * v / n, 2) AS vector_coverage, t AS with_terms, round(100.0 * t / n, 2) AS term_coverage FROM (
      SELECT count(*) AS n, count(e.vec_id) AS v, sum((d.text IS NOT NULL AND regexp_matches(d.text, '[\\p{L}\\p{N}]'))::INT)::BIGINT AS t FROM documents d LEFT JOIN embeddings e ON d.doc_id = e.vec_id)""".replace("\\\\", "\\"),
)
def index_stats(spark, sf):
    docs = _documents(spark, sf).join(table(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"), F.lit(1).alias("v")), "doc_id", "left")
    counts = docs.agg(F.count(F.lit(1)).alias("n"), F.count("v").alias("v"), F.count_if(F.size(T.search_terms("text")) > 0).alias("t"))
    share = lambda c: F.when(F.col("n") > 0, F.round(100.0 * F.col(c) / F.col("n"), 2)).otherwise(F.lit(0.0))
    return counts.select(F.col("n").alias("total_documents"), F.col("v").alias("with_vector"), share("v").alias("vector_coverage"), F.col("t").alias("with_terms"), share("t").alias("term_coverage"))


@query("r14_collection_stats", "SELECT count(*) AS n_vectors, min(len(embedding)) AS dims, 'embeddings' AS name, 'cosine' AS metric FROM embeddings")
def collection_stats(spark, sf):
    return table(spark, sf, "embeddings").agg(F.count(F.lit(1)).alias("n_vectors"), F.min(F.size("embedding")).cast("long").alias("dims"), F.lit("embeddings").alias("name"), F.lit("cosine").alias("metric"))


@query(
    "r15_chat_context",
    f"{_LEGS} SELECT '[' || row_number() OVER (ORDER BY score DESC, doc_id) || '] [source: ' || source || ' p.' || (doc_id % 7) || ']' || chr(10) || text AS block, doc_id FROM best JOIN documents USING (doc_id)",
)
def chat_context(spark, sf):
    found = fusion.hybrid_search(_documents(spark, sf), _vectors(spark, sf), "doc_id", TERMS, query_vector(spark, sf), 20, ["text", "source"]).drop("match")
    docs = _documents(spark, sf).select("doc_id", F.col("source").alias("path"), F.col("text").alias("body"))
    rows = docs.join(F.broadcast(found.select("doc_id", "score")), "doc_id").withColumn("n", F.row_number().over(W.orderBy(F.desc("score"), "doc_id")))  # twenty rows
    return rows.select(T.prompt_block(F.col("n"), F.col("path"), F.col("doc_id") % 7, F.col("body")).alias("block"), "doc_id")


@query("f03_date_range", "SELECT event_id, ts FROM events WHERE ts >= TIMESTAMP '2024-01-05 00:00:00' AND ts <= TIMESTAMP '2024-01-09 12:00:00' AND user_id = 7")
def date_range(spark, sf):
    keep = fusion.filters(doc_id=7, start="2024-01-05 00:00:00", end="2024-01-09 12:00:00", doc_col="user_id", ts_col="ts")
    return fusion.apply(table(spark, sf, "events"), keep).select("event_id", "ts")


@query("f03_bad_bound", "SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-20 00:00:00' AND event_type = 'click'")
def bad_bound(spark, sf):
    keep = fusion.filters(path="click", start="2024-01-20 00:00:00", end="not a date", path_col="event_type", ts_col="ts")
    return fusion.apply(table(spark, sf, "events"), keep).select("event_id")


@query("f04_filter_conjunction", "SELECT d.doc_id, d.lang FROM documents d JOIN labels l ON d.doc_id = l.doc_id WHERE d.lang = 'de' AND l.quality = 1 AND l.toxic = 0")
def filter_conjunction(spark, sf):
    keep = fusion.conjunction([F.col("lang") == "de", None, F.col("quality") == 1, F.col("toxic") == 0])
    return _documents(spark, sf).join(table(spark, sf, "labels"), "doc_id").where(keep).select("doc_id", "lang")


@query("j03_full_outer_legs", "SELECT coalesce(d.doc_id, e.vec_id) AS doc_id, d.doc_id IS NOT NULL AS in_documents, e.vec_id IS NOT NULL AS in_vectors FROM (SELECT * FROM documents WHERE doc_id >= 200) d FULL OUTER JOIN embeddings e ON d.doc_id = e.vec_id")
def full_outer(spark, sf):
    d = _documents(spark, sf).where("doc_id >= 200").select("doc_id", F.lit(True).alias("d"))
    e = _vectors(spark, sf).select("doc_id", F.lit(True).alias("e"))
    return d.join(e, "doc_id", "full_outer").select("doc_id", F.coalesce("d", F.lit(False)).alias("in_documents"), F.coalesce("e", F.lit(False)).alias("in_vectors"))


@query("x12_cosine", "SELECT a.vec_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS cosine FROM embeddings a JOIN embeddings b ON a.vec_id + 1 = b.vec_id")
def cosine(spark, sf):
    e = table(spark, sf, "embeddings")
    b = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return e.join(b, "vec_id").select("vec_id", F.round(V.cosine(F.col("embedding"), F.col("other")), 6).alias("cosine"))


@query("x13_similarity_maps", f"WITH {_NEAR} SELECT vec_id, round(greatest(0, 1 - distance / 2), 6) AS half, round(1 - distance / 2, 6) AS half_raw, round(greatest(0, 1 - distance), 6) AS full_map FROM nn")
def similarity_maps(spark, sf):
    d = 1 - V.cosine(F.col("embedding"), vector_search.literal(query_vector(spark, sf)))
    rows = table(spark, sf, "embeddings").select("vec_id", d.alias("d"))
    return rows.select("vec_id", F.round(V.half_similarity(F.col("d")), 6).alias("half"), F.round(V.half_similarity(F.col("d"), False), 6).alias("half_raw"), F.round(V.full_similarity(F.col("d")), 6).alias("full_map"))


@query("x36_dimension_check", "SELECT vec_id, CASE WHEN len(embedding) = 64 THEN round(list_sum(embedding::DOUBLE[]), 5) END AS total FROM embeddings")
def dimension_check(spark, sf):
    total = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double"))
    return table(spark, sf, "embeddings").select("vec_id", F.when(F.size("embedding") == 64, F.round(total, 5)).alias("total"))


@query("r02_lsh_topk")
def lsh_topk(spark, sf):
    return vector_search.approximate_nearest(table(spark, sf, "embeddings"), "vec_id", query_vector(spark, sf), 10).withColumn("distance", F.round("distance", 6))


_RESULTS = """res AS (SELECT l_orderkey AS chunk_id, l_suppkey AS doc_id, l_extendedprice AS score, l_shipdate, l_partkey FROM lineitem)"""


def _results(spark, sf):
    return table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("chunk_id"), F.col("l_suppkey").alias("doc_id"), F.col("l_extendedprice").alias("score"))


@query("w02_dedup_best", f"WITH {_RESULTS} SELECT chunk_id, max(score) AS score FROM res GROUP BY chunk_id")
def dedup_best(spark, sf):
    return context.dedup_best(_results(spark, sf), [], "chunk_id", "score").select("chunk_id", "score")


@query(
    "w01_diversity_cap",
    f"WITH {_RESULTS}, best AS (SELECT chunk_id, doc_id, score FROM res QUALIFY row_number() OVER (PARTITION BY chunk_id ORDER BY score DESC, doc_id) = 1) SELECT chunk_id, doc_id, score FROM best QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, chunk_id) <= 3",
)
def diversity_cap(spark, sf):
    rank = F.row_number().over(W.partitionBy("chunk_id").orderBy(F.desc("score"), "doc_id"))
    best = _results(spark, sf).withColumn("r", rank).where("r = 1").drop("r")
    return context.cap_per_document(best, [], "doc_id", "chunk_id", "score", 3)


@query("w03_max_norm", "SELECT o_orderkey, round(o_totalprice / max(o_totalprice) OVER (PARTITION BY o_orderpriority), 6) AS score FROM orders")
def max_norm(spark, sf):
    best = F.max("o_totalprice").over(W.partitionBy("o_orderpriority"))
    return table(spark, sf, "orders").select("o_orderkey", F.round(F.col("o_totalprice") / best, 6).alias("score"))


@query(
    "q12_context_pack",
    f"""WITH RECURSIVE {_BATCH}, res AS (
  SELECT item_id, doc_id, source, score, floor(len([x for x in regexp_split_to_array(coalesce(text, ''), '[ \\t\\n\\x0B\\f\\r]+') if x <> '']) * 1.3)::BIGINT AS tokens,
         row_number() OVER (PARTITION BY item_id, source ORDER BY score DESC, doc_id) AS nth
  FROM ranked JOIN documents USING (doc_id) WHERE rank <= 30
), ord AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS k FROM res WHERE nth <= 3),
g AS (
  SELECT DISTINCT item_id, 0::BIGINT AS k, 0::BIGINT AS total, 0::BIGINT AS n, false AS taken FROM ord
  UNION ALL
  SELECT ord.item_id, ord.k, CASE WHEN total + tokens + (ord.k > 1)::INT <= 3900 THEN total + tokens + (ord.k > 1)::INT ELSE total END,
         n + (total + tokens + (ord.k > 1)::INT <= 3900)::INT, total + tokens + (ord.k > 1)::INT <= 3900
  FROM g JOIN ord ON ord.item_id = g.item_id AND ord.k = g.k + 1
)
SELECT g.item_id, doc_id AS chunk_id, source, score, tokens, (g.n - 1)::INT AS position, (max(g.total) OVER (PARTITION BY g.item_id))::BIGINT AS total_tokens
FROM g JOIN ord ON g.item_id = ord.item_id AND g.k = ord.k WHERE taken""",
)
def context_pack(spark, sf):
    found = keyword.bm25_batch(_documents(spark, sf), "doc_id", table(spark, sf, "benchmark"), "item_id", "text", 30)
    rows = found.join(_documents(spark, sf).select("doc_id", "text", "source"), "doc_id").withColumn("chunk_id", F.col("doc_id"))
    return context.assemble(rows, ["item_id"], "chunk_id", "source").select("item_id", "chunk_id", "source", "score", "tokens", "position", "total_tokens")


@query("a16_context_size", "SELECT sum(t)::BIGINT AS total_tokens, round(avg(t), 4) AS avg_tokens, min(t) AS min_tokens, max(t) AS max_tokens, count(*) AS n_chunks FROM (SELECT floor(length(text) / 4)::BIGINT AS t FROM documents)")
def context_size(spark, sf):
    rows = _documents(spark, sf).select(T.token_estimates("text")["by_chars"].alias("t"))
    return context.size_estimate(rows, "t")


@query("u06_sources_used", "SELECT lang, array_to_string(list_sort(list_distinct(list(source))), ',') AS sources FROM documents GROUP BY lang")
def sources_used(spark, sf):
    return _documents(spark, sf).groupBy("lang").agg(F.array_join(F.array_sort(F.collect_set("source")), ",").alias("sources"))


@query(
    "x20_chunk_header",
    """SELECT doc_id, '[Source: ' || source || CASE WHEN doc_id % 3 = 0 THEN ' | Page ' || (doc_id % 10) ELSE '' END || CASE WHEN doc_id % 2 = 0 THEN ' | Section: ' || lang ELSE '' END || ' | Relevance: ' || printf('%.2f', (doc_id % 100) / 97.0) || ']' || chr(10) || text AS block FROM documents""",
)
def chunk_headers(spark, sf):
    page, section = F.when(F.col("doc_id") % 3 == 0, F.col("doc_id") % 10), F.when(F.col("doc_id") % 2 == 0, F.col("lang"))
    return _documents(spark, sf).select("doc_id", T.chunk_header(F.col("source"), page, section, (F.col("doc_id") % 100) / 97.0, F.col("text")).alias("block"))


@query("x22_context_block", "SELECT doc_id, '[Context ' || doc_id || '] (Source: ' || source || ', Relevance: ' || printf('%.2f', (doc_id % 100) / 97.0) || ')' || chr(10) || text AS block FROM documents")
def context_blocks(spark, sf):
    return _documents(spark, sf).select("doc_id", T.context_block(F.col("doc_id"), F.col("source"), (F.col("doc_id") % 100) / 97.0, F.col("text")).alias("block"))


@query("x39_match_ratio", "SELECT doc_id, least(1.0, (contains(lower(text), 'the')::INT + contains(lower(text), 'und')::INT + contains(lower(text), 'con')::INT) / 3.0)::DOUBLE AS ratio FROM documents")
def match_ratio(spark, sf):
    lower = F.lower("text")
    return _documents(spark, sf).select("doc_id", F.least(F.lit(1.0), sum((lower.contains(w).cast("int") for w in ("the", "und", "con")), F.lit(0)) / F.lit(3.0)).alias("ratio"))
