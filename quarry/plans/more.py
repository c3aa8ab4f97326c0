"""Queries whose SQL takes a little more: greedy budgets, normalisation, parsers of generated files, providers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import embedding
from ..functions import text as T
from ..operators import context, graph
from ..sources import parsers
from .registry import query, table


@query(
    "w07_token_budget",
    """WITH RECURSIVE r AS (
  SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k, greatest(1, length(text) // 4) AS c FROM conversations
), g AS (
  SELECT DISTINCT conv_id, 0::BIGINT AS k, 0::BIGINT AS total, false AS taken FROM r
  UNION ALL
  SELECT r.conv_id, r.k, CASE WHEN total + c + (r.k > 1)::INT <= 500 THEN total + c + (r.k > 1)::INT ELSE total END, total + c + (r.k > 1)::INT <= 500
  FROM g JOIN r ON r.conv_id = g.conv_id AND r.k = g.k + 1
)
SELECT g.conv_id, r.turn, r.c AS tokens FROM g JOIN r ON g.conv_id = r.conv_id AND g.k = r.k WHERE taken""",
)
def token_budget(spark, sf):
    rows = table(spark, sf, "conversations").select("conv_id", "turn", (-F.col("turn")).cast("double").alias("score"), T.token_estimates("text")["by_chars_floor"].alias("tokens"))
    return context.within_budget(rows, ["conv_id"], "turn", "score", "tokens", 600).select("conv_id", "turn", "tokens")


@query(
    "x01_normalize_text",
    r"""SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(nfc_normalize(text), '[\x00-\x08\x0B-\x1F\x7F-\x9F\p{Cf}\p{Co}]', '', 'g'), '[ \t]+', ' ', 'g'), '\n{3,}', E'\n\n', 'g'), '^[ \t\n\r\f\v]+|[ \t\n\r\f\v]+$', '', 'g') AS text FROM documents""",
)
def normalize(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.normalize_text("text").alias("text"))


@query(
    "x02_simple_sentences",
    r"""SELECT doc_id, len([s for s in [trim(x, E' \t\n\r\f\v') for x in string_split(regexp_replace(text, '([.!?])[ \t\n\x0B\f\r]+', '\1' || chr(1), 'g'), chr(1))] if s <> ''])::BIGINT AS n FROM documents""",
)
def simple_sentences(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.size(T.simple_sentences("text")).cast("long").alias("n"))


@query("s12_csv_files", "SELECT r_name AS path, count(*) AS n_rows, 2::BIGINT AS n_columns FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name")
def csv_files(spark, sf):
    """One CSV file for each region, delimited by semicolons, parsed back."""
    nations = table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    lines = nations.groupBy("r_name").agg(F.array_join(F.array_sort(F.collect_list(F.concat("n_name", F.lit(";"), F.col("n_nationkey").cast("string")))), "\n").alias("body"))
    files = lines.select(F.concat("r_name", F.lit(".csv")).alias("path"), F.encode(F.concat(F.lit("name;key\n"), "body"), "UTF-8").alias("content"))
    found = parsers.parse_files(files).where("kind = 'header'")
    return found.select(F.regexp_replace("path", r"\.csv$", "").alias("path"), F.col("metadata")["rows"].cast("long").alias("n_rows"), F.col("metadata")["columns"].cast("long").alias("n_columns"))


@query("s14_notebooks", "SELECT conv_id, sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END)::BIGINT AS markdown, sum(CASE WHEN role <> 'user' THEN 1 ELSE 0 END)::BIGINT AS code FROM conversations GROUP BY conv_id")
def notebooks(spark, sf):
    """One notebook for each conversation: questions as markdown, the rest as code, parsed back."""
    cell = F.struct(F.when(F.col("role") == "user", "markdown").otherwise("code").alias("cell_type"), F.concat(F.lit("x "), F.col("turn").cast("string")).alias("source"))
    books = table(spark, sf, "conversations").groupBy("conv_id").agg(F.to_json(F.struct(F.collect_list(cell).alias("cells"), F.lit(4).alias("nbformat"))).alias("json"))
    files = books.select(F.concat(F.col("conv_id").cast("string"), F.lit(".ipynb")).alias("path"), F.encode("json", "UTF-8").alias("content"))
    found = parsers.parse_files(files).groupBy("path").agg(F.count_if(F.col("kind") == "markdown").alias("markdown"), F.count_if(F.col("kind") == "code").alias("code"))
    return found.select(F.regexp_replace("path", r"\.ipynb$", "").cast("long").alias("conv_id"), "markdown", "code")


@query("p09_embed_missing", "SELECT count(*) AS chunks, count(DISTINCT lower(trim(text, E' \\t\\n\\r\\f\\v'))) AS vectors FROM conversations")
def embed_missing(spark, sf):
    """Chunks that get a vector, and the distinct texts that the provider saw."""
    chunks = table(spark, sf, "conversations").select(F.struct("conv_id", "turn").alias("s"), "text").withColumn("id", F.to_json("s"))
    cache = spark.createDataFrame([], "cache_key string, embedding array<double>")
    vectors, fresh = embedding.embed_chunks(chunks, cache, embedding.provider("hashing", dimensions=16), "id")
    counts = vectors.agg(F.count(F.lit(1)).alias("chunks"))
    return counts.crossJoin(F.broadcast(fresh.agg(F.count(F.lit(1)).alias("vectors"))))  # one row each


@query("g01_graph_nodes", "SELECT 'doc_' || label AS id, 'document' AS type FROM (SELECT DISTINCT label FROM embeddings) UNION ALL SELECT 'tag_' || t, 'tag' FROM (SELECT DISTINCT lang AS t FROM documents)")
def graph_nodes(spark, sf):
    docs = graph.centroids(table(spark, sf, "embeddings"), "label").select(F.concat(F.lit("doc_"), F.col("label").cast("string")).alias("id"), F.lit("document").alias("type"))
    tags = graph.tag_edges(table(spark, sf, "documents").select("doc_id", F.array("lang").alias("tags")), "doc_id", "tags")
    return docs.unionAll(tags.select(F.col("target").alias("id"), F.lit("tag").alias("type")).distinct())
