"""Graph queries over embeddings, whose labels stand for documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graph
from .registry import query, table

_CENTROIDS = "c AS (SELECT label, list(m ORDER BY i) AS v FROM (SELECT label, i, avg(x) AS m FROM (SELECT label, unnest(embedding::DOUBLE[]) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY label, i) GROUP BY label)"
_EDGES = f"WITH {_CENTROIDS}, e AS (SELECT a.label AS source, b.label AS target, list_cosine_similarity(a.v, b.v) AS weight FROM c a JOIN c b ON a.label < b.label) "


def _centroids(spark, sf):
    return graph.centroids(table(spark, sf, "embeddings"), "label")


def _edges(spark, sf, threshold=0.05):
    return graph.similar_pairs(_centroids(spark, sf), "label", threshold, "centroid")


@query("a11_centroids", f"WITH {_CENTROIDS} SELECT label, i, round(v[i], 6) AS x FROM c, range(1, 65) t(i)")
def centroids(spark, sf):
    return _centroids(spark, sf).select("label", F.posexplode("centroid").alias("p", "x")).select("label", (F.col("p") + 1).cast("long").alias("i"), F.round("x", 6).alias("x"))


@query("j11_similar_pairs", "SELECT a.vec_id AS source, b.vec_id AS target, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 5) AS weight FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id WHERE list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) >= 0.3")
def similar_pairs(spark, sf):
    return graph.similar_pairs(table(spark, sf, "embeddings"), "vec_id", 0.3).withColumn("weight", F.round("weight", 5))


@query("g02_graph_edges", _EDGES + "SELECT source, target, round(weight, 5) AS weight FROM e WHERE weight >= 0.05")
def graph_edges(spark, sf):
    return _edges(spark, sf).withColumn("weight", F.round("weight", 5))


@query("a12_degree", _EDGES + "SELECT node, count(*) AS degree FROM (SELECT source AS node FROM e WHERE weight >= 0.05 UNION ALL SELECT target FROM e WHERE weight >= 0.05) GROUP BY node")
def degree(spark, sf):
    return graph.degrees(_edges(spark, sf))


@query("t12_max_nodes", _EDGES + ", k AS (SELECT * FROM e WHERE weight >= 0.05), d AS (SELECT node, count(*) AS n FROM (SELECT source AS node FROM k UNION ALL SELECT target FROM k) GROUP BY node ORDER BY n DESC, node LIMIT 5) SELECT source, target FROM k WHERE source IN (SELECT node FROM d) AND target IN (SELECT node FROM d)")
def max_nodes(spark, sf):
    return graph.top_nodes(_edges(spark, sf), 5).select("source", "target")


@query("j12_tag_edges", "SELECT DISTINCT 'doc_' || doc_id AS source, 'tag_' || t AS target, 1.0::DOUBLE AS weight FROM (SELECT doc_id, unnest([lang, source]) AS t FROM documents)")
def tag_edges(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", F.array("lang", "source").alias("tags"))
    return graph.tag_edges(docs, "doc_id", "tags")


@query("j13_nodes_with_metrics", _EDGES + ", k AS (SELECT * FROM e WHERE weight >= 0.05), d AS (SELECT node, count(*) AS degree FROM (SELECT source AS node FROM k UNION ALL SELECT target FROM k) GROUP BY node) SELECT label, 'doc_' || label AS id, coalesce(degree, 0) AS degree FROM c LEFT JOIN d ON label = node")
def nodes_with_metrics(spark, sf):
    nodes = _centroids(spark, sf).select("label", F.concat(F.lit("doc_"), F.col("label").cast("string")).alias("id"))
    metrics = graph.degrees(_edges(spark, sf)).withColumnRenamed("node", "label")
    return nodes.join(metrics, "label", "left").select("label", "id", F.coalesce("degree", F.lit(0)).alias("degree"))


@query("g03_betweenness")
def betweenness(spark, sf):
    return graph.betweenness(_edges(spark, sf)).withColumn("betweenness", F.round("betweenness", 6))


@query("g04_communities")
def communities(spark, sf):
    return graph.communities(_edges(spark, sf))


_ROUNDS = ", ".join(
    f"""l{i} AS (SELECT source AS node, label FROM (SELECT source, label, row_number() OVER (PARTITION BY source ORDER BY count(*) DESC, label) AS r
    FROM ends JOIN l{i - 1} ON target = node GROUP BY source, label) WHERE r = 1)"""
    for i in range(1, 6)
)


@query(
    "g04_label_propagation",
    _EDGES + f""", near AS (SELECT source, target FROM e WHERE weight >= 0.05), ends AS (SELECT source, target FROM near UNION SELECT target, source FROM near),
    l0 AS (SELECT DISTINCT source AS node, source AS label FROM ends), {_ROUNDS} SELECT node, label AS community FROM l5""",
)
def label_propagation(spark, sf):
    return graph.label_propagation(_edges(spark, sf), 5)


@query("g06_graph_totals", _EDGES + "SELECT (SELECT count(*) FROM c) AS nodes, count(*) AS edges FROM e WHERE weight >= 0.05")
def graph_totals(spark, sf):
    edges = _edges(spark, sf).agg(F.count(F.lit(1)).alias("edges"))
    return table(spark, sf, "embeddings").agg(F.countDistinct("label").alias("nodes")).crossJoin(F.broadcast(edges))  # one row each
