"""Keyword search: BM25 over postings, and substring search."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T

K1, B, LEAST_IDF = 1.2, 0.75, 1e-6


def postings(chunks: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, term, tf, dl) of every term of every chunk."""
    terms = chunks.select(key, T.search_terms(text).alias("terms"))
    rows = terms.select(key, F.size("terms").cast("long").alias("dl"), F.explode("terms").alias("term"))
    return rows.groupBy(key, "term", "dl").agg(F.count(F.lit(1)).alias("tf"))


def _term_counts(chunks: DataFrame, key: str, terms: list[str], text: str) -> DataFrame:
    """Counts of the sought terms only, in one pass: nothing else of a text is exploded or shuffled."""
    found = chunks.select(key, T.search_terms(text).alias("terms"))
    count = lambda w: F.size(F.filter("terms", lambda t: t == w)).cast("long")
    return found.select(key, F.size("terms").cast("long").alias("dl"), *[count(w).alias(f"tf{i}") for i, w in enumerate(terms)])


def bm25_term(tf: Column, dl: Column, avgdl: Column, n_docs: Column, df: Column) -> Column:
    idf = F.log((n_docs - df + 0.5) / (df + 0.5))
    idf = F.when(idf <= 0, F.lit(LEAST_IDF)).otherwise(idf)
    return idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / avgdl))


def bm25(chunks: DataFrame, key: str, query: list[str], text: str = "text") -> DataFrame:
    """(key, bm25) of chunks that hold all terms of the query."""
    counts = _term_counts(chunks, key, query, text)
    numbers = counts.agg(
        F.count(F.lit(1)).alias("n_docs"), F.avg("dl").alias("avgdl"), *[F.sum((F.col(f"tf{i}") > 0).cast("long")).alias(f"df{i}") for i in range(len(query))]
    )
    every = reduce(lambda a, b: a & b, [F.col(f"tf{i}") > 0 for i in range(len(query))])
    score = reduce(lambda a, b: a + b, [bm25_term(F.col(f"tf{i}"), F.col("dl"), F.col("avgdl"), F.col("n_docs"), F.col(f"df{i}")) for i in range(len(query))])
    return counts.where(every).crossJoin(F.broadcast(numbers)).select(key, score.alias("bm25"))  # one row


def keyword_search(chunks: DataFrame, key: str, query: list[str], limit: int = 100, text: str = "text") -> DataFrame:
    """(key, score): the best ``limit`` chunks, scores divided by the greatest; the best come first."""
    if not query:
        return chunks.select(key, F.lit(0.0).alias("score")).limit(0)
    top = bm25(chunks, key, query, text).orderBy(F.desc("bm25"), key).limit(limit)
    best = F.max("bm25").over(W.partitionBy())  # over ``limit`` rows
    score = F.when(best > 0, F.col("bm25") / best).otherwise(F.col("bm25"))
    return top.select(key, score.alias("score")).orderBy(F.desc("score"), key)


def bm25_batch(chunks: DataFrame, key: str, queries: DataFrame, query_key: str, query_text: str, limit: int, text: str = "text") -> DataFrame:
    """The best ``limit`` chunks for each of many queries, any term of the query counting."""
    wanted = queries.select(query_key, F.explode(F.array_distinct(T.search_terms(query_text))).alias("term"))
    index = postings(chunks, key, text).join(wanted.select("term").distinct(), "term", "left_semi")
    numbers = chunks.agg(F.count(F.lit(1)).alias("n_docs"), F.avg(F.size(T.search_terms(text))).alias("avgdl"))
    dfs = index.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    weighed = index.join(dfs, "term").crossJoin(F.broadcast(numbers))  # one row
    weighed = weighed.select(key, "term", bm25_term(F.col("tf"), F.col("dl"), F.col("avgdl"), F.col("n_docs"), F.col("df")).alias("part"))
    scored = wanted.join(weighed, "term").groupBy(query_key, key).agg(F.round(F.sum("part"), 6).alias("score"))
    rank = F.row_number().over(W.partitionBy(query_key).orderBy(F.desc("score"), key))
    return scored.withColumn("rank", rank.cast("long")).where(F.col("rank") <= limit)


def like_search(chunks: DataFrame, key: str, query: str, text: str = "text", title: str | None = None, limit: int | None = None) -> DataFrame:
    """Chunks that hold every word of the query in text or title; the score is the share of words in the text."""
    words = query.lower().split()
    lower = F.lower(F.coalesce(F.col(text), F.lit("")))
    where = [lower.contains(w) if title is None else lower.contains(w) | F.lower(F.coalesce(F.col(title), F.lit(""))).contains(w) for w in words]
    share = reduce(lambda a, b: a + b, [lower.contains(w).cast("int") for w in words]) / len(words)
    found = chunks.where(reduce(lambda a, b: a & b, where)).select(key, F.least(F.lit(1.0), share).alias("score"))
    return found if limit is None else found.orderBy(F.desc("score"), key).limit(limit)
