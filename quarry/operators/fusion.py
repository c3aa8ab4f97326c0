"""Fusion of the keyword and the semantic leg, enrichment, filters."""

from __future__ import annotations

from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from .keyword import keyword_search, like_search
from .vector_search import nearest, semantic_search

KEYWORD_WEIGHT, SEMANTIC_WEIGHT = 0.3, 0.7


def conjunction(conditions: list[Column | None]) -> Column | None:
    """AND of the conditions that are there; None for none."""
    present = [c for c in conditions if c is not None]
    return reduce(lambda a, b: a & b, present) if present else None


def _bound(value: str | None, ts_type: str) -> Column | None:
    """A literal of the time column's type, so that the comparison reaches the scan; None where the text is no time."""
    try:
        return None if value is None else F.lit(datetime.fromisoformat(value).isoformat(" ")).cast(ts_type)
    except ValueError:
        return None


def filters(
    path: str | None = None, doc_id: int | None = None, start: str | None = None, end: str | None = None,
    path_col: str = "path", doc_col: str = "doc_id", ts_col: str = "modified_ts", ts_type: str = "timestamp_ntz",
) -> Column | None:
    """Path and document equality and an inclusive range of time; bounds that can't be read are ignored."""
    low, high = _bound(start, ts_type), _bound(end, ts_type)
    return conjunction([
        F.col(path_col) == path if path else None,
        F.col(doc_col) == int(doc_id) if doc_id is not None else None,
        F.col(ts_col) >= low if low is not None else None,
        F.col(ts_col) <= high if high is not None else None,
    ])


def apply(df: DataFrame, condition: Column | None) -> DataFrame:
    return df if condition is None else df.where(condition)


def fuse_sum(keyword: DataFrame, semantic: DataFrame, key: str, kw_weight: float = KEYWORD_WEIGHT, sem_weight: float = SEMANTIC_WEIGHT) -> DataFrame:
    """Weighted sum over the union of both legs; a missing score is 0, and the label tells which are above 0."""
    both = keyword.withColumnRenamed("score", "kw").join(semantic.withColumnRenamed("score", "sem"), key, "full_outer")
    both = both.select(key, F.coalesce("kw", F.lit(0.0)).alias("kw"), F.coalesce("sem", F.lit(0.0)).alias("sem"))
    label = F.when((F.col("kw") > 0) & (F.col("sem") > 0), "both").when(F.col("kw") > 0, "keyword").otherwise("semantic")
    return both.select(key, (kw_weight * F.col("kw") + sem_weight * F.col("sem")).alias("score"), label.alias("source"))


def fuse_average(keyword: DataFrame, semantic: DataFrame, key: str, kw_weight: float = KEYWORD_WEIGHT, sem_weight: float = SEMANTIC_WEIGHT) -> DataFrame:
    """Each leg weighted; where a chunk is in both, the mean of the two."""
    both = keyword.select(key, (F.col("score") * kw_weight).alias("kw")).join(semantic.select(key, (F.col("score") * sem_weight).alias("sem")), key, "full_outer")
    score = F.when(F.col("kw").isNotNull() & F.col("sem").isNotNull(), (F.col("kw") + F.col("sem")) / 2).otherwise(F.coalesce("kw", "sem"))
    label = F.when(F.col("kw").isNotNull() & F.col("sem").isNotNull(), "both").when(F.col("kw").isNotNull(), "keyword").otherwise("semantic")
    return both.select(key, score.alias("score"), label.alias("source"))


def top(scored: DataFrame, key: str, k: int) -> DataFrame:
    """Best ``k`` by score as it is shown (4 places), ties by key."""
    return scored.withColumn("score", F.round("score", 4)).orderBy(F.desc("score"), key).limit(k)


def enrich(scored: DataFrame, chunks: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Columns of the chunks for scored keys; keys without a chunk are dropped.  ``scored`` is a top-k result."""
    return chunks.select(key, *columns).join(F.broadcast(scored), key)


def hybrid_search(chunks: DataFrame, vectors: DataFrame, key: str, query: list[str], vector: list[float], k: int = 20, columns: list[str] | None = None) -> DataFrame:
    """Both legs with 3k candidates each, summed, the best k enriched."""
    fused = fuse_sum(keyword_search(chunks, key, query, 3 * k), semantic_search(vectors, key, vector, 3 * k), key)
    return enrich(top(fused, key, k), chunks, key, columns or [])


def hybrid_search_average(chunks: DataFrame, vectors: DataFrame, key: str, query: str, vector: list[float], k: int = 20) -> DataFrame:
    """Substring and vector legs with k candidates each, averaged where both find a chunk."""
    semantic = nearest(vectors, key, vector, k).select(key, (1 - F.col("distance") / 2).alias("score"))
    return top(fuse_average(like_search(chunks, key, query, limit=k), semantic, key), key, k)


def cited(results: DataFrame, key: str, seq: Column | None = None) -> DataFrame:
    return results.withColumn("citation", T.citation(key, F.lit(0) if seq is None else seq))
