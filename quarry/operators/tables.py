"""Mutations as DataFrame rewrites, snapshot differences, caches and quotas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def latest(rows: DataFrame, key: list[str], order: str, *tie: str) -> DataFrame:
    """The last row of each key."""
    rank = F.row_number().over(W.partitionBy(*key).orderBy(F.desc(order), *tie))
    return rows.withColumn("__r", rank).where("__r = 1").drop("__r")


def upsert(current: DataFrame, changes: DataFrame, key: list[str], required: list[str] | None = None) -> DataFrame:
    """Rows of ``changes`` replace or join those of ``current``; incomplete ones are dropped."""
    if required:
        changes = changes.na.drop(subset=required)
    return current.join(changes.select(*key), key, "left_anti").unionByName(changes)


def delete(current: DataFrame, gone: DataFrame, key: list[str]) -> DataFrame:
    return current.join(gone.select(*key), key, "left_anti")


def missing(rows: DataFrame, index: DataFrame, key: list[str]) -> DataFrame:
    """Rows that the index lacks (an anti join, never NOT IN)."""
    return rows.join(index.select(*key), key, "left_anti")


def snapshot_diff(now: DataFrame, before: DataFrame, key: str = "path", digest: str = "hash", status: str | None = None) -> DataFrame:
    """(key, outcome): new, modified, unchanged or deleted.

    A row that was deleted or failed before is modified if it is there now, and not deleted again if it isn't.
    """
    old = before.select(key, F.col(digest).alias("__old"), (F.col(status) if status else F.lit("ok")).alias("__status"), F.lit(True).alias("__was"))
    both = now.select(key, F.col(digest).alias("__new"), F.lit(True).alias("__is")).join(old, key, "full_outer")
    stale = F.col("__status").isin("deleted", "error")
    outcome = (
        F.when(F.col("__was").isNull(), "new")
        .when(F.col("__is").isNull(), F.when(F.col("__status") == "deleted", F.lit(None)).otherwise("deleted"))
        .when(stale | ~F.col("__new").eqNullSafe(F.col("__old")), "modified")
        .otherwise("unchanged")
    )
    return both.select(key, outcome.alias("outcome")).where("outcome is not null")


OUTCOMES = ["new", "modified", "unchanged", "deleted"]


def scan_statistics(outcomes: DataFrame, root: str) -> DataFrame:
    """Counts by outcome for each root and over all (root null)."""
    counts = [F.count_if(F.col("outcome") == o).alias(o) for o in OUTCOMES]
    return outcomes.rollup(root).agg(*counts, F.count_if(F.col("outcome") != "deleted").alias("scanned"))


def under(path: Column, root: str) -> Column:
    """Paths below a folder, whose name ends at a slash."""
    return path.startswith(root.rstrip("/") + "/")


def split_cache(chunks: DataFrame, cache: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Chunks with a stored vector, and distinct keys without one."""
    hits = chunks.join(cache, key)
    return hits, chunks.join(cache.select(key), key, "left_anti").dropDuplicates([key])


def running_quota(log: DataFrame, day: str, order: list[str], tokens: str, limit: int) -> DataFrame:
    """Adds used (running sum in order of arrival) and accepted (within the day's limit)."""
    used = F.sum(tokens).over(W.partitionBy(day).orderBy(*order).rowsBetween(W.unboundedPreceding, 0))
    return log.withColumn("used", used).withColumn("accepted", F.col("used") <= limit)


def daily_usage(log: DataFrame, day: str, tokens: str, limit: int) -> DataFrame:
    used = log.groupBy(day).agg(F.sum(tokens).alias("used"))
    return used.select(day, "used", F.greatest(F.lit(0), F.lit(limit) - F.col("used")).alias("remaining"), F.round(F.col("used") * 100.0 / limit, 4).alias("percent"))


def evict(cache: DataFrame, created: str, before: Column) -> DataFrame:
    return cache.where(F.col(created) >= before)
