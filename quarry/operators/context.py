"""Context assembly: duplicates, cap for each document, greedy token budget, formatting."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T

SEPARATOR = "\n\n---\n\n"
BUDGET, RESERVE, PER_DOCUMENT = 4000, 100, 3


def dedup_best(results: DataFrame, by: list[str], key: str, score: str) -> DataFrame:
    """The best row for each key, of equally good ones the first by its other columns as JSON; rows without a key are dropped."""
    rank = F.row_number().over(W.partitionBy(*by, key).orderBy(F.desc(score), F.to_json(F.struct("*"))))
    return results.where(F.col(key).isNotNull()).withColumn("__r", rank).where("__r = 1").drop("__r")


def cap_per_document(results: DataFrame, by: list[str], doc: str, key: str, score: str, most: int = PER_DOCUMENT) -> DataFrame:
    """The first ``most`` rows of each document by score; rows without a document are exempt."""
    exempt = F.when(F.col(doc).isNull(), F.xxhash64(key))  # they are many, perhaps, and needn't meet
    rank = F.row_number().over(W.partitionBy(*by, doc, exempt).orderBy(F.desc(score), key))
    return results.withColumn("__r", rank).where(F.col(doc).isNull() | (F.col("__r") <= most)).drop("__r")


def within_budget(results: DataFrame, by: list[str], key: str, score: str, cost: str, budget: int = BUDGET, reserve: int = RESERVE, separator_cost: int = 1) -> DataFrame:
    """Rows in order of score, each taken if it still fits and passed over if not; every row after the first pays for
    the separator.  One array for each query: its results are a top-k."""
    ordered = F.array_sort(F.collect_list(F.struct((-F.col(score)).alias("s"), F.col(key).alias("k"), F.col(cost).cast("long").alias("c"))))
    start = F.struct(F.lit(0).cast("long").alias("total"), F.lit(0).alias("at"), F.array().cast("array<bigint>").alias("taken"))

    def step(state, row):
        price = row["c"] + F.when(state["at"] > 0, F.lit(separator_cost)).otherwise(F.lit(0))
        fits = state["total"] + price <= budget - reserve
        return F.struct(
            F.when(fits, state["total"] + price).otherwise(state["total"]).alias("total"),
            (state["at"] + 1).alias("at"),
            F.when(fits, F.concat(state["taken"], F.array(row["k"].cast("bigint")))).otherwise(state["taken"]).alias("taken"),
        )

    packed = results.groupBy(*by).agg(F.aggregate(ordered, start, step).alias("p"))
    taken = packed.select(*by, F.col("p.total").alias("total_tokens"), F.posexplode("p.taken").alias("position", key))
    return results.join(taken, [*by, key])


def assemble(results: DataFrame, by: list[str], key: str = "chunk_id", doc: str = "doc_id", score: str = "score", text: str = "text", budget: int = BUDGET, most: int = PER_DOCUMENT) -> DataFrame:
    """Chosen rows with their position, tokens and the query's total."""
    rows = cap_per_document(dedup_best(results, by, key, score), by, doc, key, score, most)
    rows = rows.withColumn("tokens", T.token_estimates(text)["by_words"])
    return within_budget(rows, by, key, score, "tokens", budget)


def size_estimate(results: DataFrame, tokens: str) -> DataFrame:
    return results.agg(
        F.sum(tokens).alias("total_tokens"), F.round(F.avg(tokens), 4).alias("avg_tokens"), F.min(tokens).alias("min_tokens"), F.max(tokens).alias("max_tokens"), F.count(F.lit(1)).alias("n_chunks")
    )
