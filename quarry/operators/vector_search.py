"""Nearest neighbours by cosine distance, exact or through random hyperplanes."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vectors as V

MOST_RESULTS = 1000
#: Bits by which a probed bucket may differ from the query's own.
FLIPS = 1


def literal(vector: list[float]) -> Column:
    return F.array(*[F.lit(float(x)) for x in vector])


def nearest(vectors: DataFrame, key: str, query: list[float], k: int = 10, embedding: str = "embedding") -> DataFrame:
    """(key, distance): the ``min(k, 1000)`` nearest; a partial top-k in each task, then one merge."""
    distance = 1 - V.cosine(F.col(embedding), literal(query))
    scored = vectors.where(F.size(embedding) == len(query)).select(key, distance.alias("distance"))
    return scored.orderBy(F.asc("distance"), key).limit(min(k, MOST_RESULTS))


def semantic_search(vectors: DataFrame, key: str, query: list[float], k: int = 100, embedding: str = "embedding") -> DataFrame:
    return nearest(vectors, key, query, k, embedding).select(key, V.half_similarity(F.col("distance")).alias("score"))


def hyperplane_buckets(vectors: DataFrame, dims: int, tables: int = 12, bits: int = 6, seed: int = 42, embedding: str = "embedding") -> DataFrame:
    """(table, bucket) rows for each vector; near vectors share a bucket in some table with high probability."""
    rng = np.random.default_rng(seed)
    signs = []
    for t in range(tables):
        planes = rng.standard_normal((bits, dims))
        code = sum((F.when(V.dot(F.col(embedding), literal(p.tolist())) >= 0, F.lit(1 << b)).otherwise(F.lit(0)) for b, p in enumerate(planes)), F.lit(0))
        signs.append(F.struct(F.lit(t).alias("table"), code.alias("bucket")))
    return vectors.withColumn("__b", F.explode(F.array(*signs))).select("*", "__b.table", "__b.bucket").drop("__b")


def approximate_nearest(vectors: DataFrame, key: str, query: list[float], k: int = 10, embedding: str = "embedding", tables: int = 12, bits: int = 6, flips: int = FLIPS, **index) -> DataFrame:
    """Neighbours among the vectors that in some table differ from the query in ``flips`` bits at most, by their exact distance."""
    spark = vectors.sparkSession
    index |= {"tables": tables, "bits": bits, "embedding": embedding}
    asked = spark.createDataFrame([(query,)], f"{embedding} array<double>")
    masks = F.array(*[F.lit(m) for m in range(1 << bits) if m.bit_count() <= flips])
    of_query = hyperplane_buckets(asked, len(query), **index).withColumn("mask", F.explode(masks)).select("table", F.col("bucket").bitwiseXOR(F.col("mask")).alias("bucket"))
    near = hyperplane_buckets(vectors, len(query), **index).join(F.broadcast(of_query), ["table", "bucket"], "left_semi")  # a row for each table and mask
    return nearest(near.dropDuplicates([key]).drop("table", "bucket"), key, query, k, embedding)
