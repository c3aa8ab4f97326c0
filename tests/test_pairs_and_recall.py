"""Similar pairs at the query's own threshold beyond one block, and the recall of approximate search."""

import random

import pytest
from pyspark.sql import functions as F

from quarry.functions import vectors as V
from quarry.operators import graph, vector_search


def test_all_pairs_in_blocks(spark):
    rng = random.Random(1)
    rows = [(i, [rng.gauss(0, 1) for _ in range(8)]) for i in range(120)] + [(200, [0.0] * 8), (201, None), (202, [1.0, 2.0]), (203, [2.0, 4.0])]
    df = spark.createDataFrame(rows, "id long, embedding array<double>")
    a, b = df.selectExpr("id AS source", "embedding AS x"), df.selectExpr("id AS target", "embedding AS y")
    every = a.join(b, F.col("source") < F.col("target")).where("size(x) = size(y)").withColumn("weight", V.dot(V.unit(F.col("x")), V.unit(F.col("y")))).where("weight >= 0.3")
    want = {(r.source, r.target): r.weight for r in every.collect()}
    for most in (5000, 5):
        found = graph.similar_pairs(df, "id", 0.3, all_pairs=most).collect()
        assert len(found) == len(want) and {(r.source, r.target): r.weight for r in found} == pytest.approx(want)


def test_query_recall(spark):
    """What r02_lsh_topk runs, against brute force."""
    from quarry.plans import retrieval
    from quarry.plans.registry import query_vector

    sf = "/root/testdata/sf0.1"
    e = spark.read.parquet(f"{sf}/embeddings.parquet")
    exact = {r.vec_id for r in vector_search.nearest(e, "vec_id", query_vector(spark, sf), 10).collect()}
    assert len(exact & {r.vec_id for r in retrieval.lsh_topk(spark, sf).collect()}) >= 0.9 * 10
