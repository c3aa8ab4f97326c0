"""Document graphs: centroids, similarity edges, degree, betweenness, communities."""

from __future__ import annotations

from collections import defaultdict, deque
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..session import ship

#: So many vectors a block is to hold at most.
ALL_PAIRS, EXACT_BETWEENNESS, SAMPLED_SOURCES = 5000, 100, 100
#: Blocks at least; rows of a product; what a product may differ from the sum in order.
LEAST_BLOCKS, PRODUCT_ROWS, SLACK = 8, 512, 1e-9


def centroids(vectors: DataFrame, owner: str, embedding: str = "embedding") -> DataFrame:
    """(owner, centroid): element-wise means; vectors of another length than the owner's longest are left out by null."""
    parts = vectors.select(owner, F.posexplode(embedding).alias("i", "x"))
    means = parts.groupBy(owner, "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    ordered = F.array_sort(F.collect_list(F.struct("i", "m")))
    return means.groupBy(owner).agg(F.transform(ordered, lambda p: p["m"]).alias("centroid"))


def _block_pairs(threshold: float):
    """Pairs within the blocks of two numbers, or between them, from (i, j, own, key, u) rows of one (i, j, length)."""

    def run(whole: pa.Table) -> pa.Table:
        own, keys = whole["own"].to_numpy(), whole["key"].combine_chunks()
        units = pc.list_flatten(whole["u"]).to_numpy().reshape(whole.num_rows, -1) if len(pc.list_flatten(whole["u"])) else np.zeros((whole.num_rows, 0))
        i, j = whole["i"][0].as_py(), whole["j"][0].as_py()
        left, right = np.flatnonzero(own == i), np.flatnonzero(own == j)
        found: list[list[np.ndarray]] = [[], [], []]
        for at in range(0, len(left), PRODUCT_ROWS):
            rows = left[at : at + PRODUCT_ROWS]
            near = ~(units[rows] @ units[right].T < threshold - SLACK)
            if i == j:
                near &= rows[:, None] < right[None, :]
            x, y = np.nonzero(near)
            x, y = rows[x], right[y]
            weight = np.zeros(len(x))
            for d in range(units.shape[1]):  # in the order in which V.dot adds
                weight += units[x, d] * units[y, d]
            kept = ~(weight < threshold)
            for column, part in zip(found, (x[kept], y[kept], weight[kept])):
                column.append(part)
        x, y, weight = (np.concatenate(c) if c else np.zeros(0, np.int64) for c in found)
        return pa.table({"a": keys.take(pa.array(x, pa.int64())), "b": keys.take(pa.array(y, pa.int64())), "weight": pa.array(weight, pa.float64())})

    return run


def similar_pairs(vectors: DataFrame, key: str, threshold: float, embedding: str = "embedding", all_pairs: int = ALL_PAIRS) -> DataFrame:
    """(source, target, weight) for pairs with source < target and cosine at the threshold or above.

    All vectors are compared at every size: dealt into blocks of about ``all_pairs`` at most, each pair of blocks one product.
    """
    ship(vectors.sparkSession)
    unit = vectors.select(F.col(key).alias("key"), V.unit(F.col(embedding)).alias("u")).where(F.col("key").isNotNull() & F.col("u").isNotNull() & ~F.exists("u", lambda x: x.isNull()))
    blocks = max(LEAST_BLOCKS, -(-vectors.count() // all_pairs))
    dealt = unit.withColumn("own", F.pmod(F.xxhash64("key"), F.lit(blocks)).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    dealt = dealt.select(F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "key", "u", F.size("u").alias("length"))
    kind = unit.schema["key"].dataType.simpleString()
    pairs = dealt.groupBy("i", "j", "length").applyInArrow(_block_pairs(threshold), f"a {kind}, b {kind}, weight double")
    return pairs.where("a <> b").select(F.least("a", "b").alias("source"), F.greatest("a", "b").alias("target"), "weight")


class GraphCache:
    """Built graphs by their parameters, each for ``seconds``; the caller gives the time, so that tests can."""

    def __init__(self, seconds: float) -> None:
        self.seconds = seconds
        self._held: dict = {}

    def get(self, parameters, now: float, build: Callable[[], DataFrame]) -> DataFrame:
        made, graph = self._held.get(parameters, (None, None))
        if made is None or now - made >= self.seconds:
            if graph is not None:
                graph.unpersist()
            graph = build().persist()
            self._held[parameters] = (now, graph)
        return graph

    def clear(self) -> None:
        for _, graph in self._held.values():
            graph.unpersist()
        self._held.clear()


def tag_edges(doc_tags: DataFrame, doc: str, tags: str) -> DataFrame:
    """Edges of weight 1 between documents and their tags, each once."""
    rows = doc_tags.select(F.concat(F.lit("doc_"), F.col(doc).cast("string")).alias("source"), F.explode(tags).alias("tag"))
    return rows.select("source", F.concat(F.lit("tag_"), "tag").alias("target"), F.lit(1.0).alias("weight")).distinct()


def degrees(edges: DataFrame) -> DataFrame:
    ends = edges.select(F.col("source").alias("node")).unionAll(edges.select(F.col("target").alias("node")))
    return ends.groupBy("node").agg(F.count(F.lit(1)).alias("degree"))


def top_nodes(edges: DataFrame, n: int) -> DataFrame:
    """The subgraph of the ``n`` nodes with the most edges."""
    kept = degrees(edges).orderBy(F.desc("degree"), "node").limit(n).select("node")
    by = lambda end: kept.withColumnRenamed("node", end)
    return edges.join(by("source"), "source", "left_semi").join(by("target"), "target", "left_semi")


def _adjacency(edges: DataFrame, most: int) -> dict:
    """The graph on the driver, its size checked."""
    rows = edges.select("source", "target", "weight").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} edges: take a subgraph first")
    near: dict = defaultdict(dict)
    for s, t, w in sorted(map(tuple, rows)):
        near[s][t] = near[t][s] = w
    return {k: near[k] for k in sorted(near)}


def _dependencies(near: dict, source) -> dict:
    """Brandes: what one source adds to each node."""
    order, before, paths, far = [], defaultdict(list), defaultdict(float), {source: 0}
    paths[source] = 1.0
    queue = deque([source])
    while queue:
        v = queue.popleft()
        order.append(v)
        for w in near[v]:
            if w not in far:
                far[w] = far[v] + 1
                queue.append(w)
            if far[w] == far[v] + 1:
                paths[w] += paths[v]
                before[w].append(v)
    owed: dict = defaultdict(float)
    for w in reversed(order):
        for v in before[w]:
            owed[v] += paths[v] / paths[w] * (1 + owed[w])
    owed.pop(source, None)
    return owed


def betweenness(edges: DataFrame, seed: int = 42, most_edges: int = 1_000_000) -> DataFrame:
    """(node, betweenness), normalised: exact up to 100 nodes, else from 100 sources drawn with a fixed seed.

    The adjacency goes to every task, its size checked; sources are dealt out and their parts summed.
    """
    spark = edges.sparkSession
    ship(spark)
    near = _adjacency(edges, most_edges)
    nodes = list(near)
    n = len(nodes)
    kind = edges.schema["source"].dataType.simpleString()
    if n <= EXACT_BETWEENNESS:
        chosen, scale = nodes, 1.0
    else:
        chosen = [nodes[i] for i in np.random.default_rng(seed).permutation(n)[:SAMPLED_SOURCES]]
        scale = n / len(chosen)
    norm = scale / ((n - 1) * (n - 2)) if n > 2 else 1.0
    sent = spark.sparkContext.broadcast(near)

    def parts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            rows = [(node, x) for source in frame["node"] for node, x in _dependencies(sent.value, source).items()]
            yield pd.DataFrame(rows, columns=["node", "part"])

    sources = spark.createDataFrame([(x,) for x in chosen], f"node {kind}").repartition(8)
    every = spark.createDataFrame([(x,) for x in nodes], f"node {kind}")
    sums = sources.mapInPandas(parts, f"node {kind}, part double").groupBy("node").agg(F.sum("part").alias("part"))
    return every.join(sums, "node", "left").select("node", (F.coalesce("part", F.lit(0.0)) * norm).alias("betweenness"))


def modularity(near: dict, community: dict) -> float:
    total = sum(w for v in near.values() for w in v.values())
    inside, ends = defaultdict(float), defaultdict(float)
    for v, out in near.items():
        for w, x in out.items():
            ends[community[v]] += x
            if community[v] == community[w]:
                inside[community[v]] += x
    return sum(inside[c] / total - (ends[c] / total) ** 2 for c in ends) if total else 0.0


def louvain(near: dict, seed: int = 42) -> dict:
    """Node to community: greedy gains in modularity, then the same on the graph of communities, until none is left."""
    rng = np.random.default_rng(seed)
    graph = {v: dict(out) for v, out in near.items()}
    member = {v: v for v in near}
    while True:
        total = sum(w for out in graph.values() for w in out.values())
        if not total:
            break
        weight = {v: sum(out.values()) for v, out in graph.items()}
        own, size = {v: v for v in graph}, dict(weight)
        moved, any_move = True, False
        nodes = list(graph)
        while moved:
            moved = False
            for i in rng.permutation(len(nodes)):
                v = nodes[i]
                links: dict = defaultdict(float)
                for w, x in graph[v].items():
                    if w != v:
                        links[own[w]] += x
                here = own[v]
                size[here] -= weight[v]
                best, gain = here, links.get(here, 0.0) - size[here] * weight[v] / total
                for c in sorted(links, key=str):
                    g = links[c] - size[c] * weight[v] / total
                    if g > gain + 1e-12:
                        best, gain = c, g
                size[best] += weight[v]
                if best != here:
                    own[v], moved, any_move = best, True, True
        if not any_move:
            break
        member = {v: own[c] for v, c in member.items()}
        folded: dict = {c: defaultdict(float) for c in dict.fromkeys(own.values())}
        for v, out in graph.items():
            for w, x in out.items():
                folded[own[v]][own[w]] += x
        graph = {c: dict(out) for c, out in folded.items()}
    names = {c: i for i, c in enumerate(dict.fromkeys(member[v] for v in near))}
    return {v: names[member[v]] for v in near}


def communities(edges: DataFrame, seed: int = 42, most_edges: int = 1_000_000) -> DataFrame:
    """(node, community) by Louvain with a fixed seed; the graph's size is checked before it comes to the driver."""
    kind = edges.schema["source"].dataType.simpleString()
    found = louvain(_adjacency(edges, most_edges), seed)
    return edges.sparkSession.createDataFrame(sorted(found.items()), f"node {kind}, community long")


def label_propagation(edges: DataFrame, rounds: int = 10) -> DataFrame:
    """(node, community) for graphs of any size: each node takes the most frequent label around it, the smallest at ties."""
    from pyspark.sql import Window as W

    both = edges.select("source", "target").unionAll(edges.select(F.col("target").alias("source"), F.col("source").alias("target"))).distinct().cache()  # each round reads it
    labels = both.select(F.col("source").alias("node")).distinct().withColumn("label", F.col("node"))
    for _ in range(rounds):
        seen = both.join(labels, both["target"] == labels["node"]).groupBy("source", "label").count()
        rank = F.row_number().over(W.partitionBy("source").orderBy(F.desc("count"), "label"))
        labels = seen.withColumn("r", rank).where("r = 1").select(F.col("source").alias("node"), "label")
    return labels.withColumnRenamed("label", "community")
