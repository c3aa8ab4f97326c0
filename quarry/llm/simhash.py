"""Near-duplicates by 64-bit SimHash and a Gray-order hierarchical index.

Distinct fingerprints are dealt into buckets such that any two within ``MAX_BITS`` = 2 meet in one: of four 16-bit
blocks at least two must agree, so each of the six pairs of blocks gives a bucket key.  A bucket leaves 32 bits free; one with
more than ``BUCKET_ROWS`` fingerprints is dealt again in the same way over its free bits, which leaves 16, so that no
bucket holds more than 2**16 fingerprints and a fingerprint has at most 529 neighbours in a bucket.  No link is lost.

In a task, all buckets of a block of rows form one forest.  Fingerprints are sorted by Gray rank, by which neighbours in
the order share most bits; a node stands for a run of nodes below and keeps the bits that all of them share, less
those that its parent has already.  A search goes down the levels, adds up the differences in each node's own bits and
drops the node with all below it once they exceed two.  Linked fingerprints are united in the task, and only one
edge for each member goes on to the distributed components.

``draws`` over 1 takes as many independent SimHashes of the same shingles (from the shingle's hash by a fixed mixing) and
links what any of them links, which finds looser copies with no wider radius.  Nodes are then still the first
fingerprints.

Defined cases: a null text counts as empty, and texts without words have fingerprint zero; equal fingerprints
are linked; a null doc_id gets a fingerprint and a component but never names one unless all ids there are null; an empty
table gives no rows; only ``doc_id`` and the text are read, so other columns can't clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .components import connected_components

SHINGLE_WORDS, SEED, MAX_BITS = 3, 42, 2
#: Buckets over this are dealt again; also the most that 16 free bits allow.
BUCKET_ROWS = 1 << 16
#: Children of an index node; rows indexed at a time; rows searched at a time (529 neighbours each at most).
FAN, INDEX_ROWS, SEARCH_ROWS = 8, 1 << 18, 1 << 12
BATCH_ROWS = 1024


def _mixed(x: np.ndarray, draw: int) -> np.ndarray:
    """Another 64-bit hash of each value (the finalizer of SplitMix64)."""
    x = x + np.uint64(draw * 0x9E3779B97F4A7C15 % (1 << 64))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def fingerprints(text: bytes, draws: int = 1, k: int = SHINGLE_WORDS, seed: int = SEED) -> list[int]:
    """Majority of the bits of the shingles' XXH64, and of further draws; ``text`` is UTF-8, of which A-Z are lower-cased."""
    words = text.lower().split()  # for bytes: ASCII letters, and the white space [\x20\x09-\x0D]
    if not words:
        return [0] * draws
    digest = xxhash.xxh64_digest
    if len(words) <= k:
        hashes = digest(b" ".join(words), seed)
    else:
        joined = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
        starts = np.concatenate(([0], ends[:-k])).tolist()
        hashes = b"".join([digest(joined[s:e], seed) for s, e in zip(starts, (ends[k - 1 :] - 1).tolist())])
    n = len(hashes) // 8
    ones = np.zeros((draws, 64), np.int64)
    for at in range(0, n, 4096):
        part = np.frombuffer(hashes, ">u8", min(4096, n - at), at * 8).astype(np.uint64)
        for draw in range(draws):
            own = (_mixed(part, draw) if draw else part).astype(">u8").view(np.uint8).reshape(-1, 8)
            ones[draw] += np.unpackbits(own, axis=1).sum(axis=0, dtype=np.int64)
    return [int.from_bytes(row.tobytes(), "big") for row in np.packbits(ones * 2 > n, axis=1)]


def fingerprint(text: bytes) -> int:
    return fingerprints(text)[0]


def _fingerprints(draws: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, BATCH_ROWS):
                batch = whole.slice(at, BATCH_ROWS)
                found = np.array([fingerprints(t, draws) for t in batch.column(1).cast(pa.binary()).to_pylist()], np.uint64).reshape(-1, draws)
                more = pa.array(list(found[:, 1:].view(np.int64)), pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.ascontiguousarray(found[:, 0]).view(np.int64)), more], names=["doc_id", "fp", "more"])

    return run


def gray_rank(x: np.ndarray) -> np.ndarray:
    """The place of a bit string in the reflected Gray order."""
    for shift in (1, 2, 4, 8, 16, 32):
        x = x ^ (x >> np.uint64(shift))
    return x


class GrayForest:
    """Hierarchical indexes over buckets of fingerprints, one tree a bucket, searched together."""

    def __init__(self, bucket: np.ndarray, fps: np.ndarray, fan: int = FAN) -> None:
        order = np.lexsort((gray_rank(fps), bucket))
        self.order, self.fps = order, fps[order]
        owner = bucket[order]
        both, either = self.fps, self.fps
        shared = np.full(len(fps), ~np.uint64(0))
        #: from the leaves up: the bits kept here, their pattern, the first child and the number of children
        self.levels: list[dict[str, np.ndarray]] = []
        while len(owner):
            new = np.ones(len(owner), bool)
            new[1:] = owner[1:] != owner[:-1]
            first = np.flatnonzero(new)
            place = np.arange(len(owner)) - first[np.cumsum(new) - 1]
            starts = np.flatnonzero(place % fan == 0)
            up_both, up_either = np.bitwise_and.reduceat(both, starts), np.bitwise_or.reduceat(either, starts)
            up_shared = ~(up_both ^ up_either)
            counts = np.diff(np.append(starts, len(owner)))
            parent = np.repeat(np.arange(len(starts)), counts)
            self.levels.append({"own": shared & ~up_shared[parent], "pattern": both, "first": starts, "count": counts, "parent": parent})
            at_top = len(first) == len(owner)
            owner, both, either, shared = owner[starts], up_both, up_either, up_shared
            if at_top:
                break
        self.root = np.arange(len(fps))
        for level in self.levels:
            self.root = level["parent"][self.root]

    def label(self, labels: np.ndarray) -> None:
        """Give each fingerprint (in Gray order) a label, so that searches can leave out groups of the query's own."""
        low = high = self.labels = labels
        for level in self.levels:
            level["low"], level["high"] = low, high
            low, high = np.minimum.reduceat(low, level["first"]), np.maximum.reduceat(high, level["first"])

    def search(self, query: np.ndarray, most: int, other_labels: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """(query, place) of all fingerprints in a query's bucket that differ in ``most`` bits at most; with
        ``other_labels``, of those whose label isn't the query's."""
        # a root's bits are shared by the query itself: no difference yet
        node, far = self.root[query], np.zeros(len(query), np.uint8)
        for level in reversed(self.levels):
            count = level["count"][node]
            query, far = np.repeat(query, count), np.repeat(far, count)
            begin = np.repeat(level["first"][node] - np.concatenate(([0], np.cumsum(count)[:-1])), count)
            node = begin + np.arange(len(begin))
            far = far + np.bitwise_count((self.fps[query] ^ level["pattern"][node]) & level["own"][node])
            near = far <= most
            if other_labels:
                near &= (level["low"][node] != self.labels[query]) | (level["high"][node] != self.labels[query])
            query, node, far = query[near], node[near], far[near]
        return query, node

    def pairs(self, most: int = MAX_BITS, rows: int = SEARCH_ROWS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Places i < j (in Gray order) of fingerprints in one bucket that differ in ``most`` bits at most."""
        for at in range(0, len(self.fps), rows):
            query, node = self.search(np.arange(at, min(at + rows, len(self.fps))), most)
            keep = query < node
            yield query[keep], node[keep]

    def edges(self, most: int = MAX_BITS) -> tuple[np.ndarray, np.ndarray]:
        """For each fingerprint that is linked to a smaller place in its bucket: that place and its own, as input rows."""
        label = np.arange(len(self.fps))
        for i, j in self.pairs(most):
            while True:
                low = np.minimum(label[i], label[j])
                if (label[label[i]] == low).all() and (label[label[j]] == low).all() and (label[i] == low).all() and (label[j] == low).all():
                    break
                for x in (label[i], label[j], i, j):
                    np.minimum.at(label, x, low)
                while (label[label] != label).any():
                    label = label[label]
        linked = np.flatnonzero(label != np.arange(len(label)))
        return self.order[label[linked]], self.order[linked]


def _bucket_edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by bucket; whole buckets are indexed, about ``INDEX_ROWS`` rows at a time."""

    def searched(bucket: np.ndarray, fps: np.ndarray, nodes: np.ndarray) -> pa.RecordBatch:
        new = np.ones(len(bucket) + 1, bool)
        new[1:-1] = bucket[1:] != bucket[:-1]
        with_others = ~(new[:-1] & new[1:])
        a, b = GrayForest(bucket[with_others], fps[with_others]).edges()
        nodes = nodes[with_others]
        return pa.RecordBatch.from_arrays([pa.array(nodes[a]), pa.array(nodes[b])], names=["a", "b"])

    held: list[list[np.ndarray]] = [[], [], []]
    rows = 0
    for batch in batches:
        for column, part in zip(held, batch.columns):
            column.append(part.to_numpy(zero_copy_only=False))
        rows += batch.num_rows
        if rows >= INDEX_ROWS:
            bucket, fps, nodes = map(np.concatenate, held)
            cut = int(np.searchsorted(bucket, bucket[-1], "left"))
            if cut:
                yield searched(bucket[:cut], fps[:cut].view(np.uint64), nodes[:cut])
            held, rows = [[bucket[cut:]], [fps[cut:]], [nodes[cut:]]], len(bucket) - cut
    if rows:
        bucket, fps, nodes = map(np.concatenate, held)
        yield searched(bucket, fps.view(np.uint64), nodes)


_PAIRS = [(i, j) for i in range(4) for j in range(i + 1, 4)]


def _keys(width: int, at: list[int]):
    """The two blocks of each of the six pairs of four blocks of ``width`` bits that begin at the given bits."""
    part = lambda bit: F.shiftrightunsigned("fp", bit).bitwiseAND(F.lit((1 << width) - 1))
    return [(k, F.shiftleft(part(at[i]), width).bitwiseOR(part(at[j]))) for k, (i, j) in enumerate(_PAIRS)]


def _buckets(fps: DataFrame, bucket_rows: int) -> DataFrame:
    """(bucket, fp, node) rows of (draw, fp, node): 16-bit blocks first, and 8-bit blocks of the free bits in buckets that are too large."""
    six = F.lit(len(_PAIRS))
    first = F.array(*[v + F.shiftleft((F.col("draw") * six + F.lit(k)).cast("long"), 32) for k, v in _keys(16, [0, 16, 32, 48])])
    rows = fps.select("fp", "node", F.explode(first).alias("bucket"))
    large = common.materialize(rows.groupBy("bucket").count().where(F.col("count") > bucket_rows).select("bucket", F.lit(True).alias("large")), "simhash-large")
    if large.isEmpty():
        return rows.select("bucket", "fp", "node")
    marked = rows.join(large, "bucket", "left")
    kept = marked.where("large is null").select("bucket", "fp", "node")
    for k, pair in enumerate(_PAIRS):
        free = [b for b in range(4) if b not in pair]
        starts = [16 * free[0], 16 * free[0] + 8, 16 * free[1], 16 * free[1] + 8]
        again = F.array(*[F.xxhash64("bucket", F.lit(n)).bitwiseAND(F.lit(~0xFFFF)).bitwiseOR(v) for n, v in _keys(8, starts)])
        # keys of the second dealing are negative hashes of what they stand for; a clash only makes a bucket larger
        own = marked.where("large").where(F.shiftright("bucket", 32) % six == k).select(F.explode(again).alias("key"), "fp", "node")
        kept = kept.unionByName(own.select(F.col("key").bitwiseOR(F.lit(-(1 << 63))).alias("bucket"), "fp", "node"))
    return kept


def near_duplicates(docs: DataFrame, text: str = "text", bucket_rows: int = BUCKET_ROWS, draws: int = 1) -> DataFrame:
    """One row for each row of ``docs``: doc_id, fp (signed long) and component_id."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), common.text_or_empty(text).alias("text"))
    rows = common.materialize(common.map_arrow(rows, _fingerprints(draws), "doc_id long, fp long, more array<long>"), "simhash-fingerprints")
    fps = common.materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-distinct")
    drawn = fps.select(F.lit(0).alias("draw"), "fp", F.col("fp").alias("node"))
    equal = None
    if draws > 1:
        # a fingerprint of a later draw that several nodes share links them; the smallest node stands for it in the index
        later = rows.select("fp", F.posexplode("more").alias("draw", "other")).select(F.col("fp").alias("node"), (F.col("draw") + 1).alias("draw"), F.col("other").alias("fp")).distinct()
        later = common.materialize(later, "simhash-draws")
        first = common.materialize(later.groupBy("draw", "fp").agg(F.min("node").alias("a")), "simhash-draw-nodes")
        equal = later.join(first, ["draw", "fp"]).where("a <> node").select("a", F.col("node").alias("b"))
        drawn = drawn.unionByName(first.select("draw", "fp", F.col("a").alias("node")))
    dealt = _buckets(drawn, bucket_rows).repartition(common.parallelism(docs.sparkSession), "bucket").sortWithinPartitions("bucket")
    edges = common.materialize(common.map_arrow(dealt, _bucket_edges, "a long, b long"), "simhash-edges")
    roots = connected_components(edges if equal is None else edges.unionByName(equal))

    named = common.materialize(fps.join(roots, fps["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root")), "simhash-roots")
    names = common.materialize(named.groupBy("root").agg(F.min("least").alias("component_id")), "simhash-names")
    by_fp = common.materialize(named.join(names, "root").select("fp", "component_id"), "simhash-by-fp")
    return rows.select("doc_id", "fp").join(by_fp, "fp").select("doc_id", "fp", "component_id")


def op9_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(common.table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
