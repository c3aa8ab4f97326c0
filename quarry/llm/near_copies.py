"""Near copies: groups of texts linked by a Jaccard similarity of at least 0.8 of their five-word shingles.

SimHash and the Gray-order index (``simhash.GrayForest``) find candidates, and the sets of shingles decide.  A text has
``DRAWS`` SimHashes of 64 bits.  Texts that agree in one of the blocks of ``WIDTH`` bits of one of them share a bucket, and are
candidates if there they differ in ``NEAR`` bits at most, and in the next SimHash in ``ALSO_NEAR``.  A pair at 0.8 differs in about
15 % of the bits: it agrees in a block with a probability of 0.072, is near in both with 0.93, and so is no candidate in any of the 64
buckets with (1 - 0.067)**64, about 1 %; closer pairs are lost far more rarely.

In a bucket, the most central node without a group is searched for again and again, and all that it finds join its group.  Each
node is first compared with the closest one that any of these searches paired it with.  Candidates which that leaves in different
components are searched for in a second pass, where the index passes over whole groups of the query's own component, and
compared in the first bucket they meet in; so no candidate pair is left out, and none is emitted only to be compared.  Buckets
over ``BUCKET_ROWS`` are dealt as pairs of blocks of about that size, so that a hot one spreads over many tasks.  Sets of shingles
are made again for candidates only.

A bucket holds a 2**-16 part of unrelated texts.  Beyond some hundred million texts take a greater ``width``, and as many more
``draws`` as keep (1 - 0.85**width)**(draws * 64 / width) small.

Words are split at ASCII white space, A-Z lower-cased; a text of fewer words is one shingle.  Shingles are 64-bit hashes.

Defined cases: a null text counts as empty, and texts without words are copies of each other; a null doc_id gets a component
but never names one unless all ids there are null; an empty table gives no rows; only ``doc_id``, ``key`` and the text are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .components import connected_components
from .simhash import GrayForest

SHINGLE_WORDS, SEED = 5, 42
#: SimHashes of a text, the bits of a bucket's key, and the bits in which candidates may differ: the key's SimHash, the next one.
DRAWS, WIDTH, NEAR, ALSO_NEAR = 16, 16, 11, 15
#: The share of all bits in which texts may differ that are compared: 0.15 is expected at 0.8, with a deviation of 0.011.
OF_ALL = 0.19
#: A bucket of more rows is dealt in blocks of about as many.
BUCKET_ROWS = 1 << 14
#: Rows indexed at a time, leaves that one step of a search may reach, and rows hashed at a time.
INDEX_ROWS, REACH, BATCH_ROWS = 1 << 18, 1 << 21, 1024
#: Rows from which on a bucket has a centre.
CENTRED = 8

#: Low bits of a bucket's number: which SimHash and block its key is.
PLACE_BITS = 16
PLACES = (1 << PLACE_BITS) - 1

_OFFSETS = np.arange(1, 1 << 10, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
#: For each byte, its bits as the eight bytes of a word: sums of up to 255 of them count bits side by side.
_LANES = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").view("<u8").ravel()


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: bytes, k: int = SHINGLE_WORDS) -> np.ndarray:
    """The sorted distinct hashes of the shingles; none for a text without words."""
    words = text.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(w, SEED) for w in words), np.uint64, len(words))
    n = max(1, len(words) - k + 1)
    out = np.full(n, min(len(words), k), np.uint64)
    for i in range(min(len(words), k)):
        out = _mixed(out * np.uint64(0x9E3779B97F4A7C15) + hashes[i : i + n])
    return np.unique(out)


def _node(found: bytes) -> int:
    """The number of a set of shingles, from their bytes."""
    return xxhash.xxh64_intdigest(found, SEED)


def simhashes(found: np.ndarray, draws: int = DRAWS) -> np.ndarray:
    """SimHashes of a set of shingles: the majority of each bit of as many independent hashes."""
    ones = np.zeros(draws * 64, np.int64)
    for at in range(0, len(found), 255):
        drawn = _mixed(found[at : at + 255, None] + _OFFSETS[:draws]).astype("<u8", copy=False)
        ones += _LANES[drawn.view(np.uint8)].sum(axis=0, dtype=np.uint64).astype("<u8", copy=False).view(np.uint8)
    return np.packbits((2 * ones > len(found)).reshape(draws, 64), axis=1, bitorder="little").view("<u8").ravel()


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether the Jaccard similarity of two sets is at least 0.8."""
    if not len(a) or not len(b):
        return len(a) == len(b)
    if 5 * min(len(a), len(b)) < 4 * max(len(a), len(b)):
        return False
    return 9 * len(np.intersect1d(a, b, assume_unique=True)) >= 4 * (len(a) + len(b))


def _hashed(draws: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, BATCH_ROWS):
                batch = whole.slice(at, BATCH_ROWS)
                sets = [shingles(t) for t in batch.column(2).cast(pa.binary()).to_pylist()]
                nodes = [_node(s.tobytes()) for s in sets]
                fps = pa.array([simhashes(s, draws).view(np.int64) for s in sets], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(1), pa.array(np.array(nodes, np.uint64).view(np.int64)), fps],
                    names=["doc_id", "key", "node", "fps"],
                )

    return run


# Buckets -------------------------------------------------------------------------------------------------------------


def _dealt(nodes: DataFrame, draws: int, width: int, bucket_rows: int) -> DataFrame:
    """(deal, fp, also, node, ...) for each bucket of (node, fps, ...), sorted by ``deal`` within partitions, which holds whole deals."""
    blocks = 64 // width
    mask = F.lit((1 << width) - 1)
    keys = [
        F.struct(
            # the key's value, above the number of its draw and block
            F.shiftleft(F.shiftrightunsigned(F.col("fps")[d], b * width).bitwiseAND(mask), PLACE_BITS).bitwiseOR(F.lit(d * blocks + b)).alias("bucket"),
            F.col("fps")[d].alias("fp"),
            F.col("fps")[(d + 1) % draws].alias("also"),
        )
        for d in range(draws)
        for b in range(blocks)
    ]
    rest = [c for c in nodes.columns if c != "fps"]
    rows = nodes.select(*rest, F.explode(F.array(*keys)).alias("k")).select("k.*", *rest)
    hot = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > bucket_rows)
    hot = common.materialize(hot.select("bucket", F.ceil(F.col("n") / bucket_rows).cast("int").alias("blocks")), "copies-hot")
    if hot.isEmpty():
        rows = rows.withColumnRenamed("bucket", "deal")
    else:
        # a block meets each block of its bucket once
        rows = rows.join(hot, "bucket", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
        rows = rows.withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        again = F.xxhash64("bucket", F.least("own", "other"), F.greatest("own", "other")).bitwiseAND(F.lit(-1 << PLACE_BITS))
        deal = F.when(F.col("blocks") == 1, F.col("bucket")).otherwise(again.bitwiseOR(F.col("bucket").bitwiseAND(F.lit(PLACES))))
        rows = rows.select(deal.alias("deal"), "fp", "also", *rest)
    return rows.repartition(common.parallelism(nodes.sparkSession), "deal").sortWithinPartitions("deal")


def _whole_deals(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """Columns of whole deals of two rows and more, about ``INDEX_ROWS`` rows at a time."""

    def cut(columns: list[np.ndarray]) -> list[np.ndarray]:
        deal = columns[0]
        new = np.ones(len(deal) + 1, bool)
        new[1:-1] = deal[1:] != deal[:-1]
        with_others = ~(new[:-1] & new[1:])
        return [c[with_others] for c in columns]

    held: list[list[np.ndarray]] = []
    rows = 0
    for batch in batches:
        held = held or [[] for _ in batch.columns]
        for column, part in zip(held, batch.columns):
            column.append(part.to_numpy(zero_copy_only=False))
        rows += batch.num_rows
        if rows >= INDEX_ROWS:
            columns = list(map(np.concatenate, held))
            end = int(np.searchsorted(columns[0], columns[0][-1], "left"))
            if end:
                yield cut([c[:end] for c in columns])
            held, rows = [[c[end:]] for c in columns], len(columns[0]) - end
    if rows:
        yield cut(list(map(np.concatenate, held)))


def _off_centre(forest: GrayForest) -> np.ndarray:
    """Bits in which each fingerprint differs from the majority of its bucket; in buckets of few, none."""
    size = np.bincount(forest.root)[forest.root]
    out = np.zeros(len(size), np.int64)
    rows = np.flatnonzero(size >= CENTRED)
    if len(rows):
        starts = np.flatnonzero(np.diff(forest.root[rows], prepend=-1))
        n = np.diff(np.append(starts, len(rows)))
        major = np.zeros(len(starts), np.uint64)
        for bit in range(64):
            ones = np.add.reduceat((forest.fps[rows] >> np.uint64(bit) & np.uint64(1)).astype(np.int64), starts)
            major |= (2 * ones > n).astype(np.uint64) << np.uint64(bit)
        out[rows] = np.bitwise_count(forest.fps[rows] ^ np.repeat(major, n))
    return out


def stars(forest: GrayForest, node: np.ndarray, also: np.ndarray, near: int = NEAR, also_near: int = ALSO_NEAR) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(centre, member) places: in each bucket the most central node without a group is a centre, and what it finds is in its group."""
    if not len(node):
        return
    order = np.lexsort((node, _off_centre(forest), forest.root))  # by bucket, the most central first, then the smallest
    bucket = forest.root[order]
    at = np.flatnonzero(np.diff(bucket, prepend=-1))
    end = np.append(at[1:], len(order))
    grouped = np.zeros(len(node), bool)
    while len(at):
        centre = order[at]
        query, found = forest.search(centre, near)
        close = np.bitwise_count(also[query] ^ also[found]) <= also_near
        query, found = query[close], found[close]
        grouped[found] = True
        other = query != found
        yield query[other], found[other]
        while True:  # on to the next node without a group
            stay = at < end
            at, end = at[stay], end[stay]
            done = grouped[order[at]]
            if not done.any():
                break
            at = at + done


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b, far): for each node b that is a centre or a member, the closest node a that it was paired with, and the bits in which they differ."""
    for deal, fp, also, node in _whole_deals(batches):
        forest = GrayForest(deal, fp.view(np.uint64))
        node, also = node[forest.order], also.view(np.uint64)[forest.order]
        found = [np.empty((2, 0), np.int64), *map(np.stack, stars(forest, node, also))]
        i, j = np.concatenate(found, axis=1)
        far = (np.bitwise_count(forest.fps[i] ^ forest.fps[j]) + np.bitwise_count(also[i] ^ also[j])).astype(np.int32)
        a, b, far = np.concatenate((node[i], node[j])), np.concatenate((node[j], node[i])), np.concatenate((far, far))
        order = np.lexsort((a, far, b))
        order = order[np.flatnonzero(np.diff(b[order], prepend=b[order[:1]] - 1))]
        yield pa.RecordBatch.from_arrays([pa.array(x[order]) for x in (a, b, far)], names=["a", "b", "far"])


def _open_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(deal, node) of those that a candidate in another component meets in this deal."""
    for deal, fp, also, node, root in _whole_deals(batches):
        forest = GrayForest(deal, fp.view(np.uint64))
        order = forest.order
        forest.label(root[order])
        also = also.view(np.uint64)[order]
        open_ = np.zeros(len(order), bool)
        reach = np.cumsum(np.bincount(forest.root)[forest.root]) // REACH if len(order) else order
        for query in np.split(np.arange(len(order)), np.flatnonzero(np.diff(reach)) + 1):
            a, b = forest.search(query, NEAR, other_labels=True)
            close = np.bitwise_count(also[a] ^ also[b]) <= ALSO_NEAR
            open_[a[close]] = True
        yield pa.RecordBatch.from_arrays([pa.array(deal[order][open_]), pa.array(node[order][open_])], names=["deal", "node"])


# Comparison ----------------------------------------------------------------------------------------------------------


def _similar_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = zip(batch.column(2), batch.column(3))
        kept = pa.array([similar(np.frombuffer(a.as_buffer(), np.uint64), np.frombuffer(b.as_buffer(), np.uint64)) for a, b in sets], pa.bool_())
        yield batch.select([0, 1]).filter(kept)


def _meets_here(fps: np.ndarray, others: np.ndarray, place: int, width: int) -> np.ndarray:
    """Which of the others are candidates of a text that meet it in a bucket of this place, and in none before it."""
    blocks = 64 // width
    near = np.flatnonzero(np.bitwise_count(fps[place // blocks] ^ others[:, place // blocks]) <= NEAR)
    apart = fps ^ others[near]
    far = np.bitwise_count(apart)
    good = (far <= NEAR) & (np.roll(far, -1, axis=1) <= ALSO_NEAR) & (far.sum(axis=1, keepdims=True) <= OF_ALL * 64 * far.shape[1])
    same = np.stack([(apart >> np.uint64(b * width)) & np.uint64((1 << width) - 1) == 0 for b in range(blocks)], axis=2) & good[:, :, None]
    same = same.reshape(len(near), same.shape[1] * blocks)
    return near[same.any(axis=1) & (same.argmax(axis=1) == place)]


def _by_deal(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[tuple]]]:
    """Rows (node, root, fps, ...) of each deal; they come sorted by deal."""
    held: list[tuple] = []
    last = None
    for batch in batches:
        for deal, node, root, fps, *rest in zip(*(c.to_pylist() for c in batch.columns)):
            if deal != last and held:
                yield last, held
                held = []
            last = deal
            held.append((node, root, np.array(fps, np.int64).view(np.uint64), *rest))
    if held:
        yield last, held


def _components(roots: tuple[int, ...]) -> np.ndarray:
    number = {r: k for k, r in enumerate(dict.fromkeys(roots))}
    return np.array([number[r] for r in roots])


def _meeting_rows(width: int):
    """Those of (deal, node, root, fps) rows that meet a candidate of another component in this deal first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for deal, held in _by_deal(batches):
            nodes, roots, fps = zip(*held)
            fps, component = np.stack(fps), _components(roots)
            meets = np.zeros(len(nodes), bool)
            for i in range(1, len(nodes)):
                others = np.flatnonzero(component[:i] != component[i])
                others = others[_meets_here(fps[i], fps[others], deal & PLACES, width)]
                meets[others] = True
                meets[i] |= len(others) > 0
            chosen = np.flatnonzero(meets)
            columns = [pa.array([deal] * len(chosen), pa.int64()), *(pa.array([x[i] for i in chosen], pa.int64()) for x in (nodes, roots))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(list(fps[chosen].view(np.int64)), pa.list_(pa.int64()))], names=["deal", "node", "root", "fps"])

    return lambda batches: common.gathered(run(batches))


def _open_edges(width: int):
    """Edges of (deal, node, root, fps, shingles) rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for deal, held in _by_deal(batches):
            nodes, roots, fps, data = zip(*held)
            fps, sets, component = np.stack(fps), [np.frombuffer(x, np.uint64) for x in data], _components(roots)
            found = []
            for i in range(1, len(nodes)):
                others = np.flatnonzero(component[:i] != component[i])
                for j in others[_meets_here(fps[i], fps[others], deal & PLACES, width)].tolist():
                    if component[j] != component[i] and similar(sets[i], sets[j]):
                        component[component == component[i]] = component[j]
                        found.append((nodes[i], nodes[j]))
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], names=["a", "b"])

    return lambda batches: common.gathered(run(batches))


def _shingled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = [shingles(t).tobytes() for t in batch.column(2).cast(pa.binary()).to_pylist()]
        nodes = np.array([_node(s) for s in sets], np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(sets, pa.binary())], names=["node", "shingles"])


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets are similar."""
    half = common.materialize(pairs.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa")), "a"), "copies-half")
    both = half.join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb")), "b").select("a", "b", "sa", "sb")
    edges = common.materialize(common.map_arrow(both, _similar_pairs, "a long, b long"), "copies-edges")
    common.drop(half)
    return edges


def _rooted(nodes: DataFrame, roots: DataFrame) -> DataFrame:
    """``nodes`` with the root of their component, themselves if they have no other."""
    return nodes.join(roots.withColumnRenamed("node", "__n"), F.col("node") == F.col("__n"), "left").select(*nodes.columns, F.coalesce("root", "node").alias("root"))


def near_copies(docs: DataFrame, text: str = "text", key: str | None = None, draws: int = DRAWS, width: int = WIDTH, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """One row for each row of ``docs``: doc_id, key, component_id (the smallest id among its near copies) and kept.

    ``key`` names a column of longs, one for each row, the same in each reading; without it, rows are numbered.  One row of a component is kept, that with the
    smallest id and then key; a null id comes last.
    """
    if 64 % width or draws * (64 // width) > PLACES:
        raise ValueError("width must divide 64, and there must be fewer than 2**16 keys")
    docs, key = (docs, key) if key else (common.numbered(docs, "__copies_key"), "__copies_key")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(key).alias("key"), common.text_or_empty(text).alias("text"))
    rows = common.materialize(common.map_arrow(docs, _hashed(draws), "doc_id long, key long, node long, fps array<long>"), "copies-hashed")
    # equal sets are one node
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")).alias("least")
    nodes = common.materialize(rows.groupBy("node").agg(first, F.first("fps").alias("fps")), "copies-nodes")
    pairs = common.map_arrow(_dealt(nodes.select("node", "fps"), draws, width, bucket_rows), _candidates, "a long, b long, far int")
    # of each node that is a candidate, the closest other one
    closest = common.materialize(pairs.groupBy("b").agg(F.min(F.struct("far", "a")).alias("closest")), "copies-closest")
    needed = common.materialize(nodes.join(closest.select(F.col("b").alias("node")), "node", "left_semi").select("node", "fps", F.col("least.key").alias("key")), "copies-needed")
    # the text of each one's first row is read again
    sets = common.materialize(common.selected(docs, needed.select("key"), "key", _shingled, "node long, shingles binary"), "copies-sets")
    first = closest.select(F.least("closest.a", "b").alias("a"), F.greatest("closest.a", "b").alias("b")).distinct()
    edges = _verified(first, sets)
    roots = connected_components(edges)
    # candidates in different components: first the nodes that have any, then those that all bits leave, then the sets
    rooted = common.materialize(_rooted(needed.select("node", "fps"), roots), "copies-rooted")
    opened = common.materialize(common.map_arrow(_dealt(rooted, draws, width, bucket_rows), _open_rows, "deal long, node long"), "copies-open")
    by_deal = lambda rows: rows.repartition(common.parallelism(docs.sparkSession), "deal").sortWithinPartitions("deal")
    meeting = by_deal(opened.join(rooted, "node").select("deal", "node", "root", "fps"))
    meeting = common.materialize(common.map_arrow(meeting, _meeting_rows(width), "deal long, node long, root long, fps array<long>"), "copies-meeting")
    with_sets = by_deal(meeting.join(sets, "node").select("deal", "node", "root", "fps", "shingles"))
    more = common.materialize(common.map_arrow(with_sets, _open_edges(width), "a long, b long"), "copies-open-edges")
    common.drop(closest, needed, sets, rooted, opened, meeting)
    if not more.isEmpty():
        roots = connected_components(edges.unionByName(more))
    named = common.materialize(_rooted(nodes.select("node", "least"), roots), "copies-roots")
    names = common.materialize(named.groupBy("root").agg(F.min("least").alias("best")), "copies-names")
    by_node = common.materialize(named.join(names, "root").select("node", "best"), "copies-by-node")
    common.drop(nodes, named, names)
    found = rows.select("doc_id", "key", "node").join(by_node, "node")
    return found.select("doc_id", "key", F.col("best.doc_id").alias("component_id"), (F.col("key") == F.col("best.key")).alias("kept"))
