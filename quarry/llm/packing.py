"""Best-fit decreasing packing of documents into sequences.

Pieces are packed from the longest to the shortest, each into the open sequence with the least remaining capacity that
holds it.  Which sequence that is depends on lengths alone, and there are no more lengths than a sequence has tokens; so the
driver packs *counts* of pieces by length, over all of the corpus at once, and gets instructions: the pieces of a length
from one rank to another go to sequences from a number on, so many to each, from an offset on.  Counts of open sequences
stand in a segment tree over remaining capacities, whose search is logarithmic; all pieces for which it gives the same
answer are placed in one step.  Instructions are bounded by the sequence length, whatever the corpus's size.

Tasks number their own pieces of a length as they make them, counts by task and length turn those numbers into ranks, and
each piece looks its place up.  No text is shuffled, nothing is sorted, and a length that a third of all pieces share
is just a larger count.

Defined cases: a null or empty text is a piece of one end id; repeated rows are packed each; an empty table gives no rows;
only ``doc_id`` and the text are read, so other columns can't clash.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common
from .tokens import byte_batches, default_path, encoder

SEQUENCE, END_ID = 2048, 0


class CapacityTree:
    """Segment tree over remaining capacities; a leaf counts the open sequences with that capacity."""

    def __init__(self, most: int) -> None:
        self.leaves = 1 << most.bit_length()
        self.count = [0] * (2 * self.leaves)

    def add(self, capacity: int, n: int) -> None:
        node = self.leaves + capacity
        while node:
            self.count[node] += n
            node >>= 1

    def tightest(self, least: int) -> int | None:
        """The smallest capacity of at least ``least`` that an open sequence has."""
        node = self.leaves + least
        if self.count[node]:
            return least
        while node > 1:
            if not node & 1 and self.count[node + 1]:  # a left child whose sibling has some: go down there
                node += 1
                while node < self.leaves:
                    node = 2 * node if self.count[2 * node] else 2 * node + 1
                return node - self.leaves
            node >>= 1
        return None


def best_fit_decreasing(counts: dict[int, int], most: int = SEQUENCE) -> tuple[list[tuple[int, int, int, int, int, int]], int]:
    """Instructions (length, first rank, pieces, first sequence, pieces to a sequence, offset) and the sequences used.

    A sequence that takes a piece and still holds another of the length is the tightest for it, so a sequence of
    capacity c takes c // length pieces in a row; all sequences of one capacity do so in turn.
    """
    tree = CapacityTree(most)
    runs: dict[int, list[tuple[int, int]]] = defaultdict(list)  # capacity: (first sequence, how many)
    made: list[tuple[int, int, int, int, int, int]] = []
    used = 0

    def opened(capacity: int, first: int, n: int) -> None:
        if n and capacity:
            runs[capacity].append((first, n))
            tree.add(capacity, n)

    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            capacity = tree.tightest(length)
            if capacity is None:
                each = most // length
                first, n, capacity = used, -(-left // each), most
                used += n
            else:
                each = capacity // length
                first, n = runs[capacity].pop()
                tree.add(capacity, -n)
                need = -(-left // each)
                if need < n:
                    opened(capacity, first + need, n - need)
                    n = need
            placed = min(left, n * each)
            made.append((length, rank, placed, first, each, most - capacity))
            full, rest = divmod(placed, each)
            opened(capacity - each * length, first, full)
            if rest:
                opened(capacity - rest * length, first + full, 1)
            rank, left = rank + placed, left - placed
    return made, used


_SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long, task int, number long"


def _pieces(path: str, most: int, end_id: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        seen = np.zeros(most + 1, np.int64)
        for whole in batches:
            for batch in byte_batches(whole):
                ids, counts = encoder(path).encode(batch.column(1))
                ids = np.insert(ids, np.cumsum(counts), np.uint32(end_id)).astype("<u4", copy=False)
                counts = counts + 1
                n_pieces = -(-counts // most)
                doc = np.repeat(np.arange(len(counts)), n_pieces)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(n_pieces) - n_pieces, n_pieces)
                start = piece * most
                length = np.minimum(most, counts[doc] - start)
                data = memoryview(ids).cast("B")
                begin = ((np.cumsum(counts) - counts)[doc] + start) * 4
                crc = [zlib.crc32(data[b:e]) for b, e in zip(begin.tolist(), (begin + 4 * length).tolist())]
                # numbers of equal lengths within the task, in order
                order = np.argsort(length, kind="stable")
                ordered = length[order]
                new = np.flatnonzero(np.diff(ordered, prepend=-1))
                number = np.empty(len(length), np.int64)
                number[order] = np.arange(len(length)) - np.repeat(new, np.diff(np.append(new, len(length)))) + seen[ordered]
                np.add.at(seen, length, 1)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(doc)), pa.array(piece, pa.int32()), pa.array(start), pa.array(length), pa.array(crc, pa.int64()), pa.array(np.full(len(doc), task, np.int32)), pa.array(number)],
                    names=["doc_id", "piece", "start", "length", "ids_crc32", "task", "number"],
                )

    return cut


def _place(made: list[tuple[int, int, int, int, int, int]]):
    table = np.array(made, np.int64).reshape(-1, 6)
    table = table[np.lexsort((table[:, 1], table[:, 0]))]
    keys = table[:, 0] * (1 << 48) + table[:, 1]

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            get = lambda name: batch.column(batch.schema.get_field_index(name)).to_numpy(zero_copy_only=False)
            length, rank = get("length"), get("rank")
            row = table[np.searchsorted(keys, length * (1 << 48) + rank, "right") - 1]
            turn, slot = np.divmod(rank - row[:, 1], row[:, 4])
            keep = [batch.column(batch.schema.get_field_index(n)) for n in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays([*keep, pa.array(row[:, 3] + turn), pa.array(row[:, 5] + slot * length)], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return look_up


def pack(docs: DataFrame, most: int = SEQUENCE, end_id: int = END_ID, tokenizer: str | None = None, text: str = "text") -> DataFrame:
    """One row for each piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), common.text_or_empty(text).alias("text"))
    pieces = common.materialize(common.map_arrow(rows, _pieces(tokenizer or default_path(), most, end_id), _SCHEMA), "pack-pieces")
    by_task = common.materialize(pieces.groupBy("length", "task").agg(F.count(F.lit(1)).alias("n")), "pack-counts")
    counts = {r["length"]: r["n"] for r in by_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # a row for each length up to ``most``
    made, _ = best_fit_decreasing(counts, most)
    # for each length, a row for each task
    before = W.partitionBy("length").orderBy("task").rowsBetween(W.unboundedPreceding, -1)
    bases = common.materialize(by_task.select("length", "task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base")), "pack-bases")
    ranked = pieces.join(bases, ["length", "task"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("number")).alias("rank"))
    return common.map_arrow(ranked, _place(made), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(common.table(spark, sf_dir, "documents"))
