"""Exact deduplication by distributed MSD radix partitioning.

A document's radix string is the length of its normalised text followed by that text's bytes.  Groups are split by
successive digits of that string, most significant first, until they hold one document or the string has ended; those
left at the end are equal byte for byte, so no digest takes part in the decision (SHA-256 is only reported).

* In a task, each batch is split this way in memory and one representative of each local class goes on.  A text that a
  third of all rows share thus shrinks to one row for each batch before anything is shuffled.
* Across tasks, a level counts ``(group, digit)`` pairs (summed before the exchange), drops groups of one and gives the
  others a new number, the smallest row number in them.  Digits widen from level to level, as nearly all groups that
  survive the first digits are true copies.  Both inputs of a level's join are stored first, so that Spark can choose
  a broadcast by their measured size or else split skewed partitions.

Defined cases: a null text counts as empty, and all empty texts are equal; a null doc_id sorts before others; of rows
that agree in length and doc_id exactly one stays; an empty table gives no rows; only ``doc_id`` and the text are
read, so other columns can't clash.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

WHITE = b" \t\n\x0b\x0c\r"
#: Bytes of text that go with the length in the first digit; later digits are 16 times as wide each, up to the last.
HEAD, WIDER, WIDEST = 16, 16, 1 << 20
#: Rows split in memory at a time.
BATCH_ROWS = 1024

LOCAL_SCHEMA = (
    "doc_id long, rid long, rep long, rep_doc_id long, n_local long, n_points long, text_sha256 string, "
    "n_bytes long, head binary, body binary"
)


def radix_classes(keys: list[bytes]) -> list[list[int]]:
    """Positions of equal keys, by MSD radix splitting: first by length, then by ever wider runs of bytes."""
    by_length: dict[int, list[int]] = defaultdict(list)
    for i, key in enumerate(keys):
        by_length[len(key)].append(i)
    found: list[list[int]] = []
    todo = [(group, 0, HEAD) for group in by_length.values()]
    while todo:
        group, at, width = todo.pop()
        if len(group) == 1 or at >= len(keys[group[0]]):
            found.append(group)
            continue
        split: dict[bytes, list[int]] = defaultdict(list)
        for i in group:
            split[keys[i][at : at + width]].append(i)
        todo.extend((g, at + width, width * WIDER) for g in split.values())
    return found


def _local_classes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([
        ("doc_id", pa.int64()), ("rid", pa.int64()), ("rep", pa.int64()), ("rep_doc_id", pa.int64()), ("n_local", pa.int64()),
        ("n_points", pa.int64()), ("text_sha256", pa.string()), ("n_bytes", pa.int64()), ("head", pa.binary()), ("body", pa.binary()),
    ])
    for whole in batches:
        for at in range(0, whole.num_rows, BATCH_ROWS):
            batch = whole.slice(at, BATCH_ROWS)
            ids, rids = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            points = pc.utf8_length(batch.column(1)).to_pylist()
            keys = [t.translate(None, WHITE) for t in batch.column(1).cast(pa.binary()).to_pylist()]
            n = len(keys)
            rep, count = [0] * n, [0] * n
            for group in radix_classes(keys):
                # most code points, then smallest doc_id (null first)
                best = min(group, key=lambda i: (-points[i], ids[i] is not None, ids[i] or 0, i))
                for i in group:
                    rep[i], count[i] = best, len(group)
            alone = [i == r for i, r in enumerate(rep)]
            yield pa.RecordBatch.from_arrays([
                pa.array(ids, pa.int64()),
                pa.array(rids, pa.int64()),
                pa.array([rids[r] for r in rep], pa.int64()),
                pa.array([ids[r] for r in rep], pa.int64()),
                pa.array(count, pa.int64()),
                pa.array(points, pa.int64()),
                pa.array([hashlib.sha256(k).hexdigest() for k in keys], pa.string()),
                pa.array([len(k) for k in keys], pa.int64()),
                pa.array([k[:HEAD] for k in keys], pa.binary()),
                pa.array([k[HEAD:] if a else None for k, a in zip(keys, alone)], pa.binary()),
            ], schema=schema)


def exact_duplicates(docs: DataFrame, text: str = "text", key: str | None = None) -> DataFrame:
    """One row for each row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256, key.

    ``key`` names a column of longs, one for each row; without it, rows are numbered.
    """
    number = F.col(key) if key else F.monotonically_increasing_id()
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), common.text_or_empty(text).alias("text"), number.alias("rid"))
    local = common.materialize(common.map_arrow(rows, _local_classes, LOCAL_SCHEMA), "dedup-local")
    reps = local.where("rid = rep")

    keys = common.materialize(reps.groupBy("n_bytes", "head").agg(F.min("rid").alias("gid"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"), "dedup-keys-0")
    active = reps.select("rid", "n_bytes", "head", "body").join(keys, ["n_bytes", "head"]).select("rid", "gid", F.col("body").alias("rest"))
    width, level, ended = HEAD * WIDER, 1, []
    while True:
        active = common.materialize(active, f"dedup-active-{level}")
        ended.append(active.where("octet_length(rest) = 0").select("rid", F.col("gid").alias("cid")))
        active = active.where("octet_length(rest) > 0").withColumn("digit", F.expr(f"substring(rest, 1, {width})"))
        keys = active.groupBy("gid", "digit").agg(F.min("rid").alias("next"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
        keys = common.materialize(keys, f"dedup-keys-{level}")
        if keys.isEmpty():
            break
        active = active.join(keys, ["gid", "digit"]).select("rid", F.col("next").alias("gid"), F.expr(f"substring(rest, {width + 1})").alias("rest"))
        width, level = min(width * WIDER, WIDEST), level + 1

    members = ended[0]
    for more in ended[1:]:
        members = members.unionByName(more)
    members = members.join(reps.select("rid", "doc_id", "n_points", "n_local"), "rid")
    members = common.materialize(members, "dedup-members")
    best = members.groupBy("cid").agg(F.min(F.struct(-F.col("n_points"), "doc_id", "rid")).alias("best"), F.sum("n_local").alias("size"))
    best = common.materialize(best, "dedup-best")  # stored like the other side: Spark can then split a class with many members
    best = members.select(F.col("rid").alias("rep"), "cid").join(best, "cid").select("rep", F.struct(F.col("best.doc_id").alias("doc_id"), F.col("best.rid").alias("rid"), "size").alias("all"))
    best = common.materialize(best, "dedup-by-rep")
    found = local.select("doc_id", "rid", "rep", "rep_doc_id", "n_local", "text_sha256").join(best, "rep", "left")
    return found.select(
        "doc_id",
        F.when(F.col("all").isNull(), F.col("rep_doc_id")).otherwise(F.col("all.doc_id")).alias("keep_id"),
        F.coalesce("all.size", "n_local").alias("group_size"),
        (F.col("rid") == F.coalesce("all.rid", "rep")).alias("kept"),
        "text_sha256",
        F.col("rid").alias("key"),
    )


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(common.table(spark, sf_dir, "documents")).drop("key")


OP10_SQL = r"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS original, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents
), r AS (
  SELECT doc_id, norm,
         first_value(doc_id) OVER (PARTITION BY norm ORDER BY length(original) DESC, doc_id) AS keep_id,
         count(*) OVER (PARTITION BY norm) AS group_size
  FROM t
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM r
"""
