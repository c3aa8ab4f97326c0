"""Contiguous shards of nearly equal bytes, from global prefix sums (DataFrame functions only).

Rows are put in order of ``doc_id`` by a range exchange.  Each range partition gives one total (bytes and rows);
running sums over those totals are the bases from which each partition numbers its own rows, so that no task ever
sees more than one range partition.  The byte line is then cut at equal targets: a row goes to the shard in which
its middle byte lies, which keeps each shard within one row's size of the target.

Defined cases: a null text has no bytes (its row still has the fixed 16); null ids come first; equal ids are ordered by
size and checksum, so that rows that differ in neither are interchangeable; an empty table gives no rows; only
``doc_id`` and ``text`` are read, so other columns can't clash.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common

ROW_OVERHEAD = 16


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, size (UTF-8 bytes and the fixed part) and text_crc32."""
    text = common.text_or_empty()
    return docs.select(
        F.col("doc_id"),
        (F.octet_length(text).cast("long") + F.lit(ROW_OVERHEAD)).alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
    )


def shard_by_bytes(rows: DataFrame, n_shards: int, order: list[str], size: str = "size") -> DataFrame:
    """Add ``shard`` and ``slot`` to a narrow table of sizes.

    The range exchange draws its bounds from a sample and so may differ between two runs of the same plan; the ordered
    rows are therefore materialised once, with the number of their range, before anything is summed over them.
    """
    if n_shards < 1:
        raise ValueError("n_shards must be at least 1")
    spark = rows.sparkSession
    ranged = rows.repartitionByRange(common.parallelism(spark), *order).withColumn("__range", F.spark_partition_id())
    ranged = common.materialize(ranged, "shard-ranges")

    totals = ranged.groupBy("__range").agg(F.sum(size).alias("__bytes"), F.count(F.lit(1)).alias("__rows"))
    # One row for each range partition: the only window without a key runs over so few.
    before = W.orderBy("__range").rowsBetween(W.unboundedPreceding, -1)
    bases = totals.select(
        "__range",
        F.coalesce(F.sum("__bytes").over(before), F.lit(0)).alias("__byte_base"),
        F.coalesce(F.sum("__rows").over(before), F.lit(0)).alias("__row_base"),
        F.sum("__bytes").over(W.partitionBy()).alias("__total"),
    )
    within = W.partitionBy("__range").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    start = F.col("__byte_base") + F.coalesce(F.sum(size).over(within), F.lit(0))
    cut = F.expr(f"least({n_shards - 1}, cast(floor(cast(2 * __start + {size} as decimal(38,0)) * {n_shards} / (2 * __total)) as int))")
    placed = (
        ranged.join(bases, "__range")
        .withColumn("__start", start)
        .withColumn("__row", F.col("__row_base") + F.row_number().over(W.partitionBy("__range").orderBy(*order)) - 1)
        .withColumn("shard", F.when(F.col("__total") > 0, cut).otherwise(F.lit(0)))
        .drop("__byte_base", "__row_base", "__start", "__total")
    )
    # Shards are contiguous, so a slot is the distance from the shard's first row; a row for each shard and range.
    firsts = placed.groupBy("shard").agg(F.min("__row").alias("__first"))
    return (
        placed.join(F.broadcast(firsts), "shard")  # one row a shard: n_shards is a parameter
        .withColumn("slot", F.col("__row") - F.col("__first"))
        .drop("__row", "__first", "__range")
    )


def op6_prefix_sum_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = measured(common.table(spark, sf_dir, "documents"))
    return shard_by_bytes(rows, 40, ["doc_id", "size", "text_crc32"]).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        F.col("shard").cast("int").alias("shard"),
        F.col("slot").cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
