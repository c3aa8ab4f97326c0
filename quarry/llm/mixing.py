"""Mixing sources to target weights by pivotal dependent rounding.

Every document of a source is wanted the same number of times, the source's target over its size.  The whole part of
that number is taken as it is; the fractional parts are rounded by the pivotal method: two units meet, mass moves at
random (with unchanged expectation) until one of them is 0 or 1, and the other meets the next unit.  The number of
copies in a source thus stays within one of its expectation, and as units meet in order of size, the number of words
stays near its own; the largest come first, so that what is left open to the end tends to be small.

The units of a source are dealt into groups by a hash of their rows, each group is rounded in one ordered pass
with one open unit, and the groups' residual units are rounded again, ``FAN_IN`` groups into one, up a
reduction tree until each source has one unit, which a last draw decides.  Groups depend on the rows alone and draws on
``(seed, source, level, group)``, so reruns agree wherever rows lie (rows that agree in doc_id, source and size are interchangeable).
A source that holds a third of all rows has as many more groups; a group that is far too large, because ids repeat or are
missing, is dealt among all groups of its source by the rows' numbers.

Defined cases: a null text has size 0; null is a source of its own, after the others; repeated rows are units of their
own; an empty table gives no rows; only ``doc_id``, ``source`` and the text are read, so other columns can't clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common

#: Units that one group rounds in a pass, and groups whose residuals meet in one group of the next level.
GROUP_ROWS, FAN_IN = 4096, 64
#: A document is taken at most so many times.
MOST_COPIES = 3
#: Weights of the sources, in order of their names, repeated.
WEIGHTS = (1, 2, 3)
#: Fractions closer than this to a whole number are whole.
TINY = 1e-9


def words_in(column):
    return F.regexp_count(column, F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = MOST_COPIES) -> DataFrame:
    """source, source_size, target from (source, size) rows.

    Targets share out all words by weight.  A target over ``most`` times its source's size stops there and its excess
    goes to the others by weight, until none is above.  Each round is one sum over the table of sources.
    """
    spark = sizes.sparkSession
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    # Sources are numbered by code point, null last: range by range, so that their number isn't bounded by a task.
    order = F.col("source").asc_nulls_last()
    by_source = by_source.repartitionByRange(common.parallelism(spark), order).withColumn("range", F.spark_partition_id())
    by_source = common.materialize(by_source, "mix-sources")
    before = W.orderBy("range").rowsBetween(W.unboundedPreceding, -1)  # a row for each range
    bases = by_source.groupBy("range").agg(F.count(F.lit(1)).alias("n")).select("range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    by_source = by_source.join(bases, "range")
    place = F.col("base") + F.row_number().over(W.partitionBy("range").orderBy(order)) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place % len(weights) + 1).cast("int"))
    rows = common.materialize(by_source.withColumn("weight", weight).withColumn("cap", F.col("source_size") * float(most)).drop("range", "base"), "mix-weights")
    total = rows.agg(F.sum("source_size")).first()[0] or 0
    rate = float("inf")  # words for each unit of weight; over the cap means that the source is full
    known = None
    while True:
        # full sources are those whose cap lies below the last rate; the first round has none
        full = F.lit(False) if known is None else F.col("cap") < F.col("weight") * F.lit(rate)
        held, left = rows.agg(F.sum(F.when(full, F.col("cap"))), F.sum(F.when(~full, F.col("weight")))).first()
        if not left:
            break
        rate = (total - (held or 0.0)) / left
        n_full = rows.where(F.col("cap") < F.col("weight") * F.lit(rate)).count()
        if n_full == (known or 0):
            break
        known = n_full
    target = F.least(F.col("cap"), F.col("weight") * F.lit(rate)) if total else F.lit(0.0)
    return rows.select("source", "source_size", target.cast("double").alias("target"))


class _Draws:
    """Uniform draws of one group."""

    def __init__(self, *key) -> None:
        digest = hashlib.sha256("\x1f".join(map(str, key)).encode()).digest()
        self.rng = np.random.Generator(np.random.PCG64(int.from_bytes(digest[:16], "little")))
        self.block, self.at = np.empty(0), 0

    def next(self) -> float:
        if self.at == len(self.block):
            self.block, self.at = self.rng.random(1024), 0
        self.at += 1
        return float(self.block[self.at - 1])


def meet(p: float, q: float, draw: float) -> tuple[float, float]:
    """One pivotal step: afterwards one of the two probabilities is 0 or 1, their sum and expectations are the same."""
    total = p + q
    if total <= 1.0:
        return (total, 0.0) if draw * total < p else (0.0, total)
    return (1.0, total - 1.0) if draw * (2.0 - total) < 1.0 - q else (total - 1.0, 1.0)


def _whole(p: float) -> int | None:
    return 0 if p <= TINY else 1 if p >= 1 - TINY else None


def _round_groups(level: int, seed: int, last: bool):
    """Rounds rows that come sorted by source key, group and falling size; one open unit at a time, so memory doesn't grow."""

    def rounded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, draws, open_row, open_p = None, None, None, 0.0
        done: list[tuple] = []

        def close() -> None:
            nonlocal open_row
            if open_row is not None:
                extra = (1 if draws.next() < open_p else 0) if last and _whole(open_p) is None else _whole(open_p)
                done.append((*open_row, open_p, extra))
                open_row = None

        for frame in batches:
            for src, grp, unit, doc, size, p in zip(frame.source_key, frame.grp, frame.unit, frame.doc_id, frame["size"], frame.p):
                if (src, grp) != key:
                    close()
                    key, draws = (src, grp), _Draws(seed, level, src, grp)
                row = (src, grp, unit, doc, size)
                if _whole(p) is not None:
                    done.append((*row, p, _whole(p)))
                elif open_row is None:
                    open_row, open_p = row, p
                else:
                    a, b = meet(open_p, p, draws.next())
                    if _whole(a) is not None:
                        done.append((*open_row, a, _whole(a)))
                        open_row, open_p = (row, b)
                    else:
                        done.append((*row, b, _whole(b)))
                        open_p = a
                    if _whole(open_p) is not None:
                        done.append((*open_row, open_p, _whole(open_p)))
                        open_row = None
            if len(done) >= 4096:
                yield _frame(done)
                done = []
        close()
        if done:
            yield _frame(done)

    return rounded


_SCHEMA = "source_key string, grp long, unit long, doc_id long, size long, p double, extra int"


def _frame(rows: list[tuple]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=["source_key", "grp", "unit", "doc_id", "size", "p", "extra"])
    return out.astype({"unit": "Int64", "doc_id": "Int64", "extra": "Int32"})


def pivotal_rounding(units: DataFrame, seed: int = 0) -> DataFrame:
    """0 or 1 for each unit of (source_key, unit, doc_id, size, p), as column ``extra``."""
    spark = units.sparkSession
    counts = common.materialize(units.groupBy("source_key").agg(F.ceil(F.count(F.lit(1)) / GROUP_ROWS).alias("groups")), "mix-groups")
    rows = units.join(counts, "source_key")
    rows = common.materialize(rows.withColumn("grp", F.pmod(F.xxhash64("doc_id", "size"), F.col("groups"))), "mix-dealt")
    # rows that share id and size, as those without id may: dealt by their own number instead
    large = rows.groupBy("source_key", "grp").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 4 * GROUP_ROWS).select("source_key", "grp", F.lit(True).alias("large"))
    rows = rows.join(common.materialize(large, "mix-large"), ["source_key", "grp"], "left")
    rows = rows.withColumn("grp", F.when(F.col("large"), F.pmod(F.xxhash64("unit"), F.col("groups"))).otherwise(F.col("grp"))).drop("groups", "large")
    most = counts.agg(F.max("groups")).first()[0] or 1
    level, settled = 0, []
    while True:
        last = most <= 1
        n = common.parallelism(spark)
        dealt = rows.repartition(n, "source_key", "grp").sortWithinPartitions("source_key", "grp", F.desc("size"), "doc_id", "unit")
        dealt = dealt.select("source_key", "grp", "unit", "doc_id", "size", "p")
        out = common.materialize(common.map_pandas(dealt, _round_groups(level, seed, last), _SCHEMA), f"mix-level-{level}")
        settled.append(out.where("extra is not null").select("unit", "extra"))
        if last:
            break
        rows = out.where("extra is null").select("source_key", F.floor(F.col("grp") / FAN_IN).alias("grp"), "unit", "doc_id", "size", "p")
        most, level = -(-most // FAN_IN), level + 1
    found = settled[0]
    for more in settled[1:]:
        found = found.unionByName(more)
    return found


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = MOST_COPIES, seed: int = 0, text: str = "text", key: str | None = None) -> DataFrame:
    """One row for each row of ``docs``: doc_id, size, source_size, target, copies, taken (copies times size) and key.

    ``key`` names a column of longs, one for each row; without it, rows are numbered.
    """
    number = F.col(key) if key else F.monotonically_increasing_id()
    size = words_in(common.text_or_empty(text))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), size.alias("size"), number.alias("unit"))
    rows = common.materialize(rows, "mix-rows")
    targets = source_targets(rows, weights, most)
    wanted = F.when(F.col("source_size") > 0, F.least(F.lit(float(most)), F.col("target") / F.col("source_size"))).otherwise(F.lit(0.0))
    # the key tells null from any name
    targets = targets.select(F.coalesce(F.concat(F.lit("="), "source"), F.lit("")).alias("source_key"), "source_size", "target", wanted.alias("wanted"))
    targets = common.materialize(targets.withColumn("base", F.floor(F.col("wanted") + TINY)).withColumn("p", F.greatest(F.lit(0.0), F.col("wanted") - F.col("base"))), "mix-targets")
    rows = rows.select("unit", "doc_id", "size", F.coalesce(F.concat(F.lit("="), "source"), F.lit("")).alias("source_key")).join(targets, "source_key")
    extra = pivotal_rounding(rows.select("source_key", "unit", "doc_id", "size", "p"), seed)
    return rows.join(extra, "unit").select("doc_id", "size", "source_size", "target", (F.col("base") + F.col("extra")).cast("long").alias("copies"), F.col("unit").alias("key")).withColumn("taken", F.col("copies") * F.col("size"))


def op8_pivotal_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(common.table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies")
