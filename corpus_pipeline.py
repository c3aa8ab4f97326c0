"""Corpus preparation, stage by stage: quality rules, exact dedup, near-dedup, mixing to target weights, packing.

Each stage takes the documents that the one before it kept and decides about each of their rows: rows are told apart by their
place in the stored files, so missing or repeated ids don't matter.  All columns of the documents, additional ones too, go
through to the last stage, which returns packed pieces instead.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import common
from quarry.llm.exact_dedup import exact_duplicates
from quarry.llm.mixing import mix
from quarry.llm.near_copies import near_copies
from quarry.llm.packing import pack
from quarry.llm.quality import fit_references, passing

ROW = "__pipeline_row"


def _kept(docs: DataFrame, operator: Callable[..., DataFrame]) -> DataFrame:
    """The rows of ``docs`` that an operator keeps."""
    rows = common.numbered(docs, ROW)
    return common.selected(rows, operator(rows, key=ROW).where("kept").select("key"), ROW).drop(ROW)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and diverge little from their language."""
    return passing(docs, fit_references(docs, common.table(spark, sf_dir, "labels")))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return _kept(docs, exact_duplicates)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near copies: 0.8 or more of their five-word shingles agree."""
    return _kept(docs, near_copies)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    rows = common.numbered(docs, ROW)
    copies = mix(rows, key=ROW).where("copies > 0")
    # a mark for each copy, at most three
    marks = copies.select("key", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("key")
    return common.selected(rows, marks, ROW).drop(ROW)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' tokens, packed into sequences."""
    return pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("mixing", mixing),
    ("packing", packing),
]

#: Mixing draws at random and packing tokenizes: SQL can't express either.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``, each one's rows written to the shared folder and read again."""
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = common.materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
