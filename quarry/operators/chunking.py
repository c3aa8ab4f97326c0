"""Chunks of sentences under a token target, with overlap.

Sentences are split by a built-in expression; packing them is a left fold over a document's own sentences, which runs in
Arrow batches with no shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..session import ship

TARGET, OVERLAP = 800, 200


def repaired(target: int, overlap: int) -> tuple[int, int]:
    """Usable parameters: defaults for senseless ones, and an overlap below the target."""
    target = target if target > 0 else TARGET
    overlap = overlap if overlap >= 0 else OVERLAP
    return target, overlap if overlap < target else target // 2


def tokens_in(text: str) -> int:
    return max(1, int(len(text.split()) / 0.75))


def pack_sentences(sentences: list[str], target: int = TARGET, overlap: int = OVERLAP) -> list[tuple[str, int]]:
    """(text, tokens) of each chunk.

    A chunk closes when the next sentence would pass the target, and the next begins with the trailing sentences that fit
    the overlap.  A sentence over the target is cut by words, each counting 1, and takes no overlap.
    """
    target, overlap = repaired(target, overlap)
    chunks: list[tuple[str, int]] = []
    held: list[tuple[str, int]] = []

    def close() -> None:
        if held:
            chunks.append((" ".join(s for s, _ in held), sum(n for _, n in held)))

    for sentence in sentences:
        n = tokens_in(sentence)
        if n > target:
            close()
            held = []
            words = sentence.split()
            pieces = [" ".join(words[i : i + target]) for i in range(0, len(words), target)]
            chunks += [(p, tokens_in(p)) for p in pieces[:-1]]
            held = [(pieces[-1], tokens_in(pieces[-1]))]
            continue
        if held and sum(x for _, x in held) + n > target:
            close()
            kept: list[tuple[str, int]] = []
            for s in reversed(held):
                if sum(x for _, x in kept) + s[1] > overlap:
                    break
                kept.insert(0, s)
            held = kept
        held.append((sentence, n))
    close()
    return chunks


def chunk_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", target: int = TARGET, overlap: int = OVERLAP) -> DataFrame:
    """(key, seq, text, token_count) for every chunk."""
    ship(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()

    def chunk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            rows = [(k, i, c, n) for k, s in zip(frame[key], frame["sentences"]) for i, (c, n) in enumerate(pack_sentences(list(s), target, overlap))]
            yield pd.DataFrame(rows, columns=[key, "seq", "text", "token_count"])

    split = docs.select(key, T.sentences(F.coalesce(F.col(text), F.lit(""))).alias("sentences"))
    return split.mapInPandas(chunk, f"{key} {kind}, seq long, text string, token_count long")


def chunk_statistics(chunks: DataFrame) -> DataFrame:
    return chunks.agg(
        F.count(F.lit(1)).alias("n_chunks"), F.round(F.avg("token_count"), 4).alias("avg_tokens"), F.min("token_count").alias("min_tokens"), F.max("token_count").alias("max_tokens"), F.sum("token_count").alias("total_tokens")
    )
