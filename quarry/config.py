"""Settings: typed, from the environment or a session, checked."""

from __future__ import annotations

import json
import os
from dataclasses import dataclass, fields

from pyspark.sql import SparkSession


@dataclass(frozen=True)
class Settings:
    chunk_tokens: int = 800
    chunk_overlap: int = 200
    embed_batch: int = 64
    embed_tokens_per_day: int = 1_000_000
    chat_tokens_per_day: int = 500_000
    semantic_weight: float = 0.7
    keyword_weight: float = 0.3
    graph_threshold: float = 0.55
    graph_cache_seconds: int = 3600
    most_file_bytes: int = 100 * 1024 * 1024

    def __post_init__(self) -> None:
        if not 0.99 <= self.semantic_weight + self.keyword_weight <= 1.01:
            raise ValueError("the weights of both legs must add up to 1")
        if self.chunk_tokens <= 0 or not 0 <= self.chunk_overlap < self.chunk_tokens:
            raise ValueError("the overlap must lie below the chunk's size")

    @classmethod
    def load(cls, spark: SparkSession | None = None, prefix: str = "quarry") -> Settings:
        """Values of ``QUARRY_<NAME>``, over those of ``quarry.<name>`` in the session."""
        found = {}
        for f in fields(cls):
            value = os.environ.get(f"{prefix}_{f.name}".upper())
            if value is None and spark is not None:
                value = spark.conf.get(f"{prefix}.{f.name}", None)
            if value is not None:
                found[f.name] = type(f.default)(value)
        return cls(**found)


def parse_filters(text: str | None) -> dict:
    """Filters as a JSON object; anything else is an error."""
    if not text:
        return {}
    found = json.loads(text)
    if not isinstance(found, dict):
        raise ValueError("filters must be a JSON object")
    return found


def checked_search(query: str, k: int, most: int = 100) -> tuple[str, int]:
    if not 1 <= len(query) <= 1000:
        raise ValueError("a query has 1 to 1000 characters")
    if not 1 <= k <= most:
        raise ValueError(f"k lies between 1 and {most}")
    return query, k
