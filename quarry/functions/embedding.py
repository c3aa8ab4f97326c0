"""Embedding providers and the coordinator: cache, quota, provider for what is missing.

No model comes with this package.  ``HashingProvider`` is a deterministic stand-in (signed feature hashing of words,
unit length), good for tests and for keyword-like similarity, not for meaning.
"""

from __future__ import annotations

import hashlib
import time
from abc import ABC, abstractmethod
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import ship
from . import text as T


class Provider(ABC):
    """Turns texts to vectors of one length, in batches."""

    name = "provider"
    model = "model"
    dimensions = 0
    batch = 64
    delay = 0.0

    @abstractmethod
    def embed_batch(self, texts: list[str]) -> list[list[float]]: ...

    def embed(self, texts: list[str]) -> list[list[float]]:
        found: list[list[float]] = []
        for at in range(0, len(texts), self.batch):
            if at and self.delay:
                time.sleep(self.delay)
            part = retried(lambda at=at: self.embed_batch(texts[at : at + self.batch]))
            if any(len(v) != self.dimensions for v in part):
                raise ValueError(f"{self.name} gave vectors of another length than {self.dimensions}")
            found += part
        return found


class HashingProvider(Provider):
    name, model = "hashing", "signed-words"

    def __init__(self, dimensions: int = 64) -> None:
        self.dimensions = dimensions

    def embed_batch(self, texts: list[str]) -> list[list[float]]:
        out = np.zeros((len(texts), self.dimensions))
        for row, text in zip(out, texts):
            for word in text.lower().split():
                h = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "little")
                row[h % self.dimensions] += 1.0 if h >> 63 else -1.0
            row /= np.linalg.norm(row) or 1.0
        return out.tolist()


class RemoteProvider(Provider):
    """A provider behind a network interface: the caller supplies the function that sends a batch of texts."""

    def __init__(self, name: str, model: str, dimensions: int, batch: int, delay: float, send: Callable[[list[str]], list[list[float]]] | None = None) -> None:
        self.name, self.model, self.dimensions, self.batch, self.delay, self.send = name, model, dimensions, batch, delay, send

    def embed_batch(self, texts: list[str]) -> list[list[float]]:
        if self.send is None:
            raise NotImplementedError(f"{self.name}: pass send=, a function from texts to vectors")
        return self.send(texts)


#: Dimensions, texts in a batch and seconds between batches of known services.
REMOTE = {"openai": (1536, 100, 0.05), "cohere": (1024, 96, 0.05), "voyage": (1024, 128, 0.05), "local": (768, 64, 0.0)}


def _remote(name: str) -> Callable[..., Provider]:
    dimensions, batch, delay = REMOTE[name]
    return lambda model="default", send=None, dimensions=dimensions: RemoteProvider(name, model, dimensions, batch, delay, send)


_factories: dict[str, Callable[..., Provider]] = {"hashing": HashingProvider} | {name: _remote(name) for name in REMOTE}


def register(name: str, factory: Callable[..., Provider]) -> None:
    _factories[name] = factory


def provider(name: str, **options) -> Provider:
    if name not in _factories:
        raise ValueError(f"unknown provider {name!r}; known: {sorted(_factories)}")
    return _factories[name](**options)


def retried(call: Callable, attempts: int = 3, first: float = 1.0, most: float = 10.0, errors: tuple = (ConnectionError, TimeoutError)):
    """Call again after transient errors, waiting twice as long each time."""
    for n in range(attempts):
        try:
            return call()
        except errors:
            if n == attempts - 1:
                raise
            time.sleep(min(most, first * 2**n))


def embed_missing(rows: DataFrame, by: Provider, key: str, text: str) -> DataFrame:
    """(key, embedding); the provider goes to each task once."""
    ship(rows.sparkSession)
    kind = rows.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            yield pd.DataFrame({key: frame[key], "embedding": by.embed(frame[text].tolist())})

    return rows.select(key, text).mapInPandas(run, f"{key} {kind}, embedding array<double>")


def within_quota(wanted: DataFrame, text: str, quota: int) -> DataFrame:
    """Rows in order of their cache key while the running sum of tokens fits.

    Keys are digests, so their first three digits deal them evenly: sums of those 4096 parts come first, then each
    part's own running sum.
    """
    rows = wanted.withColumn("__n", T.token_estimates(text)["by_chars_floor"]).withColumn("__part", F.substring("cache_key", 1, 3))
    before = W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)
    bases = rows.groupBy("__part").agg(F.sum("__n").alias("__sum")).select("__part", F.coalesce(F.sum("__sum").over(before), F.lit(0)).alias("__base"))
    used = F.col("__base") + F.sum("__n").over(W.partitionBy("__part").orderBy("cache_key"))
    return rows.join(F.broadcast(bases), "__part").withColumn("__used", used).where(F.col("__used") <= quota).drop("__n", "__part", "__base", "__used")  # at most 4096 parts


def embed_chunks(chunks: DataFrame, cache: DataFrame, by: Provider, key: str, text: str = "text", quota: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(vectors for all chunks, rows to add to the cache).

    Chunks whose key is stored take that vector; each other distinct text goes to the provider once.  With a quota, texts are
    taken in order of key while the running sum of their tokens fits.
    """
    keyed = chunks.withColumn("cache_key", T.cache_key(text, F.lit(by.name), F.lit(by.model)))
    stored = cache.where(F.size("embedding") == by.dimensions).select("cache_key", "embedding")
    wanted = keyed.join(stored.select("cache_key"), "cache_key", "left_anti").groupBy("cache_key").agg(F.min(text).alias(text))
    if quota is not None:
        wanted = within_quota(wanted, text, quota)
    fresh = embed_missing(wanted, by, "cache_key", text)
    return keyed.join(stored.unionByName(fresh), "cache_key").select(key, "cache_key", "embedding"), fresh
