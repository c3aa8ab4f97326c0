"""A stored inverted index: built once, brought up to date by what is missing or gone, read by term."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from . import keyword
from .store import Store


class KeywordIndex:
    """Postings (key, term, tf, dl) and lengths (key, dl) of chunks in a store.

    Each batch of postings is in order of term, so that a question's terms reach the parquet scan and pass over most of it; texts are
    read when chunks are added and never by a question.
    """

    def __init__(self, store: Store, name: str, key: str) -> None:
        self.store, self.key = store, key
        self.postings, self.lengths = f"{name}_postings", f"{name}_lengths"

    def _add(self, chunks: DataFrame, text: str) -> None:
        rows = keyword.postings(chunks, self.key, text)
        self.store.append(self.postings, rows.repartitionByRange("term").sortWithinPartitions("term"))
        self.store.append(self.lengths, chunks.select(self.key, F.size(T.search_terms(text)).cast("long").alias("dl")))

    def ensure(self, chunks: DataFrame, text: str = "text") -> None:
        """Index the chunks that aren't, and drop those that are no more; the whole of them where there is no index yet."""
        if self.store.version(self.lengths) is None:
            self._add(chunks, text)
            return
        known = self.store.read(self.lengths).select(self.key)
        gone = known.join(chunks.select(self.key), self.key, "left_anti")
        if not gone.isEmpty():
            self.remove(gone)
        missing = chunks.join(self.store.read(self.lengths).select(self.key), self.key, "left_anti")
        if not missing.isEmpty():
            self._add(missing, text)

    def remove(self, gone: DataFrame) -> None:
        for table in (self.postings, self.lengths):
            rows = self.store.read(table).join(gone.select(self.key).distinct(), self.key, "left_anti")
            self.store.write(table, rows.sortWithinPartitions("term") if table == self.postings else rows)

    def bm25(self, query: list[str]) -> DataFrame:
        """(key, bm25) of chunks that hold all terms of the query."""
        terms = list(dict.fromkeys(query))
        found = self.store.read(self.postings).where(F.col("term").isin(terms))
        numbers = self.store.read(self.lengths).agg(F.count(F.lit(1)).alias("n_docs"), F.avg("dl").alias("avgdl"))
        dfs = found.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
        weighed = found.join(F.broadcast(dfs), "term").crossJoin(F.broadcast(numbers))  # a row for each term of the query; one row
        part = keyword.bm25_term(F.col("tf"), F.col("dl"), F.col("avgdl"), F.col("n_docs"), F.col("df"))
        # summed in the order of the query, so that equal texts have equal scores
        by_term = [F.sum(F.when(F.col("term") == t, part)) for t in terms]
        scored = weighed.groupBy(self.key).agg(*[c.alias(f"p{i}") for i, c in enumerate(by_term)])
        total = reduce(lambda a, b: a + b, [F.col(f"p{terms.index(t)}") for t in query])  # null unless all are there
        return scored.select(self.key, total.alias("bm25")).where("bm25 is not null")
