"""File events by polling: each poll lists the roots, compares with the listing it has stored, and stores the new one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import tables
from ..operators.store import Store
from . import files

KINDS = {"new": "created", "modified": "modified", "deleted": "deleted"}
_SCHEMA = "path string, hash string"


class Watch:
    """Events of files under some roots; a file counts as modified if its time or length is another one."""

    def __init__(self, store: Store, roots: list[str], name: str = "watch") -> None:
        self.store, self.roots, self.name = store, roots, name

    def poll(self, spark: SparkSession) -> DataFrame:
        """(path, event_type) since the last poll: created, modified or deleted; read from stored listings, so it may be read again."""
        listed = files.list_files(spark, self.roots)
        mark = F.concat_ws("/", F.col("modificationTime").cast("string"), F.col("length").cast("string"))
        before = self.store.version(self.name)
        old = self.store.read(self.name, _SCHEMA, before)
        self.store.write(self.name, listed.select("path", mark.alias("hash")))
        found = tables.snapshot_diff(self.store.read(self.name), old).where(F.col("outcome") != "unchanged")
        kind = F.create_map(*[F.lit(x) for pair in KINDS.items() for x in pair])
        return found.select("path", kind[F.col("outcome")].alias("event_type"))
