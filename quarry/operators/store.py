"""A store of parquet tables: each change writes a new snapshot, readers see whole ones only."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from . import tables


class Store:
    """Tables under a folder of any Hadoop file system.

    A version of a table is a file ``_versions/<number>`` that names its data folders.  It is created under the next number, which
    fails if another writer has taken that, and never changed: readers see whole versions, the greatest number being the current
    one.  Folders that none of the last ``kept`` versions names are deleted, so that a running reader keeps its files for a while.
    """

    def __init__(self, spark: SparkSession, root: str, kept: int = 3) -> None:
        self.spark, self.root, self.kept = spark, root.rstrip("/"), kept

    def _fs(self, path: str):
        jvm = self.spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        return target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), target

    def versions(self, name: str) -> list[int]:
        fs, path = self._fs(f"{self.root}/{name}/_versions")
        found = (f.getPath().getName() for f in fs.listStatus(path)) if fs.exists(path) else ()
        return sorted(int(n) for n in found if n.isdigit())

    def version(self, name: str) -> int | None:
        return max(self.versions(name), default=None)

    def _folders(self, name: str, version: int) -> list[str]:
        fs, path = self._fs(f"{self.root}/{name}/_versions/{version}")
        stream = fs.open(path)
        try:
            return bytes(stream.readAllBytes()).decode().split("\n")
        finally:
            stream.close()

    def read(self, name: str, schema: StructType | str | None = None, version: int | None = None) -> DataFrame:
        """The rows of a version, the current one by default; an empty frame of the schema where the table isn't there."""
        version = self.version(name) if version is None else version
        if version is None:
            if schema is None:
                raise LookupError(f"no table {name!r}")
            return self.spark.createDataFrame([], schema)
        return self.spark.read.parquet(*[f"{self.root}/{name}/{f}" for f in self._folders(name, version)])

    def write(self, name: str, rows: DataFrame, after: list[str] | None = None) -> None:
        """A new version of ``rows``, behind those of the folders ``after``."""
        number, folder = (self.version(name) or 0) + 1, uuid.uuid4().hex
        rows.write.parquet(f"{self.root}/{name}/{folder}")
        fs, path = self._fs(f"{self.root}/{name}/_versions/{number}")
        try:
            stream = fs.create(path, False)
        except Exception as e:
            raise OSError(f"{name}: another writer was faster") from e
        stream.write(bytearray("\n".join([*(after or []), folder]).encode()))
        stream.close()
        self._clean(name)

    def _clean(self, name: str) -> None:
        versions = self.versions(name)
        live = {f for v in versions[-self.kept :] for f in self._folders(name, v)}
        for v in versions[: -self.kept]:
            for gone in [f"{self.root}/{name}/{f}" for f in self._folders(name, v) if f not in live] + [f"{self.root}/{name}/_versions/{v}"]:
                fs, path = self._fs(gone)
                fs.delete(path, True)

    def upsert(self, name: str, changes: DataFrame, key: list[str], required: list[str] | None = None) -> None:
        self.write(name, tables.upsert(self.read(name, changes.schema), changes, key, required))

    def delete(self, name: str, gone: DataFrame, key: list[str]) -> int:
        """Rows removed."""
        before = self.read(name)
        n = before.count()
        self.write(name, tables.delete(before, gone, key))
        return n - self.read(name).count()

    def append(self, name: str, rows: DataFrame) -> None:
        """Rows behind those that are there, which aren't written again; columns must be the same."""
        version = self.version(name)
        if version is not None:
            rows = rows.select(*[F.col(f.name).cast(f.dataType) for f in self.read(name).schema])
        self.write(name, rows, self._folders(name, version) if version is not None else None)

    def reset(self, name: str) -> None:
        self.write(name, self.read(name).limit(0))

    def compact(self, name: str, files: int = 1) -> None:
        self.write(name, self.read(name).coalesce(files))

    def delete_documents(self, gone: DataFrame, documents: str = "documents", chunks: str = "chunks", vectors: str = "vectors", soft: bool = False) -> None:
        """Chunks and vectors go with their documents, whose rows go too or are marked."""
        for name in (vectors, chunks):
            if self.version(name):
                self.delete(name, gone, ["doc_id"])
        if soft:
            marked = self.read(documents).join(gone.select("doc_id", F.lit(True).alias("__gone")), "doc_id", "left")
            self.write(documents, marked.withColumn("status", F.when(F.col("__gone"), "deleted").otherwise(F.col("status"))).drop("__gone"))
        else:
            self.delete(documents, gone, ["doc_id"])


def sse_frame(kind: str, **data) -> str:
    """A server-sent event."""
    return f"data: {json.dumps({'type': kind, **data}, ensure_ascii=False)}\n\n"


def log_line(level: str, message: str, **facts) -> str:
    """``k=v`` pairs; values with blanks are quoted."""
    shown = lambda v: json.dumps(str(v), ensure_ascii=False) if " " in str(v) or not str(v) else str(v)
    return " ".join(f"{k}={shown(v)}" for k, v in {"level": level, "message": message, **facts}.items())


def task_details(rows: DataFrame, *columns: str) -> DataFrame:
    """Pending tasks, their details as JSON."""
    return rows.select(F.lit("pending").alias("status"), F.to_json(F.struct(*columns)).alias("details"))


def write_report(spark: SparkSession, folder: str, year: int, week: int, text: str) -> str:
    """A weekly report as ``weekly-YYYY-WW.md`` in a folder of any Hadoop file system; its path.  A later one of the week replaces it."""
    path = f"{folder.rstrip('/')}/weekly-{year:04d}-{week:02d}.md"
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    stream = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(target, True)
    stream.write(bytearray(text.encode()))
    stream.close()
    return path
