"""Helpers shared by the corpus operators: shared scratch space, materialised steps, byte-exact text pieces."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import suppress
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import ship


#: Rows that ``selected`` gives at a time.
SELECTED_ROWS = 1024


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Where the setting is missing, a temporary folder is used, but only in local mode: elsewhere no
    machine-local folder would do, so that is an error.
    """
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="quarry-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new name in the application's own folder under the shared one; Hadoop deletes that when the driver's JVM ends."""
    folder = f"{shared_dir(spark)}/quarry/{spark.sparkContext.applicationId}"
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(target)
    fs.deleteOnExit(target)
    return f"{folder}/{name}-{uuid.uuid4().hex[:12]}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write a step to the shared folder and read it back: lineage ends there, and a lost executor costs one task."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def drop(*steps: DataFrame) -> None:
    """Delete stored steps whose readers are all stored themselves."""
    for step in steps:
        path = step.sparkSession._jvm.org.apache.hadoop.fs.Path(step._scratch)
        path.getFileSystem(step.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def numbered(docs: DataFrame, name: str) -> DataFrame:
    """``docs`` with a column ``name`` of longs that tells rows apart and is the same in each reading of the same files.

    It is made of the file's number and the row's place in the file; rows that aren't those of files are stored first.
    """
    if docs._jdf.queryExecution().analyzed().nodeName() != "LogicalRelation":
        docs = materialize(docs, "numbered")
    path = F.xxhash64("_metadata.file_path").alias("__file")
    files = materialize(docs.select("_metadata.file_path").distinct().select(F.xxhash64("file_path").alias("__file"), F.row_number().over(W.orderBy("file_path")).alias("__number")), "files")
    if files.groupBy("__file").count().where("count > 1").count():
        raise ValueError("two files share a hash")
    rows = docs.select("*", path, F.col("_metadata.row_index").alias("__index"))
    # a row of two numbers for each file: the driver holds the list of their names already
    rows = rows.join(F.broadcast(files), "__file")
    return rows.select(*[rows[c] for c in docs.columns], (F.shiftleft(F.col("__number").cast("long"), 40) + F.col("__index")).alias(name))


def selected(rows: DataFrame, marks: DataFrame, key: str, then=None, schema=None) -> DataFrame:
    """The rows of ``rows`` whose ``key`` is among ``marks``, each as often as it is there; no row of ``rows`` is shuffled.
    ``then`` is applied to them in the same worker, and gives rows of ``schema``.

    Marks go to sorted files, a range of keys each, and a task reads those that overlap its rows' keys.  Keys that rise with
    the place of a row, as ``numbered`` gives them, need few; any others are right too.
    """
    n = parallelism(rows.sparkSession)
    marks = materialize(marks.select(F.col(marks.columns[0]).cast("long").alias("mark")).repartitionByRange(n, "mark").sortWithinPartitions("mark"), "marks")
    at = rows.columns.index(key)
    # a row for each range: their number is the parallelism
    files = marks.groupBy(F.col("_metadata.file_path").alias("path")).agg(F.min("mark").alias("low"), F.max("mark").alias("high")).collect()
    select = _selector(sorted((f["low"], f["high"], f["path"]) for f in files), at)
    return map_arrow(rows, select if then is None else lambda batches: then(select(batches)), schema or rows.schema)


def _selector(files: list[tuple[int, int, str]], at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        @lru_cache(maxsize=4)
        def marks(path: str) -> np.ndarray:
            system, place = fs.FileSystem.from_uri(path)
            return pq.read_table(place, filesystem=system)["mark"].to_numpy()

        for batch in batches:
            keys = batch.column(at).to_numpy(zero_copy_only=False)
            times = np.zeros(len(keys), np.int64)
            for low, high, path in files:
                inside = np.flatnonzero((keys >= low) & (keys <= high))
                if len(inside):
                    own = marks(path)
                    times[inside] += np.searchsorted(own, keys[inside], "right") - np.searchsorted(own, keys[inside], "left")
            chosen = np.repeat(np.arange(len(keys)), times)
            for begin in range(0, len(chosen), SELECTED_ROWS):
                yield batch.take(pa.array(chosen[begin : begin + SELECTED_ROWS]))

    return run


def parallelism(spark: SparkSession) -> int:
    """Partitions to ask for where the shuffle's own number isn't used."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(column: str = "text"):
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def gathered(batches: Iterator[pa.RecordBatch], rows: int = 1 << 14) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about so many: each batch has its price on its way to the JVM."""
    held, n = [], 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            n += batch.num_rows
        if n >= rows:
            yield pa.concat_batches(held)
            held, n = [], 0
    if held:
        yield pa.concat_batches(held)


def _tidy(function):
    """The function, which gives memory back at a task's end: its worker waits for another."""

    def run(batches):
        yield from function(batches)
        pa.default_memory_pool().release_unused()
        with suppress(OSError, AttributeError):  # only glibc has it
            ctypes.CDLL(None).malloc_trim(0)

    return run


def map_arrow(df: DataFrame, function, schema) -> DataFrame:
    """``mapInArrow`` with this package shipped to the workers."""
    ship(df.sparkSession)
    return df.mapInArrow(_tidy(function), schema)


def map_pandas(df: DataFrame, function, schema: str) -> DataFrame:
    """``mapInPandas`` with this package shipped to the workers."""
    ship(df.sparkSession)
    return df.mapInPandas(_tidy(function), schema)
