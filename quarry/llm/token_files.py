"""Token-id files: documents in ascending id order, ids coded by a static range asymmetric numeral system.

A file holds, in this order: a magic string; the coded blocks; a footer (zlib, JSON and arrays) with the
frequency table that all blocks share, the index of blocks (offset, bytes, ids, CRC-32) and that of documents (id, ids);
the footer's length and CRC-32; the magic string again.  A block can be read, checked and decoded without any other,
and from each of its checkpoints, so files may be read in parallel down to parts of a block.

Documents go through one range exchange, and each task tokenizes, counts, codes and writes its range, one file for
about ``FILE_IDS`` ids; a file's table covers all ids in it.  A file's name holds the attempt that wrote it and only those in
the stored manifest count, so lost executors and repeated attempts leave stray files at worst.

Defined cases: a null or empty text has the end id alone; null ids come first; equal ids are neighbours in any order; an
empty table gives no files and no rows; only ``doc_id`` and the text are read, so other columns can't clash.
"""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common, rans, tokens

MAGIC = b"QTOKANS1"
FILE_IDS = 1 << 21
#: Bytes of text that are encoded together: twice the encoder's own number, as a file's ids are held anyway.
BATCH_BYTES = 2 * tokens.BATCH_BYTES


def _filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def encode_file(doc_ids: list[int | None], counts: np.ndarray, ids: np.ndarray) -> bytes:
    table = rans.Table.of(ids) if len(ids) else rans.Table(np.zeros(1, np.uint32), np.array([1 << rans.SCALE]))
    blocks = rans.encode(table, ids)
    sizes = [len(b) for b in blocks]
    n_ids = [min(rans.BLOCK_IDS, len(ids) - k * rans.BLOCK_IDS) for k in range(len(blocks))]
    arrays = {
        "symbols": np.diff(table.symbols.astype(np.int64), prepend=0).astype("<u4"),
        "freq": table.freq.astype("<u4"),
        "offset": (np.cumsum([len(MAGIC), *sizes])[:-1]).astype("<u8"),
        "bytes": np.array(sizes, "<u4"),
        "n_ids": np.array(n_ids, "<u4"),
        "crc": np.array([zlib.crc32(b) for b in blocks], "<u4"),
        "doc_id": np.array([d or 0 for d in doc_ids], "<i8"),
        "no_id": np.array([d is None for d in doc_ids], "u1"),
        "counts": counts.astype("<u8"),
    }
    head = json.dumps({"scale": rans.SCALE, "lanes": rans.LANES, "segment": rans.SEGMENT, "arrays": [[k, a.dtype.str, len(a)] for k, a in arrays.items()]}).encode()
    footer = zlib.compress(struct.pack("<I", len(head)) + head + b"".join(a.tobytes() for a in arrays.values()), 6)
    return b"".join([MAGIC, *blocks, footer, struct.pack("<QI", len(footer), zlib.crc32(footer)), MAGIC])


class TokenFile:
    """Reads a file's footer, then any of its blocks."""

    TAIL = 12 + len(MAGIC)

    def __init__(self, uri: str) -> None:
        self.fs, self.path = _filesystem(uri)
        with self.fs.open_input_file(self.path) as f:
            size = f.size()
            tail = f.read_at(self.TAIL, size - self.TAIL)
            length, crc = struct.unpack("<QI", tail[:12])
            footer = f.read_at(length, size - self.TAIL - length)
        if tail[12:] != MAGIC or zlib.crc32(footer) != crc:
            raise OSError(f"{uri}: not a whole token file")
        raw = zlib.decompress(footer)
        (n,) = struct.unpack_from("<I", raw)
        head, at = json.loads(raw[4 : 4 + n]), 4 + n
        if (head["scale"], head["lanes"], head["segment"]) != (rans.SCALE, rans.LANES, rans.SEGMENT):
            raise OSError(f"{uri}: coded with other parameters")
        self.arrays = {}
        for name, kind, count in head["arrays"]:
            self.arrays[name] = np.frombuffer(raw, kind, count, at)
            at += self.arrays[name].nbytes
        self.table = rans.Table(np.cumsum(self.arrays["symbols"].astype(np.int64)), self.arrays["freq"])
        self.doc_ids = [None if none else d for d, none in zip(self.arrays["doc_id"].tolist(), self.arrays["no_id"].tolist())]
        self.counts = self.arrays["counts"].astype(np.int64)

    def blocks(self, first: int = 0, last: int | None = None) -> np.ndarray:
        """The ids of the blocks from ``first`` up to ``last``."""
        a = self.arrays
        last = len(a["bytes"]) if last is None else last
        found = []
        with self.fs.open_input_file(self.path) as f:
            for k in range(first, last):
                block = f.read_at(int(a["bytes"][k]), int(a["offset"][k]))
                if zlib.crc32(block) != a["crc"][k]:
                    raise OSError(f"{self.path}: block {k} is damaged")
                found.append(block)
        return np.concatenate([np.empty(0, np.uint32), *rans.decode(self.table, found, a["n_ids"][first:last].tolist())])


_MANIFEST = "task int, number int, path string, n_docs long, n_ids long, n_bytes long"


def _writer(folder: str, tokenizer: str, end_id: int, file_ids: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        fs, base = _filesystem(folder)
        docs: list[int | None] = []
        counts: list[np.ndarray] = []
        parts: list[np.ndarray] = []
        held, number = 0, 0

        def flush() -> pa.RecordBatch:
            nonlocal docs, counts, parts, held, number
            ids = np.concatenate(parts)
            data = encode_file(docs, np.concatenate(counts), ids)
            name = f"ids-{context.partitionId():06d}-{number:05d}-{context.taskAttemptId()}.qtok"
            with fs.open_output_stream(f"{base}/{name}", compression=None) as f:
                f.write(data)
            row = pa.RecordBatch.from_pylist(
                [{"task": context.partitionId(), "number": number, "path": f"{folder}/{name}", "n_docs": len(docs), "n_ids": len(ids), "n_bytes": len(data)}],
                pa.schema([("task", pa.int32()), ("number", pa.int32()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64()), ("n_bytes", pa.int64())]),
            )
            docs, counts, parts, held, number = [], [], [], 0, number + 1
            return row

        for whole in batches:
            for batch in tokens.byte_batches(whole, most=BATCH_BYTES):
                ids, n = tokens.encoder(tokenizer).encode(batch.column(1))
                ended = np.insert(ids, np.cumsum(n), end_id)
                docs += batch.column(0).to_pylist()
                counts.append(n + 1)
                parts.append(ended)
                held += len(ended)
                if held >= file_ids:
                    yield flush()
        if docs:
            yield flush()

    return write


def write_token_files(docs: DataFrame, folder: str, end_id: int = 1, tokenizer: str | None = None, text: str = "text", file_ids: int = FILE_IDS) -> DataFrame:
    """Write the files; the manifest (task, number, path, n_docs, n_ids, n_bytes) lists them, in order of task and number."""
    spark = docs.sparkSession
    fs, base = _filesystem(folder)
    fs.create_dir(base, recursive=True)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), common.text_or_empty(text).alias("text"))
    ordered = rows.repartitionByRange(common.parallelism(spark), "doc_id").sortWithinPartitions("doc_id")
    return common.materialize(common.map_arrow(ordered, _writer(folder, tokenizer or tokens.default_path(), end_id, file_ids), _MANIFEST), "token-manifest")


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            file = TokenFile(path)
            data = memoryview(file.blocks().astype("<u4").tobytes())
            ends = np.cumsum(file.counts)
            starts = ends - file.counts
            crcs = [zlib.crc32(data[4 * s : 4 * e]) for s, e in zip(starts.tolist(), ends.tolist())]
            yield pa.RecordBatch.from_arrays(
                [pa.array(file.doc_ids, pa.int64()), pa.array(starts + base), pa.array(file.counts), pa.array(crcs, pa.int64())],
                names=["doc_id", "start", "n_tokens", "ids_crc32"],
            )


def read_token_files(manifest: DataFrame) -> DataFrame:
    """One row for each document in the files: doc_id, start, n_tokens, ids_crc32."""
    # a row for each file: the only window without a key runs over so few
    before = W.orderBy("task", "number").rowsBetween(W.unboundedPreceding, -1)
    files = manifest.select("path", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("base"))
    files = files.repartition(4 * common.parallelism(manifest.sparkSession))
    return common.map_arrow(files, _read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op1_rans_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = write_token_files(common.table(spark, sf_dir, "documents"), common.scratch(spark, "token-files"))
    return read_token_files(manifest)
