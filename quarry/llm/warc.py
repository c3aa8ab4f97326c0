"""WARC archives compressed by record with a Zstandard dictionary.

An archive begins with a skippable frame (magic 0x184D2A5D) that holds the dictionary, itself a Zstandard frame, as the
``.warc.zst`` convention has it; each record then is a frame of its own, with checksum, so a record can be read from its
offset with nothing but the dictionary.  A task holds an archive's records, trains its dictionary on slices from all over
them (``SAMPLE_BYTES`` together) and compresses; where there is too little to train on, the dictionary is those slices themselves.

Of records with equal payloads (of at least ``least_bytes``) the one with the largest page_id is a response and the others
revisit it.  Groups are found by SHA-256, summed before the exchange, and only those of two and more are joined back.

An archive's name holds the attempt that wrote it and only archives in the stored manifest count.

Defined cases: a null html is an empty payload; a null url gets a made-up URI; a null page_id never names a response unless all
ids of its payload are null, and then all its records are responses; rows that repeat the response's page_id are
responses too; an empty table gives no archive; only ``page_id``, ``url`` and ``html`` are read, so other columns can't clash.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

DICTIONARY_MAGIC = 0x184D2A5D
#: The dictionary's size, the bytes of records it is trained on, and the raw bytes after which an archive ends.
DICTIONARY_BYTES, SAMPLE_BYTES, ARCHIVE_BYTES = 64 << 10, 4 << 20, 64 << 20
#: The size of a slice to train on, and how many of them training takes at least.
SLICE_BYTES, LEAST_SLICES = 8 << 10, 8
LEVEL = 6
BATCH_ROWS = 256
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}/{digest}')}>"


def _uri(url: str | None, page_id: int | None) -> str:
    return quote(url, safe="%/:=&?~#+!$,;'@()*[]") if url else f"urn:page:{page_id}"


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None = None, refers_to_url: str | None = None) -> bytes:
    """One record; a revisit has the response's HTTP head, with the payload's length, but no payload."""
    digest = sha1_base32(payload)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    fields = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", _record_id(page_id, digest)),
        ("WARC-Date", DATE),
        ("WARC-Target-URI", _uri(url, page_id)),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
    ]
    if page_id is not None:
        fields.append(("X-Page-ID", str(page_id)))
    if refers_to is not None:
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", _record_id(refers_to, digest)), ("WARC-Refers-To-Target-URI", _uri(refers_to_url, refers_to)), ("X-Refers-To-Page-ID", str(refers_to))]
    fields += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    return head.encode() + block + b"\r\n\r\n"


def slices(records: list[bytes], size: int = SLICE_BYTES, most: int = SAMPLE_BYTES) -> list[bytes]:
    """Slices of the records, evenly over all their bytes."""
    every = [(k, at) for k, data in enumerate(records) for at in range(0, len(data), size)]
    step = max(1.0, len(every) * size / most)
    chosen = [every[int(i * step)] for i in range(int(len(every) / step))]
    return [records[k][at : at + size] for k, at in chosen]


def train(records: list[bytes]) -> zstandard.ZstdCompressionDict:
    """A dictionary for the records; of a few small ones, their beginnings as they are."""
    parts = slices(records)
    total = sum(map(len, parts))
    if len(parts) >= LEAST_SLICES and total >= 16 * LEAST_SLICES:
        try:
            return zstandard.train_dictionary(min(DICTIONARY_BYTES, max(256, total // 8)), parts, k=256, d=8)
        except zstandard.ZstdError:  # too much alike, or too little, for a trained one
            pass
    return zstandard.ZstdCompressionDict(b"".join(parts)[:DICTIONARY_BYTES], dict_type=zstandard.DICT_TYPE_RAWCONTENT)


class ArchiveWriter:
    """Holds an archive's records; at its end the dictionary is trained, and all are compressed."""

    def __init__(self, stream) -> None:
        self.stream, self.held, self.raw, self.at = stream, [], 0, 0
        self.offsets: list[int] = []

    def write(self, data: bytes) -> None:
        self.raw += len(data)
        self.held.append(data)

    def _put(self, data: bytes) -> None:
        self.stream.write(data)
        self.at += len(data)

    def close(self) -> None:
        dictionary = train(self.held)
        packed = zstandard.ZstdCompressor(level=19).compress(dictionary.as_bytes())
        self._put(struct.pack("<II", DICTIONARY_MAGIC, len(packed)) + packed)
        dictionary.precompute_compress(level=LEVEL)
        compressor = zstandard.ZstdCompressor(level=LEVEL, dict_data=dictionary, write_checksum=True, write_content_size=True)
        for data in self.held:
            self.offsets.append(self.at)
            self._put(compressor.compress(data))
        self.held = []
        self.stream.close()


def read_dictionary(stream) -> tuple[zstandard.ZstdCompressionDict | None, int]:
    """The dictionary of an archive, and where its first record begins."""
    head = stream.read(8)
    magic, size = struct.unpack("<II", head) if len(head) == 8 else (0, 0)
    if magic != DICTIONARY_MAGIC:
        return None, 0
    return zstandard.ZstdCompressionDict(zstandard.ZstdDecompressor().decompress(stream.read(size))), 8 + size


def frames(stream, window: int = 1 << 18) -> Iterator[bytes]:
    """The content of each frame after the leading one; memory holds a record and a window of the archive."""
    dictionary, at = read_dictionary(stream)
    stream.seek(at)
    decompressor = zstandard.ZstdDecompressor(dict_data=dictionary)
    rest = stream.read(window)
    while rest:
        frame, parts = decompressor.decompressobj(), []
        while not frame.eof:
            if not rest:
                raise OSError("the archive ends within a record")
            parts.append(frame.decompress(rest))
            rest = frame.unused_data if frame.eof else stream.read(window)
        yield b"".join(parts)
        rest = rest or stream.read(window)


def parse(data: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """WARC fields, HTTP fields and payload of a record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    fields = dict(line.split(": ", 1) for line in lines)
    size = int(fields["Content-Length"])
    if first != "WARC/1.1" or rest[size:] != b"\r\n\r\n":
        raise OSError("not a whole record")
    head, _, payload = rest[:size].partition(b"\r\n\r\n")
    return fields, dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:]), payload


def records(stream) -> Iterator[tuple[dict[str, str], dict[str, str], bytes]]:
    """The records of an archive, in order."""
    return map(parse, frames(stream))


def read_record(stream, offset: int, length: int) -> tuple[dict[str, str], dict[str, str], bytes]:
    """One record by its place, with nothing else read but the dictionary."""
    stream.seek(0)
    dictionary, _ = read_dictionary(stream)
    stream.seek(offset)
    return parse(zstandard.ZstdDecompressor(dict_data=dictionary).decompress(stream.read(length)))


def _filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


_MANIFEST = "path string, n_records long, n_bytes long, offsets array<long>"
_MANIFEST_ARROW = pa.schema([("path", pa.string()), ("n_records", pa.int64()), ("n_bytes", pa.int64()), ("offsets", pa.list_(pa.int64()))])


def _writer(folder: str):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        fs, base = _filesystem(folder)
        archive, name, number = None, "", 0

        def close() -> pa.RecordBatch:
            nonlocal archive
            archive.close()
            row = {"path": f"{folder}/{name}", "n_records": len(archive.offsets), "n_bytes": archive.at, "offsets": archive.offsets}
            archive = None
            return pa.RecordBatch.from_pylist([row], _MANIFEST_ARROW)

        for whole in batches:
            for at in range(0, whole.num_rows, BATCH_ROWS):
                part = whole.slice(at, BATCH_ROWS)
                columns = [part.column(i).to_pylist() for i in (0, 1, 3, 4)]
                for page, url, target, target_url, html in zip(*columns, part.column(2).cast(pa.binary()).to_pylist()):
                    if archive is None:
                        name = f"pages-{context.partitionId():06d}-{number:05d}-{context.taskAttemptId()}.warc.zst"
                        archive, number = ArchiveWriter(fs.open_output_stream(f"{base}/{name}", compression=None)), number + 1
                    archive.write(record(page, url, html, target, target_url))
                    if archive.raw >= ARCHIVE_BYTES:
                        yield close()
        if archive is not None:
            yield close()

    return write


def write_archives(pages: DataFrame, folder: str, least_bytes: int = 0) -> DataFrame:
    """Write the archives; the manifest (path, n_records, n_bytes, offsets) lists them."""
    fs, base = _filesystem(folder)
    fs.create_dir(base, recursive=True)
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), common.text_or_empty("html").alias("html"))
    rows = rows.withColumn("sha", F.unhex(F.sha2("html", 256)))
    groups = rows.where(F.octet_length("html") >= least_bytes).groupBy("sha").agg(F.count(F.lit(1)).alias("n"), F.max(F.struct("page_id", "url")).alias("owner"))
    groups = common.materialize(groups.where("n > 1").select("sha", "owner"), "warc-groups")
    joined = rows.join(groups, "sha", "left")
    other = F.col("owner.page_id").isNotNull() & ~F.col("owner.page_id").eqNullSafe(F.col("page_id"))
    marked = joined.select("page_id", "url", "html", F.when(other, F.col("owner.page_id")).alias("refers_to"), F.when(other, F.col("owner.url")).alias("refers_to_url"))
    return common.materialize(common.map_arrow(marked, _writer(folder), _MANIFEST), "warc-manifest")


def _reader(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
    whole = lambda x: None if x is None else int(x)

    def out(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    for batch in batches:
        for path in batch.column(0).to_pylist():
            fs, place = _filesystem(path)
            rows: list[tuple] = []
            with fs.open_input_file(place) as stream:
                for fields, http, payload in records(stream):
                    digest, size = fields["WARC-Payload-Digest"].removeprefix("sha1:"), int(http["Content-Length"])
                    if fields["WARC-Type"] == "response" and (sha1_base32(payload), len(payload)) != (digest, size):
                        raise OSError(f"{path}: the payload of {fields['WARC-Record-ID']} is damaged")
                    rows.append((whole(fields.get("X-Page-ID")), size, digest, fields["WARC-Type"], whole(fields.get("X-Refers-To-Page-ID"))))
                    if len(rows) == 4096:
                        yield out(rows)
                        rows = []
            if rows:
                yield out(rows)


def read_archives(manifest: DataFrame) -> DataFrame:
    """One row for each record: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    files = manifest.select("path").repartition(4 * common.parallelism(manifest.sparkSession))
    return common.map_arrow(files, _reader, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def op3_warc_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_archives(write_archives(common.table(spark, sf_dir, "pages"), common.scratch(spark, "warc")))


OP3_SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS payload FROM pages
), d AS (
  SELECT page_id, payload, sha1(payload) AS x, max(page_id) OVER (PARTITION BY payload) AS owner FROM p
)
SELECT page_id, strlen(payload)::BIGINT AS payload_bytes,
       array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                               (((('0x' || substr(x, (5 * (i // 4) + 1)::INT, 5))::INT >> (5 * (3 - i % 4))::INT) & 31) + 1)::INT, 1)
                        for i in range(32)], '') AS payload_digest,
       CASE WHEN page_id = owner THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> owner THEN owner END AS refers_to
FROM d
"""
