"""Secrets: base patterns, and random strings by their token efficiency.

Text that a byte-pair vocabulary has seen costs few tokens; random strings cost many.  A run of key characters is
reported as ``random`` if it yields few characters for each token, after known digests (hexadecimal of a digest's length,
UUIDs), and identifiers (names in snake, kebab or camel case, paths, numbers, dates) are excluded, and runs that a base
span covers.  Whole texts are searched; a document is searched in detail only if a fast scan of its bytes shows that it
holds what the pattern in question needs.

Defined cases: a null text is empty and has no spans; repeated rows are searched each; an empty table gives no rows; only
``doc_id`` and the text are read, so other columns can't clash.
"""

from __future__ import annotations

import base64
import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

KINDS = ("assign", "access", "hex", "random")
VOCABULARY = "byte_bpe_50k.tiktoken"
#: A candidate's least length, and the characters for each token below which it is random.
LEAST_LENGTH, MOST_EFFICIENCY = 20, 2.2
BATCH_ROWS = 1024

ASSIGN = re.compile(r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
#: Maximal runs, the short ones left out, as the base pattern drops them.
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{32,}")
CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{%d,}" % LEAST_LENGTH)
NAMES = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")

DIGEST_LENGTHS = {32, 40, 48, 56, 64, 96, 128}
_UUID = re.compile(r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}")
_NUMERIC = re.compile(r"[0-9TZ+/_=-]+")
_HEX_ONLY = re.compile(r"(0x)?[0-9a-fA-F]+")
#: Parts between separators, the coarse ones first.
SEPARATORS = (re.compile(r"[^+/=]+"), re.compile(r"[^+/=_-]+"))
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")


def _marks(characters: str) -> bytes:
    return bytes(49 if chr(b) in characters else 48 for b in range(256))


_HEX_MARKS = _marks("0123456789abcdef")
_KEY_MARKS = _marks("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-")


def base_spans(data: bytes, text: str | None = None) -> list[tuple[int, int, str]]:
    """(start, end, kind) in code points, by start, then kind as listed."""
    lower = data.lower()
    named = any(n in lower for n in NAMES)
    keyed = b"AKIA" in data
    hexed = b"1" * 32 in data.translate(_HEX_MARKS)
    if not (named or keyed or hexed):
        return []
    text = data.decode() if text is None else text
    found = []
    if named:
        found += [(*m.span(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if keyed:
        found += [(*m.span(), "access") for m in ACCESS.finditer(text) if len(m[0]) >= 16]
    if hexed:
        found += [(*m.span(), "hex") for m in HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


@lru_cache(maxsize=2)
def encoding(path: str):
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    return tiktoken.Encoding("quarry", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def known(candidate: str, vocabulary: str) -> bool:
    """Digests and identifiers, which may look random but aren't secrets."""
    if _UUID.fullmatch(candidate) or _NUMERIC.fullmatch(candidate):
        return True
    if _HEX_ONLY.fullmatch(candidate) and (len(candidate.removeprefix("0x")) in DIGEST_LENGTHS or candidate.isdigit()):
        return True
    parts = [p for p in re.split(r"[+/_=-]+", candidate) if p]
    words = [w for p in parts for w in _WORD.findall(p)]
    if len(words) > len(parts) and sum(map(len, words)) < 4 * len(words):
        return False  # random strings change class every other character
    # a name: made of few, long words, such as the vocabulary has seen in lower case
    words = [w.lower() for w in words if not w.isdigit()]
    return sum(map(len, words)) >= MOST_EFFICIENCY * sum(map(len, encoding(vocabulary).encode_ordinary_batch(words, num_threads=1)))


def is_random(candidate: str, vocabulary: str) -> bool:
    return len(candidate) < MOST_EFFICIENCY * len(encoding(vocabulary).encode_ordinary(candidate)) and not known(candidate, vocabulary)


def random_parts(run: str, at: int, vocabulary: str, separators: tuple[re.Pattern, ...] = SEPARATORS) -> list[tuple[int, int, str]]:
    """The run if it is random, else its random parts: between separators of paths and assignments, then of names."""
    if is_random(run, vocabulary):
        return [(at, at + len(run), "random")]
    if not separators or _UUID.fullmatch(run):
        return []
    parts = [m for m in separators[0].finditer(run) if len(m[0]) >= LEAST_LENGTH]
    return [s for m in parts for s in random_parts(m[0], at + m.start(), vocabulary, separators[1:])]


def random_spans(text: str, covered: list[tuple[int, int, str]], vocabulary: str) -> list[tuple[int, int, str]]:
    found = []
    # the base spans as runs that don't touch, in order
    starts, ends = [], []
    for s, e, _ in covered:
        if ends and s <= ends[-1]:
            ends[-1] = max(ends[-1], e)
        else:
            starts.append(s)
            ends.append(e)
    for m in CANDIDATE.finditer(text):
        start, end = m.span()
        before = bisect_left(starts, end) - 1
        if before >= 0 and ends[before] > start:
            continue
        found += random_parts(m[0], start, vocabulary)
    return found


def spans(data: bytes, vocabulary: str) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    """Base spans, and all spans."""
    base = base_spans(data)
    if b"1" * LEAST_LENGTH not in data.translate(_KEY_MARKS):
        return base, base
    more = random_spans(data.decode(), base, vocabulary)
    return base, sorted(base + more, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def written(found: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in found)


def _scan(vocabulary: str):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, BATCH_ROWS):
                batch = whole.slice(at, BATCH_ROWS)
                both = [spans(t, vocabulary) for t in batch.column(1).cast(pa.binary()).to_pylist()]
                count = lambda kind: pa.array([sum(s[2] == kind for s in base) for base, _ in both], pa.int64())
                digests = [hashlib.sha256(written(base).encode()).hexdigest() for base, _ in both]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), *map(count, KINDS), pa.array(digests, pa.string()), pa.array([written(every) for _, every in both], pa.string())],
                    names=["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"],
                )

    return scan


def scan_secrets(docs: DataFrame, vocabulary: str | None = None, text: str = "text") -> DataFrame:
    """One row for each row of ``docs``: doc_id, counts by kind, base_sha256 and spans."""
    if vocabulary is None:
        import public_tokenizers

        vocabulary = public_tokenizers.path(VOCABULARY)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), common.text_or_empty(text).alias("text"))
    return common.map_arrow(rows, _scan(vocabulary), "doc_id long, n_assign long, n_access long, n_hex long, n_random long, base_sha256 string, spans string")


def op7_token_efficiency_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(common.table(spark, sf_dir, "documents")).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_random")
