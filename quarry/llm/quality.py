"""Quality rules by distribution divergence.

For each document one pass gives its counts and two histograms: of character classes, and of the common words of its language.
A document is rejected if it fails a base rule, or if the Jensen-Shannon distance (base 2, 0 to 1) of a histogram to
its language's reference exceeds a limit.  A histogram is judged only where it rests on enough characters or words.

References are fitted once (``fit_references``): mean histograms of documents that are labelled good, about
``REFERENCE_DOCS`` of each language where there are more, drawn by a hash of their id, from one half of the labels.  Given the
references, a document's verdict depends on that document alone.  The limits were set on the same half; the other half is for tests.

Defined cases: a null text has no words and fails the base rules; documents in a language without reference (null, others than
those below, or none labelled) are judged by the base rules only; an empty table gives no rows; only ``doc_id``, ``lang`` and
the text are read, so other columns can't clash.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Base rules: a document needs so many words, and at most this share of them in repeated windows.
MIN_WORDS, MOST_REPEATED = 50, 0.5
#: Guards: a histogram of fewer characters or words isn't judged.
MIN_CHARS, MIN_COMMON_WORDS = 400, 100
#: Limits of the distances.
MOST_CLASS_DISTANCE, MOST_WORD_DISTANCE = 0.21, 0.26
#: Documents that a language's reference rests on, where more are labelled; shares are summed as whole numbers of this unit, in any order.
REFERENCE_DOCS, UNIT = 1000, 1 << 40
BATCH_ROWS = 1024

#: Characters that count as symbols.
SYMBOLS = "#*$%&|<>"
CLASSES = ("vowel", "consonant", "upper", "digit", "white", "line", "stop", "quote", "bracket", "symbol", "other_ascii", "latin", "beyond")

#: Common words of a language.
COMMON_WORDS = {
    "de": "der die das und in zu den von mit ist auf für nicht ein eine als auch es an werden aus er hat dass sie".split(),
    "en": "the of and to in a is that for it was on are as with his they at be this have from or by not".split(),
    "es": "de la que el en y a los se del las un por con no una su para es al lo como más o pero".split(),
    "fr": "de la le et les des en un du une que est pour qui dans a par plus pas au sur ne se ce il".split(),
}
N_COMMON = 25


def _class_table() -> np.ndarray:
    """A class for each byte of UTF-8; continuation bytes get the number after the last class."""
    of = {c: k for k, c in enumerate(CLASSES)}
    table = np.full(256, of["other_ascii"], np.uint8)
    for b in range(256):
        ch = chr(b)
        if b >= 0x80:
            name = None if b < 0xC0 else "latin" if 0xC3 <= b <= 0xC9 else "beyond"
        elif ch in SYMBOLS:
            name = "symbol"
        elif ch.isalpha():
            name = "upper" if ch.isupper() else "vowel" if ch in "aeiou" else "consonant"
        elif ch.isdigit():
            name = "digit"
        elif ch == "\n":
            name = "line"
        elif ch in " \t\x0b\x0c\r":
            name = "white"
        elif ch in ".,;:!?":
            name = "stop"
        elif ch in "'\"-_`":
            name = "quote"
        elif ch in "()[]{}":
            name = "bracket"
        else:
            name = "other_ascii"
        table[b] = len(CLASSES) if name is None else of[name]
    return table


TABLE = _class_table()
_WHITE, _LINE, _SYMBOL = (CLASSES.index(c) for c in ("white", "line", "symbol"))


def repeated_words(words: list[bytes]) -> int:
    """Words that stand in a 3-word window which the text holds twice or more, the first one included."""
    windows = list(zip(words, words[1:], words[2:]))
    if len(set(windows)) == len(windows):
        return 0
    counts = Counter(windows)
    marks = bytearray(len(words))
    for i, window in enumerate(windows):
        if counts[window] > 1:
            marks[i] = marks[i + 1] = marks[i + 2] = 1
    return sum(marks)


def repeated_lines(text: bytes) -> int:
    lines = [x for x in text.split(b"\n") if x.strip()]
    return len(lines) - len(set(lines))


def features(text: bytes, lang: str | None) -> tuple[int, int, int, int, int, list[int], list[int]]:
    words = text.split()  # for bytes: white space is [\x20\x09-\x0D]
    classes = np.bincount(TABLE[np.frombuffer(text, np.uint8)], minlength=len(CLASSES) + 1)[: len(CLASSES)] if text else np.zeros(len(CLASSES), np.int64)
    counts = Counter(words)
    common_words = [counts[w.encode()] + counts[w.capitalize().encode()] * (len(w) > 0) for w in COMMON_WORDS.get(lang or "", [])] or [0] * N_COMMON
    return (
        len(words),
        int(classes.sum() - classes[_WHITE] - classes[_LINE]),
        int(classes[_SYMBOL]),
        repeated_lines(text),
        repeated_words(words),
        classes.tolist(),
        [*common_words, len(words) - sum(common_words)],
    )


# References ----------------------------------------------------------------------------------------------------------

#: For each language: shares of the character classes, and of the common words and the rest.
References = dict[str, tuple[np.ndarray, np.ndarray]]


def shares(counts: np.ndarray) -> np.ndarray:
    """Rows of counts as shares; a row without any stays zero."""
    return counts / np.maximum(1, counts.sum(axis=1, keepdims=True))


def base_failed(n_words, n_repeat_words):
    return (n_words < MIN_WORDS) | (n_repeat_words > MOST_REPEATED * n_words)


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[str | None], list[np.ndarray]]]:
    """Slices of batches with language and text last, their languages, and the columns of their features."""
    for whole in batches:
        for at in range(0, whole.num_rows, BATCH_ROWS):
            batch = whole.slice(at, BATCH_ROWS)
            n = batch.num_columns
            langs = batch.column(n - 2).to_pylist()
            found = [features(t, lang) for t, lang in zip(batch.column(n - 1).cast(pa.binary()).to_pylist(), langs)]
            yield batch, langs, [np.array(c, np.int64) for c in zip(*found)]


def _reference_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, _, (n_words, _, _, _, n_repeat_words, classes, common_words) in _batches(batches):
        units = np.round(np.concatenate((shares(classes), shares(common_words)), axis=1) * UNIT).astype(np.int64)
        good = pa.array(~base_failed(n_words, n_repeat_words))
        yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(list(units), pa.list_(pa.int64()))], names=["lang", "units"]).filter(good)


def _columns(text: str) -> list:
    return [F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), common.text_or_empty(text).alias("text")]


def fitting_half():
    """Whether references may rest on a labelled document."""
    return F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0


def fit_references(docs: DataFrame, labels: DataFrame, most: int = REFERENCE_DOCS, text: str = "text") -> References:
    """References from ``docs`` and the labels (doc_id, quality); a document with contradicting labels isn't good."""
    good = labels.select(F.col("doc_id").cast("long").alias("doc_id"), "quality").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    good = good.where((F.col("quality") == 1) & fitting_half()).select("doc_id")
    rows = docs.select(*_columns(text)).where(F.col("lang").isin(*COMMON_WORDS))
    ids = common.materialize(rows.select("doc_id", "lang").distinct().join(good, "doc_id"), "quality-labelled")
    counts = {r["lang"]: r["n"] for r in ids.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    share = F.create_map(*[F.lit(x) for lang in counts for x in (lang, most / counts[lang])]) if counts else F.lit(None)
    ids = ids.where(F.pmod(F.xxhash64("lang", "doc_id"), F.lit(1 << 30)) < share[F.col("lang")] * (1 << 30)) if counts else ids
    # about ``most`` ids of each of the languages above
    chosen = rows.join(F.broadcast(ids), ["doc_id", "lang"], "left_semi").select("doc_id", "lang", "text")
    units = common.map_arrow(chosen, _reference_rows, "lang string, units array<long>")
    n = len(CLASSES) + N_COMMON + 1
    sums = units.groupBy("lang").agg(F.array(*[F.sum(F.col("units")[i]) for i in range(n)]).alias("sums")).collect()
    means = {r["lang"]: np.array(r["sums"], float) for r in sums}
    return {lang: tuple(part / part.sum() for part in np.split(x, [len(CLASSES)])) for lang, x in means.items()}


# Verdicts ------------------------------------------------------------------------------------------------------------


def js_distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance of each row of shares to the same row of others."""

    def part(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return (a * np.log2(np.where(a > 0, 2 * a, 1) / np.where(a > 0, a + b, 1))).sum(axis=1)

    return np.sqrt(np.maximum(0, (part(p, q) + part(q, p)) / 2))


def judge(references: References, langs: list[str | None], columns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """base_failed, both distances (not a number: not judged) and kept."""
    n_words, n_chars, _, _, n_repeat_words, classes, common_words = columns
    failed = base_failed(n_words, n_repeat_words)
    distances = []
    judged = np.array([lang in references for lang in langs], bool)
    for k, (counts, enough) in enumerate(((classes, n_chars >= MIN_CHARS), (common_words, n_words >= MIN_COMMON_WORDS))):
        own = np.full(len(langs), np.nan)
        rows = np.flatnonzero(judged & enough)
        if len(rows):
            own[rows] = js_distance(shares(counts[rows]), np.stack([references[langs[i]][k] for i in rows]))
        distances.append(own)
    diverges = (np.nan_to_num(distances[0]) > MOST_CLASS_DISTANCE) | (np.nan_to_num(distances[1]) > MOST_WORD_DISTANCE)
    return failed, *distances, ~failed & ~diverges


_SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, class_distance double, word_distance double"


def quality(docs: DataFrame, references: References, text: str = "text") -> DataFrame:
    """One row for each row of ``docs``: the counts, base_failed, both distances (null: not judged) and kept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, langs, columns in _batches(batches):
            failed, by_class, by_word, kept = judge(references, langs, columns)
            distances = [pa.array(d, pa.float64(), from_pandas=True) for d in (by_class, by_word)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, columns[:5]), pa.array(failed), pa.array(kept), *distances], names=[c.split()[0] for c in _SCHEMA.split(", ")])

    return common.map_arrow(docs.select(*_columns(text)), run, _SCHEMA)


def passing(docs: DataFrame, references: References, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that are kept, with all their columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, langs, columns in _batches(batches):
            kept = judge(references, langs, columns)[-1]
            yield batch.select(list(range(batch.num_columns - 2))).filter(pa.array(kept))

    # the columns that are read come last, under names of their own
    read = [F.col("lang").cast("string").alias("__quality_lang"), common.text_or_empty(text).alias("__quality_text")]
    return common.map_arrow(docs.select("*", *read), run, docs.schema)


def op4_quality_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    return quality(docs, fit_references(docs, common.table(spark, sf_dir, "labels")))
