"""Token ids by the tokenizers library, with each distinct word of a batch encoded once.

For a vocabulary that drops white space and never joins across it, a text's ids are those of its words in order.
``WordEncoder`` therefore splits a batch into words, gives the library the distinct ones and looks all others up; nothing
is kept from one batch to the next, so memory is bounded by the batch.  Words whose pieces are plain to see (ASCII, and
Latin letters) go to a second instance of the same model that only splits at spaces, all in one call; the rest goes through
the whole tokenizer.  This needs a tokenizer that lower-cases and splits by the pattern below, such as
``word_bpe_49k.json``; ``supported`` says so.
"""

from __future__ import annotations

import codecs
import json
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

VOCABULARY = "word_bpe_49k.json"
#: Bytes of text that are encoded together; a longer text is a batch of its own.
BATCH_BYTES = 4 << 20
#: The tokenizer's pattern for pieces of words, and the same for lower-case ASCII.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_ASCII_PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^a-z0-9]+")
_MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
#: Letters whose normal form is their own and whose lower case is one letter in any context.
_LATIN = "^[A-Za-zÀ-ÖØ-öø-įı-ɏ]+$"
_LATIN_OR_DIGIT_LAST = "[0-9A-Za-zÀ-ÖØ-öø-įı-ɏ]$"
_PRINTABLE = "^[!-~]+$"


def _byte_characters() -> str:
    """The character that stands for each byte in byte-level vocabularies: itself if printable, else from 256 on.
    The space stays, as it parts words here."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    table = [chr(b if b in own else next(others)) for b in range(256)]
    table[32] = " "
    return "".join(table)


_CHARACTERS = _byte_characters()


def default_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_batches(batch: pa.RecordBatch, column: int = 1, most: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose texts have at most so many bytes together, or one row."""
    upto = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    at = 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + most, "right")))
        yield batch.slice(at, end - at)
        at = end


def _gather(flat: np.ndarray, first: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs ``flat[first[i]:first[i + 1]]`` for each i of ``at``, one after another, and their lengths."""
    runs = pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(flat))
    return runs.take(pa.array(at)).flatten().to_numpy(), np.diff(first)[at]


class WordEncoder:
    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a worker is one of many on its machine
        from tokenizers import Tokenizer, pre_tokenizers

        self.library = Tokenizer.from_file(path)
        if not supported(self.library):
            raise ValueError(f"{path}: words can't be encoded one by one under this tokenizer")
        self.model = Tokenizer(self.library.model)  # shares the vocabulary and merges
        self.model.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        tokens = map(self.library.id_to_token, range(self.library.get_vocab_size(with_added_tokens=True)))
        self.ends = np.array([t is not None and t.endswith("</w>") for t in tokens])

    def _whole(self, texts: list[str]) -> list[np.ndarray]:
        """Ids by the whole tokenizer."""
        return [np.array(e.ids, np.uint32) for e in self.library.encode_batch_fast(texts, add_special_tokens=False)] if texts else []

    def _encode_pieces(self, words: list[str], n_pieces: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words that are given as their pieces with spaces between, and the ends of each word's ids."""
        text = codecs.charmap_decode(" ".join(words).encode(), "strict", _CHARACTERS)[0]
        ids = np.array(self.model.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32) if words else np.empty(0, np.uint32)
        ends = np.concatenate(([0], np.flatnonzero(self.ends[ids]) + 1))
        if len(ends) != n_pieces.sum() + 1:
            raise RuntimeError("the vocabulary doesn't mark the ends of words")
        return ids, ends[np.cumsum(n_pieces)]

    def _encode_cores(self, cores: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct words, one after another, and where each word's begin (and the last one's end)."""
        letters = pc.match_substring_regex(cores, _LATIN).to_numpy(zero_copy_only=False)
        mixed = pc.match_substring_regex(cores, _PRINTABLE).to_numpy(zero_copy_only=False) & ~letters
        lower = pc.utf8_lower(cores.filter(pa.array(letters))).to_pylist()
        split = [" ".join(_ASCII_PIECES.findall(w)) for w in cores.filter(pa.array(mixed)).to_pylist()]
        others = self._whole(cores.filter(pa.array(~(letters | mixed))).to_pylist())
        n_pieces = np.concatenate((np.ones(len(lower), np.int64), np.array([w.count(" ") + 1 for w in split], np.int64)))
        ids, ends = self._encode_pieces(lower + split, n_pieces)
        # the three kinds one after another, then in the order of the words
        flat = np.concatenate([ids, *others])
        first = np.concatenate(([0], ends, len(ids) + np.cumsum([len(x) for x in others], dtype=np.int64)))
        order = np.concatenate([np.flatnonzero(kind) for kind in (letters, mixed, ~(letters | mixed))])
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        flat, lengths = _gather(flat, first, place)
        return flat, np.concatenate(([0], np.cumsum(lengths)))

    def _encode_words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The same of distinct words as they stand: marks at the end of an ASCII letter, a digit or a Latin letter are a piece of their own."""
        cores = pc.ascii_rtrim(words, characters=_MARKS)
        plain = pc.match_substring_regex(cores, _LATIN_OR_DIGIT_LAST)
        cores = pc.if_else(plain, cores, words)
        n_core = pc.binary_length(cores).to_numpy(zero_copy_only=False)
        marked = np.flatnonzero(n_core < pc.binary_length(words).to_numpy(zero_copy_only=False))
        tails = [w[n:] for w, n in zip(words.take(pa.array(marked)).cast(pa.binary()).to_pylist(), n_core[marked].tolist())]
        tail = pa.array([t.decode() for t in tails], pa.string()).dictionary_encode()
        core = cores.dictionary_encode()
        flat, first = self._encode_cores(core.dictionary)
        tail_ids, tail_ends = self._encode_pieces(tail.dictionary.to_pylist(), np.ones(len(tail.dictionary), np.int64))
        # a word is the run of its core and the run of its marks (an empty one at the end where it has none)
        runs = np.full((len(words), 2), len(first) - 1 + len(tail_ends), np.int64)
        runs[:, 0] = core.indices.to_numpy()
        runs[marked, 1] = len(first) - 1 + tail.indices.to_numpy()
        flat = np.concatenate((flat, tail_ids))
        first = np.concatenate((first, first[-1] + tail_ends, [len(flat)]))
        flat, lengths = _gather(flat, first, runs.ravel())
        return flat, np.concatenate(([0], np.cumsum(lengths.reshape(-1, 2).sum(axis=1))))

    def encode(self, texts: pa.Array | list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids, text after text, and the number of ids of each text."""
        texts = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
        texts = pc.fill_null(texts, "")
        # strings that look like special tokens would not survive the lower-casing: those texts go as a whole
        special = np.flatnonzero(pc.match_substring(texts, "<|").to_numpy(zero_copy_only=False))
        if len(special):
            keep = np.ones(len(texts), bool)
            keep[special] = False
            whole = self._whole(texts.take(pa.array(special)).to_pylist())
            texts = pc.if_else(pa.array(keep), texts, "")
        split = pc.ascii_split_whitespace(pc.ascii_trim_whitespace(pc.ascii_lower(texts)))
        words = split.flatten().dictionary_encode()  # an empty text is one empty word
        ids, lengths = _gather(*self._encode_words(words.dictionary), words.indices.to_numpy())
        word_ends = np.concatenate(([0], np.cumsum(lengths, dtype=np.int64)))
        counts = np.diff(word_ends[split.offsets.to_numpy()])
        if len(special):
            begins = np.cumsum(counts)[special]  # nothing of them is there yet
            counts[special] = list(map(len, whole))
            ids = np.insert(ids, np.repeat(begins, counts[special]), np.concatenate(whole))
        return ids, counts


def supported(tokenizer) -> bool:
    """Whether a tokenizer lower-cases words and splits by the pattern, white space dropped."""
    state = lambda part: json.loads(part.__getstate__()) if part is not None else {}
    steps = [n.get("type") for n in state(tokenizer.normalizer).get("normalizers", [])]
    first = (state(tokenizer.pre_tokenizer).get("pretokenizers") or [{}])[0]
    pattern = (first.get("pattern") or {}).get("Regex")
    return "Lowercase" in steps and first.get("behavior") == "Removed" and pattern == PIECES and tokenizer.model.end_of_word_suffix == "</w>"


@lru_cache(maxsize=2)
def encoder(path: str) -> WordEncoder:
    """The worker's encoder; it outlives tasks."""
    return WordEncoder(path)
