"""Personal data: base patterns, and spans that a character-level bidirectional LSTM with CRF transitions finds.

The tagger is trained in numpy on labelled spans that ``training_set`` writes: kinds in the forms of the base patterns and
in forms which those miss (national telephone numbers, written-out addresses, IPv6, cards with other separators), among
dates, prices, versions and other numbers that are none.  Texts are cut into windows that overlap by half; windows are
decoded and their spans reconciled over the whole text: parts of a span that the edges of windows cut are joined, a part
gives way to the whole span in the next window, equal ones become one, and of those that overlap the set with the greatest
total score stays.  What the tagger proposes must be well formed for its kind and touch no base span.

A well-formed span has four digits, an "at" sign (as such or in brackets) or two colons.  Windows with none of these therefore add
nothing and aren't decoded, unless a span that is cut in a neighbouring window goes on in them; ``every`` decodes all the same, and a
test holds that against this.

Defined cases: a null text is empty and has no spans; repeated rows are searched each; an empty table gives no rows; only
``doc_id`` and the text are read, so other columns can't clash.
"""

from __future__ import annotations

import hashlib
import ipaddress
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .lstm_crf import BiLstmCrf, char_ids

KINDS = ("email", "ip", "card", "phone")
#: Tags: none, then begin and inside of each kind.
N_TAGS = 1 + 2 * len(KINDS)
WINDOW, STRIDE = 96, 48
#: Training: labelled windows, steps of 64 windows each, and the seed of both.
TRAINING_WINDOWS, TRAINING_STEPS, SEED = 6000, 260, 7
BATCH_ROWS, DECODED_TOGETHER = 1024, 512

# Base patterns.  Runs are entered at their beginning only, which finds the same matches without retrying inside a run.
_EMAIL_RIGHT = re.compile(r"@[A-Za-z0-9-]++(\.[A-Za-z0-9-]++)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LEFT = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _is_byte(digits: str) -> bool:
    """Whether a decimal number, of any length and with any leading zeros, is at most 255."""
    digits = digits.lstrip("0")
    return len(digits) <= 3 and int(digits or "0") <= 255


def base_spans(text: str, has_digits: bool = True) -> list[tuple[int, int, str]]:
    """(start, end, kind) in code points, by kind as listed, then start."""
    found = []
    at, floor = text.find("@"), 0
    while at >= 0:
        start = at
        while start > floor and text[start - 1] in _LEFT:
            start -= 1
        if start < at and (m := _EMAIL_RIGHT.match(text, at)):
            found.append((start, m.end(), "email"))
            floor = m.end()
            at = text.find("@", floor)
        else:
            floor = at + 1  # no later match begins before this sign
            at = text.find("@", at + 1)
    if has_digits:
        found += [(*m.span(), "ip") for m in _IP.finditer(text) if all(_is_byte(p) for p in m[0].split("."))]
        found += [(*m.span(), "card") for m in _CARD.finditer(text) if 13 <= len(d := _digits(m[0])) <= 19 and luhn(d)]
        if "+" in text:
            found += [(*m.span(), "phone") for m in _PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15]
    return found


# Training data -----------------------------------------------------------------------------------------------------

_WORDS = (
    "the of and to in for with from by call me at home write mail send payment order number please contact us office server host "
    "address tel phone fax card visa account der die und ist von bitte Konto Anruf unter Adresse le la les est pour avec numéro "
    "appelez el los con para por favor llame tarjeta correo invoice version released on page price total was about near"
).split()


class _Writer:
    """Random texts with labelled spans."""

    def __init__(self, seed: int) -> None:
        self.rng = np.random.default_rng(seed)

    def pick(self, options):
        return options[int(self.rng.integers(len(options)))]

    def digits(self, n: int) -> str:
        return "".join(map(str, self.rng.integers(0, 10, n)))

    def word(self) -> str:
        if self.rng.random() < 0.5:
            return self.pick(_WORDS)
        return "".join(self.pick(["an", "th", "er", "on", "re", "ing", "ed", "st", "é", "ü", "ción", "sch", "ou", "a", "e", "ti"]) for _ in range(int(self.rng.integers(1, 5))))

    def name(self) -> str:
        return "".join(self.pick("abcdefghijklmnopqrstuvwxyz") for _ in range(int(self.rng.integers(2, 8))))

    def email(self) -> str:
        """An address as such or written out, now and then with many long parts."""
        long = self.rng.random() < 0.25
        name = (lambda: self.name() + self.name()) if long else self.name
        user = name() + self.pick(["", ".", "_", "1"]) + name() + (self.pick([".", "_", "-"]) + name() if long else "")
        hosts = [name() + (self.pick(["", "-"]) + name() if long else "") for _ in range(int(self.rng.integers(1, 4)) if long else 1)]
        end = self.pick(["com", "org", "net", "de", "fr", "example"])
        at = self.pick(["@", " (at) ", " [at] ", "(at)", "[at]", " {at} "])
        dot = self.pick([" (dot) ", " [dot] ", "(dot)", "[dot]", "."]) if at != "@" or self.rng.random() < 0.2 else "."
        return user + at + dot.join([*hosts, end])

    def ip(self) -> str:
        if self.rng.random() < 0.6:
            return ".".join(str(x) for x in self.rng.integers(0, 256, 4))
        groups = [f"{x:x}" for x in self.rng.integers(0, 65536, 8)]
        return ":".join(groups) if self.rng.random() < 0.5 else ":".join(groups[:4]) + "::" + ":".join(groups[4:6])

    def card(self) -> str:
        head = self.pick("345") + self.digits(14)
        number = next(head + d for d in "0123456789" if luhn(head + d))
        return self.pick(["", " ", "-", ".", "/"]).join(number[i : i + 4] for i in range(0, 16, 4))

    def phone(self) -> str:
        a, b, c = self.digits(3), self.digits(3), self.digits(4)
        return self.pick([
            f"+{self.pick('123456789')}{self.digits(1)} {a} {b}{c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"0{a} {b}{c}", f"0{a}/{b}{c}",
            f"00{self.digits(2)} {a} {b} {c}", f"0{self.digits(1)} {self.digits(2)} {self.digits(2)} {self.digits(2)} {self.digits(2)}", f"+1 ({a}) {b}-{c}",
        ])

    def other(self) -> str:
        d = self.digits
        return self.pick([
            f"20{d(2)}-{d(2)}-{d(2)}", f"{d(2)}.{d(2)}.20{d(2)}", f"{d(2)}:{d(2)}:{d(2)}", f"${d(1)},{d(3)}.{d(2)}", f"{d(3)}.{d(3)},{d(2)} EUR", d(int(self.rng.integers(1, 9))), f"v{d(1)}.{d(1)}.{d(2)}",
            f"#{d(6)}", f"{d(2)}-{d(2)}", f"20{d(2)}", f"no. {d(7)}", "".join(self.pick("0123456789abcdef") for _ in range(int(self.rng.integers(8, 40)))), d(int(self.rng.integers(17, 30))),
            f"ISBN 978-{d(1)}-{d(4)}-{d(4)}-{d(1)}", f"{d(1)}.{d(2)}", f"{d(2)} %", f"20{d(2)}-{d(2)}-{d(2)}T{d(2)}:{d(2)}:{d(2)}", f"{d(4)}/{d(4)}",
        ])

    def text(self, length: int) -> tuple[str, list[tuple[int, int, str]]]:
        out, spans, size = [], [], 0
        while size < length:
            r = self.rng.random()
            kind = self.pick(KINDS) if r < 0.14 else None
            part = getattr(self, kind)() if kind else self.other() if r < 0.26 else self.word()
            before = self.pick(["", "", "", "(", "<", '"']) if kind else ""
            if kind:
                spans.append((size + len(before), size + len(before) + len(part), kind))
            piece = before + part + self.pick([" ", " ", " ", " ", ", ", ". ", "\n", ") ", ": "])
            out.append(piece)
            size += len(piece)
        return "".join(out), spans


def tags_of(spans: list[tuple[int, int, str]], start: int, length: int) -> np.ndarray:
    tags = np.zeros(length, np.int64)
    for s, e, kind in spans:
        k = 1 + 2 * KINDS.index(kind)
        lo, hi = max(0, s - start), min(length, e - start)
        if lo < hi:
            tags[lo:hi] = k + 1
            if s >= start:
                tags[lo] = k
    return tags


def training_set(n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Windows of characters and their tags; one in ten ends early, as a short text does."""
    writer = _Writer(seed)
    ids, tags = [], []
    while len(ids) < n:
        text, spans = writer.text(WINDOW * 12)
        for start in range(0, len(text) - WINDOW, WINDOW):
            length = int(writer.rng.integers(20, WINDOW)) if writer.rng.random() < 0.1 else WINDOW
            own = tags_of(spans, start, length)
            ids.append(char_ids(text[start : start + length], WINDOW))
            tags.append(np.pad(own, (0, WINDOW - length)))
    return np.array(ids[:n]), np.array(tags[:n])


@lru_cache(maxsize=2)
def trained(windows: int = TRAINING_WINDOWS, steps: int = TRAINING_STEPS, seed: int = SEED) -> BiLstmCrf:
    """The tagger; trained once in a process, and the same each time."""
    model = BiLstmCrf(N_TAGS, seed=seed)
    model.fit(*training_set(windows, seed), steps=steps, seed=seed)
    return model


# Search ------------------------------------------------------------------------------------------------------------

_ANCHOR = re.compile(r"[0-9]|@|[(\[{]\x20?at\x20?[)\]}]|:")
_AT = re.compile(r"[A-Za-z0-9._%+-]+\x20?(?:@|[(\[{]\x20?at\x20?[)\]}])\x20?[A-Za-z0-9-]+(?:\x20?(?:\.|[(\[{]\x20?dot\x20?[)\]}])\x20?[A-Za-z0-9-]+)+")
#: With three separators in a row at most, so that a window over a good part of one has four digits.
_PHONE_FORM = re.compile(r"[+(]?[0-9](?:[\x20()./-]{0,3}[0-9])+")
_CARD_FORM = re.compile(r"[0-9]+(?:[\x20./-][0-9]+)*")
#: A date alone is no telephone number, nor is anything with a date and its full year.
_FULL_DATE = re.compile(r"(?:19|20)[0-9]{2}[-./][0-9]{1,2}[-./][0-9]{1,2}|[0-9]{1,2}[-./][0-9]{1,2}[-./](?:19|20)[0-9]{2}(?![0-9])")
_DATE = re.compile(r"(?:19|20)[0-9]{2}[-./][0-9]{1,2}[-./][0-9]{1,2}|[0-9]{1,2}[-./][0-9]{1,2}[-./](?:19|20)?[0-9]{2}")


def well_formed(span: str, kind: str) -> bool:
    digits = _digits(span)
    if kind == "email":
        return _AT.fullmatch(span) is not None
    if kind == "card":
        return 13 <= len(digits) <= 19 and _CARD_FORM.fullmatch(span) is not None and luhn(digits)
    if kind == "phone":
        # with separators: a bare run of digits says too little
        return 9 <= len(digits) <= 15 and _PHONE_FORM.fullmatch(span) is not None and not span.isdigit() and _DATE.fullmatch(span) is None and _FULL_DATE.search(span) is None
    if len(digits) < 4 and span.count(":") < 2:
        return False
    try:
        ipaddress.ip_address(span)
    except ValueError:
        return False
    return True


def _last_window(text: str) -> int:
    return max(0, -(-(len(text) - WINDOW) // STRIDE))


def windows_of(text: str) -> list[int]:
    """Numbers of the windows that may hold a well-formed span."""
    last = _last_window(text)
    digits: dict[int, int] = {}
    colons: dict[int, int] = {}
    chosen = set()
    for m in _ANCHOR.finditer(text):
        k = m.start() // STRIDE
        for w in (k - 1, k):
            if 0 <= w <= last:
                if m[0] == ":":
                    colons[w] = colons.get(w, 0) + 1
                elif m[0].isdigit():
                    digits[w] = digits.get(w, 0) + 1
                else:
                    chosen.add(w)
    return sorted(chosen | {w for w, n in digits.items() if n >= 4} | {w for w, n in colons.items() if n >= 2})


def joined(parts: list[tuple[int, int, str, float, bool, bool]]) -> list[tuple[int, int, str, float]]:
    """Spans from parts (start, end, kind, score, cut on the left, cut on the right) that overlap the next part of their kind."""
    out = []
    for kind in KINDS:
        own = sorted((p for p in parts if p[2] == kind), key=lambda p: (p[0], p[1]))
        held: tuple[int, int, float] | None = None  # begins whole and is cut on the right
        for start, end, _, score, left, right in own:
            if not left and not right:
                out.append((start, end, kind, score))
            if held and start < held[1] <= end and (left or right):
                held = (held[0], end, held[2] + score)
                if not right:
                    out.append((held[0], end, kind, held[2]))
                    held = None
            elif held and start < held[1] <= end:
                out.append((held[0], end, kind, held[2] + score))
            elif right and not left:
                held = (start, end, score)
    return out


def reconcile(found: list[tuple[int, int, str, float]]) -> list[tuple[int, int, str]]:
    """Of spans from all windows, the set without overlaps that has the greatest total score."""
    best: dict[tuple[int, int, str], float] = {}
    for s, e, kind, score in found:
        best[s, e, kind] = max(score, best.get((s, e, kind), 0.0))
    spans = sorted(best, key=lambda x: (x[1], x[0], x[2]))
    ends = [s[1] for s in spans]
    chain: list[tuple[float, int, int]] = [(0.0, -1, -1)]  # score so far, span taken, where it goes on
    for i, span in enumerate(spans):
        j = bisect_right(ends, span[0], 0, i)
        take = chain[j][0] + best[span]
        chain.append((take, i, j) if take > chain[i][0] else (chain[i][0], -1, i))
    out, at = [], len(spans)
    while at > 0:
        _, i, j = chain[at]
        if i >= 0:
            out.append(spans[i])
        at = j
    return out[::-1]


def _parts(model: BiLstmCrf, texts: list[str], places: list[tuple[int, int]]) -> Iterator[tuple[int, int, tuple[int, int, str, float, bool, bool]]]:
    """(text, window, part of a span) for windows (text, number)."""
    for at in range(0, len(places), DECODED_TOGETHER):
        part = places[at : at + DECODED_TOGETHER]
        tags, margins = model.decode(np.array([char_ids(texts[i][w * STRIDE : w * STRIDE + WINDOW], WINDOW) for i, w in part]))
        for row in np.flatnonzero(tags.any(axis=1)):
            i, w = part[row]
            start = w * STRIDE
            n = min(WINDOW, len(texts[i]) - start)
            own, margin = tags[row, :n], margins[row]
            p = 0
            while p < n:
                if own[p] == 0:
                    p += 1
                    continue
                kind, q = (own[p] - 1) // 2, p + 1
                while q < n and own[q] == 2 + 2 * kind:
                    q += 1
                yield i, w, (start + p, start + q, KINDS[kind], float(margin[p:q].sum()), p == 0 and start > 0, q == n and start + n < len(texts[i]))
                p = q


def added_spans(model: BiLstmCrf, texts: list[str], base: list[list[tuple[int, int, str]]], every: bool = False) -> list[list[tuple[int, int, str]]]:
    """The tagger's spans for each text, without those that are malformed or touch a base span."""
    places = [(i, w) for i, text in enumerate(texts) for w in (range(_last_window(text) + 1) if every else windows_of(text))]
    seen = set(places)
    raw: list[list[tuple[int, int, str, float, bool, bool]]] = [[] for _ in texts]
    while places:
        following = []
        for i, w, part in _parts(model, texts, places):
            raw[i].append(part)
            # the windows on which a cut span goes on
            following += [(i, v) for v, cut in ((w - 1, part[4]), (w + 1, part[5])) if cut and 0 <= v <= _last_window(texts[i])]
        places = sorted(set(following) - seen)
        seen.update(places)
    out = []
    for text, spans, parts in zip(texts, base, raw):
        ends = [(s, e) for s, e, _ in sorted(spans)]
        upto = list(accumulate((e for _, e in ends), max))  # base spans may overlap
        starts = [s for s, _ in ends]
        touches = lambda s, e: (k := bisect_left(starts, e)) > 0 and upto[k - 1] > s
        good = [c for c in joined(parts) if c[3] > 0 and well_formed(text[c[0] : c[1]], c[2]) and not touches(c[0], c[1])]
        # a number that goes on outside of the span is not a whole one
        good = [c for c in good if not (c[0] and text[c[0] - 1].isalnum()) and not (c[1] < len(text) and text[c[1]].isalnum())]
        out.append(reconcile(good))
    return out


def written(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in sorted(spans, key=lambda s: (KINDS.index(s[2]), s[0], s[1])))


def _search(model: BiLstmCrf):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, BATCH_ROWS):
                batch = whole.slice(at, BATCH_ROWS)
                data = batch.column(1).cast(pa.binary()).to_pylist()
                base: list[list[tuple[int, int, str]]] = [[] for _ in data]
                more: list[list[tuple[int, int, str]]] = [[] for _ in data]
                texts, where = [], []
                for i, raw in enumerate(data):
                    digits = len(raw.translate(None, b"0123456789")) < len(raw)
                    if digits or b"@" in raw or b":" in raw or b"at" in raw and _ANCHOR.search(raw.decode()):
                        text = raw.decode()
                        base[i] = base_spans(text, digits)
                        texts.append(text)
                        where.append(i)
                for i, spans in zip(where, added_spans(model, texts, [base[i] for i in where])):
                    more[i] = spans
                count = lambda kind: pa.array([sum(s[2] == kind for s in spans) for spans in base], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0), *map(count, KINDS), pa.array([hashlib.sha256(written(s).encode()).hexdigest() for s in base], pa.string()),
                        pa.array([written(s + m) for s, m in zip(base, more)], pa.string()), pa.array([len(m) for m in more], pa.int64()),
                    ],
                    names=["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added"],
                )

    return search


def find_personal_data(docs: DataFrame, model: BiLstmCrf | None = None, text: str = "text") -> DataFrame:
    """One row for each row of ``docs``: doc_id, base counts by kind, base_sha256, spans (all) and n_added."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), common.text_or_empty(text).alias("text"))
    schema = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long"
    return common.map_arrow(rows, _search(model or trained()), schema)


def op2_pii_bilstm_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_personal_data(common.table(spark, sf_dir, "documents"))
