"""Static range asymmetric numeral system over numpy arrays.

One frequency table, fixed before coding, serves many blocks that are coded independently of each other.  Within a block
``LANES`` interleaved states take turns, and each block keeps checkpoints (all states and the place in its words)
every ``SEGMENT`` steps, from which decoding can begin.  Blocks, checkpoints and lanes are all decoded side by side.
States are 64-bit with 32-bit words, frequencies sum to 2**SCALE.
"""

from __future__ import annotations

import numpy as np

SCALE, LANES, SEGMENT = 20, 128, 256
#: Steps of a full block; ids in one.
STEPS = 512
BLOCK_IDS = STEPS * LANES
_LOW = np.uint64(1 << 31)
_U = np.uint64


def quantize(counts: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """Frequencies of at least 1 that sum to 2**scale and follow the counts."""
    if len(counts) > 1 << scale:
        raise ValueError("more symbols than the table has slots")
    target = 1 << scale
    freq = np.maximum(1, np.floor(counts * (target / counts.sum())).astype(np.int64))
    over = int(freq.sum()) - target
    if over < 0:
        freq[int(np.argmax(freq))] -= over
    order = np.argsort(-freq, kind="stable")
    while over > 0:  # rounding up to 1 took too much: take it back from the largest, in proportion
        spare = freq[order] - 1
        take = np.minimum(spare, np.maximum(1, spare * over // max(1, int(spare.sum()))))
        enough = np.cumsum(take)
        take = np.where(enough <= over, take, np.maximum(0, over - (enough - take)))
        freq[order] -= take
        over -= int(take.sum())
    return freq


class Table:
    """Symbols (ascending ids) with quantised frequencies."""

    def __init__(self, symbols: np.ndarray, freq: np.ndarray) -> None:
        self.symbols = symbols.astype(np.uint32)
        self.freq = freq.astype(np.uint64)
        self.start = (np.cumsum(freq) - freq).astype(np.uint64)
        self._slots: np.ndarray | None = None

    @classmethod
    def of(cls, ids: np.ndarray) -> Table:
        symbols, counts = np.unique(ids, return_counts=True)
        return cls(symbols, quantize(counts))

    @property
    def slots(self) -> np.ndarray:
        """The symbol's number for each value of a state's low bits."""
        if self._slots is None:
            self._slots = np.repeat(np.arange(len(self.freq), dtype=np.uint32), self.freq.astype(np.int64))
        return self._slots

    def numbers(self, ids: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.symbols, ids) if not len(self.symbols) or self.symbols[-1] >= 1 << 24 else self._dense()[ids]

    def _dense(self) -> np.ndarray:
        dense = np.zeros(int(self.symbols[-1]) + 1, np.uint32)
        dense[self.symbols] = np.arange(len(self.symbols), dtype=np.uint32)
        return dense


def encode(table: Table, ids: np.ndarray) -> list[bytes]:
    """Blocks of ``BLOCK_IDS`` ids each, the last one shorter."""
    full = len(ids) // BLOCK_IDS * BLOCK_IDS
    blocks = _encode(table, ids[:full].reshape(-1, STEPS, LANES)) if full else []
    rest = ids[full:]
    if len(rest):
        steps = -(-len(rest) // LANES)
        padded = np.full(steps * LANES, table.symbols[int(np.argmax(table.freq))], np.uint32)
        padded[: len(rest)] = rest
        blocks += _encode(table, padded.reshape(1, steps, LANES))
    return blocks


def _encode(table: Table, ids: np.ndarray) -> list[bytes]:
    n, steps, lanes = ids.shape
    numbers = table.numbers(ids)
    state = np.full((n, lanes), _LOW)
    words = np.zeros((n, steps, lanes), np.uint32)
    spilled = np.zeros((n, steps, lanes), bool)
    checkpoints: dict[int, np.ndarray] = {}
    for t in range(steps - 1, -1, -1):
        number = numbers[:, t]
        freq, start = table.freq[number], table.start[number]
        large = state >= freq << _U(63 - SCALE)
        spilled[:, t], words[:, t] = large, state.astype(np.uint32)
        state = np.where(large, state >> _U(32), state)
        whole = state // freq
        state = (whole << _U(SCALE)) + (state - whole * freq) + start
        if t % SEGMENT == 0:
            checkpoints[t] = state.copy()
    out = []
    for b in range(n):
        before = np.concatenate(([0], np.cumsum(spilled[b].sum(axis=1))))
        head = [np.array([steps, len(checkpoints)], "<u4").tobytes()]
        for t in sorted(checkpoints):
            head += [np.array([before[t]], "<u4").tobytes(), checkpoints[t][b].astype("<u8").tobytes()]
        out.append(b"".join(head) + words[b][spilled[b]].astype("<u4").tobytes())
    return out


def decode(table: Table, blocks: list[bytes], n_ids: list[int]) -> list[np.ndarray]:
    """The ids of each block."""
    segments = []  # (block, first step, steps, place of the first word, states)
    words, base, results = [], 0, []
    for b, block in enumerate(blocks):
        steps, marks = np.frombuffer(block, "<u4", 2).tolist()
        size = 4 + 8 * LANES
        for k in range(marks):
            at = 8 + k * size
            place = int(np.frombuffer(block, "<u4", 1, at)[0])
            segments.append((b, k * SEGMENT, min(SEGMENT, steps - k * SEGMENT), base + place, np.frombuffer(block, "<u8", LANES, at + 4)))
        own = np.frombuffer(block, "<u4", offset=8 + marks * size)
        words.append(own)
        base += len(own)
        results.append(np.empty((steps, LANES), np.uint32))
    stream = np.concatenate([*words, np.zeros(LANES, np.uint32)]) if words else np.zeros(0, np.uint32)
    slots, mask = table.slots, _U((1 << SCALE) - 1)
    by_steps: dict[int, list[tuple]] = {}
    for s in segments:
        by_steps.setdefault(s[2], []).append(s)
    for steps, group in by_steps.items():
        state = np.stack([s[4] for s in group]).astype(np.uint64)
        place = np.array([s[3] for s in group], np.int64)
        out = np.empty((len(group), steps, LANES), np.uint32)
        for t in range(steps):
            low = state & mask
            number = slots[low]
            out[:, t] = table.symbols[number]
            state = table.freq[number] * (state >> _U(SCALE)) + low - table.start[number]
            short = state < _LOW
            order = np.cumsum(short, axis=1)
            word = stream[np.minimum(place[:, None] + order - 1, len(stream) - 1)]
            state = np.where(short, (state << _U(32)) | word.astype(np.uint64), state)
            place += order[:, -1]
        for (b, first, *_), part in zip(group, out):
            results[b][first : first + steps] = part
    return [r.reshape(-1)[:n] for r, n in zip(results, n_ids)]
