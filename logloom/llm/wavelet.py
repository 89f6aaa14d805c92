"""A wavelet matrix over the character classes of UTF-8 text.

Every byte has a class: a continuation byte, the end of a line, a blank, a mark that ends a sentence, or
any other first byte of a character. The matrix keeps one bit vector a level, with counts of the ones
before each block, so ``rank`` (how many bytes of a class stand before a place) and ``select`` (where the
n-th one stands) take a few vectorised steps for any number of queries at once. Ranks combine: the
characters before a place are its bytes without the continuation bytes, the lines before it the line
ends, the sentences line ends and marks together.

The bits are packed: two levels need a quarter of the text's own size, block counts a sixteenth more.
"""

from __future__ import annotations

import numpy as np

OTHER, LINE_END, BLANK, MARK, CONTINUATION = range(5)
LEVELS = 3
BLOCK_BYTES = 64  # bytes of a bit vector between two counts
_ONES = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).sum(1).astype(np.uint8)
_HEADS = np.array([0, *(256 - (1 << (8 - n)) for n in range(1, 8))], np.uint8)  # the first n bits of a byte


def byte_classes() -> np.ndarray:
    table = np.full(256, OTHER, np.uint8)
    table[0x80:0xC0] = CONTINUATION
    table[ord("\n")] = LINE_END
    table[[ord(" "), ord("\t")]] = BLANK
    table[[ord(c) for c in ".!?"]] = MARK
    return table


BYTE_CLASSES = byte_classes()


class Bits:
    """A packed bit vector with rank."""

    def __init__(self, bits: np.ndarray):
        self.size = len(bits)
        self.packed = np.packbits(bits)
        padding = -len(self.packed) % BLOCK_BYTES + BLOCK_BYTES
        self.packed = np.concatenate([self.packed, np.zeros(padding, np.uint8)])
        blocks = _ONES[self.packed].reshape(-1, BLOCK_BYTES).sum(1, dtype=np.int64)
        self.before = np.concatenate([[0], np.cumsum(blocks)])

    def ones(self, places: np.ndarray) -> np.ndarray:
        """How many bits are set before each place."""
        byte = places >> 3
        block = byte // BLOCK_BYTES
        whole = self.packed[(block * BLOCK_BYTES)[:, None] + np.arange(BLOCK_BYTES)]
        ahead = np.arange(BLOCK_BYTES) < (byte % BLOCK_BYTES)[:, None]
        last = _ONES[self.packed[byte] & _HEADS[places & 7]]
        return self.before[block] + (_ONES[whole] * ahead).sum(1, dtype=np.int64) + last


class WaveletMatrix:
    """Rank and select over the classes of a run of bytes."""

    def __init__(self, data: np.ndarray):
        values = BYTE_CLASSES[data]
        self.size = len(values)
        self.levels: list[tuple[Bits, int]] = []
        for level in reversed(range(LEVELS)):
            bits = (values >> level) & 1
            ones = bits.astype(bool)
            self.levels.append((Bits(bits), self.size - int(np.count_nonzero(bits))))
            values = np.concatenate([values[~ones], values[ones]])

    def _interval(self, kind: int, places: np.ndarray) -> tuple[int, np.ndarray]:
        """Where the class begins on the last level, and how far it reaches for the first ``places`` bytes."""
        start, ends = np.zeros(1, np.int64), places
        for level, (bits, zeros) in zip(reversed(range(LEVELS)), self.levels):
            if (kind >> level) & 1:
                start, ends = zeros + bits.ones(start), zeros + bits.ones(ends)
            else:
                start, ends = start - bits.ones(start), ends - bits.ones(ends)
        return int(start[0]), ends

    def rank(self, kinds: tuple[int, ...], places: np.ndarray) -> np.ndarray:
        """How many bytes of the classes stand before each place."""
        found = np.zeros(len(places), np.int64)
        for kind in kinds:
            start, ends = self._interval(kind, places)
            found += ends - start
        return found

    def select(self, kinds: tuple[int, ...], nth: np.ndarray) -> np.ndarray:
        """The least place with ``nth`` (1 or more) bytes of the classes before it, by bisection on ranks."""
        low, high = np.zeros(len(nth), np.int64), np.full(len(nth), self.size, np.int64)
        while (open_ := np.flatnonzero(low < high)).size:
            middle = (low[open_] + high[open_]) // 2
            enough = self.rank(kinds, middle) >= nth[open_]
            high[open_[enough]] = middle[enough]
            low[open_[~enough]] = middle[~enough] + 1
        return low
