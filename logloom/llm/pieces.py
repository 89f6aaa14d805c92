"""Encode the pieces that a pattern splits text into, equal ones but once."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import regex

# Fixed value: how byte-level tokenizers split text.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
MARK, LETTER, NUMBER, WHITE = range(4)
SLICE = 1 << 20  # characters of a text that are split at once
_CUT = regex.compile(r"(?<=\S) (?=\S)")


def slices(text: str) -> Iterator[str]:
    """The text in parts that no piece crosses: a single space between visible characters begins one."""
    start = 0
    while len(text) - start > SLICE and (found := _CUT.search(text, start + SLICE)):
        yield text[start : found.start()]
        start = found.start()
    yield text[start:]


class PieceCache:
    """The ids of texts as bytes. ``encode_pieces`` gives those of pieces that are not remembered.

    A piece is forgotten when ``limit`` other new ones have come since it was asked for; at most
    twice ``limit``, and those of one call, are remembered, in some 200 bytes each.
    """

    def __init__(self, pattern, encode_pieces: Callable[[list[str]], Iterable[bytes]], limit: int):
        self.find = pattern.findall
        self.encode_pieces = encode_pieces
        self.limit = limit
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def texts(self, texts: list[str]) -> list[bytes]:
        found = [[self.find(part) for part in slices(text)] for text in texts]
        ids = self._known(set().union(*(pieces for parts in found for pieces in parts)))
        return [b"".join([b"".join(map(ids, pieces)) for pieces in parts]) for parts in found]

    def _known(self, wanted: set[str]) -> Callable[[str], bytes]:
        """How to look up all of ``wanted``, until the next call."""
        if len(self.new) > self.limit:
            self.old, self.new = self.new, {}
        new, old = self.new, self.old
        wanted = wanted.difference(new)
        again = {piece: old[piece] for piece in wanted if piece in old}
        new.update(again)
        unknown = list(wanted.difference(again))
        new.update(zip(unknown, self.encode_pieces(unknown), strict=True))
        return new.__getitem__


@cache
def kinds_of_characters() -> np.ndarray:
    """Whether each code point is a letter, a number, white space or another mark."""
    kinds = np.full(0x110000, MARK, np.uint8)
    text = "".join(map(chr, [*range(0xD800), *[0] * 0x800, *range(0xE000, 0x110000)]))
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (WHITE, r"\s+")):
        for found in regex.finditer(pattern, text):
            kinds[found.start() : found.end()] = kind
    return kinds


def piece_starts(codes: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Whether a match of ``PATTERN`` starts at each code point; ``begins`` says where texts do, one place longer."""
    kinds = kinds_of_characters()[codes]
    white, first = kinds == WHITE, begins[:-1]
    visible_next = np.append(~white[1:], False) & ~begins[1:]
    before = np.append(np.uint8(WHITE), kinds[:-1])
    space_before = np.append(False, codes[:-1] == 32)
    # The last white space before something visible stands apart, or together with that if it is a space.
    starts = first | np.where(white, (before != WHITE) | visible_next, (before != kinds) & ~space_before)
    quotes = np.flatnonzero(starts & (codes == 39))
    if len(quotes):
        ends = np.append(begins, [True, True])
        after = np.append(codes, [0, 0, 0]).astype(np.uint32)
        one, two = after[quotes + 1], after[quotes + 2]
        inside = ~ends[quotes + 1]
        short = inside & np.isin(one, [ord(c) for c in "stmd"])
        long = inside & ~ends[quotes + 2] & np.isin(one << 8 | two, [ord(a) << 8 | ord(b) for a, b in ("re", "ve", "ll")]) & (two < 256)
        ended = np.append(starts, [True, True, True])
        ended[quotes[short | long] + 1] = False
        ended[quotes[short] + 2] = True
        ended[quotes[long] + 3] = True
        starts = ended[: len(codes)]
    return starts


class ColumnPieces:
    """As ``PieceCache`` for ``PATTERN``, with all texts of a call split and looked up as columns."""

    def __init__(self, encode_pieces: Callable[[list[str]], Iterable[bytes]], limit: int):
        self.encode_pieces = encode_pieces
        self.limit = limit
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def texts(self, texts: list[str]) -> list[bytes]:
        if all(len(text) <= SLICE for text in texts):
            return self._together(texts)
        return [b"".join(self._together([part])[0] for part in slices(text)) for text in texts]

    def _together(self, texts: list[str]) -> list[bytes]:
        joined = "".join(texts)
        if not joined:
            return [b""] * len(texts)
        codes, data = np.frombuffer(joined.encode("utf-32-le"), "<u4"), joined.encode()
        ends = np.cumsum([0, *map(len, texts)])
        begins = np.zeros(len(codes) + 1, bool)
        begins[ends] = True
        starts = np.append(np.flatnonzero(piece_starts(codes, begins)), len(codes))
        if len(data) == len(codes):
            offsets = starts
        else:
            offsets = np.append(np.flatnonzero((np.frombuffer(data, np.uint8) & 0xC0) != 0x80), len(data))[starts]
        buffers = pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data)
        pieces = pa.LargeStringArray.from_buffers(len(starts) - 1, *buffers).dictionary_encode()
        known = self._known(pieces.dictionary.to_numpy(zero_copy_only=False).tolist())
        _, offsets, ids = pa.array(known, pa.large_binary()).take(pieces.indices).buffers()
        at = np.frombuffer(offsets, np.int64)[np.searchsorted(starts, ends)].tolist()
        ids = memoryview(ids)
        return [bytes(ids[start:end]) for start, end in zip(at, at[1:])]

    def _known(self, wanted: list[str]) -> list[bytes]:
        if len(self.new) > self.limit:
            self.old, self.new = self.new, {}
        found = list(map(self.new.get, wanted))
        missing = [n for n, ids in enumerate(found) if ids is None]
        for n in missing:
            found[n] = self.old.get(wanted[n])
        unknown = [n for n in missing if found[n] is None]
        for n, ids in zip(unknown, self.encode_pieces([wanted[n] for n in unknown]), strict=True):
            found[n] = ids
        self.new.update((wanted[n], found[n]) for n in missing)
        return found
