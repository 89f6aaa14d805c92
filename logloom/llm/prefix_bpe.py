"""Operator 7: byte-level BPE by dynamic programming over prefixes.

For every prefix of a piece exactly one token can come last in the encoding of that prefix: the one that
ends there and may follow the last token of the prefix before it. ``Prefixes`` keeps that token for each
prefix, so appending bytes extends the table and leaves the rest alone, an edit recomputes it from the
edit on until it meets the old table again, and the encoding of any prefix is a walk back from its end.

Whether token b may follow token a depends on the two alone. Merges run in the order of their ranks, so
a part on the right edge of a lives from its own rank to the rank of the part that swallows it, and the
same holds on the left edge of b. The pair is kept apart iff no two such parts that live at the same
time would be merged before either is swallowed.

As in the library, a piece that is itself a token is that token. Decoding joins the tokens' bytes.
``encode_documents`` takes a null text as empty; an empty text has no ids. Texts of any length are
encoded whole. Rows and other columns pass through unchanged in number; an empty table stays empty.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from logloom.llm.common import give_back, worker_state
from logloom.llm.files import opened
from logloom.llm.pieces import PieceCache
from logloom.llm.token_files import groups

NEVER = 1 << 40  # a rank beyond all
PAIRS_REMEMBERED = 250_000
REMEMBERED = 200_000  # pieces of text
CHARS_AT_ONCE = 1 << 19  # of texts that are split together; each of their pieces is an object


def load_ranks(path: str) -> dict[bytes, int]:
    with opened(path) as file:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file.read().splitlines())}


def merged(piece: bytes, ranks: dict[bytes, int], below: int = NEVER) -> list[bytes]:
    """Plain byte-pair merging: the lowest rank first, the leftmost of equals. For short pieces."""
    found = [piece[n : n + 1] for n in range(len(piece))]
    while len(found) > 1:
        rank, n = min((ranks.get(found[n] + found[n + 1], NEVER), n) for n in range(len(found) - 1))
        if rank >= below:
            break
        found[n : n + 2] = [found[n] + found[n + 1]]
    return found


class Vocabulary:
    """The tokens of a rank table, and which of them may stand side by side."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = {rank: token for token, rank in ranks.items()}
        self.longest = max(map(len, ranks))
        self.halves: dict[bytes, tuple[bytes, bytes] | None] = {}
        self.edges: dict[tuple[bytes, bool], list[tuple[bytes, int, int]]] = {}
        self.pairs: dict[int, bool] = {}
        self.size = max(ranks.values()) + 1
        self.made = {token: rank for token, rank in ranks.items() if len(token) == 1 or self.half(token)}
        # What a token may begin with; -1 for what is not one itself.
        self.begun = {token[:n]: -1 for token in self.made for n in range(1, len(token))} | self.made

    def half(self, token: bytes) -> tuple[bytes, bytes] | None:
        """The two tokens whose merge makes this one; None for single bytes and what no merge makes."""
        if token not in self.halves:
            last = merged(token, self.ranks, self.ranks[token]) if len(token) > 1 else [token]
            self.halves[token] = (last[0], last[1]) if len(last) == 2 else None
        return self.halves[token]

    def edge(self, token: bytes, right: bool) -> list[tuple[bytes, int, int]]:
        """Parts that stand at one edge while the token is built: part, rank, rank that swallows it."""
        if (token, right) not in self.edges:
            found, part, end = [], token, NEVER
            while True:
                half = self.half(part)
                rank = self.ranks[part] if half else -1  # single bytes are there from the start
                found.append((part, rank, end))
                if half is None:
                    break
                part, end = half[right], rank
            self.edges[token, right] = found
        return self.edges[token, right]

    def may_follow(self, first: bytes, second: bytes) -> bool:
        """Whether both tokens stay as they are side by side."""
        key = self.ranks[first] * self.size + self.ranks[second]
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) > PAIRS_REMEMBERED:
                self.pairs.clear()
            known = self.pairs[key] = self._apart(first, second)
        return known

    def _apart(self, first: bytes, second: bytes) -> bool:
        ranks = self.ranks
        for left, left_rank, left_end in self.edge(first, True):
            for right, right_rank, right_end in self.edge(second, False):
                if left_rank >= right_end or right_rank >= left_end:
                    continue  # never there together
                rank = ranks.get(left + right)
                # Of equal ranks the leftmost merge comes first: within the first token, then across.
                if rank is not None and rank < left_end and rank <= right_end:
                    return False
        return True

class Prefixes:
    """One piece of text with the last token of each of its prefixes."""

    def __init__(self, vocabulary: Vocabulary, piece: bytes = b""):
        self.vocabulary = vocabulary
        self.piece = bytearray()
        self.last: list[bytes] = [b""]
        self.append(piece)

    def append(self, more: bytes) -> None:
        self.piece += more
        for end in range(len(self.last), len(self.piece) + 1):
            self.last.append(self._last(end))

    def _last(self, end: int) -> bytes:
        """The token at ``end`` that may follow the last one of the prefix before it."""
        vocabulary, piece, last = self.vocabulary, self.piece, self.last
        made, may_follow = vocabulary.made, vocabulary.may_follow
        for start in range(max(0, end - vocabulary.longest), end):
            token = bytes(piece[start:end])
            if token in made and (start == 0 or may_follow(last[start], token)):
                return token
        raise ValueError(f"no token ends at byte {end}")

    def replace(self, start: int, end: int, new: bytes) -> int:
        """Put ``new`` in place of bytes start to end. Returns how many prefixes were computed anew."""
        tail, old = bytes(self.piece[end:]), self.last[end + 1 :]
        del self.piece[start:], self.last[start + 1 :]
        self.append(new)
        count, same, keep = len(new), 0, self.vocabulary.longest
        for n in range(len(tail)):
            if same >= keep:  # so many in a row decide all that follow, which the old table holds
                self.piece += tail[n:]
                self.last += old[n:]
                return count
            self.append(tail[n : n + 1])
            count += 1
            same = same + 1 if self.last[-1] == old[n] else 0
        return count

    def tokens(self, end: int | None = None) -> list[bytes]:
        """The encoding of the first ``end`` bytes."""
        end, found = len(self.piece) if end is None else end, []
        while end:
            found.append(self.last[end])
            end -= len(found[-1])
        return found[::-1]


def encode_piece(vocabulary: Vocabulary, piece: bytes) -> list[int]:
    """Ids of one piece: the table of last tokens filled forwards, read backwards."""
    ranks = vocabulary.ranks
    whole = ranks.get(piece)
    if whole is not None:
        return [whole]
    size, begun, pairs, tokens = len(piece), vocabulary.begun.get, vocabulary.pairs.get, vocabulary.bytes_of
    last = [-1] * (size + 1)
    for end in range(1, size + 1):
        rank = begun(piece[:end])
        if rank is None:
            break
        last[end] = rank
    for start in range(1, size):
        before = last[start]
        base = before * vocabulary.size
        for end in range(start + 1, size + 1):
            if last[end] < 0:
                rank = begun(piece[start:end])
                if rank is None:  # no token goes on like this
                    break
                if rank >= 0:
                    known = pairs(base + rank)
                    if vocabulary.may_follow(tokens[before], tokens[rank]) if known is None else known:
                        last[end] = rank
    found, end = [], size
    while end:
        found.append(last[end])
        end -= len(tokens[last[end]])
    return found[::-1]


class Codec:
    """Texts to ids and back, each match of the pattern by itself."""

    def __init__(self, path: str, pattern: str):
        self.vocabulary = Vocabulary(load_ranks(path))
        self.cache = PieceCache(regex.compile(pattern), self._pieces, REMEMBERED)
        self.token_bytes = [self.vocabulary.bytes_of.get(n, b"") for n in range(max(self.vocabulary.bytes_of) + 1)]

    def _pieces(self, found: list[str]) -> Iterator[bytes]:
        for piece in found:
            ids = encode_piece(self.vocabulary, piece.encode())
            yield struct.pack(f"<{len(ids)}I", *ids)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        return self.cache.texts(texts)

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.token_bytes.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def codec(path: str, pattern: str) -> Codec:
    return worker_state(("prefix-bpe", path, pattern), lambda: Codec(path, pattern))


def encode_documents(docs: DataFrame, path: str, pattern: str, digests: bool = False) -> DataFrame:
    """doc_id, n_tokens and ids (binary, unsigned 32 bits each); or digests of ids and decoded bytes."""
    outputs = "ids_sha256 string, decoded_sha256 string" if digests else "ids binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for batch in batches:
            doc_ids, at = batch.column("doc_id"), 0
            for texts in groups([t or "" for t in batch.column("text").to_pylist()], CHARS_AT_ONCE):
                ids = own.encode(texts)
                columns = {"doc_id": doc_ids.slice(at, len(ids)), "n_tokens": pa.array([len(x) // 4 for x in ids], pa.int64())}
                if digests:
                    columns["ids_sha256"] = pa.array([hashlib.sha256(x).hexdigest() for x in ids])
                    columns["decoded_sha256"] = pa.array([hashlib.sha256(own.decode(x)).hexdigest() for x in ids])
                else:
                    columns["ids"] = pa.array(ids, pa.binary())
                at += len(ids)
                yield pa.RecordBatch.from_pydict(columns)
        give_back()

    rows = docs.select(F.col("doc_id").cast("long"), "text")
    return rows.mapInArrow(run, f"doc_id long, n_tokens long, {outputs}")
