"""Operator 11: phrase collocation mining by multikey three-way quicksort of suffix pointers.

Texts are lower-cased (A-Z), split at punctuation into pieces and those at blanks into words. A suffix is
what follows a place up to the end of its piece, ``max_words`` words at most. Each task puts equal
suffixes of its texts together and sends them to buckets by language and their two leading words, so that all
suffixes that begin with the same two words meet. A bucket is then sorted: a multikey three-way quicksort of
pointers to its suffixes, which partitions all open segments of a depth at once and goes one word
deeper in the equal part. The size of an equal part is the count of its phrase, and a part of fewer than
``min_count`` suffixes is abandoned with all that it might hold.

Pairs of two very frequent words would fill a bucket by themselves: their suffixes go to buckets by three
leading words, and the pair's own count goes as one suffix of each task to the bucket of the pair. A
bucket larger than ``BLOCK`` is sorted in blocks without abandoning anything; counts of equal phrases are added
up at the end in either case, so counts are exact whatever the spread.

A candidate is a phrase of 2 to ``max_words`` words that occurs ``min_count`` times (a). Its score is the least
over all cuts of ``scale * a * a / (l * r)``, rounded down, with the counts l and r of the two parts. Candidates
inside a longer one that has at least ``held_percent`` of their count are dropped. Arithmetic is that of
whole numbers without bound. Each language's ``top`` phrases are returned, ties by count, then by bytes.

A null text has no words, a null language is ``und``. Rows count as often as they occur; doc_id is not read,
so null or repeated ones do no harm. Texts count whole, however long; extra columns are not read; an empty
table gives no rows.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F

from logloom.llm.common import give_back, small, stored

UNKNOWN = "und"
END = 0  # the word id behind the last word of a piece
BREAK = b"\xff"  # no byte of UTF-8; stands between pieces
AT_ONCE = 1 << 19  # words whose suffixes are put together at once
SLICE = 1 << 22  # bytes of a text that are split at once
COUNTED = 1 << 18  # distinct words that a task counts before it hands them on
HELD = 1 << 24  # bytes of text that wait in a task
BUCKET = 400_000  # word occurrences that a bucket is meant for
BLOCK = 4_000_000  # suffixes that are sorted at once at most
HOT_LEAST, HOT_SHARE = 20_000, 50_000  # a word is very frequent above the least, and a share of all words
BROADCAST_ROWS = 300_000
HEATS = 16  # parts of a language that are ranked by themselves first
# The characters that end a piece.
PIECE_ENDS = b".,;:!?\x0a\x0b\x0c\x0d"
_TABLE = bytes(0xFF if c in PIECE_ENDS else c + 32 if 65 <= c <= 90 else c for c in range(256))
_CUT = re.compile(rb"[\x20\x09-\x0D.,;:!?]")
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class Options:
    max_words: int = 3
    min_count: int = 10
    held_percent: int = 50
    scale: int = 1_000_000
    top: int = 2000


def words(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text in order, BREAK between pieces, in lists of bounded size."""
    start = 0
    while start < len(text):
        found = _CUT.search(text, start + SLICE) if len(text) - start > SLICE else None
        end = found.end() if found else len(text)
        yield text[start:end].translate(_TABLE).replace(BREAK, b" \xff ").split()
        start = end


def by_language(batch: pa.RecordBatch) -> Iterator[tuple[str, bytes]]:
    langs, texts = batch.column("lang").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist()
    return ((UNKNOWN if lang is None else lang, text) for lang, text in zip(langs, texts) if text)


def word_counts(docs: DataFrame) -> DataFrame:
    """lang, word and f, the occurrences of every word."""

    def rows(found: Counter) -> pa.RecordBatch:
        keys, counts = list(found), list(found.values())
        langs = pa.array([lang for lang, _ in keys], pa.string())
        return pa.RecordBatch.from_arrays([langs, pa.array([w for _, w in keys], pa.binary()), pa.array(counts, pa.int64())], ["lang", "word", "f"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Counter] = {}

        def flushed() -> Iterator[pa.RecordBatch]:
            for lang, counter in held.items():
                counter.pop(BREAK, None)
                yield rows({(lang, w): n for w, n in counter.items()})
            held.clear()

        for batch in batches:
            for lang, text in by_language(batch):
                counter = held.setdefault(lang, Counter())
                for found in words(text):
                    counter.update(found)
            if sum(map(len, held.values())) > COUNTED:
                yield from flushed()
        yield from flushed()

    counted = docs.select("lang", "text").mapInArrow(run, "lang string, word binary, f long")
    return counted.groupBy("lang", "word").agg(F.sum("f").alias("f"))


def _mixed(values: np.ndarray) -> np.ndarray:
    values = (values ^ (values >> np.uint64(29))) * _MULTIPLIER
    return values ^ (values >> np.uint64(32))


def _distinct(ids: np.ndarray, count: int, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct suffixes (rows of ``depth`` ids) that begin at the first ``count`` words, with their counts."""
    columns = [ids[:count]]
    for n in range(1, depth):
        columns.append(np.where(columns[-1] == END, END, ids[n : n + count]))
    size = int(ids.max(initial=0)) + 1
    key = columns[0]
    for column in columns[1:]:
        if int(key.max(initial=0)) >= (1 << 62) // size:
            key = np.unique(key, return_inverse=True)[1]
        key = key * size + column
    _, first, counts = np.unique(key[columns[0] != END], return_index=True, return_counts=True)
    at = np.flatnonzero(columns[0] != END)[first]
    return np.stack([c[at] for c in columns], 1), counts


class Suffixes:
    """Puts the suffixes of one language together and packs them into rows by bucket."""

    def __init__(self, lang: str, hot: frozenset[bytes], buckets: int, depth: int):
        self.lang, self.hot, self.buckets, self.depth = lang, hot, buckets, depth
        self.seed = np.uint64(xxhash.xxh3_64_intdigest(lang.encode()))
        self.held: list[bytes] = []

    def add(self, found: list[bytes]) -> Iterator[tuple]:
        self.held += found
        while len(self.held) >= AT_ONCE + self.depth:
            yield from self._packed(self.held[: AT_ONCE + self.depth - 1], AT_ONCE)
            self.held = self.held[AT_ONCE:]

    def end(self) -> Iterator[tuple]:
        if self.held:
            yield from self._packed(self.held, len(self.held))
            self.held = []

    def _packed(self, found: list[bytes], count: int) -> Iterator[tuple]:
        """(bucket, lang, salted, words, suffixes) of the suffixes that begin at the first ``count`` words."""
        known = {BREAK: END}
        for word in found:
            known.setdefault(word, len(known))
        names = list(known)
        ids = np.fromiter(map(known.__getitem__, found), np.int64, len(found))
        suffixes, counts = _distinct(np.concatenate([ids, np.zeros(self.depth, np.int64)]), count, self.depth)
        if not len(suffixes):
            return
        hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, names), np.uint64, len(names))
        is_hot = np.fromiter((n in self.hot for n in names), bool, len(names))
        pair = _mixed(_mixed(hashes[suffixes[:, 0]] + self.seed) + hashes[suffixes[:, 1]])
        salted = is_hot[suffixes[:, 0]] & is_hot[suffixes[:, 1]] & (self.depth > 2)
        route = pair.copy()
        if salted.any():
            route[salted] = _mixed(route[salted] + hashes[suffixes[salted, 2]])
            # The pair's own count, as one suffix without more words.
            keys, at, inverse = np.unique(pair[salted], return_index=True, return_inverse=True)
            own = suffixes[salted][at].copy()
            own[:, 2:] = END
            totals = np.bincount(inverse, counts[salted]).astype(np.int64)
            suffixes, counts = np.concatenate([suffixes, own]), np.concatenate([counts, totals])
            route, salted = np.concatenate([route, keys]), np.concatenate([salted, np.zeros(len(own), bool)])
        bucket = (route % np.uint64(self.buckets)).astype(np.int64) * 2 + salted
        order = np.argsort(bucket, kind="stable")
        bucket, suffixes, counts = bucket[order], suffixes[order], counts[order]
        bounds = np.flatnonzero(np.diff(bucket, prepend=-1, append=-1))
        for low, high in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            yield self._row(int(bucket[low]), names, suffixes[low:high], counts[low:high])

    def _row(self, bucket: int, names: list[bytes], suffixes: np.ndarray, counts: np.ndarray) -> tuple:
        used, own = np.unique(np.concatenate([[END], suffixes.ravel()]), return_inverse=True)
        table = np.column_stack([own[1:].reshape(suffixes.shape), counts])
        kind = "<u2" if max(len(used), int(counts.max())) < 1 << 16 else "<u8"
        return bucket, self.lang, b" ".join(map(names.__getitem__, used[1:].tolist())), kind, table.astype(kind).tobytes()


_ROUTED = "bucket long, lang string, words binary, kind string, suffixes binary"
_ROUTED_KINDS = pa.schema([("bucket", pa.int64()), ("lang", pa.string()), ("words", pa.binary()), ("kind", pa.string()), ("suffixes", pa.binary())])


def _batches(rows: Iterator[tuple], kinds: pa.Schema, at_once: int = 2000) -> Iterator[pa.RecordBatch]:
    held = []
    for row in rows:
        held.append(row)
        if len(held) == at_once:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), kinds)], schema=kinds)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), kinds)], schema=kinds)


def routed(docs: DataFrame, hot: dict[str, frozenset[bytes]], buckets: int, options: Options) -> DataFrame:
    """The suffixes of all texts, put together by task, in rows for the buckets."""
    depth = options.max_words

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        open_: dict[str, Suffixes] = {}
        waiting = 0
        for batch in batches:
            for lang, text in by_language(batch):
                own = open_.get(lang)
                if own is None:
                    own = open_[lang] = Suffixes(lang, hot.get(lang, frozenset()), buckets, depth)
                for found in words(text):
                    yield from own.add(found)
                yield from own.add([BREAK])
                waiting += len(text)
            if waiting > HELD and len(open_) > 8:  # many languages: let go of what waits
                for own in open_.values():
                    yield from own.end()
                open_, waiting = {}, 0
        for own in open_.values():
            yield from own.end()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _batches(packed(batches), _ROUTED_KINDS)
        give_back()

    return docs.select("lang", "text").mapInArrow(run, _ROUTED)


def equal_parts(keys: np.ndarray, counts: np.ndarray, least: int, seed: int = 0) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Phrases of the suffixes ``keys`` (rows of word ids) and their counts, ``least`` or more.

    Yields (words, pointers, counts) with a pointer to one suffix that begins with each phrase. A
    multikey three-way quicksort of pointers: each open segment is split by a pivot at its depth into less,
    equal and greater, all segments in one pass; equal parts go one word deeper, small ones are given up.
    """
    depth = keys.shape[1]
    columns = np.ascontiguousarray(keys.T)
    pointers = np.arange(len(keys))
    starts, at = np.zeros(1, np.int64), np.zeros(1, np.int64)  # of the open segments: begin, depth
    rng = np.random.default_rng(seed)
    while len(pointers):
        lengths = np.diff(starts, append=len(pointers))
        segment = np.repeat(np.arange(len(starts)), lengths)
        level = at[segment]
        key = columns[level, pointers]
        pivot = key[starts + (rng.random(len(starts)) * lengths).astype(np.int64)]
        side = (key >= pivot[segment]).astype(np.int64) + (key > pivot[segment])  # less, equal, greater
        part = segment * 3 + side
        sizes = np.bincount(part, counts[pointers], 3 * len(starts)).astype(np.int64)
        kept = sizes >= least
        middle = np.arange(1, 3 * len(starts), 3)  # the equal parts
        found = kept[middle] & (pivot != END)
        depths = np.repeat(at, 3)
        depths[middle] += 1
        some = np.zeros(3 * len(starts), np.int64)
        some[part] = pointers
        for words_ in np.unique(at[found]):
            own = middle[found & (at == words_)]
            yield int(words_) + 1, some[own], sizes[own]
        kept[middle] &= (pivot != END) & (at + 1 < depth)
        alive = kept[part]
        pointers, part = pointers[alive], part[alive]
        order = np.argsort(part, kind="stable")
        pointers, part = pointers[order], part[order]
        starts = np.flatnonzero(np.diff(part, prepend=-1))
        at = depths[part[starts]]


class Bucket:
    """Suffixes of one bucket and language as rows of ids, taken from packed rows."""

    def __init__(self, depth: int):
        self.depth = depth
        self.known: dict[bytes, int] = {}
        self.tables: list[np.ndarray] = []
        self.size = 0

    def add(self, words_: bytes, kind: str, suffixes: bytes) -> None:
        table = np.frombuffer(suffixes, kind).reshape(-1, self.depth + 1).astype(np.int64)
        own = words_.split(b" ") if words_ else []
        known = self.known
        ids = np.fromiter((known.setdefault(w, len(known) + 1) for w in own), np.int64, len(own))
        table[:, :-1] = np.concatenate([[END], ids])[table[:, :-1]]
        self.tables.append(table)
        self.size += len(table)

    def phrases(self, least: int) -> Iterator[tuple[int, bytes, int]]:
        """(words, phrase, count) of two words or more."""
        if not self.tables:
            return
        table = np.concatenate(self.tables)
        names = [b"", *self.known]
        keys, counts = table[:, :-1], table[:, -1]
        for n, pointers, sizes in equal_parts(keys, counts, least):
            if n > 1:
                for row, size in zip(keys[pointers, :n].tolist(), sizes.tolist()):
                    yield n, b" ".join(map(names.__getitem__, row)), size


_PHRASES = "lang string, words int, phrase binary, a long"
_PHRASES_KINDS = pa.schema([("lang", pa.string()), ("words", pa.int32()), ("phrase", pa.binary()), ("a", pa.int64())])


def counted(rows: DataFrame, options: Options) -> DataFrame:
    """lang, words, phrase and a of every phrase of two words or more that occurs often enough."""
    depth = options.max_words

    def phrases(bucket: Bucket, key: tuple[int, str], least: int) -> Iterator[tuple]:
        salted = key[0] % 2  # of two leading words their own buckets know the count
        for n, phrase, size in bucket.phrases(least):
            if not salted or n > 2:
                yield key[1], n, phrase, size

    def sorted_(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        key, bucket, least = None, Bucket(depth), options.min_count
        for batch in batches:
            for bucket_id, lang, *packed in zip(*(batch.column(c).to_pylist() for c in batch.schema.names)):
                if (bucket_id, lang) != key:
                    if key is not None:
                        yield from phrases(bucket, key, least)
                    key, bucket, least = (bucket_id, lang), Bucket(depth), options.min_count
                bucket.add(*packed)
                if bucket.size > BLOCK:
                    least = 1  # more of this bucket may come, so nothing is too rare yet
                    yield from phrases(bucket, key, least)
                    bucket = Bucket(depth)
        if key is not None:
            yield from phrases(bucket, key, least)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _batches(sorted_(batches), _PHRASES_KINDS, 20_000)
        give_back()

    met = rows.repartition("bucket").sortWithinPartitions("bucket", "lang")
    found = met.mapInArrow(run, _PHRASES).groupBy("lang", "words", "phrase").agg(F.sum("a").alias("a"))
    return found.where(F.col("a") >= options.min_count)


def _sized(frame: DataFrame) -> DataFrame:
    return F.broadcast(frame) if small(frame, BROADCAST_ROWS) else frame


def parts(phrase: bytes) -> list[tuple[int, bytes, bytes]]:
    """(k, first k words, the rest) for every cut."""
    found = phrase.split(b" ")
    return [(k, b" ".join(found[:k]), b" ".join(found[k:])) for k in range(1, len(found))]


def inner(phrase: bytes) -> list[bytes]:
    """Phrases of two words or more that lie in a phrase, without itself."""
    found = phrase.split(b" ")
    return list({b" ".join(found[a:b]) for a in range(len(found)) for b in range(a + 2, len(found) + 1) if b - a < len(found)})


def _mapped(frame: DataFrame, schema: str, kinds: pa.Schema, rows: Callable[[dict], Iterator[tuple]]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from _batches((out for row in batch.to_pylist() for out in rows(row)), kinds, 20_000)

    return frame.mapInArrow(run, schema)


def scored(candidates: DataFrame, singles: DataFrame, options: Options) -> DataFrame:
    """Candidates with l, r and score of their lowest cut."""
    kinds = pa.schema([("lang", pa.string()), ("phrase", pa.binary()), ("a", pa.int64()), ("k", pa.int32()), ("left", pa.bool_()), ("part", pa.binary())])

    def sides(row: dict) -> Iterator[tuple]:
        for k, left, right in parts(row["phrase"]):
            yield row["lang"], row["phrase"], row["a"], k, True, left
            yield row["lang"], row["phrase"], row["a"], k, False, right

    asked = _mapped(candidates.select("lang", "phrase", "a"), "lang string, phrase binary, a long, k int, left boolean, part binary", kinds, sides)
    known = singles.select("lang", F.col("word").alias("part"), "f").union(candidates.select("lang", "phrase", "a"))
    counts = F.sort_array(F.collect_list(F.struct("k", "left", "f"))).alias("counts")
    cuts = asked.join(_sized(known), ["lang", "part"]).groupBy("lang", "phrase", "a").agg(counts)

    def lowest(row: dict) -> Iterator[tuple]:
        a, sizes = row["a"], [c["f"] for c in row["counts"]]  # by cut; the right part's before the left one's
        found = [(options.scale * a * a // (right * left), n, left, right) for n, (right, left) in enumerate(zip(sizes[::2], sizes[1::2]))]
        score, _, left, right = min(found)
        yield row["lang"], row["phrase"], a, left, right, score

    kinds_out = pa.schema([("lang", pa.string()), ("phrase", pa.binary()), ("a", pa.int64()), ("l", pa.int64()), ("r", pa.int64()), ("score", pa.int64())])
    return _mapped(cuts, "lang string, phrase binary, a long, l long, r long, score long", kinds_out, lowest)


def _best(rows: DataFrame, top: int, *groups: Column | str) -> DataFrame:
    order = Window.partitionBy(*groups).orderBy(F.col("score").desc(), F.col("a").desc(), F.col("phrase"))
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def collocations(docs: DataFrame, options: Options = Options()) -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score of each language's best phrases in ``docs`` (text, lang)."""
    docs = docs.select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    counts = stored(word_counts(docs), "word-counts")
    totals = stored(counts.groupBy("lang").agg(F.sum("f").alias("n")), "word-totals")
    total = totals.agg(F.coalesce(F.sum("n"), F.lit(0))).head()[0]
    buckets = max(1, -(-total // BUCKET))
    least = max(HOT_LEAST, total // HOT_SHARE)
    hot: dict[str, set[bytes]] = {}
    for row in counts.where(F.col("f") >= least).select("lang", "word").collect():  # at most HOT_SHARE of them
        hot.setdefault(row["lang"], set()).add(bytes(row["word"]))
    suffixes = routed(docs, {lang: frozenset(found) for lang, found in hot.items()}, buckets, options)
    candidates = stored(counted(suffixes, options), "candidates")
    kinds = pa.schema([("lang", pa.string()), ("phrase", pa.binary()), ("held", pa.int64())])
    longer = candidates.where("words > 2").select("lang", "phrase", "a")
    covers = _mapped(longer, "lang string, phrase binary, held long", kinds, lambda row: ((row["lang"], p, row["a"]) for p in inner(row["phrase"])))
    covered = covers.groupBy("lang", "phrase").agg(F.max("held").alias("held"))
    singles = counts.where(F.col("f") >= options.min_count)
    held = F.coalesce(100 * F.col("held") >= options.held_percent * F.col("a"), F.lit(False))
    left = stored(scored(candidates, singles, options), "scored").join(_sized(stored(covered, "covered")), ["lang", "phrase"], "left").where(~held)
    ranked = _best(left, options.top, "lang", F.pmod(F.xxhash64("phrase"), F.lit(HEATS)))  # few of each heat meet again
    ranked = _best(ranked, options.top, "lang")
    return ranked.join(F.broadcast(totals) if small(totals, BROADCAST_ROWS) else totals, "lang").select(
        "lang", F.col("rank").cast("long").alias("rank"), F.col("phrase").cast("string").alias("phrase"), "a", "l", "r", "n", "score"
    )
