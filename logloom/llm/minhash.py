"""Operator 8: near-duplicates by bottom-k sketches from one hash function.

A document's set holds the 64-bit hashes of its distinct word shingles, and its sketch the K smallest of
them. Documents with equal sets are one class from the start; everything below is about classes.

Candidates come from inverted lists of retained values. Two classes with a Jaccard similarity of at
least ``percent`` share ``needed`` retained values or more: exactly so where the sets are no larger than
their sketches, else but for a chance of at most ``LOSS`` by the exact binomial tail (hash values drawn without
replacement spread less than that). So in any common order of the values, each of them has a shared value among its first ``retained - needed + 1``. The order is by
length of the value's list, shortest first, so lists of frequent values are hardly used; values that no
other class retains stand first and make no list.

A list of up to ``SMALL_LIST`` members compares all its pairs. A longer one, such as a large group of
near copies makes, compares its members with a pivot first. What that leaves unconnected is compared in
blocks: each task holds the sets of two blocks of the pivot's members and returns the links that connect
them, never all pairs. Jaccard distance is a metric, so classes beyond twice the limit from the pivot need
no comparison with its links. No list is cut.

The estimate from the union's sketch drops pairs that share fewer values than that, so the same chance covers both
steps: of a thousand million pairs at the limit one may go unseen, and fewer above it. The others are confirmed on
their full sets. Components come from confirmed links.

``Options(native=True)`` does the same with DataFrame functions alone: other 64-bit hashes, and two blocks meet in a join
that gives no pair but links.

Without words (or text) a document is linked with nothing. Fewer words than a shingle are one shingle.
Null ids: such rows join the component of equal or similar rows, and stay if it has no id at all.
Repeated rows share their component. Whole texts count; extra columns do no harm; an empty table gives
no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce
from math import ceil, comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from logloom.functions.json_text import bind
from logloom.llm.common import dropped, gathered, give_back, packed, small, stored, unpacked, worker_state
from logloom.llm.components import components

K = 64
LOSS = 1e-9
SMALL_LIST = 24
BLOCK_MEMBERS = 400  # classes and shingles of one of the two blocks that meet in a task, on average
BLOCK_SHINGLES = 400_000
NEAR, UNSURE, FAR = 1, 2, 4  # how a class stands to its pivot: linked, perhaps near a link, or neither
BROADCAST_ROWS = 300_000
PAIRS_AT_ONCE = 1_000_000  # pairs whose sketches, and shingles of pairs whose sets, are moved at once; more where the table has more
SHINGLES_AT_ONCE = 4_000_000
WORDS_KEPT = 100_000  # words whose hashes a worker remembers
SPACES = " \t\n\v\f\r"
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class Options:
    shingle_words: int = 5
    percent: int = 80
    k: int = K
    native: bool = False  # DataFrame functions only

    def least_shared(self, percent: float) -> int:
        """Pairs of ``percent`` share fewer of their union's ``k`` smallest values with a chance of at most ``LOSS``."""
        share, below = percent / 100, 0.0
        for shared in range(self.k):
            below += comb(self.k, shared) * share**shared * (1 - share) ** (self.k - shared)
            if below > LOSS:
                return shared
        return self.k

    @property
    def most_needed(self) -> int:
        """Shared retained values that a similar pair of large sets has."""
        return max(1, self.least_shared(self.percent))

    def likely(self, percent: float) -> float:
        """An estimate below which a pair's similarity is below ``percent``."""
        return self.least_shared(percent) / self.k


def _mixed(values: np.ndarray) -> np.ndarray:
    values = values * _MULTIPLIER
    values ^= values >> np.uint64(32)
    values *= np.uint64(0xD6E8FEB86659FD93)
    return values ^ (values >> np.uint64(29))


def shingle_set(text: str | None, size: int) -> np.ndarray:
    """The sorted hashes of the text's distinct shingles."""
    words = (text or "").encode().translate(_LOWER).split()
    if not words:
        return np.zeros(0, np.int64)
    known = worker_state("word-hashes", dict)
    if len(known) > WORDS_KEPT:
        known.clear()
    for word in set(words).difference(known):
        known[word] = xxhash.xxh3_64_intdigest(word)
    hashes = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    width = min(size, len(words))
    found = np.full(len(words) - width + 1, width, np.uint64)
    for n in range(width):
        found = _mixed(found + hashes[n : len(words) - width + 1 + n])
    return np.unique(found.view(np.int64))


def set_key(found: np.ndarray) -> bytes | None:
    return hashlib.blake2b(found.tobytes(), digest_size=16).digest() if len(found) else None


def with_sets(rows: DataFrame, size: int) -> DataFrame:
    """``rows`` with ``members``, the sorted hashes of the distinct shingles of ``text``, by DataFrame functions."""
    text = F.coalesce("text", F.lit(""))
    upper, lower = ("".join(map(chr, range(c, c + 26))) for c in (65, 97))
    only_ascii = F.octet_length(text) == F.length(text)
    plain = F.btrim(F.when(only_ascii, F.lower(text)).otherwise(F.translate(text, upper, lower)), F.lit(SPACES))
    words = F.when(plain == "", F.array().cast("array<string>")).otherwise(F.split(plain, f"[{SPACES}]+", -1))
    width = F.least(F.lit(size), F.size("_words"))
    starts = F.when(width > 0, F.sequence(F.lit(1), F.size("_words") - width + 1)).otherwise(F.array().cast("array<int>"))
    hashes = F.transform(starts, lambda at: F.xxhash64(F.slice("_words", at, width)))
    # Bound, so that no filter on them is pushed below and splits the text again for each shingle.
    return bind(bind(rows, _words=words), members=F.sort_array(F.array_distinct(hashes))).drop("_words")


def native_key(members: Column) -> Column:
    return F.when(F.size(members) > 0, F.unhex(F.md5(F.array_join(members.cast("array<string>"), ","))))


def sketches(docs: DataFrame, options: Options) -> DataFrame:
    """doc_id, text_key, n, set_key and sketch of each row of ``docs`` (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = (shingle_set(t, options.shingle_words) for t in batch.column("text").to_pylist())
            found = [(len(s), set_key(s), s[: options.k].tolist()) for s in sets]
            columns = {
                "doc_id": batch.column("doc_id"),
                "text_key": batch.column("text_key"),
                "n": pa.array([f[0] for f in found], pa.int64()),
                "set_key": pa.array([f[1] for f in found], pa.binary()),
                "sketch": pa.array([f[2] for f in found], pa.list_(pa.int64())),
            }
            yield pa.RecordBatch.from_pydict(columns)
        give_back()

    rows = docs.select(F.col("doc_id").cast("long"), F.unhex(F.md5("text")).alias("text_key"), "text")
    if options.native:
        members = F.col("members")
        columns = F.size(members).cast("long").alias("n"), native_key(members).alias("set_key"), F.slice(members, 1, options.k).alias("sketch")
        return with_sets(rows, options.shingle_words).select("doc_id", "text_key", *columns)
    return rows.mapInArrow(run, "doc_id long, text_key binary, n long, set_key binary, sketch array<long>")


def full_sets(docs: DataFrame, options: Options) -> DataFrame:
    """set_key and members of each row of ``docs`` (text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(t, options.shingle_words) for t in batch.column("text").to_pylist()]
            keys = pa.array([set_key(s) for s in sets], pa.binary())
            yield pa.RecordBatch.from_pydict({"set_key": keys, "members": pa.array(sets, pa.list_(pa.int64()))})
        give_back()

    if options.native:
        sets = with_sets(docs.select("text"), options.shingle_words)
        return bind(sets, set_key=native_key(F.col("members"))).select("set_key", "members")
    return docs.select("text").mapInArrow(run, "set_key binary, members array<long>")


def _sized(frame: DataFrame) -> DataFrame:
    return F.broadcast(frame) if small(frame, BROADCAST_ROWS) else frame


def inverted_lists(classes: DataFrame, options: Options) -> DataFrame:
    """value, node, n and members (of the list): the lists that have two classes or more."""
    retained = classes.select("node", F.explode("sketch").alias("value"))
    lengths = retained.groupBy("value").agg(F.count("*").alias("length")).where("length > 1")
    shared = (
        retained.join(lengths, "value")
        .groupBy("node")
        .agg(F.sort_array(F.collect_list(F.struct("length", "value"))).alias("shared"))
        .join(classes.select("node", "n"), "node")  # a size for each class, not one for each value
    )
    held = F.least("n", F.lit(options.k))
    needed = F.least(F.ceil(F.col("n") * options.percent / 100), F.lit(options.most_needed))
    first = F.greatest(F.size("shared") - needed + 1, F.lit(0)).cast("int")  # others stand before the shared ones
    first = F.least(first, (held - needed + 1).cast("int"))
    postings = stored(
        shared.select("node", "n", F.explode(F.slice("shared", F.lit(1), first)).alias("entry")).select("node", "n", "entry.value"),
        "postings",
    )
    several = postings.groupBy("value").agg(F.count("*").alias("members")).where("members > 1")
    lists = stored(postings.join(several, "value").select("value", "node", "n", "members"), "inverted-lists")
    dropped(postings)
    return lists


def _parts(load: int | None, most: int) -> int:
    return max(1, ceil((load or 0) / most))


def _in_parts(rows: DataFrame, parts: int, keys: list[str], step: Callable[[DataFrame], DataFrame], label: str) -> DataFrame:
    """``step`` of ``rows``, stored, a part of the keys at a time: disks hold what one part moves."""
    if parts == 1:
        return stored(step(rows), label)
    part = F.pmod(F.xxhash64(*keys), F.lit(parts))
    found = [stored(step(rows.where(part == n)), label) for n in range(parts)]
    whole = stored(reduce(DataFrame.union, found), label)
    dropped(*found)
    return whole


class Comparison:
    """Compares pairs of classes: by their sketches, and those that may be links by their full sets."""

    def __init__(self, docs: DataFrame, classes: DataFrame, options: Options):
        self.docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
        self.classes = classes
        self.options = options
        self.sets = classes.sparkSession.createDataFrame([], "node long, members array<long>")
        self.made: list[DataFrame] = []
        count, shingles = classes.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
        # About the bytes of the texts themselves, whatever the number of pairs.
        self.pairs_at_once = max(PAIRS_AT_ONCE, count)
        self.shingles_at_once = max(SHINGLES_AT_ONCE, shingles // 2)

    def _beside(self, pairs: DataFrame, table: DataFrame, columns: list[str]) -> DataFrame:
        """The columns of both classes of each pair; other classes' rows are not moved."""
        for side in ("a", "b"):
            nodes = _sized(pairs.select(F.col(side).alias("node")).distinct())
            own = table.join(nodes, "node", "left_semi")
            own = own.select(F.col("node").alias(side), *(F.col(c).alias(f"{c}_{side}") for c in columns))
            pairs = pairs.join(own, side)
        return pairs

    def learn(self, nodes: DataFrame) -> None:
        """Make the full sets of classes (``node``) that are not known yet."""
        nodes = nodes.distinct()
        missing = stored(nodes.join(self.sets.select("node"), "node", "left_anti"), "set-nodes")
        if missing.isEmpty():
            return
        keys = stored(self.classes.join(_sized(missing), "node").select("node", "rep", F.col("set_key").alias("key")), "set-keys")
        rows = self.docs.join(_sized(keys.select("rep").distinct()), F.col("doc_id").eqNullSafe(F.col("rep")), "left_semi")
        sets = full_sets(rows, self.options).join(_sized(keys), F.col("set_key") == F.col("key")).select("node", "members")
        sets = stored(sets.dropDuplicates(["node"]), "sets")  # rows may share an id or a text
        dropped(missing, keys)
        self.made.append(sets)
        self.sets = self.sets.union(sets)

    def forget(self) -> None:
        dropped(*self.made)

    def estimates(self, pairs: DataFrame, percent: float) -> DataFrame:
        """a, b, n_a, n_b and the estimated similarity of pairs that may reach ``percent``."""
        union = F.slice(F.sort_array(F.array_union("sketch_a", "sketch_b")), 1, self.options.k)
        both = F.array_intersect("sketch_a", "sketch_b")

        def estimated(part: DataFrame) -> DataFrame:
            found = (
                self._beside(part, self.classes, ["n", "sketch"])
                .where(_sizes_fit("n_a", "n_b", percent))
                .withColumn("union", union)
                .withColumn("estimate", F.size(F.array_intersect("union", both)) / F.size("union"))
            )
            return found.where(F.col("estimate") >= self.options.likely(percent)).select("a", "b", "n_a", "n_b", "estimate")

        return _in_parts(pairs, _parts(pairs.count(), self.pairs_at_once), ["a", "b"], estimated, "estimates")

    def links(self, estimated: DataFrame) -> DataFrame:
        """The pairs that are links; full sets decide."""
        near = estimated.where(F.col("estimate") >= self.options.likely(self.options.percent)).select("a", "b", "n_a", "n_b")
        self.learn(near.select(F.col("a").alias("node")).union(near.select("b")))
        shared = F.size(F.array_intersect("members_a", "members_b")).cast("long").alias("shared")
        united = F.col("n_a") + F.col("n_b") - F.col("shared")

        def confirmed(part: DataFrame) -> DataFrame:
            return (
                self._beside(part, self.sets, ["members"])
                .select("a", "b", "n_a", "n_b", shared)
                .where(100 * F.col("shared") >= self.options.percent * united)
                .select("a", "b")
            )

        load = near.agg(F.sum(F.col("n_a") + F.col("n_b"))).first()[0]
        return _in_parts(near, _parts(load, self.shingles_at_once), ["a", "b"], confirmed, "links")


def _sizes_fit(one: str, other: str, percent: float) -> Column:
    """Whether sets of these sizes can be as similar as ``percent``."""
    return 100 * F.least(one, other) >= percent * F.greatest(one, other)


def _pairs(lists: DataFrame, percent: int) -> DataFrame:
    """All pairs within each list, each once; sizes too different for a link are left out."""
    one = lists.select("value", F.col("node").alias("a"), F.col("n").alias("own"))
    other = lists.select("value", F.col("node").alias("b"), F.col("n").alias("its"))
    fits = (F.col("a") < F.col("b")) & _sizes_fit("own", "its", percent)
    return one.join(other, "value").where(fits).select("a", "b").distinct()


def confirmed_links(lists: DataFrame, comparison: Comparison) -> DataFrame:
    """Links (a, b) that connect what is to be connected."""
    options = comparison.options
    pairs = stored(_pairs(lists.where(F.col("members") <= SMALL_LIST), options.percent), "pairs")
    estimated = comparison.estimates(pairs, options.percent)
    dropped(pairs)
    found = comparison.links(estimated)
    dropped(estimated)
    long = lists.where(F.col("members") > SMALL_LIST)
    if long.isEmpty():
        return found
    pivots = long.groupBy("value").agg(F.min(F.struct("node", "n")).alias("pivot"))
    pairs = long.join(pivots, "value").where("node <> pivot.node")
    pairs = pairs.select(F.col("node").alias("a"), F.col("pivot.node").alias("b"), F.col("n").alias("own"), F.col("pivot.n").alias("its"))
    pairs = stored(pairs.distinct(), "pairs")
    # Beyond twice the limit from a pivot, none can be within the limit of the pivot's links.
    percent = max(0, 2 * options.percent - 100)
    estimated = comparison.estimates(pairs.where(_sizes_fit("own", "its", percent)).select("a", "b"), percent)
    linked = comparison.links(estimated)
    found = stored(found.union(linked), "links")
    among = among_members(pairs.select("a", "b"), estimated, linked, found, comparison)
    dropped(pairs, estimated)
    return found.union(among)


def among_members(
    pairs: DataFrame, estimated: DataFrame, linked: DataFrame, found: DataFrame, comparison: Comparison
) -> DataFrame:
    """Links between members (a) of one pivot (b) that are not connected yet.

    A pivot's members are dealt into blocks, and every two blocks meet in one task, which holds their
    sets and returns no more links than connect them.
    """
    grouped = stored(components(found), "components")
    own = grouped.select(F.col("node").alias("a"), F.col("component").alias("own"))
    placed = (
        pairs.join(linked.select("a", "b", F.lit(NEAR).alias("near")), ["a", "b"], "left")
        .join(estimated.select("a", "b", F.lit(UNSURE).alias("unsure")), ["a", "b"], "left")
        .join(own, "a", "left")
        .select(F.col("a").alias("node"), F.col("b").alias("pivot"), F.coalesce("near", "unsure", F.lit(FAR)).alias("kind"), F.coalesce("own", "a").alias("own"))
    )
    placed = placed.join(comparison.classes.select("node", "n"), "node")
    groups = (
        placed.groupBy("pivot")
        .agg(F.count("*").alias("members"), F.sum("n").alias("shingles"), F.min("own").alias("low"), F.max("own").alias("high"))
        .where("low <> high")
    )
    blocks = F.ceil(F.greatest(F.col("members") / BLOCK_MEMBERS, F.col("shingles") / BLOCK_SHINGLES)).cast("int")
    placed = stored(placed.join(groups.select("pivot", blocks.alias("blocks")), "pivot"), "members")
    dropped(grouped)
    if placed.isEmpty():
        return found.where("false")
    comparison.learn(placed.select("node"))
    block = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    meetings = F.transform(
        F.sequence(F.lit(0), F.col("blocks") - 1),
        lambda other: F.struct(F.least("block", other).alias("i"), F.greatest("block", other).alias("j")),
    )
    dealt = placed.withColumn("block", block).select("pivot", "node", "kind", "own", "n", "block", F.explode(meetings).alias("at"))
    dealt = dealt.select("pivot", "at.i", "at.j", "block", "node", "kind", "own", "n")
    percent = comparison.options.percent

    def compare(table: pa.Table) -> pa.Table:
        links = block_links(table, percent)
        return pa.table({"a": pa.array([x for x, _ in links], pa.int64()), "b": pa.array([y for _, y in links], pa.int64())})

    def met(part: DataFrame) -> DataFrame:
        part = part.join(comparison.sets, "node").select(*dealt.columns, "members")
        if comparison.options.native:
            return member_links(part, percent)
        return part.groupBy("pivot", "i", "j").applyInArrow(compare, "a long, b long").distinct()

    load = placed.agg(F.sum(F.col("n") * F.col("blocks"))).first()[0]
    links = _in_parts(dealt, _parts(load, comparison.shingles_at_once), ["pivot", "i", "j"], met, "member-links")
    dropped(placed)
    return links


def member_links(dealt: DataFrame, percent: int) -> DataFrame:
    """What ``block_links`` is for, as a join of two blocks: one link at least between a member and a component."""
    at, own = ["pivot", "i", "j"], ["block", "node", "kind", "own", "n", "members"]
    one, other = (dealt.where(F.col("block") == F.col(b)).select(*at, *(F.col(c).alias(f"{c}_{s}") for c in own)) for b, s in ("ia", "jb"))
    open_ = (F.col("i") < F.col("j")) | (F.col("node_a") < F.col("node_b"))
    open_ &= (F.col("own_a") != F.col("own_b")) & (F.col("kind_a") + F.col("kind_b") != NEAR + FAR)
    open_ &= 100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b")
    shared = F.size(F.array_intersect("members_a", "members_b"))
    alike = (100 + percent) * shared >= percent * (F.col("n_a") + F.col("n_b"))  # of the union
    met = one.hint("merge").join(other, at).where(open_ & alike)
    return met.groupBy(F.col("node_a").alias("a"), "own_b").agg(F.min("node_b").alias("b")).select("a", "b").distinct()


def block_links(table: pa.Table, percent: int) -> list[tuple[int, int]]:
    """Links between rows of the two blocks in ``table`` that connect what has not been connected."""
    block, kind, sizes = (table[c].to_numpy() for c in ("block", "kind", "n"))
    nodes, group = table["node"].to_pylist(), table["own"].to_numpy().copy()
    members = table["members"].combine_chunks()
    values, starts = members.flatten().to_numpy(), np.concatenate([[0], np.cumsum(members.value_lengths().to_numpy())])
    # Rows by value, so that one row's intersections with all others are counted at once.
    order = np.argsort(values, kind="stable")
    ranked, holders = values[order], np.repeat(np.arange(len(nodes)), np.diff(starts))[order]
    first_block = block == block.min()
    two_blocks = not first_block.all()
    found = []
    for row in np.flatnonzero(first_block):
        open_ = (group != group[row]) & (100 * np.minimum(sizes, sizes[row]) >= percent * np.maximum(sizes, sizes[row]))
        open_ &= ~first_block if two_blocks else np.arange(len(nodes)) > row
        open_ &= (kind + kind[row]) != NEAR + FAR
        if not open_.any():
            continue
        own = values[starts[row] : starts[row + 1]]
        low, high = np.searchsorted(ranked, own, "left"), np.searchsorted(ranked, own, "right")
        counts = high - low
        places = np.repeat(low - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts) + np.arange(counts.sum())
        shared = np.bincount(holders[places], minlength=len(nodes))
        alike = open_ & (100 * shared >= percent * (sizes + sizes[row] - shared))
        for other in np.flatnonzero(alike):
            if group[other] != group[row]:
                found.append((nodes[row], nodes[other]))
                group[group == group[other]] = group[row]
    return found


def near_duplicates(docs: DataFrame, options: Options = Options()) -> DataFrame:
    """doc_id, text_key, n_shingles, component_id and kept of each row of ``docs`` (doc_id, text)."""
    rows = stored(sketches(docs, options), "sketches")
    classes = (
        rows.where("n > 0")
        .groupBy("set_key")
        .agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.any_value("sketch").alias("sketch"))
        .withColumn("node", F.monotonically_increasing_id())  # written at once, so it stays as it is
    )
    classes = stored(classes, "classes")
    lists = inverted_lists(classes, options)
    comparison = Comparison(docs, classes, options)
    links = confirmed_links(lists, comparison)
    dropped(lists)
    comparison.forget()
    grouped = stored(components(links), "components")
    reps = classes.select("node", "rep")
    smallest = grouped.join(reps, "node").groupBy("component").agg(F.min("rep").alias("smallest"))
    renamed = stored(grouped.join(smallest, "component").select("node", "smallest"), "smallest")
    dropped(grouped)
    owners = classes.select("set_key", "node", "rep").join(_sized(renamed), "node", "left")
    owners = owners.select(F.col("set_key").alias("key"), F.coalesce("smallest", "rep").alias("owner"))
    component = F.when(F.col("n") > 0, F.col("owner")).otherwise(F.col("doc_id"))
    return (
        rows.select("doc_id", "text_key", "n", "set_key")
        .join(owners, F.col("set_key") == F.col("key"), "left")
        .select("doc_id", "text_key", F.col("n").alias("n_shingles"), component.alias("component_id"))
        .withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
    )


def one_of_each(docs: DataFrame, options: Options = Options()) -> DataFrame:
    """``docs`` without the near-duplicates of documents with a smaller id."""
    gone = near_duplicates(docs, options).where("not kept").select("doc_id", "text_key").distinct()
    gone = _sized(stored(gone, "duplicates")).select(F.col("doc_id").alias("_gone"), F.col("text_key").alias("_gone_key"))
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("_gone")) & F.unhex(F.md5("text")).eqNullSafe(F.col("_gone_key"))
    return unpacked(packed(docs, "doc_id", "text").join(gone, same, "left_anti"), docs.columns)
