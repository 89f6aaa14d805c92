"""Operator 4: mixing sources to target weights by capped water-filling.

Every source gets its share of the budget by weight. A share above ``max_epochs`` times the source's
size stops there, and the excess goes to the others by weight until no share is above. A source with
target T and size S is then taken floor(T / S) times whole, and once more for the documents that come
first in a seeded order until the rest of T is met as nearly as whole documents allow (the error is at
most half the size of one document).

The order is md5(seed:doc_id), doc_id, size, so a decision is a function of the row: repeated rows
share it, reruns agree, and lost tasks may be repeated. A null text has size 0, a null source is a
source of its own, a null doc_id counts as an empty text in the order; an empty table gives no rows.
Columns of the input pass through; those that this operator adds replace columns of the same name.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window, functions as F

from logloom.llm.common import packed, stored, unpacked, word_count

MAX_SOURCES = 100_000  # weights are set per source, so sources are few; more are refused, not dropped
BUCKET_DIGITS = 3  # 4096 slices of the seeded order find the place where a source's last pass ends


@dataclass(frozen=True)
class Share:
    """A source's part of the mix. Its target is ``numerator / denominator`` words."""

    source: str | None
    size: int
    numerator: int
    denominator: int

    @property
    def target(self) -> float:
        return self.numerator / self.denominator

    @property
    def whole(self) -> int:
        """Passes over the whole source."""
        return self.numerator // (self.denominator * self.size) if self.size else 0

    @property
    def rest(self) -> int:
        """Words beyond the whole passes, times the denominator."""
        return self.numerator - self.whole * self.size * self.denominator


def cyclic(weights: Sequence[int]) -> Callable[[int, str | None], int]:
    """Weights given to the sources by turns, in code point order, null last."""
    return lambda position, source: weights[position % len(weights)]


def water_fill(
    sizes: dict[str | None, int],
    weight: Callable[[int, str | None], int],
    max_epochs: int,
    budget: int,
) -> list[Share]:
    """Shares of ``budget`` words. Weights are positive integers; arithmetic is exact."""
    ordered = sorted(sizes, key=lambda s: (s is None, s or ""))
    weights = {source: weight(n, source) for n, source in enumerate(ordered)}
    left, weight_left = budget, sum(weights.values())
    shares = {}
    # Sources that reach their limit first; when one does not, none after it does.
    for source in sorted(ordered, key=lambda s: Fraction(max_epochs * sizes[s], weights[s])):
        limit = max_epochs * sizes[source]
        if limit * weight_left > weights[source] * left:
            break
        shares[source] = Share(source, sizes[source], limit, 1)
        left -= limit
        weight_left -= weights[source]
    return [shares.get(s) or Share(s, sizes[s], weights[s] * left, weight_left) for s in ordered]


def _order(seed: str) -> list[Column]:
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    return [key, F.col("doc_id"), F.col("size")]


def mix_sources(
    docs: DataFrame,
    weights: Sequence[int] = (1, 2, 3),
    max_epochs: int = 3,
    seed: str = "mix",
    budget: int | None = None,
) -> DataFrame:
    """``docs`` (doc_id, text, source) with size, source_size, target (of its source) and repeats.

    ``budget`` is in words; by default as many as the sources hold.
    """
    spark = docs.sparkSession
    key, doc_id, size = _order(seed)
    bucket = F.substring(key, 1, BUCKET_DIGITS)
    sized = stored(docs.select("doc_id", "source", word_count(F.col("text")).alias("size")), "mix-sizes")

    by_source = sized.groupBy("source").agg(F.sum("size").alias("size")).limit(MAX_SOURCES + 1).collect()
    if len(by_source) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    sizes = {row["source"]: row["size"] for row in by_source}
    total = sum(sizes.values()) if budget is None else budget
    shares = spark.createDataFrame(
        [(s.source, s.size, s.target, s.whole, s.rest, s.denominator) for s in water_fill(sizes, cyclic(weights), max_epochs, total)],
        "share_source string, source_size long, target double, whole long, rest long, denominator long",
    )
    same_source = F.col("source").eqNullSafe(F.col("share_source"))

    # The slice of the order in which the rest of the target is reached, then the last row before that.
    in_order = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    slices = (
        sized.groupBy("source", bucket.alias("bucket"))
        .agg(F.sum("size").alias("size"))
        .withColumn("before", F.coalesce(F.sum("size").over(in_order), F.lit(0)))
    )
    last_slice = (
        slices.join(F.broadcast(shares.where("rest > 0")), same_source)
        .where("before * denominator <= rest")
        .groupBy("share_source", "rest", "denominator")
        .agg(F.max("bucket").alias("slice"), F.max_by("before", "bucket").alias("slice_before"))
    )
    ranked = Window.partitionBy("source").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    edges = (
        sized.withColumn("bucket", bucket)
        .join(F.broadcast(last_slice), same_source & (F.col("bucket") == F.col("slice")))
        .groupBy("source", key.alias("key"), "doc_id", "size", "rest", "denominator", "slice_before")
        .agg(F.sum("size").alias("peers"))
        .withColumn("before", F.col("slice_before") + F.coalesce(F.sum("peers").over(ranked), F.lit(0)))
        .where("(2 * before + size) * denominator <= 2 * rest")
        .groupBy("source")
        .agg(F.max(F.struct(F.col("key"), F.col("doc_id"), F.col("size"))).alias("edge"))
        .select(F.col("source").alias("edge_source"), "edge")
    )
    plan = (
        shares.join(
            last_slice.select(F.col("share_source").alias("slice_source"), "slice"),
            F.col("share_source").eqNullSafe(F.col("slice_source")),
            "left",
        )
        .join(edges, F.col("share_source").eqNullSafe(F.col("edge_source")), "left")
        .select(
            F.struct(*(F.col(c) for c in ("share_source", "source_size", "target", "whole", "slice", "edge"))).alias("_share")
        )
    )
    plan = stored(plan, "mix-plan")

    size = F.col("_size")
    once_more = (F.substring("_key", 1, BUCKET_DIGITS) < F.col("_share.slice")) | (
        (F.substring("_key", 1, BUCKET_DIGITS) == F.col("_share.slice"))
        & (F.struct(F.col("_key").alias("key"), F.col("doc_id"), size.alias("size")) <= F.col("_share.edge"))
    )
    rows = (
        packed(docs, "doc_id", "text", "source")
        .withColumn("_size", word_count(F.col("text")))
        .withColumn("_key", key)
        .join(F.broadcast(plan), F.col("source").eqNullSafe(F.col("_share.share_source")))
    )
    added = {
        "size": size,
        "source_size": F.col("_share.source_size"),
        "target": F.col("_share.target"),
        "repeats": F.col("_share.whole") + F.coalesce(once_more, F.lit(False)).cast("long"),
    }
    return unpacked(rows, docs.columns, added)


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: rows of ``docs`` as often as the mix takes them."""
    copies = F.explode(F.sequence(F.lit(1), F.col("repeats").cast("int"))).alias("_copy")
    taken = mix_sources(packed(docs, "doc_id", "text", "source"), **options).where("repeats > 0")
    return unpacked(taken.select("_row", copies), docs.columns)
