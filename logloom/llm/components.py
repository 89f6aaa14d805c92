"""Connected components of a graph given as links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from logloom.llm.common import dropped, gathered, stored


def _both_ways(links: DataFrame) -> DataFrame:
    return links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _least(neighbours: DataFrame) -> DataFrame:
    return neighbours.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("least"))


def components(links: DataFrame) -> DataFrame:
    """``links`` (a, b: long, a <> b) to node and component, the smallest node reachable.

    Each round writes its links to the shared folder and deletes those of the round before, so the plan stays
    short and a lost executor costs one round. A hub's neighbours are never gathered in one place. Few links are handled in few tasks.
    """
    links, before = stored(links.select("a", "b").distinct(), "links"), None
    rows = links.count()
    while True:
        # Nodes beyond a node go to its least neighbour; then a node and those before it do.
        around = _both_ways(links)
        large = around.join(_least(around), "a").where("b > a").select(F.col("b").alias("a"), F.col("least").alias("b"))
        large = gathered(large.where("a <> b"), rows).distinct()
        down = gathered(large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")), rows)
        least = _least(down)
        small = down.join(least, "a").select(F.col("b").alias("a"), F.col("least").alias("b"))
        small = small.union(least.select("a", F.col("least").alias("b"))).where("a <> b")
        round_before, links = links, stored(gathered(gathered(small, 2 * rows).distinct(), rows), "links")
        dropped(round_before)
        now = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before, rows = now, now[0]
    nodes = links.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return gathered(nodes.union(links.select("b", "b")).distinct(), rows)
