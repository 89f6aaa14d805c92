"""Operator 9: approximate nearest neighbours by a forest of random-projection trees.

A tree halves the vectors again and again: each level has a random direction, each node the median of
its vectors' projections. The directions and medians come from a sample of at most ``SAMPLE_FLOATS``
numbers; then every vector is put into its leaf of every tree. A query walks all trees through one
priority queue ordered by how far from the query a branch begins, and stops where that is more than
``REACH`` times the distance of its tenth neighbour in the sample. All vectors of the leaves it has
reached are ranked by their exact distances in double precision.

Vectors of a leaf stay together in pages of neighbouring leaves, and queries travel to the pages they
reach. A page that many queries reach is read once for each ``QUERY_BLOCK`` of them, and one that holds many
vectors is cut into slices of about ``SLICE_ROWS``, each of which meets all the page's queries; pages that no
query reaches are not read. So no task holds more for a larger table, and vectors travel about as often as queries.
Equal vectors are one vector with its smallest ids, so copies neither fill leaves nor tie tasks: more
than ``neighbours`` + 1 of them can't be in any answer.

Vectors that are null, empty, zero, of another length than most, or that hold null or non-finite
components take no part, as query or as candidate; nor do rows without an id. A row is no neighbour of
rows with its own id. Ties go to the smaller id. With fewer candidates than asked, all are returned;
without queries or vectors, none.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from logloom.llm.common import small, stored

TREES = 4
LEAF_ROWS = 128
PAGE_ROWS = 4096
REACH = 0.12
SAMPLE_FLOATS = 1_000_000
QUERY_BLOCK = 5000
SLICE_ROWS = 8192
PAGES_BROADCAST = 200_000
SEED = 5


@dataclass
class Forest:
    directions: np.ndarray  # tree, level, component; of length 1
    splits: np.ndarray  # tree, node in breadth-first order from 1
    page_bits: int  # lower levels that lie within a page
    sample: np.ndarray
    sample_ids: np.ndarray

    @property
    def depth(self) -> int:
        return self.directions.shape[1]

    def projected(self, vectors: np.ndarray) -> np.ndarray:
        """vector, tree, level"""
        trees, depth, size = self.directions.shape
        return (vectors @ self.directions.reshape(-1, size).T).reshape(len(vectors), trees, depth)

    def leaves(self, vectors: np.ndarray) -> np.ndarray:
        """The leaf of each vector in each tree."""
        found = np.zeros((len(vectors), len(self.directions)), np.int64)
        projected = self.projected(vectors)
        for tree in range(found.shape[1]):
            for level in range(self.depth):
                node = found[:, tree]
                found[:, tree] = 2 * node + (projected[:, tree, level] >= self.splits[tree, (1 << level) + node])
        return found

    def radius(self, vector: np.ndarray, own: int, neighbours: int) -> float:
        """About the distance of the farthest neighbour to be found."""
        distances = np.sqrt(((self.sample - vector) ** 2).sum(1))[self.sample_ids != own]
        if not len(distances):
            return math.inf
        return float(np.partition(distances, min(neighbours, len(distances)) - 1)[min(neighbours, len(distances)) - 1])

    def reached(self, vector: np.ndarray, most: float, least_leaves: int) -> list[tuple[int, int]]:
        """Leaves (tree, leaf) that begin within ``most`` of the vector, the nearest first.

        Goes on beyond until there are ``least_leaves``.
        """
        projected = self.projected(vector[None])[0]
        queue = [(0.0, tree, 0, 0) for tree in range(len(self.directions))]
        found: list[tuple[int, int]] = []
        while queue:
            away, tree, level, node = heapq.heappop(queue)
            if away > most and len(found) >= least_leaves:
                break
            if level == self.depth:
                found.append((tree, node))
                continue
            margin = float(projected[tree, level] - self.splits[tree, (1 << level) + node])
            near = int(margin >= 0)
            heapq.heappush(queue, (away, tree, level + 1, 2 * node + near))
            heapq.heappush(queue, (max(away, abs(margin)), tree, level + 1, 2 * node + 1 - near))
        return found


def grown(sample: np.ndarray, sample_ids: np.ndarray, total: int) -> Forest:
    """Trees whose leaves hold about ``LEAF_ROWS`` of ``total`` vectors, as far as the sample can tell."""
    rng = np.random.default_rng(SEED)
    depth = max(0, math.ceil(math.log2(max(1, total) / LEAF_ROWS)))
    depth = min(depth, max(0, int(math.log2(max(1, len(sample)))) - 2))
    directions = rng.standard_normal((TREES, depth, sample.shape[1]))
    directions /= np.linalg.norm(directions, axis=2, keepdims=True)
    splits = np.zeros((TREES, 1 << depth))
    for tree in range(TREES):
        projected, node = sample @ directions[tree].T, np.zeros(len(sample), np.int64)
        for level in range(depth):
            for n in range(1 << level):
                inside = projected[node == n, level]
                splits[tree, (1 << level) + n] = np.median(inside) if len(inside) else 0.0
            node = 2 * node + (projected[:, level] >= splits[tree, (1 << level) + node])
    page_bits = min(depth, max(0, int(math.log2(PAGE_ROWS * (1 << depth) / max(1, total)))))
    return Forest(directions, splits, page_bits, sample, sample_ids)


def usable(vector: Column) -> Column:
    """Whether a vector is there, finite and not zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def distinct_vectors(rows: DataFrame, neighbours: int) -> DataFrame:
    """uid, vector and the smallest ids of each distinct vector of ``rows`` (vec_id, vector)."""
    first = Window.partitionBy("vector").orderBy("vec_id")
    few = rows.distinct().withColumn("nth", F.row_number().over(first)).where(F.col("nth") <= neighbours + 1)
    grouped = few.groupBy("vector").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    return stored(grouped.select(F.monotonically_increasing_id().alias("uid"), "vector", "ids"), "vectors")


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    values = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return values.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, size)


def nearest(rows: DataFrame, is_query: Column, neighbours: int = 10) -> DataFrame:
    """query_id, rank, vec_id and score (Euclidean distance) for the rows of ``rows`` where ``is_query``.

    ``rows`` has vec_id and embedding.
    """
    spark = rows.sparkSession
    rows = rows.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>").alias("vector"), is_query.alias("asks"))
    rows = rows.where(F.col("vec_id").isNotNull() & usable(F.col("vector")))
    lengths = rows.groupBy(F.size("vector").alias("size")).count().orderBy(F.desc("count"), "size").first()
    if lengths is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    size = lengths["size"]
    rows = rows.where(F.size("vector") == size)
    vectors = distinct_vectors(rows.select("vec_id", "vector"), neighbours)
    total = vectors.count()
    asked = rows.where("asks").select(F.col("vec_id").alias("query_id"), "vector").distinct()
    asked = stored(asked.join(vectors.select("uid", "vector"), "vector"), "queries")

    parts, wanted = 1 << 20, max(1, SAMPLE_FLOATS // size)
    share = min(parts, math.ceil(parts * wanted / total))
    sampled = vectors.where(F.pmod(F.xxhash64("uid"), F.lit(parts)) < share).select("uid", "vector").limit(2 * wanted).orderBy("uid").toArrow()
    forest = grown(_matrix(sampled["vector"], size), sampled["uid"].to_numpy(), total)

    def indexed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = forest
        for batch in batches:
            if not batch.num_rows:
                continue
            leaves = own.leaves(_matrix(batch.column("vector"), size))
            for tree in range(leaves.shape[1]):
                leaf = leaves[:, tree]
                places = [pa.array(np.full(len(leaf), tree)), pa.array(leaf >> own.page_bits), pa.array(leaf)]
                yield pa.RecordBatch.from_arrays(places + batch.columns, ["tree", "page", "leaf", *batch.schema.names])

    def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = forest
        least = math.ceil(4 * (neighbours + 1) / LEAF_ROWS) * len(own.directions) + 4
        for batch in batches:
            if not batch.num_rows:
                continue
            for uid, vector in zip(batch.column("uid").to_pylist(), _matrix(batch.column("vector"), size)):
                pages: dict[tuple[int, int], list[int]] = {}
                for tree, leaf in own.reached(vector, REACH * own.radius(vector, uid, neighbours), least):
                    pages.setdefault((tree, leaf >> own.page_bits), []).append(leaf)
                columns = {
                    "tree": pa.array([t for t, _ in pages], pa.int64()),
                    "page": pa.array([p for _, p in pages], pa.int64()),
                    "query": pa.array([uid] * len(pages), pa.int64()),
                    "vector": pa.array([vector] * len(pages), pa.list_(pa.float64())),
                    "leaves": pa.array(list(pages.values()), pa.list_(pa.int64())),
                }
                yield pa.RecordBatch.from_pydict(columns)

    def ranked(page: pa.Table, queries: pa.Table) -> pa.Table:
        """The nearest vectors of a slice of a page for each query of a block."""
        columns: dict[str, list] = {"query": [], "uid": [], "score": [], "ids": []}
        if page.num_rows and queries.num_rows:
            leaf, uids, ids = page["leaf"].to_numpy(), page["uid"].to_numpy(), page["ids"].to_pylist()
            least = np.array([i[0] for i in ids])
            vectors = _matrix(page["vector"], size)
            asking = zip(queries["query"].to_pylist(), _matrix(queries["vector"], size), queries["leaves"].to_pylist())
            for query, vector, leaves in asking:
                near = np.flatnonzero(np.isin(leaf, leaves))
                scores = np.sqrt(((vectors[near] - vector) ** 2).sum(1))
                best = np.lexsort((least[near], scores))[: neighbours + 1]
                columns["query"] += [query] * len(best)
                columns["uid"] += uids[near[best]].tolist()
                columns["score"] += scores[best].tolist()
                columns["ids"] += [ids[n] for n in near[best]]
        kinds = pa.schema([("query", pa.int64()), ("uid", pa.int64()), ("score", pa.float64()), ("ids", pa.list_(pa.int64()))])
        return pa.table(columns, kinds)

    page = ("tree", "page")
    places = "tree long, page long, leaf long, uid long, vector array<double>, ids array<long>"
    index = vectors.mapInArrow(indexed, places)
    once = asked.select("uid", "vector").dropDuplicates(["uid"])
    wanted_pages = "tree long, page long, query long, vector array<double>, leaves array<long>"
    probes = stored(once.mapInArrow(searched, wanted_pages), "probes")

    held, asking = (f.groupBy(*page).agg(F.count("*").alias("rows")) for f in (index, probes))
    slices, blocks = (F.ceil(f["rows"] / most).alias(n) for f, most, n in ((held, SLICE_ROWS, "slices"), (asking, QUERY_BLOCK, "blocks")))
    pages = stored(held.join(asking, [*page]).select(*page, slices, blocks), "pages")
    if small(pages, PAGES_BROADCAST):
        pages = F.broadcast(pages)

    def part(key: str, count: str) -> Column:
        return F.pmod(F.xxhash64(key), F.col(count))

    def every(count: str) -> Column:
        return F.explode(F.sequence(F.lit(0).cast("long"), F.col(count) - 1))

    index = index.join(pages, [*page]).withColumns({"slice": part("uid", "slices"), "block": every("blocks")}).drop("slices", "blocks")
    probes = probes.join(pages, [*page]).withColumns({"block": part("query", "blocks"), "slice": every("slices")}).drop("slices", "blocks")
    keys = (*page, "slice", "block")
    found = index.groupBy(*keys).cogroup(probes.groupBy(*keys)).applyInArrow(ranked, "query long, uid long, score double, ids array<long>")

    by_distance = Window.partitionBy("query_id").orderBy("score", "vec_id")
    near = found.groupBy("query", "uid").agg(F.min("score").alias("score"), F.first("ids").alias("ids"))
    best = Window.partitionBy("query").orderBy("score", F.col("ids")[0])
    near = near.withColumn("nth", F.row_number().over(best)).where(F.col("nth") <= neighbours + 1)
    return (
        asked.select("query_id", F.col("uid").alias("query"))
        .join(near, "query")
        .select("query_id", "score", F.explode("ids").alias("vec_id"))
        .where("vec_id <> query_id")
        .withColumn("rank", F.row_number().over(by_distance))
        .where(F.col("rank") <= neighbours)
        .select("query_id", "rank", "vec_id", "score")
    )
