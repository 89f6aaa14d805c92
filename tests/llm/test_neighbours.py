import numpy as np
import pytest
from pyspark.sql import functions as F

from logloom.llm import neighbours as nn


def table(spark, rows):
    found = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    return found.withColumns({c: F.lit("own") for c in ("vector", "uid", "asks", "tree", "rank", "score", "ids", "query")})


def brute_force(rows, is_query, count):
    found = {}
    for q, a in rows:
        if is_query(q):
            near = sorted((float(np.sqrt(((np.float64(np.float32(a)) - np.float64(np.float32(b))) ** 2).sum())), v) for v, b in rows if v != q)
            found[q] = near[:count]
    return found


def answers(frame):
    found = {}
    for row in frame.orderBy("query_id", "rank").collect():
        found.setdefault(row["query_id"], []).append((row["score"], row["vec_id"]))
        assert row["rank"] == len(found[row["query_id"]])
    return found


def test_recall(spark):
    rng = np.random.default_rng(1)
    centres = rng.standard_normal((20, 24))
    rows = [(n, (centres[n % 20] + rng.standard_normal(24) * 0.7).tolist()) for n in range(6000)]
    got = answers(nn.nearest(table(spark, rows), F.col("vec_id") % 100 == 0))
    want = brute_force(rows, lambda q: q % 100 == 0, 10)
    assert got.keys() == want.keys() and all(len(g) == 10 for g in got.values())
    recall = np.mean([len({v for _, v in got[q]} & {v for _, v in want[q]}) / 10 for q in want])
    assert recall >= 0.9
    for q, near in got.items():
        assert near == sorted(near) and all(abs(s - np.linalg.norm(np.float32(rows[q][1]).astype(float) - np.float32(rows[v][1]))) < 1e-6 for s, v in near)


def test_ties_copies_and_own_row(spark):
    rows = [(n, [1.0, 2.0]) for n in range(40)] + [(n, [float(n), 0.0]) for n in range(100, 130)] + [(7, [1.0, 2.0])]
    once = sorted(dict(rows).items())
    got = answers(nn.nearest(table(spark, rows), F.col("vec_id") % 10 == 0))
    want = brute_force(once, lambda q: q % 10 == 0, 10)
    assert {q: [v for _, v in n] for q, n in got.items()} == {q: [v for _, v in n] for q, n in want.items()}


def test_vectors_that_take_no_part(spark):
    bad = [None, [], [0.0, 0.0], [float("nan"), 1.0], [float("inf"), 1.0], [None, 1.0], [1.0, 2.0, 3.0]]
    rows = [(100 + n, v) for n, v in enumerate(bad)] + [(0, [1.0, 1.0]), (1, [1.0, 2.0]), (200, [4.0, 2.0]), (None, [1.0, 1.0])]
    got = answers(nn.nearest(table(spark, rows), F.col("vec_id") % 100 == 0))
    assert {q: [v for _, v in n] for q, n in got.items()} == {0: [1, 200], 200: [1, 0]}


@pytest.mark.parametrize("rows", [[], [(0, None)], [(0, [1.0])], [(1, [1.0]), (2, [2.0])]])
def test_no_answers(spark, rows):
    assert nn.nearest(table(spark, rows), F.col("vec_id") % 100 == 0).collect() == []


def test_the_queue_gives_the_nearest_leaves_first():
    rng = np.random.default_rng(2)
    vectors = rng.standard_normal((2000, 8))
    forest = nn.grown(vectors, np.arange(2000), 2000)
    assert forest.depth == 4 and forest.leaves(vectors).max() < 16
    reached = forest.reached(vectors[5], 0.3, 4)
    assert reached[: nn.TREES] and set(enumerate(forest.leaves(vectors[5:6])[0].tolist())) <= set(reached)
    assert len(set(reached)) == len(reached)
    everything = forest.reached(vectors[5], np.inf, 0)
    assert len(everything) == nn.TREES * 16 and everything[: len(reached)] == reached


def test_slices_and_blocks_of_a_page_give_the_same(spark, monkeypatch):
    rng = np.random.default_rng(6)
    rows = [(n, rng.standard_normal(6).tolist()) for n in range(1500)] + [(2000 + n, [1.0] * 6) for n in range(30)]
    frame, asks = table(spark, rows), F.col("vec_id") % 10 == 0
    whole = answers(nn.nearest(frame, asks))
    for name, value in (("SLICE_ROWS", 100), ("QUERY_BLOCK", 7), ("PAGES_BROADCAST", 0)):
        monkeypatch.setattr(nn, name, value)
    assert answers(nn.nearest(frame, asks)) == whole and len(whole) == 153
