from fractions import Fraction

import pytest
from cases import CLASHES, documents

from logloom.llm import mixing


def naive_targets(sizes, weights, epochs):
    """Reshare by weight, again and again, until nobody is above the limit."""
    ordered = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[n % len(weights)] for n, s in enumerate(ordered)}
    capped, left = {}, Fraction(sum(sizes.values()))
    while open_ := [s for s in ordered if s not in capped]:
        total = sum(weight[s] for s in open_)
        share = {s: left * weight[s] / total for s in open_}
        above = [s for s in open_ if share[s] > epochs * sizes[s]]
        if not above:
            return capped | share
        for s in above:
            capped[s] = Fraction(epochs * sizes[s])
            left -= capped[s]
    return capped


@pytest.mark.parametrize(
    "sizes",
    [
        {"a": 10, "b": 1000, None: 30},
        {"a": 0, "b": 5, "c": 7, "é": 1000, "z": 100},
        {"a": 1},
        {"a": 1, "b": 1, "c": 1, "d": 10_000},
        {"a": 0, "b": 0},
    ],
)
def test_water_fill_equals_resharing(sizes):
    shares = mixing.water_fill(sizes, mixing.cyclic((1, 2, 3)), 3, sum(sizes.values()))
    want = naive_targets(sizes, (1, 2, 3), 3)
    assert {s.source: Fraction(s.numerator, s.denominator) for s in shares} == want


def test_takes_come_near_targets(spark):
    rows = [(n, "w " * (1 + n * 7919 % 50), "en", f"s{n % 3}" if n % 2 else "hot") for n in range(3000)]
    found = mixing.mix_sources(documents(spark, rows)).collect()
    for source in {r["source"] for r in found}:
        own = [r for r in found if r["source"] == source]
        assert abs(sum(r["size"] * r["repeats"] for r in own) - own[0]["target"]) <= 25
        assert all(r["repeats"] <= 3 for r in own)
    again = mixing.mix_sources(documents(spark, rows)).collect()
    assert {(r["doc_id"], r["repeats"]) for r in found} == {(r["doc_id"], r["repeats"]) for r in again}


def test_awkward_rows(spark):
    docs = documents(spark)
    rows = mixing.mix_sources(docs).collect()
    assert len(rows) == docs.count()
    by_id = {r["doc_id"]: r for r in rows}
    assert by_id[2]["size"] == by_id[3]["size"] == by_id[4]["size"] == 0
    assert by_id[1]["_size"] == "own _size" and by_id[1]["size"] == 11
    assert len({r["repeats"] for r in rows if r["doc_id"] == 8}) == 1
    mixed = mixing.mixed(docs)
    assert mixed.columns == docs.columns
    assert mixed.count() == sum(r["repeats"] for r in rows)
    assert {r[c] for r in mixed.collect() for c in CLASHES} == {f"own {c}" for c in CLASHES}


def test_empty_table(spark):
    assert mixing.mix_sources(documents(spark, [])).collect() == []
