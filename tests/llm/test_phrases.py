import random
import re
from collections import Counter

import numpy as np
import pytest
from cases import DOCUMENTS, documents

from logloom.llm import phrases as ph


def brute_force(rows, options=ph.Options()):
    counts: dict[str, Counter] = {}
    for _, text, lang, *_ in rows:
        own = counts.setdefault("und" if lang is None else lang, Counter())
        lowered = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lowered):
            words = re.findall(r"[^\x20\x09]+", piece)
            for size in range(1, options.max_words + 1):
                own.update(tuple(words[at : at + size]) for at in range(len(words) - size + 1))
    found = []
    for lang, f in counts.items():
        total = sum(n for p, n in f.items() if len(p) == 1)
        candidates = {p: n for p, n in f.items() if len(p) > 1 and n >= options.min_count}
        kept = []
        for p, a in candidates.items():
            longer = [n for q, n in candidates.items() if len(q) > len(p) and any(q[at : at + len(p)] == p for at in range(len(q)))]
            if any(100 * n >= options.held_percent * a for n in longer):
                continue
            cuts = [(options.scale * a * a // (f[p[:k]] * f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p))]
            score, _, left, right = min(cuts)
            kept.append((-score, -a, " ".join(p).encode(), left, right))
        for rank, (score, a, p, left, right) in enumerate(sorted(kept)[: options.top], 1):
            found.append((lang, rank, p.decode(), -a, left, right, total, -score))
    return sorted(found)


def result(docs, options=ph.Options()):
    return sorted(map(tuple, ph.collocations(docs, options).collect()))


def corpus(seed, size=400, langs=("en", "fr", None)):
    rnd = random.Random(seed)
    vocabulary = ["the", "The", "of", "é", "日本", "a", "b", "new", "york", "city", "x1", "don't", "\x85", "\x00"] + [f"w{n}" for n in range(30)]
    weights = [1 / (n + 1) for n in range(len(vocabulary))]
    found = []
    for n in range(size):
        words = rnd.choices(vocabulary, weights, k=rnd.randint(0, 40))
        text = "".join(w + rnd.choice([" ", "  ", "\t", " ", ", ", ".", "\n", " "]) for w in words)
        found.append((n, text + "New York City. " * (n % 3 == 0), rnd.choice(langs), "s"))
    return found


SETTINGS = {
    "as they are": {},
    "salted": {"HOT_LEAST": 30, "HOT_SHARE": 10**9, "BUCKET": 50},
    "small blocks": {"BLOCK": 20, "BUCKET": 2000, "AT_ONCE": 64},
    "small slices": {"SLICE": 5, "AT_ONCE": 7, "HOT_LEAST": 100, "COUNTED": 4, "BUCKET": 100},
    "shuffled": {"BROADCAST_ROWS": -1, "HELD": 1},
}


@pytest.mark.parametrize("name", SETTINGS)
def test_equals_brute_force(spark, monkeypatch, name):
    for constant, value in SETTINGS[name].items():
        monkeypatch.setattr(ph, constant, value)
    rows = corpus(name)
    found = result(documents(spark, rows).repartition(5))
    assert len(found) > 50 and found == brute_force(rows)


@pytest.mark.parametrize("options", [ph.Options(max_words=2, min_count=3, top=7), ph.Options(max_words=5, min_count=4, held_percent=80), ph.Options(min_count=1)])
def test_other_options(spark, monkeypatch, options):
    monkeypatch.setattr(ph, "HOT_LEAST", 40)
    rows = corpus(5, 60)
    assert result(documents(spark, rows).repartition(3), options) == brute_force(rows, options)


def test_copies_and_ties(spark):
    rows = [(1, "same words here again", "en", "s")] * 25 + [(2, "other words there again", "en", "s")] * 25
    found = result(documents(spark, rows))
    assert found == brute_force(rows) and [r[2] for r in found if r[1] == 1] == ["other words there"]


def test_awkward_rows(spark):
    options = ph.Options(min_count=2)
    assert result(documents(spark), options) == brute_force(DOCUMENTS, options)
    one = [(1, "word" * 300_000 + " " + "a b " * 40_000, "en", "s")]
    assert result(documents(spark, one)) == brute_force(one)


def test_empty_table(spark):
    assert ph.collocations(documents(spark, [])).collect() == []


def test_scores_beyond_64_bits(spark):
    a, left, right = 3 * 10**17, 4 * 10**18, 9 * 10**17 + 1
    candidates = spark.createDataFrame([("en", bytearray(b"x y"), a)], "lang string, phrase binary, a long")
    singles = spark.createDataFrame([("en", bytearray(b"x"), left), ("en", bytearray(b"y"), right)], "lang string, word binary, f long")
    (row,) = ph.scored(candidates, singles, ph.Options()).collect()
    assert (row["l"], row["r"], row["score"]) == (left, right, 10**6 * a * a // (left * right))


@pytest.mark.parametrize("seed", range(4))
def test_sort_equals_counting(seed):
    rng = np.random.default_rng(seed)
    keys = rng.integers(0, 6, (500, 3))
    keys[:, 1][keys[:, 0] == 0] = 0
    keys[:, 2][keys[:, 1] == 0] = 0
    counts = rng.integers(1, 4, 500)
    expected: Counter = Counter()
    for row, n in zip(keys.tolist(), counts.tolist()):
        for size in (1, 2, 3):
            if row[size - 1]:
                expected[tuple(row[:size])] += n
    for least in (1, 10, 60):
        found = [(tuple(keys[at, :n].tolist()), int(c)) for n, ats, cs in ph.equal_parts(keys, counts, least, seed) for at, c in zip(ats, cs)]
        assert sorted(found) == sorted((p, n) for p, n in expected.items() if n >= least)
