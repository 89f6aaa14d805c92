import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from cases import DOCUMENTS, LONG, documents

from logloom.llm import catalog, syncmers as sm


def plain_syncmers(text):
    """By the definition: k-mers whose least inner hash is at an edge."""
    smers = sm._smers(sm._points(text), sm.S)
    width = sm.K - sm.S + 1
    found = []
    for at in range(len(text) - sm.K + 1):
        inner = smers[at : at + width]
        if inner.min() in (inner[0], inner[-1]):
            found.append(at)
    return found


@pytest.mark.parametrize("seed", range(8))
def test_equals_the_definition(seed, monkeypatch):
    rnd = random.Random(seed)
    text = "".join(rnd.choice("abcde éß\U0001f600") for _ in range(rnd.randint(16, 400)))
    whole = sm.syncmers(text)
    assert whole[0].tolist() == plain_syncmers(text)
    monkeypatch.setattr(sm, "CHUNK", 37)
    assert [x.tolist() for x in sm.syncmers(text)] == [x.tolist() for x in whole]


def test_anchors_keep_their_passage():
    rnd = random.Random(1)
    passage = "".join(rnd.choice("abcdefgh ") for _ in range(300))
    positions, hashes = sm.syncmers(passage)
    moved, others = sm.syncmers("xyz " * 9 + passage + " zz" * 9)
    assert set(zip((positions + 36).tolist(), hashes.tolist())) <= set(zip(moved.tolist(), others.tolist()))
    one, other = sm.sketch(passage), sm.sketch("xyz " + passage)
    places = sm.matches(one, other)
    assert len(places) > 30 and sum(b - a == 4 for a, b in places) > 0.9 * len(places)


def test_likeness_is_the_true_share():
    rnd = random.Random(2)
    words = ["".join(rnd.choice("abcdefghij") for _ in range(7)) for _ in range(3000)]
    one, other = " ".join(words), " ".join(words[:1500] + words[:0:-1][:1500])
    a, b = (set(sm.syncmers(t)[1].tolist()) for t in (one, other))
    assert sm.likeness(sm.sketch(one), sm.sketch(other)) == 2 * len(a & b) / (len(a) + len(b))


@pytest.mark.parametrize("own", [1000, 20_000, 100_000])
def test_shared_passages_match_in_texts_of_any_length(own):
    rnd = random.Random(own)
    chars = lambda n: "".join(rnd.choice("abcdefgh ") for _ in range(n))
    passage = chars(2000)
    one, other = f"{chars(own)}{passage}{chars(own)}", f"{chars(own // 2)}{passage}{chars(own)}"
    whole, again = sm.sketch(one), sm.sketch(other)
    assert sm.alike(whole, again) > 300 and sm.likeness(whole, again) > 0
    places = [(a, b) for a, b in sm.matches(sm.fingerprint(whole), sm.fingerprint(again)) if b - a == own // 2 - own]
    assert len(places) >= 5 and all(own <= a < own + 2000 for a, _ in places)
    assert len(sm.fingerprint(whole)) > len(one) / 200


def kept(found):
    return [r for n, r in enumerate(found.tolist()) if n < 16 or r[0] * 16 < 2**32]


def share(a, b):
    return 2 * len(a.keys() & b.keys()) / (len(a) + len(b)) if a and b else float(len(a) == len(b))


def shifted(a, b):
    return max(Counter(b[h] - a[h] for h in a.keys() & b.keys()).values(), default=0)


def brute_force(rows):
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0]))
    for n, (doc_id, text) in enumerate(ordered):
        text, following = text or "", ordered[(n + 1) % len(ordered)][1] or ""
        changed = text[: len(text) - len(text) // 2] + following[: len(text) // 2]
        own, new = sm.sketch(text), sm.sketch(changed)
        digest = hashlib.sha256(changed.encode()).hexdigest()
        other, prints = sm.sketch(following), [sm.written_out(np.array(kept(s), np.uint32).reshape(-1, 2)) for s in (own, new)]
        a, b, c = (dict(s.tolist()) for s in (own, new, other))
        yield doc_id, len(text), digest, *prints, share(a, b), share(a, c), shifted(a, b), shifted(a, c)


@pytest.mark.parametrize("per_bucket", [2, 7, 5000])
def test_fingerprints_equal_brute_force(spark, monkeypatch, per_bucket):
    monkeypatch.setattr(sm, "ROWS_PER_BUCKET", per_bucket)
    rows = [(n * 3 % 50 * (1 if n % 2 else 1000), f"{n} words of text number {n} " * (n % 7)) for n in range(50)]
    docs = documents(spark, [(a, t, "en", "s") for a, t in dict(rows).items()])
    assert sorted(map(tuple, sm.fingerprints(docs).collect())) == sorted(brute_force(list(dict(rows).items())))


def test_awkward_rows(spark, monkeypatch):
    monkeypatch.setattr(sm, "ROWS_PER_BUCKET", 3)
    rows = sm.fingerprints(documents(spark)).collect()
    assert len(rows) == len(DOCUMENTS)
    empty = [r for r in rows if r["doc_id"] in (2, 3)]
    assert all(r["fingerprint"] == "" and r["n_chars"] == 0 and r["near_edited"] == 1.0 for r in empty)
    assert len({r["fingerprint"] for r in rows if r["doc_id"] in (1, 8)}) == 1
    assert [r["n_chars"] for r in rows if r["doc_id"] == 5] == [len(LONG)]
    assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in rows)


def test_one_row_follows_itself(spark):
    (row,) = sm.fingerprints(documents(spark, [(4, "just one text, some words long", "en", "a")])).collect()
    assert row["near_next"] == 1.0


def test_empty_table(spark):
    assert sm.fingerprints(documents(spark, [])).collect() == []
    assert sm.anchors(documents(spark, [])).collect() == []


def test_fingerprint_text_round_trip():
    found = sm.sketch(LONG)
    assert np.array_equal(sm.parsed(sm.written_out(found)), found)


def test_the_query_keeps_all_anchors(spark, tmp_path):
    rnd = random.Random(6)
    words = lambda n: " ".join("".join(rnd.choice("abcdefghij") for _ in range(7)) for _ in range(n))
    passage = words(40)
    texts = [f"{words(500)} {passage} {words(500)}", f"{words(900)} {passage}", words(30), "short", "", None]
    documents(spark, [(n, t, "en", "s") for n, t in enumerate(texts)]).write.parquet(f"{tmp_path}/documents.parquet")
    rows = {r["doc_id"]: r for r in catalog.op6_syncmer_fingerprints(spark, str(tmp_path)).collect()}
    for n, text in enumerate(texts):
        whole, following = text or "", texts[(n + 1) % len(texts)] or ""
        changed = whole[: len(whole) - len(whole) // 2] + following[: len(whole) // 2]
        assert np.array_equal(sm.parsed(rows[n]["fingerprint"]), sm.sketch(whole))
        assert np.array_equal(sm.parsed(rows[n]["edited_fingerprint"]), sm.sketch(changed))
    one, other = (sm.parsed(rows[n]["fingerprint"]) for n in (0, 1))
    inside = set(sm.sketch(passage)[:, 0].tolist())
    assert inside <= set(np.intersect1d(one[:, 0], other[:, 0]).tolist()) and len(inside) > 40
