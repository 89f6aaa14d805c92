import random
import re

import numpy as np
import pytest
from cases import DOCUMENTS, documents
from hypothesis import given, settings, strategies as st

from logloom.llm import pii, tagger

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def by_definition(text):
    found = []
    for kind, pattern in PATTERNS.items():
        for match in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", match.group())
            total = sum(int(d) if n % 2 == 0 else (2 * int(d)) // 10 + (2 * int(d)) % 10 for n, d in enumerate(reversed(digits)))
            fits = {
                "email": True,
                "ip": all(int(part) <= 255 for part in match.group().split(".")) if kind == "ip" else False,
                "card": 14 <= len(digits) <= 19 and total % 10 == 0,
                "phone": 10 <= len(digits) <= 15,
            }
            if fits[kind]:
                found.append((match.start(), list(PATTERNS).index(kind), match.end()))
    return sorted(found)


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="aZ09.@+-_%() 15\né", max_size=80))
def test_base_spans_equal_the_patterns(text):
    assert pii.base_spans(text) == by_definition(text)


def test_base_spans_of_typical_texts():
    text = "Mail a.b@x.example.com, b@y or c@@z.de; 1.2.3.4.5.6.7.8.9 256.1.1.1 007.0.0.255; 4111 1111 1111 1111; 4111-1111-1111-1112; +1 (017) 555-7713."
    assert pii.base_spans(text) == by_definition(text)
    assert [text[s:e] for s, k, e in pii.base_spans(text)] == ["a.b@x.example.com", "1.2.3.4", "5.6.7.8", "007.0.0.255", "4111 1111 1111 1111", "+1 (017) 555-7713"]


def test_long_runs_take_linear_time():
    for text in ("1" * 200_000, "a." * 200_000, "1." * 100_000, "1 " * 100_000, "+1 " * 60_000, "a" * 300_000 + "@", "@" * 200_000, "5" * 5000 + ".1.2.3"):
        assert all(0 <= s < e <= len(text) for s, _, e in pii.base_spans(text))


def brute_log_loss(scores, labels, length, steps, first):
    """Log loss of one window over all its label sequences."""
    import itertools

    def total(found):
        return first[found[0]] + scores[0, found[0]] + sum(steps[a, b] + scores[t + 1, b] for t, (a, b) in enumerate(zip(found, found[1:])))

    every = [total(found) for found in itertools.product(range(scores.shape[1]), repeat=length)]
    best = max(itertools.product(range(scores.shape[1]), repeat=length), key=total)
    return np.log(np.sum(np.exp(every))) - total(labels[:length].tolist()), best


def test_crf_equals_enumeration():
    rng = np.random.default_rng(3)
    scores, steps, first = rng.normal(size=(3, 5, 3)), rng.normal(size=(3, 3)), rng.normal(size=3)
    labels, lengths = rng.integers(0, 3, (3, 5)), np.array([5, 3, 1])
    loss, *_ = tagger.crf_gradient(scores, labels, lengths, steps, first)
    each = [brute_log_loss(scores[n], labels[n], lengths[n], steps, first) for n in range(3)]
    assert abs(loss - sum(x for x, _ in each)) < 1e-9
    weights = tagger.initial(4, 3, 2) | {"steps": steps, "first": first}
    rows = rng.integers(1, 4, (3, 5)).astype(np.uint8)
    own = tagger.emissions(weights, rows, lengths)
    found = tagger.decode(weights, rows, lengths)
    for n in range(3):
        assert tuple(found[n, : lengths[n]]) == brute_log_loss(own[n], labels[n], lengths[n], steps, first)[1]


def test_gradient_equals_differences():
    rng = np.random.default_rng(0)
    rows, lengths = rng.integers(1, 6, (3, 7)).astype(np.uint8), np.array([7, 4, 1])
    labels = np.zeros((3, 7), int)
    labels[0, 1:3], labels[1, 0] = (1, 2), 3
    weights, allowed = tagger.initial(6, 9, 4), pii.allowed_steps()
    found = tagger.gradient(weights, rows, lengths, labels, allowed)[1]
    for name, values in weights.items():
        flat = values.reshape(-1)
        for at in rng.choice(flat.size, min(8, flat.size), replace=False):
            old, losses = flat[at], []
            for step in (1e-5, -1e-5):
                flat[at] = old + step
                losses.append(tagger.gradient(weights, rows, lengths, labels, allowed)[0])
            flat[at] = old
            assert abs((losses[0] - losses[1]) / 2e-5 - found[name].reshape(-1)[at]) < 1e-6


def luhn_number(rnd):
    digits = "".join(rnd.choice("0123456789") for _ in range(15))
    return next(digits + d for d in "0123456789" if pii.luhn(digits + d))


def private(rnd):
    card = luhn_number(rnd)
    return rnd.choice(
        [
            f"{rnd.choice(['ann', 'bo.li', 'x_9'])}{rnd.randint(1, 99)}@mail{rnd.randint(1, 9)}.example.com",
            ".".join(str(rnd.randint(0, 255)) for _ in range(4)),
            " ".join(card[at : at + 4] for at in range(0, 16, 4)),
            f"+1 ({rnd.randint(100, 999)}) 555-{rnd.randint(1000, 9999)}",
        ]
    )


def text_with(rnd, parts, size=120):
    words = ["the", "of", "on", "report", "Wagen", "était", "12", "2024-01-05", "98079157628", "$5", "v1.2", "=", "\n", "end."]
    found = [rnd.choice(words) for _ in range(size)]
    for part in parts:
        found.insert(rnd.randint(0, len(found)), f"call {part} now")  # numbers do not run into it
    return " ".join(found)


@pytest.fixture(scope="module")
def weights():
    rnd = random.Random(1)
    windows = {w for n in range(900) for w in pii.sample_windows(text_with(rnd, [private(rnd) for _ in range(n % 3)]))}
    chosen = sorted(windows, key=lambda w: (w[0], w[1]))
    kinds = {k: [w for w in chosen if w[0] == k][:150] for k in (-1, 0, 1, 2, 3)}
    return pii.fitted([(text, list(spans)) for own in kinds.values() for _, _, text, spans in own])


def test_held_out_windows(weights):
    rnd = random.Random(2)
    windows = [w for n in range(300) for w in pii.sample_windows(text_with(rnd, [private(rnd) for _ in range(n % 3)]))]
    for shaped in ([(t, list(s)) for _, _, t, s in windows], [pii.rewritten(t, list(s), rnd) for _, _, t, s in windows if s]):
        rows, labels = (np.stack(x) for x in zip(*(pii.labelled(t, s) for t, s in shaped)))
        lengths = np.array([min(len(t), pii.WIDTH) for t, _ in shaped])
        found, gold = set(tagger.runs(tagger.decode(weights, rows, lengths))), set(tagger.runs(labels))
        both = len(found & gold)
        assert both / len(found) > 0.9 and both / len(gold) > 0.9


def one_by_one(text, weights):
    """All spans of a text, its windows decoded one after another over the whole text."""
    pieces, base = [], by_definition(text)
    for start in range(0, max(1, len(text) - pii.WIDTH + pii.STRIDE), pii.STRIDE):
        part = text[start : start + pii.WIDTH]
        if re.search("[0-9@]", part):
            row = pii.classes(part)[None]
            for _, kind, low, high in tagger.runs(tagger.decode(weights, row, np.array([len(part)]))):
                pieces.append((start + low, kind, start + high))
    return pii.reconciled(text, pieces, base) if pieces else base


def listed(spans):
    return [(s["start"], pii.KINDS.index(s["kind"]), s["end"]) for s in spans]


def test_spans_equal_one_by_one(spark, monkeypatch, weights):
    monkeypatch.setattr(pii, "WINDOWS_AT_ONCE", 5)
    rnd = random.Random(4)
    rows = []
    for n in range(60):
        parts = [private(rnd) for _ in range(n % 4)]
        spans = [pii.base_spans(p) for p in parts]
        parts += [pii.variant(s[0][1], p, rnd) for p, s in zip(parts, spans) if s]
        rows.append((n, text_with(rnd, parts, rnd.randint(0, 300)), "en", "s"))
    added = 0
    found = pii.personal_data(documents(spark, rows), weights)
    found = found.select("*", pii.written_out(found["spans"]).alias("text"), *(c.alias(f"n_{k}") for k, c in pii.counts(found["base"]).items()))
    for row in found.collect():
        text = rows[row["doc_id"]][1]
        assert row["text"] == ",".join(f"{s['kind']}:{s['start']}:{s['end']}" for s in row["spans"])
        assert [row[f"n_{k}"] for k in pii.KINDS] == [sum(s["kind"] == k for s in row["base"]) for k in pii.KINDS]
        assert listed(row["base"]) == by_definition(text)
        assert listed(row["spans"]) == one_by_one(text, weights)
        assert set(row["base"]) <= set(row["spans"])
        added += len(row["spans"]) - len(row["base"])
    assert added > 30


def test_clean_text_is_left_alone(spark, weights):
    rnd = random.Random(6)
    rows = [(n, text_with(rnd, []), "en", "s") for n in range(200)]
    assert all(r["spans"] == r["base"] for r in pii.personal_data(documents(spark, rows), weights).collect())


@pytest.mark.parametrize(
    "kind, yes, no",
    [
        ("email", ["a@b.de", "a (at) b.example.com", "a [@] b.de"], ["a at b.de", "a@b", "x a@b.de"]),
        ("ip", ["1.2.3.4", "1[.]2[.]3[.]4", "1 . 2 . 3 . 255"], ["1.2.3", "1.2.3.256", "1.2.3.4.5"]),
        ("card", ["4111.1111.1111.1111", "4111/1111/1111/1111", "4111 - 1111 - 1111 - 1111"], ["4111.1111.1111.1112", "4111x1111x1111x1111"]),
        ("phone", ["001 (017) 555-7713", "(017) 555-7713", "017/555/7713"], ["98079157628", "5551234", "2024-01-05"]),
    ],
)
def test_proper(kind, yes, no):
    place = pii.KINDS.index(kind)
    assert [pii.proper(place, t) for t in yes] == [True] * len(yes)
    assert [pii.proper(place, t) for t in no] == [False] * len(no)


def test_long_pieces_are_joined():
    text = "x " * 20 + "a" * 300 + "@b.example.com end"
    base = pii.base_spans(text)
    pieces = [(40, 0, 136), (88, 0, 184), (184, 0, 354)]
    assert pii.reconciled(text, pieces, []) == base == pii.reconciled(text, pieces, base)
    assert pii.reconciled("4111.1111.1111.1111", [(0, 2, 19), (0, 1, 14)], []) == [(0, 2, 19)]


def test_sample_is_bounded_and_distinct(spark):
    rnd = random.Random(8)
    rows = [(n, text_with(rnd, [private(rnd) for _ in range(2)]), "en", "s") for n in range(100)]
    docs = documents(spark, rows + rows)
    chosen = [sorted(map(repr, pii.sample(docs.repartition(n), 7).collect())) for n in (1, 6)]
    assert chosen[0] == chosen[1] and len(chosen[0]) == len(set(chosen[0])) == 35


def test_awkward_rows(spark, weights):
    rows = [*DOCUMENTS, (20, "a@b.example.com " * 20_000, "en", "s"), (21, "\U0001f600 é a1@b.example.com", "en", "s"), (22, "7" * 50_000, "en", "s")]
    for model in (weights, pii.train(documents(spark, DOCUMENTS))):
        found = pii.personal_data(documents(spark, rows), model).collect()
        assert sorted(map(repr, ((r["doc_id"], listed(r["base"])) for r in found))) == sorted(repr((r[0], by_definition(r[1] or ""))) for r in rows)
    assert pii.train(documents(spark, DOCUMENTS)) is None


def test_empty_table(spark):
    docs = documents(spark, [])
    assert pii.train(docs) is None and pii.personal_data(docs, None).collect() == []


def every_window(text, weights):
    """All spans of a text, each of its windows decoded whatever it holds."""
    pieces = []
    for start in range(0, max(1, len(text) - pii.WIDTH + pii.STRIDE) if text else 0, pii.STRIDE):
        part = text[start : start + pii.WIDTH]
        for _, kind, low, high in tagger.runs(tagger.decode(weights, pii.classes(part)[None], np.array([len(part)]))):
            pieces.append((start + low, kind, start + high))
    return pii.reconciled(text, pieces, pii.base_spans(text))


def test_spans_equal_those_of_every_window(spark, monkeypatch, weights):
    monkeypatch.setattr(pii, "WINDOWS_AT_ONCE", 5)
    rnd = random.Random(11)
    words = ["the", "of", "on", "report", "Wagen", "était", "end."]
    marks = ["(at)", " [at] ", " (at) ", "[at]", "@", " @ "]
    rows = []
    for n in range(120):
        found = [rnd.choice(words) for _ in range(rnd.randint(0, 120))]
        name = lambda: "".join(rnd.choice("abcdefgh.") for _ in range(rnd.randint(3, 60))).strip(".")
        for _ in range(n % 4):
            host = ".".join("".join(rnd.choice("klmn") for _ in range(rnd.randint(2, 40))) for _ in range(rnd.randint(2, 5)))
            found.insert(rnd.randint(0, len(found)), f"call x{name()}{rnd.choice(marks)}{host} now")
        rows.append((n, " ".join(found), "en", "s"))
    bare = 0
    for row in pii.personal_data(documents(spark, rows), weights).collect():
        text = rows[row["doc_id"]][1]
        assert listed(row["spans"]) == every_window(text, weights)
        bare += sum("at" in text[s:e] and not re.search("[0-9@]", text[max(0, s - 48) : e + 48]) for s, _, e in listed(row["spans"]))
    assert bare > 0  # no digit and no @ anywhere near
