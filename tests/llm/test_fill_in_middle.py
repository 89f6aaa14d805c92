import hashlib
import random
import re

import numpy as np
import pytest
from cases import DOCUMENTS, LONG, documents

from logloom.llm import fill_in_middle as fm, wavelet as wv

UNITS = {"line": r"[^\n]*\n|[^\n]+", "sentence": r"[^\n.!?]*[\n.!?]|[^\n.!?]+", "word": r"[^\n \t]*[\n \t]|[^\n \t]+"}


def brute_force(doc_id, text, options=fm.Options()):
    text = text or ""
    units = re.findall(UNITS[options.unit], text)
    drawn = hashlib.sha256(f"{options.salt}{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(drawn[at : at + 8], 16) for at in range(0, 32, 8))
    one, two = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    prefix, middle, suffix = "".join(units[:one]), "".join(units[one:two]), "".join(units[two:])
    if not text or any(mark in text for mark in ("<P>", "<S>", "<M>")) or h3 % 100 >= options.percent:
        return doc_id, len(units), "plain", None, None, text, text
    spm = h4 % 100 < options.spm_percent
    output = f"<S>{suffix}<P>{prefix}<M>{middle}" if spm else f"<P>{prefix}<S>{suffix}<M>{middle}"
    return doc_id, len(units), "spm" if spm else "psm", len(prefix), len(middle), output, text


def result(docs, options=fm.Options()):
    rows = fm.fill_in_middle(docs, options)
    found = rows.withColumn("restored", fm.restored(rows["output"], rows["form"])).collect()
    return sorted(map(repr, map(tuple, found)))


def expected(rows, options=fm.Options()):
    return sorted(repr(brute_force(row[0], row[1], options)) for row in rows)


def texts(seed):
    rnd = random.Random(seed)
    pieces = ["\n", "\n\n", " ", "\t", ".", "a", "word", "é", "日本", "\U0001f600", "<", "<P", "S>", "\x00", "\r", "!?"]
    found = ["".join(rnd.choice(pieces) for _ in range(rnd.randint(0, 60))) for _ in range(200)]
    return [(n, t, "en", "s") for n, t in enumerate([*found, "<P>", "x<M>y", "a<S>", "\n", "no end"])]


@pytest.mark.parametrize("unit", ["line", "sentence", "word"])
@pytest.mark.parametrize("together", [1, 500, 1 << 22])
def test_equals_brute_force(spark, monkeypatch, unit, together):
    monkeypatch.setattr(fm, "TOGETHER", together)
    rows, options = texts(together), fm.Options(unit=unit)
    assert result(documents(spark, rows), options) == expected(rows, options)


def test_shares_of_forms(spark):
    rows = [(n, f"one {n}\ntwo\nthree\n", "en", "s") for n in range(400)]
    options = fm.Options(percent=50, spm_percent=20, salt="other:")
    assert result(documents(spark, rows), options) == expected(rows, options)
    forms = [r["form"] for r in fm.fill_in_middle(documents(spark, rows), options).collect()]
    assert 150 < forms.count("plain") < 250 and 20 < forms.count("spm") < 70


def test_awkward_rows(spark):
    assert result(documents(spark)) == expected(DOCUMENTS)
    many = [(1, LONG + "\n" + LONG, "en", "s"), (2, "\n" * 100_000, "en", "s"), (3, "x" * 300_000, "en", "s")]
    assert result(documents(spark, many)) == expected(many)


def test_empty_table(spark):
    assert fm.fill_in_middle(documents(spark, [])).collect() == []


@pytest.mark.parametrize("size", [0, 1, 7, 8, 511, 512, 513, 5000])
def test_rank_and_select(size):
    rng = np.random.default_rng(size)
    data = rng.choice(np.frombuffer(b"ab \n\t.!\xc3\xa9\xe6", np.uint8), size)
    matrix = wv.WaveletMatrix(data)
    kinds = wv.BYTE_CLASSES[data]
    places = np.arange(size + 1)
    for chosen in [(0,), (1,), (2,), (3,), (4,), (1, 3), (0, 2, 4)]:
        member = np.isin(kinds, chosen)
        counts = np.concatenate([[0], np.cumsum(member)])
        assert matrix.rank(chosen, places).tolist() == counts.tolist()
        nth = np.arange(1, counts[-1] + 1)
        assert matrix.select(chosen, nth).tolist() == (np.flatnonzero(member) + 1).tolist()
