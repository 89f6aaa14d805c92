import math
import unicodedata
from collections import Counter

import numpy as np
import pytest
from cases import documents

import corpus_pipeline
from logloom.llm import language

WORDS = {"en": "the and of with that which for house", "fr": "le la les et dans pour avec maison", "de": "der die das und mit nicht haus für", "es": "el los las y con para que casa"}


def labelled(n=400):
    rng = np.random.default_rng(3)
    rows = []
    for doc in range(n):
        lang = list(WORDS)[doc % len(WORDS)]
        rows.append((doc, " ".join(rng.choice(WORDS[lang].split(), 12)), lang, "s"))
    return rows


@pytest.fixture(scope="module")
def model(spark):
    docs = documents(spark, labelled())
    return language.train(docs.where(language.learnable(docs["doc_id"])))


def test_held_out_accuracy(spark, model):
    docs = documents(spark, labelled())
    held = docs.where(~language.learnable(docs["doc_id"]))
    found = {r["doc_id"]: r for r in language.identify(held, model).collect()}
    truth = {r["doc_id"]: r["lang"] for r in held.collect()}
    assert len(found) == len(truth) > 80
    assert np.mean([found[d]["lang_pred"] == truth[d] for d in truth]) >= 0.98
    assert all(0.5 <= r["score"] <= 1 for r in found.values())


def test_awkward_rows(spark, model):
    rows = language.identify(documents(spark), model).collect()
    assert len(rows) == documents(spark).count()
    for row in rows:
        if row["doc_id"] in (2, 3, 4, 7):
            assert (row["lang_pred"], row["score"]) == ("und", 0.0)
    assert {r["lang_pred"] for r in rows if r["doc_id"] == 8} == {"en"}
    docs = documents(spark)
    kept = language.understood(docs, model)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {1, 5, 6, 8, None, 9}


def plain_prediction(model, text):
    """Counting, classifying and decoding by the definition, in plain Python."""
    if not any(unicodedata.category(c).startswith("L") for c in text or ""):
        return "und", 0.0
    data = bytes(c if c >= 128 or chr(c).isalpha() else 32 for c in text.lower().encode())
    data = b" " + b" ".join(data.split()) + b" "
    counts = Counter()
    for size in language.SIZES:
        for at in range(len(data) - size + 1):
            mixed = size
            for byte in data[at : at + size]:
                mixed = (mixed ^ byte) * 0x9E3779B1 % 2**32
                mixed ^= mixed >> 15
            counts[mixed % language.BUCKETS] += 1
    total = sum(counts.values())
    distances = []
    for word, trust in zip(model.code.tolist(), model.trust.tolist()):
        loss = 0.0
        for bit, side in enumerate(word):
            margin = sum(n * float(model.weights[bucket, bit]) for bucket, n in counts.items()) / total
            loss += trust[bit] * math.log1p(math.exp(-4 * side * margin * float(model.scale[bit])))
        distances.append(loss)
    first, second = sorted(distances)[:2]
    return model.languages[distances.index(first)], second / (first + second) if second else 0.5


def test_predictions_equal_plain_decoding(spark, model):
    rng = np.random.default_rng(5)
    every = " ".join(WORDS.values()).split()
    texts = [" ".join(rng.choice(every, n % 9)) + ["", " 12", "²", "É!", "日本"][n % 5] for n in range(60)]
    texts += ["²", "½ ①", "x²", "12 ³", "ª", "Ⅷ", "ʰ", "_", "é"]
    docs = documents(spark, [(n, t, None, "s") for n, t in enumerate(texts)])
    for row in language.identify(docs, model).collect():
        lang, score = plain_prediction(model, texts[row["doc_id"]])
        assert (row["lang_pred"], row["ambiguous"]) == (lang, row["score"] < language.AMBIGUOUS), texts[row["doc_id"]]
        assert abs(row["score"] - score) < 1e-5
    assert [language.has_letter(t) for t in texts[-9:]] == [False, False, True, False, True, False, True, False, True]


def test_mixed_text_is_ambiguous(model):
    lang, score = model.predict("the and of with " * 10 + "le la les et " * 11)
    assert lang in ("en", "fr") and score < model.predict("the and of with " * 10)[1]


def test_long_texts_count_whole(model, monkeypatch):
    text = "the house " * 3000
    whole = language.ngram_counts(text)
    monkeypatch.setattr(language, "CHUNK", 777)
    assert (language.ngram_counts(text) == whole).all()
    assert model.predict("le la les " * 20 + text)[0] == "en"


@pytest.mark.parametrize("languages", [2, 3, 4, 7, 12, 60])
def test_codewords_differ(languages):
    code = language.codewords(languages)
    apart = [(a != b).sum() for n, a in enumerate(code) for b in code[:n]]
    assert min(apart) >= (1 if languages == 2 else 2)
    assert (abs(code.sum(0)) < languages).all()
    assert languages == 2 or len({tuple(c * c[0]) for c in code.T}) == code.shape[1]  # no bit is another's or its opposite


def test_few_labels(spark):
    nothing = language.train(documents(spark, []))
    assert nothing.predict("any words") == ("und", 0.0)
    assert language.identify(documents(spark, []), nothing).collect() == []
    one = language.train(documents(spark, [(1, "some words", "en", "a")]))
    assert one.predict("other words") == ("en", 1.0)


def test_the_sample_is_bounded(spark):
    assert language.labelled_sample(documents(spark, labelled()), 10).count() <= 80


def test_unlearned_and_ambiguous_texts_are_rejected(spark):
    english, mixed = "the house of that and which for the house", "the and of with " * 10 + "le la les et avec dans " * 9
    texts = ["это обычный русский текст о жизни в городе", "这是一个关于城市生活的普通中文文本", "xqzv wkjh qpwz zzkx vbnm qwrt plkj", mixed, english, "house", "12 34", None]
    rows = [*labelled(), *((1000 + n, text, None, "s") for n, text in enumerate(texts))]
    docs = documents(spark, rows).select("doc_id", "text", "lang", "source")
    kept = {r["doc_id"] for r in corpus_pipeline.language_id(spark, docs, "").collect()}
    assert kept == {*range(400), 1004, 1005}


def test_without_labels_every_text_with_a_letter_stays(spark):
    docs = documents(spark, [(1, "some words", None, "a"), (2, "12", None, "a"), (3, None, None, "a")])
    assert [r["doc_id"] for r in corpus_pipeline.language_id(spark, docs, "").collect()] == [1]
