"""The stages one after the other, against brute force over each stage's own input."""

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from test_line_templates import brute_force as lines_left
from test_minhash import brute_force as groups

import corpus_pipeline
from logloom.llm import language, line_templates, minhash, mixing, prefix_bpe
from logloom.llm.common import stored

WORDS = {"en": "the and of with that which for house tree road lamp sea", "fr": "le la les et dans pour avec maison arbre route mer lampe"}


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = np.random.default_rng(8)
    rows = []
    for n in range(240):
        lang = "fr" if n % 4 == 0 else "en"
        text = "\n".join(" ".join(rng.choice(WORDS[lang].split(), 30)) + "." for _ in range(3))
        if n % 3 == 0:
            text += f"\nPage {n} of the annual report by the lamp company"
        if n % 10 == 9:
            text = rows[-1][1] + " sea"
        rows.append((n, None if n == 50 else "123 456" if n == 51 else text, lang if n % 2 else None, f"s{n % 3}"))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    path = tmp_path_factory.mktemp("pipeline")
    docs.withColumn("n_chars", F.length("text").cast("long")).write.parquet(f"{path}/documents.parquet")
    return str(path)


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    found = {}
    for name, stage in corpus_pipeline.STAGES:
        found[name] = docs, stored(stage(spark, docs, folder), "stage-test")
        docs = found[name][1]
        assert name == corpus_pipeline.STAGES[-1][0] or docs.columns == columns

    before, after = found["language_id"]
    want = [r for r in before.collect() if language.has_letter(r["text"])]
    assert sorted(after.collect()) == sorted(want) and len(want) == 238

    before, after = found["line_dedup"]
    rows = [(r["doc_id"], r["text"]) for r in before.collect()]
    owner = {d: c for d, _, c, _ in groups(rows, corpus_pipeline.NEAR)}
    assert sorted((r["doc_id"], r["text"]) for r in after.collect()) == sorted(lines_left(rows, corpus_pipeline.LINES, lambda d, _: owner[d]))
    assert all(r["n_chars"] == len(r["text"]) for r in after.collect())
    assert sum("annual report" in r["text"] for r in after.collect()) < 5

    before, after = found["near_dedup"]
    rows = [(r["doc_id"], r["text"]) for r in before.collect()]
    want = {d for d, _, _, kept in groups(rows, minhash.Options(shingle_words=5)) if kept}
    assert {r["doc_id"] for r in after.collect()} == want and len(want) < len(rows)

    before, after = found["source_mixing"]
    repeats = {r["doc_id"]: r["repeats"] for r in mixing.mix_sources(before).collect()}
    got = [r["doc_id"] for r in after.collect()]
    assert {d: got.count(d) for d in repeats} == repeats and set(got) <= set(repeats)

    before, after = found["bpe_encoding"]
    ranks = prefix_bpe.load_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = sorted((r["doc_id"], library.encode_ordinary(r["text"])) for r in before.collect())
    assert sorted((r["doc_id"], np.frombuffer(r["ids"], "<u4").tolist()) for r in after.collect()) == want
    assert sorted((r["doc_id"], r["n_tokens"]) for r in corpus_pipeline.run(spark, folder).collect()) == [(d, len(i)) for d, i in want]


def test_copies_leave_one_document_and_no_stub(spark, folder):
    rng = np.random.default_rng(3)
    words = lambda n: " ".join(rng.choice(WORDS["en"].split(), n))
    body, passage = f"{words(120)}\n{words(70)}\n{words(9)}", words(60)
    rows = [(n, body, "en", "s") for n in (1, 2, 3)] + [(4, body + " lamp", "en", "s"), (5, f"{words(80)}\n{passage}", "en", "s"), (6, f"{passage}\n{words(80)}", "en", "s")]
    docs = spark.createDataFrame([(*r, f"own {r[0]}", "x", "y") for r in rows], "doc_id long, text string, lang string, source string, n_lines string, n_dropped string, document string")
    lines = corpus_pipeline.line_dedup(spark, docs, folder)
    assert lines.columns == docs.columns and {r["n_lines"] for r in lines.collect()} == {f"own {n}" for n in range(1, 7)}
    kept = {r["doc_id"]: r["text"] for r in corpus_pipeline.near_dedup(spark, stored(lines, "stub-test"), folder).collect()}
    assert kept.keys() == {1, 5, 6} and kept[1] == body and passage in kept[5] and passage not in kept[6]


def test_empty_table(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet").where("false")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
