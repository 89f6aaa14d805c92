import zlib

import numpy as np
import public_tokenizers
import pytest
from cases import DOCUMENTS, documents

from logloom.llm import token_files as tf
from logloom.session import scratch_path

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def tokenizer():
    return tf.load_tokenizer(PATH)


def expected(tokenizer, text):
    return [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]


def test_files_hold_every_document_in_order(spark, tokenizer):
    folder = scratch_path(spark, "tokens-test")
    index = tf.write_tokens(documents(spark), folder, PATH)
    rows = tf.read_tokens(spark, folder).orderBy("start").collect()
    assert len(rows) == len(DOCUMENTS) and index["dtype"] == "<u2"
    ids = [r["doc_id"] for r in rows]
    assert ids == sorted(ids, key=lambda x: (x is not None, x))
    start = 0
    texts: dict = {}
    for doc_id, text, *_ in DOCUMENTS:
        want = np.array(expected(tokenizer, text), "<u4")
        texts.setdefault(doc_id, []).append((len(want), zlib.crc32(want.tobytes())))
    for row in rows:
        assert row["start"] == start
        start += row["n_tokens"]
        texts[row["doc_id"]].remove((row["n_tokens"], row["ids_crc32"]))
    assert start == index["tokens"] and not any(texts.values())


def test_documents_by_number(spark, tokenizer):
    folder = scratch_path(spark, "tokens-test")
    rows = [(n, f"text {n} " * n, "en", "a") for n in range(40)]
    index = tf.write_tokens(documents(spark, rows), folder, PATH, end_id=70_000)
    assert index["dtype"] == "<u4"
    for shard in index["shards"]:
        file = tf.TokenFile(folder, shard["shard"], index["dtype"])
        assert len(file) == shard["documents"] and int(file.offsets[0]) == shard["base"]
        for n, doc_id in enumerate(file.docs.tolist()):
            assert file[n].tolist() == expected(tokenizer, rows[doc_id][1])[:-1] + [70_000]


def test_empty_table(spark):
    folder = scratch_path(spark, "tokens-test")
    assert tf.write_tokens(documents(spark, []), folder, PATH)["shards"] == []
    assert tf.read_tokens(spark, folder).collect() == []


@pytest.mark.parametrize("dtype", ["<u2", "<u4"])
def test_parts_encode_as_the_whole(tokenizer, dtype):
    texts = ["", " ", "1b x", "1b", "b1 c", "'sa", " B", "a b  c", "a\n b", "a\n \nb", "a \nb ", " lead", "x\tb c", "it's we'll", "a\x00b c\x00", "<|endoftext|> x", "ü ß é", "  ", "\n", "a \n\nb", "1 2 345", "x y" * 3]
    found = tf.text_encoder(PATH, dtype)(texts + texts)
    assert [np.frombuffer(f, dtype).tolist() for f in found] == [expected(tokenizer, t)[:-1] for t in texts + texts]


def test_other_tokenizers_encode_whole_texts():
    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer = tf.load_tokenizer(path)
    texts = ["Hello there  World", "", "a b"]
    found = tf.text_encoder(path, "<u2")(texts)
    assert [np.frombuffer(f, "<u2").tolist() for f in found] == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def test_added_tokens_are_read_as_the_library_does(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(PATH)
    texts = ["a <|endoftext|> b", "<|endoftext|>", "no marker", "<|endoftext|><|endoftext|>x", "<|endoftext", "<|ENDOFTEXT|>", "", "last"]
    want = [library.encode(t, add_special_tokens=False).ids for t in texts]
    found = tf.text_encoder(PATH, "<u2")(texts)
    assert [np.frombuffer(f, "<u2").tolist() for f in found] == want and want[0] == [64, 220, 50256, 275]
    folder = scratch_path(spark, "tokens-test")
    tf.write_tokens(documents(spark, [(n, t, "en", "a") for n, t in enumerate(texts)]), folder, PATH)
    assert [r["n_tokens"] for r in tf.read_tokens(spark, folder).orderBy("doc_id").collect()] == [len(ids) + 1 for ids in want]
