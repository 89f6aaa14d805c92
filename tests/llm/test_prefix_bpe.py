import hashlib
import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from cases import DOCUMENTS, LONG, documents
from hypothesis import given, settings, strategies as st

from logloom.llm import prefix_bpe as bpe

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def codec():
    return bpe.Codec(PATH, public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def library(codec):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=codec.vocabulary.ranks, special_tokens={})


def ids(codec, text):
    return np.frombuffer(codec.encode([text])[0], "<u4").tolist()


@settings(max_examples=300, deadline=None)
@given(text=st.one_of(st.text(max_size=60), st.text("ab st\n'ré0!", max_size=80)))
def test_any_text_as_the_library(codec, library, text):
    assert ids(codec, text) == library.encode_ordinary(text)
    assert codec.decode(codec.encode([text])[0]) == text.encode()


def test_long_runs(codec, library):
    for text in ("a" * 20_000, " " * 5000, "the" * 3000, "\n" * 3000 + "x", LONG):
        assert ids(codec, text) == library.encode_ordinary(text)


def glued(codec, count, seed):
    chosen = random.Random(seed).choices(sorted(codec.vocabulary.ranks), k=count)
    return b"".join(chosen)


@pytest.mark.parametrize("seed", range(60))
def test_appends_and_edits_equal_a_fresh_table(codec, seed):
    rnd = random.Random(seed)
    piece, more = glued(codec, 30, seed), glued(codec, 3, seed + 1000)
    grown = bpe.Prefixes(codec.vocabulary, piece)
    grown.append(more)
    assert grown.last == bpe.Prefixes(codec.vocabulary, piece + more).last
    start = rnd.randint(0, len(piece))
    end = min(len(piece), start + rnd.randint(0, 6))
    edit = bpe.Prefixes(codec.vocabulary, piece)
    computed = edit.replace(start, end, more)
    want = piece[:start] + more + piece[end:]
    assert bytes(edit.piece) == want and edit.last == bpe.Prefixes(codec.vocabulary, want).last
    assert computed <= len(more) + len(piece) - end


def test_an_edit_stays_near(codec):
    piece = glued(codec, 3000, 5)
    edit = bpe.Prefixes(codec.vocabulary, piece)
    assert edit.replace(10, 12, b"xyz") < 400
    assert b"".join(edit.tokens()) == bytes(edit.piece)


def test_every_prefix_has_the_encoding_of_itself(codec):
    piece = glued(codec, 12, 3)
    table = bpe.Prefixes(codec.vocabulary, piece)
    for end in range(1, len(piece) + 1):
        want = bpe.merged(piece[:end], codec.vocabulary.ranks)
        assert table.tokens(end) == want


def test_documents(spark, library):
    found = bpe.encode_documents(documents(spark), PATH, public_tokenizers.PATTERN).collect()
    want = [(doc_id, library.encode_ordinary(text or "")) for doc_id, text, *_ in DOCUMENTS]
    assert sorted(map(repr, ((r["doc_id"], np.frombuffer(r["ids"], "<u4").tolist()) for r in found))) == sorted(map(repr, want))
    digests = bpe.encode_documents(documents(spark), PATH, public_tokenizers.PATTERN, digests=True).collect()
    for row in digests:
        texts = [text or "" for doc_id, text, *_ in DOCUMENTS if doc_id == row["doc_id"]]
        assert row["decoded_sha256"] in [hashlib.sha256(t.encode()).hexdigest() for t in texts]
        assert row["ids_sha256"] in [hashlib.sha256(np.array(library.encode_ordinary(t), "<u4").tobytes()).hexdigest() for t in texts]


def test_empty_table(spark):
    assert bpe.encode_documents(documents(spark, []), PATH, public_tokenizers.PATTERN).collect() == []


class Docs:
    """Gives the function that a query would run over batches."""

    def select(self, *columns):
        return self

    def mapInArrow(self, run, schema):
        return run


def test_few_characters_are_split_together(spark, monkeypatch):
    """A batch of many texts does not become piece objects all at once."""
    own, most = bpe.codec(PATH, public_tokenizers.PATTERN), []
    monkeypatch.setattr(own.cache, "texts", lambda texts: most.append(sum(map(len, texts))) or [b""] * len(texts))
    batch = pa.RecordBatch.from_pydict({"doc_id": pa.array(range(400), pa.int64()), "text": ["some words " * 1000] * 400})
    run = bpe.encode_documents(Docs(), PATH, public_tokenizers.PATTERN)
    assert sum(len(b) for b in run(iter([batch]))) == 400
    assert max(most) <= 1 << 19


def test_a_walk_ends_where_no_token_goes_on():
    ranks = {bytes([n]): n for n in range(256)}
    for n in range(2, 60):
        ranks[b"a" * n] = 254 + n  # long tokens that begin like the piece
    vocabulary = bpe.Vocabulary(ranks)
    asked = []

    class Asked(dict):
        def get(self, token, default=None):
            asked.append(token)
            return super().get(token, default)

    vocabulary.made = Asked(vocabulary.made)
    vocabulary.begun = Asked(getattr(vocabulary, "begun", {}))
    piece = b"aaab" * 40
    assert b"".join(vocabulary.bytes_of[n] for n in bpe.encode_piece(vocabulary, piece)) == piece
    assert len(asked) <= 4 * len(piece)
