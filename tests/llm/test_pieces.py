import numpy as np
import regex
from hypothesis import given, settings, strategies as st

from logloom.llm import pieces as pc

SPLIT = regex.compile(pc.PATTERN)
PARTS = [" ", "  ", "\n", "\r\n", "\t", "a", "s", "t", "l", "r", "e", "é", "1", "½", "²", "'", "'s", "'ll", "'re", ".", "$$", "_", "\x00", "\x1c", "\x85", "\xa0", "　", "İ", "か", "😀"]
TEXTS = st.lists(st.lists(st.sampled_from(PARTS), max_size=12).map("".join) | st.text(max_size=12), max_size=6)


def encode(found):
    return [f"<{piece}>".encode() for piece in found]


def want(texts):
    return [b"".join(encode(SPLIT.findall(text))) for text in texts]


@settings(max_examples=400, deadline=None)
@given(TEXTS)
def test_columns_split_as_the_pattern_does(texts):
    assert pc.ColumnPieces(encode, 1000).texts(texts) == want(texts)


def test_long_texts_and_forgotten_pieces(monkeypatch):
    monkeypatch.setattr(pc, "SLICE", 50)
    rng = np.random.default_rng(4)
    cache, asked = pc.ColumnPieces(lambda found: asked.extend(found) or encode(found), 20), []
    for _ in range(30):
        texts = ["".join(rng.choice(PARTS, n)) for n in rng.integers(0, 200, 5)] + ["", "x" * 300]
        assert cache.texts(texts) == want(texts)
        assert len(cache.new) <= 20 + len(set(PARTS)) * 60
    assert len(asked) > len(set(asked))  # some were forgotten


def test_no_texts():
    assert pc.ColumnPieces(encode, 10).texts([]) == [] and pc.ColumnPieces(encode, 10).texts(["", ""]) == [b"", b""]
