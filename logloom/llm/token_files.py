"""Operator 3: token ids as flat binary files with 64-bit document offsets.

``write_tokens`` lays the documents out in ascending doc_id order (null first, equal ids by content)
over range partitions. Each task writes one shard:

    ids-NNNNNN.bin      unsigned ids, 16 bits where the vocabulary allows, else 32, little-endian
    offsets-NNNNNN.bin  unsigned 64-bit: ids before each document in the whole set, then the shard's end
    docs-NNNNNN.bin     signed 64-bit doc_id of each document; the smallest number stands for null

and ``index.json`` names the shards in order with their documents and tokens. A shard learns its base
from the prefix sums of the shards' token counts; offsets are written when those are known. Readers map
the files into memory; ``TokenFile`` does so for single documents.

A null or empty text is the end id alone. Ids are those of the library without special tokens at the ends;
an added token's name inside a text becomes that token's id, as there.
Repeated rows are documents of their own. An empty table is an index without shards.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Callable, Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from logloom.llm.common import stored, worker_state
from logloom.llm.files import mapped, opened, written
from logloom.llm.pieces import ColumnPieces

END_ID = 2
NO_ID = -(1 << 63)
TEXTS_AT_ONCE = 8192
REMEMBERED = 250_000  # pieces of text
CHARS_AT_ONCE = 1 << 22
# The characters that byte-level tokenizers write bytes as.
_VISIBLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
BYTE_CHARS = {b: b for b in _VISIBLE} | {b: 256 + n for n, b in enumerate(b for b in range(256) if b not in _VISIBLE)}


def load_tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks already use every core
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def id_type(tokenizer, end_id: int) -> str:
    return "<u2" if max(tokenizer.get_vocab_size(with_added_tokens=True) - 1, end_id) < 1 << 16 else "<u4"


def is_byte_level(tokenizer) -> bool:
    """Whether the tokenizer splits text by the pattern and then merges bytes, and does nothing else."""
    said = json.loads(tokenizer.to_str())
    split = said["pre_tokenizer"] or {}
    plain = said["normalizer"] is None and split.get("type") == "ByteLevel" and split.get("use_regex", True)
    return plain and not split["add_prefix_space"] and said["model"]["type"] == "BPE"


def text_encoder(path: str, dtype: str) -> Callable[[list[str]], list[bytes]]:
    """What gives the ids of texts as bytes."""
    tokenizer = load_tokenizer(path)
    tokenize, size = tokenizer.model.tokenize, np.dtype(dtype).itemsize

    def pieces(found: list[str]) -> list[bytes]:
        """Words straight from the tokenizer's model; it makes no merges across them."""
        written = "\0".join(found).encode().decode("latin-1").translate(BYTE_CHARS).split(chr(BYTE_CHARS[0]))
        if len(written) != len(found):  # some have that byte themselves
            written = [piece.encode().decode("latin-1").translate(BYTE_CHARS) for piece in found]
        ids, ends = [], []
        for word in written:
            ids += [token.id for token in tokenize(word)]
            ends.append(len(ids) * size)
        data = np.array(ids, dtype).tobytes()
        return [data[start:end] for start, end in zip([0, *ends], ends)]

    def whole(texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, dtype).tobytes() for e in tokenizer.encode_batch(texts, add_special_tokens=False)]

    if not is_byte_level(tokenizer):
        return whole
    split = ColumnPieces(pieces, REMEMBERED).texts
    names = [token.content for token in tokenizer.get_added_tokens_decoder().values()]
    if not names:
        return split
    named = regex.compile("|".join(map(regex.escape, names)))

    def texts(given: list[str]) -> list[bytes]:
        """The library reads texts that may hold an added token; the others go by pieces."""
        library = [named.search(t) is not None for t in given]
        if not any(library):
            return split(given)
        by_pieces = iter(split([t for t, own in zip(given, library) if not own]))
        by_library = iter(whole([t for t, own in zip(given, library) if own]))
        return [next(by_library if own else by_pieces) for own in library]

    return texts


def groups(texts: list[str], most: int = CHARS_AT_ONCE) -> Iterator[list[str]]:
    """Texts in order, few at a time where they are long."""
    held, chars = [], 0
    for text in texts:
        if held and (len(held) >= TEXTS_AT_ONCE or chars + len(text) > most):
            yield held
            held, chars = [], 0
        held.append(text)
        chars += len(text)
    if held:
        yield held


def _name(folder: str, kind: str, shard: int) -> str:
    return f"{folder}/{kind}-{shard:06d}.bin"


def write_tokens(docs: DataFrame, folder: str, tokenizer_path: str, end_id: int = END_ID) -> dict:
    """Write ``docs`` (doc_id, text) below ``folder``; returns what index.json says."""
    spark = docs.sparkSession
    dtype = id_type(load_tokenizer(tokenizer_path), end_id)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoded = worker_state(("token-files", tokenizer_path, dtype), lambda: text_encoder(tokenizer_path, dtype))
        end = np.array([end_id], dtype).tobytes()
        shard, count, tokens = TaskContext.get().partitionId(), 0, 0
        first = next((b for b in batches if b.num_rows), None)
        if first is None:
            return
        with written(_name(folder, "ids", shard)) as ids, written(_name(folder, "docs", shard)) as names, written(
            _name(folder, "lengths", shard)
        ) as lengths:
            batch = first
            while batch is not None:
                doc_ids = batch.column("doc_id").fill_null(NO_ID).to_numpy().astype("<i8")
                names.write(doc_ids.tobytes())
                for texts in groups([t or "" for t in batch.column("text").to_pylist()]):
                    found = [one + end for one in encoded(texts)]
                    ids.write(b"".join(found))
                    sizes = np.fromiter(map(len, found), "<u8", len(found)) // np.dtype(dtype).itemsize
                    lengths.write(sizes.tobytes())
                    tokens += int(sizes.sum())
                count += len(doc_ids)
                batch = next(batches, None)
        yield pa.RecordBatch.from_pydict({"shard": [shard], "documents": [count], "tokens": [tokens]})

    def offsets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, base in zip(batch.column("shard").to_pylist(), batch.column("base").to_pylist()):
                sizes = mapped(_name(folder, "lengths", shard), "<u8")
                with written(_name(folder, "offsets", shard)) as out:
                    out.write(np.array([base], "<u8").tobytes())
                    out.write((np.cumsum(sizes, dtype="<u8") + np.uint64(base)).tobytes())
            yield batch

    ordered = (
        docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("_tie"))
        .repartitionByRange("doc_id", "_tie")
        .sortWithinPartitions("doc_id", "_tie")
    )
    made = stored(ordered.mapInArrow(encode, "shard long, documents long, tokens long"), "token-shards")
    shards = made.orderBy("shard").collect()  # one row per file
    bases = [0, *accumulate(s["tokens"] for s in shards)]
    listed = [s.asDict() | {"base": base} for s, base in zip(shards, bases)]
    if listed:
        rows = spark.createDataFrame([(s["shard"], s["base"]) for s in listed], "shard long, base long")
        rows = rows.repartition(len(listed), "shard") if len(listed) > 1 else rows
        rows.mapInArrow(offsets, "shard long, base long").count()
    index = {"dtype": dtype, "end_id": end_id, "tokens": bases[-1], "shards": listed}
    with written(f"{folder}/index.json") as out:
        out.write(json.dumps(index).encode())
    return index


def read_index(folder: str) -> dict:
    with opened(f"{folder}/index.json") as file:
        return json.loads(file.read())


class TokenFile:
    """Documents of one shard, from memory-mapped files."""

    def __init__(self, folder: str, shard: int, dtype: str):
        self.ids = mapped(_name(folder, "ids", shard), dtype)
        self.offsets = mapped(_name(folder, "offsets", shard), "<u8")
        self.docs = mapped(_name(folder, "docs", shard), "<i8")

    def __len__(self) -> int:
        return len(self.docs)

    def __getitem__(self, n: int) -> np.ndarray:
        start, end = (int(x - self.offsets[0]) for x in self.offsets[n : n + 2])
        return self.ids[start:end]


def read_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start, n_tokens and the crc32 of each document's ids, from the files."""
    index = read_index(folder)
    dtype = index["dtype"]
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"
    kinds = pa.schema([(c.split()[0], pa.int64()) for c in schema.split(", ")])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard in batch.column("shard").to_pylist():
                file = TokenFile(folder, shard, dtype)
                for at in range(0, len(file), 50_000):
                    docs = np.asarray(file.docs[at : at + 50_000])
                    starts = np.asarray(file.offsets[at : at + len(docs) + 1]).astype("i8")
                    sums = [zlib.crc32(file[at + n].astype("<u4").tobytes()) for n in range(len(docs))]
                    columns = [pa.array(docs, mask=docs == NO_ID), pa.array(starts[:-1]), pa.array(np.diff(starts)), pa.array(sums, pa.int64())]
                    yield pa.RecordBatch.from_arrays(columns, schema=kinds)

    shards = [(s["shard"],) for s in index["shards"]]
    if not shards:
        return spark.createDataFrame([], schema)
    rows = spark.createDataFrame(shards, "shard long")
    rows = rows.repartition(len(shards), "shard") if len(shards) > 1 else rows
    return rows.mapInArrow(read, schema)
