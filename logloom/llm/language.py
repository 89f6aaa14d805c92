"""Operator 2: language identification by error-correcting output codes.

Every language has a codeword of +1 and -1. For each bit a binary classifier over hashed byte n-grams
tells the languages with +1 from those with -1: the log odds of an n-gram are weighed by how often the
text has it, as in naive Bayes, with every language counting alike. Decoding sums a loss over the bits
for each codeword, weighted by how well each bit's classifier knows that language, and takes the nearest
codeword; ``ambiguous`` marks texts whose two nearest codewords are almost as near.

The score is the second distance's part of the two smallest distances, from 0.5 for a tie to 1; ties
go to the language that comes first by code points. A text that is null or has no letter is ``und``
with score 0. A single learned language is always chosen, with score 1; without labelled rows every
text is ``und``. Whole texts count, of any length.

``train(docs, limits=True)`` also measures how far the learned rows, and their beginnings, lie from their own
codewords. ``understood`` then rejects a text whose nearest codeword is farther than the limit of its language
and length, or that is ambiguous. Texts with fewer than ``LENGTHS[0]`` bytes of letters are too short to tell and
stay, and so does every text with a letter if there are fewer than two languages to tell apart.

Classifiers learn from at most about ``documents_per_language`` labelled rows of each language, picked
by a hash of doc_id, so reruns agree. More than ``MAX_LANGUAGES`` labels are refused. Extra columns,
repeated rows and null ids do no harm; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, functions as F

from logloom.llm.common import give_back, stored, worker_state

UNKNOWN = "und"
BUCKETS = 1 << 14
SIZES = (1, 2, 3, 4)  # bytes in an n-gram
CHUNK = 1 << 20  # bytes of a text that are counted at once
MAX_LANGUAGES = 500
DOCUMENTS_PER_LANGUAGE = 2000
EXHAUSTIVE = 7  # up to so many languages get all bits there are
AMBIGUOUS = 0.55
LENGTHS = (16, 64, 256)  # bytes of letters from which a text is measured with others of its length
FARTHER = 3  # times the distance that 99 of 100 learned rows keep within is clearly farther than usual
NEAR = 0.25  # distances below are never far: the bits agree well
_LETTER = regex.compile(r"\p{L}")
_LETTERS_ONLY = bytes(c if c >= 128 or chr(c).isalpha() else 32 for c in range(256))


def hashed(piece: bytes, starts: int) -> np.ndarray:
    """Bucket of each n-gram that begins in the first ``starts`` bytes."""
    values = np.frombuffer(piece, np.uint8).astype(np.uint32)
    found = []
    for size in SIZES:
        if len(values) < size:
            break
        count = min(starts, len(values) - size + 1)
        mixed = np.full(count, size, np.uint32)
        for n in range(size):
            mixed = (mixed ^ values[n : count + n]) * np.uint32(0x9E3779B1)
            mixed ^= mixed >> np.uint32(15)
        found.append(mixed & np.uint32(BUCKETS - 1))
    return np.concatenate(found) if found else np.zeros(0, np.uint32)


def ngram_counts(text: str) -> np.ndarray:
    """How often the text has n-grams of each bucket; letters only, words set apart by one space."""
    letters = b" ".join(text.lower().encode().translate(_LETTERS_ONLY).split())
    data = b" " + letters + b" "
    counts = np.zeros(BUCKETS, np.int64)
    for at in range(0, len(data), CHUNK):
        counts += np.bincount(hashed(data[at : at + CHUNK + max(SIZES) - 1], CHUNK), minlength=BUCKETS)
    return counts


def has_letter(text: str | None) -> bool:
    return bool(text) and _LETTER.search(text) is not None


def codewords(languages: int, seed: int = 7) -> np.ndarray:
    """Rows of +1 and -1, far from each other; no column is another's or its opposite."""
    if languages < 2:
        return np.ones((languages, 1))
    if languages <= EXHAUSTIVE:
        bits = np.arange(1, 2 ** (languages - 1))
        rows = [(bits >> n) & 1 for n in range(languages - 1)]
        return np.stack([np.ones_like(bits), *(1 - 2 * r for r in rows)]).astype(float)
    rng, best, most = np.random.default_rng(seed), None, -1
    columns = int(np.ceil(10 * np.log2(languages)))
    for _ in range(200):
        code = rng.choice([-1.0, 1.0], (languages, columns))
        if (abs(code.sum(0)) == languages).any() or np.unique(code * code[0], axis=1).shape[1] < columns:
            continue
        apart = ((columns - code @ code.T) / 2 + columns * np.eye(languages)).min()
        if apart > most:
            best, most = code, apart
    return best


@dataclass
class Model:
    languages: list[str]
    code: np.ndarray  # language, bit
    weights: np.ndarray  # bucket, bit
    scale: np.ndarray  # bit: what makes a usual margin 1
    trust: np.ndarray  # language, bit: sums to 1 for each language
    limits: np.ndarray | None = None  # language, length: the largest distance of texts in that language

    def margins(self, counts: np.ndarray) -> np.ndarray:
        seen = np.flatnonzero(counts)
        return counts[seen] @ self.weights[seen] / max(1, counts.sum())

    def distances(self, margins: np.ndarray) -> np.ndarray:
        """Of each codeword: the logistic loss of the bits, by trust."""
        agreement = self.code * (margins * self.scale)
        return (self.trust * np.logaddexp(0, -4 * agreement)).sum(1)

    def predict(self, text: str | None) -> tuple[str, float]:
        if not self.languages or not has_letter(text):
            return UNKNOWN, 0.0
        if len(self.languages) == 1:
            return self.languages[0], 1.0
        distances = self.distances(self.margins(ngram_counts(text)))
        best = int(distances.argmin())
        first, second = np.sort(distances)[:2]
        return self.languages[best], float(second / (first + second)) if second else 0.5

    def knows(self, text: str | None) -> bool:
        """Whether a text has letters and, where that can be told, is in a learned language."""
        if not has_letter(text) or self.limits is None:
            return has_letter(text)
        counts = ngram_counts(text)
        if (band := length_band(counts)) < 0:
            return True
        distances = self.distances(self.margins(counts))
        first, second = np.sort(distances)[:2]
        return bool(second * (1 - AMBIGUOUS) >= AMBIGUOUS * first and first <= self.limits[distances.argmin(), band])


def length_band(counts: np.ndarray) -> int:
    """Which of LENGTHS a text has reached; -1 for none. Each byte begins about one n-gram of each size."""
    return int(np.searchsorted(LENGTHS, counts.sum() / len(SIZES), "right")) - 1


def labelled_sample(docs: DataFrame, per_language: int) -> DataFrame:
    """text and lang of the labelled rows to learn from."""
    labelled = docs.where("lang is not null and text is not null")
    counts = labelled.groupBy("lang").count().limit(MAX_LANGUAGES + 1).collect()
    if len(counts) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    parts = 1 << 20
    kept = F.lit(False)
    for row in counts:
        share = min(parts, int(np.ceil(parts * per_language / row["count"])))
        kept = kept | ((F.col("lang") == row["lang"]) & (F.pmod(F.xxhash64("doc_id"), F.lit(parts)) < share))
    return labelled.where(kept).select("text", "lang").limit(2 * per_language * max(1, len(counts)))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    totals: dict[str, np.ndarray] = {}
    for batch in batches:
        for text, lang in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist()):
            if has_letter(text):
                totals[lang] = totals.get(lang, 0) + ngram_counts(text)
    for lang, counts in totals.items():
        seen = np.flatnonzero(counts)
        yield pa.RecordBatch.from_pydict({"lang": [lang] * len(seen), "bucket": seen, "n": counts[seen]})


def train(docs: DataFrame, documents_per_language: int = DOCUMENTS_PER_LANGUAGE, limits: bool = False) -> Model:
    """A model from the labelled rows of ``docs`` (doc_id, text, lang)."""
    sample = stored(labelled_sample(docs, documents_per_language), "language-sample")
    rows = sample.repartition(sample.sparkSession.sparkContext.defaultParallelism, F.xxhash64("text"))
    counted = rows.mapInArrow(_count, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    found = counted.toPandas()  # at most BUCKETS rows a language
    languages = sorted(found["lang"].unique().tolist())
    code = codewords(len(languages))
    chances = np.full((len(languages), BUCKETS), 0.5)
    for n, lang in enumerate(languages):
        own = found[found["lang"] == lang]
        chances[n, own["bucket"]] += own["n"]
    chances /= chances.sum(1, keepdims=True)
    bits = code.shape[1] if languages else 0
    weights = np.zeros((BUCKETS, bits), np.float32)
    if len(languages) > 1:
        for bit in range(bits):
            ahead = code[:, bit] > 0
            weights[:, bit] = np.log(chances[ahead].mean(0)) - np.log(chances[~ahead].mean(0))
    model = Model(languages, code, weights, np.ones(bits), np.full((len(languages), bits), 1 / max(1, bits)))
    if len(languages) < 2:
        return model
    model = calibrated(model, rows)
    return limited(model, rows) if limits else model


def calibrated(model: Model, rows: DataFrame) -> Model:
    """The model with each bit's usual margin and each classifier's accuracy on each language."""
    bits = model.code.shape[1]

    def margins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, langs = (batch.column(c).to_pylist() for c in ("text", "lang"))
            pairs = [(lang, model.margins(ngram_counts(t)).tolist()) for t, lang in zip(texts, langs) if has_letter(t)]
            yield pa.RecordBatch.from_pydict(
                {"lang": pa.array([p[0] for p in pairs], pa.string()), "margins": pa.array([p[1] for p in pairs], pa.list_(pa.float64()))}
            )

    at = [F.col("margins")[bit] for bit in range(bits)]
    means = rows.mapInArrow(margins, "lang string, margins array<double>").groupBy("lang")
    found = {
        row["lang"]: row
        for row in means.agg(
            *(F.avg(F.abs(c)).alias(f"size{n}") for n, c in enumerate(at)),
            *(F.avg((c > 0).cast("double")).alias(f"ahead{n}") for n, c in enumerate(at)),
        ).collect()  # a row a language
    }
    size = np.array([[found[lang][f"size{n}"] for n in range(bits)] for lang in model.languages])
    ahead = np.array([[found[lang][f"ahead{n}"] for n in range(bits)] for lang in model.languages])
    right = np.where(model.code > 0, ahead, 1 - ahead)
    trust = np.maximum(right, 1e-3)
    scale = 1 / np.maximum(size.mean(0), 1e-9)
    return Model(model.languages, model.code, model.weights, scale, trust / trust.sum(1, keepdims=True))


def limited(model: Model, rows: DataFrame) -> Model:
    """The model with the limits of each language, from the learned rows that it gets right."""

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for text, lang in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist()):
                for part in (text, *(text[: 2 * n] for n in LENGTHS if 2 * n < len(text))):
                    if has_letter(part) and (band := length_band(counts := ngram_counts(part))) >= 0:
                        distances = model.distances(model.margins(counts))
                        if model.languages[distances.argmin()] == lang:
                            found.append((lang, band, float(distances.min())))
            columns = zip(*found) if found else ([], [], [])
            kinds = (pa.string(), pa.int64(), pa.float64())
            arrays = [pa.array(c, kind) for c, kind in zip(columns, kinds)]
            yield pa.RecordBatch.from_arrays(arrays, names=["lang", "band", "distance"])

    far = rows.mapInArrow(measured, "lang string, band long, distance double").groupBy("lang", "band")
    limits = np.full((len(model.languages), len(LENGTHS)), np.inf)
    for row in far.agg(F.percentile("distance", F.lit(0.99)).alias("far")).collect():  # rows: languages x lengths
        limits[model.languages.index(row["lang"]), row["band"]] = max(NEAR, FARTHER * row["far"])
    for band in range(1, len(LENGTHS)):  # a length that no row has: what holds for shorter ones
        limits[:, band] = np.where(np.isinf(limits[:, band]), limits[:, band - 1], limits[:, band])
    return Model(model.languages, model.code, model.weights, model.scale, model.trust, limits)


def learnable(doc_id: Column) -> Column:
    """Whether a document may be learned from; the others are held out to measure accuracy."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3 != 1


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, text's lang_pred, score and ambiguous, a row for each of ``docs`` (doc_id, text)."""

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_state("language", dict)  # other operators' memory is free now
        for batch in batches:
            found = [model.predict(t) for t in batch.column("text").to_pylist()]
            scores = np.array([s for _, s in found], float)
            columns = {
                "doc_id": batch.column("doc_id"),
                "lang_pred": pa.array([lang for lang, _ in found], pa.string()),
                "score": pa.array(scores),
                "ambiguous": pa.array(scores < AMBIGUOUS),
            }
            yield pa.RecordBatch.from_pydict(columns)

    rows = docs.select(F.col("doc_id").cast("long"), "text")
    return rows.mapInArrow(predict, "doc_id long, lang_pred string, score double, ambiguous boolean")


def understood(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs`` whose text the model knows; other columns are kept as they are."""

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_state("language", dict)  # other operators' memory is free now
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("text")).to_pylist()
            yield batch.filter(pa.array([model.knows(t) for t in texts], pa.bool_()))
        give_back()

    return docs.mapInArrow(keep, docs.schema)
