"""Operator 12: fill-in-middle transformation, cut at unit boundaries found in a wavelet matrix.

A text is cut into units (lines, or sentences, or blank-ended words), each of which ends with a character
of the unit's classes; what follows the last such character is a unit too. Prefix and middle end after a
number of units that a digest of the doc_id decides, so that reruns agree and rows need not meet. The texts of
a batch share one wavelet matrix: ranks at the texts' ends tell how many units each has, bisection on
ranks (select) finds the places of all cuts at once, and ranks of continuation bytes turn places into
code points.

Forms: ``psm`` writes prefix, suffix, middle, and ``spm`` suffix, prefix, middle, each behind its mark;
``plain`` is the text as it is. Empty (and null) texts and those that contain a mark are plain; a null
doc_id is digested as empty text. Marks can't arise where parts meet, so ``restored`` gets the exact text
from output and form alone. Repeated rows get equal results; texts count whole; other columns of ``docs``
are not read; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from logloom.llm.wavelet import BLANK, CONTINUATION, LINE_END, MARK, WaveletMatrix

# The marks of the parts.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
UNITS = {"line": (LINE_END,), "sentence": (LINE_END, MARK), "word": (LINE_END, BLANK)}
TOGETHER = 1 << 22  # bytes of short texts that share a matrix; a longer text has its own
PSM, SPM, PLAIN = "psm", "spm", "plain"


@dataclass(frozen=True)
class Options:
    unit: str = "line"
    percent: int = 100  # of texts that are transformed
    spm_percent: int = 50  # of those, in the form spm
    salt: str = "7:"


def draws(doc_id: int | None, salt: str) -> tuple[int, int, int, int]:
    """Four numbers for a document."""
    found = hashlib.sha256(f"{salt}{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return tuple(int(found[at : at + 8], 16) for at in range(0, 32, 8))


def _groups(sizes: np.ndarray) -> Iterator[tuple[int, int]]:
    """Runs of texts that share a matrix."""
    first, held = 0, 0
    for n, size in enumerate(sizes.tolist()):
        if n > first and held + size > TOGETHER:
            yield first, n
            first, held = n, 0
        held += size
    if first < len(sizes):
        yield first, len(sizes)


def cuts(data: np.ndarray, starts: np.ndarray, numbers: np.ndarray, unit: str) -> tuple[np.ndarray, ...]:
    """Units of each text, and for prefix and middle the byte each ends before and its code points.

    ``data`` holds the texts one after another, ``starts`` their bounds in it, ``numbers`` two draws a text.
    """
    kinds = UNITS[unit]
    matrix = WaveletMatrix(data)
    before = matrix.rank(kinds, starts)
    points = starts - matrix.rank((CONTINUATION,), starts)
    sizes = np.diff(starts)
    ends_open = np.zeros(len(sizes), np.int64)  # what follows the last end of a unit
    filled = np.flatnonzero(sizes)
    if len(filled):
        last = matrix.rank(kinds, starts[1:][filled]) - matrix.rank(kinds, starts[1:][filled] - 1)
        ends_open[filled] = 1 - last
    units = np.diff(before) + ends_open
    chosen = np.sort(numbers % (units + 1)[:, None], axis=1)
    places = np.repeat(starts[:-1, None], 2, axis=1)
    for part in range(2):
        wanted = chosen[:, part]
        whole = wanted == units
        places[whole, part] = starts[1:][whole]
        inside = np.flatnonzero(~whole & (wanted > 0))
        places[inside, part] = matrix.select(kinds, before[:-1][inside] + wanted[inside])
    at = places - matrix.rank((CONTINUATION,), places.ravel()).reshape(places.shape)
    return units, places, at[:, 0] - points[:-1], at[:, 1] - at[:, 0]


def fill_in_middle(docs: DataFrame, options: Options = Options()) -> DataFrame:
    """doc_id, n (units), form, prefix_chars, middle_chars and output of each row of ``docs`` (doc_id, text)."""
    schema = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"
    marks = [m.encode() for m in (PREFIX, SUFFIX, MIDDLE)]

    def transform(doc_ids: list[int | None], texts: pa.Array) -> pa.RecordBatch:
        marked = pc.match_substring_regex(texts, "|".join((PREFIX, SUFFIX, MIDDLE))).to_numpy(zero_copy_only=False)
        raw = texts.cast(pa.large_binary())
        _, offsets, data = raw.buffers()
        bounds = np.frombuffer(offsets, np.int64)[raw.offset : raw.offset + len(raw) + 1]
        values = np.zeros(0, np.uint8) if data is None else np.frombuffer(data, np.uint8)
        numbers = np.array([draws(d, options.salt) for d in doc_ids], np.int64).reshape(-1, 4)
        plain = (np.diff(bounds) == 0) | marked | (numbers[:, 2] % 100 >= options.percent)
        spm = numbers[:, 3] % 100 < options.spm_percent
        n, prefix, middle, forms, outputs = [], [], [], [], []
        for low, high in _groups(np.diff(bounds)):
            base = bounds[low]
            own = values[base : bounds[high]]
            units, places, prefix_chars, middle_chars = cuts(own, bounds[low : high + 1] - base, numbers[low:high, :2], options.unit)
            n.append(units)
            prefix.append(prefix_chars)
            middle.append(middle_chars)
            for at in range(low, high):
                start, end = int(bounds[at] - base), int(bounds[at + 1] - base)
                if plain[at]:
                    forms.append(PLAIN)
                    outputs.append(own[start:end].tobytes())
                    continue
                one, two = places[at - low].tolist()
                parts = (own[start:one].tobytes(), own[two:end].tobytes(), own[one:two].tobytes())
                order = (1, 0, 2) if spm[at] else (0, 1, 2)
                forms.append(SPM if spm[at] else PSM)
                outputs.append(b"".join(x for part in order for x in (marks[part], parts[part])))
        none = [np.zeros(0, np.int64)]
        return pa.RecordBatch.from_arrays(
            [
                pa.array(doc_ids, pa.int64()),
                pa.array(np.concatenate(n or none)),
                pa.array(forms, pa.string()),
                pa.array(np.concatenate(prefix or none), mask=plain),
                pa.array(np.concatenate(middle or none), mask=plain),
                pa.array(outputs, pa.binary()).cast(pa.string()),
            ],
            ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield transform(batch.column("doc_id").to_pylist(), batch.column("text").fill_null(""))

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


def _between(text: Column, mark: str, following: str) -> Column:
    """What stands behind a mark and before the next one."""
    return F.split_part(F.split_part(text, F.lit(mark), F.lit(2)), F.lit(following), F.lit(1))


def restored(output: Column, form: Column) -> Column:
    """The text that a row's output was made of."""
    middle = F.split_part(output, F.lit(MIDDLE), F.lit(2))
    psm = F.concat(_between(output, PREFIX, SUFFIX), middle, _between(output, SUFFIX, MIDDLE))
    spm = F.concat(_between(output, PREFIX, MIDDLE), middle, _between(output, SUFFIX, PREFIX))
    return F.when(form == PSM, psm).when(form == SPM, spm).otherwise(output)
