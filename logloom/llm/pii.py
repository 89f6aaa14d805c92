"""Operator 13: personal data, by patterns and by a BiLSTM-CRF that is trained on what they find.

Patterns give the base spans of four kinds (email, ip, card, phone): leftmost matches that do not overlap
within their kind, of which those that fail their check go. They are found in time linear in the text.

The base spans label a sample of windows, of which some are written differently (``VARIANTS``: other
separators, no plus sign, an @ in brackets). A character-level bidirectional LSTM with CRF transitions
learns from them (``tagger``), and from windows with digits or an @ that hold no span. Texts are decoded
in overlapping windows, with the result of decoding every window: no new span is without a digit, an @ or an
``at`` in brackets, so windows with one of these are decoded first, and then all that a piece found so far reaches
or touches, until there are no more. The spans of all windows of a text are reconciled: pieces of one kind that
overlap or touch are one span, of overlapping kinds the longest stays, and base spans stand. A new span must still be a proper
address or number when its separators are read leniently (``proper``), so that clean text is left alone.

Sample: at most ``PER_KIND`` windows of each kind and as many without any, those with the smallest hashes
of their text, so copies count once and the sample does not depend on how the rows are spread. All texts
count whole in everything else.

A null or empty text has no spans; repeated rows get equal results; null doc_ids stay. If no base span
occurs anywhere there is nothing to learn, and only base spans (none) are returned. Other columns are not
read; an empty table gives no rows. Offsets are code points, ends exclusive.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator
from heapq import nsmallest

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F

from logloom.llm import tagger

KINDS = ("email", "ip", "card", "phone")
WIDTH, STRIDE = 96, 48  # characters of a window, and from one to the next
PER_KIND = 250
UPDATES = 200  # steps of the training
WINDOWS_AT_ONCE = 1024
# What the base spans look like.
EMAIL_NAME = r"[A-Za-z0-9._%+-]"
EMAIL_HOST = r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
CARD_DIGITS, PHONE_DIGITS, IP_PART = (14, 19), (10, 15), 255

_BEFORE_AT = re.compile(f"{EMAIL_NAME}*\\Z")
_HOST = re.compile(EMAIL_HOST)
_EMAIL = re.compile(f"{EMAIL_NAME}+@{EMAIL_HOST}")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_DIGITS = re.compile(r"[0-9]+(?:[\x20-][0-9]+)*")
_PHONE = re.compile(PHONE)
_DIGIT = re.compile("[0-9]")
_TRIGGERS = re.compile("[0-9@]+")
_NEEDED = re.compile(r"[0-9@]+|[\[(]\s*at\s*[\])]")  # what every proper span holds one of
_NAME_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
Span = tuple[int, int, int]  # start, place of its kind in KINDS, end


def luhn(digits: str) -> bool:
    values = [int(d) for d in reversed(digits)]
    return (sum(values[::2]) + sum(sum(divmod(2 * d, 10)) for d in values[1::2])) % 10 == 0


def is_card(digits: str) -> bool:
    return CARD_DIGITS[0] <= len(digits) <= CARD_DIGITS[1] and luhn(digits)


def is_ip_part(digits: str) -> bool:
    short = digits.lstrip("0")
    return len(short) <= 3 and int(short or "0") <= IP_PART


def only_digits(text: str) -> str:
    return re.sub("[^0-9]", "", text)


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Names end at an @ and can't hold one, so each @ has one possible match."""
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _NAME_CHARS:
            start -= 1
        host = _HOST.match(text, at + 1) if start < at else None
        free = host.end() if host else at + 1
        if host:
            yield start, free
        at = text.find("@", free)


def ips(text: str) -> Iterator[tuple[int, int]]:
    """Four numbers each, one match after another, of a run of numbers joined by single dots."""
    for run in _DOTTED.finditer(text):
        numbers = run.group().split(".")
        at = run.start()
        for n in range(0, len(numbers) - 3, 4):
            four = numbers[n : n + 4]
            end = at + sum(map(len, four)) + 3
            if all(map(is_ip_part, four)):
                yield at, end
            at = end + 1


def cards(text: str) -> Iterator[tuple[int, int]]:
    for run in _DIGITS.finditer(text):
        if run.end() - run.start() >= CARD_DIGITS[0] and is_card(only_digits(run.group())):
            yield run.span()


def phones(text: str) -> Iterator[tuple[int, int]]:
    for run in _PHONE.finditer(text):
        if PHONE_DIGITS[0] <= len(only_digits(run.group())) <= PHONE_DIGITS[1]:
            yield run.span()


def base_spans(text: str) -> list[Span]:
    """Spans by start, then kind."""
    found = [(start, 0, end) for start, end in emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        for kind, find in ((1, ips), (2, cards), (3, phones)):
            found += [(start, kind, end) for start, end in find(text)]
    return sorted(found)


_AROUND_AT = re.compile(r"\s*(?:[\[(]\s*(?:@|at)\s*[\])]|@)\s*")
_AROUND_DOT = re.compile(r"\s*[\[(]?\s*\.\s*[\])]?\s*")
_CARD_LIKE = re.compile(r"[0-9]+(?:[\x20./_–-]{1,3}[0-9]+)*")
_PHONE_LIKE = re.compile(
    r"(?:\+|00)\x20?[0-9]{1,3}[\x20./-]?(?:\([0-9]{2,5}\)|[0-9]{2,5})(?:[\x20./-]?[0-9]{2,5}){1,4}"  # with a country
    r"|(?:[0-9]{1,3}\x20)?\([0-9]{2,5}\)\x20?[0-9]{2,5}(?:[\x20./-][0-9]{2,5}){1,3}"  # area in brackets
    r"|[0-9]{3}(?P<mark>[./-])[0-9]{3}(?P=mark)[0-9]{4}"
)
_DATE = re.compile(r"(?:19|20)[0-9]{2}[./-][0-9]{1,2}[./-][0-9]{1,2}|[0-9]{1,2}[./-][0-9]{1,2}[./-](?:19|20)[0-9]{2}")


def proper(kind: int, text: str) -> bool:
    """Whether a span that was decoded is of its kind, with separators read leniently."""
    if KINDS[kind] == "email":
        return _EMAIL.fullmatch(_AROUND_AT.sub("@", text)) is not None
    if KINDS[kind] == "ip":
        numbers = _AROUND_DOT.sub(".", text).split(".")
        return len(numbers) == 4 and all(n.isascii() and n.isdigit() and is_ip_part(n) for n in numbers)
    if KINDS[kind] == "card":
        return _CARD_LIKE.fullmatch(text) is not None and is_card(only_digits(text))
    fits = PHONE_DIGITS[0] <= len(only_digits(text)) <= PHONE_DIGITS[1]
    return fits and _PHONE_LIKE.fullmatch(text) is not None and _DATE.search(text) is None


def variant(kind: int, text: str, rnd: random.Random) -> str:
    """A span written in another way."""
    if KINDS[kind] == "email":
        return text.replace("@", rnd.choice([" @ ", "[@]", "(at)", "[at]", " (at) ", " [at] "]))
    if KINDS[kind] == "ip":
        return text.replace(".", rnd.choice([" . ", "[.]", "(.)", ". "]))
    digits = only_digits(text)
    if KINDS[kind] == "card":
        mark = rnd.choice([".", "/", "_", "  ", " - ", "–"])
        return mark.join(digits[at : at + 4] for at in range(0, len(digits), 4))
    if rnd.random() < 0.5:
        return rnd.choice(["", "00"]) + text.removeprefix("+")
    cut = [digits[-10:-7], digits[-7:-4], digits[-4:]]
    return rnd.choice([".", "/", "-"]).join(["00" + digits[:-10]] * (len(digits) > 10) + cut)


def class_table() -> np.ndarray:
    """The class of each code point up to 0x2FF; 0 is padding."""
    table = np.full(0x300, 1, np.uint8)  # other characters
    singles = "\n .,-+@()[]/:_%=#\"'|"
    for n, char in enumerate(singles):
        table[ord(char)] = 5 + n
    table[ord("\t")] = table[ord(" ")]
    for code in range(0x300):
        char = chr(code)
        if char.isascii() and char.isdigit():
            table[code] = 2
        elif char.isalpha():
            table[code] = 4 if char.isupper() else 3
    return table


CLASS_OF = class_table()
CLASSES = int(CLASS_OF.max()) + 1


def classes(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    return np.where(points < 0x300, CLASS_OF[np.minimum(points, 0x2FF)], 3).astype(np.uint8)


def allowed_steps() -> np.ndarray:
    """Which label may follow which: the next characters of a span only its first or next ones."""
    size = 1 + 2 * len(KINDS)
    found = np.ones((size, size), bool)
    for kind in range(len(KINDS)):
        found[:, 2 * kind + 2] = False
        found[[2 * kind + 1, 2 * kind + 2], 2 * kind + 2] = True
    return found


def last_window(size: int) -> int:
    """The number of the last window of a text with ``size`` characters."""
    return max(0, -(-(size - WIDTH) // STRIDE))


def window_starts(text: str) -> np.ndarray:
    """Where the windows begin that hold something of what every proper span has."""
    found: list[np.ndarray] = []
    last = last_window(len(text))
    for run in _NEEDED.finditer(text):
        low = max(0, (run.start() - WIDTH) // STRIDE + 1)
        found.append(np.arange(min(low, last), min((run.end() - 1) // STRIDE, last) + 1))
    return np.unique(np.concatenate(found)) * STRIDE if found else np.zeros(0, np.int64)


# ---- the sample ------------------------------------------------------------------------

_SAMPLE = "kind int, hash long, text string, starts array<int>, kinds array<int>, ends array<int>"


def sample_windows(text: str) -> Iterator[tuple[int, int, str, tuple[Span, ...]]]:
    """(kind or -1, hash, text, spans) of windows that may be learned from; they begin and end between spans."""
    spans = base_spans(text)
    triggers = [m.span() for m in _TRIGGERS.finditer(text)]
    taken = -1
    for kind, at, end in [(k, s, e) for s, k, e in spans] + [(-1, s, e) for s, e in triggers]:
        if kind < 0 and (at < taken or any(s < at + WIDTH // 2 and at - WIDTH // 2 < e for s, _, e in spans)):
            continue
        seed = xxhash.xxh3_64_intdigest(text[max(0, at - WIDTH) : end + WIDTH].encode("utf-8", "surrogatepass"))
        low = max(0, at - seed % max(1, WIDTH - min(end - at, WIDTH - 1)))
        high = min(len(text), low + WIDTH)
        own = [(s, k, e) for s, k, e in spans if s < high and low < e]
        if any(s < low or e > high for s, _, e in own):
            continue
        if kind < 0:
            taken = high
        part = text[low:high]
        yield kind, xxhash.xxh3_64_intdigest(part.encode("utf-8", "surrogatepass")) >> 1, part, tuple((s - low, k, e - low) for s, k, e in own)


def sample(docs: DataFrame, per_kind: int = PER_KIND) -> DataFrame:
    """At most ``per_kind`` windows for each kind, and as many without spans."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, dict[int, tuple]] = {}
        for batch in batches:
            for text in batch.column("text").to_pylist():
                if not text:
                    continue
                for kind, key, part, spans in sample_windows(text):
                    own = held.setdefault(kind, {})
                    own[key] = (part, spans)
                    if len(own) >= 4 * per_kind:
                        held[kind] = {k: own[k] for k in nsmallest(per_kind, own)}
        rows = [
            {"kind": kind, "hash": key, "text": part, "starts": [s for s, _, _ in spans], "kinds": [k for _, k, _ in spans], "ends": [e for _, _, e in spans]}
            for kind, own in held.items()
            for key, (part, spans) in sorted(own.items())[:per_kind]
        ]
        lists = pa.list_(pa.int32())
        kinds = pa.schema([("kind", pa.int32()), ("hash", pa.int64()), ("text", pa.string()), ("starts", lists), ("kinds", lists), ("ends", lists)])
        if rows:
            yield pa.RecordBatch.from_pylist(rows, kinds)

    found = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, _SAMPLE).dropDuplicates(["kind", "hash", "text"])
    order = Window.partitionBy("kind").orderBy("hash", "text")
    return found.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= per_kind).drop("_rank")


def rewritten(text: str, spans: list[Span], rnd: random.Random) -> tuple[str, list[Span]]:
    """The window with its spans written differently."""
    parts, found, done, size = [], [], 0, 0
    for start, kind, end in spans:
        if start < done:
            continue
        new = variant(kind, text[start:end], rnd)
        parts += [text[done:start], new]
        size += start - done
        found.append((size, kind, size + len(new)))
        size += len(new)
        done = end
    return "".join([*parts, text[done:]]), found


def labelled(text: str, spans: list[Span]) -> tuple[np.ndarray, np.ndarray]:
    """Classes and labels of a window, padded; where spans overlap the first counts."""
    rows, labels = np.zeros(WIDTH, np.uint8), np.zeros(WIDTH, np.int64)
    own = classes(text[:WIDTH])
    rows[: len(own)] = own
    for start, kind, end in sorted(spans):
        if end <= len(own) and not labels[start:end].any():
            labels[start:end] = 2 * kind + 2
            labels[start] = 2 * kind + 1
    return rows, labels


def train(docs: DataFrame, per_kind: int = PER_KIND, updates: int = UPDATES, seed: int = 0) -> tagger.Weights | None:
    """Weights learned from the base spans of ``docs`` (text), or None if there is none."""
    chosen = sample(docs, per_kind).orderBy("kind", "hash", "text").collect()  # at most per_kind a kind
    return fitted([(r["text"], list(zip(r["starts"], r["kinds"], r["ends"]))) for r in chosen], updates, seed)


def fitted(windows: list[tuple[str, list[Span]]], updates: int = UPDATES, seed: int = 0) -> tagger.Weights | None:
    if not any(spans for _, spans in windows):
        return None
    rnd = random.Random(seed)
    shaped = list(windows) + [rewritten(text, spans, rnd) for text, spans in windows if spans]
    rows, labels = (np.stack(found) for found in zip(*(labelled(t, s) for t, s in shaped)))
    lengths = np.array([min(len(t), WIDTH) for t, _ in shaped])
    return tagger.train(rows, lengths, labels, CLASSES, allowed_steps(), updates, seed=seed)


# ---- decoding --------------------------------------------------------------------------


def reconciled(text: str, pieces: list[Span], base: list[Span]) -> list[Span]:
    """All spans of a text: the base ones, and what the windows' pieces add to them."""
    joined: list[Span] = []
    for kind in range(len(KINDS)):
        own: list[list[int]] = []
        for start, end in sorted((s, e) for s, k, e in pieces if k == kind):
            if own and start <= own[-1][1]:
                own[-1][1] = max(own[-1][1], end)
            else:
                own.append([start, end])
        joined += [(start, kind, end) for start, end in own]
    added: list[Span] = []
    # What stands overlaps no other, so a new span can only meet its neighbours by start.
    taken = sorted((s, e) for s, _, e in base)
    reach = np.maximum.accumulate([e for _, e in taken]) if taken else np.zeros(0, np.int64)
    starts = np.array([s for s, _ in taken], np.int64)
    for start, kind, end in joined:
        before = int(np.searchsorted(starts, end))
        if (before == 0 or reach[before - 1] <= start) and proper(kind, text[start:end]):
            added.append((start, kind, end))
    kept: list[Span] = []
    for span in sorted(added, key=lambda s: (s[0], s[0] - s[2], s[1])):
        while kept and kept[-1][2] > span[0] and span[2] - span[0] > kept[-1][2] - kept[-1][0]:
            kept.pop()
        if not kept or kept[-1][2] <= span[0]:
            kept.append(span)
    return sorted(base + kept)


class Decoder:
    """Decodes the windows of several texts at once."""

    def __init__(self, weights: tagger.Weights):
        self.weights = weights
        self.texts: list[tuple[int, np.ndarray, np.ndarray]] = []  # place, classes, window starts
        self.windows = 0

    def add(self, place: int, text: str) -> None:
        starts = window_starts(text)
        if len(starts):
            self.texts.append((place, classes(text), starts))
            self.windows += len(starts)

    def pieces(self) -> dict[int, list[Span]]:
        """Spans of each text's windows, in the order of the texts."""
        found: dict[int, list[Span]] = {}
        decoded = [set(starts.tolist()) for _, _, starts in self.texts]
        todo = [(n, start) for n, starts in enumerate(decoded) for start in sorted(starts)]
        while todo:
            reached = set()
            for owner, kind, start, end in self._decoded(todo):
                found.setdefault(self.texts[owner][0], []).append((start, kind, end))
                last = last_window(len(self.texts[owner][1]))
                for n in range(max(0, -(-(start - WIDTH) // STRIDE)), min(end // STRIDE, last) + 1):
                    if n * STRIDE not in decoded[owner]:
                        decoded[owner].add(n * STRIDE)
                        reached.add((owner, n * STRIDE))
            todo = sorted(reached)
        self.texts, self.windows = [], 0
        return found

    def _decoded(self, windows: list[tuple[int, int]]) -> Iterator[tuple[int, int, int, int]]:
        """(text, kind, start, end) of the pieces in windows (text, start)."""
        for at in range(0, len(windows), WINDOWS_AT_ONCE):
            own = windows[at : at + WINDOWS_AT_ONCE]
            rows = np.zeros((len(own), WIDTH), np.uint8)
            for n, (owner, start) in enumerate(own):
                part = self.texts[owner][1][start : start + WIDTH]
                rows[n, : len(part)] = part
            lengths = (rows > 0).sum(1)
            for row, kind, start, end in tagger.runs(tagger.decode(self.weights, rows, lengths)):
                owner, begin = own[row]
                yield owner, kind, begin + start, begin + end


_SPANS = "array<struct<kind: string, start: long, end: long>>"


def personal_data(docs: DataFrame, weights: tagger.Weights | None) -> DataFrame:
    """doc_id, base and spans (kind, start, end) of each row of ``docs`` (doc_id, text)."""
    kinds = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def listed(spans: list[list[Span]]) -> pa.Array:
        return pa.array([[{"kind": KINDS[k], "start": s, "end": e} for s, k, e in own] for own in spans], kinds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            base = [base_spans(t) for t in texts]
            spans = list(base)
            if weights is not None:
                decoder = Decoder(weights)
                for n, text in enumerate(texts):
                    decoder.add(n, text)
                    if decoder.windows >= WINDOWS_AT_ONCE or n == len(texts) - 1:
                        for place, pieces in decoder.pieces().items():
                            spans[place] = reconciled(texts[place], pieces, base[place])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), listed(base), listed(spans)], ["doc_id", "base", "spans"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, f"doc_id long, base {_SPANS}, spans {_SPANS}")


def written_out(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def counts(spans: Column) -> dict[str, Column]:
    """How many spans there are of each kind."""

    def of(kind: str) -> Column:
        return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")

    return {kind: of(kind) for kind in KINDS}
