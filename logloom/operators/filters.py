"""Search options as column predicates."""

from __future__ import annotations

import base64
import binascii
import json
import math
from dataclasses import dataclass, replace
from datetime import date
from functools import reduce
from operator import and_

from pyspark.sql import Column, functions as F

from logloom.schema import PROMOTED_FIELDS

MAX_LIMIT = 1000
DEFAULT_PAGE_LIMIT = 100
DEFAULT_BUCKET_LIMIT = 25


@dataclass(frozen=True)
class Cursor:
    """Position after the last row of a page."""

    timestamp: str
    id: int

    def encode(self) -> str:
        text = json.dumps({"id": self.id, "timestamp": self.timestamp}, ensure_ascii=False, separators=(",", ":"))
        return base64.urlsafe_b64encode(text.encode()).decode().rstrip("=")

    @staticmethod
    def decode(text: str | None) -> Cursor | None:
        """The cursor in ``text``, or None when it is absent or malformed."""
        if not text:
            return None
        try:
            body = json.loads(base64.urlsafe_b64decode(text + "=" * (-len(text) % 4)))
        except (ValueError, binascii.Error):
            return None
        if not isinstance(body, dict):
            return None
        stamp, row_id = body.get("timestamp"), body.get("id")
        if not isinstance(stamp, str) or isinstance(row_id, bool) or not isinstance(row_id, (int, float)):
            return None
        if not math.isfinite(row_id) or row_id <= 0:
            return None
        return Cursor(stamp, int(row_id))


def clamp_limit(limit: float | None, default: int) -> int:
    """Truncate to an integer in 1..1000; missing and zero take the default."""
    value = limit if limit else default
    if math.isnan(value):
        value = default
    return max(1, int(min(MAX_LIMIT, value)))


@dataclass(frozen=True)
class LogQuery:
    """Optional search conditions, all ANDed. A field test needs both ``field`` and ``value``."""

    from_: str | None = None
    to: str | None = None
    level: str | None = None
    audit: bool | None = None
    field: str | None = None
    value: str | None = None
    limit: float | None = None
    cursor: str | None = None

    def without_paging(self) -> LogQuery:
        return replace(self, cursor=None, limit=None)

    @property
    def filters_on_field(self) -> bool:
        return bool(self.field) and self.value is not None

    def conditions(self, with_field: bool = True) -> list[Column]:
        """Conditions on the entry columns, including bounds on the date partition."""
        timestamp = F.col("timestamp")
        found: list[Column] = []
        if self.from_:
            found += [timestamp >= self.from_, *day_bound(self.from_, lower=True)]
        if self.to:
            found += [timestamp <= self.to, *day_bound(self.to, lower=False)]
        if self.level:
            found.append(F.col("level") == self.level.upper())
        if self.audit is not None:
            found.append(F.col("is_audit") == F.lit(self.audit))
        if with_field and self.filters_on_field:
            found.append(field_value(self.field) == self.value)
        return found

    def predicate(self) -> Column:
        return all_of(self.conditions())


def field_value(name: str) -> Column:
    """Text of a top-level field, NULL where an entry lacks it."""
    if name in PROMOTED_FIELDS:
        return F.col(PROMOTED_FIELDS[name])
    return F.try_element_at("fields", F.lit(name))


def all_of(conditions: list[Column]) -> Column:
    return reduce(and_, conditions) if conditions else F.lit(True)


def day_prefix(text: str) -> date | None:
    try:
        return date.fromisoformat(text[:10]) if len(text) >= 10 and text[4] == "-" else None
    except ValueError:
        return None


def day_bound(text: str, lower: bool) -> list[Column]:
    """Partition bound implied by a textual bound.

    Entries whose timestamp does not begin with a date sit in the NULL partition and stay in.
    """
    day = day_prefix(text)
    if day is None:
        return []
    column = F.col("event_date")
    bound = column >= F.lit(day) if lower else column <= F.lit(day)
    return [bound | column.isNull()]


def after_cursor(cursor: Cursor) -> list[Column]:
    """Rows that follow ``cursor`` in newest-first order."""
    timestamp = F.col("timestamp")
    keyset = (timestamp < cursor.timestamp) | ((timestamp == cursor.timestamp) & (F.col("id") < cursor.id))
    return [keyset, *day_bound(cursor.timestamp, lower=False)]


def expired(normal_cutoff: str, audit_cutoff: str) -> Column:
    """Entries older than the cutoff of their class."""
    audit, timestamp = F.col("is_audit"), F.col("timestamp")
    return (~audit & (timestamp < normal_cutoff)) | (audit & (timestamp < audit_cutoff))
