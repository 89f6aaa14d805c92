"""ISO text from timestamps and back, independent of the session time zone."""

from __future__ import annotations

from datetime import datetime, timedelta, timezone

from pyspark.sql import Column, functions as F

_EPOCH_NTZ = "timestamp_ntz '1970-01-01 00:00:00'"


def iso_millis(ntz: Column) -> Column:
    """``yyyy-MM-ddTHH:mm:ss.SSSZ`` of a zone-less timestamp read as UTC."""
    text = ntz.cast("timestamp_ntz").cast("string")
    return F.concat(
        F.substring(text, 1, 10),
        F.lit("T"),
        F.substring(text, 12, 8),
        F.lit("."),
        F.rpad(F.substring(text, 21, 3), 3, "0"),
        F.lit("Z"),
    )


def utc_ntz(instant: Column) -> Column:
    """Zone-less UTC wall clock of an instant."""
    return F.expr(_EPOCH_NTZ) + F.make_dt_interval(secs=(F.unix_micros(instant) / F.lit(1_000_000)).cast("decimal(18,6)"))


def ntz_from_millis(millis: Column) -> Column:
    return F.expr(_EPOCH_NTZ) + F.make_dt_interval(secs=(millis / F.lit(1000)).cast("decimal(18,6)"))


def iso_from_millis(millis: Column) -> Column:
    return iso_millis(ntz_from_millis(millis))


def utc_day(instant: Column) -> Column:
    return F.substring(utc_ntz(instant).cast("string"), 1, 10)


def canonical_millis(text: Column) -> Column:
    """Milliseconds since 1970 of canonical ISO text; NULL for every other text."""
    canonical = text.rlike(r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d\.\d{3}Z$")
    ntz = F.try_to_timestamp(F.when(canonical, F.concat(F.substring(text, 1, 23), F.lit("+00:00"))))
    return F.unix_millis(ntz)


def date_prefix(text: Column) -> Column:
    """Date named by the first ten characters, NULL unless they are a real yyyy-MM-dd.

    Text order implies the order of these prefixes, so a textual bound on ``timestamp``
    is also a bound on this date.
    """
    day = F.substring(text, 1, 10)
    return F.when(day.rlike(r"^\d{4}-\d\d-\d\d$"), day.try_cast("date"))


def to_iso(moment: datetime) -> str:
    """ISO millisecond text of a Python datetime; a naive one is read as UTC."""
    if moment.tzinfo is None:
        moment = moment.replace(tzinfo=timezone.utc)
    moment = moment.astimezone(timezone.utc)
    return moment.strftime("%Y-%m-%dT%H:%M:%S.") + f"{moment.microsecond // 1000:03d}Z"


def from_iso(text: str) -> datetime:
    return datetime.fromisoformat(text.replace("Z", "+00:00"))


def iso_minus(now: str, **delta: float) -> str:
    return to_iso(from_iso(now) - timedelta(**delta))


def utc_now() -> str:
    return to_iso(datetime.now(timezone.utc))
