"""Ingest payloads: JSON arrays of records, or objects holding one under ``logs``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from logloom.functions.json_text import js_trim, with_parsed

DEFAULT_MAX_BODY_BYTES = 1_048_576
MIN_MAX_BODY_BYTES = 1024

ACCEPTED = "ok"
UNAUTHORIZED = "unauthorized"
TOO_LARGE = "too_large"
INVALID_JSON = "invalid_json"
INVALID_SHAPE = "invalid_payload"


def effective_max_bytes(limit: float | None) -> int:
    return max(MIN_MAX_BODY_BYTES, int(DEFAULT_MAX_BODY_BYTES if limit is None or limit < 0 else limit))


def assign_producers(requests: DataFrame, producers: DataFrame) -> DataFrame:
    """Add ``producer_id``: the authenticated user name, else the producer of the token, else NULL."""
    table = producers.select("token", F.col("producer_id").alias("_token_producer"))
    return (
        requests.join(table, "token", "left")
        .withColumn("producer_id", F.coalesce(F.nullif("basic_user", F.lit("")), "_token_producer"))
        .drop("_token_producer")
    )


def parse_requests(requests: DataFrame, max_bytes: int = DEFAULT_MAX_BODY_BYTES) -> DataFrame:
    """Add ``status`` and ``records`` (array of variant, NULL unless the request is accepted).

    Needs ``producer_id`` and ``payload``. An empty body counts as an empty array.
    """
    too_large = F.octet_length("payload") > max_bytes
    body = js_trim(F.coalesce("payload", F.lit("")))
    # Rejected bodies are not parsed at all.
    text = F.when(F.col("producer_id").isNotNull() & ~F.coalesce(too_large, F.lit(False)), body)
    prepared = requests.withColumn("_body", F.when(text == "", F.lit("[]")).otherwise(text))
    parsed = with_parsed(prepared, "_body", "_parsed")

    def array_at(path: str) -> Column:
        return F.try_variant_get(F.col("_parsed"), path, "array<variant>")

    records = F.coalesce(array_at("$.logs"), array_at("$"))
    status = (
        F.when(F.col("producer_id").isNull(), F.lit(UNAUTHORIZED))
        .when(too_large, F.lit(TOO_LARGE))
        .when(F.col("_parsed").isNull(), F.lit(INVALID_JSON))
        .when(F.col("records").isNull(), F.lit(INVALID_SHAPE))
        .otherwise(F.lit(ACCEPTED))
    )
    return parsed.withColumn("records", records).withColumn("status", status).drop("_body", "_parsed")


def explode_records(parsed: DataFrame) -> DataFrame:
    """One row per array element of accepted requests: request columns, position, record."""
    keep = [name for name in parsed.columns if name not in ("payload", "records", "status")]
    return parsed.where(F.col("status") == ACCEPTED).select(
        *keep, F.posexplode("records").alias("position", "record")
    )
