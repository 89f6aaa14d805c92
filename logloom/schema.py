"""Table layouts. ``timestamp`` stays text: comparisons are textual, dates only prune partitions."""

from pyspark.sql import types as T

ENTRY_SCHEMA = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("timestamp", T.StringType()),
        T.StructField("level", T.StringType()),
        T.StructField("event", T.StringType()),
        T.StructField("message", T.StringType()),
        T.StructField("data_json", T.StringType()),
        T.StructField("correlation_id", T.StringType()),
        T.StructField("request_id", T.StringType()),
        T.StructField("fields", T.MapType(T.StringType(), T.StringType())),
        T.StructField("field_count", T.IntegerType()),
        T.StructField("source_file", T.StringType()),
        T.StructField("line_number", T.LongType()),
        T.StructField("generation", T.IntegerType()),
        T.StructField("indexed_at", T.StringType()),
        T.StructField("is_audit", T.BooleanType()),
        T.StructField("event_date", T.DateType()),
    ]
)
ENTRY_COLUMNS = [f.name for f in ENTRY_SCHEMA.fields]

# Fields that also have a column of their own: Parquet can skip data by a column, not by a map
# key, and reading it does not touch the map.
PROMOTED_FIELDS = {"correlationId": "correlation_id", "requestId": "request_id"}

# One row per file and run; the newest row of a file is its state.
LEDGER_SCHEMA = T.StructType(
    [
        T.StructField("source_file", T.StringType()),
        T.StructField("byte_offset", T.LongType()),
        T.StructField("file_size", T.LongType()),
        T.StructField("modified_at", T.TimestampType()),
        T.StructField("lines", T.LongType()),
        T.StructField("generation", T.IntegerType()),
        T.StructField("present", T.BooleanType()),
        T.StructField("run_seq", T.LongType()),
    ]
)

RUN_SCHEMA = T.StructType(
    [
        T.StructField("run_seq", T.LongType()),
        T.StructField("kind", T.StringType()),
        T.StructField("mode", T.StringType()),
        T.StructField("status", T.StringType()),
        T.StructField("started_at", T.StringType()),
        T.StructField("finished_at", T.StringType()),
        T.StructField("last_id", T.LongType()),
        T.StructField("counters", T.MapType(T.StringType(), T.LongType())),
        T.StructField("error", T.StringType()),
        T.StructField("duration_ms", T.LongType()),
    ]
)

# Data files that are no longer part of the table.
REMOVED_SCHEMA = T.StructType([T.StructField("path", T.StringType())])

# Entries of the source file with ids up to ``max_id`` are gone.
TOMBSTONE_SCHEMA = T.StructType([T.StructField("source_file", T.StringType()), T.StructField("max_id", T.LongType())])

ALERT_SCHEMA = T.StructType(
    [
        T.StructField("policy_id", T.StringType()),
        T.StructField("rule", T.StringType()),
        T.StructField("severity", T.StringType()),
        T.StructField("triggered_at", T.StringType()),
        T.StructField("details", T.MapType(T.StringType(), T.DoubleType())),
        T.StructField("status", T.StringType()),
        T.StructField("attempts", T.IntegerType()),
        T.StructField("sent_at", T.StringType()),
        T.StructField("error", T.StringType()),
    ]
)
