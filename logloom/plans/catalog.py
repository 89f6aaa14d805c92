"""Every operator as a query over the driver tables."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date, datetime, time, timedelta, timezone

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from logloom.functions.normalize import (
    INGESTED,
    classify_lines,
    entries_from_lines,
    is_audit_file,
)
from logloom.functions.times import iso_millis, to_iso
from logloom.operators import alerts, fields, ingest, policies, reports, retention, search
from logloom.operators.aggregate import aggregate_logs
from logloom.operators.filters import LogQuery
from logloom.operators.index import ignore_known, to_rows
from logloom.plans.base_logs import GLOB, MAX_BYTES, NOW, Workspace, event_lines, folder_of, log_id, write_lines
from logloom.schema import RUN_SCHEMA
from logloom.session import scratch_path
from logloom.sources import files, payloads

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

RANGE = {"from_": "2024-01-10", "to": "2024-01-12T12:00:00.000Z"}
COMBINED = {
    "from_": "2024-01-05T00:00:00.000Z",
    "to": "2024-01-25T00:00:00.000Z",
    "level": "error",
    "audit": False,
    "field": "userId",
    "value": "7",
}
CUTOFFS = ("2024-01-16T06:30:00.000Z", "2024-01-26T00:00:00.000Z")
NO_DAY = date(2024, 1, 1)
SPLIT_DAY = "2024-01-15"


def alert_policy() -> policies.AlertPolicy:
    return policies.create_policy(
        "demo",
        "http://alerts.invalid/hook",
        intervalMs=1_800_000,
        windowMinutes=60,
        errorThreshold=5,
        noLogsThresholdMinutes=7,
        cooldownMs=6_000_000,
        webhookRetryAttempts=3,
    )


def query(run: Callable[[Workspace], DataFrame]) -> Callable[[Workspace], DataFrame]:
    QUERIES[run.__name__] = lambda spark, sf_dir: run(Workspace.of(spark, sf_dir))
    return run


# ---- lines, parsing, files -------------------------------------------------------


@query
def ingest_roundtrip(w: Workspace) -> DataFrame:
    entries = entries_from_lines(w.lines(), NOW)
    return entries.select(
        folder_of().alias("folder"),
        "line_number",
        log_id().alias("log_id"),
        "timestamp",
        "level",
        "event",
        "message",
        "is_audit",
        F.try_element_at("fields", F.lit("userId")).alias("user_id"),
    )


def _odd_records(events: DataFrame) -> DataFrame:
    """Lines that exercise every normalisation rule, one form per event."""
    n = F.col("event_id").cast("string")
    forms = [
        '"timestamp":12345,"level":"","message":"m"',
        '"timestamp":"2024-01-01T00:00:00Z","level":"warn","event":"","message":""',
        '"timestamp":"","level":"Error","event":"e","message":1.50',
        '"timestamp":"t","message":{"b":1,"a":[true,null]}',
        '"timestamp":"t","event":"e","message":null',
        '"timestamp":"t","audit":" YES "',
        '"timestamp":"t","audit":0',
        '"timestamp":"t","audit":"maybe"',
        '"timestamp":"t","audit":null',
        '"timestamp":"t","level":3,"event":true,"message":"fallback"',
        '"timestamp":"t","message":true,"audit":2.5',
        '"timestamp":"t","level":"debug","event":"e","message":"\\u00fc \\"q\\""',
    ]
    form = F.array(*[F.lit(text) for text in forms])[(F.col("event_id") % len(forms)).cast("int")]
    path = F.when(F.col("event_id") % 5 == 0, "/logs/AUDIT/x.ndjson").otherwise("/logs/app/x.ndjson")
    return events.select(
        "event_id", path.alias("path"), F.concat(F.lit('﻿ {"n":'), n, F.lit(","), form, F.lit("}\t")).alias("line")
    )


@query
def normalize_records(w: Workspace) -> DataFrame:
    return entries_from_lines(_odd_records(w.table("events")), NOW).select(
        "event_id", "timestamp", "level", "event", "message", "is_audit"
    )


@query
def ingest_report(w: Workspace) -> DataFrame:
    listed = files.list_files(w.spark, w.logs, GLOB).agg(F.count("*").alias("files_scanned"))
    return reports.line_counts(classify_lines(w.lines())).join(listed)  # one row each


@query
def parse_error_report(w: Workspace) -> DataFrame:
    lines = classify_lines(w.lines()).withColumn("folder", folder_of())
    return reports.line_counts(lines, "folder")


@query
def file_scan_report(w: Workspace) -> DataFrame:
    listing = files.list_files(w.spark, w.logs, GLOB)
    return (
        listing.groupBy(folder_of().alias("folder"))
        .agg(F.count("*").alias("files"), F.count_if(F.col("length") > 0).alias("filled"))
        .orderBy("folder")
    )


def _day() -> Column:
    return F.regexp_extract("source_file", r"day=([0-9-]{10})", 1)


@query
def file_change_status(w: Workspace) -> DataFrame:
    listing = files.list_files(w.spark, w.logs, GLOB)
    case = F.substring(_day(), 9, 2).cast("int") % 6
    state = listing.withColumn("case", case)
    offset = F.col("length") + F.when(F.col("case") == 1, -10).when(F.col("case") == 3, 10).otherwise(0)
    touched = F.when(F.col("case") == 4, F.col("modified_at") - F.expr("interval 1 hour")).otherwise(F.col("modified_at"))
    gone = F.concat(F.when(F.col("case") == 5, F.lit("gone/")).otherwise(F.lit("")), F.col("source_file"))
    ledger = state.where("case <> 0").select(
        gone.alias("source_file"),
        offset.alias("byte_offset"),
        touched.alias("modified_at"),
        F.lit(0).alias("lines"),
        F.lit(0).alias("generation"),
    )
    return files.classify_changes(listing, ledger).select(folder_of().alias("folder"), "status")


# ---- search ----------------------------------------------------------------------


def _found(entries: DataFrame) -> DataFrame:
    return entries.select(log_id().alias("log_id"), "timestamp", "level", "event", "is_audit")


def _search(w: Workspace, **options) -> DataFrame:
    wanted = LogQuery(**options)
    return _found(search.matching(w.index.entries(wanted), wanted))


@query
def filter_time_range(w: Workspace) -> DataFrame:
    return _search(w, **RANGE)


@query
def filter_level(w: Workspace) -> DataFrame:
    return _search(w, level="warn")


@query
def filter_audit(w: Workspace) -> DataFrame:
    return _search(w, audit=True)


@query
def filter_field_value(w: Workspace) -> DataFrame:
    return _search(w, field="correlationId", value="CORR-7")


@query
def filter_combined(w: Workspace) -> DataFrame:
    return _search(w, **COMBINED)


@query
def filter_field_semi_join(w: Workspace) -> DataFrame:
    entries = w.index.entries()
    found = fields.semi_join_field(entries, fields.field_rows(entries), LogQuery(level="ERROR", field="userId", value="7"))
    return _found(found)


def _page(entries: DataFrame) -> DataFrame:
    data = F.parse_json("data_json")
    return entries.select(
        F.variant_get(data, "$.id", "bigint").alias("log_id"),
        "timestamp",
        "level",
        "event",
        "message",
        F.variant_get(data, "$.userId", "string").alias("user_id"),
        F.variant_get(data, "$.context.k", "int").alias("context_k"),
    )


@query
def page_first(w: Workspace) -> DataFrame:
    return _page(w.index.page_frame(LogQuery(limit=100)))


@query
def page_next(w: Workspace) -> DataFrame:
    first = w.index.page(LogQuery(limit=100))
    return _page(w.index.page_frame(LogQuery(limit=100, cursor=first.next_cursor)))


@query
def count_filtered(w: Workspace) -> DataFrame:
    wanted = LogQuery(**COMBINED)
    return search.count_logs(w.index.entries(wanted), wanted)


def _buckets(w: Workspace, group_by: str, group_field: str | None = None, **options) -> DataFrame:
    return w.index.aggregate(LogQuery(**options), group_by, group_field)


@query
def aggregate_level(w: Workspace) -> DataFrame:
    return _buckets(w, "level")


@query
def aggregate_event(w: Workspace) -> DataFrame:
    return _buckets(w, "event")


@query
def aggregate_field(w: Workspace) -> DataFrame:
    return _buckets(w, "field", "k", limit=40)


@query
def aggregate_correlation(w: Workspace) -> DataFrame:
    return _buckets(w, "correlation", limit=1000)


@query
def aggregate_filtered(w: Workspace) -> DataFrame:
    return _buckets(w, "field", "userId", level="error", audit=False, **RANGE)


@query
def correlation_by_join(w: Workspace) -> DataFrame:
    entries = w.index.entries().withColumn("id", log_id())
    return fields.correlation_by_join(entries, fields.field_rows(entries)).select(F.col("id").alias("log_id"), "key")


@query
def field_index(w: Workspace) -> DataFrame:
    return fields.field_rows(w.index.entries().withColumn("id", log_id()))


@query
def index_stats(w: Workspace) -> DataFrame:
    return w.index.stats().select("entry_count", "field_count")


@query
def audit_classify(w: Workspace) -> DataFrame:
    values = ["true", '"No"', '" yes"', "0", "-1", '"1"', '"maybe"', "null", "[]"]
    value = F.array(*[F.lit(text) for text in values])[(F.col("event_id") % len(values)).cast("int")]
    paths = ["/logs/app/x.ndjson", "/logs/audit/x.ndjson", "/logs/app/my-Audit.ndjson", "/logs/audits/x.ndjson"]
    path = F.array(*[F.lit(text) for text in paths])[(F.col("event_id") % len(paths)).cast("int")]
    lines = w.table("events").select(
        "event_id", path.alias("path"), F.concat(F.lit('{"audit":'), value, F.lit("}")).alias("line")
    )
    return entries_from_lines(lines, NOW).select(
        "event_id", "is_audit", is_audit_file(F.col("path")).alias("is_audit_file")
    )


# ---- index maintenance -----------------------------------------------------------


@query
def insert_ignore_counts(w: Workspace) -> DataFrame:
    rows = to_rows(w.lines(), NOW, 0)
    known = rows.where((F.col("line_kind") == INGESTED) & (_day() <= SPLIT_DAY))
    added = ignore_known(rows, known, files.list_files(w.spark, w.logs, GLOB))

    def by_folder(table: DataFrame, out: str) -> DataFrame:
        is_record = F.col("line_kind") == INGESTED
        return table.groupBy(folder_of().alias("folder")).agg(F.count_if(is_record).alias(out))

    return (
        by_folder(rows, "records")
        .join(by_folder(added, "records_inserted"), "folder", "left")
        .select(
            "folder",
            F.coalesce("records_inserted", F.lit(0)).alias("records_inserted"),
            (F.col("records") - F.coalesce("records_inserted", F.lit(0))).alias("records_skipped"),
        )
    )


@query
def replace_source_file(w: Workspace) -> DataFrame:
    index = w.new_index("replaced")
    index.index_directory(w.logs, NOW, GLOB)
    doomed = files.list_files(w.spark, w.logs, GLOB).where(_day().isin("2024-01-05", "2024-01-06"))
    report = index.delete_source_files(doomed.select("source_file"))
    return (
        index.entries()
        .groupBy(folder_of().alias("folder"))
        .agg(F.count("*").alias("entries_left"))
        .withColumns({name: F.lit(value) for name, value in report.items()})
    )


REPORT_DDL = (
    "run int, mode string, files_scanned bigint, lines_scanned bigint, records_inserted bigint, "
    "records_skipped bigint, parse_errors bigint"
)


def _reports(w: Workspace, found: list[dict]) -> DataFrame:
    names = [part.split()[0] for part in REPORT_DDL.split(", ")]
    return w.spark.createDataFrame([tuple({"run": n, **r}[name] for name in names) for n, r in enumerate(found)], REPORT_DDL)


@query
def incremental_append(w: Workspace) -> DataFrame:
    root = scratch_path(w.spark, "growing")
    lines = event_lines(w.table("events"))
    index = w.new_index("incremental")
    write_lines(lines.where(F.col("day") <= SPLIT_DAY), f"{root}/first")
    found = [index.index_incremental(root, NOW, GLOB)]
    write_lines(lines.where(F.col("day") > SPLIT_DAY), f"{root}/second")
    found += [index.index_incremental(root, NOW, GLOB) for _ in range(2)]
    return _reports(w, found)


@query
def reindex_report(w: Workspace) -> DataFrame:
    index = w.new_index("reindexed")
    first = index.index_directory(w.logs, NOW, GLOB)
    result = index.reindex(w.logs, NOW, GLOB)
    return _reports(w, [first, result["report"]]).withColumns({k: F.lit(v) for k, v in result["reset"].items()})


# ---- ingest ----------------------------------------------------------------------


def _parsed(w: Workspace) -> DataFrame:
    return payloads.parse_requests(payloads.assign_producers(w.requests(), w.producers()), MAX_BYTES)


@query
def producer_assignment(w: Workspace) -> DataFrame:
    return payloads.assign_producers(w.requests(), w.producers()).select("request_id", "producer_id")


@query
def ingest_payload_explode(w: Workspace) -> DataFrame:
    records = payloads.explode_records(_parsed(w))
    return records.select(
        "request_id", "position", F.try_variant_get("record", "$.id", "bigint").alias("log_id")
    )


@query
def ingest_stamp_override(w: Workspace) -> DataFrame:
    stamped = ingest.stamp_records(payloads.explode_records(_parsed(w))).where(F.col("line").isNotNull())
    names = {"log_id": "id", "event": "event", "producer_id": "producerId", "ingested_at": "ingestedAt"}
    return stamped.select(
        "request_id",
        "position",
        *[F.get_json_object("line", f"$.{key}").alias(out) for out, key in names.items()],
    )


@query
def ingest_request_report(w: Workspace) -> DataFrame:
    return ingest.request_report(_parsed(w))


@query
def producer_day_counts(w: Workspace) -> DataFrame:
    root = scratch_path(w.spark, "producers")
    stamped = ingest.stamp_records(payloads.explode_records(_parsed(w)))
    for _ in range(2):  # repeating a batch adds nothing
        ingest.write_producer_files(stamped, root, "batch-0", NOW)
    lines = w.spark.read.text(f"{root}/{ingest.INGEST_FOLDER}")
    return lines.groupBy("producer", F.col("day").cast("string").alias("day")).agg(F.count("*").alias("records"))


@query
def producer_map_validate(w: Workspace) -> DataFrame:
    forms = ["a-{u}=p-{u}, b=q", "=x, a=p", "a=, b=q ,,", "t=p-{u},t=r", "a= -bad,b=ok.id", "a = p , b=q=r", "nothing", " , "]
    users = w.table("events").select("user_id").distinct()
    form = F.array(*[F.lit(text) for text in forms])[(F.col("user_id") % len(forms)).cast("int")]
    lists = users.select(
        F.col("user_id").alias("config_id"),
        F.replace(form, F.lit("{u}"), F.col("user_id").cast("string")).alias("mapping"),
    )
    return ingest.parse_producer_mappings(lists).select("config_id", "position", "entry", "problem")


# ---- retention -------------------------------------------------------------------


@query
def retention_prune(w: Workspace) -> DataFrame:
    return _found(retention.kept_entries(w.index.entries(), *CUTOFFS))


@query
def retention_report(w: Workspace) -> DataFrame:
    return retention.prune_report(w.index.entries(), *CUTOFFS)


def _aged_listing(w: Workspace) -> DataFrame:
    """The log files with the start of their day as modification time."""
    stamp = F.to_timestamp(F.concat(_day(), F.lit("T00:00:00+00:00")))
    return files.list_files(w.spark, w.logs, GLOB).withColumn("modified_at", stamp)


@query
def file_retention_plan(w: Workspace) -> DataFrame:
    plan = retention.expired_files(_aged_listing(w), NOW, 20, 10)
    return plan.select(folder_of().alias("folder"), "is_audit_file")


@query
def expired_audit_archive(w: Workspace) -> DataFrame:
    backup = scratch_path(w.spark, "backup")
    plan = retention.expired_files(_aged_listing(w), NOW, 0, 10).where("is_audit_file")
    copies = retention.archive_files(plan, w.logs, backup)
    return copies.select(folder_of().alias("folder"), "ok")


# ---- alerts ----------------------------------------------------------------------


def _counts(w: Workspace) -> DataFrame:
    """Replay from the first interval that begins after midnight of the first day to the end of the day after the last."""
    entries, policy = w.index.entries(), alert_policy()
    first, last = entries.agg(F.min("event_date"), F.max("event_date")).head()
    days = (last - first).days + 2 if first else 0
    start = to_iso(datetime.combine(first or NO_DAY, time(), timezone.utc) + timedelta(milliseconds=policy.intervalMs))
    return alerts.replay_counts(entries, policy, start, round(days * 86_400_000 / policy.intervalMs))


@query
def alert_lookback_counts(w: Workspace) -> DataFrame:
    return _counts(w)


def _rule(w: Workspace, rule: str) -> DataFrame:
    return alerts.triggers(_counts(w), alert_policy()).where(F.col("rule") == rule)


@query
def alert_error_threshold(w: Workspace) -> DataFrame:
    return _rule(w, alerts.ERROR_THRESHOLD).select(
        "tick",
        "triggered_at",
        "severity",
        F.try_element_at("details", F.lit("errorCount")).cast("bigint").alias("error_count"),
        F.try_element_at("details", F.lit("totalWindowCount")).cast("bigint").alias("total_count"),
    )


@query
def alert_no_logs(w: Workspace) -> DataFrame:
    return _rule(w, alerts.NO_LOGS).select("tick", "triggered_at", "severity")


def _alerts(w: Workspace) -> DataFrame:
    return alerts.apply_cooldown(alerts.triggers(_counts(w), alert_policy()), alert_policy())


@query
def alert_cooldown(w: Workspace) -> DataFrame:
    return _alerts(w).select("rule", "tick", "status")


@query
def alert_state_summary(w: Workspace) -> DataFrame:
    state = alerts.alert_state(_alerts(w))
    return state.select(
        "policy_id",
        "sent",
        "suppressed",
        *[
            F.try_element_at("last_trigger_by_rule", F.lit(rule)).alias(f"last_{rule}")
            for rule in (alerts.ERROR_THRESHOLD, alerts.NO_LOGS)
        ],
    )


@query
def alert_delivery_plan(w: Workspace) -> DataFrame:
    replies = [[204], [500, 204], [500, 429, 200], [400, 200], [503, 408, 0], [0, 301]]
    options = F.array(*[F.array(*[F.lit(code) for code in codes]) for codes in replies])
    due = _alerts(w).where(F.col("status") == alerts.SENT)
    due = due.withColumn("replies", options[(F.col("tick") % len(replies)).cast("int")])
    return alerts.delivery_plan(due, alert_policy()).select("rule", "tick", "attempts", "outcome", "wait_ms")


@query
def policy_apply_updates(w: Workspace) -> DataFrame:
    forms = [
        '{"enabled":"yes","intervalMs":1500}',
        '{"webhookUrl":"  http://new/{u} ","windowMinutes":"7"}',
        '{"webhookUrl":null}',
        '{"enabled":true,"webhookUrl":null}',
        '{"errorThreshold":0}',
        '{"cooldownMs":"soon"}',
        '{"nope":1}',
        "[1]",
        "{}",
        '{"webhookRetryAttempts":4.9,"noLogsThresholdMinutes":true}',
        '{"enabled":"maybe"}',
        '{"webhookUrl":5}',
    ]
    users = w.table("events").select("user_id").distinct()
    defaults = policies.create_policy()
    current = users.select(
        F.col("user_id").cast("string").alias("policy_id"),
        (F.col("user_id") % 5 != 0).alias("enabled"),
        F.when(F.col("user_id") % 5 != 0, F.concat(F.lit("http://old/"), "user_id")).alias("webhookUrl"),
        *[F.lit(getattr(defaults, name)).alias(name) for name in policies.NUMBER_FIELDS],
    )
    user, texts = F.col("user_id"), F.array(*[F.lit(text) for text in forms])
    turns = F.array(user % len(forms), (user + 5) % len(forms), (user * 7 + 1) % len(forms))  # three updates, one after another
    updates = users.where("user_id % 13 <> 0").select(
        F.col("user_id").cast("string").alias("policy_id"),
        F.posexplode(F.transform(turns, lambda n: F.get(texts, n.cast("int")))).alias("seq", "form"),
    )
    updates = updates.withColumn("payload", F.replace("form", F.lit("{u}"), F.col("policy_id"))).drop("form")
    updated = policies.apply_policy_updates(current, policies.parse_policy_updates(updates))
    shown = policies.masked(updated.withColumn("_url", F.col("webhookUrl")))
    return shown.withColumnsRenamed({"webhookUrl": "masked_url", "_url": "webhookUrl"})


# ---- reports ---------------------------------------------------------------------


def _daily_runs(w: Workspace) -> DataFrame:
    """One ingest run per day of the logs, with the counters of that day's lines; those of every tenth day failed."""
    days = reports.line_counts(classify_lines(w.lines()).withColumn("day", _day()), "day")
    failed = F.col("day").endswith("0")
    values = {
        "run_seq": F.replace(F.col("day"), F.lit("-")).cast("bigint"),
        "kind": F.lit("ingest"),
        "mode": F.lit("incremental"),
        "status": F.when(failed, F.lit("failed")).otherwise(F.lit("finished")),
        "started_at": F.col("day"),
        "finished_at": F.col("day"),
        "last_id": F.lit(0),
        "counters": F.create_map(
            F.lit("lines_scanned"), "lines_scanned", F.lit("records_inserted"), "records", F.lit("parse_errors"), "parse_errors"
        ),
        "error": F.when(failed, F.concat(F.lit("lost on "), "day")),
        "duration_ms": F.col("lines_scanned"),
    }
    return days.select(*[values[f.name].cast(f.dataType).alias(f.name) for f in RUN_SCHEMA.fields])


@query
def run_totals(w: Workspace) -> DataFrame:
    return reports.run_totals(_daily_runs(w))


@query
def status_snapshot(w: Workspace) -> DataFrame:
    return reports.status_snapshot(w.index.stats(), _daily_runs(w), _alerts(w)).drop("approximate_size_bytes")


@query
def lineitem_buckets(w: Workspace) -> DataFrame:
    """Line items as log lines, parsed, normalised and counted by a field."""
    record = F.struct(
        iso_millis(F.col("l_shipdate")).alias("timestamp"),
        F.when(F.col("l_returnflag") == "R", "error").otherwise("info").alias("level"),
        F.lit("line.shipped").alias("event"),
        F.concat_ws("-", "l_orderkey", "l_linenumber").alias("message"),
        F.concat("l_returnflag", "l_linestatus").alias("state"),
        F.col("l_quantity").alias("quantity"),
    )
    lines = w.table("lineitem").select(F.lit("/logs/lineitem.ndjson").alias("path"), F.to_json(record).alias("line"))
    entries = entries_from_lines(lines, NOW)
    return aggregate_logs(entries, LogQuery(level="info", from_="1996-01-01"), "field", "quantity")


def queries() -> dict[str, Query]:
    return dict(QUERIES)
