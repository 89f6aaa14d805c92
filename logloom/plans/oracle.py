"""The same results in DuckDB SQL over the driver tables, for checking."""

from __future__ import annotations

_LOGS = """
logs AS (
  SELECT event_id + 1 AS id, event_id, user_id, value,
    strftime(ts, '%Y-%m-%dT%H:%M:%S.%gZ') AS timestamp,
    strftime(ts, '%Y-%m-%d') AS day,
    CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'purchase' THEN 'WARN' WHEN 'view' THEN 'DEBUG' ELSE 'INFO' END AS level,
    CASE event_type WHEN 'purchase' THEN 'warn' WHEN 'error' THEN 'ERROR' WHEN 'view' THEN 'DEBUG' ELSE 'INFO' END AS raw_level,
    'user.' || event_type AS event, event_type AS message,
    event_type = 'signup' AS is_audit,
    CAST(user_id AS VARCHAR) AS user_text,
    json_extract_string(props, '$.k') AS k,
    CASE WHEN event_id % 3 = 0 THEN 'CORR-' || user_id END AS correlation_id,
    CASE WHEN event_id % 5 <> 0 THEN 'REQ-' || (event_id // 4) END AS request_id,
    (CASE WHEN event_type = 'signup' THEN 'audit' ELSE 'app' END)
      || '/day=' || strftime(ts, '%Y-%m-%d') || '/chunk=' || (event_id // 250000) AS folder
  FROM events),
all_lines AS (
  SELECT *, 0 AS pos, 'record' AS kind FROM logs
  UNION ALL SELECT *, 1, 'parse_error' FROM logs WHERE event_id % 97 = 0
  UNION ALL SELECT *, 2, 'blank' FROM logs WHERE event_id % 89 = 0)
"""
_FIELDS = """
field_rows AS (
  SELECT id AS entry_id, 'id' AS key, CAST(id AS VARCHAR) AS value_text FROM logs
  UNION ALL SELECT id, 'timestamp', timestamp FROM logs
  UNION ALL SELECT id, 'level', raw_level FROM logs
  UNION ALL SELECT id, 'event', event FROM logs
  UNION ALL SELECT id, 'message', message FROM logs
  UNION ALL SELECT id, 'audit', CAST(is_audit AS VARCHAR) FROM logs WHERE event_id % 2 = 0
  UNION ALL SELECT id, 'userId', user_text FROM logs
  UNION ALL SELECT id, 'k', k FROM logs WHERE k IS NOT NULL
  UNION ALL SELECT id, 'value', regexp_replace(CAST(value AS VARCHAR), '\\.0$', '') FROM logs WHERE value IS NOT NULL
  UNION ALL SELECT id, 'correlationId', correlation_id FROM logs WHERE correlation_id IS NOT NULL
  UNION ALL SELECT id, 'requestId', request_id FROM logs WHERE request_id IS NOT NULL)
"""
_NOW = "2024-02-01T00:00:00.000Z"
_COMBINED = """timestamp >= '2024-01-05T00:00:00.000Z' AND timestamp <= '2024-01-25T00:00:00.000Z'
  AND level = 'ERROR' AND NOT is_audit AND user_text = '7'"""
_RANGE = "timestamp >= '2024-01-10' AND timestamp <= '2024-01-12T12:00:00.000Z'"
_EXPIRED = """((NOT is_audit AND timestamp < '2024-01-16T06:30:00.000Z')
  OR (is_audit AND timestamp < '2024-01-26T00:00:00.000Z'))"""


def _with(*parts: str, select: str, recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' if recursive else ''}{', '.join(p.strip() for p in parts)} {select}"


def _logs(select: str) -> str:
    return _with(_LOGS, select=select)


def _found(where: str) -> str:
    return _logs(f"SELECT id AS log_id, timestamp, level, event, is_audit FROM logs WHERE {where}")


def _page(offset: int) -> str:
    return _logs(
        "SELECT id AS log_id, timestamp, level, event, message, user_text AS user_id, CAST(k AS INTEGER) AS context_k "
        f"FROM logs ORDER BY timestamp DESC, id DESC LIMIT 100 OFFSET {offset}"
    )


def _buckets(key: str, limit: int, where: str = "true") -> str:
    return _logs(
        f"SELECT {key} AS key, count(*) AS count FROM logs WHERE {where} GROUP BY 1 ORDER BY count DESC, key ASC LIMIT {limit}"
    )


_CORRELATION = "coalesce(correlation_id, request_id, '(missing)')"

_REQUESTS = """
parts AS (
  SELECT user_id, event_id // 500 AS part, max(ts) AS last,
    '[' || string_agg(CASE WHEN event_id % 13 = 0 THEN '"just text"'
      ELSE '{"id":' || event_id || ',"event":"' || event_type || '","producerId":"spoof"}' END, ',' ORDER BY event_id) || ']' AS body
  FROM events GROUP BY 1, 2),
requests AS (
  SELECT user_id, part, user_id || '-' || part AS request_id, last, (user_id + part) % 10 AS kind,
    CASE (user_id + part) % 10 WHEN 1 THEN '{"logs":' || body || '}' WHEN 2 THEN '{"logs":' || body
      WHEN 3 THEN '{"items":' || body || '}' WHEN 4 THEN '  ' WHEN 5 THEN body || repeat(' ', 4096) ELSE body END AS payload,
    CASE WHEN user_id % 11 = 0 THEN 'basic-' || user_id
      WHEN user_id % 7 <> 0 AND user_id % 4 < 3 THEN 'producer-' || (user_id % 4) END AS producer_id
  FROM parts),
checked AS (
  SELECT *, CASE WHEN producer_id IS NULL THEN 'unauthorized' WHEN strlen(payload) > 4096 THEN 'too_large'
    WHEN kind = 2 THEN 'invalid_json' WHEN kind = 3 THEN 'invalid_payload' ELSE 'ok' END AS status FROM requests),
records AS (
  SELECT c.request_id, c.producer_id, c.last, e.event_id, e.event_type, e.event_id % 13 <> 0 AS is_object,
    row_number() OVER (PARTITION BY c.request_id ORDER BY e.event_id) - 1 AS position
  FROM checked c JOIN events e ON e.user_id = c.user_id AND e.event_id // 500 = c.part
  WHERE c.status = 'ok' AND c.kind <> 4)
"""

_TICKS = """
ticks AS (
  SELECT n AS tick, strftime(t, '%Y-%m-%dT%H:%M:%S.%gZ') AS triggered_at,
    strftime(t - INTERVAL 60 MINUTE, '%Y-%m-%dT%H:%M:%S.%gZ') AS window_start,
    strftime(t - INTERVAL 7 MINUTE, '%Y-%m-%dT%H:%M:%S.%gZ') AS quiet_start
  FROM (SELECT n, first + (n + 1) * INTERVAL 30 MINUTE AS t
    FROM (SELECT date_trunc('day', min(ts)) AS first, unnest(range(48 * (date_diff('day', min(ts), max(ts)) + 2))) AS n FROM events) d)),
counts AS (
  SELECT t.tick, any_value(t.triggered_at) AS triggered_at,
    count(*) FILTER (WHERE l.level = 'ERROR') AS error_count,
    count(l.id) AS total_count,
    count(l.id) FILTER (WHERE l.timestamp >= t.quiet_start) AS silence_count
  FROM ticks t LEFT JOIN logs l ON l.timestamp >= t.window_start AND l.timestamp <= t.triggered_at
  GROUP BY t.tick),
fired AS (
  SELECT tick, triggered_at, 'error_threshold' AS rule FROM counts WHERE error_count >= 5
  UNION ALL SELECT tick, triggered_at, 'no_logs' FROM counts WHERE silence_count = 0)
"""
# A cooldown of 100 minutes is four ticks of 30.
_SENDS = """
sends AS (
  SELECT rule, min(tick) AS tick FROM fired GROUP BY rule
  UNION ALL
  SELECT rule, next FROM (
    SELECT s.rule, (SELECT min(f.tick) FROM fired f WHERE f.rule = s.rule AND f.tick >= s.tick + 4) AS next FROM sends s)
  WHERE next IS NOT NULL),
alerts AS (
  SELECT f.rule, f.tick, f.triggered_at, CASE WHEN s.tick IS NULL THEN 'suppressed' ELSE 'sent' END AS status
  FROM fired f LEFT JOIN sends s ON s.rule = f.rule AND s.tick = f.tick)
"""


def _alerts(select: str) -> str:
    return _with(_LOGS, _TICKS, _SENDS, select=select, recursive=True)


_COUNTS = """count(*) AS lines_scanned, count(*) FILTER (WHERE kind = 'record') AS records,
  count(*) FILTER (WHERE kind = 'parse_error') AS parse_errors, count(*) FILTER (WHERE kind = 'blank') AS blank_lines"""
_DAY_CASE = "CAST(day_number AS INTEGER) % 6"


def oracle_sql() -> dict[str, str]:
    return {
        "ingest_roundtrip": _with(
            _LOGS,
            "numbered AS (SELECT *, row_number() OVER (PARTITION BY folder ORDER BY event_id, pos) AS line_number FROM all_lines)",
            select="SELECT folder, line_number, id AS log_id, timestamp, level, event, message, is_audit, "
            "user_text AS user_id FROM numbered WHERE pos = 0",
        ),
        "normalize_records": f"""
            SELECT event_id,
              CASE f WHEN 0 THEN '{_NOW}' WHEN 1 THEN '2024-01-01T00:00:00Z' WHEN 2 THEN '{_NOW}' ELSE 't' END AS timestamp,
              CASE f WHEN 1 THEN 'WARN' WHEN 2 THEN 'ERROR' WHEN 11 THEN 'DEBUG' ELSE 'INFO' END AS level,
              CASE WHEN f = 0 THEN 'm' WHEN f IN (2, 4, 11) THEN 'e' WHEN f = 9 THEN 'fallback' ELSE 'log.event' END AS event,
              CASE f WHEN 0 THEN 'm' WHEN 2 THEN '1.5' WHEN 3 THEN '{{"b":1,"a":[true,null]}}' WHEN 9 THEN 'fallback'
                WHEN 10 THEN 'true' WHEN 11 THEN 'ü "q"' ELSE '' END AS message,
              CASE WHEN f IN (5, 10) THEN true WHEN f = 6 THEN false ELSE event_id % 5 = 0 END AS is_audit
            FROM (SELECT event_id, event_id % 12 AS f FROM events)""",
        "ingest_report": _logs(f"SELECT {_COUNTS}, count(DISTINCT folder) AS files_scanned FROM all_lines"),
        "parse_error_report": _logs(f"SELECT folder, {_COUNTS} FROM all_lines GROUP BY folder"),
        "file_scan_report": _logs("SELECT folder, 1 AS files, 1 AS filled FROM logs GROUP BY folder ORDER BY folder"),
        "file_change_status": _with(
            _LOGS,
            "folders AS (SELECT folder, day[9:10] AS day_number FROM logs GROUP BY ALL)",
            select=f"""
            SELECT folder, CASE {_DAY_CASE} WHEN 1 THEN 'appended' WHEN 2 THEN 'unchanged' WHEN 3 THEN 'rewritten'
              WHEN 4 THEN 'rewritten' ELSE 'new' END AS status FROM folders
            UNION ALL SELECT 'gone/' || folder, 'vanished' FROM folders WHERE {_DAY_CASE} = 5""",
        ),
        "filter_time_range": _found(_RANGE),
        "filter_level": _found("level = 'WARN'"),
        "filter_audit": _found("is_audit"),
        "filter_field_value": _found("correlation_id = 'CORR-7'"),
        "filter_combined": _found(_COMBINED),
        "filter_field_semi_join": _with(
            _LOGS,
            _FIELDS,
            select="SELECT id AS log_id, timestamp, level, event, is_audit FROM logs WHERE level = 'ERROR' AND EXISTS "
            "(SELECT 1 FROM field_rows f WHERE f.entry_id = id AND f.key = 'userId' AND f.value_text = '7')",
        ),
        "page_first": _page(0),
        "page_next": _page(100),
        "count_filtered": _logs(f"SELECT count(*) AS count FROM logs WHERE {_COMBINED}"),
        "aggregate_level": _buckets("level", 25),
        "aggregate_event": _buckets("event", 25),
        "aggregate_field": _buckets("coalesce(k, '(missing)')", 40),
        "aggregate_correlation": _buckets(_CORRELATION, 1000),
        "aggregate_filtered": _buckets("user_text", 25, f"{_RANGE} AND level = 'ERROR' AND NOT is_audit"),
        "correlation_by_join": _logs(f"SELECT id AS log_id, {_CORRELATION} AS key FROM logs"),
        "field_index": _with(_LOGS, _FIELDS, select="SELECT entry_id, key, value_text FROM field_rows"),
        "index_stats": _with(
            _LOGS,
            _FIELDS,
            select="SELECT (SELECT count(*) FROM logs) AS entry_count, (SELECT count(*) FROM field_rows) AS field_count",
        ),
        "audit_classify": """
            SELECT event_id,
              CASE WHEN event_id % 9 IN (0, 2, 4, 5) THEN true WHEN event_id % 9 IN (1, 3) THEN false
                ELSE event_id % 4 = 1 END AS is_audit,
              event_id % 4 IN (1, 2) AS is_audit_file
            FROM events""",
        "insert_ignore_counts": _logs(
            "SELECT folder, count(*) FILTER (WHERE day > '2024-01-15') AS records_inserted, "
            "count(*) FILTER (WHERE day <= '2024-01-15') AS records_skipped FROM logs GROUP BY folder"
        ),
        "replace_source_file": _with(
            _LOGS,
            _FIELDS,
            "doomed AS (SELECT id FROM logs WHERE day IN ('2024-01-05', '2024-01-06'))",
            select="""
            SELECT folder, count(*) AS entries_left, (SELECT count(*) FROM doomed) AS entries_deleted,
              (SELECT count(*) FROM field_rows WHERE entry_id IN (SELECT id FROM doomed)) AS fields_deleted
            FROM logs WHERE day NOT IN ('2024-01-05', '2024-01-06') GROUP BY folder""",
        ),
        "incremental_append": _with(
            _LOGS,
            "passes AS (SELECT *, CASE WHEN day <= '2024-01-15' THEN 0 ELSE 1 END AS run FROM all_lines)",
            select="""
            SELECT r.run, 'incremental' AS mode,
              (SELECT count(DISTINCT folder) FROM passes p WHERE p.run <= r.run) AS files_scanned,
              (SELECT count(*) FROM passes p WHERE p.run = r.run) AS lines_scanned,
              (SELECT count(*) FROM passes p WHERE p.run = r.run AND kind = 'record') AS records_inserted,
              0 AS records_skipped,
              (SELECT count(*) FROM passes p WHERE p.run = r.run AND kind = 'parse_error') AS parse_errors
            FROM range(3) r(run)""",
        ),
        "reindex_report": _with(
            _LOGS,
            _FIELDS,
            select="""
            SELECT r.run, 'full' AS mode, (SELECT count(DISTINCT folder) FROM logs) AS files_scanned,
              (SELECT count(*) FROM all_lines) AS lines_scanned, (SELECT count(*) FROM logs) AS records_inserted,
              0 AS records_skipped, (SELECT count(*) FROM all_lines WHERE kind = 'parse_error') AS parse_errors,
              (SELECT count(*) FROM logs) AS entries_deleted, (SELECT count(*) FROM field_rows) AS fields_deleted
            FROM range(2) r(run)""",
        ),
        "producer_assignment": _with(_REQUESTS, select="SELECT request_id, producer_id FROM requests"),
        "ingest_payload_explode": _with(
            _REQUESTS, select="SELECT request_id, position, CASE WHEN is_object THEN event_id END AS log_id FROM records"
        ),
        "ingest_stamp_override": _with(
            _REQUESTS,
            select="""
            SELECT request_id, position, CAST(event_id AS VARCHAR) AS log_id, event_type AS event, producer_id,
              strftime(last, '%Y-%m-%dT%H:%M:%S.%gZ') AS ingested_at FROM records WHERE is_object""",
        ),
        "ingest_request_report": _with(
            _REQUESTS,
            select="""
            SELECT c.request_id, c.producer_id, c.status,
              count(r.event_id) FILTER (WHERE r.is_object) AS accepted,
              count(r.event_id) FILTER (WHERE NOT r.is_object) AS rejected
            FROM checked c LEFT JOIN records r ON r.request_id = c.request_id GROUP BY 1, 2, 3""",
        ),
        "producer_day_counts": _with(
            _REQUESTS,
            select="SELECT producer_id AS producer, '2024-02-01' AS day, count(*) AS records FROM records "
            "WHERE is_object GROUP BY 1",
        ),
        "producer_map_validate": """
            WITH users AS (SELECT DISTINCT user_id AS u FROM events),
            entries(f, position, entry, problem) AS (VALUES
              (0, 0, 'a-{u}=p-{u}', NULL), (0, 1, 'b=q', NULL),
              (1, 0, '=x', 'syntax'), (1, 1, 'a=p', NULL),
              (2, 0, 'a=', 'syntax'), (2, 1, 'b=q', NULL),
              (3, 0, 't=p-{u}', NULL), (3, 1, 't=r', 'duplicate'),
              (4, 0, 'a= -bad', 'producer_id'), (4, 1, 'b=ok.id', NULL),
              (5, 0, 'a = p', NULL), (5, 1, 'b=q=r', 'producer_id'),
              (6, 0, 'nothing', 'syntax'))
            SELECT u AS config_id, position, replace(entry, '{u}', CAST(u AS VARCHAR)) AS entry, problem
            FROM users JOIN entries ON f = u % 8""",
        "retention_prune": _found(f"NOT {_EXPIRED}"),
        "retention_report": _with(
            _LOGS,
            _FIELDS,
            select=f"""
            SELECT count(*) FILTER (WHERE NOT is_audit) AS normal_entries_deleted,
              count(*) FILTER (WHERE is_audit) AS audit_entries_deleted, count(*) AS entries_deleted,
              coalesce((SELECT count(*) FROM field_rows WHERE entry_id IN (SELECT id FROM logs WHERE {_EXPIRED})), 0) AS fields_deleted
            FROM logs WHERE {_EXPIRED}""",
        ),
        "file_retention_plan": _logs(
            "SELECT folder, is_audit AS is_audit_file FROM logs WHERE day < "
            "CASE WHEN is_audit THEN '2024-01-22' ELSE '2024-01-12' END GROUP BY ALL"
        ),
        "expired_audit_archive": _logs(
            "SELECT folder, true AS ok FROM logs WHERE is_audit AND day < '2024-01-22' GROUP BY folder"
        ),
        "alert_lookback_counts": _with(
            _LOGS, _TICKS, select="SELECT tick, triggered_at, error_count, total_count, silence_count FROM counts"
        ),
        "alert_error_threshold": _with(
            _LOGS,
            _TICKS,
            select="SELECT tick, triggered_at, 'critical' AS severity, error_count, total_count FROM counts "
            "WHERE error_count >= 5",
        ),
        "alert_no_logs": _with(
            _LOGS,
            _TICKS,
            select="SELECT tick, triggered_at, 'warning' AS severity FROM counts WHERE silence_count = 0",
        ),
        "alert_cooldown": _alerts("SELECT rule, tick, status FROM alerts"),
        "alert_state_summary": _alerts(
            """SELECT 'demo' AS policy_id, count(*) FILTER (WHERE status = 'sent') AS sent,
              count(*) FILTER (WHERE status = 'suppressed') AS suppressed,
              max(triggered_at) FILTER (WHERE status = 'sent' AND rule = 'error_threshold') AS last_error_threshold,
              max(triggered_at) FILTER (WHERE status = 'sent' AND rule = 'no_logs') AS last_no_logs
            FROM alerts"""
        ),
        "alert_delivery_plan": _alerts(
            """SELECT rule, tick,
              CASE tick % 6 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 3 WHEN 3 THEN 1 WHEN 4 THEN 3 ELSE 2 END AS attempts,
              CASE WHEN tick % 6 <= 2 THEN 'sent' ELSE 'failed' END AS outcome,
              CASE tick % 6 WHEN 1 THEN 250 WHEN 2 THEN 750 WHEN 4 THEN 750 WHEN 5 THEN 250 ELSE 0 END AS wait_ms
            FROM alerts WHERE status = 'sent'"""
        ),
        "policy_apply_updates": """
            WITH RECURSIVE state AS (
              SELECT user_id AS u, 0 AS n, user_id % 5 <> 0 AS enabled,
                CASE WHEN user_id % 5 <> 0 THEN 'http://old/' || user_id END AS url, 30000.0::DOUBLE AS interval_ms, 5.0::DOUBLE AS minutes,
                0.0::DOUBLE AS quiet, 3 AS attempts, false AS applied, CAST(NULL AS VARCHAR) AS problem, CAST(0 AS BIGINT) AS done
              FROM (SELECT DISTINCT user_id FROM events) users
              UNION ALL
              SELECT u, n + 1, CASE WHEN wrong IS NULL THEN new_on ELSE enabled END, CASE WHEN wrong IS NULL THEN new_url ELSE url END,
                CASE WHEN wrong IS NULL AND form = 0 THEN 1500.0 ELSE interval_ms END,
                CASE WHEN wrong IS NULL AND form = 1 THEN 7.0 ELSE minutes END,
                CASE WHEN wrong IS NULL AND form = 9 THEN 1.0 ELSE quiet END,
                CASE WHEN wrong IS NULL AND form = 9 THEN 4 ELSE attempts END,
                wrong IS NULL, wrong, done + CASE WHEN wrong IS NULL THEN 1 ELSE 0 END
              FROM (SELECT *, CASE
                    WHEN form = 4 THEN 'errorThreshold must be greater than or equal to 1.'
                    WHEN form = 5 THEN 'cooldownMs must be a finite number.'
                    WHEN form = 6 THEN 'Alert config payload includes unsupported field "nope".'
                    WHEN form = 7 THEN 'Alert config payload must be a JSON object.'
                    WHEN form = 8 THEN 'Alert config payload must include at least one updatable field.'
                    WHEN form = 10 THEN 'enabled must be a boolean.'
                    WHEN form = 11 THEN 'webhookUrl must be a string or null.'
                    WHEN new_on AND new_url IS NULL THEN 'webhookUrl must be configured when alerting is enabled.' END AS wrong
                  FROM (SELECT *, CASE form WHEN 0 THEN true WHEN 1 THEN true WHEN 2 THEN false WHEN 3 THEN true ELSE enabled END AS new_on,
                          CASE form WHEN 1 THEN 'http://new/' || u WHEN 2 THEN NULL WHEN 3 THEN NULL ELSE url END AS new_url
                        FROM (SELECT *, CASE n WHEN 0 THEN u % 12 WHEN 1 THEN (u + 5) % 12 ELSE (u * 7 + 1) % 12 END AS form
                              FROM state WHERE n < 3 AND u % 13 <> 0) drawn) tried) checked)
            SELECT CAST(u AS VARCHAR) AS policy_id, enabled, url AS "webhookUrl", interval_ms AS "intervalMs", minutes AS "windowMinutes",
              20.0::DOUBLE AS "errorThreshold", quiet AS "noLogsThresholdMinutes", 300000.0::DOUBLE AS "cooldownMs",
              5000.0::DOUBLE AS "webhookTimeoutMs", attempts AS "webhookRetryAttempts", 250.0::DOUBLE AS "webhookBackoffMs",
              applied, problem, done AS applied_updates, CAST(n AS BIGINT) AS updates,
              CASE WHEN url IS NOT NULL THEN '[configured]' END AS masked_url
            FROM state WHERE n = CASE WHEN u % 13 = 0 THEN 0 ELSE 3 END""",

        "run_totals": _with(
            _LOGS,
            f"daily AS (SELECT day, {_COUNTS} FROM all_lines WHERE day NOT LIKE '%0' GROUP BY day)",
            "pairs AS (SELECT day, 'lines_scanned' AS counter, lines_scanned AS value FROM daily "
            "UNION ALL SELECT day, 'records_inserted', records FROM daily "
            "UNION ALL SELECT day, 'parse_errors', parse_errors FROM daily)",
            select="""
            SELECT 'ingest' AS kind, counter, arg_max(value, day) AS last_run, CAST(sum(value) AS BIGINT) AS total,
              count(*) AS runs FROM pairs GROUP BY counter""",
        ),
        "status_snapshot": _with(
            _LOGS,
            _FIELDS,
            _TICKS,
            _SENDS,
            select="""
            SELECT (SELECT count(*) FROM logs) AS entry_count, (SELECT count(*) FROM field_rows) AS field_count,
              (SELECT count(DISTINCT day) FROM logs WHERE day NOT LIKE '%0') AS runs,
              (SELECT count(DISTINCT day) FROM logs WHERE day LIKE '%0') AS failed_runs,
              (SELECT max(day) FROM logs) AS last_run_at, (SELECT max(day) FROM logs WHERE day NOT LIKE '%0') AS last_success_at,
              (SELECT count(*) FROM all_lines WHERE day = (SELECT max(day) FROM logs)) AS last_duration_ms,
              (SELECT count(*) FROM logs WHERE day NOT LIKE '%0') AS records_inserted_total,
              (SELECT count(*) FROM all_lines WHERE kind = 'parse_error' AND day NOT LIKE '%0') AS parse_errors_total,
              (SELECT CASE WHEN max(day) LIKE '%0' THEN 'lost on ' || max(day) END FROM logs) AS last_error,
              (SELECT count(*) FROM alerts WHERE status = 'sent') AS alerts_sent,
              (SELECT count(*) FROM alerts WHERE status = 'suppressed') AS alerts_suppressed""",
            recursive=True,
        ),
        "lineitem_buckets": """
            SELECT regexp_replace(CAST(l_quantity AS VARCHAR), '\\.0$', '') AS key, count(*) AS count FROM lineitem
            WHERE l_returnflag <> 'R' AND l_shipdate >= TIMESTAMP '1996-01-01' GROUP BY 1
            ORDER BY count DESC, key ASC LIMIT 25""",
    }
