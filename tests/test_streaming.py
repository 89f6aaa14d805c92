import json
import os
import time

import pytest
from conftest import line, write_lines
from pyspark.sql import functions as F

from logloom import LogIndex, LogQuery
from logloom.functions.normalize import entries_from_lines
from logloom.operators.alerts import AlertLog, Reply, apply_cooldown, replay_counts, triggers
from logloom.operators.policies import create_policy
from logloom.sources.payloads import DEFAULT_MAX_BODY_BYTES
from logloom.streaming.alert_stream import (
    alert_cycles,
    lookback_windows,
    read_triggers,
    silence_alerts,
    threshold_triggers,
    with_cooldown,
    write_triggers,
)
from logloom.streaming.journal import RunJournal
from logloom.streaming.ingest_stream import follow_files, ingest_requests

NOW = "2026-02-18T00:00:00.000Z"
ONCE = {"availableNow": True}


def content(index: LogIndex) -> list[tuple]:
    names = ("source_file", "line_number", "event", "generation")
    return sorted(tuple(row[name] for name in names) for row in index.entries().collect())


def test_follow_files_equals_batch(spark, tmp_path):
    logs = tmp_path / "logs"
    index = LogIndex(spark, str(tmp_path / "index"))

    def run():
        query = follow_files(index, str(logs), str(tmp_path / "checkpoint"), trigger=ONCE, now=lambda: NOW)
        query.awaitTermination(120)
        assert query.exception() is None

    write_lines(logs / "a.ndjson", line(event="one"), "oops", "", line(event="two"))
    write_lines(logs / "sub" / "b.ndjson", line(event="b1"), '{"event":', newline_at_end=False)
    write_lines(logs / "c.txt", line(event="ignored"))
    run()
    assert content(index) == [("a.ndjson", 1, "one", 0), ("a.ndjson", 4, "two", 0), ("sub/b.ndjson", 1, "b1", 0)]
    write_lines(logs / "a.ndjson", line(event="three"), append=True)
    write_lines(logs / "sub" / "b.ndjson", '"b2"}', append=True)
    run()
    run()
    assert index.runs().where("status = 'finished'").count() == 2
    batch = LogIndex(spark, str(tmp_path / "batch"))
    batch.index_directory(str(logs), NOW)
    assert content(index) == content(batch)

    write_lines(logs / "a.ndjson", line(event="fresh"))
    run()
    assert content(index) == [("a.ndjson", 1, "fresh", 1), ("sub/b.ndjson", 1, "b1", 0), ("sub/b.ndjson", 2, "b2", 0)]
    # The batch job takes over from the same ledger.
    write_lines(logs / "a.ndjson", line(event="later"), append=True)
    assert index.index_incremental(str(logs), NOW)["records_inserted"] == 1


def _lines_from(first: int, count: int) -> list[str]:
    return [line(event=f"e{n}") for n in range(first, first + count)]


@pytest.mark.parametrize("checkpoint", ["same", "new"])
def test_tail_goes_on_where_the_index_is(spark, tmp_path, checkpoint):
    """Bulk run, appends, files that vanish and return longer, and rotation: as one full scan."""
    logs = tmp_path / "logs"
    a, b = logs / "a.ndjson", logs / "b.ndjson"
    index = LogIndex(spark, str(tmp_path / "index"))
    runs = 0

    def run():
        nonlocal runs
        runs += 1
        place = tmp_path / (f"checkpoint{runs}" if checkpoint == "new" else "checkpoint")
        query = follow_files(index, str(logs), str(place), trigger=ONCE, now=lambda: NOW)
        query.awaitTermination(120)
        assert query.exception() is None

    def check(*expected):
        assert content(index) == sorted(expected)

    write_lines(a, *_lines_from(1, 2))
    index.index_directory(str(logs), NOW)
    write_lines(a, *_lines_from(3, 1), append=True)
    run()
    check(*[("a.ndjson", n, f"e{n}", 0) for n in (1, 2, 3)])
    write_lines(a, *_lines_from(4, 1), append=True)
    write_lines(b, *_lines_from(1, 4))
    run()
    run()
    both = [("a.ndjson", n, f"e{n}", 0) for n in range(1, 5)] + [("b.ndjson", n, f"e{n}", 0) for n in range(1, 5)]
    check(*both)
    b.unlink()
    run()
    check(*both)
    write_lines(b, *_lines_from(1, 6))
    run()
    both += [("b.ndjson", n, f"e{n}", 0) for n in (5, 6)]
    check(*both)
    write_lines(a, *_lines_from(9, 1))  # rotation: shorter than what was read
    run()
    check(("a.ndjson", 1, "e9", 1), *[row for row in both if row[0] == "b.ndjson"])
    write_lines(a, *_lines_from(10, 2), append=True)
    index.index_incremental(str(logs), NOW)
    run()
    check(*[("a.ndjson", n, f"e{n + 8}", 1) for n in (1, 2, 3)], *[row for row in both if row[0] == "b.ndjson"])


def test_request_stream(spark, tmp_path):
    schema = "request_id string, token string, basic_user string, payload string, received_at timestamp"
    inbox = tmp_path / "inbox"
    root, index = str(tmp_path / "logs"), LogIndex(spark, str(tmp_path / "index"))
    producers = spark.createDataFrame([("ingest-token", "frontend-web")], "token string, producer_id string")

    def put(name: str, *requests: dict) -> None:
        write_lines(inbox / name, *[json.dumps(r) for r in requests])

    def run():
        stream = spark.readStream.schema(schema).json(str(inbox))
        query = ingest_requests(
            stream, producers, root, index, "s1", str(tmp_path / "checkpoint"), DEFAULT_MAX_BODY_BYTES, ONCE, lambda: NOW
        )
        query.awaitTermination(120)
        assert query.exception() is None

    at = "2026-02-17T10:00:00.000Z"
    put(
        "1.json",
        {
            "request_id": "r1",
            "token": "ingest-token",
            "payload": json.dumps([{"event": "web.click", "producerId": "spoofed"}, "text"]),
            "received_at": at,
        },
        {"request_id": "r2", "token": "unknown", "payload": "[]", "received_at": at},
        {"request_id": "r3", "basic_user": "ops", "payload": '{"logs":[{"event":"ops.done"}]}', "received_at": at},
        {"request_id": "r4", "token": "ingest-token", "payload": '{"logs":[', "received_at": at},
    )
    run()
    put("2.json", {"request_id": "r5", "token": "ingest-token", "payload": '[{"event":"web.next"}]', "received_at": at})
    run()
    assert index.count(LogQuery(field="producerId", value="spoofed")) == 0
    assert index.count(LogQuery(field="producerId", value="frontend-web")) == 2
    assert index.count(LogQuery(field="ingestedAt", value=at)) == 3
    reports = spark.read.parquet(f"{root}/_reports")
    found = {r["request_id"]: (r["status"], r["accepted"], r["rejected"]) for r in reports.collect()}
    assert found == {
        "r1": ("ok", 1, 1),
        "r2": ("unauthorized", 0, 0),
        "r3": ("ok", 1, 0),
        "r4": ("invalid_json", 0, 0),
        "r5": ("ok", 1, 0),
    }


def _entries(stream):
    return entries_from_lines(stream.select(F.lit("/x").alias("path"), F.col("value").alias("line")), NOW)


def _run_to_table(frame, name, tmp_path):
    query = (
        frame.writeStream.format("memory")
        .queryName(name)
        .outputMode("append")
        .option("checkpointLocation", str(tmp_path / f"cp-{name}"))
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination(120)
    assert query.exception() is None
    return frame.sparkSession.table(name).collect()


def test_threshold_stream_equals_replay(spark, tmp_path):
    policy = create_policy("p", "http://x", intervalMs=60_000, windowMinutes=2, errorThreshold=2, cooldownMs=180_000)
    logs = tmp_path / "logs"
    for n in range(30):
        level = "ERROR" if n % 10 < 6 else "INFO"
        write_lines(logs / f"{n:02d}.ndjson", line(timestamp=f"2026-02-17T10:{n:02d}:30.500Z", level=level))
    write_lines(logs / "99.ndjson", line(timestamp="2026-02-17T11:30:00.000Z", level="INFO"))
    stream = _entries(spark.readStream.option("maxFilesPerTrigger", 8).text(str(logs)))
    found = threshold_triggers(lookback_windows(stream, policy), policy)
    writing = write_triggers(found, str(tmp_path / "triggers"), str(tmp_path / "cp-triggers"), ONCE)
    writing.awaitTermination(120)
    assert writing.exception() is None
    alerts = with_cooldown(read_triggers(spark, str(tmp_path / "triggers")), policy)
    live = {(r["rule"], r["tick_ms"], r["status"]) for r in _run_to_table(alerts, "threshold_alerts", tmp_path)}

    entries = _entries(spark.read.text(str(logs)))
    counts = replay_counts(entries, policy, "2026-02-17T10:00:00.000Z", 60)
    replay = apply_cooldown(triggers(counts, policy), policy).withColumn("ms", F.unix_millis(F.to_timestamp("triggered_at")))
    batch = {(r["rule"], r["ms"], r["status"]) for r in replay.collect()}
    assert live and live == batch


def test_panes_count_late_entries_like_the_replay(spark, tmp_path):
    """Windows that are no multiple of the interval, and entries that come late but within one look-back."""
    policy = create_policy("p", "http://x", intervalMs=60_000, windowMinutes=2.5, errorThreshold=1, cooldownMs=1000)
    logs = tmp_path / "logs"
    seconds = [10, 200, 130, 260, 150, 290, 410, 300, 395, 520, 470, 600, 30 * 60]  # in the order they come
    for n, at in enumerate(seconds):
        stamp = f"2026-02-17T10:{at // 60:02d}:{at % 60:02d}.000Z"
        write_lines(logs / f"{n:02d}.ndjson", line(timestamp=stamp, level="ERROR" if n % 3 else "INFO"))
        os.utime(logs / f"{n:02d}.ndjson", (1_700_000_000 + n, 1_700_000_000 + n))
    windows = lookback_windows(_entries(spark.readStream.option("maxFilesPerTrigger", 1).text(str(logs))), policy)
    shown = windows.select(F.unix_millis("window.start").alias("start"), F.unix_millis("window.end").alias("end"), "error_count", "total_count")
    found = {(r["start"], r["end"]): (r["error_count"], r["total_count"]) for r in _run_to_table(shown, "pane_windows", tmp_path)}
    zero, checked = 1771322400000, 0
    for (start, end), counts in found.items():
        assert end - start == 150_000
        inside = [n for n, at in enumerate(seconds) if start <= zero + at * 1000 < end]
        assert counts == (sum(n % 3 > 0 for n in inside), len(inside))
        checked += len(inside)
    assert checked >= 2 * (len(seconds) - 1)


def test_failed_streams_are_recorded(spark, tmp_path):
    index = LogIndex(spark, str(tmp_path / "index"))
    journal = RunJournal(index)
    spark.streams.addListener(journal)
    try:
        write_lines(tmp_path / "logs" / "a.ndjson", line(event="one"))
        query = follow_files(index, str(tmp_path / "logs"), str(tmp_path / "cp"), trigger=ONCE, now=lambda: 1 / 0)
        with pytest.raises(Exception, match="division by zero"):
            query.awaitTermination(120)
        for _ in range(100):
            if index.runs().count():
                break
            time.sleep(0.2)
    finally:
        spark.streams.removeListener(journal)
    (run,) = index.runs().collect()
    assert (run["kind"], run["status"]) == ("stream", "failed") and run["error"]


def _silence(spark, tmp_path, minutes, files_at_once, **options):
    """Alerts of a clock whose files hold the given minutes, read in that order."""
    policy = create_policy("p", "http://x", noLogsThresholdMinutes=1, cooldownMs=120_000)
    logs, clock = tmp_path / "logs", tmp_path / "clock"
    write_lines(logs / "1.ndjson", line(timestamp="2026-02-17T10:00:00.000Z"))
    for n, minute in enumerate(minutes):
        write_lines(clock / f"{n}.json", json.dumps({"timestamp": f"2026-02-17T10:{minute:02d}:00.000Z"}))
        os.utime(clock / f"{n}.json", (1_700_000_000 + n, 1_700_000_000 + n))
    stream = _entries(spark.readStream.text(str(logs)))
    ticks = spark.readStream.schema("timestamp timestamp").option("maxFilesPerTrigger", files_at_once).json(str(clock))
    rows = _run_to_table(silence_alerts(stream, ticks, policy, **options), f"silence_{tmp_path.name}", tmp_path)
    return sorted(((r["tick_ms"] - 1771322400000) // 60_000, r["status"]) for r in rows)


REPLAYED = [(2, "sent"), (3, "suppressed"), (4, "sent"), (5, "suppressed"), (6, "sent")]


def test_silence_stream(spark, tmp_path):
    assert _silence(spark, tmp_path, range(7), 3) == REPLAYED


def test_silence_stream_with_ticks_out_of_order(spark, tmp_path):
    found = _silence(spark, tmp_path, [1, 0, 3, 5, 2, 4, 6, 59], 1, max_delay_ms=180_000)
    assert found == REPLAYED  # the last tick is held


def test_a_tick_that_comes_too_late_is_skipped(spark, tmp_path):
    assert _silence(spark, tmp_path, [0, 5, 2, 6, 7], 1) == [(5, "sent"), (6, "suppressed"), (7, "sent")]


def test_alert_cycles(spark, tmp_path):
    logs, clock = tmp_path / "logs", tmp_path / "clock"
    write_lines(logs / "a.ndjson", line(timestamp="2026-02-17T10:00:00.000Z", level="error"))
    index = LogIndex(spark, str(tmp_path / "index"))
    index.index_directory(str(logs), NOW)
    policy = create_policy("p", "http://x", errorThreshold=1, cooldownMs=60_000)
    log, calls = AlertLog(spark, str(tmp_path / "alerts")), []

    def send(url, payload, timeout):
        calls.append(payload["rule"])
        return Reply(204)

    for n in (1, 2):
        write_lines(clock / f"{n}.json", json.dumps({"timestamp": f"2026-02-17T10:00:{n}0.000Z"}))
        ticks = spark.readStream.schema("timestamp timestamp").json(str(clock))
        options = {"clock": lambda: "2026-02-17T10:00:10.000Z"}
        query = alert_cycles(ticks, index, policy, log, str(tmp_path / "cp"), send, ONCE, **options)
        query.awaitTermination(120)
        assert query.exception() is None
    assert calls == ["error_threshold"]
    assert sorted(r["status"] for r in log.alerts().collect()) == ["sent", "suppressed"]
