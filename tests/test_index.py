import os
import random

import pytest
from conftest import line, write_lines

from logloom import LogIndex, LogQuery
from logloom.operators import index as index_module
from logloom.operators.commit_log import CommitLog, ConcurrentWrite
from logloom.operators.filters import Cursor
from logloom.operators.search import result_json
from logloom.sources.files import list_files
from logloom.sources.lines import scan_lines
from pyspark.sql import functions as F

NOW = "2026-02-18T00:00:00.000Z"


def stamp(minute: int, second: int = 0) -> str:
    return f"2026-02-17T10:{minute:02d}:{second:02d}.000Z"


def counts(report: dict) -> tuple:
    return tuple(
        report[key] for key in ("files_scanned", "lines_scanned", "records_inserted", "records_skipped", "parse_errors")
    )


def events(index: LogIndex, **options) -> list[str]:
    return [row["event"] for row in index.page(LogQuery(**options)).entries]


def test_index_and_filters(spark, tmp_path):
    logs = tmp_path / "logs"
    write_lines(
        logs / "orders.ndjson",
        line(timestamp=stamp(0, 0), level="INFO", event="order.created", message="order.created", customerId="CUST-1"),
        "this-is-not-json",
        line(timestamp=stamp(0, 1), level="ERROR", event="order.failed", message="order.failed", customerId="CUST-1"),
        newline_at_end=False,
    )
    write_lines(
        logs / "nested" / "supplier.ndjson",
        line(timestamp=stamp(0, 2), level="INFO", event="supplier.viewed-orders", audit=True, customerId="CUST-2"),
        newline_at_end=False,
    )
    index = LogIndex(spark, str(tmp_path / "index"))
    assert counts(index.index_directory(str(logs), NOW)) == (2, 4, 3, 0, 1)
    assert counts(index.index_directory(str(logs), NOW)) == (2, 4, 0, 3, 1)

    assert sorted(events(index, field="customerId", value="CUST-1")) == ["order.created", "order.failed"]
    assert events(index, level="error") == ["order.failed"]
    assert events(index, audit=True) == ["supplier.viewed-orders"]
    assert index.count(LogQuery(field="customerId", value="CUST-1")) == 2
    assert index.count(LogQuery(field="customerId")) == 3
    row = result_json(index.entries().where("level = 'ERROR'")).head()
    assert '"customerId":"CUST-1"' in row["entry_json"] and '"sourceFile":"orders.ndjson"' in row["entry_json"]
    order = [(r["source_file"], r["line_number"]) for r in index.entries().orderBy("id").collect()]
    assert order == [("nested/supplier.ndjson", 1), ("orders.ndjson", 1), ("orders.ndjson", 3)]


def test_missing_folder(spark, tmp_path):
    index = LogIndex(spark, str(tmp_path / "index"))
    assert counts(index.index_directory(str(tmp_path / "nope"), NOW)) == (0, 0, 0, 0, 0)
    assert counts(index.index_incremental(str(tmp_path / "nope"), NOW)) == (0, 0, 0, 0, 0)
    assert index.entries().count() == 0
    assert index.stats().head().asDict() == {"entry_count": 0, "field_count": 0, "approximate_size_bytes": 0}


def test_incremental_append(spark, tmp_path):
    log = tmp_path / "logs" / "a.ndjson"
    write_lines(log, line(timestamp=stamp(0), level="INFO", event="order.created"))
    index = LogIndex(spark, str(tmp_path / "index"))
    first = index.index_incremental(str(log.parent), NOW)
    assert first["mode"] == "incremental" and counts(first) == (1, 1, 1, 0, 0)
    write_lines(log, line(timestamp=stamp(1), level="ERROR", event="order.failed"), append=True)
    assert counts(index.index_incremental(str(log.parent), NOW)) == (1, 1, 1, 0, 0)
    assert counts(index.index_incremental(str(log.parent), NOW)) == (1, 0, 0, 0, 0)
    assert index.count(LogQuery()) == 2
    assert [r["line_number"] for r in index.entries().orderBy("id").collect()] == [1, 2]


def test_unterminated_line_waits(spark, tmp_path):
    log = tmp_path / "logs" / "a.ndjson"
    write_lines(log, line(event="one"), '{"event":', newline_at_end=False)
    index = LogIndex(spark, str(tmp_path / "index"))
    assert counts(index.index_incremental(str(log.parent), NOW)) == (1, 1, 1, 0, 0)
    write_lines(log, '"two"}', append=True)
    assert counts(index.index_incremental(str(log.parent), NOW)) == (1, 1, 1, 0, 0)
    assert {r["event"] for r in index.entries().collect()} == {"one", "two"}

    other = LogIndex(spark, str(tmp_path / "other"))
    write_lines(log, line(event="three"), newline_at_end=False, append=True)
    report = other.index_incremental(str(log.parent), NOW, include_unterminated=True)
    assert counts(report) == (1, 3, 3, 0, 0)


def test_rewritten_file_replaces_its_entries(spark, tmp_path):
    log = tmp_path / "logs" / "a.ndjson"
    write_lines(log, line(timestamp=stamp(0), event="order.created", message="order.created " * 40))
    write_lines(tmp_path / "logs" / "b.ndjson", line(timestamp=stamp(0), event="kept"))
    index = LogIndex(spark, str(tmp_path / "index"))
    index.index_incremental(str(log.parent), NOW)
    write_lines(log, line(timestamp=stamp(5), level="ERROR", event="order.rewritten"))
    assert counts(index.index_incremental(str(log.parent), NOW)) == (2, 1, 1, 0, 0)
    assert events(index) == ["order.rewritten", "kept"]
    assert {r["event"]: r["generation"] for r in index.entries().collect()} == {"order.rewritten": 1, "kept": 0}

    same_length = line(timestamp=stamp(5), level="ERROR", event="order.rewrItten")
    write_lines(log, same_length)
    os.utime(log, (2_000_000_000, 2_000_000_000))
    assert counts(index.index_incremental(str(log.parent), NOW)) == (2, 1, 1, 0, 0)
    assert events(index) == ["order.rewrItten", "kept"]


def test_file_emptied_in_place(spark, tmp_path):
    log = tmp_path / "logs" / "a.ndjson"
    write_lines(log, line(event="one"))
    index = LogIndex(spark, str(tmp_path / "index"))
    index.index_incremental(str(log.parent), NOW)
    log.write_text("")
    assert counts(index.index_incremental(str(log.parent), NOW)) == (1, 0, 0, 0, 0)
    assert index.count(LogQuery()) == 0
    assert counts(index.index_incremental(str(log.parent), NOW)) == (1, 0, 0, 0, 0)
    write_lines(log, line(event="two"))
    assert counts(index.index_incremental(str(log.parent), NOW)) == (1, 1, 1, 0, 0)
    assert events(index) == ["two"]


def test_vanished_file_keeps_entries_and_is_skipped_when_back(spark, tmp_path):
    log = tmp_path / "logs" / "a.ndjson"
    write_lines(log, line(event="one"), line(event="two"))
    index = LogIndex(spark, str(tmp_path / "index"))
    index.index_incremental(str(log.parent), NOW)
    log.rename(tmp_path / "away.ndjson")
    assert counts(index.index_incremental(str(log.parent), NOW)) == (0, 0, 0, 0, 0)
    assert index.ledger().count() == 0 and index.count(LogQuery()) == 2
    (tmp_path / "away.ndjson").rename(log)
    write_lines(log, line(event="three"), append=True)
    assert counts(index.index_incremental(str(log.parent), NOW)) == (1, 3, 1, 2, 0)


def test_a_broken_run_leaves_nothing_but_its_record(spark, tmp_path, monkeypatch):
    log = tmp_path / "logs" / "a.ndjson"
    write_lines(log, line(event="one"), "oops")
    index = LogIndex(spark, str(tmp_path / "index"))
    with monkeypatch.context() as patch:
        patch.setattr(LogIndex, "_changes", lambda *_: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            index.index_incremental(str(log.parent), NOW)
    with monkeypatch.context() as patch:
        patch.setattr(index, "_commit", lambda *_: 1 / 0)  # all is written but the commit, and then the record too
        with pytest.raises(ZeroDivisionError):
            index.index_incremental(str(log.parent), NOW)
    assert index.count(LogQuery()) == 0 and index.ledger().count() == 0
    (run,) = index.runs().collect()
    assert (run["status"], run["kind"], run["error"]) == ("failed", "index", "ZeroDivisionError: division by zero")
    again = LogIndex(spark, str(tmp_path / "index"))
    assert counts(again.index_incremental(str(log.parent), NOW)) == (1, 2, 1, 0, 1)
    assert again.count(LogQuery()) == 1
    (run,) = again.runs().where("status = 'finished'").collect()
    assert run["counters"]["records_inserted"] == 1 and run["duration_ms"] > 0 and run["error"] is None
    left = {p.name for p in (tmp_path / "index" / "data").iterdir()}
    again.vacuum(0)
    assert len(left) == 2 and len(list((tmp_path / "index" / "data").rglob("*.parquet"))) == 2 and again.count(LogQuery()) == 1


def test_of_two_writers_one_fails(spark, tmp_path):
    first, second = tmp_path / "logs" / "a.ndjson", tmp_path / "logs" / "b.ndjson"
    write_lines(first, line(event="one"), line(event="two"))
    index = LogIndex(spark, str(tmp_path / "index"))
    other = LogIndex(spark, str(tmp_path / "index"))
    write, raced = index._write_rows, []

    def late(rows):
        found = write(rows)
        if not raced:
            raced.append(True)
            write_lines(second, line(event="three"))
            other.index_incremental(str(first.parent), NOW)
        return found

    index._write_rows = late
    with pytest.raises(ConcurrentWrite):
        index.index_incremental(str(first.parent), NOW)
    rows = index.entries().collect()
    assert sorted(r["event"] for r in rows) == ["one", "three", "two"] and len({r["id"] for r in rows}) == 3
    assert [r["status"] for r in index.runs().orderBy("run_seq").collect()] == ["finished", "failed"]
    write_lines(second, line(event="four"), append=True)
    assert counts(index.index_incremental(str(first.parent), NOW)) == (2, 1, 1, 0, 0)
    assert len({r["id"] for r in index.entries().collect()}) == 4


def test_commits_by_many_writers_at_once(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    log = CommitLog(spark, str(tmp_path / "log"))

    def write(writer):
        won = 0
        for number in range(1, 31):
            try:
                log.create(number, {"number": number, "by": writer})
                won += 1
            except ConcurrentWrite:
                pass
        return won

    with ThreadPoolExecutor(8) as pool:
        assert sum(pool.map(write, range(8))) == 30
    (tmp_path / "log" / "_newest").write_text("7")
    assert log.newest() == 30 and log.read(30)["number"] == 30
    (tmp_path / "log" / "_newest").write_text("garbage")
    assert log.newest() == 30
    assert not [p for p in (tmp_path / "log").iterdir() if p.name.startswith("draft")]


def test_many_runs_open_few_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(index_module, "MAX_PARTS", 4)
    monkeypatch.setattr(index_module, "MAX_RUNS", 6)
    log = tmp_path / "logs" / "a.ndjson"
    index = LogIndex(spark, str(tmp_path / "index"))
    for n in range(14):
        write_lines(log, line(timestamp=stamp(n), event=f"e{n}"), append=True)
        assert index.index_incremental(str(log.parent), NOW)["records_inserted"] == 1
        if n == 8:
            index.delete_source_files(spark.createDataFrame([("other.ndjson",)], "source_file string"))
    for _ in range(186):
        index.log_report("ingest", "test", NOW, {"n": 1})
    snapshot = index.snapshot()
    assert snapshot.number == 201
    assert all(len(snapshot.of_table(name)) <= 4 for name in index_module.SCHEMAS) and len(snapshot.runs) <= 7
    assert index.runs().count() == 201 and index.runs().select("run_seq").distinct().count() == 201
    assert events(index, limit=3) == ["e13", "e12", "e11"] and index.count(LogQuery()) == 14
    assert index.ledger().count() == 1 and index.stats().head()["entry_count"] == 14


def test_tombstones_hide_until_compaction(spark, tmp_path):
    logs = tmp_path / "logs"
    for name in ("a", "b", "c"):
        write_lines(logs / f"{name}.ndjson", *[line(timestamp=f"2026-02-{day:02d}T00:00:00.000Z", event=f"{name}{day}", k="v") for day in range(1, 4)])
    write_lines(logs / "d.ndjson", line(timestamp="2026-02-09T00:00:00.000Z", event="d9"))
    index = LogIndex(spark, str(tmp_path / "index"))
    index.index_directory(str(logs), NOW)
    before = set((tmp_path / "index" / "data").rglob("*.parquet"))
    doomed = spark.createDataFrame([("a.ndjson",), ("a.ndjson",), ("none",)], "source_file string")
    conditions = [index_module.manifest.may_hold([(index_module.manifest.SOURCE, "a.ndjson")])]
    assert len(index._paths(index.snapshot(), conditions)) == 3  # of four days
    assert index.delete_source_files(doomed) == {"entries_deleted": 3, "fields_deleted": 9}
    assert set((tmp_path / "index" / "data").rglob("*.parquet")) == before
    kept = ["d9", "c3", "b3", "c2", "b2", "c1", "b1"]
    assert events(index) == kept and index.count(LogQuery(field="k", value="v")) == 6
    assert index.stats().head()["entry_count"] == 7 and index.stats().head()["field_count"] == 20
    assert index.delete_source_files(doomed) == {"entries_deleted": 0, "fields_deleted": 0}
    # The file's entries come back with a full scan: their ids are new.
    assert counts(index.index_directory(str(logs), NOW)) == (4, 10, 3, 7, 0)
    assert len(events(index)) == 10
    assert index.delete_source_files(spark.createDataFrame([("b.ndjson",)], "source_file string"))["entries_deleted"] == 3
    report = index.prune("2026-02-02T00:00:00.000Z", "2000")
    assert report["entries_deleted"] == 2 and report["fields_deleted"] == 6
    assert index.stats().head()["entry_count"] == 5
    content = sorted((r["id"], r["event"]) for r in index.entries().collect())
    days = index.compact(max_files=100)
    assert [str(day) for _, day in days] == ["2026-02-02", "2026-02-03"]
    assert sorted((r["id"], r["event"]) for r in index.entries().collect()) == content and len(content) == 5
    assert not index.snapshot().of_table("tombstones") and index.snapshot().hidden == {"entries": 0, "fields": 0}
    assert index.stats().head().asDict()["entry_count"] == 5
    assert index.vacuum(0) > 0 and sorted((r["id"], r["event"]) for r in index.entries().collect()) == content


def test_a_reader_keeps_its_snapshot(spark, tmp_path):
    log = tmp_path / "logs" / "a.ndjson"
    write_lines(log, *[line(timestamp=f"2026-02-{day:02d}T00:00:00.000Z", event=f"e{day}") for day in range(1, 6)])
    index = LogIndex(spark, str(tmp_path / "index"))
    index.index_directory(str(log.parent), NOW)
    seen = index.entries()
    assert index.prune("2026-02-03T12:00:00.000Z", "2000")["entries_deleted"] == 3
    index.compact(max_files=0)
    write_lines(log, line(event="new"))
    index.reindex(str(log.parent), NOW)
    assert seen.count() == 5 and [r["event"] for r in index.entries().collect()] == ["new"]


def test_full_run_then_incremental(spark, tmp_path):
    log = tmp_path / "logs" / "a.ndjson"
    write_lines(log, line(event="one"), line(event="two"))
    index = LogIndex(spark, str(tmp_path / "index"))
    index.index_directory(str(log.parent), NOW)
    assert counts(index.index_incremental(str(log.parent), NOW)) == (1, 0, 0, 0, 0)
    write_lines(log, line(event="three"), append=True)
    assert counts(index.index_incremental(str(log.parent), NOW)) == (1, 1, 1, 0, 0)


def test_reindex_drops_stale_rows(spark, tmp_path):
    log = tmp_path / "logs" / "a.ndjson"
    write_lines(log, line(event="old", k="1"), line(event="old2"))
    index = LogIndex(spark, str(tmp_path / "index"))
    index.index_directory(str(log.parent), NOW)
    top = index.entries().agg(F.max("id")).head()[0]
    write_lines(log, line(event="new"))
    result = index.reindex(str(log.parent), NOW)
    assert result["reset"] == {"entries_deleted": 2, "fields_deleted": 3}
    assert counts(result["report"]) == (1, 1, 1, 0, 0)
    rows = index.entries().collect()
    assert [r["event"] for r in rows] == ["new"] and rows[0]["id"] > top
    assert counts(index.index_incremental(str(log.parent), NOW)) == (1, 0, 0, 0, 0)


def test_paging(spark, tmp_path):
    log = tmp_path / "logs" / "a.ndjson"
    write_lines(log, *[line(timestamp=stamp(i), event=f"event.{i}") for i in range(3)])
    write_lines(
        log,
        line(timestamp="2026-02-10T00:00:00Z", event="older"),
        line(timestamp="garbage", event="undated"),
        line(timestamp="0", event="low"),
        append=True,
    )
    index = LogIndex(spark, str(tmp_path / "index"))
    index.index_directory(str(log.parent), NOW)
    expected = ["undated", "event.2", "event.1", "event.0", "older", "low"]
    assert events(index) == expected
    frame = index.page_frame(LogQuery(limit=2)).collect()
    assert [r["event"] for r in frame] == expected[:2]
    seen, cursor = [], None
    while True:
        page = index.page(LogQuery(limit=1, cursor=cursor))
        seen += [r["event"] for r in page.entries]
        cursor = page.next_cursor
        if not page.has_more:
            assert cursor is None
            break
    assert seen == expected
    # Only the files that the range and the cursor leave are looked at; the undated one reaches from 0 to garbage.
    assert events(index, limit=1, from_="2026-02-09", to="2026-02-11") == ["older"]
    at_older = Cursor("2026-02-10T00:00:00Z", 10**9)
    for query, files in ((LogQuery(from_="2026-02-09", to="2026-02-11"), 2), (LogQuery(cursor=at_older.encode()), 2)):
        assert sum(map(len, index.zones(query))) == files
    assert events(index, cursor=at_older.encode()) == ["older", "low"]
    assert events(index, limit=1, cursor="not-a-valid-cursor") == ["undated"]
    assert index.page(LogQuery(limit=99999)).limit == 1000
    assert index.page(LogQuery(limit=0)).limit == 100
    assert index.page(LogQuery(limit=-5)).limit == 1


def test_aggregates(spark, tmp_path):
    log = tmp_path / "logs" / "a.ndjson"
    write_lines(
        log,
        line(level="INFO", component="orders", correlationId="CORR-1", requestId="REQ-1"),
        line(level="ERROR", component="orders", correlationId="CORR-1", requestId="REQ-2"),
        line(level="ERROR", component="supplier", requestId="REQ-3"),
        line(level="ERROR", correlationId=""),
    )
    index = LogIndex(spark, str(tmp_path / "index"))
    index.index_directory(str(log.parent), NOW)

    def buckets(*args, **options):
        return [tuple(r) for r in index.aggregate(LogQuery(**options), *args).collect()]

    assert buckets("level") == [("ERROR", 3), ("INFO", 1)]
    assert buckets("field", " component ") == [("orders", 2), ("(missing)", 1), ("supplier", 1)]
    assert buckets("correlation") == [("CORR-1", 2), ("", 1), ("REQ-3", 1)]
    assert buckets("level", limit=1) == [("ERROR", 3)]
    for bad in (("field", "  "), ("nope",)):
        try:
            buckets(*bad)
        except ValueError:
            continue
        raise AssertionError(bad)


def test_prune_and_compact(spark, tmp_path):
    logs = tmp_path / "logs"
    index = LogIndex(spark, str(tmp_path / "index"))
    write_lines(logs / "old.ndjson", line(timestamp="2025-01-01T00:00:00.000Z", event="old.event"))
    write_lines(logs / "audit" / "old.ndjson", line(timestamp="2025-01-01T00:00:00.000Z", event="old.audit.event"))
    write_lines(logs / "new.ndjson", line(timestamp="2026-02-17T00:00:00.000Z", event="new.event"))
    index.index_incremental(str(logs), NOW)
    report = index.prune("2026-01-01T00:00:00.000Z", "2024-01-01T00:00:00.000Z")
    assert (report["entries_deleted"], report["normal_entries_deleted"], report["audit_entries_deleted"]) == (1, 1, 0)
    assert report["fields_deleted"] == 2
    assert index.stats().head()["entry_count"] == 2
    assert sorted(events(index)) == ["new.event", "old.audit.event"]

    for n in range(6):
        write_lines(logs / "new.ndjson", line(timestamp="2026-02-17T00:00:01.000Z", event=f"n{n}"), append=True)
        index.index_incremental(str(logs), NOW)
    before = sorted(tuple(r[c] for c in ("id", "event", "line_number")) for r in index.entries().collect())
    chosen = index.compact(max_files=3)
    assert [str(day) for _, day in chosen] == ["2026-02-17"]
    after = sorted(tuple(r[c] for c in ("id", "event", "line_number")) for r in index.entries().collect())
    assert after == before
    zones = [z for block in index.zones(LogQuery(audit=False)) for z in block]
    assert len(zones) == 1 and zones[0].rows == 7
    assert len(list((tmp_path / "index" / "data").rglob("day=2026-02-17/*.parquet"))) == 8  # until they are vacuumed
    index.vacuum(0)
    assert len(list((tmp_path / "index" / "data").rglob("day=2026-02-17/*.parquet"))) == 1


def test_pages_read_each_file_once(spark, tmp_path, monkeypatch):
    """Pages equal a plain sort, whatever the filter and the spread, and no file is opened twice."""
    rng = random.Random(3)
    logs = tmp_path / "logs"
    for n in range(30):
        days = [f"2026-02-{rng.randint(1, 12):02d}T{rng.randint(0, 23):02d}:00:00.000Z" for _ in range(12)]
        rows = [line(timestamp=t, level=rng.choice(["INFO", "ERROR"]), user=str(rng.randint(1, 40)), rare=f"r{n}" if k == 0 else None) for k, t in enumerate(days)]
        write_lines(logs / f"{n}.ndjson", *rows)
    index = LogIndex(spark, str(tmp_path / "index"))
    index.index_directory(str(logs), NOW)
    entries = index.entries().collect()
    read, opened = index._entries_of, []

    def counting(snapshot, paths):
        opened.append(paths)
        return read(snapshot, paths)

    monkeypatch.setattr(index, "_entries_of", counting)
    monkeypatch.setattr(index_module, "ZONES_AT_ONCE", 5)
    for options in ({"limit": 7}, {"limit": 200, "level": "error"}, {"field": "user", "value": "7", "limit": 4}, {"field": "rare", "value": "r3"}, {"from_": "2026-02-05", "to": "2026-02-07", "limit": 9}, {"audit": True}):
        query, cursor, found = LogQuery(**options), None, []
        wanted = [
            r["id"]
            for r in sorted(entries, key=lambda r: (r["timestamp"], r["id"]), reverse=True)
            if (not query.level or r["level"] == query.level.upper())
            and (not query.field or r["fields"].get(query.field) == query.value)
            and (not query.from_ or query.from_ <= r["timestamp"] <= query.to)
            and not query.audit
        ]
        for _ in range(3):
            opened.clear()
            page = index.page(LogQuery(**options, cursor=cursor))
            paths = [p for wave in opened for p in wave]
            assert len(paths) == len(set(paths))
            found += [r["id"] for r in page.entries]
            assert page.has_more == (len(wanted) > len(found))
            cursor = page.next_cursor
            if not cursor:
                break
        assert found == wanted[: len(found)] and (page.has_more or len(found) == len(wanted))
    opened.clear()
    index.page(LogQuery(limit=1))
    assert len(opened) == 1 and len(opened[0]) == 8  # of twelve
    opened.clear()
    assert index.page(LogQuery(field="rare", value="none of these")).entries == [] and sum(map(len, opened)) <= 2


def test_bloom_filters_lose_nothing(spark, tmp_path):
    log = tmp_path / "logs" / "a.ndjson"
    write_lines(log, *[line(timestamp=f"2026-02-{n % 9 + 1:02d}T00:00:00.000Z", key=f"value {n}", n=n, level="warn" if n % 9 == 3 else "info") for n in range(900)])
    index = LogIndex(spark, str(tmp_path / "index"))
    index.index_directory(str(log.parent), NOW)
    snapshot, found = index.snapshot(), 0
    for n in range(0, 900, 45):
        paths = index._paths(snapshot, index_module.manifest.reachable(LogQuery(field="key", value=f"value {n}")))
        assert any(f"day=2026-02-{n % 9 + 1:02d}" in p for p in paths)
        found += len(paths)
    assert found < 20 * 1.6  # nine files each without the filter
    assert len(index._paths(snapshot, index_module.manifest.reachable(LogQuery(level="Warn")))) == 1


def test_appends_equal_one_scan(spark, tmp_path):
    """However a file grows, the index ends up the same as after one full scan."""
    rng = random.Random(7)
    kinds = ["", "oops", "null"]
    for name in ("a.ndjson", "deep/b.ndjson"):
        lines = [line(event=f"e{n}", text="x" * rng.randrange(60)) if rng.random() < 0.8 else rng.choice(kinds) for n in range(120)]
        (tmp_path / "final" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "final" / name).write_bytes("\r\n".join(lines).encode() + b"\r\n")
    grown = LogIndex(spark, str(tmp_path / "grown"))
    totals = [0] * 4
    for step in range(1, 4):
        for name in ("a.ndjson", "deep/b.ndjson"):
            data = (tmp_path / "final" / name).read_bytes()
            end = len(data) if step == 3 else rng.randrange(len(data) * step // 3)
            target = tmp_path / "logs" / name
            target.parent.mkdir(parents=True, exist_ok=True)
            old = target.stat().st_size if target.exists() else 0
            with open(target, "ab") as out:
                out.write(data[old : max(old, end)])
        report = grown.index_incremental(str(tmp_path / "logs"), NOW, range_bytes=500)
        totals = [a + b for a, b in zip(totals, counts(report)[1:])]
    whole = LogIndex(spark, str(tmp_path / "whole"))
    assert totals == list(counts(whole.index_directory(str(tmp_path / "final"), NOW))[1:])

    def content(index):
        names = ("source_file", "line_number", "event", "data_json", "fields")
        return sorted(tuple(str(row[name]) for name in names) for row in index.entries().collect())

    assert content(grown) == content(whole)


def test_known_keys_do_not_pass_through_the_driver(spark, tmp_path):
    for name in ("a", "b"):
        write_lines(tmp_path / f"{name}.ndjson", *(line(event=f"{name}{n}") for n in range(40)), "not-json", "")
    rows = index_module.to_rows(scan_lines(spark, str(tmp_path)), NOW, 0)
    known = rows.where("line_kind = 'record' AND source_file = 'a.ndjson' AND line_number <= 30")
    added = index_module.ignore_known(rows, known, list_files(spark, str(tmp_path)))
    plan = added._jdf.queryExecution().sparkPlan().toString()
    by_key = [x for x in plan.splitlines() if "Join" in x and "line_number" in x]
    assert len(by_key) == 1 and "SortMergeJoin" in by_key[0], plan
    found = {(r["source_file"], r["line_kind"]): r["count"] for r in added.groupBy("source_file", "line_kind").count().collect()}
    assert found == {(f"{name}.ndjson", kind): n for name, records in (("a", 10), ("b", 40)) for kind, n in (("record", records), ("parse_error", 1), ("blank", 1))}
