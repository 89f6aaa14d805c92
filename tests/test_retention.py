import os

from conftest import line, write_lines
from pyspark.sql import functions as F

from logloom import LogIndex, LogQuery
from logloom.operators.retention import cutoffs, expired_files, run_maintenance
from logloom.sources.files import list_files

NOW = "2026-02-18T00:00:00.000Z"
DAY = 86_400
NOW_S = 1771372800


def aged(path, days, *lines):
    write_lines(path, *lines)
    os.utime(path, (NOW_S - days * DAY, NOW_S - days * DAY))


def test_maintenance(spark, tmp_path):
    logs, backup = tmp_path / "logs", tmp_path / "backup"
    old = line(timestamp="2025-12-01T00:00:00.000Z", event="old")
    aged(logs / "app" / "old.ndjson", 40, old)
    aged(logs / "app" / "new.ndjson", 1, line(timestamp="2026-02-17T00:00:00.000Z", event="new"))
    aged(logs / "audit" / "old one.ndjson", 400, line(timestamp="2025-01-01T00:00:00.000Z", event="audit-old"))
    aged(logs / "app" / "my-audit.ndjson", 40, line(timestamp="2025-12-01T00:00:00.000Z", event="named"))
    aged(logs / "app" / "empty.ndjson", 40)
    (logs / "app" / "empty.ndjson").write_text("")
    os.utime(logs / "app" / "empty.ndjson", (NOW_S - 40 * DAY,) * 2)
    text = (logs / "audit" / "old one.ndjson").read_bytes()
    index = LogIndex(spark, str(tmp_path / "index"))
    index.index_directory(str(logs), NOW)

    report = run_maintenance(index, str(logs), str(tmp_path / "work"), NOW, backup=str(backup))
    assert (report["normal_files_deleted"], report["audit_files_deleted"], report["files_deleted"]) == (2, 1, 3)
    # Row class comes from the folder, file class also from the name.
    assert (report["normal_entries_deleted"], report["audit_entries_deleted"]) == (2, 1)
    assert report["vacuum_runs"] == 1
    assert (backup / "audit" / "old one.ndjson").read_bytes() == text
    assert sorted(p.name for p in logs.rglob("*.ndjson")) == ["my-audit.ndjson", "new.ndjson"]
    assert [r["event"] for r in index.entries().collect()] == ["new"]
    again = run_maintenance(index, str(logs), str(tmp_path / "work2"), NOW, backup=str(backup))
    assert (again["files_deleted"], again["entries_deleted"], again["vacuum_runs"]) == (0, 0, 0)
    assert index.runs().where("kind = 'maintenance'").count() == 2


def test_zero_days(spark, tmp_path):
    aged(tmp_path / "logs" / "a.ndjson", 400, line(timestamp="2025-01-01T00:00:00.000Z"))
    aged(tmp_path / "logs" / "audit" / "b.ndjson", 400, line(timestamp="2025-01-01T00:00:00.000Z"))
    listing = list_files(spark, str(tmp_path / "logs"))
    assert expired_files(listing, NOW, 0, 0).count() == 0
    assert [r["source_file"] for r in expired_files(listing, NOW, 0, 30).collect()] == ["audit/b.ndjson"]
    assert [r["source_file"] for r in expired_files(listing, NOW, 30, -1).collect()] == ["a.ndjson"]
    assert cutoffs(NOW, 0, 1) == (NOW, "2026-02-17T00:00:00.000Z")
    index = LogIndex(spark, str(tmp_path / "index"))
    index.index_directory(str(tmp_path / "logs"), NOW)
    assert index.prune(*cutoffs(NOW, 0, 0))["entries_deleted"] == 2
    assert index.count(LogQuery()) == 0


def test_manifest_prunes_scans(spark, tmp_path):
    days = [f"2026-02-{day:02d}" for day in range(1, 11)]
    write_lines(tmp_path / "logs" / "a.ndjson", *[line(timestamp=f"{day}T00:00:00.000Z") for day in days], line(timestamp="x"))
    index = LogIndex(spark, str(tmp_path / "index"))
    index.index_directory(str(tmp_path / "logs"), NOW)
    query = LogQuery(from_="2026-02-09T00:00:00.000Z", audit=False)
    found = index.entries(query).where(query.predicate())
    opened = found.select(F.input_file_name().alias("f")).distinct().collect()
    assert len(opened) == 3  # two days and the undated file
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(timestamp" in plan and "Exchange" not in plan
