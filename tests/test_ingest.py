import json
import os
import time

import pytest
from pyspark.sql import functions as F

from logloom.operators.ingest import (
    accept_records,
    parse_producer_mappings,
    producer_table,
    request_report,
    write_producer_files,
)
from logloom.sources.payloads import effective_max_bytes

SCHEMA = "request_id string, token string, basic_user string, payload string, received_at timestamp"


def accept(spark, *requests, max_bytes=1_048_576):
    rows = [(f"r{n}", r.get("token"), r.get("user"), r.get("payload")) for n, r in enumerate(requests)]
    frame = spark.createDataFrame(rows, "request_id string, token string, basic_user string, payload string")
    frame = frame.withColumn("received_at", F.to_timestamp(F.lit("2026-02-17T10:00:00.123Z")))
    producers = spark.createDataFrame([("ingest-token", "frontend-web"), ("token-a", "frontend-web")], "token string, producer_id string")
    parsed, stamped = accept_records(frame, producers, max_bytes)
    report = {r["request_id"]: tuple(r)[1:] for r in request_report(parsed).collect()}
    return [report[f"r{n}"] for n in range(len(requests))], stamped


def test_requests(spark):
    spoofed = [{"event": "web.click", "producerId": "spoofed", "ingestedAt": "x", "nested": {"b": 1, "a": [1, 2]}}, "text", 5, None, []]
    report, stamped = accept(
        spark,
        {"token": "ingest-token", "payload": json.dumps(spoofed)},
        {"token": "token-a", "payload": '{"logs":[{"event":"a"}]}'},
        {"token": "token-a", "payload": '{"logs":['},
        {"token": "token-a", "payload": '{"logs":{}}'},
        {"token": "token-a", "payload": '[{"a":1}] x'},
        {"token": "token-a", "payload": "  \n"},
        {"token": "unknown", "payload": "[]"},
        {"payload": "[]"},
        {"token": "token-a", "user": "frontend-user", "payload": '[{"a":1}]'},
        {"user": "", "token": "token-a", "payload": "[]"},
    )
    assert report == [
        ("frontend-web", "ok", 1, 4),
        ("frontend-web", "ok", 1, 0),
        ("frontend-web", "invalid_json", 0, 0),
        ("frontend-web", "invalid_payload", 0, 0),
        ("frontend-web", "invalid_json", 0, 0),
        ("frontend-web", "ok", 0, 0),
        (None, "unauthorized", 0, 0),
        (None, "unauthorized", 0, 0),
        ("frontend-user", "ok", 1, 0),
        ("frontend-web", "ok", 0, 0),
    ]
    lines = {r["request_id"]: json.loads(r["line"]) for r in stamped.where("line is not null").collect()}
    stamp = {"ingestedAt": "2026-02-17T10:00:00.123Z"}
    assert lines["r0"] == {"event": "web.click", "producerId": "frontend-web", "nested": {"b": 1, "a": [1, 2]}, **stamp}
    assert lines["r8"] == {"a": 1, "producerId": "frontend-user", **stamp}


def test_size_limit(spark):
    big = json.dumps([{"message": "x" * 3000}])
    report, _ = accept(spark, {"token": "token-a", "payload": big}, max_bytes=effective_max_bytes(64))
    assert report == [("frontend-web", "too_large", 0, 0)]
    assert [effective_max_bytes(v) for v in (None, -1, 64, 5000)] == [1_048_576, 1_048_576, 1024, 5000]
    report, _ = accept(spark, {"token": "token-a", "payload": "ü" * 600}, {"token": "token-a", "payload": "[]"}, max_bytes=1024)
    assert [r[1] for r in report] == ["too_large", "ok"]


def test_repeated_flush_replaces_files(spark, tmp_path):
    _, stamped = accept(spark, {"token": "token-a", "payload": '[{"n":1},{"n":2}]'}, {"user": "ops", "payload": '[{"n":3}]'})
    root = str(tmp_path / "logs")
    for batch in ("b0", "b0", "b1"):
        write_producer_files(stamped, root, batch, "2026-02-18T00:00:00.000Z")
    lines = spark.read.text(f"{root}/ingest")
    found = {(r["producer"], str(r["day"]), r["batch"]): r["n"] for r in lines.groupBy("producer", "day", "batch").agg(F.count("*").alias("n")).collect()}
    assert found == {(p, "2026-02-18", b): n for p, n in (("frontend-web", 2), ("ops", 1)) for b in ("b0", "b1")}


def test_many_producers_are_written_by_tasks(spark, tmp_path):
    def flush(root, producers):
        rows = [(f"r{n}", producers[n % len(producers)], n % 3, f'{{"n":{n}}}') for n in range(1200)]
        stamped = spark.createDataFrame(rows, "request_id string, producer_id string, position int, line string")
        begun = time.time()
        write_producer_files(stamped.withColumn("received_at", F.to_timestamp(F.lit("2026-02-17T10:00:00Z"))), root, "b0", "2026-02-18T00:00:00Z")
        return time.time() - begun

    root = str(tmp_path / "few")
    odd = ["a b", "c/d=e%", "ü", None]
    flush(root, odd)
    once = min(flush(root, odd) for _ in range(2))
    found = spark.read.text(f"{root}/ingest").groupBy("producer").count().collect()
    assert {r["producer"]: r["count"] for r in found} == dict.fromkeys(odd, 300)
    many = flush(str(tmp_path / "many"), [f"p{n}" for n in range(600)])
    assert spark.read.text(str(tmp_path / "many" / "ingest")).groupBy("producer").count().count() == 600
    assert many < once + 3  # the driver moved every folder by itself, some 13 ms each
    assert os.listdir(tmp_path / "many" / "ingest" / "_temporary") == []


@pytest.mark.parametrize(
    "mapping,problems",
    [
        ("a=p, b=q", [None, None]),
        ("a=p,,  ,b=q", [None, None]),
        ("a", ["syntax"]),
        ("=p", ["syntax"]),
        ("a=", ["syntax"]),
        ("a= =", ["producer_id"]),
        ("a=p,a=q", [None, "duplicate"]),
        ("a=.p", ["producer_id"]),
        (f"a={'p' * 129}", ["producer_id"]),
        ("a=b=c", ["producer_id"]),
    ],
)
def test_producer_mappings(spark, mapping, problems):
    checked = parse_producer_mappings(spark.createDataFrame([(1, mapping)], "config_id int, mapping string"))
    assert [r["problem"] for r in checked.orderBy("position").collect()] == problems
    assert producer_table(checked).count() == (len(problems) if not any(problems) else 0)
