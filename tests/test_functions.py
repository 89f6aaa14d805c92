import json
import math
import os
import struct
import random

import pytest
from conftest import line, write_lines
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from logloom.functions.json_text import JS_WHITESPACE, js_number_text, text_to_boolean
from logloom.functions.normalize import BAD, BLANK, INGESTED, classify_lines, entries_from_lines
from logloom.functions.times import canonical_millis, date_prefix, iso_from_millis, iso_millis, utc_ntz
from logloom.operators.alerts import millis_around
from logloom.operators.filters import Cursor, clamp_limit
from logloom.operators.running import running
from logloom.sources.byte_ranges import last_line_end, line_array, line_count, range_blocks, range_bytes
from logloom.sources.files import list_files, name_pattern
from logloom.sources.lines import scan_lines

NOW = "2026-02-18T00:00:00.000Z"


def parse(spark, lines, path="/logs/a.ndjson"):
    return spark.createDataFrame([(n, path, text) for n, text in enumerate(lines)], "n int, path string, line string")


LINE_KINDS = [
    ("", BLANK),
    (" \t  ", BLANK),
    ('﻿{"a":1}', INGESTED),
    ('　{"a":1} ', INGESTED),
    ('{"a":1} xyz', BAD),
    ("1] xyz", BAD),
    ("1} xyz", BAD),
    ("1,2", BAD),
    ('{"a":1}}', BAD),
    ('{"a":1,"a":2}', INGESTED),
    ("{'a':1}", BAD),
    ('{"a":NaN}', BAD),
    ('{"a":01}', BAD),
    ('{"a":1,}', BAD),
    ("null", BAD),
    ("123", INGESTED),
    ("[1,2]", INGESTED),
    ('"abc"', INGESTED),
    ('{"a":"⁠end-of-line⁠"}', INGESTED),
    ('1,"⁠end-of-line⁠"] x', BAD),
    ('1,"⁠end-of-line⁠"', BAD),
]


def test_line_kinds(spark):
    rows = classify_lines(parse(spark, [text for text, _ in LINE_KINDS])).orderBy("n").collect()
    assert [row["line_kind"] for row in rows] == [kind for _, kind in LINE_KINDS]


def test_normalisation(spark):
    cases = [
        ('{"timestamp":5,"level":"","message":{"z":1, "a":[true,null]}}', (NOW, "INFO", "log.event", '{"z":1,"a":[true,null]}')),
        ('{"timestamp":"x","level":"warn","event":"e","message":null}', ("x", "WARN", "e", "")),
        ('{"timestamp":"","event":"","message":"m"}', (NOW, "INFO", "m", "m")),
        ('{"message":1.50}', (NOW, "INFO", "log.event", "1.5")),
        ('{"message":false,"level":7}', (NOW, "INFO", "log.event", "false")),
        ("123", (NOW, "INFO", "log.event", "")),
        ("[1]", (NOW, "INFO", "log.event", "")),
    ]
    rows = entries_from_lines(parse(spark, [text for text, _ in cases]), NOW).orderBy("n").collect()
    assert [(r["timestamp"], r["level"], r["event"], r["message"]) for r in rows] == [want for _, want in cases]
    assert rows[-1]["fields"] == {} and rows[0]["fields"] == {"timestamp": "5", "level": ""}


@pytest.mark.parametrize("path,by_path", [("/logs/Audit/a.ndjson", True), ("/logs/audit.ndjson", False)])
def test_audit(spark, path, by_path):
    values = {
        "true": True, "false": False, '"YES"': True, '" no "': False, "0": False, "-0.0": False, "2": True, "0.5": True,
        "null": by_path, '"maybe"': by_path, "[]": by_path, '"1"': True,
    }
    rows = entries_from_lines(parse(spark, [f'{{"audit":{v}}}' for v in values], path), NOW).orderBy("n").collect()
    assert [row["is_audit"] for row in rows] == list(values.values())


def test_field_texts(spark):
    texts = {
        "1.0": "1", "1e3": "1000", "1e21": "1e+21", "123e18": "123000000000000000000", "1.5e-7": "1.5e-7", "-0.0": "0",
        "0.000001": "0.000001", "12345678901234567890": "12345678901234567000", "9007199254740993": "9007199254740992",
        "9007199254740991": "9007199254740991", "-42": "-42", "0.1": "0.1", "null": "null", "true": "true", '""': "",
        '"x"': "x", "123456789.123456789": "123456789.12345679", "100": "100", "-1.25e-9": "-1.25e-9",
    }
    record = "{" + ",".join(f'"k{n}":{value}' for n, value in enumerate(texts)) + ',"o":{"k":1},"l":[1]}'
    fields = entries_from_lines(parse(spark, [record]), NOW).head()["fields"]
    assert fields == {f"k{n}": text for n, text in enumerate(texts.values())}


def js_text(number: float) -> str:
    """Shortest round-trip digits, laid out plainly between 1e-6 and 1e21."""
    if number == 0:
        return "0"
    sign, digits, exponent = "-" if number < 0 else "", *format(abs(number), ".17e").split("e")
    mantissa, _, power = repr(abs(number)).partition("e")
    whole, _, fraction = mantissa.partition(".")
    digits = (whole + fraction).strip("0") or "0"
    lead = len(whole.lstrip("0")) if whole.strip("0") else -(len(fraction) - len(fraction.lstrip("0")))
    point = lead + int(power or 0)
    if 0 < point <= 21:
        body = digits.ljust(point, "0")
        return sign + body[:point] + ("." + body[point:] if len(body) > point else "")
    if -6 < point <= 0:
        return sign + "0." + "0" * -point + digits
    shown = digits[0] + ("." + digits[1:] if len(digits) > 1 else "")
    return f"{sign}{shown}e{'+' if point > 0 else '-'}{abs(point - 1)}"


@settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.decimals(min_value=-1000, max_value=1000, places=6), min_size=50, max_size=50), st.integers(-12, 20))
def test_number_text(spark, values, power):
    numbers = [float(f"{value}e{power}") for value in values]
    frame = spark.createDataFrame([(n,) for n in numbers], "d double").select(js_number_text(F.col("d")).alias("t"))
    assert [row["t"] for row in frame.collect()] == [js_text(n) for n in numbers]


def test_number_text_is_the_shortest(spark):
    rng = random.Random(4)
    numbers = [5e-324, 1.5e-323, 2.2250738585072014e-308, 2.225073858507201e-308, 1.7976931348623157e308, 2e-3, 1e23, 9007199254740993.0, 0.1 + 0.2, 1 / 3]
    numbers += [struct.unpack("<d", rng.randbytes(8))[0] for _ in range(3000)] + [rng.randrange(1, 1 << 52) * 5e-324 for _ in range(300)]
    numbers += [float(rng.randrange(10**17)) / 10 ** rng.randrange(12) for _ in range(700)]
    numbers = [n for n in numbers if math.isfinite(n)]
    frame = spark.createDataFrame([(n,) for n in numbers], "d double").select(js_number_text(F.col("d")).alias("t"))
    assert [(n, row["t"]) for n, row in zip(numbers, frame.collect())] == [(n, js_text(n)) for n in numbers]


def test_nested_numbers_take_their_shortest_form(spark):
    texts = ['{"message":{"x":2.0,"e":1e2,"s":"2.0 and 1e2 \\" 3.0","d":[-0.0,5e-324,12,1.50,123456789012]}}', '{"message":[1,"-",-7,{"a-1.0":1.0}]}', '{"message":{"n":-5,"t":true}}']
    shown = [row["message"] for row in entries_from_lines(parse(spark, texts), NOW).orderBy("n").collect()]
    assert shown == ['{"x":2,"e":100,"s":"2.0 and 1e2 \\" 3.0","d":[0,5e-324,12,1.5,123456789012]}', '[1,"-",-7,{"a-1.0":1}]', '{"n":-5,"t":true}']


def test_text_to_boolean(spark):
    words = {"TRUE": True, " yes ": True, "1": True, "no": False, "0": False, "False": False, "on": None, "": None}
    frame = spark.createDataFrame([(w,) for w in words], "w string").select(text_to_boolean(F.col("w")).alias("b"))
    assert [row["b"] for row in frame.collect()] == list(words.values())


def test_whitespace_is_what_a_line_trim_removes():
    assert all(ch.isspace() or ch == "﻿" for ch in JS_WHITESPACE)


@pytest.mark.parametrize("zone", ["UTC", "America/New_York", "Asia/Kolkata"])
def test_times_ignore_session_zone(spark, zone):
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        row = spark.range(1).select(
            iso_millis(F.expr("timestamp_ntz '2024-03-10 02:30:00.0079'")).alias("ntz"),
            iso_millis(utc_ntz(F.expr("timestamp_micros(1710037800007900)"))).alias("instant"),
            iso_from_millis(F.lit(1710037800007)).alias("millis"),
            canonical_millis(F.lit("2024-03-10T02:30:00.007Z")).alias("back"),
            canonical_millis(F.lit("2024-03-10T02:30:00Z")).alias("no_millis"),
            date_prefix(F.lit("2024-03-10 anything")).cast("string").alias("day"),
            date_prefix(F.lit("2024-13-10")).alias("bad_day"),
        ).head()
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert row["ntz"] == row["instant"] == row["millis"] == "2024-03-10T02:30:00.007Z"
    assert row["back"] == 1710037800007 and row["no_millis"] is None
    assert row["day"] == "2024-03-10" and row["bad_day"] is None


def test_millis_around_follows_text_order(spark):
    tails = ["", "Z", ".Z", ".5Z", ".50", ".500Z", ".5000Z", ".500", ".500z", ".500 Z", ".5", "+02:00", ".12:", ".999Z", ".000Z", "a"]
    texts = [f"2024-01-01T00:00:00{tail}" for tail in tails]
    low, high = millis_around(F.col("t"))
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", low.alias("low"), high.alias("high")).collect()
    base = 1704067200000

    def iso(ms):
        second, milli = divmod(ms, 1000)
        return f"2024-01-01T00:00:{second:02d}.{milli:03d}Z" if second >= 0 else f"2023-12-31T23:59:59.{milli:03d}Z"

    grid = [(ms, iso(ms)) for ms in range(-1, 1001)]
    for row in rows:
        assert row["low"] - base == max(ms for ms, text in grid if text <= row["t"]), row["t"]
        assert row["high"] - base == min(ms for ms, text in grid if text >= row["t"]), row["t"]


def test_cursor_and_limit():
    cursor = Cursor("2026-02-17T10:00:00.000Z", 12)
    assert Cursor.decode(cursor.encode()) == cursor
    for bad in (None, "", "not-a-valid-cursor", "e30", "bnVsbA", "eyJpZCI6MH0", Cursor("x", 1).encode()[:-4]):
        assert Cursor.decode(bad) is None
    limits = [(None, 100), (0, 100), (5.9, 5), (-3, 1), (99999, 1000), (math.inf, 1000), (math.nan, 100)]
    assert [clamp_limit(value, 100) for value, _ in limits] == [want for _, want in limits]


class Bytes:
    def __init__(self, data):
        self.data = data

    def read_at(self, count, at):
        return self.data[at : at + count]


@settings(max_examples=300, deadline=None)
@given(st.binary(max_size=60).map(lambda b: b.replace(b"a", b"\n").replace(b"b", b"\r\n")), st.integers(1, 20), st.integers(0, 10))
def test_ranges_cover_a_file_once(data, step, skip):
    source = Bytes(data)
    first = min(skip, len(data))
    limit = last_line_end(source, first, len(data))
    lines = []
    for start in range(first, limit, step):
        part = range_bytes(source, start, min(start + step, limit), first, limit)
        found = line_array(part).to_pylist()
        assert len(found) == line_count(part)
        lines += found
    assert lines == [text.decode("utf-8", "replace") for text in data[first:limit].splitlines()]


@settings(max_examples=300, deadline=None)
@given(st.binary(max_size=60).map(lambda b: b.replace(b"a", b"\n").replace(b"b", b"\r\n").replace(b"c", b"\r")), st.integers(1, 9))
def test_blocks_hold_whole_lines(data, size):
    blocks = list(range_blocks(Bytes(data), 0, len(data), 0, len(data), size))
    assert b"".join(blocks) == data
    assert sum(map(line_count, blocks)) == line_count(data)
    assert [text for block in blocks for text in line_array(block).to_pylist()] == line_array(data).to_pylist()


def test_a_range_is_not_held_whole():
    data = b"line of text\n" * 300_000
    blocks = list(range_blocks(Bytes(data), 0, len(data), 0, len(data)))
    assert b"".join(blocks) == data and max(map(len, blocks)) < len(data) / 3


@pytest.mark.parametrize("split_bytes", ["200b", "1000b"])
def test_line_numbers_over_many_splits(spark, tmp_path, split_bytes):
    files = {"a.ndjson": 250, "sub dir/b+c%.ndjson": 40, "sub dir/empty.ndjson": 0, "z.NDJSON": 3}
    for name, count in files.items():
        write_lines(tmp_path / "logs" / name, *[line(n=n) for n in range(1, count + 1)], newline_at_end=False)
    spark.conf.set("spark.sql.files.maxPartitionBytes", split_bytes)
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        rows = scan_lines(spark, str(tmp_path / "logs")).orderBy("line_seq").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert [row["line_seq"] for row in rows] == list(range(1, 294))
    got = [(row["source_file"], row["line_number"], json.loads(row["line"])["n"]) for row in rows]
    assert got == [(name, n, n) for name, count in sorted(files.items()) for n in range(1, count + 1)]
    sizes = {r["source_file"]: r["length"] for r in list_files(spark, str(tmp_path / "logs")).collect()}
    assert sizes.keys() == files.keys() and sizes["sub dir/empty.ndjson"] == 0


@pytest.mark.parametrize("at_once", [1, 4, 20_000])
def test_walk_lists_every_name(spark, tmp_path, at_once):
    names = ["a.ndjson", "_b.NDJSON", ".c.ndjson", "_deep/.er/d.ndjson", "x y/+%/e.ndjson", "f.txt", "_temporary/0/g.ndjson", "h.ndjson.bak"]
    names += [f"many/{n % 7}/{n}.ndjson" for n in range(40)]
    for name in names:
        write_lines(tmp_path / "logs" / name, line(name=name))
    (tmp_path / "logs" / "empty").mkdir()
    listed = list_files(spark, str(tmp_path / "logs"), at_once=at_once)
    wanted = {n for n in names if n.lower().endswith(".ndjson") and not n.startswith("_temporary")}
    rows = listed.collect()
    assert sorted(r["source_file"] for r in rows) == sorted(wanted)
    assert all(os.stat(r["path"]).st_size == r["length"] and os.stat(r["path"]).st_mtime_ns // 10**6 == r["modified_at"].timestamp() * 1000 for r in rows)
    some = spark.createDataFrame([(str(tmp_path / "logs" / "many" / "3"),), (str(tmp_path / "logs" / "gone"),)], "path string")
    few = list_files(spark, str(tmp_path / "logs"), folders=some, at_once=at_once).collect()
    assert sorted(r["source_file"] for r in few) == sorted(n for n in names if n.startswith("many/3/"))
    assert list_files(spark, str(tmp_path / "nowhere")).collect() == []


def test_name_patterns():
    import re

    for glob, yes, no in [("*.{txt,[nN]d}", ["a.txt", ".nd", "x.Nd"], ["a.txt2", "a.nD"]), ("a?[0-9]*", ["ab1", "ab1.x"], ["a1", "xab1"])]:
        match = re.compile(name_pattern(glob)).match
        assert all(map(match, yes)) and not any(map(match, no))


def test_lines_appended_while_a_scan_runs(spark, tmp_path):
    log = tmp_path / "logs" / "a.ndjson"
    write_lines(log, line(n=1), line(n=2), '{"n":', newline_at_end=False)
    write_lines(tmp_path / "logs" / "b.ndjson", line(n=1), line(n=2), newline_at_end=False)
    lines = scan_lines(spark, str(tmp_path / "logs"), work_dir=str(tmp_path / "work"))
    write_lines(log, "3}", line(n=4), append=True)
    rows = sorted((r["source_file"], r["line_number"], r["line"]) for r in lines.collect())
    assert rows[:2] == [("a.ndjson", n, line(n=n)) for n in (1, 2)] and rows[-2:] == [("b.ndjson", n, line(n=n)) for n in (1, 2)]
    state = {r["source_file"]: (r["byte_offset"], r["split_lines"]) for r in spark.read.parquet(str(tmp_path / "work")).collect()}
    assert state["a.ndjson"] == (log.read_bytes().index(b"3}"), 3) and len(rows) == 5


def test_line_numbers_do_not_depend_on_packing(spark, tmp_path):
    for n in range(30):
        write_lines(tmp_path / "logs" / f"{n:02d}.ndjson", *[line(n=k) for k in range(1, 6)])
    lines = scan_lines(spark, str(tmp_path / "logs"))
    spark.conf.set("spark.sql.files.minPartitionNum", "3")
    spark.conf.set("spark.sql.files.openCostInBytes", "10m")
    try:
        rows = lines.collect()
    finally:
        spark.conf.unset("spark.sql.files.minPartitionNum")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert len(rows) == 150 and all(row["line_number"] == json.loads(row["line"])["n"] for row in rows)


def test_running_over_blocks(spark):
    table = spark.range(100).select((F.col("id") % 3).alias("g"), "id", (F.col("id") * 7 % 11).alias("v"))
    columns = {"total": ("sum", F.col("v")), "top": ("max", F.when(F.col("v") < 5, F.col("id")))}
    rows = running(table, ["g"], "id", columns, block_rows=8).collect()
    for row in rows:
        earlier = [n for n in range(row["id"] + 1) if n % 3 == row["g"]]
        assert row["total"] == sum(n * 7 % 11 for n in earlier)
        assert row["top"] == max((n for n in earlier if n * 7 % 11 < 5), default=None)
    before = {r["id"]: r["t"] for r in running(table, ["g"], "id", {"t": ("sum", F.col("v"))}, False, 8).collect()}
    assert before == {r["id"]: r["total"] - r["v"] for r in rows}


def test_members_are_cast_to_text_once_for_a_line(spark):
    lines = spark.createDataFrame([('{"message":1.50,"audit":0,"n":12345678901234567890,"o":{"b":1}}', "/x")], "line string, path string")
    entries = entries_from_lines(lines, "now")
    plan = entries._jdf.queryExecution().optimizedPlan().toString()
    assert "_texts" in plan and "_members" not in plan  # no variant of a member lives on to be cast again
    (row,) = entries.collect()
    assert (row["message"], row["is_audit"], row["fields"]["n"]) == ("1.5", False, "12345678901234567000")
