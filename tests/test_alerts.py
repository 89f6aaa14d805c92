import pytest
from conftest import line, write_lines
from pyspark.sql import functions as F

from logloom import LogIndex
from logloom.operators import alerts as alerts_module
from logloom.operators.alerts import (
    AlertLog,
    Reply,
    alert_state,
    apply_cooldown,
    deliver,
    delivery_plan,
    manual_test,
    replay_counts,
    run_cycle,
    triggers,
)
from logloom.operators.policies import (
    apply_policy_updates,
    create_policy,
    load_policies,
    masked,
    parse_policy_updates,
    persist_policies,
    policy_frame,
)

from logloom.operators.reports import run_state, status_snapshot

URL = "http://hook.invalid"


def replies(*codes):
    calls, left = [], list(codes)

    def send(url, payload, timeout):
        calls.append((url, payload))
        return Reply(left.pop(0))

    return send, calls


@pytest.fixture()
def index(spark, tmp_path):
    write_lines(
        tmp_path / "logs" / "a.ndjson",
        line(timestamp="2026-02-17T09:59:30.000Z", level="ERROR"),
        line(timestamp="2026-02-17T09:59:50.000Z", level="error"),
        line(timestamp="2026-02-17T10:30:00.000Z", level="INFO"),
        line(timestamp="2026-02-17T08:00:00.000Z", level="ERROR"),
    )
    index = LogIndex(spark, str(tmp_path / "index"))
    index.index_directory(str(tmp_path / "logs"), "2026-02-17T10:00:00.000Z")
    return index


def test_cycles(spark, tmp_path, index):
    log = AlertLog(spark, str(tmp_path / "alerts"))
    policy = create_policy("p", URL, errorThreshold=2, windowMinutes=60, cooldownMs=500)
    assert policy.cooldownMs == 1000
    now = "2026-02-17T10:00:00.000Z"
    send, calls = replies(204, 204)
    options = {"send": send, "service_url": "http://svc", "clock": lambda: "2026-02-17T10:00:00.300Z", "sleep": lambda s: None}
    rows = run_cycle(index, policy, log, now=now, **options)
    assert [r[5] for r in rows] == ["sent"]
    assert calls[0][1] == {
        "source": "logloom",
        "rule": "error_threshold",
        "severity": "critical",
        "triggeredAt": now,
        "serviceUrl": "http://svc",
        # The entry stamped half an hour ahead counts: a live window has no upper end.
        "details": {"errorCount": 2.0, "threshold": 2.0, "totalWindowCount": 3.0, "windowMinutes": 60.0},
    }
    assert [r[5] for r in run_cycle(index, policy, log, now="2026-02-17T10:00:01.299Z", **options)] == ["suppressed"]
    assert [r[5] for r in run_cycle(index, policy, log, now="2026-02-17T10:00:01.300Z", **options)] == ["sent"]
    state = alert_state(log.alerts()).head()
    assert (state["sent"], state["suppressed"]) == (2, 1)
    assert run_cycle(index, create_policy("off"), log, send) == []


def test_failed_delivery_ends_the_cycle(spark, tmp_path, index):
    log = AlertLog(spark, str(tmp_path / "alerts"))
    # Both rules fire well after the last entry; the first fails for good.
    policy = create_policy("p", URL, errorThreshold=1, windowMinutes=180, noLogsThresholdMinutes=1)
    now = "2026-02-17T10:40:00.000Z"
    send, calls = replies(400)
    rows = run_cycle(index, policy, log, send, now=now, sleep=lambda s: None)
    assert [(r[1], r[5], r[6]) for r in rows] == [("error_threshold", "failed", 1)] and len(calls) == 1
    send, calls = replies(204, 204)
    rows = run_cycle(index, policy, log, send, now=now, sleep=lambda s: None)
    assert [(r[1], r[5]) for r in rows] == [("error_threshold", "sent"), ("no_logs", "sent")]


def test_deliver_and_plan_agree(spark):
    policy = create_policy("p", URL, webhookRetryAttempts=3, webhookBackoffMs=30)
    cases = {(500, 500, 204): (3, "sent"), (400,): (1, "failed"), (429, 302): (2, "failed"), (0, 0, 0): (3, "failed"), (408, 200): (2, "sent")}
    frame = spark.createDataFrame([(list(codes),) for codes in cases], "replies array<int>")
    planned = {tuple(r["replies"]): r for r in delivery_plan(frame, policy).collect()}
    for codes, (attempts, outcome) in cases.items():
        send, calls = replies(*codes)
        slept = []
        made, error = deliver({}, policy, send, slept.append)
        assert (made, "failed" if error else "sent") == (attempts, outcome) and len(calls) == attempts
        row = planned[codes]
        assert (row["attempts"], row["outcome"], row["wait_ms"]) == (attempts, outcome, round(sum(slept) * 1000))


def test_manual_test_alert():
    send, calls = replies(204, 404)
    sent = manual_test(create_policy("p"), send, url=f" {URL} ", now="2026-02-17T10:00:00.000Z")
    assert sent == {"sentAt": "2026-02-17T10:00:00.000Z", "targetUrl": URL}
    assert calls[0][1]["rule"] == "manual_test" and calls[0][1]["severity"] == "warning"
    with pytest.raises(RuntimeError):
        manual_test(create_policy("p", URL), send)
    with pytest.raises(ValueError):
        manual_test(create_policy("p"), send)


def test_replay_against_brute_force(spark):
    texts = ["2026-02-17T10:00:00.000Z", "2026-02-17T10:00:00Z", "2026-02-17T10:01:00.0005Z", "2026-02-17T10:03:59.999Z", "2026-02-17T10:04",
             "2026-02-17T10:02:00+02:00", "2026-02-17T09:50:00.000Z", "garbage", "2026-02-17T10:59:59.999Z"]
    rows = [(t, "ERROR" if n % 2 == 0 else "INFO") for n, t in enumerate(texts)]
    entries = spark.createDataFrame(rows, "timestamp string, level string").withColumn("event_date", F.lit(None).cast("date"))
    policy = create_policy("p", URL, intervalMs=60_000, windowMinutes=2.5, noLogsThresholdMinutes=1, errorThreshold=1, cooldownMs=150_000)
    counts = {r["tick"]: r for r in replay_counts(entries, policy, "2026-02-17T10:00:00.000Z", 9).collect()}

    def iso(ms):
        return f"2026-02-17T{9 + ms // 3_600_000:02d}:{ms // 60_000 % 60:02d}:{ms // 1000 % 60:02d}.{ms % 1000:03d}Z"

    whole = [t for t in texts if len(t) >= 19]
    fired = []
    for tick in range(9):
        now = 3_600_000 + tick * 60_000
        inside = [(t, lv) for t, lv in rows if t in whole and iso(now - 150_000) <= t <= iso(now)]
        quiet = [t for t in whole if iso(now - 60_000) <= t <= iso(now)]
        got = counts[tick]
        want = (iso(now), sum(lv == "ERROR" for _, lv in inside), len(inside), len(quiet))
        assert (got["triggered_at"], got["error_count"], got["total_count"], got["silence_count"]) == want
        fired += [("error_threshold", tick)] * (want[1] >= 1) + [("no_logs", tick)] * (want[3] == 0)
    result = apply_cooldown(triggers(replay_counts(entries, policy, "2026-02-17T10:00:00.000Z", 9), policy), policy)
    expected, last = set(), {}
    for rule, tick in fired:
        sent = rule not in last or (tick - last[rule]) * 60_000 >= 150_000
        last = {**last, rule: tick} if sent else last
        expected.add((rule, tick, "sent" if sent else "suppressed"))
    assert {(r["rule"], r["tick"], r["status"]) for r in result.collect()} == expected


def by_hand(ticks, gap):
    sent, last = set(), None
    for tick in sorted(ticks):
        if last is None or tick - last >= gap:
            sent.add(tick)
            last = tick
    return sent


@pytest.mark.parametrize("folded", [0, 12, 4096])
def test_cooldown_of_short_and_long_spells(spark, monkeypatch, folded):
    import random

    monkeypatch.setattr(alerts_module, "FOLDED", folded)
    rng = random.Random(folded)
    fired = {rule: sorted(rng.sample(range(900), 250)) + list(range(1000, 1400)) + [2000] for rule in ("a", "b")}
    rows = [("p", rule, tick) for rule, ticks in fired.items() for tick in ticks]
    frame = spark.createDataFrame(rows, "policy_id string, rule string, tick bigint")
    policy = create_policy("p", URL, intervalMs=60_000, cooldownMs=7 * 60_000)
    found = apply_cooldown(frame, policy).collect()
    assert len(found) == len(rows)
    for rule, ticks in fired.items():
        assert {r["tick"] for r in found if r["rule"] == rule and r["status"] == "sent"} == by_hand(ticks, 7)


def test_cooldown_of_a_million_ticks(spark):
    frame = spark.range(1_000_000).select(F.lit("p").alias("policy_id"), F.lit("r").alias("rule"), F.col("id").alias("tick"))
    policy = create_policy("p", URL, intervalMs=1000, cooldownMs=999_000)
    sent = apply_cooldown(frame, policy).where("status = 'sent'")
    row = sent.agg(F.count("*").alias("n"), F.max("tick").alias("top"), F.count_if(F.col("tick") % 999 == 0).alias("fit")).head()
    assert (row["n"], row["top"], row["fit"]) == (1002, 999_999 // 999 * 999, 1002)


def test_cycles_leave_run_records(spark, tmp_path, index):
    log = AlertLog(spark, str(tmp_path / "alerts"))
    policy = create_policy("p", URL, errorThreshold=2, windowMinutes=180)
    assert log.runs().count() == 0
    send, _ = replies(204, 400)
    run_cycle(index, policy, log, send, now="2026-02-17T10:00:00.000Z", clock=lambda: "2026-02-17T10:00:00.000Z")
    run_cycle(index, create_policy("quiet", URL, errorThreshold=99), log, send, now="2026-02-17T10:00:05.000Z")
    state = {r["mode"]: r for r in run_state(log.runs(), "mode").collect()}
    assert (state["p"]["runs"], state["p"]["failed_runs"], state["p"]["last_error"]) == (1, 0, None)
    assert (state["quiet"]["runs"], state["quiet"]["last_success_at"]) == (1, "2026-02-17T10:00:05.000Z")
    run_cycle(index, policy, log, send, now="2026-02-17T11:00:00.000Z", sleep=lambda s: None)  # the reply is 400
    with pytest.raises(ZeroDivisionError):
        run_cycle(index, policy, log, lambda *_: 1 / 0, now="2026-02-17T11:00:01.000Z")
    runs = log.runs().orderBy("run_seq").collect()
    assert [r["error"] for r in runs] == [None, None, "Alert webhook failed (400)", "ZeroDivisionError: division by zero"]
    assert alert_state(log.alerts()).head()["last_error"] == "Alert webhook failed (400)" and alert_state(log.alerts()).head()["failed"] == 1
    snapshot = status_snapshot(index.stats(), log.runs(), log.alerts()).head()
    assert (snapshot["runs"], snapshot["failed_runs"], snapshot["last_error"]) == (2, 2, "ZeroDivisionError: division by zero")
    assert snapshot["last_run_at"] == "2026-02-17T11:00:01.000Z" and snapshot["last_duration_ms"] is not None


def test_updates_go_in_order(spark):
    policies = policy_frame(spark, [create_policy("a"), create_policy("b", URL), create_policy("c")])
    payloads = {
        "a": ['{"enabled":true}', '{"webhookUrl":"http://x"}', '{"intervalMs":2000}', '{"intervalMs":1}'],
        "b": ['{"webhookUrl":null}', '{"enabled":true}', '{"cooldownMs":5000,"enabled":false}'],
    }
    rows = [(p, n, text) for p, texts in payloads.items() for n, text in enumerate(texts)]
    updates = spark.createDataFrame(rows[::-1], "policy_id string, seq int, payload string").repartition(3)
    found = {r["policy_id"]: r for r in apply_policy_updates(policies, parse_policy_updates(updates)).collect()}
    a, b, c = (found[p] for p in "abc")
    assert (a["enabled"], a["webhookUrl"], a["intervalMs"]) == (True, "http://x", 2000)
    assert (a["updates"], a["applied_updates"], a["applied"], a["problem"]) == (4, 2, False, "intervalMs must be greater than or equal to 1000.")
    assert (b["enabled"], b["webhookUrl"], b["cooldownMs"], b["applied_updates"], b["applied"]) == (False, None, 5000, 2, True)
    assert (c["updates"], c["applied_updates"], c["applied"], c["problem"]) == (0, 0, False, None)


def test_policies(spark, tmp_path):
    policies = policy_frame(spark, [create_policy("a"), create_policy("b", URL, intervalMs=5, windowMinutes=-1, errorThreshold=float("nan"))])
    floors = policies.where("policy_id = 'b'").head()
    assert (floors["intervalMs"], floors["windowMinutes"], floors["errorThreshold"], floors["enabled"]) == (1000, 5, 20, True)
    updates = spark.createDataFrame(
        [("a", '{"webhookUrl":" http://new ","intervalMs":1500,"windowMinutes":7,"errorThreshold":9999}'), ("b", '{"cooldownMs":1}')],
        "policy_id string, payload string",
    )
    result = apply_policy_updates(policies, parse_policy_updates(updates))
    rows = {r["policy_id"]: r for r in result.collect()}
    assert rows["a"]["applied"] and rows["a"]["enabled"] and rows["a"]["webhookUrl"] == "http://new"
    assert (rows["a"]["intervalMs"], rows["a"]["windowMinutes"], rows["a"]["errorThreshold"]) == (1500, 7, 9999)
    assert not rows["b"]["applied"] and rows["b"]["problem"] == "cooldownMs must be greater than or equal to 1000."
    assert {r["webhookUrl"] for r in masked(result).collect()} == {"[configured]"}

    persist_policies(result, str(tmp_path / "policies"))
    defaults = policy_frame(spark, [create_policy("a"), create_policy("b"), create_policy("c")])
    loaded = {r["policy_id"]: r for r in load_policies(spark.read.parquet(str(tmp_path / "policies")), defaults).collect()}
    assert loaded["a"]["webhookUrl"] == "http://new" and loaded["a"]["intervalMs"] == 1500
    assert loaded["b"]["webhookUrl"] == URL and loaded["c"]["webhookUrl"] is None and not loaded["c"]["applied"]
