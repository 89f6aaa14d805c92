"""Threshold and silence alerts: replay over history, live cycles, delivery."""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.request
from collections.abc import Callable
from dataclasses import dataclass, replace
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from logloom.functions.times import from_iso, iso_from_millis, iso_minus, to_iso, utc_now
from logloom.operators.filters import LogQuery
from logloom.operators.index import LogIndex
from logloom.operators.policies import AlertPolicy
from logloom.operators.running import running
from logloom.schema import ALERT_SCHEMA, RUN_SCHEMA
from logloom.session import scratch_path
from logloom.sources.files import path_exists

SOURCE = "logloom"
ERROR_THRESHOLD, NO_LOGS, MANUAL_TEST = "error_threshold", "no_logs", "manual_test"
SEVERITY = {ERROR_THRESHOLD: "critical", NO_LOGS: "warning", MANUAL_TEST: "warning"}
SENT, FAILED, SUPPRESSED = "sent", "failed", "suppressed"
FOLDED = 4096  # ticks of a spell that is folded in one piece


# ---- replay over past ticks ---------------------------------------------------------


def millis_around(text: Column) -> tuple[Column, Column]:
    """Largest and smallest millisecond whose ISO text is not after / not before ``text``.

    They are equal for canonical text. Other text that starts with a date and time to the
    second falls between two milliseconds, by text order. NULL for anything else.
    """
    head, rest = F.substring(text, 1, 19), F.substring(text, 20, 1000)
    head = F.when(head.rlike(r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d$"), head)
    second = F.unix_millis(F.try_to_timestamp(F.concat(head, F.lit("+00:00"))))
    digits = F.regexp_extract(rest, r"^\.(\d{0,3})", 1)
    width = F.length(digits)
    tail = F.substring(rest, width + 2, 1000)
    # With fewer than three digits the next character is compared with a digit, else with Z.
    above = F.when(width == 3, tail > "Z").otherwise(tail >= ":")
    scaled = (F.concat(F.lit("0"), digits).cast("int") + above.cast("int")) * F.pow(F.lit(10), 3 - width).cast("int")
    low = (
        F.when(rest.rlike(r"^\.\d{3}Z$"), F.substring(rest, 2, 3).cast("int"))
        .when(~rest.startswith("."), F.when(rest < ".", F.lit(-1)).otherwise(F.lit(999)))
        .when(width == 3, digits.cast("int") - 1 + above.cast("int"))
        .otherwise(scaled - 1)
    )
    exact = rest.rlike(r"^\.\d{3}Z$")
    return second + low, second + low + F.when(exact, 0).otherwise(1)


def replay_counts(entries: DataFrame, policy: AlertPolicy, first_tick: str, ticks: int) -> DataFrame:
    """Look-back counts at every evaluation tick: tick, triggered_at, error_count, total_count, silence_count.

    At tick t the window [t - W, t] counts the entries whose timestamp text lies in it. An
    entry is in the window of a range of ticks, so it is counted up at the first and down
    after the last of them; running sums give all windows in one pass over the entries.
    """
    start = int(from_iso(first_tick).timestamp() * 1000)
    interval = int(policy.intervalMs)
    window = int(policy.windowMinutes * 60_000)
    silence = int(policy.noLogsThresholdMinutes * 60_000)
    oldest, newest = start - max(window, silence), start + (ticks - 1) * interval
    bounds = LogQuery(from_=_iso(oldest), to=_iso(newest)).predicate()

    floor_ms, ceil_ms = millis_around(F.col("timestamp"))
    enters = F.greatest(F.ceil((ceil_ms - start) / interval), F.lit(0))

    def leaves(length: int) -> Column:
        return F.floor((floor_ms + length - start) / interval) + 1

    spans = (
        entries.where(bounds)
        .select(
            enters.alias("enters"),
            leaves(window).alias("leaves"),
            leaves(silence).alias("silence_leaves"),
            (F.col("level") == "ERROR").cast("int").alias("is_error"),
        )
        .where("enters is not null")
        .groupBy("enters", "leaves", "silence_leaves")
        .agg(F.sum("is_error").alias("errors"), F.count("*").alias("total"))
    )
    in_window, in_silence = F.col("leaves") > F.col("enters"), F.col("silence_leaves") > F.col("enters")

    def step(at: str, counted: Column, sign: int, main: bool) -> Column:
        def amount(value: Column, used: bool) -> Column:
            return F.when(counted, value * sign).otherwise(0) if used else F.lit(0).cast("bigint")

        return F.struct(
            F.col(at).cast("bigint").alias("tick"),
            amount(F.col("errors"), main).alias("errors"),
            amount(F.col("total"), main).alias("total"),
            amount(F.col("total"), not main).alias("quiet"),
        )

    steps = F.array(
        step("enters", in_window, 1, True),
        step("leaves", in_window, -1, True),
        step("enters", in_silence, 1, False),
        step("silence_leaves", in_silence, -1, False),
    )
    deltas = (
        spans.select(F.inline(steps))
        .groupBy("tick")
        .agg(F.sum("errors").alias("errors"), F.sum("total").alias("total"), F.sum("quiet").alias("quiet"))
    )
    table = entries.sparkSession.range(ticks).withColumnRenamed("id", "tick").join(deltas, "tick", "left")
    counts = running(
        table,
        [],
        "tick",
        {
            "error_count": ("sum", F.coalesce("errors", F.lit(0))),
            "total_count": ("sum", F.coalesce("total", F.lit(0))),
            "silence_count": ("sum", F.coalesce("quiet", F.lit(0))),
        },
    )
    return counts.select(
        "tick",
        iso_from_millis(F.lit(start) + F.col("tick") * interval).alias("triggered_at"),
        "error_count",
        "total_count",
        "silence_count",
    )


def _iso(millis: int) -> str:
    return to_iso(datetime.fromtimestamp(millis / 1000, timezone.utc))


def triggers(counts: DataFrame, policy: AlertPolicy) -> DataFrame:
    """Rules that fire at each tick: policy_id, tick, triggered_at, rule, severity, details."""
    no_details = F.lit(None).cast("map<string,double>")
    error_details = F.create_map(
        *[F.lit("errorCount"), F.col("error_count").cast("double")],
        *[F.lit("threshold"), F.lit(float(policy.errorThreshold))],
        *[F.lit("totalWindowCount"), F.col("total_count").cast("double")],
        *[F.lit("windowMinutes"), F.lit(float(policy.windowMinutes))],
    )
    quiet_details = F.create_map(F.lit("thresholdMinutes"), F.lit(float(policy.noLogsThresholdMinutes)))
    errors_fire = F.col("error_count") >= policy.errorThreshold
    quiet_fires = F.lit(policy.noLogsThresholdMinutes > 0) & (F.col("silence_count") == 0)

    def rule(name: str, fires: Column, details: Column) -> Column:
        return F.struct(
            F.lit(name).alias("rule"),
            F.lit(SEVERITY[name]).alias("severity"),
            F.when(fires, details).otherwise(no_details).alias("details"),
        )

    rules = F.array(rule(ERROR_THRESHOLD, errors_fire, error_details), rule(NO_LOGS, quiet_fires, quiet_details))
    return (
        counts.select(F.lit(policy.policy_id).alias("policy_id"), "tick", "triggered_at", F.inline(rules))
        .where("details is not null")
    )


def apply_cooldown(fired: DataFrame, policy: AlertPolicy) -> DataFrame:
    """Add ``status`` sent or suppressed: a rule stays quiet until the cooldown since its last send is over.

    A trigger that comes a full cooldown after the one before it is always sent. Such triggers
    cut a rule's history into independent spells. A spell of up to ``FOLDED`` ticks is folded in order; in a
    longer one ``reached`` follows links from each trigger to the first one a cooldown later.
    """
    gap = -(-int(policy.cooldownMs) // int(policy.intervalMs))  # whole ticks between two sends
    fired = _kept(fired)
    keys = ["policy_id", "rule"]
    marked = running(fired, keys, "tick", {"_previous": ("max", F.col("tick"))}, include_current=False)
    fresh = F.col("_previous").isNull() | (F.col("tick") - F.col("_previous") >= gap)
    marked = marked.withColumn("_start", F.when(fresh, F.col("tick")))
    marked = running(marked, keys, "tick", {"_spell": ("max", F.col("_start"))}).select(*keys, "_spell", "tick")
    span = fired.agg(F.max("tick") - F.min("tick")).head()[0] or 0
    found = _folded(marked, keys, gap) if span <= FOLDED else _sent(_kept(marked), keys, gap)
    return (
        fired.join(found.withColumn("_sent", F.lit(True)), [*keys, "tick"], "left")
        .withColumn("status", F.when(F.col("_sent"), F.lit(SENT)).otherwise(F.lit(SUPPRESSED)))
        .drop("_sent")
    )


def _sent(marked: DataFrame, keys: list[str], gap: int) -> DataFrame:
    """The ticks that are sent, spells taken by their length."""
    spell = [*keys, "_spell"]
    lengths = marked.groupBy(*spell).agg((F.max("tick") - F.min("tick")).alias("_length"))
    long = lengths.where(F.col("_length") > FOLDED)
    short = _folded(marked.join(long, spell, "left_anti"), keys, gap)
    return short.unionByName(reached(marked.join(long, spell, "left_semi"), spell, gap).select(*keys, "tick"))


def _kept(rows: DataFrame) -> DataFrame:
    """The rows written down and read again, so that what they took is done once."""
    path = scratch_path(rows.sparkSession, "cooldown")
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def _folded(marked: DataFrame, keys: list[str], gap: int) -> DataFrame:
    """The ticks of short spells that are sent."""
    start = F.struct(F.lit(-gap).cast("bigint").alias("last"), F.array().cast("array<bigint>").alias("sends"))

    def send(state: Column, tick: Column) -> Column:
        ready = tick - state["last"] >= gap
        return F.when(
            ready, F.struct(tick.alias("last"), F.array_append(state["sends"], tick).alias("sends"))
        ).otherwise(state)

    ticks = marked.groupBy(*keys, "_spell").agg(F.sort_array(F.collect_list("tick")).alias("_ticks"))
    return ticks.select(*keys, F.explode(F.aggregate("_ticks", start, send, lambda state: state["sends"])).alias("tick"))


def reached(marked: DataFrame, spell: list[str], gap: int) -> DataFrame:
    """The ticks of spells that are sent: those that links of a cooldown lead to from a spell's first tick.

    Marks spread by doubling: what is marked marks what its links lead to, then every link is replaced by two
    links in a row, so a chain of n sends takes log n rounds. Each round is written down.
    """
    # The next trigger at or after tick + gap: the running minimum from behind over triggers and questions.
    asked = marked.select(*spell, F.col("tick").alias("at"), F.col("tick").alias("target"), F.lit(None).cast("bigint").alias("tick"))
    asked = asked.unionByName(marked.select(*spell, (F.col("tick") + gap).alias("at"), F.lit(None).cast("bigint").alias("target"), "tick"))
    order = (-2 * F.col("at") + F.when(F.col("target").isNull(), 1).otherwise(0)).alias("_order")  # a trigger is met before a question
    placed = running(asked.select("*", order), spell, "_order", {"_next": ("max", -F.col("target"))})
    links = _kept(placed.where("tick is not null and _next is not null").select(*spell, "tick", (-F.col("_next")).alias("next")))
    marks = _kept(marked.where(F.col("tick") == F.col("_spell")).select(*spell, "tick"))
    while not links.isEmpty():
        ahead = marks.join(links, [*spell, "tick"]).select(*spell, F.col("next").alias("tick"))
        marks = _kept(marks.unionByName(ahead))
        far = links.select(*spell, F.col("tick").alias("next"), F.col("next").alias("_far"))
        links = _kept(links.join(far, [*spell, "next"]).select(*spell, "tick", F.col("_far").alias("next")))
    return marks.distinct()


def alert_state(alerts: DataFrame) -> DataFrame:
    """One row per policy: sent, suppressed, failed, the last send of each rule, and the error of the newest alert if it failed."""
    error = (F.col("error") if "error" in alerts.columns else F.lit(None).cast("string")).alias("error")
    by_rule = alerts.groupBy("policy_id", "rule").agg(
        F.count_if(F.col("status") == SENT).alias("sent"),
        F.count_if(F.col("status") == SUPPRESSED).alias("suppressed"),
        F.count_if(F.col("status") == FAILED).alias("failed"),
        F.max(F.when(F.col("status") == SENT, F.col("triggered_at"))).alias("last"),
        F.max(F.struct("triggered_at", error)).alias("newest"),
    )
    pairs = F.collect_list(F.when(F.col("last").isNotNull(), F.struct("rule", "last")))  # one per rule
    return by_rule.groupBy("policy_id").agg(
        F.sum("sent").alias("sent"),
        F.sum("suppressed").alias("suppressed"),
        F.sum("failed").alias("failed"),
        F.max("newest")["error"].alias("last_error"),
        F.map_from_entries(F.sort_array(pairs)).alias("last_trigger_by_rule"),
    )


# ---- delivery -----------------------------------------------------------------------


def is_retryable(status: Column) -> Column:
    """Replies worth another attempt; 0 stands for a timeout or network failure."""
    return (status == 0) | status.isin(408, 429) | (status >= 500)


def is_delivered(status: Column) -> Column:
    return status.between(200, 299)


def delivery_plan(alerts: DataFrame, policy: AlertPolicy) -> DataFrame:
    """Outcome of delivering each alert given ``replies``, the status of each attempt in order.

    Adds attempts, outcome (sent or failed) and wait_ms, the back-off slept between attempts.
    Attempts beyond the replies given count as network failures.
    """
    limit, backoff = int(policy.webhookRetryAttempts), float(policy.webhookBackoffMs)
    padded = F.slice(F.concat("replies", F.array_repeat(F.lit(0), limit)), 1, limit)
    final = F.transform(padded, lambda status, at: F.when(~is_retryable(status), at + 1))
    attempts = F.coalesce(F.array_min(final), F.lit(limit))
    attempt_numbers = F.sequence(F.lit(1), F.lit(limit))
    waits = F.transform(attempt_numbers, lambda n: F.floor(F.lit(backoff) * F.pow(F.lit(2.0), n - 1) + 0.5))
    waited = F.aggregate(F.slice(waits, 1, F.col("attempts") - 1), F.lit(0).cast("bigint"), lambda a, b: a + b)
    last = F.element_at(padded, F.col("attempts"))
    return (
        alerts.withColumn("attempts", attempts.cast("int"))
        .withColumn("outcome", F.when(is_delivered(last), F.lit(SENT)).otherwise(F.lit(FAILED)))
        .withColumn("wait_ms", waited)
    )


@dataclass(frozen=True)
class Reply:
    """What a sender got: an HTTP status, or 0 with a reason when there was no reply."""

    status: int
    text: str = ""


Sender = Callable[[str, dict, float], Reply]


def http_sender(url: str, payload: dict, timeout_ms: float) -> Reply:
    """POST the payload as JSON."""
    request = urllib.request.Request(
        url,
        data=json.dumps(payload).encode(),
        headers={"content-type": "application/json; charset=utf-8"},
        method="POST",
    )
    try:
        with urllib.request.urlopen(request, timeout=timeout_ms / 1000) as response:
            return Reply(response.status)
    except urllib.error.HTTPError as error:
        return Reply(error.code, error.read(240).decode("utf-8", "replace"))
    except TimeoutError:
        return Reply(0, f"Alert webhook timeout after {timeout_ms:g}ms")
    except OSError as error:
        return Reply(0, str(error))


def deliver(
    payload: dict, policy: AlertPolicy, send: Sender, sleep: Callable[[float], None] = time.sleep
) -> tuple[int, str | None]:
    """Send one alert with retries: attempts made, and the error of the last one or None."""
    limit = int(policy.webhookRetryAttempts)
    for attempt in range(1, limit + 1):
        reply = send(policy.webhookUrl, payload, policy.webhookTimeoutMs)
        if 200 <= reply.status <= 299:
            return attempt, None
        error = (reply.text or "no reply") if reply.status == 0 else f"Alert webhook failed ({reply.status})"
        if reply.status and reply.text:
            error += f": {reply.text[:240]}"
        retryable = reply.status in (0, 408, 429) or reply.status >= 500
        if not retryable or attempt == limit:
            return attempt, error
        sleep(round(policy.webhookBackoffMs * 2 ** (attempt - 1)) / 1000)
    raise AssertionError("unreachable")


def payload_of(rule: str, triggered_at: str, details: dict, service_url: str) -> dict:
    return {
        "source": SOURCE,
        "rule": rule,
        "severity": SEVERITY[rule],
        "triggeredAt": triggered_at,
        "serviceUrl": service_url,
        "details": details,
    }


def manual_test(
    policy: AlertPolicy,
    send: Sender,
    url: str | None = None,
    now: str | None = None,
    service_url: str = "",
    sleep: Callable[[float], None] = time.sleep,
) -> dict:
    """Send a test alert to ``url`` or the policy's webhook; raises if it cannot be delivered."""
    target = (url or "").strip() or policy.webhookUrl
    if not target:
        raise ValueError("Alert webhook URL is not configured.")
    sent_at = now or utc_now()
    body = payload_of(MANUAL_TEST, sent_at, {"message": "Manual webhook test event"}, service_url)
    _, error = deliver(body, replace(policy, webhookUrl=target), send, sleep)
    if error is not None:
        raise RuntimeError(error)
    return {"sentAt": sent_at, "targetUrl": target}


class AlertLog:
    """Alerts sent, suppressed or failed, kept as Parquet."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def alerts(self) -> DataFrame:
        if not path_exists(self.spark, self.path):
            return self.spark.createDataFrame([], ALERT_SCHEMA)
        return self.spark.read.schema(ALERT_SCHEMA).parquet(self.path)

    def append(self, rows: list[tuple]) -> None:
        if rows:
            self.spark.createDataFrame(rows, ALERT_SCHEMA).coalesce(1).write.mode("append").parquet(self.path)

    def runs(self) -> DataFrame:
        """One row per evaluation, whether anything fired or not; ``mode`` is the policy."""
        if not path_exists(self.spark, f"{self.path}/_runs"):
            return self.spark.createDataFrame([], RUN_SCHEMA)
        return self.spark.read.schema(RUN_SCHEMA).parquet(f"{self.path}/_runs")

    def log_run(self, policy_id: str, at: str, took_ms: int, counters: dict[str, int], error: str | None) -> None:
        row = {
            "run_seq": time.time_ns() // 1000,
            "kind": "alert",
            "mode": policy_id,
            "status": "finished" if error is None else "failed",
            "started_at": at,
            "finished_at": at,
            "counters": counters,
            "error": error,
            "duration_ms": took_ms,
        }
        rows = self.spark.createDataFrame([tuple(row.get(f.name) for f in RUN_SCHEMA.fields)], RUN_SCHEMA)
        rows.coalesce(1).write.mode("append").parquet(f"{self.path}/_runs")

    def last_sent(self, policy_id: str) -> dict[str, str]:
        sent = self.alerts().where((F.col("policy_id") == policy_id) & (F.col("status") == SENT))
        return {row["rule"]: row["at"] for row in sent.groupBy("rule").agg(F.max("sent_at").alias("at")).collect()}


def _window_starts(policy: AlertPolicy, now: str) -> tuple[str, str]:
    return iso_minus(now, minutes=policy.windowMinutes), iso_minus(now, minutes=policy.noLogsThresholdMinutes)


def cycle_counts(entries: DataFrame, policy: AlertPolicy, now: str) -> DataFrame:
    """The counts of one live evaluation, in one pass over the days the windows reach.

    Windows have no upper end: entries stamped in the future count.
    """
    window, quiet = _window_starts(policy, now)
    timestamp = F.col("timestamp")
    in_window = timestamp >= window
    return entries.where(LogQuery(from_=min(window, quiet)).predicate()).agg(
        F.count_if(in_window & (F.col("level") == "ERROR")).alias("error_count"),
        F.count_if(in_window).alias("total_count"),
        F.count_if(timestamp >= quiet).alias("silence_count"),
        F.lit(now).alias("triggered_at"),
        F.lit(0).alias("tick"),
    )


def run_cycle(
    index: LogIndex,
    policy: AlertPolicy,
    log: AlertLog,
    send: Sender = http_sender,
    now: str | None = None,
    service_url: str = "",
    sleep: Callable[[float], None] = time.sleep,
    clock: Callable[[], str] = utc_now,
) -> list[tuple]:
    """Evaluate the rules once on the index and deliver what fires.

    A failed delivery ends the cycle: later rules wait for the next one and no cooldown starts. Every cycle
    leaves a run record, with the error of what failed in it.
    """
    if not policy.enabled or not policy.webhookUrl:
        return []
    now, began = now or utc_now(), time.monotonic()
    rows: list[tuple] = []
    problem: str | None = None
    try:
        rows = _evaluated(index, policy, log, send, now, service_url, sleep, clock)
        problem = next((row[-1] for row in rows if row[5] == FAILED), None)
        return rows
    except Exception as error:
        problem = f"{type(error).__name__}: {error}".split("\n")[0]
        raise
    finally:
        counters = {status: sum(row[5] == status for row in rows) for status in (SENT, SUPPRESSED, FAILED)}
        log.log_run(policy.policy_id, now, round((time.monotonic() - began) * 1000), counters, problem)


def _evaluated(
    index: LogIndex, policy: AlertPolicy, log: AlertLog, send: Sender, now: str, service_url: str, sleep: Callable[[float], None], clock: Callable[[], str]
) -> list[tuple]:
    recent = index.entries(LogQuery(from_=min(_window_starts(policy, now))))
    fired = triggers(cycle_counts(recent, policy, now), policy).collect()  # at most two rows
    last_sent = log.last_sent(policy.policy_id) if fired else {}
    rows = []
    for row in sorted(fired, key=lambda r: r["rule"] != ERROR_THRESHOLD):
        rule, details = row["rule"], dict(row["details"])
        base = (policy.policy_id, rule, SEVERITY[rule], now, details)
        if rule in last_sent:
            since = (from_iso(now) - from_iso(last_sent[rule])).total_seconds() * 1000
            if since < policy.cooldownMs:
                rows.append((*base, SUPPRESSED, 0, None, None))
                continue
        attempts, error = deliver(payload_of(rule, now, details, service_url), policy, send, sleep)
        if error is not None:
            rows.append((*base, FAILED, attempts, None, error))
            break
        rows.append((*base, SENT, attempts, clock(), None))
    log.append(rows)
    return rows
