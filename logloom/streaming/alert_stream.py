"""Live alerts as streaming queries."""

from __future__ import annotations

import json
import math
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from logloom.functions.times import iso_millis, utc_ntz
from logloom.operators.alerts import (
    ERROR_THRESHOLD,
    NO_LOGS,
    SENT,
    SEVERITY,
    SUPPRESSED,
    AlertLog,
    Sender,
    http_sender,
    millis_around,
    run_cycle,
)
from logloom.operators.index import LogIndex
from logloom.operators.policies import AlertPolicy

TRIGGER_DDL = "rule string, tick_ms bigint, error_count bigint, total_count bigint"
ALERT_STREAM_DDL = "rule string, severity string, tick_ms bigint, error_count bigint, total_count bigint, status string"

_STATE_DDL = "last_sent bigint, last_tick bigint, held string"


def alert_cycles(
    ticks: DataFrame,
    index: LogIndex,
    policy: AlertPolicy,
    log: AlertLog,
    checkpoint: str,
    send: Sender = http_sender,
    trigger: dict | None = None,
    **options,
) -> StreamingQuery:
    """Evaluate the rules on the index at every tick of a stream with column ``timestamp``.

    Several ticks in one batch are evaluated once, at the latest of them. Delivery happens
    here on the driver: a cycle has at most two alerts.
    """

    def evaluate(batch: DataFrame, _: int) -> None:
        at = batch.agg(F.max(iso_millis(utc_ntz(F.col("timestamp")))).alias("at")).head()["at"]
        if at is not None:
            run_cycle(index, policy, log, send, now=at, **options)

    writer = ticks.writeStream.foreachBatch(evaluate).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"processingTime": f"{int(policy.intervalMs)} milliseconds"})).start()


def lookback_windows(entries: DataFrame, policy: AlertPolicy) -> DataFrame:
    """Error and total counts of the sliding windows of a stream of entries.

    Entries are counted once, in panes that both the window and the interval are multiples of; a second
    step adds up the panes of each window, so it is panes that are repeated, not entries.
    Windows end at multiples of the interval. The watermark is one look-back, so an entry
    counts as long as a window it belongs to can still be open.
    """
    window_ms, interval_ms = int(policy.windowMinutes * 60_000), int(policy.intervalMs)
    floor_ms, _ = millis_around(F.col("timestamp"))
    timed = entries.select(F.timestamp_millis(floor_ms).alias("ts"), (F.col("level") == "ERROR").alias("is_error"))
    panes = (
        timed.where(F.col("ts").isNotNull())
        .withWatermark("ts", f"{window_ms} milliseconds")
        .groupBy(F.window("ts", f"{math.gcd(window_ms, interval_ms)} milliseconds").alias("pane"))
        .agg(F.count_if("is_error").alias("errors"), F.count("*").alias("total"))
    )
    span = F.window("pane", f"{window_ms} milliseconds", f"{interval_ms} milliseconds")
    return panes.groupBy(span.alias("window")).agg(F.sum("errors").alias("error_count"), F.sum("total").alias("total_count"))


def threshold_triggers(windows: DataFrame, policy: AlertPolicy) -> DataFrame:
    """Windows that reach the error threshold, as rule and tick (the end of the window)."""
    return windows.where(F.col("error_count") >= policy.errorThreshold).select(
        F.lit(ERROR_THRESHOLD).alias("rule"),
        F.unix_millis(F.col("window.end")).alias("tick_ms"),
        "error_count",
        "total_count",
    )


def write_triggers(triggers: DataFrame, path: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Keep triggers as a Parquet table, each exactly once."""
    writer = triggers.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"processingTime": "1 second"})).start(path)


def read_triggers(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.schema(TRIGGER_DDL).parquet(path)


def _in_order(
    held: str | None, arrived: list[list[int]], done: int | None, max_delay_ms: int
) -> tuple[list[list[int]], str, int | None]:
    """Rows to evaluate now, rows to hold, and the last tick evaluated; a row begins with its tick.

    Ticks wait until one that is ``max_delay_ms`` later has come, and go in order. A tick that
    comes after a later one was evaluated is skipped, and so is the second of two equal ticks.
    """
    rows = sorted({row[0]: row for row in [*arrived, *json.loads(held or "[]")]}.values())
    ready = rows[-1][0] - max_delay_ms if rows else 0
    due = [row for row in rows if row[0] <= ready and (done is None or row[0] > done)]
    return due, json.dumps([row for row in rows if row[0] > ready]), due[-1][0] if due else done


def with_cooldown(triggers: DataFrame, policy: AlertPolicy, max_delay_ms: int = 0) -> DataFrame:
    """Mark each trigger sent or suppressed; the state of a rule is the time of its last send.

    Triggers may come up to ``max_delay_ms`` out of order and are held for so long; later ones
    are skipped.

    Custom state cannot follow an aggregation in one streaming query, so triggers of
    ``lookback_windows`` pass through a table: ``write_triggers``, then ``read_triggers``.
    Triggers are at most one row per tick and rule, so a group stays small.
    """
    cooldown = int(policy.cooldownMs)

    def decide(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        (rule,) = key
        last, done, held = state.get if state.exists else (None, None, None)
        arrived = pd.concat(list(frames))[["tick_ms", "error_count", "total_count"]].astype(int).values.tolist()
        due, held, done = _in_order(held, arrived, done, max_delay_ms)
        statuses = []
        for tick, *_ in due:
            ready = last is None or tick - last >= cooldown
            statuses.append(SENT if ready else SUPPRESSED)
            last = tick if ready else last
        state.update((last, done, held))
        yield _alert_frame(rule, due, statuses)

    return triggers.groupBy("rule").applyInPandasWithState(
        decide, ALERT_STREAM_DDL, _STATE_DDL, "append", GroupStateTimeout.NoTimeout
    )


def _alert_frame(rule: str, due: list[list[int]], statuses: list[str]) -> pd.DataFrame:
    numbers = {name: pd.Series([row[n] for row in due], dtype="int64") for n, name in enumerate(("tick_ms", "error_count", "total_count"))}
    texts = {"rule": [rule] * len(due), "severity": [SEVERITY[rule]] * len(due), "status": statuses}
    columns = numbers | {name: pd.Series(values, dtype="object") for name, values in texts.items()}
    return pd.DataFrame({name: columns[name] for name in ("rule", "severity", "tick_ms", "error_count", "total_count", "status")})


def _newest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per task and kind instead of one per entry."""
    newest: int | None = None
    ticks: list[int] = []
    for batch in batches:
        is_tick = batch.column("is_tick")
        ticks += pc.filter(batch.column("at_ms"), is_tick).to_pylist()
        top = pc.max(pc.filter(batch.column("at_ms"), pc.invert(is_tick))).as_py()
        if top is not None:
            newest = top if newest is None else max(newest, top)
    rows = [(at, True) for at in ticks] + ([(newest, False)] if newest is not None else [])
    yield pa.RecordBatch.from_arrays(
        [
            pa.array([NO_LOGS] * len(rows), pa.string()),
            pa.array([at for at, _ in rows], pa.int64()),
            pa.array([tick for _, tick in rows], pa.bool_()),
        ],
        names=["rule", "at_ms", "is_tick"],
    )


def silence_alerts(entries: DataFrame, ticks: DataFrame, policy: AlertPolicy, max_delay_ms: int = 0) -> DataFrame:
    """Alert at each tick that follows a silence, with cooldown.

    Ticks may come up to ``max_delay_ms`` out of order and are held for so long; later ones are
    skipped.

    A silent input produces no batches of its own, so a stream of ticks (column ``timestamp``,
    for example the rate source) is merged in. Each task first reduces its entries to the
    newest time; the stateful step sees those few rows and the ticks.
    """
    silence, cooldown = int(policy.noLogsThresholdMinutes * 60_000), int(policy.cooldownMs)
    floor_ms, _ = millis_around(F.col("timestamp"))
    logs = entries.select(floor_ms.alias("at_ms"), F.lit(False).alias("is_tick")).where("at_ms is not null")
    clock = ticks.select(F.unix_millis("timestamp").alias("at_ms"), F.lit(True).alias("is_tick"))
    merged = logs.unionByName(clock).mapInArrow(_newest, "rule string, at_ms bigint, is_tick boolean")

    def decide(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        newest, last, done, held = state.get if state.exists else (None, None, None, None)
        rows = pd.concat(list(frames))
        seen = rows.loc[~rows["is_tick"], "at_ms"]
        if len(seen):
            newest = int(seen.max()) if newest is None else max(newest, int(seen.max()))
        arrived = [[tick, 0, 0] for tick in rows.loc[rows["is_tick"], "at_ms"].astype(int).tolist()]
        due, held, done = _in_order(held, arrived, done, max_delay_ms)
        fired, statuses = [row for row in due if newest is None or newest < row[0] - silence], []
        for tick, *_ in fired:
            ready = last is None or tick - last >= cooldown
            statuses.append(SENT if ready else SUPPRESSED)
            last = tick if ready else last
        state.update((newest, last, done, held))
        yield _alert_frame(NO_LOGS, fired, statuses)

    return merged.groupBy("rule").applyInPandasWithState(
        decide, ALERT_STREAM_DDL, f"newest bigint, {_STATE_DDL}", "append", GroupStateTimeout.NoTimeout
    )
