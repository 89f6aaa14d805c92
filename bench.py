"""Benchmark: index throughput and query times. Prints one JSON line.

BENCH_SF_DIR is the data folder (default /root/testdata/sf0.1), BENCH_CPUS the local cores.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time
from collections.abc import Callable
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from logloom import LogIndex, LogQuery  # noqa: E402
from logloom.operators import alerts  # noqa: E402
from logloom.plans.base_logs import GLOB, NOW, Workspace, event_lines, write_lines  # noqa: E402
from logloom.plans.catalog import alert_policy, queries  # noqa: E402
from logloom.session import local_session, scratch_path  # noqa: E402

REPEATS = 3
PAGE_REPEATS = 5
TABLE_QUERIES = [
    "filter_level",
    "filter_field_value",
    "filter_time_range",
    "filter_combined",
    "page_first",
    "count_filtered",
    "aggregate_level",
    "aggregate_event",
    "aggregate_field",
    "aggregate_correlation",
    "aggregate_filtered",
    "field_index",
    "index_stats",
    "retention_report",
    "parse_error_report",
    "normalize_records",
    "ingest_request_report",
    "alert_lookback_counts",
    "alert_cooldown",
    "lineitem_buckets",
]


def timed(run: Callable[[], object], repeats: int = REPEATS) -> float:
    """Median seconds after one warm-up run."""
    seconds = []
    for _ in range(repeats + 1):
        start = time.perf_counter()
        run()
        seconds.append(time.perf_counter() - start)
    return round(statistics.median(seconds[1:]), 3)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, "logloom-bench", shuffle_partitions=int(cpus) if cpus.isdigit() else 8)
    workspace = Workspace.of(spark, sf_dir)
    times: dict[str, float] = {}

    def sink(frame) -> None:
        frame.write.format("noop").mode("overwrite").save()

    workspace.logs
    records = workspace.table("events").count()

    def build() -> None:
        LogIndex(spark, scratch_path(spark, "bench-index")).index_directory(workspace.logs, NOW, GLOB)

    times["index_build"] = timed(build, 2)

    root = scratch_path(spark, "bench-growing")
    grown = LogIndex(spark, scratch_path(spark, "bench-incremental"))
    lines = event_lines(workspace.table("events"))
    write_lines(lines, f"{root}/base")
    grown.index_incremental(root, NOW, GLOB)
    seconds = []
    for n in range(3):
        write_lines(lines.where(f"event_id >= {n * 2500} and event_id < {(n + 1) * 2500}"), f"{root}/more{n}")
        start = time.perf_counter()
        grown.index_incremental(root, NOW, GLOB)
        seconds.append(time.perf_counter() - start)
    times["incremental_append_2500"] = round(statistics.median(seconds), 3)
    times["incremental_nothing_new"] = timed(lambda: grown.index_incremental(root, NOW, GLOB))

    index = workspace.index
    pages = {
        "page_by_level_120": LogQuery(level="ERROR", limit=120),
        "page_by_field_120": LogQuery(field="userId", value="7", limit=120),
        "page_by_range_250": LogQuery(from_="2024-01-10", to="2024-01-11", limit=250),
    }
    for name, query in pages.items():
        times[name] = timed(lambda query=query: index.page(query), PAGE_REPEATS)
    times["alert_cycle_counts"] = timed(
        lambda: alerts.cycle_counts(index.entries(LogQuery(from_="2024-01-19")), alert_policy(), NOW).collect()
    )
    for name in TABLE_QUERIES:
        times[name] = timed(lambda name=name: sink(queries()[name](spark, sf_dir)))

    print(
        json.dumps(
            {
                "metric": "total_seconds",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": Path(sf_dir).name.removeprefix("sf"),
                "records": records,
                "index_records_per_sec": round(records / times["index_build"]),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
