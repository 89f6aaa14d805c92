"""Reports over classified lines, runs and the whole index."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from logloom.functions.normalize import BAD, BLANK, INGESTED


def line_counts(classified: DataFrame, *by: str) -> DataFrame:
    """Counts of classified lines, in total or by columns ``by``."""
    kind = F.col("line_kind")
    return classified.groupBy(*by).agg(
        F.count("*").alias("lines_scanned"),
        F.count_if(kind == INGESTED).alias("records"),
        F.count_if(kind == BAD).alias("parse_errors"),
        F.count_if(kind == BLANK).alias("blank_lines"),
    )


def run_totals(runs: DataFrame) -> DataFrame:
    """Value of each counter in the last finished run of its kind, and its total over all runs."""
    counters = runs.where("status = 'finished'").select("kind", "run_seq", F.explode("counters").alias("counter", "value"))
    return counters.groupBy("kind", "counter").agg(
        F.max_by("value", "run_seq").alias("last_run"),
        F.sum("value").alias("total"),
        F.count("*").alias("runs"),
    )


def run_state(runs: DataFrame, *by: str) -> DataFrame:
    """Runs and failures, and how the newest run went; its error is gone once a run succeeds."""
    finished = F.col("status") == "finished"
    return runs.groupBy(*by).agg(
        F.count_if(finished).alias("runs"),
        F.count_if(~finished).alias("failed_runs"),
        F.max("started_at").alias("last_run_at"),
        F.max(F.when(finished, F.col("finished_at"))).alias("last_success_at"),
        F.max_by("duration_ms", "run_seq").alias("last_duration_ms"),
        F.max_by("error", "run_seq").alias("last_error"),
    )


def status_snapshot(stats: DataFrame, runs: DataFrame, alerts: DataFrame) -> DataFrame:
    """One row on the state of the service: storage, runs and alerts."""
    finished = F.col("status") == "finished"
    counters = runs.agg(
        F.coalesce(F.sum(F.when(finished, F.try_element_at("counters", F.lit("records_inserted")))), F.lit(0)).alias(
            "records_inserted_total"
        ),
        F.coalesce(F.sum(F.when(finished, F.try_element_at("counters", F.lit("parse_errors")))), F.lit(0)).alias(
            "parse_errors_total"
        ),
    )
    alert_row = alerts.agg(
        F.count_if(F.col("status") == "sent").alias("alerts_sent"),
        F.count_if(F.col("status") == "suppressed").alias("alerts_suppressed"),
    )
    # Each side is a single row.
    return stats.join(run_state(runs)).join(counters).join(alert_row)
