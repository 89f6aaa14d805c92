"""The entry table: build, append, replace, prune and inspect.

Layout below the index path::

    log/<number>.json      commits, see ``commit_log``
    meta/<table>-<id>/     parts of the metadata tables that commits name
    data/<id>/             data files of one write, by kind of line, class and day; never changed

The metadata tables are ``files`` (the manifest), ``removed`` (data files that are no longer part of the table),
``tombstones`` (source files whose entries up to an id are gone), ``ledger`` (what has been read of each
source file) and ``runs``. A write adds parts to them and becomes visible as a whole with its commit, so
readers need no lock and see nothing of a write that broke off. Parts are merged, small ones first, when
there are more than ``MAX_PARTS`` of a table. Of two writers at a time one fails with ``ConcurrentWrite``.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager, suppress
from dataclasses import dataclass, field, replace
from datetime import date, datetime, timezone
from functools import reduce

from pyspark.sql import Column, DataFrame, Row, SparkSession, functions as F

from logloom.functions.normalize import BAD, BLANK, INGESTED, classify_lines, normalize
from logloom.functions.times import from_iso, utc_now
from logloom.operators import manifest
from logloom.operators.aggregate import aggregate_logs
from logloom.operators.commit_log import CommitLog, ConcurrentWrite
from logloom.operators.fields import field_rows
from logloom.operators.filters import DEFAULT_PAGE_LIMIT, LogQuery, all_of, clamp_limit, expired
from logloom.operators.search import PAGE_COLUMNS, LogPage, Zone, build_page, count_logs, newest_rows
from logloom.schema import (
    ENTRY_COLUMNS,
    ENTRY_SCHEMA,
    LEDGER_SCHEMA,
    PROMOTED_FIELDS,
    REMOVED_SCHEMA,
    RUN_SCHEMA,
    TOMBSTONE_SCHEMA,
)
from logloom.session import configure
from logloom.sources.appended import read_appended
from logloom.sources.byte_ranges import RANGE_BYTES
from logloom.sources.files import (
    NDJSON_GLOB,
    NEW,
    REWRITTEN,
    UNCHANGED,
    VANISHED,
    classify_changes,
    delete_listed,
    delete_path,
    list_files,
)
from logloom.sources.lines import scan_lines

Partition = tuple[bool, date | None]
FILES, REMOVED, TOMBSTONES, LEDGER, RUNS = "files", "removed", "tombstones", "ledger", "runs"
SCHEMAS = {
    FILES: manifest.FILE_SCHEMA,
    REMOVED: REMOVED_SCHEMA,
    TOMBSTONES: TOMBSTONE_SCHEMA,
    LEDGER: LEDGER_SCHEMA,
    RUNS: RUN_SCHEMA,
}
MAX_PARTS = 16  # of a metadata table; more are merged
MAX_RUNS = 64  # run records in a commit; older ones are kept in a table
ROWS_PER_FILE = 2_000_000
BROADCAST_ROWS = 100_000
ZONES_AT_ONCE = 2048  # manifest rows that a page looks at in one step
NOTHING = {"entries": 0, "fields": 0}
NO_ROWS = {INGESTED: 0, BAD: 0, BLANK: 0}
KEEP_SECONDS = 3600  # how long files of no commit may still be read, or be about to be committed


def ignore_known(rows: DataFrame, known: DataFrame, files: DataFrame) -> DataFrame:
    """Drop record rows whose (source_file, line_number) is already in ``known``.

    Rejected lines always stay, they are counted in every run. ``known`` is first cut down
    to the ``files`` of the batch, given as a table so that rows need not be made twice. Its keys are
    as many as lines and go to no driver: Spark takes what is made of a few byte ranges for a small table.
    """
    key = ["source_file", "line_number"]
    named = files.select("source_file").distinct()
    held = known.select(*key).join(named, "source_file", "left_semi").withColumn("_known", F.lit(True))
    marked = rows.join(held.hint("merge"), key, "left")
    return marked.where(F.col("_known").isNull() | (F.col("line_kind") != INGESTED)).drop("_known")


def to_rows(lines: DataFrame, now: str, id_base: int) -> DataFrame:
    """Classified and normalised lines in the column order of the row table."""
    classified = classify_lines(lines)
    rows = normalize(classified, now)
    is_record = F.col("line_kind") == INGESTED

    def only_records(name: str) -> Column:
        return F.when(is_record, F.col(name)).alias(name)

    shaped = rows.withColumns(
        {
            "id": F.lit(id_base) + F.col("line_seq"),
            "field_count": F.size("fields"),
            "indexed_at": F.lit(now),
        }
    )
    passed = ("id", "source_file", "line_number", "generation", "indexed_at")
    return shaped.select(
        "line_kind", *[F.col(name) if name in passed else only_records(name) for name in ENTRY_COLUMNS]
    )


@dataclass(frozen=True)
class Part:
    """A folder of a metadata table and how many rows it has."""

    path: str
    rows: int


@dataclass(frozen=True)
class Snapshot:
    """The table as one commit says it is."""

    number: int = 0
    version: int = 0
    last_id: int = 0
    parts: dict[str, list[Part]] = field(default_factory=dict)
    runs: list[dict] = field(default_factory=list)
    hidden: dict[str, int] = field(default_factory=lambda: dict(NOTHING))  # entries that tombstones hide

    @staticmethod
    def of(commit: dict) -> Snapshot:
        parts = {name: [Part(**p) for p in own] for name, own in commit["parts"].items()}
        return Snapshot(commit["number"], commit["version"], commit["last_id"], parts, commit["runs"], commit["hidden"])

    def commit(self) -> dict:
        parts = {name: [vars(p) for p in own] for name, own in self.parts.items()}
        return {"number": self.number, "version": self.version, "last_id": self.last_id, "parts": parts, "runs": self.runs, "hidden": self.hidden}

    def of_table(self, name: str) -> list[Part]:
        return self.parts.get(name, [])

    def rows(self, name: str) -> int:
        return sum(p.rows for p in self.of_table(name))

    def with_parts(self, name: str, parts: list[Part]) -> Snapshot:
        return replace(self, parts={**self.parts, name: parts})

    def plus(self, name: str, part: Part | None) -> Snapshot:
        return self.with_parts(name, [*self.of_table(name), part]) if part else self


class LogIndex:
    """An index of log entries stored at ``path``."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark = configure(spark)
        self.path = path.rstrip("/")
        self.log = CommitLog(spark, f"{self.path}/log")

    # ---- metadata -----------------------------------------------------------------

    def snapshot(self) -> Snapshot:
        number = self.log.newest()
        return Snapshot.of(self.log.read(number)) if number else Snapshot()

    def _read(self, schema, paths: list[str]) -> DataFrame:
        if not paths:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*(f"{self.path}/{p}" for p in paths))

    def _table(self, snapshot: Snapshot, name: str) -> DataFrame:
        return self._read(SCHEMAS[name], [p.path for p in snapshot.of_table(name)])

    def _part(self, name: str, rows: DataFrame) -> Part | None:
        """Write rows of a metadata table; None if there are none."""
        path = f"meta/{name}-{uuid.uuid4().hex}"
        columns = [F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in SCHEMAS[name].fields]
        rows.select(*columns).write.parquet(f"{self.path}/{path}")
        count = self._read(SCHEMAS[name], [path]).count()
        return Part(path, count) if count else None

    def _run_rows(self, runs: list[dict]) -> DataFrame:
        return self.spark.createDataFrame([tuple(r.get(f.name) for f in RUN_SCHEMA.fields) for r in runs], RUN_SCHEMA)

    def runs(self) -> DataFrame:
        """One row per finished or failed run."""
        snapshot = self.snapshot()
        return self._table(snapshot, RUNS).unionByName(self._run_rows(snapshot.runs))

    def version(self) -> int:
        return self.snapshot().version

    def _live(self, snapshot: Snapshot) -> DataFrame:
        """The manifest without the files that were removed."""
        files = self._table(snapshot, FILES)
        if not snapshot.of_table(REMOVED):
            return files
        gone = self._table(snapshot, REMOVED).select("path").distinct()
        return files.join(self._small(gone, snapshot.rows(REMOVED)), "path", "left_anti")

    @staticmethod
    def _small(rows: DataFrame, count: int) -> DataFrame:
        return F.broadcast(rows) if count <= BROADCAST_ROWS else rows

    def ledger(self) -> DataFrame:
        """Newest state of each file that was present in the last run."""
        return self._ledger(self.snapshot()).where("present")

    def _ledger(self, snapshot: Snapshot) -> DataFrame:
        return self._newest_states(self._table(snapshot, LEDGER))

    @staticmethod
    def _newest_states(history: DataFrame) -> DataFrame:
        columns = [f.name for f in LEDGER_SCHEMA.fields]
        newest = history.groupBy("source_file").agg(F.max_by(F.struct(*columns), "run_seq").alias("s"))
        return newest.select("s.*")

    def _merged(self, snapshot: Snapshot) -> Snapshot:
        """The same table with fewer parts, and with few run records in the commit itself."""
        if len(snapshot.runs) > MAX_RUNS:
            snapshot = replace(snapshot.plus(RUNS, self._part(RUNS, self._run_rows(snapshot.runs))), runs=[])
        if 4 * snapshot.rows(REMOVED) > max(snapshot.rows(FILES), 4 * MAX_PARTS):
            live = self._part(FILES, self._live(snapshot))
            snapshot = snapshot.with_parts(FILES, [live] if live else []).with_parts(REMOVED, [])
        for name in SCHEMAS:
            parts = sorted(snapshot.of_table(name), key=lambda p: p.rows)
            if len(parts) <= MAX_PARTS:
                continue
            few, rest = parts[: MAX_PARTS // 2 + 1], parts[MAX_PARTS // 2 + 1 :]  # large parts are seldom written again
            rows = self._read(SCHEMAS[name], [p.path for p in few])
            rows = self._newest_states(rows) if name == LEDGER else rows.distinct() if name == REMOVED else rows
            merged = self._part(name, rows)
            snapshot = snapshot.with_parts(name, [*rest, *([merged] if merged else [])])
        return snapshot

    def _commit(self, snapshot: Snapshot, run: dict) -> None:
        """Publish ``snapshot``, which was made from the commit before it, with the record of its run."""
        number = snapshot.number + 1
        record = {**run, "run_seq": number, "last_id": snapshot.last_id}
        merged = self._merged(replace(snapshot, number=number, runs=[*snapshot.runs, record]))
        self.log.create(number, merged.commit())

    @staticmethod
    def _record(kind: str, mode: str, started: str, counters: dict | None = None, error: str | None = None) -> dict:
        finished = utc_now()
        took = from_iso(finished) - from_iso(started)
        return {
            "kind": kind,
            "mode": mode,
            "status": "finished" if error is None else "failed",
            "started_at": started,
            "finished_at": finished,
            "duration_ms": max(0, round(took.total_seconds() * 1000)),
            "counters": counters or {},
            "error": error,
        }

    def log_run(self, kind: str, mode: str, started: str, counters: dict | None = None, error: str | None = None) -> None:
        """Record a run that changed nothing in the table; tried again if another commit comes first."""
        for attempt in range(20):
            try:
                return self._commit(self.snapshot(), self._record(kind, mode, started, counters, error))
            except ConcurrentWrite:
                if attempt == 19:
                    raise

    def log_report(self, kind: str, mode: str, started: str, report: dict) -> None:
        """Record the whole-number counters of a finished run."""
        self.log_run(kind, mode, started, self._counters(report))

    @contextmanager
    def _journal(self, kind: str, mode: str) -> Iterator[str]:
        """Gives the start time of a run, and records the run if it fails."""
        started = utc_now()
        try:
            yield started
        except Exception as error:
            with suppress(Exception):  # what went wrong first is what is raised
                self.log_run(kind, mode, started, error=f"{type(error).__name__}: {error}".split("\n")[0])
            raise

    # ---- reading ------------------------------------------------------------------

    def entries(self, query: LogQuery | None = None) -> DataFrame:
        """All entries. With a query, only the data files it can match are read; the query itself is not applied."""
        return self._entries(self.snapshot(), query)

    def _entries(self, snapshot: Snapshot, query: LogQuery | None = None) -> DataFrame:
        return self._entries_of(snapshot, self._paths(snapshot, manifest.reachable(query or LogQuery())))

    def _paths(self, snapshot: Snapshot, conditions: list[Column]) -> list[str]:
        chosen = self._live(snapshot).where(all_of(conditions)).select("path").collect()  # as Spark lists any table
        return [row["path"] for row in chosen]

    def _entries_of(self, snapshot: Snapshot, paths: list[str]) -> DataFrame:
        """The entries of data files, without those that tombstones hide."""
        rows = self._read(ENTRY_SCHEMA, paths)
        if not paths or not snapshot.of_table(TOMBSTONES):
            return rows
        return rows.join(self._hiding(snapshot), self._is_hidden(), "left_anti")

    def _hiding(self, snapshot: Snapshot) -> DataFrame:
        stones = self._table(snapshot, TOMBSTONES)
        newest = stones.groupBy(F.col("source_file").alias("_gone")).agg(F.max("max_id").alias("_max_id"))
        return self._small(newest, snapshot.rows(TOMBSTONES))

    @staticmethod
    def _is_hidden() -> Column:
        return (F.col("source_file") == F.col("_gone")) & (F.col("id") <= F.col("_max_id"))

    def fields(self) -> DataFrame:
        return field_rows(self.entries())

    def partitions(self) -> list[Partition]:
        """Classes and days that have entries."""
        found = self._live(self.snapshot()).where(F.col("line_kind") == INGESTED).select("is_audit", "event_date").distinct()
        return sorted(((r["is_audit"], r["event_date"]) for r in found.collect()), key=lambda p: (p[0], p[1] or date.min))

    # ---- search -------------------------------------------------------------------

    def zones(self, query: LogQuery) -> Iterator[list[Zone]]:
        """The data files that a query can match, those with the newest entries first, in bounded lists."""
        return self._zones(self.snapshot(), query)

    def _zones(self, snapshot: Snapshot, query: LogQuery) -> Iterator[list[Zone]]:
        files = self._live(snapshot).where(all_of(manifest.reachable(query))).select("path", "max_time", "rows")
        last: Zone | None = None
        while True:
            after = files
            if last is not None:
                newest = F.col("max_time")
                after = files.where((newest < last.max_time) | ((newest == last.max_time) & (F.col("path") > last.path)))
            found = after.orderBy(F.col("max_time").desc(), "path").limit(ZONES_AT_ONCE).collect()
            if found:
                yield [Zone(r["path"], r["max_time"], r["rows"]) for r in found]
                last = Zone(found[-1]["path"], found[-1]["max_time"], found[-1]["rows"])
            if len(found) < ZONES_AT_ONCE:
                return

    def _page_rows(self, query: LogQuery, count: int) -> list[Row]:
        snapshot = self.snapshot()
        cores = self.spark.sparkContext.defaultParallelism
        return newest_rows(self._zones(snapshot, query), lambda paths: self._entries_of(snapshot, paths), query, count, cores)

    def page(self, query: LogQuery) -> LogPage:
        limit = clamp_limit(query.limit, DEFAULT_PAGE_LIMIT)
        return build_page(self._page_rows(query, limit + 1), limit)

    def page_frame(self, query: LogQuery) -> DataFrame:
        """The page (at most 1000 rows) as a DataFrame."""
        rows = self._page_rows(query, clamp_limit(query.limit, DEFAULT_PAGE_LIMIT))
        schema = [ENTRY_SCHEMA[name] for name in PAGE_COLUMNS]
        frame = self.spark.createDataFrame([tuple(r) for r in rows], type(ENTRY_SCHEMA)(schema))
        return frame.orderBy(F.col("timestamp").desc(), F.col("id").desc())

    def count(self, query: LogQuery) -> int:
        return count_logs(self.entries(query), query).head()[0]

    def aggregate(self, query: LogQuery, group_by: str, group_field: str | None = None) -> DataFrame:
        return aggregate_logs(self.entries(query), query, group_by, group_field)

    def stats(self) -> DataFrame:
        """One row: entry_count, field_count, approximate_size_bytes, from the manifest alone."""
        snapshot = self.snapshot()
        hidden = snapshot.hidden
        total = {"entry_count": ("rows", hidden["entries"]), "field_count": ("fields", hidden["fields"]), "approximate_size_bytes": ("bytes", 0)}
        entries = self._live(snapshot).where(F.col("line_kind") == INGESTED)
        return entries.agg(*[(F.coalesce(F.sum(c), F.lit(0)) - less).alias(name) for name, (c, less) in total.items()])

    # ---- writing ------------------------------------------------------------------

    def _write_rows(self, rows: DataFrame) -> tuple[Part | None, dict[str, int]]:
        """Write data files; returns their part of the manifest, and how many rows there are of each kind of line."""
        folder, part = f"data/{uuid.uuid4().hex}", f"meta/{FILES}-{uuid.uuid4().hex}"
        keys = ["line_kind", "audit", "day"]
        bloom = {f"parquet.bloom.filter.enabled#{column}": "true" for column in PROMOTED_FIELDS.values()}
        # Rebalancing keeps files of a day together, merges small days and splits big ones.
        (
            rows.withColumns({"audit": F.col("is_audit"), "day": F.col("event_date")})
            .hint("rebalance", *keys)
            .sortWithinPartitions(*keys, "timestamp")
            .write.options(**bloom)
            .option("maxRecordsPerFile", ROWS_PER_FILE)
            .partitionBy(*keys)
            .parquet(f"{self.path}/{folder}")
        )
        manifest.described(self.spark, self.path, folder).write.parquet(f"{self.path}/{part}")
        sums = [F.coalesce(F.sum(F.when(F.col("line_kind") == kind, F.col("rows"))), F.lit(0)).alias(kind) for kind in NO_ROWS]
        found = self._read(manifest.FILE_SCHEMA, [part]).agg(F.count("*").alias("_files"), *sums).head().asDict()
        files = found.pop("_files")
        return (Part(part, files) if files else None), found

    @staticmethod
    def _report(mode: str, started: str, files: int, lines: int, new: dict[str, int]) -> dict:
        return {
            "mode": mode,
            "started_at": started,
            "finished_at": utc_now(),
            "files_scanned": files,
            "lines_scanned": lines,
            "records_inserted": new[INGESTED],
            "records_skipped": lines - new[INGESTED] - new[BAD] - new[BLANK],
            "parse_errors": new[BAD],
        }

    @staticmethod
    def _counters(report: dict) -> dict[str, int]:
        return {key: value for key, value in report.items() if isinstance(value, int)}

    def _work(self) -> str:
        return f"{self.path}/work/{uuid.uuid4().hex}"

    def index_directory(self, root: str, now: str | None = None, glob: str = NDJSON_GLOB) -> dict:
        """Scan every file below ``root`` and add the lines not yet indexed."""
        with self._journal("index", "full") as started:
            return self._full_run(root, now or utc_now(), glob, self.snapshot(), started, "index")

    def _full_run(self, root: str, now: str, glob: str, known: Snapshot, started: str, kind: str) -> dict:
        """Add what is new to ``known``, the table as it was read (or, for a reindex, emptied)."""
        work = self._work()
        lines = scan_lines(self.spark, root, glob, f"{work}/splits", self._ledger(known))
        splits = self.spark.read.parquet(f"{work}/splits")
        files, total = splits.agg(F.count("*"), F.coalesce(F.sum("split_lines"), F.lit(0))).head()
        part, new = None, dict(NO_ROWS)
        if total:
            rows = to_rows(lines, now, known.last_id)
            if known.of_table(FILES):
                rows = ignore_known(rows, self._entries(known), splits)
            part, new = self._write_rows(rows)
        report = self._report("full", started, files, total, new)
        after = replace(known.plus(FILES, part), last_id=known.last_id + total)
        if files:
            after = after.plus(LEDGER, self._part(LEDGER, self._scanned_state(splits, known)))
        self._commit(after, self._record(kind, "full", started, self._counters(report)))
        delete_path(self.spark, work)
        return report

    def _scanned_state(self, splits: DataFrame, known: Snapshot) -> DataFrame:
        old = self._ledger(known).select("source_file", "generation")
        return splits.join(old, "source_file", "left").select(
            "source_file",
            "byte_offset",
            "file_size",
            F.col("file_modified_at").alias("modified_at"),
            F.col("split_lines").alias("lines"),
            F.coalesce("generation", F.lit(0)).alias("generation"),
            F.lit(True).alias("present"),
            F.lit(known.number + 1).alias("run_seq"),
        )

    def index_incremental(
        self,
        root: str,
        now: str | None = None,
        glob: str = NDJSON_GLOB,
        include_unterminated: bool = False,
        range_bytes: int = RANGE_BYTES,
        folders: DataFrame | None = None,
        quiet: bool = False,
    ) -> dict:
        """Read only what was appended since the last run; replace files rewritten in place.

        A last line without a newline waits for the next run unless ``include_unterminated``.
        Files are read in pieces of ``range_bytes``. ``folders`` (column ``path``) limits the run to folders
        below ``root``; files elsewhere are then not looked for. A ``quiet`` run leaves no record if nothing changed.
        """
        with self._journal("index", "incremental") as started:
            known, work = self.snapshot(), self._work()
            changes = self._changes(known, list_files(self.spark, root, glob, folders), folders is None)
            changes.write.parquet(f"{work}/changes")
            changes = self.spark.read.parquet(f"{work}/changes")
            status = F.col("status")
            seen = changes.agg(
                F.count_if(status != VANISHED).alias("files"),
                F.count_if(status == REWRITTEN).alias("rewritten"),
                F.count_if(~status.isin(UNCHANGED, VANISHED)).alias("changed"),
                F.count_if((status == NEW) & F.col("_was_present").isNotNull()).alias("returned"),
                F.count_if(status == VANISHED).alias("vanished"),
            ).head()
            after, total, part, new = known, 0, None, dict(NO_ROWS)
            if seen["rewritten"]:
                after, _ = self._hidden(after, changes.where(status == REWRITTEN).select("source_file"))
            states = changes.where(status == VANISHED).select(
                "source_file",
                F.col("old_offset").alias("byte_offset"),
                F.col("old_offset").alias("file_size"),
                F.col("old_modified_at").alias("modified_at"),
                F.col("old_lines").alias("lines"),
                F.col("old_generation").alias("generation"),
                F.lit(False).alias("present"),
            )
            if seen["changed"]:
                todo = self._todo(changes)
                lines, state = read_appended(todo, seen["changed"], root, work, include_unterminated, range_bytes)
                total = state.agg(F.coalesce(F.sum("new_lines"), F.lit(0))).head()[0]
                if total:
                    rows = to_rows(lines, now or started, known.last_id)
                    if seen["returned"]:
                        rows = ignore_known(rows, self._entries(after), todo)
                    part, new = self._write_rows(rows)
                states = states.unionByName(
                    todo.join(state, "source_file").select(
                        "source_file",
                        "byte_offset",
                        F.col("length").alias("file_size"),
                        "modified_at",
                        "lines",
                        "generation",
                        F.lit(True).alias("present"),
                    )
                )
            report = self._report("incremental", started, seen["files"], total, new)
            if seen["changed"] or seen["vanished"]:
                after = after.plus(LEDGER, self._part(LEDGER, states.withColumn("run_seq", F.lit(known.number + 1))))
            if after is not known or not quiet:
                after = replace(after.plus(FILES, part), last_id=known.last_id + total)
                self._commit(after, self._record("index", "incremental", started, self._counters(report)))
            delete_path(self.spark, work)
            return report

    def _changes(self, known: Snapshot, listing: DataFrame, whole: bool) -> DataFrame:
        history = self._ledger(known)
        if not whole:
            history = history.join(listing.select("source_file"), "source_file", "left_semi")
        old = history.select("source_file", F.col("present").alias("_was_present"), F.col("generation").alias("_last_generation"))
        return classify_changes(listing, history.where("present")).join(old, "source_file", "left")

    @staticmethod
    def _todo(changes: DataFrame) -> DataFrame:
        """The files to read, from where and with which generation."""
        rewritten = F.col("status") == REWRITTEN
        fresh = rewritten | (F.col("status") == NEW)
        last = F.coalesce("_last_generation", F.lit(0))
        return changes.where(~F.col("status").isin(UNCHANGED, VANISHED)).select(
            "source_file",
            "path",
            "length",
            "modified_at",
            F.when(fresh, F.lit(0)).otherwise(F.col("old_offset")).cast("bigint").alias("first"),
            F.when(fresh, F.lit(0)).otherwise(F.col("old_lines")).cast("bigint").alias("lines_before"),
            F.when(rewritten, last + 1).otherwise(last).cast("int").alias("generation"),
        )

    def reindex(self, root: str, now: str | None = None, glob: str = NDJSON_GLOB) -> dict:
        """Build the index anew from the files and publish it in place of the old one, with one commit."""
        with self._journal("reindex", "full") as started:
            known = self.snapshot()
            totals = self.stats().head()
            kept = {RUNS: known.of_table(RUNS)}
            empty = replace(known, version=known.version + 1, parts=kept, hidden=dict(NOTHING))
            report = self._full_run(root, now or utc_now(), glob, empty, started, "reindex")
            return {"report": report, "reset": {"entries_deleted": totals["entry_count"], "fields_deleted": totals["field_count"]}}

    # ---- deleting -----------------------------------------------------------------

    @staticmethod
    def _totals(entries: DataFrame) -> dict[str, int]:
        row = entries.agg(F.count("*"), F.coalesce(F.sum("field_count"), F.lit(0))).head()
        return {"entries_deleted": row[0], "fields_deleted": row[1]}

    def delete_source_files(self, files: DataFrame) -> dict[str, int]:
        """Delete the entries of the files named in column ``source_file``; nothing is rewritten."""
        with self._journal("delete", "sources") as started:
            after, report = self._hidden(self.snapshot(), files)
            self._commit(after, self._record("delete", "sources", started, report))
            return report

    def _hidden(self, known: Snapshot, files: DataFrame) -> tuple[Snapshot, dict[str, int]]:
        """The table with tombstones for source files, and what they hide.

        Only data files that may hold their entries are read. New entries have greater ids, so the
        tombstone of a file does not hide what is read from it later.
        """
        part = self._part(TOMBSTONES, files.select("source_file").distinct().withColumn("max_id", F.lit(known.last_id)))
        if part is None:
            return known, {"entries_deleted": 0, "fields_deleted": 0}
        stones = self._read(TOMBSTONE_SCHEMA, [part.path]).select("source_file")
        conditions = manifest.reachable(LogQuery())
        if part.rows <= manifest.MAX_NAMED:
            conditions.append(manifest.may_hold([(manifest.SOURCE, r["source_file"]) for r in stones.collect()]))
        held = self._entries_of(known, self._paths(known, conditions))
        report = self._totals(held.join(self._small(stones, part.rows), "source_file", "left_semi"))
        hidden = {"entries": known.hidden["entries"] + report["entries_deleted"], "fields": known.hidden["fields"] + report["fields_deleted"]}
        return replace(known.plus(TOMBSTONES, part), hidden=hidden), report

    def _rewritten(self, known: Snapshot, gone: list[Row], keep: Callable[[DataFrame], DataFrame] | None) -> Snapshot:
        """The table with data files replaced by what ``keep`` leaves of their entries, None for nothing."""
        if not gone:
            return known
        paths = [r["path"] for r in gone]
        live = self._entries_of(known, paths)
        after = known
        if keep is not None:
            kept = keep(live).withColumn("line_kind", F.lit(INGESTED)).select("line_kind", *ENTRY_COLUMNS)
            after = after.plus(FILES, self._write_rows(kept)[0])
        if known.of_table(TOMBSTONES):  # what tombstones hide in these files is gone for good
            left = self._totals(live)
            entries = known.hidden["entries"] - sum(r["rows"] for r in gone) + left["entries_deleted"]
            fields = known.hidden["fields"] - sum(r["fields"] for r in gone) + left["fields_deleted"]
            after = replace(after, hidden={"entries": entries, "fields": fields})
        removed = self.spark.createDataFrame([(p,) for p in paths], REMOVED_SCHEMA)
        return after.plus(REMOVED, self._part(REMOVED, removed))

    def prune(self, normal_cutoff: str, audit_cutoff: str) -> dict:
        """Delete entries older than the cutoff of their class (text comparison, strict).

        Data files that lie wholly before the cutoff are taken off the table. Only those whose range the
        cutoff falls in are rewritten.
        """
        with self._journal("prune", "retention") as started:
            known = self.snapshot()
            cutoff = F.when(F.col("is_audit"), F.lit(audit_cutoff)).otherwise(F.lit(normal_cutoff))
            whole = (F.col("max_time") < cutoff).alias("whole")
            touched = (
                self._live(known)
                .where((F.col("line_kind") == INGESTED) & (F.col("min_time") < cutoff))
                .select("path", "rows", "fields", "is_audit", whole)
                .collect()  # the names of files that go
            )
            gone = expired(normal_cutoff, audit_cutoff)
            partly = [r for r in touched if not r["whole"]]
            dropped = [r for r in touched if r["whole"]]
            counted = [r["path"] for r in (touched if known.of_table(TOMBSTONES) else partly)]
            row = (
                self._entries_of(known, counted)
                .where(gone)
                .agg(
                    F.count_if(~F.col("is_audit")).alias("normal"),
                    F.count_if("is_audit").alias("audit"),
                    F.coalesce(F.sum("field_count"), F.lit(0)).alias("fields"),
                )
                .head()
            )
            known_sizes = [] if known.of_table(TOMBSTONES) else dropped  # the manifest says how many they hold
            normal = row["normal"] + sum(r["rows"] for r in known_sizes if not r["is_audit"])
            audit = row["audit"] + sum(r["rows"] for r in known_sizes if r["is_audit"])
            after = self._rewritten(self._rewritten(known, dropped, None), partly, lambda rows: rows.where(~gone))
            report = {
                "normal_cutoff": normal_cutoff,
                "audit_cutoff": audit_cutoff,
                "normal_entries_deleted": normal,
                "audit_entries_deleted": audit,
                "entries_deleted": normal + audit,
                "fields_deleted": row["fields"] + sum(r["fields"] for r in known_sizes),
            }
            self._commit(after, self._record("prune", "retention", started, self._counters(report)))
            return report

    def compact(self, max_files: int = 4) -> list[Partition]:
        """Rewrite the days that have more than ``max_files`` small files, and the files with hidden entries."""
        with self._journal("compact", "partitions") as started:
            known = self.snapshot()
            live = self._live(known).where(F.col("line_kind") == INGESTED)
            day = ["is_audit", "event_date"]
            crowded = live.groupBy(*day).agg(F.count("*").alias("n"), F.avg("bytes").alias("mean"))
            crowded = crowded.where((F.col("n") > max_files) & (F.col("mean") < 64 * 1024 * 1024)).select(*day)
            same = [F.col(f"f.{c}").eqNullSafe(F.col(f"c.{c}")) for c in day]
            chosen = live.alias("f").join(crowded.alias("c"), all_of(same)).select("f.*")
            if known.of_table(TOMBSTONES):
                every = self._read(ENTRY_SCHEMA, [r["path"] for r in live.select("path").collect()])
                name = F.concat(F.lit("data/"), F.substring_index(F.col("_metadata.file_path"), "/data/", -1))
                held = every.select(name.alias("path"), "source_file", "id").join(self._hiding(known), self._is_hidden(), "left_semi")
                chosen = chosen.unionByName(live.join(held.select("path").distinct(), "path", "left_semi")).dropDuplicates(["path"])
            gone = chosen.select("path", "rows", "fields", *day).collect()  # the names of files that go
            after = self._rewritten(known, gone, lambda rows: rows)
            if known.of_table(TOMBSTONES):
                after = replace(after.with_parts(TOMBSTONES, []), hidden=dict(NOTHING))
            partitions = sorted({(r["is_audit"], r["event_date"]) for r in gone}, key=lambda p: (p[0], p[1] or date.min))
            self._commit(after, self._record("compact", "partitions", started, {"partitions": len(partitions)}))
            return partitions

    def vacuum(self, keep_seconds: float = KEEP_SECONDS) -> int:
        """Delete files below the index that the newest commit does not name and that are older than ``keep_seconds``."""
        known = self.snapshot()
        before = datetime.fromtimestamp(datetime.now(timezone.utc).timestamp() - keep_seconds, timezone.utc)
        found = reduce(DataFrame.unionByName, [
            list_files(self.spark, f"{self.path}/{folder}", "*").withColumn("_in", F.lit(folder)) for folder in ("data", "meta", "work")
        ])
        # A checksum file goes with the file that it is of.
        name = F.regexp_replace(F.concat_ws("/", "_in", "source_file"), r"/\.([^/]+)\.crc$", "/$1")
        old = found.where(F.col("modified_at") < F.lit(before)).withColumn("name", name)
        used = self._live(known).select(F.col("path").alias("name"))
        parts = [p.path for own in known.parts.values() for p in own]
        named = F.substring_index("name", "/", 2).isin(parts) if parts else F.lit(False)
        return delete_listed(old.where(~named).join(used, "name", "left_anti").select("path"), self.path)
