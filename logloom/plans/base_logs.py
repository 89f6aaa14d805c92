"""The driver tables as log files, an index over them, and ingest requests."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from logloom.functions.times import iso_millis
from logloom.operators.index import LogIndex
from logloom.session import configure, scratch_path
from logloom.sources.lines import scan_lines

NOW = "2024-02-01T00:00:00.000Z"
GLOB = "*.txt"
CHUNK_ROWS = 250_000  # most events in one file
REQUEST_ROWS = 500  # most records in one request
MAX_BYTES = 4096  # largest payload that is accepted

# Lines that are no JSON value, mixed into the files.
BROKEN_LINES = ["not-json", '{"a":1} xyz', "1] xyz", "1} xyz", "{'a':1}", '{"a":NaN}', "null"]


def level_of(event_type: Column) -> Column:
    return (
        F.when(event_type == "error", "ERROR")
        .when(event_type == "purchase", "warn")
        .when(event_type == "view", "DEBUG")
        .otherwise("INFO")
    )


def event_lines(events: DataFrame) -> DataFrame:
    """Log lines of the events in file order: stream, day, chunk, event_id, position, line."""
    event_id, kind = F.col("event_id"), F.col("event_type")
    stamp = iso_millis(F.col("ts"))
    k = F.get_json_object("props", "$.k")
    record = F.struct(
        (event_id + 1).alias("id"),
        stamp.alias("timestamp"),
        level_of(kind).alias("level"),
        F.concat(F.lit("user."), kind).alias("event"),
        kind.alias("message"),
        F.when(event_id % 2 == 0, kind == "signup").alias("audit"),
        F.col("user_id").cast("string").alias("userId"),
        k.alias("k"),
        F.col("value").alias("value"),
        F.when(event_id % 3 == 0, F.concat(F.lit("CORR-"), F.col("user_id"))).alias("correlationId"),
        F.when(event_id % 5 != 0, F.concat(F.lit("REQ-"), F.floor(event_id / 4))).alias("requestId"),
        F.struct(k.cast("int").alias("k"), F.array(kind).alias("tags")).alias("context"),
    )
    broken = F.array(*[F.lit(text) for text in BROKEN_LINES])[(F.floor(event_id / 97) % len(BROKEN_LINES)).cast("int")]
    lines = F.array_compact(
        F.array(F.to_json(record), F.when(event_id % 97 == 0, broken), F.when(event_id % 89 == 0, F.lit("  ")))
    )
    return events.select(
        F.when(kind == "signup", "audit").otherwise("app").alias("stream"),
        F.substring(stamp, 1, 10).alias("day"),
        F.floor(event_id / CHUNK_ROWS).alias("chunk"),
        "event_id",
        F.posexplode(lines).alias("position", "line"),
    )


def write_lines(lines: DataFrame, root: str) -> None:
    """One file per stream, day and chunk below ``root``/<stream>/day=../chunk=.."""
    for stream in ("app", "audit"):
        (
            lines.where(F.col("stream") == stream)
            .repartition("day", "chunk")
            .sortWithinPartitions("day", "chunk", "event_id", "position")
            .select("line", "day", "chunk")
            .write.mode("overwrite")
            .partitionBy("day", "chunk")
            .text(f"{root}/{stream}")
        )


def folder_of(source_file: str = "source_file") -> Column:
    return F.regexp_replace(source_file, "/[^/]*$", "")


def log_id() -> Column:
    """The record's own id; index ids depend on file names."""
    return F.try_element_at("fields", F.lit("id")).cast("bigint")


class Workspace:
    """Files and index of one data folder, made on first use in a session."""

    _made: dict[tuple[str, str], Workspace] = {}

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = configure(spark)
        self.sf_dir = sf_dir.rstrip("/")
        self.path = scratch_path(spark, "workspace")

    @classmethod
    def of(cls, spark: SparkSession, sf_dir: str) -> Workspace:
        key = (spark.sparkContext.applicationId, sf_dir)
        if key not in cls._made:
            cls._made[key] = cls(spark, sf_dir)
        made = cls._made[key]
        made.spark = configure(spark)
        return made

    def table(self, name: str) -> DataFrame:
        """A driver table. One of fewer files than cores is dealt out before costly parsing."""
        found = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        cores = self.spark.sparkContext.defaultParallelism
        return found if len(found._jdf.inputFiles()) >= cores else found.repartition(cores)

    @cached_property
    def logs(self) -> str:
        root = f"{self.path}/logs"
        write_lines(event_lines(self.table("events")), root)
        return root

    def lines(self) -> DataFrame:
        return scan_lines(self.spark, self.logs, GLOB)

    @cached_property
    def index(self) -> LogIndex:
        index = LogIndex(self.spark, f"{self.path}/index")
        index.index_directory(self.logs, NOW, GLOB)
        return index

    def new_index(self, name: str) -> LogIndex:
        return LogIndex(self.spark, scratch_path(self.spark, name))

    def requests(self) -> DataFrame:
        """Events as ingest requests of at most REQUEST_ROWS records each."""
        event_id, user = F.col("event_id"), F.col("user_id")
        record = F.when(event_id % 13 == 0, F.lit('"just text"')).otherwise(
            F.concat(
                F.lit('{"id":'),
                event_id,
                F.lit(',"event":"'),
                F.col("event_type"),
                F.lit('","producerId":"spoof"}'),
            )
        )
        part = F.floor(event_id / REQUEST_ROWS)
        grouped = (
            self.table("events")
            .groupBy("user_id", part.alias("part"))
            .agg(
                F.sort_array(F.collect_list(F.struct("event_id", record.alias("record")))).alias("records"),
                F.max("ts").alias("last"),
            )
            .withColumn("body", F.concat(F.lit("["), F.array_join("records.record", ","), F.lit("]")))
        )
        kind = (user + F.col("part")) % 10
        payload = (
            F.when(kind == 1, F.concat(F.lit('{"logs":'), F.col("body"), F.lit("}")))
            .when(kind == 2, F.concat(F.lit('{"logs":'), F.col("body")))
            .when(kind == 3, F.concat(F.lit('{"items":'), F.col("body"), F.lit("}")))
            .when(kind == 4, F.lit("  "))
            .when(kind == 5, F.concat(F.col("body"), F.lit(" " * MAX_BYTES)))  # too large at every scale
            .otherwise(F.col("body"))
        )
        return grouped.select(
            F.concat_ws("-", user, "part").alias("request_id"),
            F.when(user % 7 != 0, F.concat(F.lit("token-"), user % 4)).alias("token"),
            F.when(user % 11 == 0, F.concat(F.lit("basic-"), user)).alias("basic_user"),
            payload.alias("payload"),
            F.to_timestamp(F.concat(F.col("last").cast("string"), F.lit("+00:00"))).alias("received_at"),
        )

    def producers(self) -> DataFrame:
        """token → producer; token-3 is not mapped."""
        users = self.table("events").select((F.col("user_id") % 3).alias("n")).distinct()
        return users.select(
            F.concat(F.lit("token-"), "n").alias("token"), F.concat(F.lit("producer-"), "n").alias("producer_id")
        )
