"""Line scan with line numbers that continue across the parts of a file."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from logloom.session import scratch_path
from logloom.sources.appended import read_appended
from logloom.sources.files import NDJSON_GLOB, list_files


def scan_lines(
    spark: SparkSession,
    root: str,
    glob: str = NDJSON_GLOB,
    work_dir: str | None = None,
    generations: DataFrame | None = None,
) -> DataFrame:
    """Every line below ``root`` as source_file, path, generation, line_number, line_seq, line.

    ``line_number`` starts at 1 in each file and counts blank lines. ``line_seq`` numbers all
    lines in file-name order. Files are listed once and cut into byte ranges once: one pass counts the
    lines of each range, the next one reads it from its known number on, so numbers depend on nothing
    that may differ between two reads, and no text is shuffled. Of a file that grows meanwhile the whole
    lines of its listed length are taken. ``work_dir`` then holds a table of the files: source_file,
    byte_offset (up to where lines were taken), file_size, file_modified_at, split_lines.
    ``generations`` (source_file, generation) names the version of files known already.
    """
    target = work_dir or scratch_path(spark, "splits")
    listing = list_files(spark, root, glob)
    whole = listing.select(
        "source_file",
        "path",
        F.lit(0).alias("generation"),
        F.lit(0).cast("bigint").alias("lines_before"),
        F.lit(0).cast("bigint").alias("first"),
        "length",
    )
    if generations is not None:
        own = generations.select("source_file", F.col("generation").alias("_own"))
        whole = whole.join(own, "source_file", "left").withColumn("generation", F.coalesce("_own", "generation")).drop("_own")
    lines, state = read_appended(whole, listing.count(), root, f"{target}-read", include_unterminated=True)
    files = listing.select("source_file", F.col("length").alias("file_size"), F.col("modified_at").alias("file_modified_at"))
    state = state.select("source_file", "byte_offset", F.col("new_lines").alias("split_lines"))
    files.join(state, "source_file").write.mode("overwrite").parquet(target)
    return lines
