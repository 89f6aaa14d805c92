"""Session settings and the shared working folder."""

from __future__ import annotations

import sys
import tempfile
import uuid

from pyspark import cloudpickle
from pyspark.sql import SparkSession

_LOCAL_DIRS: dict[str, str] = {}


def configure(spark: SparkSession) -> SparkSession:
    """Set the one runtime option results depend on: in a JSON object the last duplicate key wins.

    The few functions that run in Python workers travel with the job, so executors need no
    copy of this package.
    """
    spark.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    cloudpickle.register_pickle_by_value(sys.modules[__package__])
    return spark


def local_session(cores: str = "*", app_name: str = "logloom", shuffle_partitions: int = 8) -> SparkSession:
    """A single-machine session for tests and benchmarks."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app_name)
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        # Rebalanced writes and packed small files aim at these sizes; the defaults suit clusters.
        .config("spark.sql.files.openCostInBytes", "64k")
        .config("spark.sql.adaptive.advisoryPartitionSizeInBytes", "8m")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return configure(spark)


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, named by ``spark.checkpoint.dir``.

    Only a local-mode session without that setting gets a temporary folder.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get(
        "spark.checkpoint.dir"
    )
    if configured:
        return configured.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder shared by the whole cluster")
    if context.applicationId not in _LOCAL_DIRS:
        _LOCAL_DIRS[context.applicationId] = tempfile.mkdtemp(prefix="logloom-")
    return _LOCAL_DIRS[context.applicationId]


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder for one intermediate table."""
    return f"{shared_dir(spark)}/logloom/{label}-{uuid.uuid4().hex}"
