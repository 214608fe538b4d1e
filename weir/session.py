"""Session settings and the shared working folder."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Sequence
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def build_session(app_name: str = "weir", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators are tuned for.

    On a cluster leave ``master`` empty; sizes and the checkpoint folder come from
    the submit configuration.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        # Checkpoint files go when the frame they belong to is no longer used.
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def work_dir(spark: SparkSession) -> str:
    """The folder every executor can reach: ``spark.checkpoint.dir`` of the session.

    Only a local session without that setting gets a temporary folder of its own.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get(
        "spark.checkpoint.dir"
    )
    if not folder:
        folder = context.getCheckpointDir()
    if not folder:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by the cluster")
        folder = tempfile.mkdtemp(prefix="weir-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return folder


def work_path(spark: SparkSession, name: str) -> str:
    """A fresh path below :func:`work_dir`."""
    return f"{work_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str = "step") -> DataFrame:
    """The frame, written below the work folder and read back.

    Unlike a checkpoint it is computed once, and its size is known to the plans that read it.
    """
    path = work_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


# Bytes of input files for each task of a shuffle whose rows are sorted or held.
BYTES_PER_TASK = 4 << 20


def tasks_by_input(df: DataFrame) -> int | None:
    """How many shuffle tasks the files behind a frame ask for; None: no more than the session's.

    A fixed number of tasks would hold ever more rows each when the input grows. Shuffles that
    adaptive execution lays out start with the larger number too; small ones are joined by it.
    """
    # Names come encoded as in a URL, and are read as patterns.
    spark = df.sparkSession
    files = [re.sub(r"([\[\]{}*?\\])", r"\\\1", unquote(name)) for name in df.inputFiles()]
    usual = int(spark.conf.get("spark.sql.shuffle.partitions"))
    if not files:
        return None
    sizes = spark.read.format("binaryFile").load(files).agg(F.sum("length"))
    tasks = (sizes.first()[0] or 0) // BYTES_PER_TASK
    if tasks <= usual:
        return None
    first = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
    if int(spark.conf.get(first, None) or usual) < tasks:
        spark.conf.set(first, tasks)
    return tasks


def dealt(df: DataFrame, tasks: int | None, keys: Sequence[str]) -> DataFrame:
    """The rows dealt by their keys over that many tasks; as they are without a number or keys."""
    return df.repartition(tasks, *keys) if tasks and keys else df


# Plan nodes and calls whose second run may differ from the first, if only in the last
# digit of a sum whose parts arrived in another order.
_UNSTEADY = re.compile(
    r"^[\s:+\-!']*(Aggregate|Window|Deduplicate|Sample|GlobalLimit|LocalLimit"
    r"|\w+InPandas|\w+InArrow)\b"
    r"|\b(rand|randn|uuid|monotonically_increasing_id)\(",
    re.MULTILINE,
)


def read_twice(df: DataFrame) -> DataFrame:
    """A frame that gives the same values each time it is read.

    Scans, filters, projections and joins do, and are returned as they are; a frame with
    sums, windows or limits in its plan is written to the work folder and read back.
    """
    if not _UNSTEADY.search(df._jdf.queryExecution().analyzed().toString()):
        return df
    return written(df)
