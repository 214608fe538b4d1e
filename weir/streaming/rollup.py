"""Daily rollup over arriving flow files.

The rollup adds up, so the running totals are the only state: one row per day and group.
There is no watermark: it would drop late corrections, which belong to their gas day however
late they come. The state therefore grows with the days and groups seen. A target belongs to
one checkpoint; with a new checkpoint use a new target, since versions start again at 0.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weir.operators.metrics import ROLLUP_KEYS, daily_rollup
from weir.session import work_path
from weir.sources.flows import normalize_flows


def stream_flows(
    spark: SparkSession, folder: str, schema: T.StructType, pattern: str | None = None
) -> DataFrame:
    """Stream of the parquet files that land in a folder."""
    reader = spark.readStream.schema(schema)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    return normalize_flows(reader.parquet(folder))


def start_rollup(
    flows: DataFrame,
    target: str,
    checkpoint: str,
    keys: Sequence[str] = ROLLUP_KEYS,
    available_now: bool = True,
):
    """Keep the newest totals per key under ``target``, one folder per micro-batch.

    Each batch writes only the groups it changed; :func:`read_rollup` takes the newest
    version of every group. A repeated batch overwrites its own folder.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target}/version={number}")

    writer = (
        daily_rollup(flows, keys)
        .writeStream.outputMode("update")
        .option("checkpointLocation", checkpoint)
        .foreachBatch(write)
    )
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def read_rollup(
    spark: SparkSession, target: str, keys: Sequence[str] = ROLLUP_KEYS
) -> DataFrame:
    """Newest totals of every group."""
    saved = spark.read.parquet(target)
    values = [c for c in saved.columns if c not in (*keys, "version")]
    newest = F.max_by(F.struct(*values), F.col("version")).alias("newest")
    return saved.groupBy(*keys).agg(newest).select(*keys, "newest.*")


def rollup_from_stream(spark: SparkSession, folder: str) -> DataFrame:
    """The line items of the test tables as a stream of flows per supplier and day."""
    schema = spark.read.parquet(f"{folder}/lineitem.parquet").schema
    stream = stream_flows(spark, folder, schema, "lineitem.parquet").select(
        F.col("l_shipdate").cast("date").alias("eff_gas_day"),
        "l_suppkey",
        F.when(F.col("l_linestatus") == "O", 1).otherwise(-1).cast("tinyint").alias("rec_del_sign"),
        F.col("l_quantity").alias("scheduled_quantity"),
    )
    keys = ["eff_gas_day", "l_suppkey"]
    target = work_path(spark, "stream-rollup")
    query = start_rollup(stream, target, work_path(spark, "stream-checkpoint"), keys)
    query.awaitTermination()
    return read_rollup(spark, target, keys)
