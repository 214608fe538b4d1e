"""Writers. Every writer leaves a Spark folder of part files behind."""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weir.operators.profile import numeric_summary
from weir.session import work_path

FORMATS = ("parquet", "csv", "json")
PLOT_COLUMNS = 5


def write_frame(
    df: DataFrame, path: str, format: str = "parquet", overwrite: bool = True
) -> DataFrame:
    """Write and hand on what was saved; without ``overwrite`` an existing folder is an error.

    The input is worked out once. Parquet is read back from its own files; for CSV and JSON,
    which lose types and nulls, a Parquet copy in the work folder is made first and handed on.
    The rows come back in no particular order.
    """
    if format not in FORMATS:
        raise ValueError(f"unknown format {format!r}; choose from {FORMATS}")
    mode = "overwrite" if overwrite else "errorifexists"
    if format == "parquet":
        df.write.mode(mode).parquet(path)
        return df.sparkSession.read.schema(df.schema).parquet(path)
    kept = materialize(df)
    writer = kept.write.mode(mode)
    if format == "csv":
        writer = writer.option("header", "true")
    writer.format(format).save(path)
    return kept


def read_saved(spark: SparkSession, path: str, schema: T.StructType, format: str) -> DataFrame:
    """Read a saved result back with the schema it was written with."""
    if format == "parquet":
        return spark.read.parquet(path)
    reader = spark.read.schema(schema)
    if format == "csv":
        reader = reader.option("header", "true")
    return reader.format(format).load(path)


def save_artifact(
    df: DataFrame,
    folder: str,
    name: str,
    format: str = "parquet",
    overwrite: bool = True,
    include_plots: bool = False,
) -> DataFrame:
    """Write a named result with a one-row metadata file next to it.

    Returns the metadata row: format, saved paths, row and column counts, column names
    and types. The row count comes from the written files, so the plan runs once.
    """
    folder = folder.rstrip("/")
    target = f"{folder}/{name}"
    write_frame(df, target, format, overwrite)
    spark = df.sparkSession
    saved = read_saved(spark, target, df.schema, format)
    paths = [target]
    if include_plots:
        plots = plot_data(saved)
        if plots is not None:
            paths.append(f"{folder}/{name}_plot_data")
            write_frame(plots, paths[-1], "json", overwrite)
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    metadata = saved.agg(F.count(F.lit(1)).alias("rows")).select(
        F.lit(format).alias("output_format"),
        F.array(*map(F.lit, paths)).alias("saved_files"),
        "rows",
        F.lit(len(df.columns)).cast("bigint").alias("columns"),
        F.array(*map(F.lit, df.columns)).alias("column_names"),
        F.create_map(*[F.lit(x) for pair in types.items() for x in pair]).alias("column_types"),
        F.lit(datetime.now(timezone.utc).isoformat()).alias("created_at"),
    )
    meta_path = f"{folder}/{name}_metadata"
    write_frame(metadata, meta_path, "json", overwrite)
    return spark.read.schema(metadata.schema).json(meta_path)


def materialize(df: DataFrame, path: str | None = None) -> DataFrame:
    """Write a step result as zstd parquet in the shared work folder and read it back.

    The rows come back in no particular order. :func:`saved_counts` counts them.
    """
    path = path or work_path(df.sparkSession, "step")
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def saved_counts(saved: DataFrame) -> DataFrame:
    """One row for a saved step: ``rows`` and ``nulls``, the null count of every column."""
    nulls = [x for c in saved.columns for x in (F.lit(c), F.count_if(F.col(c).isNull()))]
    counts = F.create_map(*nulls) if nulls else F.create_map().cast("map<string, bigint>")
    return saved.agg(F.count(F.lit(1)).alias("rows"), counts.alias("nulls"))


def write_daily_rollup(rollup: DataFrame, path: str, date_col: str = "eff_gas_day") -> str:
    """Write the daily rollup in year folders, so that a date filter skips whole years.

    Rows are clustered by year before the write, spread inside a year by a hash of the
    group columns: a few files per year and no single task behind a heavy year.
    """
    year = F.year(date_col)
    spread = F.pmod(F.xxhash64(*[c for c in rollup.columns if c != date_col]), F.lit(32))
    (
        rollup.withColumn("eff_gas_year", year)
        .repartition(F.col("eff_gas_year"), spread)
        .write.mode("overwrite")
        .partitionBy("eff_gas_year")
        .parquet(path)
    )
    return path


def read_daily_rollup(spark: SparkSession, path: str) -> DataFrame:
    """The rollup table; filter on ``eff_gas_year`` to prune folders."""
    return spark.read.parquet(path)


def export_results(
    df: DataFrame,
    path: str,
    question: str,
    description: str = "",
    plan: Mapping[str, object] | None = None,
    run_id: str | None = None,
) -> DataFrame:
    """Result rows as JSON lines in ``path``, and one metadata row beside them.

    The metadata (also written, to ``<path>_metadata``): run id, question, description, the
    plan as JSON text, number and names of columns, and number of rows returned. The rows are
    counted in the saved data.
    """
    saved = write_frame(df, path, "json")
    metadata = saved.agg(F.count(F.lit(1)).alias("rows_returned")).select(
        F.lit(run_id or uuid.uuid4().hex).alias("run_id"),
        F.lit(question).alias("question"),
        F.lit(description).alias("description"),
        F.lit(json.dumps(plan or {}, default=str)).alias("plan"),
        "rows_returned",
        F.array(*map(F.lit, df.columns)).alias("columns"),
    )
    return write_frame(metadata, f"{path.rstrip('/')}_metadata", "json")


def write_dictionary(dictionary: DataFrame, path: str) -> str:
    dictionary.write.mode("overwrite").json(path)
    return path


def load_dictionary(spark: SparkSession, path: str) -> DataFrame:
    schema = "column_name string, data_type string, null_rate double, n_rows bigint"
    return spark.read.schema(schema).json(path)


def plot_data(df: DataFrame) -> DataFrame | None:
    """Mean, std, min, max and count of the first five numeric columns; None without any."""
    numeric = [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]
    if not numeric:
        return None
    return numeric_summary(df, numeric[:PLOT_COLUMNS])
