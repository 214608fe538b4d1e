"""Filters, projections and semi joins."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from typing import Any

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weir.functions.columns import (
    delivery_quantity,
    keep_present,
    receipt_quantity,
    signed_quantity,
)
from weir.functions.order import median_is_positive
from weir.functions.predicates import all_of, date_window, name_contains


def filter_rows(df: DataFrame, filters: Iterable[Mapping[str, Any]]) -> DataFrame:
    """Keep the rows that meet every filter."""
    return df.where(all_of(filters))


def select_present(df: DataFrame, wanted: Sequence[str]) -> DataFrame:
    return df.select(*keep_present(df, wanted))


def scope(df: DataFrame, pipeline: str | None = None, since: Any = None) -> DataFrame:
    """Optional pipeline and start-day restriction."""
    if pipeline:
        df = df.where(F.col("pipeline_name") == pipeline)
    if since:
        df = df.where(date_window(since=since))
    return df


def pipelines_like(df: DataFrame, part: str) -> DataFrame:
    return df.where(name_contains("pipeline_name", part))


def with_net_flow(df: DataFrame) -> DataFrame:
    return df.withColumn("net_flow", signed_quantity())


def with_receipts_deliveries(df: DataFrame) -> DataFrame:
    return df.withColumns({"receipts": receipt_quantity(), "deliveries": delivery_quantity()})


def entities_with_days(daily: DataFrame, entity: str, min_days: int) -> DataFrame:
    """Rows of the entities that have at least ``min_days`` rows; give one row per day.

    A semi join of the table with its own frequent keys, written as a count next to each
    row: the windows that follow per entity reuse the same partitioning.
    """
    days = F.count(F.lit(1)).over(Window.partitionBy(entity))
    return daily.withColumn("__days", days).where(F.col("__days") >= min_days).drop("__days")


def active_locations(df: DataFrame) -> DataFrame:
    """(pipeline, location) pairs whose median quantity is above zero."""
    return (
        df.groupBy("pipeline_name", "loc_name")
        .agg(median_is_positive(F.col("scheduled_quantity")).alias("active"))
        .where("active")
        .drop("active")
    )
