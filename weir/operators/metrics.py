"""Flow metrics and the daily rollup."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weir.functions.columns import (
    at_least_one,
    delivery_quantity,
    receipt_quantity,
    signed_imbalance_pct,
    signed_quantity,
    total,
)
from weir.functions.order import group_quantiles, left_join_on_keys
from weir.session import dealt, read_twice, tasks_by_input

ROLLUP_KEYS = ["eff_gas_day", "pipeline_name", "state_abb", "category_short"]
LOCATION = ["pipeline_name", "loc_name"]


def daily_rollup(df: DataFrame, keys: Sequence[str] = ROLLUP_KEYS) -> DataFrame:
    """Receipts, deliveries, everything and net per day and group; the base of daily work."""
    return (
        df.groupBy(*keys)
        .agg(
            total(receipt_quantity()).alias("sum_receipts"),
            total(delivery_quantity()).alias("sum_deliveries"),
            total(F.col("scheduled_quantity")).alias("sum_all"),
        )
        .withColumn("net", F.col("sum_receipts") - F.col("sum_deliveries"))
    )


def row_changes(df: DataFrame, keys: Sequence[str] = LOCATION) -> DataFrame:
    """Absolute change between neighbouring rows of a key, as (keys, abs_delta).

    Rows are ordered by (day, quantity), nulls first. Neighbours on one day meet in a group of
    that key and day; from day to day the largest quantity of one meets the first of the next,
    one row per key and day. Both read one shuffle by key and day, dealt to tasks by the size of
    the input: a task sorts its rows and holds its days.
    """
    keys = list(keys)
    quantity, day = F.col("scheduled_quantity"), "eff_gas_day"
    tasks = tasks_by_input(df)
    number = [tasks] if tasks else []
    rows = df.select(*keys, day, "scheduled_quantity").repartition(*number, *keys, day)
    in_day = Window.partitionBy(*keys, day).orderBy("scheduled_quantity")
    on_one_day = rows.select(
        *keys, F.abs(quantity - F.lag(quantity).over(in_day)).alias("abs_delta")
    )
    days = rows.groupBy(*keys, day).agg(
        F.when(F.count_if(quantity.isNull()) == 0, F.min(quantity)).alias("first"),
        F.max(quantity).alias("last"),
    )
    by_day = Window.partitionBy(*keys).orderBy(day)
    to_next = F.abs(F.col("first") - F.lag("last").over(by_day))
    from_day_to_day = dealt(days, tasks, keys).select(*keys, to_next.alias("abs_delta"))
    return on_one_day.unionByName(from_day_to_day).where(F.col("abs_delta").isNotNull())


def _ramp_ratio(joined: DataFrame) -> DataFrame:
    ratio = F.col("p95_abs_delta") / at_least_one(F.col("median_flow"))
    return joined.select(
        *LOCATION,
        F.when(F.col("p95_abs_delta").isNull(), 0.0).otherwise(ratio).alias("ramp_risk"),
        "n_days",
        "p95_abs_delta",
        "median_flow",
    )


def ramp_risk(df: DataFrame) -> DataFrame:
    """p95 of the absolute row-to-row change / max(median flow, 1) per location.

    A location without changes gets risk 0. Locations may have any size: neighbours meet per
    day, and quantiles come from bucket counts.
    """
    rows = read_twice(df.select(*LOCATION, "eff_gas_day", "scheduled_quantity"))
    n_days = rows.groupBy(*LOCATION).agg(F.count(F.lit(1)).alias("n_days"))
    # Changes and quantities share the passes over their buckets.
    changes = row_changes(rows).select(*LOCATION, F.lit(True).alias("change"), "abs_delta")
    flows = rows.select(*LOCATION, F.lit(False), "scheduled_quantity").toDF(*changes.columns)
    wanted = {"p95": 0.95, "middle": "median"}
    found = group_quantiles(changes.unionByName(flows), [*LOCATION, "change"], "abs_delta", wanted)
    both = found.groupBy(*LOCATION).agg(
        F.max(F.when(F.col("change"), F.col("p95"))).alias("p95_abs_delta"),
        F.max(F.when(~F.col("change"), F.col("middle"))).alias("median_flow"),
    )
    return _ramp_ratio(left_join_on_keys(n_days, both, LOCATION))


def reversal_freq(df: DataFrame) -> DataFrame:
    """Share of days on which the net flow with a counterparty changes its sign."""
    keys = ["pipeline_name", "connecting_entity"]
    daily = df.groupBy(*keys, "eff_gas_day").agg(total(signed_quantity()).alias("net"))
    # One row per key and day: bounded by the calendar.
    by_day = Window.partitionBy(*keys).orderBy("eff_gas_day")
    sign = F.signum("net")
    return (
        daily.withColumn("turned", sign != F.lag(sign).over(by_day))
        .groupBy(*keys)
        .agg(
            F.count(F.lit(1)).alias("n_days"),
            F.count_if("turned").alias("n_reversals"),
            F.stddev_samp("net").alias("net_flow_std"),
        )
        .select(
            *keys,
            (F.col("n_reversals") / at_least_one(F.col("n_days"))).alias("reversal_freq"),
            "n_days",
            "n_reversals",
            "net_flow_std",
        )
    )


def imbalance_pct(df: DataFrame) -> DataFrame:
    """|receipts - deliveries| / max(receipts, 1) * 100 per pipeline and day, sorted."""
    gap = F.col("total_receipts") - F.col("total_deliveries")
    return (
        df.groupBy("pipeline_name", "eff_gas_day")
        .agg(
            total(receipt_quantity()).alias("total_receipts"),
            total(delivery_quantity()).alias("total_deliveries"),
        )
        .select(
            "pipeline_name",
            "eff_gas_day",
            (F.abs(gap) / at_least_one(F.col("total_receipts")) * 100.0).alias("imbalance_pct"),
            "total_receipts",
            "total_deliveries",
            gap.alias("net_flow"),
        )
        .orderBy("pipeline_name", "eff_gas_day")
    )


def daily_balance(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Receipts and deliveries per key set (which includes the day)."""
    return df.groupBy(*keys).agg(
        total(receipt_quantity()).alias("receipts"),
        total(delivery_quantity()).alias("deliveries"),
    )


def pipeline_summary(df: DataFrame) -> DataFrame:
    return df.groupBy("pipeline_name").agg(
        total(F.col("scheduled_quantity")).alias("total_quantity"),
        F.avg("scheduled_quantity").alias("avg_quantity"),
        F.min("eff_gas_day").alias("start_date"),
        F.max("eff_gas_day").alias("end_date"),
        F.count(F.lit(1)).alias("record_count"),
    )


def signed_imbalance_summary(df: DataFrame) -> DataFrame:
    """Mean and spread of the signed daily imbalance per pipeline."""
    return (
        daily_balance(df, ["pipeline_name", "eff_gas_day"])
        .withColumn("pct", signed_imbalance_pct())
        .groupBy("pipeline_name")
        .agg(
            F.avg("pct").alias("avg_imbalance_pct"),
            F.stddev_samp("pct").alias("std_imbalance_pct"),
            F.count(F.lit(1)).alias("days_analyzed"),
        )
    )


def monthly_seasonality(df: DataFrame) -> DataFrame:
    """Mean, spread and row count per pipeline and calendar month."""
    return df.groupBy("pipeline_name", F.month("eff_gas_day").alias("month")).agg(
        F.avg("scheduled_quantity").alias("avg_monthly_flow"),
        F.stddev_samp("scheduled_quantity").alias("std_monthly_flow"),
        F.count(F.lit(1)).alias("record_count"),
    )


METRICS = {
    "ramp_risk": ramp_risk,
    "reversal_freq": reversal_freq,
    "imbalance_pct": imbalance_pct,
}


def compute_metric(df: DataFrame, name: str) -> DataFrame:
    if name not in METRICS:
        raise ValueError(f"unknown metric {name!r}; choose from {sorted(METRICS)}")
    return METRICS[name](df)

