"""Data-quality rules R-001 to R-006: each returns its violations as a DataFrame."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weir.functions.columns import (
    delivery_quantity,
    has_columns,
    keep_present,
    receipt_quantity,
    total,
)
from weir.functions.order import median_is_positive, median_parts, positive_by_parts
from weir.operators.basic import active_locations, scope
from weir.session import written
from weir.sources.flows import FLOW_SCHEMA

# Fixed thresholds and rule texts.
ZERO_STREAK_DAYS = 7
IMBALANCE_THRESHOLD = 5.0
MIN_COVERED_DAYS = 30
RULE_DESCRIPTIONS = {
    "R-001": "Missing coordinates on active rows",
    "R-002": "Location name in several states",
    "R-003": "Zero-quantity days at active locations",
    "R-004": "Daily pipeline imbalance",
    "R-005": "Connecting pipeline outside interconnects",
    "R-006": "Missing gas days",
}
LOCATION = ["pipeline_name", "loc_name"]


def _no_rows(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """An empty result for a rule whose columns are absent."""
    known = {f.name: f.dataType for f in FLOW_SCHEMA.fields}
    return df.where(F.lit(False)).select(
        *[
            F.col(c) if c in df.columns else F.lit(None).cast(known.get(c, "double")).alias(c)
            for c in columns
        ]
    )


def _geo_is_missing(df: DataFrame) -> Column:
    active = F.col("scheduled_quantity") > 0
    if has_columns(df, "latitude", "longitude"):
        return active & (F.col("latitude").isNull() | F.col("longitude").isNull())
    return active


def _category_is_wrong() -> Column:
    return F.col("connecting_pipeline").isNotNull() & (
        F.lower("category_short") != "interconnect"
    )


def missing_geo(df: DataFrame) -> DataFrame:
    """R-001: latitude or longitude null while the quantity is positive.

    An absent coordinate column counts as null on every row.
    """
    wanted = ["pipeline_name", "loc_name", "scheduled_quantity", "eff_gas_day"]
    coordinates = [
        F.col(c) if c in df.columns else F.lit(None).cast("double").alias(c)
        for c in ("latitude", "longitude")
    ]
    return df.where(_geo_is_missing(df)).select(*keep_present(df, wanted), *coordinates)


def locations_in_many_states(
    df: DataFrame, loc_col: str = "loc_name", state_col: str = "state_abb"
) -> DataFrame:
    """R-002: location name seen in more than one state, with its states and one example.

    Rows are first reduced to one per (location, state, pipeline) with its first day, by a
    plain hash aggregation: states and example are built from that, never from raw rows.
    """
    extra = keep_present(df, ["pipeline_name", "eff_gas_day"])
    if not has_columns(df, loc_col, state_col):
        return _no_rows(df, [loc_col, "n_states", "states", *extra])
    first_day = F.min("eff_gas_day") if "eff_gas_day" in extra else F.count(F.lit(1))
    reduced = df.groupBy(loc_col, state_col, *[c for c in extra if c == "pipeline_name"]).agg(
        first_day.alias("eff_gas_day")
    )
    example = F.min(F.struct(*extra)) if extra else F.lit(None)
    result = (
        reduced.groupBy(loc_col, state_col)
        .agg(example.alias("example"))
        .groupBy(loc_col)
        .agg(
            F.count(F.lit(1)).alias("n_states"),
            F.sort_array(F.collect_list(state_col)).alias("states"),
            F.min("example").alias("example"),
        )
        .where(F.col("n_states") > 1)
    )
    return result.select(
        loc_col, "n_states", "states", *[F.col(f"example.{c}").alias(c) for c in extra]
    )


def _zero_day_columns() -> dict[str, Column]:
    day = F.when(F.col("scheduled_quantity") == 0, F.col("eff_gas_day"))
    return {
        "zero_days": F.count(day),
        "first_zero_date": F.min(day),
        "last_zero_date": F.max(day),
        "active": median_is_positive(F.col("scheduled_quantity")),
    }


def zero_quantity_days(df: DataFrame, min_days: int = ZERO_STREAK_DAYS) -> DataFrame:
    """R-003 as counted: locations with a positive median and ``min_days`` zero rows or more.

    Zero days and the sign of the median come from one aggregation.
    """
    columns = ["zero_days", "first_zero_date", "last_zero_date"]
    if not has_columns(df, *LOCATION, "scheduled_quantity", "eff_gas_day"):
        return _no_rows(df, [*LOCATION, *columns])
    return (
        df.groupBy(*LOCATION)
        .agg(*[c.alias(name) for name, c in _zero_day_columns().items()])
        .where(F.col("active") & (F.col("zero_days") >= min_days))
        .drop("active")
    )


def zero_quantity_streaks(df: DataFrame, min_days: int = ZERO_STREAK_DAYS) -> DataFrame:
    """R-003 as described: runs of ``min_days`` consecutive days whose rows are all zero.

    Days are numbered per location; day minus number is constant inside a run.
    """
    columns = ["streak_start", "streak_end", "streak_days"]
    if not has_columns(df, *LOCATION, "scheduled_quantity", "eff_gas_day"):
        return _no_rows(df, [*LOCATION, *columns])
    all_zero = (
        df.groupBy(*LOCATION, "eff_gas_day")
        .agg(F.max(F.coalesce(F.abs("scheduled_quantity"), F.lit(1.0))).alias("most"))
        .where((F.col("most") == 0) & F.col("eff_gas_day").isNotNull())
    )
    by_day = Window.partitionBy(*LOCATION).orderBy("eff_gas_day")
    streaks = (
        all_zero.withColumn("run", F.date_sub("eff_gas_day", F.row_number().over(by_day)))
        .groupBy(*LOCATION, "run")
        .agg(
            F.min("eff_gas_day").alias("streak_start"),
            F.max("eff_gas_day").alias("streak_end"),
            F.count(F.lit(1)).alias("streak_days"),
        )
        .where(F.col("streak_days") >= min_days)
        .drop("run")
    )
    active = active_locations(df).toDF("__pipeline", "__loc")
    return streaks.join(
        active,
        F.col("pipeline_name").eqNullSafe(F.col("__pipeline"))
        & F.col("loc_name").eqNullSafe(F.col("__loc")),
        "left_semi",
    )


def pipeline_imbalance(
    df: DataFrame, threshold: float = IMBALANCE_THRESHOLD, mode: str = "absolute"
) -> DataFrame:
    """R-004: days on which a pipeline's receipts and deliveries differ.

    ``absolute`` compares the difference itself with the threshold, ``ratio`` compares
    difference / (receipts + 1), in percent.
    """
    if mode not in ("absolute", "ratio"):
        raise ValueError("mode is 'absolute' or 'ratio'")
    columns = ["receipts", "deliveries", "net", "imbalance_ratio"]
    keys = ["pipeline_name", "eff_gas_day"]
    if not has_columns(df, *keys, "rec_del_sign", "scheduled_quantity"):
        return _no_rows(df, [*keys, *columns])
    daily = df.groupBy(*keys).agg(
        total(receipt_quantity()).alias("receipts"),
        total(delivery_quantity()).alias("deliveries"),
    )
    return _out_of_balance(daily, threshold, mode)


def _out_of_balance(daily: DataFrame, threshold: float, mode: str) -> DataFrame:
    balance = daily.withColumn("net", F.col("receipts") - F.col("deliveries")).withColumn(
        "imbalance_ratio", F.abs("net") / (F.col("receipts") + 1.0)
    )
    size = F.abs("net") if mode == "absolute" else F.col("imbalance_ratio") * 100
    return balance.where(size > threshold)


def schema_mismatch(df: DataFrame) -> DataFrame:
    """R-005: a connecting pipeline on a row whose category is not interconnect."""
    columns = ["connecting_pipeline", "category_short"]
    if not has_columns(df, *columns):
        return _no_rows(df, columns)
    extra = keep_present(df, ["pipeline_name", "loc_name", "eff_gas_day"])
    return df.where(_category_is_wrong()).select(*columns, *extra)


def gas_day_gaps(df: DataFrame, min_days: int = MIN_COVERED_DAYS) -> DataFrame:
    """R-006: active locations with fewer than ``min_days`` rows, and their missing days.

    ``actual_days`` counts rows; ``distinct_days`` counts days, for tables in which a
    location reports more than once a day.
    """
    columns = ["first_date", "last_date", "actual_days", "missing_days", "total_quantity"]
    if not has_columns(df, *LOCATION, "eff_gas_day", "scheduled_quantity"):
        return _no_rows(df, [*LOCATION, *columns, "distinct_days"])
    # Two plain aggregations instead of a distinct one: per day, then per location.
    per_day = df.groupBy(*LOCATION, "eff_gas_day").agg(
        F.count("eff_gas_day").alias("rows"),
        total(F.col("scheduled_quantity")).alias("quantity"),
    )
    span = F.datediff("last_date", "first_date") + 1
    return (
        per_day.groupBy(*LOCATION)
        .agg(
            F.min("eff_gas_day").alias("first_date"),
            F.max("eff_gas_day").alias("last_date"),
            F.sum("rows").alias("actual_days"),
            F.sum("quantity").alias("total_quantity"),
            F.count("eff_gas_day").alias("distinct_days"),
        )
        .where((F.col("total_quantity") > 0) & (F.col("actual_days") < min_days))
        .withColumn("missing_days", span - F.col("actual_days"))
        .select(*LOCATION, *columns, "distinct_days")
    )


RULES: dict[str, Callable[[DataFrame], DataFrame]] = {
    "R-001": missing_geo,
    "R-002": locations_in_many_states,
    "R-003": zero_quantity_days,
    "R-004": pipeline_imbalance,
    "R-005": schema_mismatch,
    "R-006": gas_day_gaps,
}


def violation_counts(df: DataFrame, pipeline: str | None = None, since: Any = None) -> DataFrame:
    """(rule_id, violations) of all six rules on the scoped rows.

    The rows are read once, into one written row per place (location and state) and one per
    pipeline and day; every rule is counted from those.
    """
    scoped = scope(df, pipeline, since)
    nothing = F.lit(0).cast("bigint")
    places = keep_present(scoped, [*LOCATION, "state_abb"])
    days = ["pipeline_name", "eff_gas_day"]
    at_locations = has_columns(scoped, *LOCATION, "scheduled_quantity", "eff_gas_day")
    balanced = has_columns(scoped, *days, "rec_del_sign", "scheduled_quantity")
    has_category = has_columns(scoped, "connecting_pipeline", "category_short")

    found = {
        "geo": F.count_if(_geo_is_missing(scoped)),
        "category": F.count_if(_category_is_wrong()) if has_category else F.count_if(F.lit(False)),
    }
    if at_locations:
        zero_day = F.when(F.col("scheduled_quantity") == 0, F.col("eff_gas_day"))
        found |= median_parts(F.col("scheduled_quantity")) | {
            "zero_days": F.count(zero_day),
            "rows": F.count("eff_gas_day"),
            "quantity": F.sum("scheduled_quantity"),
        }
    if balanced:
        found |= {
            "receipts": total(receipt_quantity()),
            "deliveries": total(delivery_quantity()),
            "of_day": F.grouping("eff_gas_day") == 0,
        }
        columns = list(dict.fromkeys([*places, *days]))
        grouped = scoped.groupingSets([places, days], *columns)
    else:
        found["of_day"] = F.max(F.lit(False))
        grouped = scoped.groupBy(*places)
    groups = written(grouped.agg(*[c.alias(name) for name, c in found.items()]), "rule-groups")
    of_place = groups.where(~F.coalesce("of_day", F.lit(False)))

    parts = [
        of_place.agg(
            F.coalesce(F.sum("geo"), nothing).alias("R-001"),
            F.coalesce(F.sum("category"), nothing).alias("R-005"),
        ),
        locations_in_many_states(of_place.select(*places)).agg(F.count(F.lit(1)).alias("R-002")),
    ]
    if at_locations:
        merged = of_place.groupBy(*LOCATION).agg(
            *[F.sum(c).alias(c) for c in ("n", "low", "zero_days", "rows", "quantity")],
            F.max("below").alias("below"),
            F.min("above").alias("above"),
        )
        active = positive_by_parts(*[F.col(c) for c in ("n", "low", "below", "above")])
        parts.append(
            merged.agg(
                F.count_if(active & (F.col("zero_days") >= ZERO_STREAK_DAYS)).alias("R-003"),
                F.count_if((F.col("quantity") > 0) & (F.col("rows") < MIN_COVERED_DAYS)).alias(
                    "R-006"
                ),
            )
        )
    else:
        parts.append(of_place.agg(*[F.count_if(F.lit(False)).alias(r) for r in ("R-003", "R-006")]))
    if balanced:
        off = _out_of_balance(groups.where("of_day"), IMBALANCE_THRESHOLD, "absolute")
    else:
        off = _no_rows(of_place, [])
    parts.append(off.agg(F.count(F.lit(1)).alias("R-004")))
    long = [part.unpivot([], part.columns, "rule_id", "violations") for part in parts]
    return reduce(DataFrame.unionByName, long)


def run_rules(
    df: DataFrame, pipeline: str | None = None, since: Any = None, samples: int = 3
) -> dict[str, DataFrame]:
    """``summary`` with the counts, and up to ``samples`` rows of every rule by its id."""
    scoped = scope(df, pipeline, since)
    result = {"summary": violation_counts(scoped)}
    for rule_id, rule in RULES.items():
        found = rule(scoped)
        order = [c for c in found.columns if c != "states"]
        result[rule_id] = found.orderBy(*order).limit(samples)
    return result


def rules_report(df: DataFrame, pipeline: str | None = None, since: Any = None) -> DataFrame:
    """Counts with rule texts, and a total row at the end."""
    text = F.create_map(*[F.lit(x) for pair in RULE_DESCRIPTIONS.items() for x in pair])
    counts = violation_counts(df, pipeline, since)
    return (
        counts.rollup("rule_id")
        .agg(F.sum("violations").alias("violations"))
        .select(
            F.coalesce("rule_id", F.lit("Total")).alias("rule_id"),
            F.coalesce(F.try_element_at(text, F.col("rule_id")), F.lit("All rules")).alias(
                "description"
            ),
            "violations",
        )
        .orderBy(F.col("rule_id") == "Total", "rule_id")
    )
