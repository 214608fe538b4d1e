"""Changepoints of daily series, their statistics and the event card."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weir.functions import segments
from weir.functions.columns import total
from weir.functions.order import left_join_on_keys
from weir.operators.decompose import daily_series
from weir.session import read_twice

STAT_COLUMNS = (
    "before_mean",
    "after_mean",
    "before_std",
    "after_std",
    "change_magnitude",
    "confidence",
)
TINY = 1e-8
DAYS_BEFORE = 30
DAYS_AFTER = 30

# The kernel travels with the task, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(segments)


def with_split_stats(
    daily: DataFrame, series: Sequence[str], value: str, date_col: str = "eff_gas_day"
) -> DataFrame:
    """For every day: statistics of all days before it and of it and all days after it.

    Both sides are running aggregates (one forward, one backward), so a long series costs
    no more per day than a short one.
    """
    whole = Window.partitionBy(*series)
    before = whole.orderBy(F.col(date_col)).rowsBetween(Window.unboundedPreceding, -1)
    after = whole.orderBy(F.col(date_col).desc()).rowsBetween(Window.unboundedPreceding, 0)
    shift = F.abs(F.col("after_mean") - F.col("before_mean"))
    pooled = F.sqrt((F.pow("before_std", F.lit(2)) + F.pow("after_std", F.lit(2))) / 2)
    return daily.withColumns(
        {
            "before_mean": F.avg(value).over(before),
            "before_std": F.stddev_pop(value).over(before),
            "after_mean": F.avg(value).over(after),
            "after_std": F.stddev_pop(value).over(after),
        }
    ).withColumns(
        {
            "change_magnitude": shift / (F.abs("before_mean") + TINY),
            "confidence": shift / (pooled + TINY),
        }
    )


def detect_changepoints(
    df: DataFrame,
    groupby: Sequence[str] | None = None,
    value: str = "scheduled_quantity",
    date_col: str = "eff_gas_day",
    min_size: int = 10,
    penalty: float | str = 10.0,
    min_confidence: float = 0.7,
    jump: int = 5,
) -> DataFrame:
    """Breaks in the daily totals of every group (one combined series without groups).

    Columns: the groups, ``changepoint_date``, mean and population std before and after,
    ``change_magnitude`` and ``confidence``. Series shorter than twice ``min_size`` and
    series with a null key are skipped.
    """
    if min_size < 1 or jump < 1:
        raise ValueError("min_size and jump are 1 or more")
    if penalty != "bic" and not isinstance(penalty, (int, float)):
        raise ValueError("penalty is a number or 'bic'")
    series = list(groupby or [])
    daily = daily_series(df, series, value, date_col).where(F.col(date_col).isNotNull())
    for key in series:
        daily = daily.where(F.col(key).isNotNull())
    columns = [*series, date_col, *STAT_COLUMNS]
    stats = with_split_stats(daily, series, value, date_col).select(*columns, value)
    schema = stats.select(*columns).schema

    best_breaks = segments.best_breaks

    def breaks_of_series(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(date_col, ignore_index=True)
        found = best_breaks(pdf[value].to_numpy(dtype=float), min_size, penalty, jump)
        return pdf.loc[found, columns]

    # The windows above already placed every series in one partition; the Python side
    # sees at most one row per calendar day and series.
    if not series:
        stats = stats.withColumn("__all", F.lit(True))
    found = stats.groupBy(*(series or ["__all"])).applyInPandas(breaks_of_series, schema)
    if min_confidence > 0:
        found = found.where(F.col("confidence") >= min_confidence)
    return found.withColumnRenamed(date_col, "changepoint_date")


def changepoint_step(
    df: DataFrame,
    column: str = "scheduled_quantity",
    date_column: str = "eff_gas_day",
    method: str = "pelt",
    cost: str = "l2",
    min_size: int = 7,
    penalty: float | str = 10.0,
    min_confidence: float = 0.7,
    groupby: Sequence[str] | None = None,
    jump: int = 5,
) -> DataFrame:
    """Step form with its own defaults; only the pelt method with the l2 cost exists."""
    if method != "pelt":
        raise ValueError(f"unsupported changepoint method {method!r}")
    if cost != "l2":
        raise ValueError(f"unsupported changepoint cost {cost!r}")
    return detect_changepoints(
        df, groupby, column, date_column, min_size, penalty, min_confidence, jump
    )


def sensitive_changepoints(df: DataFrame) -> DataFrame:
    """Preset of the multi-analysis: short segments, low penalty, low confidence."""
    return detect_changepoints(
        df, ["pipeline_name"], min_size=3, penalty=0.5, min_confidence=0.3
    )


def split_stats_at(
    df: DataFrame,
    splits: DataFrame,
    series: Sequence[str],
    value: str = "scheduled_quantity",
    date_col: str = "eff_gas_day",
) -> DataFrame:
    """Before/after statistics at given split days (series columns plus ``date_col``)."""
    daily = daily_series(df, series, value, date_col)
    stats = with_split_stats(daily, series, value, date_col)
    return stats.join(splits, [*series, date_col]).select(
        *series, F.col(date_col).alias("changepoint_date"), *STAT_COLUMNS
    )


def window_totals(
    df: DataFrame,
    dates: DataFrame,
    keys: Sequence[str] = ("pipeline_name", "loc_name"),
    value: str = "scheduled_quantity",
    date_col: str = "eff_gas_day",
    match: Sequence[str] = (),
) -> DataFrame:
    """Totals per key in the 30 days before and the 31 days from every event date on.

    ``dates`` holds ``changepoint_date`` (and the ``match`` columns). Distinct event dates
    are bounded by the calendar; each is laid out as its 61 days, which turns the range
    join into an equality join on the day against daily totals.
    """
    keys, match = list(keys), list(match)
    event_days = (
        dates.select(*match, "changepoint_date")
        .distinct()
        .select(
            *match,
            "changepoint_date",
            F.explode(F.sequence(F.lit(-DAYS_BEFORE), F.lit(DAYS_AFTER))).alias("shift"),
        )
        .withColumn(date_col, F.date_add("changepoint_date", F.col("shift")))
    )
    daily = daily_series(df, list(dict.fromkeys([*keys, *match])), value, date_col)
    is_before = F.col("shift") < 0
    return (
        daily.join(event_days, [*match, date_col])
        .groupBy("changepoint_date", *dict.fromkeys([*match, *keys]))
        .agg(
            total(F.when(is_before, F.col(value))).alias("before_total"),
            total(F.when(~is_before, F.col(value))).alias("after_total"),
        )
        .withColumn("change", F.col("after_total") - F.col("before_total"))
        .withColumn("abs_change", F.abs("change"))
    )


def top_contributors(
    df: DataFrame,
    dates: DataFrame,
    top: int = 5,
    match: Sequence[str] = (),
    date_col: str = "eff_gas_day",
) -> DataFrame:
    """The ``top`` locations by absolute change around every event date."""
    keys = ["pipeline_name", "loc_name"]
    order = Window.partitionBy("changepoint_date", *match).orderBy(F.desc("abs_change"), *keys)
    return (
        window_totals(df, dates, keys, date_col=date_col, match=match)
        .withColumn("place", F.row_number().over(order))
        .where(F.col("place") <= top)
    )


def event_card(
    changepoints: DataFrame,
    df: DataFrame,
    top: int = 5,
    match: Sequence[str] = (),
    date_col: str = "eff_gas_day",
) -> DataFrame:
    """Every changepoint with its top contributors as an array of structs.

    Contributors come from the whole table; ``match`` limits them to the event's group.
    """
    match = list(match)
    changepoints = read_twice(changepoints)
    fields = [
        "place",
        "pipeline_name",
        "loc_name",
        "before_total",
        "after_total",
        "change",
        "abs_change",
    ]
    lists = (
        top_contributors(df, changepoints, top, match, date_col)
        .withColumn("entry", F.struct(*fields))
        .groupBy("changepoint_date", *match)
        .agg(F.sort_array(F.collect_list("entry")).alias("top_contributors"))
    )
    return left_join_on_keys(changepoints, lists, ["changepoint_date", *match])


def full_outer_totals(
    df: DataFrame,
    split: str,
    keys: Sequence[str] = ("pipeline_name", "loc_name"),
    value: str = "scheduled_quantity",
    date_col: str = "eff_gas_day",
) -> DataFrame:
    """Before and after totals of one event date by a full outer join; a missing side is 0."""
    day = F.col(date_col)
    at = F.lit(split).cast("date")

    def side(condition, name: str) -> DataFrame:
        return df.where(condition).groupBy(*keys).agg(total(F.col(value)).alias(name))

    before = side(day.between(F.date_sub(at, DAYS_BEFORE), F.date_sub(at, 1)), "before_total")
    after = side(day.between(at, F.date_add(at, DAYS_AFTER)), "after_total")
    return (
        before.join(after, list(keys), "full")
        .fillna(0.0, ["before_total", "after_total"])
        .withColumn("change", F.col("after_total") - F.col("before_total"))
    )


def score_detection(detected: DataFrame, known: DataFrame, tolerance_days: int = 7) -> DataFrame:
    """Precision, recall and F1 of detected dates against known dates (column ``day``).

    A known date counts as found when a detection lies within the tolerance. Detections
    are laid out over the tolerance, so the test is an equality semi join.
    """
    spread = F.explode(F.sequence(F.lit(-tolerance_days), F.lit(tolerance_days)))
    near = detected.select("day", spread.alias("shift")).select(
        F.date_add("day", F.col("shift")).alias("day")
    )

    def count(frame: DataFrame) -> DataFrame:
        return frame.agg(F.count(F.lit(1)).alias("n"))

    zero = F.lit(0.0)
    correct = F.col("correct_detections")
    both = F.col("precision") + F.col("recall")
    return (
        count(known.join(near.distinct(), "day", "left_semi"))
        .withColumnRenamed("n", "correct_detections")
        .withColumn("total_detected", count(detected).scalar())
        .withColumn("total_true", count(known).scalar())
        .withColumn("precision", F.coalesce(F.try_divide(correct, "total_detected"), zero))
        .withColumn("recall", F.coalesce(F.try_divide(correct, "total_true"), zero))
        .withColumn(
            "f1_score",
            F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"), both), zero),
        )
    )
