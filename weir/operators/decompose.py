"""Seasonal decomposition of daily series by window functions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weir.functions.columns import total
from weir.session import dealt, tasks_by_input

MIN_ROWS = 14
SEASON_PERIODS = {"weekly": 7, "annual": 365}


def daily_series(
    df: DataFrame, series: Sequence[str], value: str, date_col: str = "eff_gas_day"
) -> DataFrame:
    """One total per (series, day). Map-side sums run first, so after this step the rows of
    one series are bounded by the calendar, whatever part of the table it holds."""
    return df.groupBy(*series, date_col).agg(total(F.col(value).cast("double")).alias(value))


def season_key(period: int, date_col: str, series: Sequence[str]) -> Column:
    """Weekday for 7, day of year for 365, else the row number modulo the period."""
    if period == 7:
        return F.weekday(date_col)
    if period == 365:
        return F.dayofyear(date_col)
    number = F.row_number().over(Window.partitionBy(*series).orderBy(date_col))
    return F.pmod(number - 1, F.lit(period))


def with_seasonal(
    df: DataFrame,
    value: str,
    period: int,
    name: str,
    series: Sequence[str] = (),
    date_col: str = "eff_gas_day",
) -> DataFrame:
    """Mean of ``value`` per season key, centred so that it sums to zero over the series."""
    keyed = df.withColumn("__key", season_key(period, date_col, series))
    raw = F.avg(value).over(Window.partitionBy(*series, "__key"))
    centred = F.col("__raw") - F.avg("__raw").over(Window.partitionBy(*series))
    return keyed.withColumn("__raw", raw).withColumn(name, centred).drop("__raw", "__key")


def deseasonalize(
    df: DataFrame,
    column: str = "scheduled_quantity",
    date_col: str = "eff_gas_day",
    series: Sequence[str] = (),
    seasonal: Sequence[str] = ("weekly", "annual"),
    trend_window: int = 365,
) -> DataFrame:
    """Split daily totals into trend, weekly part, annual part and residual, per series.

    ``value = trend + seasonal_weekly + seasonal_annual + residual`` and
    ``deseasonalized = value - seasonal_weekly - seasonal_annual``. Series of fewer than
    14 days stay as they are: the trend is the value and the other parts are 0. All windows
    work on one dealing of the days by series, in tasks whose number grows with the input.
    """
    unknown = [s for s in seasonal if s not in SEASON_PERIODS]
    if unknown:
        raise ValueError(f"unknown seasonal components {unknown}")
    if not isinstance(df.schema[column].dataType, T.NumericType):
        raise ValueError(f"column {column!r} is not numeric")
    series = list(series)
    whole = Window.partitionBy(*series)
    half = trend_window // 2
    around = whole.orderBy(date_col).rowsBetween(-half, half)

    tasks = tasks_by_input(df)
    daily = daily_series(df, series, column, date_col).where(F.col(date_col).isNotNull())
    daily = dealt(daily, tasks, series)
    parts = daily.withColumns(
        {
            "trend": F.avg(column).over(around),
            "__short": F.count(F.lit(1)).over(whole) < MIN_ROWS,
        }
    ).withColumn("__left", F.col(column) - F.col("trend"))
    for component in ("weekly", "annual"):
        name = f"seasonal_{component}"
        if component in seasonal:
            parts = with_seasonal(
                parts, "__left", SEASON_PERIODS[component], name, series, date_col
            )
        else:
            parts = parts.withColumn(name, F.lit(0.0))
        parts = parts.withColumn("__left", F.col("__left") - F.col(name))

    short = F.col("__short")
    season = F.col("seasonal_weekly") + F.col("seasonal_annual")
    return parts.select(
        *series,
        date_col,
        column,
        F.when(short, F.col(column)).otherwise(F.col(column) - season).alias("deseasonalized"),
        F.when(short, F.col(column)).otherwise(F.col("trend")).alias("trend"),
        F.when(short, 0.0).otherwise(F.col("seasonal_weekly")).alias("seasonal_weekly"),
        F.when(short, 0.0).otherwise(F.col("seasonal_annual")).alias("seasonal_annual"),
        F.when(short, 0.0).otherwise(F.col("__left")).alias("residual"),
    )
