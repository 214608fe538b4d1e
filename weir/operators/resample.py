"""Calendar resampling: left-closed buckets labelled by their first day or instant."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weir.functions.columns import total
from weir.operators.aggregate import ALIASES, aggregate, metric_name

# Frequency suffixes and the unit they stand for.
UNITS = {
    "s": "second",
    "m": "minute",
    "min": "minute",
    "h": "hour",
    "d": "day",
    "w": "week",
    "mo": "month",
    "M": "month",
    "q": "quarter",
    "y": "year",
}
SECONDS = {"second": 1, "minute": 60, "hour": 3600}
CALENDAR_MONTHS = {"month": 1, "quarter": 3, "year": 12}
FIRST_MONDAY = "1970-01-05"


def parse_freq(freq: str) -> tuple[int, str]:
    match = re.fullmatch(r"(\d+)([A-Za-z]+)", freq)
    if not match or match[2] not in UNITS or int(match[1]) < 1:
        raise ValueError(f"not a frequency: {freq!r} (like 1d, 15min, 1w, 1mo, 1q, 1y)")
    return int(match[1]), UNITS[match[2]]


def time_bucket(df: DataFrame, on: str, freq: str) -> Column:
    """Start of the bucket that holds ``on``, with the type of ``on``.

    Days count from 1970-01-01, weeks start on Monday, months count from January 1970. Null
    times are a bucket of their own at every frequency.
    """
    n, unit = parse_freq(freq)
    dtype = df.schema[on].dataType
    c = F.col(on)
    if unit in ("second", "minute", "hour"):
        width = F.lit(n * SECONDS[unit])
        passed = F.unix_seconds(c.cast("timestamp"))
        return F.timestamp_seconds(passed - F.pmod(passed, width)).cast(dtype)
    if unit in CALENDAR_MONTHS:
        months = n * CALENDAR_MONTHS[unit]
        index = (F.year(c) - 1970) * 12 + F.month(c) - 1
        start = index - F.pmod(index, F.lit(months))
        return F.add_months(F.lit("1970-01-01").cast("date"), start).cast(dtype)
    days, origin = (n, "1970-01-01") if unit == "day" else (7 * n, FIRST_MONDAY)
    if days == 1:
        return c if isinstance(dtype, T.DateType) else c.cast("date").cast(dtype)
    origin_day = F.lit(origin).cast("date")
    passed = F.datediff(c.cast("date"), origin_day)
    return F.date_add(origin_day, passed - F.pmod(passed, F.lit(days))).cast(dtype)


def _resample_metric(col: str, fn: str) -> Column:
    c = F.col(col)
    simple = {"sum": total, "mean": F.avg, "min": F.min, "max": F.max}
    if fn in simple:
        return simple[fn](c).alias(col)
    if fn == "count":
        return F.count(F.lit(1)).alias(f"{col}_count")
    if fn in ("first", "last"):
        return F.col(f"__{fn}")[col].alias(col)
    raise ValueError(f"unsupported resample function {fn!r}")


def resample(
    df: DataFrame,
    freq: str = "1d",
    on: str = "eff_gas_day",
    agg: Mapping[str, str] | None = None,
) -> DataFrame:
    """One row per non-empty bucket.

    Functions: sum, mean, count (named ``<col>_count``), min, max, first, last. All first
    values of a bucket come from one row, the smallest by (``on``, then the other columns in
    table order, nulls first), and all last values from the greatest. Without ``agg`` every
    other column gives its first.
    """
    if agg is None:
        agg = {c: "first" for c in df.columns if c != on}
    kept = df.withColumn("__at", F.col(on)).withColumn(on, time_bucket(df, on, freq))
    row = F.struct("__at", *[c for c in df.columns if c != on])
    ends = {"first": F.min(row).alias("__first"), "last": F.max(row).alias("__last")}
    metrics, picked = [], []
    for i, (c, fn) in enumerate(agg.items()):
        metric = _resample_metric(c, fn)
        if fn in ends:
            picked.append(metric)
        else:
            name = f"{c}_count" if fn == "count" else c
            metrics.append(metric.alias(f"__m{i}"))
            picked.append(F.col(f"__m{i}").alias(name))
    used = [end for fn, end in ends.items() if fn in agg.values()]
    return kept.groupBy(on).agg(*metrics, *used).select(on, *picked)


def resample_grouped(
    df: DataFrame,
    group: Sequence[str],
    freq: str,
    col: str = "scheduled_quantity",
    fn: str = "sum",
    on: str = "eff_gas_day",
) -> DataFrame:
    """Per key: the metric per ``on`` value, then the **sum** of those per bucket.

    Sum and count add up, so they need only the second grouping. For every other
    function (avg, p95, ...) the daily values are summed too; that is the defined meaning.
    Without keys the metric is computed directly per bucket.
    """
    group = [c for c in group if c != on]
    name = metric_name(col, fn)
    additive = ALIASES.get(fn.lower(), fn.lower()) in ("sum", "count")
    bucket = time_bucket(df, on, freq)
    if additive or not group:
        return aggregate(df.withColumn(on, bucket), [*group, on], [{"col": col, "fn": fn}])
    daily = aggregate(df, [*group, on], [{"col": col, "fn": fn}])
    return daily.groupBy(*group, bucket.alias(on)).agg(total(F.col(name)).alias(name))


def monthly_trend(
    df: DataFrame, col: str = "scheduled_quantity", on: str = "eff_gas_day"
) -> DataFrame:
    """Monthly totals with a ``yyyy-MM`` label."""
    return resample(df, "1mo", on, {col: "sum"}).select(
        F.date_format(on, "yyyy-MM").alias("month"), F.col(col).alias(f"sum_{col}")
    )
