"""Grouped and global aggregation with the metric names sum_x, avg_x, p95_x, ..."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weir.functions.columns import total
from weir.functions.order import group_quantiles, left_join_on_keys
from weir.session import read_twice

# Other names for the same function.
ALIASES = {"mean": "avg", "median": "p50"}
QUANTILES = {"p95": 0.95, "p50": "median"}
SIMPLE = {
    "sum": total,
    "avg": F.avg,
    "min": F.min,
    "max": F.max,
    "std": F.stddev_samp,
    "var": F.var_samp,
}
METRIC_FNS = ("sum", "count", "avg", "p95", "p50", "min", "max", "std", "var")


def metric_name(col: str, fn: str) -> str:
    fn = ALIASES.get(fn.lower(), fn.lower())
    if fn not in METRIC_FNS:
        raise ValueError(f"unsupported aggregation function {fn!r}; choose from {METRIC_FNS}")
    return "count" if fn == "count" else f"{fn}_{col}"


def _simple(col: str, fn: str) -> Column:
    fn = ALIASES.get(fn.lower(), fn.lower())
    expr = F.count(F.lit(1)) if fn == "count" else SIMPLE[fn](F.col(col))
    return expr.alias(metric_name(col, fn))


def aggregate(
    df: DataFrame,
    groupby: Sequence[str],
    metrics: Sequence[Mapping[str, str]],
    approximate: bool = False,
) -> DataFrame:
    """``groupBy(groupby).agg(metrics)``; an empty ``groupby`` gives one row.

    p95 is the nearest-rank value and p50 the interpolated median, both exact. They come
    from bucket counts, for which no group has to fit anywhere, whatever its size.
    ``approximate=True`` uses a sketch instead.
    """
    if not metrics:
        raise ValueError("aggregate needs at least one metric")
    groupby = list(groupby)
    names = [metric_name(m["col"], m["fn"]) for m in metrics]
    fns = [ALIASES.get(m["fn"].lower(), m["fn"].lower()) for m in metrics]
    exact = not approximate and any(fn in QUANTILES for fn in fns)
    if exact:
        # What is read twice may be checkpointed, so only the columns in use go along.
        used = {*groupby, *(m["col"] for m in metrics)}
        df = read_twice(df.select(*[c for c in df.columns if c in used]))
    exprs, wanted = [], {}
    for metric, name, fn in zip(metrics, names, fns):
        if fn not in QUANTILES:
            exprs.append(_simple(metric["col"], fn))
        elif approximate:
            q = 0.5 if fn == "p50" else QUANTILES[fn]
            exprs.append(F.percentile_approx(metric["col"], q, 10000).alias(name))
        else:
            wanted.setdefault(metric["col"], {})[name] = QUANTILES[fn]

    if wanted and not exprs:
        exprs.append(F.count(F.lit(1)).alias("__rows"))
    result = df.groupBy(*groupby).agg(*exprs)
    for col, quantiles in wanted.items():
        result = left_join_on_keys(result, group_quantiles(df, groupby, col, quantiles), groupby)
    return result.select(*groupby, *dict.fromkeys(names))


def aggregate_one(
    df: DataFrame, group: Sequence[str], col: str = "scheduled_quantity", fn: str = "sum"
) -> DataFrame:
    """Single-metric form."""
    return aggregate(df, group, [{"col": col, "fn": fn}])


def distinct_rows(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.select(*columns).distinct()


def value_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows per (column, value); values as strings, null kept as a value."""
    return (
        df.select(*[F.col(c).cast("string").alias(c) for c in columns])
        .unpivot([], list(columns), "column_name", "value")
        .groupBy("column_name", "value")
        .agg(F.count(F.lit(1)).alias("count"))
    )


def most_common(df: DataFrame, columns: Sequence[str], top: int = 3) -> DataFrame:
    """The most frequent values of each column, ties by value.

    The ``rank <= top`` filter lets Spark cut every map-side partition to ``top`` rows
    per column before the shuffle.
    """
    order = Window.partitionBy("column_name").orderBy(
        F.desc("count"), F.col("value").asc_nulls_last()
    )
    return (
        value_counts(df, columns)
        .withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= top)
    )


def frequency(df: DataFrame, key: Column, name: str) -> DataFrame:
    """Row count by a derived key."""
    return df.groupBy(key.alias(name)).agg(F.count(F.lit(1)).alias("count"))


def correlation_pairs(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Pearson correlation of every column pair as (col_a, col_b, correlation), one scan."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    if not pairs:
        raise ValueError("correlation needs two columns or more")
    one_row = df.agg(*[F.corr(a, b).alias(f"{a}|{b}") for a, b in pairs])
    entries = F.array(
        *[
            F.struct(
                F.lit(a).alias("col_a"),
                F.lit(b).alias("col_b"),
                F.col(f"`{a}|{b}`").alias("correlation"),
            )
            for a, b in pairs
        ]
    )
    return one_row.select(F.inline(entries))
