"""Data dictionary, column profile and quality scores."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weir.functions.order import group_quantiles
from weir.operators.aggregate import most_common, value_counts
from weir.operators.ranking import sample_rows

# Bytes of the fixed-width types.
WIDTHS = {
    T.BooleanType: 1, T.ByteType: 1, T.ShortType: 2, T.IntegerType: 4, T.FloatType: 4,
    T.DateType: 4, T.LongType: 8, T.DoubleType: 8, T.TimestampType: 8, T.TimestampNTZType: 8,
}
EVIDENCE = ("basic", "nulls", "numeric", "strings")
QUALITY_METRICS = ("data_quality_score", "completeness", "uniqueness")


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def string_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def _null_total(c: str) -> Column:
    return F.count_if(F.col(c).isNull()).alias(f"__null_{c}")


def null_profile(df: DataFrame) -> DataFrame:
    """(column_name, data_type, null_count, null_pct, n_rows), one aggregation over one scan."""
    entries = [
        F.struct(
            F.lit(f.name).alias("column_name"),
            F.lit(f.dataType.simpleString()).alias("data_type"),
            F.col(f"__null_{f.name}").alias("null_count"),
        )
        for f in df.schema.fields
    ]
    pct = F.coalesce(F.try_divide(F.col("null_count"), F.col("n_rows")) * 100, F.lit(0.0))
    return (
        df.agg(F.count(F.lit(1)).alias("n_rows"), *[_null_total(c) for c in df.columns])
        .select("n_rows", F.inline(F.array(*entries)))
        .select("column_name", "data_type", "null_count", pct.alias("null_pct"), "n_rows")
    )


def data_dictionary(df: DataFrame) -> DataFrame:
    """(column_name, data_type, null_rate, n_rows); rates are 0 for an empty table."""
    rate = F.coalesce(F.try_divide(F.col("null_count"), F.col("n_rows")), F.lit(0.0))
    return null_profile(df).select("column_name", "data_type", rate.alias("null_rate"), "n_rows")


def row_width(schema: T.StructType) -> int:
    """Rough bytes of a row: the width of fixed types, 20 for each column of another type."""
    return sum(WIDTHS.get(type(f.dataType), 20) for f in schema.fields)


def table_shape(df: DataFrame) -> DataFrame:
    """(row_count, column_count, estimated_bytes); the bytes are rows times :func:`row_width`."""
    return df.agg(F.count(F.lit(1)).alias("row_count")).select(
        "row_count",
        F.lit(len(df.columns)).cast("bigint").alias("column_count"),
        (F.col("row_count") * row_width(df.schema)).alias("estimated_bytes"),
    )


def step_stats(df: DataFrame) -> DataFrame:
    """Row count, column count, estimated bytes and the null count of every column as one map."""
    nulls = F.create_map(*[x for c in df.columns for x in (F.lit(c), F.col(f"__null_{c}"))])
    width = F.lit(len(df.columns)).cast("bigint")
    return df.agg(
        F.count(F.lit(1)).alias("row_count"), *[_null_total(c) for c in df.columns]
    ).select(
        "row_count",
        width.alias("column_count"),
        (F.col("row_count") * row_width(df.schema)).alias("estimated_bytes"),
        nulls.alias("null_counts"),
    )


def _moments(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column_name, mean, std, min, max, count) of numeric columns from one aggregation."""
    names = ("mean", "std", "min", "max")
    functions = (F.avg, F.stddev_samp, F.min, F.max)
    exprs = []
    for c in columns:
        v = F.col(c).cast("double")
        exprs += [f(v).alias(f"{name}|{c}") for name, f in zip(names, functions)]
        exprs.append(F.count(v).alias(f"count|{c}"))
    entries = [
        F.struct(
            F.lit(c).alias("column_name"),
            *[F.col(f"`{name}|{c}`").alias(name) for name in (*names, "count")],
        )
        for c in columns
    ]
    return df.agg(*exprs).select(F.inline(F.array(*entries)))


def numeric_summary(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column_name, mean, std, min, max, count); an empty column gives 0.0 and count 0."""
    return _moments(df, columns).fillna(0.0, ["mean", "std", "min", "max"])


def distinct_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column_name, unique_count), null counted as a value.

    Equal values merge before they are counted, spread over (column, value).
    """
    return (
        value_counts(df, columns)
        .groupBy("column_name")
        .agg(F.count(F.lit(1)).alias("unique_count"))
    )


def numeric_profile(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Mean, std, min, max, median, nearest quartiles and distinct count per numeric column."""
    columns = list(columns) if columns else numeric_columns(df)
    long = df.select(*[F.col(c).cast("double").alias(c) for c in columns]).unpivot(
        [], columns, "column_name", "value"
    )
    quantiles = group_quantiles(
        long, ["column_name"], "value", {"median": "median", "q25": 0.25, "q75": 0.75}
    )
    # A double tells all values of the narrower types apart; wider ones compare as text.
    narrow = (T.ByteType, T.ShortType, T.IntegerType, T.FloatType, T.DoubleType)
    if all(isinstance(df.schema[c].dataType, narrow) for c in columns):
        values = long.groupBy("column_name", "value").agg(F.lit(1))
        unique = values.groupBy("column_name").agg(F.count(F.lit(1)).alias("unique_count"))
    else:
        unique = distinct_counts(df, columns)
    return (
        _moments(df, columns)
        .drop("count")
        .join(quantiles, "column_name", "left")
        .join(unique, "column_name", "left")
    )


def string_profile(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Distinct count, mean length and the three most common values per string column."""
    columns = list(columns) if columns else string_columns(df)
    counts = value_counts(df, columns)
    n, length = F.col("count"), F.char_length("value")
    present = F.col("value").isNotNull()
    stats = counts.groupBy("column_name").agg(
        F.count(F.lit(1)).alias("unique_count"),
        F.try_divide(F.sum(length * n), F.sum(F.when(present, n))).alias("avg_length"),
    )
    # Three entries per column at most.
    top = (
        most_common(df, columns)
        .groupBy("column_name")
        .agg(F.sort_array(F.collect_list(F.struct("rank", "value", "count"))).alias("most_common"))
    )
    return stats.join(top, "column_name", "left")


def quality_scores(df: DataFrame, metrics: Sequence[str] = QUALITY_METRICS) -> DataFrame:
    """(metric, value, message): requested scores; an unknown name gives a message."""
    per_column = null_profile(df)
    if "uniqueness" in metrics:
        per_column = per_column.join(distinct_counts(df, df.columns), "column_name", "left")
    else:
        per_column = per_column.withColumn("unique_count", F.lit(0))
    ratio = F.coalesce(F.try_divide(F.col("unique_count"), F.col("n_rows")), F.lit(0.0))
    cells, nulls = F.sum("n_rows"), F.sum("null_count")
    one_row = per_column.agg(
        F.greatest(F.lit(0.0), 100 - F.avg("null_pct")).alias("data_quality_score"),
        F.coalesce(F.try_divide(cells - nulls, cells) * 100, F.lit(0.0)).alias("completeness"),
        (F.avg(ratio) * 100).alias("uniqueness"),
    )
    entries = [
        F.struct(
            F.lit(m).alias("metric"),
            (F.col(m) if m in QUALITY_METRICS else F.lit(None).cast("double")).alias("value"),
            F.lit(None if m in QUALITY_METRICS else f"Unknown metric: {m}")
            .cast("string")
            .alias("message"),
        )
        for m in metrics
    ]
    return one_row.select(F.inline(F.array(*entries)))


def profile(
    df: DataFrame,
    metrics: Sequence[str] = (),
    sample_size: int = 5,
    sample_order: Sequence[str] | None = None,
) -> dict[str, DataFrame]:
    """All parts of a table profile, each a DataFrame that runs only when it is used."""
    parts = {"basic": table_shape(df), "nulls": null_profile(df)}
    if numeric_columns(df):
        parts["numeric"] = numeric_profile(df)
    if string_columns(df):
        parts["strings"] = string_profile(df)
    if sample_size > 0:
        parts["sample"] = sample_rows(df, sample_size, "head", sample_order)
    if metrics:
        parts["scores"] = quality_scores(df, metrics)
    return parts


def evidence(df: DataFrame, parts: Sequence[str]) -> DataFrame:
    """(part, column_name, name, value): the wanted parts of a profile as one table of numbers.

    A part without a fitting column gives no rows. The column name is null for ``basic``.
    """
    found = []
    for part in dict.fromkeys(parts):
        if part == "basic":
            table = table_shape(df).withColumn("column_name", F.lit(None).cast("string"))
        elif part == "nulls":
            table = null_profile(df).drop("data_type", "n_rows")
        elif part == "numeric" and numeric_columns(df):
            table = numeric_profile(df)
        elif part == "strings" and string_columns(df):
            table = string_profile(df).drop("most_common")
        else:
            continue
        names = [c for c in table.columns if c != "column_name"]
        table = table.select("column_name", *[F.col(c).cast("double").alias(c) for c in names])
        long = table.unpivot(["column_name"], names, "name", "value")
        found.append(long.select(F.lit(part).alias("part"), "column_name", "name", "value"))
    if not found:
        schema = "part string, column_name string, name string, value double"
        return df.sparkSession.createDataFrame([], schema)
    return reduce(DataFrame.unionByName, found)
