"""Ranks, sorts, limits, samples and row-relative columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weir.functions.order import slot_offsets, sorted_slots, with_row_position
from weir.operators.aggregate import aggregate, metric_name
from weir.session import read_twice, work_dir

RANK_METHODS = ("average", "min", "max", "dense", "first")
STEP_METHODS = ("ordinal", "dense", "min", "max")


def _directed(column: str, descending: bool) -> Column:
    c = F.col(column)
    return c.desc_nulls_last() if descending else c.asc_nulls_last()


def _total_order(df: DataFrame, by: Sequence[str], descending: bool) -> list[Column]:
    """The columns in rank order, then all others ascending so that ties are settled."""
    rest = [c for c in df.columns if c not in by]
    return [_directed(c, descending) for c in by] + [F.col(c).asc_nulls_last() for c in rest]


def rank_table(df: DataFrame, column: str, descending: bool = False) -> DataFrame:
    """(value, below, ties, dense) for every distinct non-null value.

    ``below`` counts the rows that rank ahead of the value. Equal values are merged first and
    the different ones range-sorted; every sorted partition is numbered by itself.
    """
    values = (
        df.where(F.col(column).isNotNull())
        .groupBy(F.col(column).alias("__value"))
        .agg(F.count(F.lit(1)).alias("__ties"))
    )
    placed = sorted_slots(values, [_directed("__value", descending)])
    offsets = slot_offsets(placed, __rows=F.sum("__ties"), __values=F.count(F.lit(1)))
    in_slot = Window.partitionBy("__slot").orderBy("__index")
    ahead = F.sum("__ties").over(in_slot.rowsBetween(Window.unboundedPreceding, -1))
    return (
        placed.withColumn("__ahead", F.coalesce(ahead, F.lit(0)))
        .join(offsets, "__slot")
        .select(
            "__value",
            "__ties",
            (F.col("__rows") + F.col("__ahead")).alias("__below"),
            (F.col("__values") + F.col("__index") + 1).alias("__dense"),
        )
    )


def _rank_value(method: str) -> Column:
    below, ties = F.col("__below"), F.col("__ties")
    return {
        "average": below + 1 + (ties - 1) / F.lit(2.0),
        "min": below + 1,
        "max": below + ties,
        "dense": F.col("__dense"),
    }[method]


def with_rank(
    df: DataFrame, column: str, method: str, descending: bool, name: str
) -> DataFrame:
    """Add one rank column; null values get a null rank.

    Rows without a value do not join, so they do not meet in one task.
    """
    if method in ("first", "ordinal"):
        placed = with_row_position(df, _total_order(df, [column], descending), "__p")
        rank = F.when(F.col(column).isNotNull(), F.col("__p") + 1)
        return placed.withColumn(name, rank).drop("__p")
    df = read_twice(df)
    ranked = (
        df.where(F.col(column).isNotNull())
        .join(rank_table(df, column, descending), F.col(column) == F.col("__value"))
        .withColumn(name, _rank_value(method))
        .drop("__value", "__ties", "__below", "__dense")
    )
    kind = dict(ranked.dtypes)[name]
    unranked = df.where(F.col(column).isNull()).withColumn(name, F.lit(None).cast(kind))
    return ranked.unionByName(unranked)


def rank_columns(
    df: DataFrame, by: Sequence[str], method: str = "average", descending: bool = False
) -> DataFrame:
    """Add ``rank_<col>`` for each column and sort by the columns."""
    if not by:
        raise ValueError("rank needs at least one column")
    if method not in RANK_METHODS:
        raise ValueError(f"unsupported rank method {method!r}; choose from {RANK_METHODS}")
    result = read_twice(df)
    for column in by:
        result = with_rank(result, column, method, descending, f"rank_{column}")
    return result.orderBy(*_total_order(df, by, descending))


def rank_order(df: DataFrame, by: str | Sequence[str], descending: bool) -> list[Column]:
    """The order in which :func:`rank_columns` leaves the rows of ``df``."""
    by = [by] if isinstance(by, str) else list(by)
    return _total_order(df, by, descending)


def rank_step_order(df: DataFrame) -> list[Column]:
    """The order in which :func:`rank_step` leaves the rows of ``df``."""
    return [F.col("rank").asc_nulls_last(), *[F.col(c).asc_nulls_last() for c in df.columns]]


def rank_step(
    df: DataFrame,
    by: str | Sequence[str],
    descending: bool = True,
    method: str = "ordinal",
) -> DataFrame:
    """Add one ``rank`` column and sort by it.

    Ordinal numbers the rows over all ``by`` columns; the other methods rank the first.
    """
    by = [by] if isinstance(by, str) else list(by)
    if not by:
        raise ValueError("rank needs at least one column")
    if method not in STEP_METHODS:
        raise ValueError(f"unsupported rank method {method!r}; choose from {STEP_METHODS}")
    if method == "ordinal":
        placed = with_row_position(df, _total_order(df, by, descending), "__p")
        ranked = placed.withColumn("rank", F.col("__p") + 1).drop("__p")
    else:
        ranked = with_rank(df, by[0], method, descending, "rank")
    return ranked.orderBy(*rank_step_order(df))


def sort_rows(
    df: DataFrame,
    by: Sequence[str],
    descending: bool = False,
    limit: int | None = None,
    settle_ties: bool = True,
) -> DataFrame:
    """Sort by several columns in one direction; with a limit Spark keeps a running top-n."""
    order = (
        _total_order(df, by, descending)
        if settle_ties
        else [_directed(c, descending) for c in by]
    )
    ordered = df.orderBy(*order)
    return ordered.limit(limit) if limit is not None else ordered


def check_limit(n: int, offset: int = 0) -> None:
    if not isinstance(n, int) or n < 1:
        raise ValueError("limit needs a positive n")
    if not isinstance(offset, int) or offset < 0:
        raise ValueError("limit needs an offset of 0 or more")


def limit_rows(
    df: DataFrame, n: int, offset: int = 0, order: Sequence[Column | str] | None = None
) -> DataFrame:
    """Rows offset .. offset + n; pass ``order`` (or a sorted frame) to fix which rows."""
    check_limit(n, offset)
    if order:
        df = df.orderBy(*order)
    if offset:
        df = df.offset(offset)
    return df.limit(n)


def top_k(
    df: DataFrame,
    groupby: Sequence[str],
    col: str = "scheduled_quantity",
    fn: str = "sum",
    k: int = 10,
    descending: bool = True,
) -> DataFrame:
    """Aggregate, add the average rank of the metric, keep the first k groups.

    The first k groups and those tied with the last of them are enough to rank the k: a top-n
    finds the k-th value, a filter the groups up to it. Nulls rank last and have no rank.
    """
    check_limit(k)
    name = metric_name(col, fn)
    totals = read_twice(aggregate(df, groupby, [{"col": col, "fn": fn}]))
    value = F.col(name)
    order = _total_order(totals, [name], descending)
    # A handful of rows whatever the number of groups.
    first = totals.orderBy(*order).limit(k).select(value.alias("__value"))
    ends = first.agg((F.min if descending else F.max)("__value").alias("__last"))
    beyond = value >= F.col("__last") if descending else value <= F.col("__last")
    ties = (
        totals.join(F.broadcast(ends), F.coalesce(beyond, F.lit(False)))
        .groupBy(value.alias("__value"))
        .agg(F.count(F.lit(1)).alias("__ties"))
    )
    # One row per distinct value among the first k groups: k at most.
    window = Window.orderBy(_directed("__value", descending))
    ahead = F.sum("__ties").over(window.rowsBetween(Window.unboundedPreceding, -1))
    ranks = F.broadcast(ties.withColumn("__below", F.coalesce(ahead, F.lit(0))))
    return (
        totals.orderBy(*order)
        .limit(k)
        .join(ranks, value == F.col("__value"), "left")
        .withColumn(f"rank_{name}", _rank_value("average"))
        .drop("__value", "__ties", "__below")
        .orderBy(*order)
    )


def sample_rows(
    df: DataFrame,
    n: int = 100,
    method: str = "random",
    order: Sequence[str] | None = None,
    seed: int = 42,
) -> DataFrame:
    """n rows: random with a seed, or the first / last n of an order.

    The random sample takes the rows with the smallest digests of seed and row, so it is the
    same whatever the partitions are; equal rows come next to each other.
    """
    if n < 1:
        raise ValueError("a sample needs at least one row")
    if method == "random":
        # A null is marked, so that it differs from an empty text.
        texts = [F.coalesce(F.concat(F.lit("+"), F.col(f"`{c}`").cast("string")), F.lit("-")) for c in df.columns]
        digest = F.md5(F.concat_ws("|", F.lit(str(seed)), *texts))
        return df.withColumn("__r", digest).orderBy("__r").limit(n).drop("__r")
    order = list(order) if order else list(df.columns)
    if method == "head":
        return df.orderBy(*[F.col(c).asc_nulls_last() for c in order]).limit(n)
    if method == "tail":
        last = df.orderBy(*[F.col(c).desc_nulls_first() for c in order]).limit(n)
        return last.orderBy(*[F.col(c).asc_nulls_last() for c in order])
    return df


def with_difference(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], col: str, name: str
) -> DataFrame:
    """Change against the previous row of the same key; give one row per key and day."""
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(name, F.col(col) - F.lag(col).over(window))


def with_previous(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], col: str, name: str
) -> DataFrame:
    """Value of the previous row of the same key."""
    return df.withColumn(name, F.lag(col).over(Window.partitionBy(*keys).orderBy(*order)))


def with_trailing_mean(
    df: DataFrame, keys: Sequence[str], order: str, col: str, name: str, rows: int = 30
) -> DataFrame:
    """Mean of this row and the rows before it; null until ``rows`` rows are there."""
    window = Window.partitionBy(*keys).orderBy(order).rowsBetween(1 - rows, 0)
    mean = F.when(F.count(F.lit(1)).over(window) == rows, F.avg(col).over(window))
    return df.withColumn(name, mean)


def with_centred_mean(
    df: DataFrame, keys: Sequence[str], order: str, col: str, name: str, rows: int = 365
) -> DataFrame:
    """Mean of the rows around this one; the window shrinks at both ends."""
    half = rows // 2
    window = Window.partitionBy(*keys).orderBy(order).rowsBetween(-half, half)
    return df.withColumn(name, F.avg(col).over(window))


def overall(df: DataFrame, aggregate: Column) -> Column:
    """A global aggregate of the frame as one value that every row can use."""
    return df.agg(aggregate).scalar()


def with_share(df: DataFrame, col: str, name: str) -> DataFrame:
    """Share of the column total; null when the total is 0."""
    return df.withColumn(name, F.try_divide(F.col(col), overall(df, F.sum(col))))


def percentile_ranks(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Average rank / rows * 100 for each ``{column: output name}``."""
    result = read_twice(df)
    rows = overall(result, F.count(F.lit(1)))
    for column, name in columns.items():
        result = with_rank(result, column, "average", False, name)
        result = result.withColumn(name, F.col(name) / rows * 100)
    return result


def last_days(df: DataFrame, order: str, n: int) -> DataFrame:
    """The n rows with the greatest order value; give one row per day."""
    return df.orderBy(F.col(order).desc()).limit(n)
