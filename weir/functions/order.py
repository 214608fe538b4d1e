"""Order statistics, ranks and neighbours that survive one huge group.

A plain window or ``percentile`` sends a whole group to one task. Two other ways are used:

* Quantiles: every value falls into an *order bucket*, a number that never decreases when
  the value grows. Counts per (group, bucket) shrink on the map side to a bounded table; a
  running sum over it tells which bucket holds a wanted position, and only the rows of
  that bucket are looked at again.
* Ranks and neighbours: one range sort spreads the rows evenly, each sorted partition is
  worked on alone, and one summary row per partition carries sums or last rows onward.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weir.session import read_twice, written

LARGEST_DOUBLE = 1.7976931348623157e308
# Bucket widths, each 4096 times finer than the one before. A double has 52 bits after its
# leading one, so a bucket of the finest width holds at most 2 ** 16 different values.
STEPS_PER_OCTAVE = (1 << 12, 1 << 24, 1 << 36)
# A bucket with more rows than this, and with different values, is split by finer buckets.
ROWS_PER_BUCKET = 1_000_000
# A table is broadcast when its counted rows and texts take no more than this.
BROADCAST_BYTES = 32 << 20
# Memory of one broadcast row beside its texts.
ROW_BYTES = 128


def order_bucket(column: str, steps_per_octave: int = STEPS_PER_OCTAVE[0]) -> Column:
    """Monotone bucket number of a numeric column; null stays null.

    Magnitudes are split at powers of two and every octave into equal steps, so the
    number of buckets does not depend on the number of rows.
    """
    x = f"cast(`{column}` as double)"
    size = f"least(abs({x}), {LARGEST_DOUBLE}D)"
    octave = f"floor(log2({size}))"
    step = f"floor(({size} / pow(2.0D, {octave}) - 1) * {steps_per_octave}L)"
    number = f"(({octave} + 1100) * {steps_per_octave}L + {step})"
    return F.expr(
        f"case when {x} is null then null when {x} = 0 then 0L when {x} > 0 then {number} else -{number} end"
    )


def nearest_index(n: Column, q: float) -> Column:
    """Zero-based position of the nearest-rank quantile among n sorted values."""
    return F.floor((n - 1) * F.lit(float(q)) + F.lit(0.5))


def nearest_of_list(c: Column, q: float) -> Column:
    """Nearest-rank quantile for groups bounded by the calendar (one value per day)."""
    values = F.sort_array(F.collect_list(c))
    n = F.count(c)
    return F.when(n > 0, F.try_element_at(values, (nearest_index(n, q) + 1).cast("int")))


def median_of_list(c: Column) -> Column:
    """Mean of the two middle values, for groups known to be small."""
    values = F.sort_array(F.collect_list(c))
    n = F.count(c)
    low = F.try_element_at(values, (F.floor((n - 1) / 2) + 1).cast("int"))
    high = F.try_element_at(values, (F.floor(n / 2) + 1).cast("int"))
    return F.when(n > 0, low + (high - low) / 2)


def median_parts(c: Column) -> dict[str, Column]:
    """Aggregates that tell the sign of a median; parts of a group merge by sum, max and min."""
    return {
        "n": F.count(c),
        "low": F.count_if(c <= 0),
        "below": F.max(F.when(c <= 0, c)),
        "above": F.min(F.when(c > 0, c)),
    }


def positive_by_parts(n: Column, low: Column, below: Column, above: Column) -> Column:
    """Whether the interpolated median is above zero, by the aggregates of `median_parts`."""
    return (
        F.when(n == 0, False)
        .when(low <= F.floor((n - 1) / 2), True)
        .when(low > F.floor(n / 2), False)
        .otherwise(below + above > 0)
    )


def median_is_positive(c: Column) -> Column:
    """Whether the interpolated median of a group is above zero, as one plain aggregate.

    The two middle values decide by their sum. Counting the values at or below zero tells
    on which side each of them lies; only when the middle falls between the two sides do
    the largest value below and the smallest above matter.
    """
    return positive_by_parts(**median_parts(c))


def broadcast_size(texts: Sequence[str]) -> Column:
    """Bytes that the rows of a table take when broadcast, with their texts, as an aggregate."""
    lengths = [F.coalesce(F.octet_length(F.col(c).cast("string")), F.lit(0)) for c in texts]
    return F.coalesce(F.sum(reduce(lambda a, b: a + b, lengths, F.lit(ROW_BYTES))), F.lit(0))


def left_join_on_keys(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Left join on null-safe keys; the right side adds only its other columns."""
    renamed = right.withColumnsRenamed({k: f"__r_{k}" for k in keys})
    on = reduce(
        lambda a, b: a & b,
        [F.col(k).eqNullSafe(F.col(f"__r_{k}")) for k in keys],
        F.lit(True),
    )
    return left.join(renamed, on, "left").drop(*[f"__r_{k}" for k in keys])


def group_quantiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    wanted: Mapping[str, float | str],
    weight: str | None = None,
    rows_per_bucket: int = ROWS_PER_BUCKET,
    broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """Exact quantiles of ``value`` per group, one row per group with a non-null value.

    ``wanted`` maps an output name to a fraction (nearest rank) or to ``"median"`` (mean of
    the two middle values); ``weight`` names a column of repeat counts. Groups may have any
    size: no task holds one.

    The first pass runs at once. It shuffles bucket counts only and leaves at most two
    buckets per group and quantile. Buckets that still hold too many different values are
    split by another such pass with finer buckets. The last pass, which is lazy, shuffles
    only the rows of the buckets that are left.

    The bucket table is broadcast when its counted size is ``broadcast_bytes`` or less: Spark
    would pick the join before it knows this size, and would shuffle every row of the table.
    Above that it is a shuffle join, in which adaptive execution splits hot partitions.
    """
    keys = list(keys)
    amount = F.col(weight).cast("bigint") if weight else F.lit(1).cast("bigint")
    rows = df.where(F.col(value).isNotNull()).select(
        *keys, F.col(value).alias("__v"), amount.alias("__w")
    )
    if weight:
        rows = rows.where(F.col("__w") > 0)
    rows = read_twice(rows)
    n = F.col("__n")
    positions: dict[str, Column] = {}
    for name, q in wanted.items():
        if q == "median":
            positions[f"__lo_{name}"] = F.floor((n - 1) / 2)
            positions[f"__hi_{name}"] = F.ceil((n - 1) / 2)
        else:
            positions[f"__at_{name}"] = nearest_index(n, q)

    def holds(start: Column, count: Column) -> Column:
        tests = [(p >= start) & (p < start + count) for p in positions.values()]
        return reduce(lambda a, b: a | b, tests)

    needed: DataFrame | None = None
    for level, steps in enumerate(STEPS_PER_OCTAVE):
        finer = rows.withColumn("__b", order_bucket("__v", steps))
        if needed is None:
            inside, base = keys, F.lit(0)
            source = finer
        else:
            inside, base = [*keys, "__p"], F.col("__before")
            source = _rows_of_buckets(finer, needed, keys, STEPS_PER_OCTAVE[level - 1])
        carried = [] if needed is None else ["__p", "__before", "__n"]
        running = Window.partitionBy(*inside).orderBy("__b")
        ahead = F.sum("__in").over(running.rowsBetween(Window.unboundedPreceding, -1))
        counts = (
            source.groupBy(*keys, *carried, "__b")
            .agg(
                F.sum("__w").alias("__in"),
                (F.min("__v") < F.max("__v")).alias("__mixed"),
            )
            .withColumn("__start", base + F.coalesce(ahead, F.lit(0)))
        )
        if needed is None:
            counts = counts.withColumn("__n", F.sum("__in").over(Window.partitionBy(*keys)))
        found = written(
            counts.where(holds(F.col("__start"), F.col("__in"))).select(
                *[F.col(k).alias(f"__r_{k}") for k in keys],
                F.col("__b").alias("__p"),
                F.col("__start").alias("__before"),
                "__n",
                "__in",
                "__mixed",
            ),
            "buckets",
        )
        most = F.max(F.when(F.col("__mixed"), F.col("__in")))
        size, most = found.agg(
            broadcast_size([f"__r_{k}" for k in keys]), F.coalesce(most, F.lit(0))
        ).first()
        needed = found.drop("__in", "__mixed")
        if size <= broadcast_bytes:
            needed = F.broadcast(needed)
        if most <= rows_per_bucket:
            break

    within = Window.partitionBy(*keys, "__p").orderBy("__v")
    through = F.sum("__c").over(within.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    picked = (
        _rows_of_buckets(rows, needed, keys, steps)
        .groupBy(*keys, "__p", "__before", "__n", "__v")
        .agg(F.sum("__w").alias("__c"))
        .withColumn("__end", F.col("__before") + through)
    )
    start, end = F.col("__end") - F.col("__c"), F.col("__end")
    hits = [
        F.max(F.when((p >= start) & (p < end), F.col("__v"))).alias(name)
        for name, p in positions.items()
    ]
    final = []
    for name, q in wanted.items():
        if q == "median":
            low, high = F.col(f"__lo_{name}"), F.col(f"__hi_{name}")
            final.append((low + (high - low) / 2).alias(name))
        else:
            final.append(F.col(f"__at_{name}").alias(name))
    return picked.groupBy(*keys).agg(*hits).select(*keys, *final)


def _rows_of_buckets(
    rows: DataFrame, needed: DataFrame, keys: Sequence[str], steps: int
) -> DataFrame:
    """The rows that lie in a needed bucket of the given width, with the bucket's counts."""
    same = [F.col(k).eqNullSafe(F.col(f"__r_{k}")) for k in keys]
    same.append(F.col("__at") == F.col("__p"))
    return (
        rows.withColumn("__at", order_bucket("__v", steps))
        .join(needed, reduce(lambda a, b: a & b, same))
        .drop("__at", *[f"__r_{k}" for k in keys])
    )


def sorted_slots(df: DataFrame, order: Sequence[Column | str]) -> DataFrame:
    """Range-sort the rows and tell each its sorted partition and its place in there.

    Adds ``__slot`` and ``__index``; rows of a lower slot come before those of a higher one.
    The result is written, so that a lost executor cannot shift a partition boundary
    between two readings. The sort samples the data: partitions are even whatever the keys.
    """
    number = F.monotonically_increasing_id()
    return written(
        df.orderBy(*order)
        .withColumn("__id", number)
        .withColumn("__slot", F.shiftright("__id", 33))
        .withColumn("__index", F.col("__id").bitwiseAND(F.lit((1 << 33) - 1)))
        .drop("__id"),
        "sorted",
    )


def slot_offsets(placed: DataFrame, **totals: Column) -> DataFrame:
    """For every slot the sums over all slots before it.

    One row per sort partition, so its size is set by the session and not by the data.
    """
    earlier = Window.orderBy("__slot").rowsBetween(Window.unboundedPreceding, -1)
    per_slot = placed.groupBy("__slot").agg(*[c.alias(name) for name, c in totals.items()])
    return F.broadcast(
        per_slot.select(
            "__slot",
            *[F.coalesce(F.sum(name).over(earlier), F.lit(0)).alias(name) for name in totals],
        )
    )


def with_row_position(
    df: DataFrame, order: Sequence[Column | str], name: str = "position"
) -> DataFrame:
    """Number the rows 0, 1, 2, ... in the given order without a one-task window."""
    placed = sorted_slots(df, order)
    return (
        placed.join(slot_offsets(placed, __offset=F.count(F.lit(1))), "__slot")
        .withColumn(name, F.col("__offset") + F.col("__index"))
        .drop("__slot", "__offset", "__index")
    )


def with_previous_row(
    df: DataFrame, order: Sequence[str], columns: Sequence[str], name: str = "previous"
) -> DataFrame:
    """Put the given columns of the row before (in the global order) next to every row.

    Inside a sorted partition this is a lag; the first row of a partition takes the last
    row of the partition before it.
    """
    placed = sorted_slots(df, order).withColumn("__row", F.struct(*columns))
    in_slot = Window.partitionBy("__slot").orderBy("__index")
    last_rows = placed.groupBy("__slot").agg(F.max_by("__row", "__index").alias("__row"))
    before = last_rows.select(
        "__slot", F.lag("__row").over(Window.orderBy("__slot")).alias("__carried")
    )
    previous = F.coalesce(F.lag("__row").over(in_slot), F.col("__carried"))
    return (
        placed.join(F.broadcast(before), "__slot")
        .withColumn(name, previous)
        .drop("__slot", "__index", "__row", "__carried")
    )
