"""Small column expressions shared by the operators."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed label values.
MONTH_NAMES = ["Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec"]
WEEKDAY_NAMES = ["Mon", "Tue", "Wed", "Thu", "Fri", "Sat", "Sun"]


def keep_present(df: DataFrame, wanted: Iterable[str]) -> list[str]:
    """The wanted columns that the frame has, in the wanted order."""
    return [c for c in wanted if c in df.columns]


def has_columns(df: DataFrame, *names: str) -> bool:
    return set(names) <= set(df.columns)


def iso_weekday(day: str | Column) -> Column:
    """1 = Monday ... 7 = Sunday."""
    return F.weekday(day) + F.lit(1)


def is_weekend(day: str | Column) -> Column:
    return F.weekday(day) >= 5


def month_label(month: str | Column) -> Column:
    month = F.col(month) if isinstance(month, str) else month
    return F.element_at(F.array(*map(F.lit, MONTH_NAMES)), month)


def weekday_label(iso_day: str | Column) -> Column:
    iso_day = F.col(iso_day) if isinstance(iso_day, str) else iso_day
    return F.element_at(F.array(*map(F.lit, WEEKDAY_NAMES)), iso_day)


def receipt_quantity(sign: str = "rec_del_sign", quantity: str = "scheduled_quantity") -> Column:
    """Quantity on receipt rows, 0 elsewhere."""
    return F.when(F.col(sign) == 1, F.col(quantity)).otherwise(0.0)


def delivery_quantity(sign: str = "rec_del_sign", quantity: str = "scheduled_quantity") -> Column:
    """Quantity on delivery rows, 0 elsewhere."""
    return F.when(F.col(sign) == -1, F.col(quantity)).otherwise(0.0)


def signed_quantity(sign: str = "rec_del_sign", quantity: str = "scheduled_quantity") -> Column:
    """Receipts count up, deliveries count down."""
    return F.col(sign) * F.col(quantity)


def at_least_one(c: Column) -> Column:
    """max(c, 1), null when c is null (``greatest`` alone would turn null into 1)."""
    return F.when(c.isNotNull(), F.greatest(c.cast("double"), F.lit(1.0)))


def signed_imbalance_pct(receipts: str = "receipts", deliveries: str = "deliveries") -> Column:
    """(receipts - deliveries) / receipts * 100; 0 on days without receipts."""
    gap = F.col(receipts) - F.col(deliveries)
    return F.when(F.col(receipts) > 0, F.try_divide(gap, F.col(receipts)) * 100).otherwise(0.0)


def total(c: Column) -> Column:
    """Sum that is 0 for a group without values."""
    return F.coalesce(F.sum(c), F.lit(0.0))


def distinct_with_null(c: str) -> Column:
    """Distinct count in which null is a value of its own."""
    return F.count_distinct(F.col(c)) + F.coalesce(
        F.max(F.col(c).isNull().cast("bigint")), F.lit(0).cast("bigint")
    )


def distinct_of_list(c: str) -> Column:
    """As :func:`distinct_with_null`, for groups of one row per day: no second shuffle."""
    return F.size(F.collect_set(c)).cast("bigint") + F.max(F.col(c).isNull().cast("bigint"))
