"""Row predicates built from (column, operator, value) triples."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from datetime import date, datetime
from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

FILTER_OPS = ("=", "!=", ">", ">=", "<", "<=", "in", "between", "is_not_null", "contains")


def as_date(value: Any) -> date | None:
    """The date behind a ``YYYY-MM-DD`` string, or None when it is something else."""
    if isinstance(value, datetime):
        return value.date()
    if isinstance(value, date):
        return value
    if not isinstance(value, str):
        return None
    try:
        return datetime.strptime(value, "%Y-%m-%d").date()
    except ValueError:
        return None


def check_filter(column: Any, op: str, value: Any) -> None:
    """Raise ValueError unless the value has the shape the operator needs."""
    if not isinstance(column, str) or not column:
        raise ValueError("a filter needs a column name")
    if op not in FILTER_OPS:
        raise ValueError(f"unknown filter operator {op!r}")
    if op == "is_not_null":
        if value is not None:
            raise ValueError("is_not_null takes no value")
    elif op == "in":
        if not isinstance(value, (list, tuple, set)):
            raise ValueError("in needs a list of values")
    elif op == "between":
        if not isinstance(value, (list, tuple)) or len(value) != 2:
            raise ValueError("between needs exactly two values")
    elif value is None:
        raise ValueError(f"{op} needs a value")


def predicate(column: str, op: str, value: Any = None) -> Column:
    """One condition on a raw column, so that parquet can evaluate it during the scan."""
    check_filter(column, op, value)
    c = F.col(column)
    if op == "=":
        return c == value
    if op == "!=":
        return c != value
    if op == "in":
        return c.isin(list(value))
    if op == "between":
        low, high = value
        if as_date(low) and as_date(high):
            # As text: against a date column Spark reads them as dates, while planning, and a
            # text column is compared as text instead of being cast row by row.
            low, high = F.lit(as_date(low).isoformat()), F.lit(as_date(high).isoformat())
        return c.between(low, high)
    if op == "is_not_null":
        return c.isNotNull()
    if op == "contains":
        return c.cast("string").rlike(str(value))
    return {">": c > value, ">=": c >= value, "<": c < value, "<=": c <= value}[op]


def all_of(filters: Iterable[Mapping[str, Any]]) -> Column:
    """Conjunction of many ``{"column", "op", "value"}`` entries; none means true."""
    parts = [predicate(f["column"], f["op"], f.get("value")) for f in filters]
    return reduce(lambda a, b: a & b, parts, F.lit(True))


def date_window(
    column: str = "eff_gas_day",
    since: Any = None,
    until: Any = None,
    year: int | None = None,
    after: Any = None,
    before: Any = None,
) -> Column:
    """Date range with any end left open; ``after``/``before`` exclude their day."""
    c = F.col(column)
    parts = []
    if year is not None:
        parts.append(c.between(F.lit(date(year, 1, 1)), F.lit(date(year, 12, 31))))
    bounds = [(since, c.__ge__), (until, c.__le__), (after, c.__gt__), (before, c.__lt__)]
    for bound, compare in bounds:
        if bound is None:
            continue
        day = as_date(bound)
        if day is None:
            raise ValueError(f"not a YYYY-MM-DD date: {bound!r}")
        parts.append(compare(F.lit(day)))
    return reduce(lambda a, b: a & b, parts, F.lit(True))


def name_contains(column: str, part: str) -> Column:
    """Case-insensitive substring test."""
    return F.lower(F.col(column)).contains(part.lower())
