"""Ready-made questions as functions of a flow table."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weir.functions.predicates import date_window
from weir.operators.aggregate import aggregate, metric_name
from weir.operators.basic import filter_rows, pipelines_like
from weir.operators.changepoint import (
    detect_changepoints,
    event_card,
    sensitive_changepoints,
)
from weir.operators.cluster import cluster_summary
from weir.operators.decompose import deseasonalize
from weir.operators.metrics import (
    monthly_seasonality,
    pipeline_summary,
    ramp_risk,
    reversal_freq,
    signed_imbalance_summary,
)
from weir.operators.ranking import rank_columns, sort_rows, top_k
from weir.sources.sinks import materialize

QUANTITY = "scheduled_quantity"
DELIVERY, RECEIPT = -1, 1


def _sum(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return aggregate(df, by, [{"col": QUANTITY, "fn": "sum"}])


def _in_range(df: DataFrame, date_range: Sequence[str] | None) -> DataFrame:
    return df.where(date_window(since=date_range[0], until=date_range[1])) if date_range else df


def _of(df: DataFrame, pipeline: str, sign: int | None = None) -> DataFrame:
    df = df.where(F.col("pipeline_name") == pipeline)
    return df.where(F.col("rec_del_sign") == sign) if sign is not None else df


def deliveries_on(df: DataFrame, pipeline: str, day: str) -> DataFrame:
    """Total deliveries of a pipeline on one day."""
    return _sum(_in_range(_of(df, pipeline, DELIVERY), (day, day)))


def top_states(df: DataFrame, n: int, year: int | None = None) -> DataFrame:
    """States by total quantity, in one year or over all time."""
    rows = df.where(date_window(year=year)) if year else df
    return sort_rows(_sum(rows, ["state_abb"]), [f"sum_{QUANTITY}"], descending=True, limit=n)


def daily_deliveries(df: DataFrame, pipeline: str, start: str, end: str) -> DataFrame:
    rows = _in_range(_of(df, pipeline, DELIVERY), (start, end))
    return _sum(rows, ["eff_gas_day"]).orderBy("eff_gas_day")


def total_receipts(df: DataFrame, pipeline: str) -> DataFrame:
    return _sum(_of(df, pipeline, RECEIPT))


def total_scheduled(df: DataFrame, pipeline: str) -> DataFrame:
    return _sum(_of(df, pipeline))


def average_by_state(df: DataFrame, limit: int | None = None) -> DataFrame:
    means = aggregate(df, ["state_abb"], [{"col": QUANTITY, "fn": "avg"}])
    return sort_rows(means, [f"avg_{QUANTITY}"], descending=True, limit=limit)


def pipeline_changepoints(
    df: DataFrame, pipeline: str, min_confidence: float = 0.7
) -> DataFrame:
    """Changepoints of one pipeline as a single series."""
    return detect_changepoints(_of(df, pipeline), None, min_confidence=min_confidence)


def all_pipeline_changepoints(df: DataFrame, min_confidence: float = 0.7) -> DataFrame:
    return detect_changepoints(df, ["pipeline_name"], min_confidence=min_confidence)


def clusters_of(df: DataFrame, entity_type: str = "loc", k: int = 6) -> DataFrame:
    return cluster_summary(df, entity_type, k, 42)


def simple_aggregation(
    df: DataFrame,
    groupby: Sequence[str] = ("pipeline_name",),
    col: str = QUANTITY,
    fn: str = "sum",
    limit: int = 100,
) -> DataFrame:
    """Aggregate and keep the first ``limit`` groups in key order."""
    return aggregate(df, groupby, [{"col": col, "fn": fn}]).orderBy(*groupby).limit(limit)


def regime_shifts(
    df: DataFrame,
    date_range: Sequence[str] | None = ("2022-01-01", "2022-12-31"),
    groupby: Sequence[str] = ("pipeline_name",),
    value: str = QUANTITY,
    limit: int = 10,
) -> DataFrame:
    """Largest changepoints of the deseasonalised daily totals of each group."""
    groupby = list(groupby)
    name = metric_name(value, "sum")
    daily = aggregate(
        _in_range(df, date_range), [*groupby, "eff_gas_day"], [{"col": value, "fn": "sum"}]
    )
    parts = deseasonalize(daily, name, series=groupby)
    found = detect_changepoints(
        parts, groupby, "deseasonalized", min_size=7, penalty=1.0, min_confidence=0.1
    )
    return rank_columns(found, ["change_magnitude"], descending=True).limit(limit)


def top_variability(
    df: DataFrame, groupby: Sequence[str] = ("pipeline_name",), k: int = 10
) -> DataFrame:
    """Groups by the spread of their rows."""
    return top_k(df, groupby, QUANTITY, "std", k)


def sum_by_group(
    df: DataFrame, group: Sequence[str], date_range: Sequence[str] | None = None, top: int = 10
) -> DataFrame:
    return top_k(_in_range(df, date_range), group, QUANTITY, "sum", top)


def count_by_group(
    df: DataFrame, group: Sequence[str], date_range: Sequence[str] | None = None, top: int = 10
) -> DataFrame:
    return top_k(_in_range(df, date_range), group, QUANTITY, "count", top)


def daily_totals(
    df: DataFrame, group: Sequence[str], date_range: Sequence[str] | None = None
) -> DataFrame:
    return _sum(_in_range(df, date_range), [*group, "eff_gas_day"])


def change_events(
    df: DataFrame,
    pipeline: str | None = None,
    since: str | None = None,
    top: int = 10,
    min_confidence: float = 0.7,
) -> DataFrame:
    """Most confident changepoints since a day, each with its top contributors."""
    rows = df.where(date_window(since=since)) if since else df
    if pipeline:
        rows = _of(rows, pipeline)
    groups = None if pipeline else ["pipeline_name"]
    found = detect_changepoints(rows, groups, min_confidence=min_confidence)
    best = sort_rows(found, ["confidence"], descending=True, limit=top)
    return event_card(best, df)


ANALYSES = {
    "summary": pipeline_summary,
    "changepoint": sensitive_changepoints,
    "cluster": clusters_of,
    "ramp_risk": ramp_risk,
    "reversal_freq": reversal_freq,
    "imbalance_pct": signed_imbalance_summary,
    "seasonality": monthly_seasonality,
}


def multi_analysis(
    df: DataFrame,
    names: Sequence[str],
    filters: Sequence[Mapping[str, Any]] = (),
    pipeline_part: str | None = None,
    keep_input: bool = False,
) -> tuple[dict[str, DataFrame], dict[str, str]]:
    """Run several analyses on one filtered table: (results by name, errors by name).

    Every analysis reads the columns it needs through the same pushed-down filters. Set
    ``keep_input`` when the input is costly to make again: it is then written once to the
    work folder and read from there.
    """
    rows = filter_rows(df, filters)
    if pipeline_part:
        rows = pipelines_like(rows, pipeline_part)
    if keep_input:
        rows = materialize(rows)
    results, errors = {}, {}
    for name in names:
        try:
            if name not in ANALYSES:
                raise ValueError(f"unknown analysis {name!r}; choose from {sorted(ANALYSES)}")
            results[name] = ANALYSES[name](rows)
        except Exception as error:  # one failing analysis leaves the others standing
            errors[name] = str(error)
    return results, errors
