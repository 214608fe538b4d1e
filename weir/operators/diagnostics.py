"""Evidence numbers for "why did this change": each part is a one-row DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weir.functions.columns import (
    delivery_quantity,
    is_weekend,
    iso_weekday,
    receipt_quantity,
    signed_imbalance_pct,
    total,
)
from weir.functions.order import group_quantiles, nearest_of_list
from weir.operators.aggregate import correlation_pairs, frequency
from weir.operators.decompose import daily_series
from weir.operators.metrics import daily_balance
from weir.operators.profile import table_shape
from weir.operators.ranking import (
    overall,
    percentile_ranks,
    with_share,
    with_trailing_mean,
)
from weir.session import read_twice, written

ROLLING_DAYS = 30
TREND_DAYS = 7
TREND_MARGIN = 0.1
PEER_COLUMNS = {"state": "state_abb", "pipeline": "pipeline_name"}
CHANGE_COLUMNS = [
    "change_magnitude",
    "confidence",
    "before_mean",
    "after_mean",
    "before_std",
    "after_std",
]

def _day_counts() -> dict[str, Column]:
    """What a day contributes to means and counts of rows."""
    return {
        "rows": F.count(F.lit(1)),
        "known": F.count("scheduled_quantity"),
        "quantity": F.sum("scheduled_quantity"),
    }


def _or(c: Column, default: float | str) -> Column:
    return F.coalesce(c, F.lit(default))


def daily_z_scores(df: DataFrame, value: str = "scheduled_quantity") -> DataFrame:
    """Daily totals with their trailing 30-day mean and z = (x - mean) / overall std.

    One row per day, so the windows over the whole frame hold no more rows than the
    calendar. ``age`` is 1 for the last day.
    """
    return _z_scores(daily_series(df, [], value), value)


def _z_scores(daily: DataFrame, value: str) -> DataFrame:
    daily = daily.where(F.col("eff_gas_day").isNotNull())
    rolling = with_trailing_mean(daily, [], "eff_gas_day", value, "rolling_mean", ROLLING_DAYS)
    spread = F.stddev_samp(value).over(Window.partitionBy())
    return rolling.select(
        "eff_gas_day",
        value,
        "rolling_mean",
        F.try_divide(F.col(value) - F.col("rolling_mean"), spread).alias("z_score"),
        F.row_number().over(Window.orderBy(F.desc("eff_gas_day"))).alias("age"),
    )


def seasonal_deviation(df: DataFrame, value: str = "scheduled_quantity") -> DataFrame:
    """Mean z of the last 30 days, nearest p95 of z, trend of the last 7 days, day count."""
    return _seasonal_deviation(daily_series(df, [], value), value)


def _seasonal_deviation(daily: DataFrame, value: str) -> DataFrame:
    v, age = F.col(value), F.col("age")
    slope = (
        F.max(F.when(age == 1, v)) - F.max(F.when(age == TREND_DAYS, v))
    ) / TREND_DAYS
    margin = TREND_MARGIN * F.avg(F.when(age <= TREND_DAYS, v))
    trend = F.when(slope > margin, "increasing").when(slope < -margin, "decreasing")
    current = F.avg(F.when(age <= ROLLING_DAYS, F.col("z_score")))
    return _z_scores(daily, value).agg(
        _or(F.round(current, 2), 0.0).alias("z_score_current"),
        _or(F.round(nearest_of_list(F.col("z_score"), 0.95), 2), 0.0).alias("z_score_p95"),
        _or(trend, "stable").alias("trend_direction"),
        F.count(F.lit(1)).alias("data_points"),
    )


def _peers(df: DataFrame, scope: str) -> DataFrame:
    return df.groupBy(PEER_COLUMNS.get(scope, "state_abb")).agg(
        total(F.col("scheduled_quantity")).alias("total_volume"),
        F.avg("scheduled_quantity").alias("avg_volume"),
    )


def peer_table(df: DataFrame, scope: str = "state") -> DataFrame:
    """Totals and means per peer with their percentile ranks."""
    return percentile_ranks(
        _peers(df, scope),
        {"total_volume": "total_percentile", "avg_volume": "avg_percentile"},
    )


def peer_contrast(df: DataFrame, scope: str = "state") -> DataFrame:
    """Mean percentiles over all peers, and how many there are; 50 without peers.

    Average ranks of m values always have the mean (m + 1) / 2, so counting is enough;
    :func:`peer_table` has the percentile of every peer.
    """
    return _peer_contrast(_peers(df, scope), scope)


def _peer_contrast(peers: DataFrame, scope: str) -> DataFrame:
    n = F.count(F.lit(1))

    def mean_percentile(c: str) -> Column:
        ranked = F.count(c)
        percentile = F.try_divide((ranked + 1) / 2, F.when(ranked > 0, n)) * 100
        return _or(F.round(percentile, 1), 50.0)

    return peers.agg(
        mean_percentile("total_volume").alias("percentile_total"),
        mean_percentile("avg_volume").alias("percentile_avg"),
        n.alias("peer_count"),
        F.lit(scope).alias("scope"),
    )


def balance_residual(df: DataFrame) -> DataFrame:
    """Mean and spread of the signed daily imbalance of the whole table."""
    return _balance_residual(daily_balance(df, ["eff_gas_day"]))


def _balance_residual(daily: DataFrame) -> DataFrame:
    return daily.withColumn("pct", signed_imbalance_pct()).agg(
        _or(F.round(F.avg("pct"), 2), 0.0).alias("imbalance_pct_mean"),
        _or(F.round(F.stddev_samp("pct"), 2), 0.0).alias("imbalance_pct_std"),
        F.count(F.lit(1)).alias("days_analyzed"),
    )


def counterparty_shares(df: DataFrame) -> DataFrame:
    """Volume and market share per known counterparty."""
    volumes = (
        df.where(F.col("connecting_entity").isNotNull())
        .groupBy("connecting_entity")
        .agg(total(F.col("scheduled_quantity")).alias("total_volume"))
    )
    return with_share(volumes, "total_volume", "market_share")


def counterparty_concentration(df: DataFrame) -> DataFrame:
    """Sum of squared shares, share of the three largest in percent, counterparty count."""
    return _concentration(counterparty_shares(df))


def _concentration(shares: DataFrame) -> DataFrame:
    largest = shares.orderBy(F.desc("total_volume"), "connecting_entity").limit(3)
    return shares.agg(
        _or(F.round(F.sum(F.pow("market_share", F.lit(2))), 4), 0.0).alias("hhi"),
        F.count(F.lit(1)).alias("counterparty_count"),
    ).select(
        "hhi",
        _or(F.round(overall(largest, F.sum("market_share")) * 100, 2), 0.0).alias("top_3_share"),
        "counterparty_count",
    )


def weekend_effect(df: DataFrame) -> DataFrame:
    """Mean row on weekends against weekdays, their difference in percent, row counts."""
    per_day = df.groupBy("eff_gas_day").agg(*[c.alias(n) for n, c in _day_counts().items()])
    return _weekend_effect(per_day)


def _weekend_effect(per_day: DataFrame) -> DataFrame:
    """From one row per day with its row count, its known quantities and their sum."""
    weekend = is_weekend("eff_gas_day")
    effect = F.when(
        F.col("weekday") > 0, F.try_divide(F.col("weekend") - F.col("weekday"), F.col("weekday"))
    )

    def mean(days: Column) -> Column:
        quantity, known = F.sum(F.when(days, F.col("quantity"))), F.sum(F.when(days, F.col("known")))
        return _or(F.try_divide(quantity, known), 0.0)

    def rows(days: Column) -> Column:
        return F.coalesce(F.sum(F.when(days, F.col("rows"))), F.lit(0).cast("bigint"))

    return per_day.agg(
        mean(weekend).alias("weekend"),
        mean(~weekend).alias("weekday"),
        rows(weekend).alias("weekend_days"),
        rows(~weekend).alias("weekday_days"),
    ).select(
        _or(F.round(effect * 100, 2), 0.0).alias("weekend_effect_pct"),
        F.round("weekend", 2).alias("weekend_avg"),
        F.round("weekday", 2).alias("weekday_avg"),
        "weekend_days",
        "weekday_days",
    )


def _grouped_once(df: DataFrame, peer: str, value: str) -> DataFrame:
    """Sums per day, per peer and per counterparty from one reading, written.

    ``set`` tells what a row stands for. There are no more rows than days, peers and
    counterparties.
    """
    sets = {"day": "eff_gas_day", "peer": peer, "counterparty": "connecting_entity"}
    name = F.lit(None).cast("string")
    for kind, column in sets.items():
        name = F.when(F.grouping(column) == 0, kind).otherwise(name)
    sums = _day_counts() | {
        "value": total(F.col(value).cast("double")),
        "receipts": total(receipt_quantity()),
        "deliveries": total(delivery_quantity()),
        "set": name,
    }
    grouped = df.groupingSets([[c] for c in sets.values()], *sets.values())
    return written(grouped.agg(*[c.alias(n) for n, c in sums.items()]), "evidence-groups")


def _bundle(data_type: str, parts: dict[str, DataFrame]) -> DataFrame:
    """One row; every part becomes a struct column through its own scalar subquery."""
    first, *others = parts.items()
    whole = F.struct(*first[1].columns).alias(first[0])
    row = first[1].select(F.lit(data_type).alias("data_type"), whole)
    for name, part in others:
        row = row.withColumn(name, part.select(F.struct(*part.columns)).scalar())
    return row


def flow_evidence(
    df: DataFrame, scope: str = "pipeline", value: str = "scheduled_quantity"
) -> DataFrame:
    peer = PEER_COLUMNS.get(scope, "state_abb")
    groups = _grouped_once(df, peer, value)
    quantity = _or(F.col("quantity"), 0.0).alias("total_volume")
    days = groups.where(F.col("set") == "day")
    daily = days.select("eff_gas_day", F.col("value").alias(value))
    peers = groups.where(F.col("set") == "peer").select(
        peer, quantity, F.try_divide("quantity", "known").alias("avg_volume")
    )
    volumes = groups.where(
        (F.col("set") == "counterparty") & F.col("connecting_entity").isNotNull()
    ).select("connecting_entity", quantity)
    shares = with_share(volumes, "total_volume", "market_share")
    return _bundle(
        "pipeline",
        {
            "seasonal_stats": _seasonal_deviation(daily, value),
            "peer_comparison": _peer_contrast(peers, scope),
            "balance_analysis": _balance_residual(days.select("receipts", "deliveries")),
            "counterparty_analysis": _concentration(shares),
            "calendar_signals": _weekend_effect(
                days.select("eff_gas_day", "rows", "known", "quantity")
            ),
        },
    )


def magnitude_stats(changes: DataFrame) -> DataFrame:
    c = F.col("change_magnitude")
    wanted = {"median_magnitude": 0.5, "p75_magnitude": 0.75, "p95_magnitude": 0.95}
    quantiles = group_quantiles(changes, [], "change_magnitude", wanted)
    return changes.agg(
        F.avg(c).alias("mean_magnitude"),
        F.stddev_samp(c).alias("std_magnitude"),
        F.min(c).alias("min_magnitude"),
        F.max(c).alias("max_magnitude"),
        F.count_if(c > 0.5).alias("high_magnitude_count"),
        F.count(F.lit(1)).alias("total_changes"),
    ).withColumns({name: quantiles.select(name).scalar() for name in wanted})


def confidence_stats(changes: DataFrame) -> DataFrame:
    c = F.col("confidence")
    return changes.agg(
        F.avg(c).alias("mean_confidence"),
        F.stddev_samp(c).alias("std_confidence"),
        F.min(c).alias("min_confidence"),
        F.max(c).alias("max_confidence"),
        F.count_if(c > 0.8).alias("high_confidence_count"),
        F.count_if(c < 0.5).alias("low_confidence_count"),
        F.count(F.lit(1)).alias("total_changes"),
    )


def volume_changes(changes: DataFrame) -> DataFrame:
    before, after = F.col("before_mean"), F.col("after_mean")
    return changes.agg(
        F.avg(before).alias("avg_before_mean"),
        F.avg(after).alias("avg_after_mean"),
        F.avg(after - before).alias("avg_volume_change"),
        F.stddev_samp(after - before).alias("std_volume_change"),
        F.count_if(after > before).alias("volume_increases"),
        F.count_if(after < before).alias("volume_decreases"),
        F.avg(F.try_divide(after - before, before) * 100).alias("avg_pct_change"),
        F.count(F.lit(1)).alias("total_changes"),
    )


def volatility_changes(changes: DataFrame) -> DataFrame:
    before, after = F.col("before_std"), F.col("after_std")
    return changes.agg(
        F.avg(before).alias("avg_before_volatility"),
        F.avg(after).alias("avg_after_volatility"),
        F.avg(after - before).alias("avg_volatility_change"),
        F.count_if(after > before).alias("volatility_increases"),
        F.count_if(after < before).alias("volatility_decreases"),
        F.count(F.lit(1)).alias("total_changes"),
    )


def timing_counts(changes: DataFrame) -> DataFrame:
    """(part, key, count): changepoints by month, year and weekday (1 = Monday)."""
    day = F.col("changepoint_date")
    parts = {"month": F.month(day), "year": F.year(day), "day_of_week": iso_weekday(day)}
    entries = F.array(
        *[F.struct(F.lit(p).alias("part"), k.alias("key")) for p, k in parts.items()]
    )
    return (
        changes.select(F.inline(entries))
        .groupBy("part", "key")
        .agg(F.count(F.lit(1)).alias("count"))
    )


def timing_range(changes: DataFrame) -> DataFrame:
    day = F.col("changepoint_date")
    return changes.agg(
        F.count(F.lit(1)).alias("total_changepoints"),
        F.min(day).alias("earliest"),
        F.max(day).alias("latest"),
    )


def timing(changes: DataFrame) -> DataFrame:
    """Range plus the three distributions as arrays; months, weekdays and years are few."""
    counts = timing_counts(changes)

    def distribution(part: str) -> Column:
        rows = counts.where(F.col("part") == part)
        return rows.agg(F.sort_array(F.collect_list(F.struct("key", "count")))).scalar()

    return timing_range(changes).withColumns(
        {
            "monthly_distribution": distribution("month"),
            "yearly_distribution": distribution("year"),
            "day_of_week_distribution": distribution("day_of_week"),
        }
    )


def cross_correlations(changes: DataFrame) -> DataFrame:
    return correlation_pairs(changes, [c for c in CHANGE_COLUMNS if c in changes.columns])


def changepoint_evidence(changes: DataFrame) -> DataFrame:
    """Everything about a changepoint table that its columns allow, in one row."""
    changes = read_twice(changes)
    have = set(changes.columns)
    parts: dict[str, DataFrame] = {"stats": table_shape(changes)}
    optional: list[tuple[str, set[str], Callable[[DataFrame], DataFrame]]] = [
        ("magnitude_analysis", {"change_magnitude"}, magnitude_stats),
        ("confidence_analysis", {"confidence"}, confidence_stats),
        ("volume_change_analysis", {"before_mean", "after_mean"}, volume_changes),
        ("volatility_analysis", {"before_std", "after_std"}, volatility_changes),
        ("temporal_analysis", {"changepoint_date"}, timing),
    ]
    for name, needed, build in optional:
        if needed <= have:
            parts[name] = build(changes)
    if len(have & set(CHANGE_COLUMNS)) > 1:
        pairs = cross_correlations(changes)
        label = F.concat_ws("_vs_", "col_a", "col_b")
        parts["correlation_analysis"] = pairs.agg(
            F.map_from_entries(F.collect_list(F.struct(label, "correlation"))).alias(
                "correlations"
            )
        )
    return _bundle("changepoint", parts)


def cluster_distribution(clusters: DataFrame) -> DataFrame:
    return frequency(clusters, F.col("cluster_id"), "cluster_id")


def cluster_evidence(clusters: DataFrame) -> DataFrame:
    sizes = cluster_distribution(clusters)
    return sizes.agg(
        F.lit("cluster").alias("data_type"),
        F.sort_array(F.collect_list(F.struct("cluster_id", "count"))).alias(
            "cluster_distribution"
        ),
        F.count(F.lit(1)).alias("total_clusters"),
        _or(F.sum("count"), 0).alias("total_points"),
    )


def basic_evidence(df: DataFrame) -> DataFrame:
    return table_shape(df).select(
        F.lit("unknown").alias("data_type"),
        F.col("row_count").alias("data_points"),
        "column_count",
        F.array(*map(F.lit, df.columns)).alias("columns"),
    )


def build_evidence(df: DataFrame, scope: str = "pipeline") -> DataFrame:
    """Pick the evidence by the columns: changepoint table, cluster table, flows, else basic."""
    if "changepoint_date" in df.columns:
        return changepoint_evidence(df)
    if "cluster_id" in df.columns:
        return cluster_evidence(df)
    needed = {
        "eff_gas_day",
        "scheduled_quantity",
        "rec_del_sign",
        "connecting_entity",
        PEER_COLUMNS.get(scope, "state_abb"),
    }
    return flow_evidence(df, scope) if needed <= set(df.columns) else basic_evidence(df)
