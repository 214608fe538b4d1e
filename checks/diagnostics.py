"""Diagnostics of flow tables, changepoint tables and cluster tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from checks.common import DAY, QUANTITY, SIGN, Check, flow_check, p_nearest, r6
from checks.metrics import DEL, REC, SIGNED_PCT
from checks.series import CHANGE_COLUMNS, CHANGES, changes_at_quarters
from weir.operators import diagnostics as dia

FLOW_COLUMNS = ["pipeline_name", "state_abb", "connecting_entity", DAY, SIGN, QUANTITY]


def r2(expr: str, places: int = 2) -> str:
    return r6(f"round({expr}, {places})")


Z_SQL = """d AS (SELECT eff_gas_day, sum(scheduled_quantity) AS v FROM flows GROUP BY ALL),
z AS (SELECT eff_gas_day, v, (v - CASE WHEN count(*) OVER w = 30 THEN avg(v) OVER w END)
  / stddev_samp(v) OVER () AS z FROM d
  WINDOW w AS (ORDER BY eff_gas_day ROWS BETWEEN 29 PRECEDING AND CURRENT ROW)),
week AS (SELECT * FROM z ORDER BY eff_gas_day DESC LIMIT 7),
slope AS (SELECT (arg_max(v, eff_gas_day) - arg_min(v, eff_gas_day)) / 7 AS s,
  0.1::DOUBLE * avg(v) AS margin FROM week)"""
SEASONAL = f"""{r2("(SELECT avg(z) FROM (SELECT z FROM z ORDER BY eff_gas_day DESC LIMIT 30))")}
    AS z_score_current,
  {r2(f"(SELECT {p_nearest('z', 0.95)} FROM z)")} AS z_score_p95,
  (SELECT CASE WHEN s > margin THEN 'increasing' WHEN s < -margin THEN 'decreasing'
    ELSE 'stable' END FROM slope) AS trend_direction,
  (SELECT count(*) FROM d) AS data_points"""
BALANCE_SQL = f"""bal AS (SELECT eff_gas_day, {REC} AS r, {DEL} AS d FROM flows GROUP BY ALL),
pct AS (SELECT {SIGNED_PCT} AS pct FROM bal)"""
SHARES_SQL = """vol AS (SELECT connecting_entity, sum(scheduled_quantity) AS total_volume
  FROM flows WHERE connecting_entity IS NOT NULL GROUP BY ALL),
sh AS (SELECT *, total_volume / sum(total_volume) OVER () AS share FROM vol)"""
CONCENTRATION = f"""{r2("(SELECT sum(share ** 2) FROM sh)", 4)} AS hhi,
  {r2('''(SELECT sum(share) FROM (SELECT share FROM sh
    ORDER BY total_volume DESC, connecting_entity LIMIT 3)) * 100''')} AS top_3_share,
  (SELECT count(*) FROM sh) AS counterparty_count"""
WEEKEND_SQL = """we AS (SELECT
  avg(scheduled_quantity) FILTER (WHERE isodow(eff_gas_day) >= 6) AS e,
  avg(scheduled_quantity) FILTER (WHERE isodow(eff_gas_day) < 6) AS d,
  count(*) FILTER (WHERE isodow(eff_gas_day) >= 6) AS ne,
  count(*) FILTER (WHERE isodow(eff_gas_day) < 6) AS nd FROM flows)"""


def _peer_sql(column: str) -> str:
    rank = """(rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0::DOUBLE)
      / count(*) OVER () * 100"""
    return f"""peers AS (SELECT {column}, sum(scheduled_quantity) AS total_volume,
      avg(scheduled_quantity) AS avg_volume FROM flows GROUP BY ALL),
    ranked AS (SELECT *, {rank.format(c="total_volume")} AS total_percentile,
      {rank.format(c="avg_volume")} AS avg_percentile FROM peers)"""


def _flat_evidence(df: DataFrame) -> DataFrame:
    return dia.build_evidence(df).select(
        "data_type",
        "seasonal_stats.*",
        F.col("peer_comparison.percentile_total").alias("percentile_total"),
        F.col("peer_comparison.peer_count").alias("peer_count"),
        "balance_analysis.*",
        "counterparty_analysis.*",
        "calendar_signals.weekend_effect_pct",
    )


def _flat_changes(df: DataFrame) -> DataFrame:
    evidence = dia.build_evidence(changes_at_quarters(df))
    return evidence.select(
        "data_type",
        "stats.row_count",
        "magnitude_analysis.p95_magnitude",
        "confidence_analysis.low_confidence_count",
        "volume_change_analysis.volume_increases",
        "volatility_analysis.volatility_increases",
        "temporal_analysis.latest",
        F.size("temporal_analysis.monthly_distribution").alias("months"),
        F.col("correlation_analysis.correlations")["before_mean_vs_after_mean"].alias("corr"),
    )


def _quantity_clusters(df: DataFrame) -> DataFrame:
    """A cluster table from the data: locations by the tens of their mean quantity."""
    return df.groupBy("loc_name").agg(
        F.floor(F.avg(QUANTITY)).cast("int").alias("cluster_id")
    )


def _flat_clusters(df: DataFrame) -> DataFrame:
    return dia.build_evidence(_quantity_clusters(df)).select(
        "data_type", "total_clusters", "total_points"
    )


def _change_check(covers: str, run, select: str) -> Check:
    return flow_check(
        covers,
        CHANGE_COLUMNS,
        lambda df: run(changes_at_quarters(df)),
        f"WITH {CHANGES} SELECT {select} FROM ch",
    )


CORR_COLUMNS = dia.CHANGE_COLUMNS
CORR_SQL = " UNION ALL ".join(
    f"SELECT '{a}' AS col_a, '{b}' AS col_b, {r6(f'corr({a}, {b})')} AS correlation FROM ch"
    for i, a in enumerate(CORR_COLUMNS)
    for b in CORR_COLUMNS[i + 1 :]
)
MAGNITUDE_SQL = f"""{r6("avg(change_magnitude)")} AS mean_magnitude,
  {r6("stddev_samp(change_magnitude)")} AS std_magnitude,
  {r6("min(change_magnitude)")} AS min_magnitude, {r6("max(change_magnitude)")} AS max_magnitude,
  count(*) FILTER (WHERE change_magnitude > 0.5) AS high_magnitude_count,
  count(*) AS total_changes, {r6(p_nearest("change_magnitude", 0.5))} AS median_magnitude,
  {r6(p_nearest("change_magnitude", 0.75))} AS p75_magnitude,
  {r6(p_nearest("change_magnitude", 0.95))} AS p95_magnitude"""

CHECKS: dict[str, Check] = {
    "seasonal_deviation": flow_check(
        "DIA-1",
        [DAY, QUANTITY],
        dia.seasonal_deviation,
        f"WITH {Z_SQL} SELECT {SEASONAL}",
    ),
    "daily_z_scores": flow_check(
        "DIA-1",
        [DAY, QUANTITY],
        lambda df: dia.daily_z_scores(df).select(DAY, "z_score"),
        f"WITH {Z_SQL} SELECT eff_gas_day, {r6('z')} AS z_score FROM z",
    ),
    "peer_table": flow_check(
        "DIA-2",
        ["state_abb", QUANTITY],
        dia.peer_table,
        f"""WITH {_peer_sql("state_abb")} SELECT state_abb, total_volume,
          {r6("avg_volume")} AS avg_volume, {r6("total_percentile")} AS total_percentile,
          {r6("avg_percentile")} AS avg_percentile FROM ranked""",
    ),
    "peer_contrast": flow_check(
        "DIA-2",
        ["pipeline_name", QUANTITY],
        lambda df: dia.peer_contrast(df, "pipeline"),
        f"""WITH {_peer_sql("pipeline_name")} SELECT {r2("avg(total_percentile)", 1)}
          AS percentile_total, {r2("avg(avg_percentile)", 1)} AS percentile_avg,
          count(*) AS peer_count, 'pipeline' AS scope FROM ranked""",
    ),
    "balance_residual": flow_check(
        "DIA-3",
        [DAY, SIGN, QUANTITY],
        dia.balance_residual,
        f"""WITH {BALANCE_SQL} SELECT {r2("avg(pct)")} AS imbalance_pct_mean,
          {r2("stddev_samp(pct)")} AS imbalance_pct_std, count(*) AS days_analyzed FROM pct""",
    ),
    "counterparty_shares": flow_check(
        "DIA-4",
        ["connecting_entity", QUANTITY],
        dia.counterparty_shares,
        f"""WITH {SHARES_SQL} SELECT connecting_entity, total_volume,
          {r6("share")} AS market_share FROM sh""",
    ),
    "counterparty_concentration": flow_check(
        "DIA-4",
        ["connecting_entity", QUANTITY],
        dia.counterparty_concentration,
        f"WITH {SHARES_SQL} SELECT {CONCENTRATION}",
    ),
    "weekend_effect": flow_check(
        "DIA-5",
        [DAY, QUANTITY],
        dia.weekend_effect,
        f"""WITH {WEEKEND_SQL} SELECT {r2("(e - d) / d * 100")} AS weekend_effect_pct,
          {r2("e")} AS weekend_avg, {r2("d")} AS weekday_avg, ne AS weekend_days,
          nd AS weekday_days FROM we""",
    ),
    "flow_evidence": flow_check(
        "DIA-6 DIA-7",
        FLOW_COLUMNS,
        _flat_evidence,
        f"""WITH {Z_SQL}, {_peer_sql("pipeline_name")}, {BALANCE_SQL}, {SHARES_SQL},
          {WEEKEND_SQL} SELECT 'pipeline' AS data_type, {SEASONAL},
          {r2("(SELECT avg(total_percentile) FROM ranked)", 1)} AS percentile_total,
          (SELECT count(*) FROM ranked) AS peer_count,
          {r2("(SELECT avg(pct) FROM pct)")} AS imbalance_pct_mean,
          {r2("(SELECT stddev_samp(pct) FROM pct)")} AS imbalance_pct_std,
          (SELECT count(*) FROM pct) AS days_analyzed, {CONCENTRATION},
          {r2("(SELECT (e - d) / d * 100 FROM we)")} AS weekend_effect_pct""",
    ),
    "change_magnitudes": _change_check("DIA-8", dia.magnitude_stats, MAGNITUDE_SQL),
    "change_confidences": _change_check(
        "DIA-9",
        dia.confidence_stats,
        f"""{r6("avg(confidence)")} AS mean_confidence,
        {r6("stddev_samp(confidence)")} AS std_confidence,
        {r6("min(confidence)")} AS min_confidence, {r6("max(confidence)")} AS max_confidence,
        count(*) FILTER (WHERE confidence > 0.8) AS high_confidence_count,
        count(*) FILTER (WHERE confidence < 0.5) AS low_confidence_count,
        count(*) AS total_changes""",
    ),
    "change_volumes": _change_check(
        "DIA-10",
        dia.volume_changes,
        f"""{r6("avg(before_mean)")} AS avg_before_mean, {r6("avg(after_mean)")}
          AS avg_after_mean, {r6("avg(after_mean - before_mean)")} AS avg_volume_change,
        {r6("stddev_samp(after_mean - before_mean)")} AS std_volume_change,
        count(*) FILTER (WHERE after_mean > before_mean) AS volume_increases,
        count(*) FILTER (WHERE after_mean < before_mean) AS volume_decreases,
        {r6("avg((after_mean - before_mean) / nullif(before_mean, 0) * 100)")}
          AS avg_pct_change, count(*) AS total_changes""",
    ),
    "change_volatilities": _change_check(
        "DIA-11",
        dia.volatility_changes,
        f"""{r6("avg(before_std)")} AS avg_before_volatility, {r6("avg(after_std)")}
          AS avg_after_volatility, {r6("avg(after_std - before_std)")} AS avg_volatility_change,
        count(*) FILTER (WHERE after_std > before_std) AS volatility_increases,
        count(*) FILTER (WHERE after_std < before_std) AS volatility_decreases,
        count(*) AS total_changes""",
    ),
    "change_timing_counts": flow_check(
        "DIA-12",
        CHANGE_COLUMNS,
        lambda df: dia.timing_counts(changes_at_quarters(df)),
        f"""WITH {CHANGES} SELECT 'month' AS part, month(changepoint_date) AS key,
          count(*) AS count FROM ch GROUP BY 2
        UNION ALL SELECT 'year', year(changepoint_date), count(*) FROM ch GROUP BY 2
        UNION ALL SELECT 'day_of_week', isodow(changepoint_date), count(*) FROM ch GROUP BY 2""",
    ),
    "change_timing_range": _change_check(
        "DIA-12",
        dia.timing_range,
        """count(*) AS total_changepoints, min(changepoint_date) AS earliest,
        max(changepoint_date) AS latest""",
    ),
    "change_correlations": flow_check(
        "DIA-13",
        CHANGE_COLUMNS,
        lambda df: dia.cross_correlations(changes_at_quarters(df)),
        f"WITH {CHANGES} {CORR_SQL}",
    ),
    "changepoint_evidence": flow_check(
        "DIA-14 DIA-7",
        CHANGE_COLUMNS,
        _flat_changes,
        f"""WITH {CHANGES} SELECT 'changepoint' AS data_type, count(*) AS row_count,
          {r6(p_nearest("change_magnitude", 0.95))} AS p95_magnitude,
          count(*) FILTER (WHERE confidence < 0.5) AS low_confidence_count,
          count(*) FILTER (WHERE after_mean > before_mean) AS volume_increases,
          count(*) FILTER (WHERE after_std > before_std) AS volatility_increases,
          max(changepoint_date) AS latest,
          count(DISTINCT month(changepoint_date)) AS months,
          {r6("corr(before_mean, after_mean)")} AS corr FROM ch""",
    ),
    "cluster_distribution": flow_check(
        "DIA-15",
        ["loc_name", QUANTITY],
        lambda df: dia.cluster_distribution(_quantity_clusters(df)),
        """WITH c AS (SELECT loc_name, CAST(floor(avg(scheduled_quantity)) AS BIGINT)
          AS cluster_id FROM flows GROUP BY ALL)
        SELECT cluster_id, count(*) AS count FROM c GROUP BY ALL""",
    ),
    "cluster_evidence": flow_check(
        "DIA-15 DIA-7",
        ["loc_name", QUANTITY],
        _flat_clusters,
        """WITH c AS (SELECT loc_name, floor(avg(scheduled_quantity)) AS cluster_id
          FROM flows GROUP BY ALL)
        SELECT 'cluster' AS data_type, count(DISTINCT cluster_id) AS total_clusters,
          count(*) AS total_points FROM c""",
    ),
    "basic_evidence": flow_check(
        "DIA-16 DIA-7",
        ["loc_name", "category_short"],
        lambda df: dia.build_evidence(df).withColumn("columns", F.array_join("columns", ",")),
        """SELECT 'unknown' AS data_type, count(*) AS data_points, 2::BIGINT AS column_count,
          'loc_name,category_short' AS columns FROM flows""",
    ),
}
