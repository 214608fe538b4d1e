"""Domain metrics and rollups."""

from __future__ import annotations

from checks.common import DAY, LOCATION, QUANTITY, SIGN, Check, flow_check, p_nearest, r6
from checks.filters import ROLLUP_COLUMNS, ROLLUP_SQL
from weir.operators import metrics
from weir.streaming.rollup import rollup_from_stream

REC = "sum(CASE WHEN rec_del_sign = 1 THEN scheduled_quantity ELSE 0 END)"
DEL = "sum(CASE WHEN rec_del_sign = -1 THEN scheduled_quantity ELSE 0 END)"
SIGNED_PCT = "CASE WHEN r > 0 THEN (r - d) / r * 100 ELSE 0 END"

RAMP_SQL = f"""
WITH deltas AS (SELECT pipeline_name, loc_name, scheduled_quantity,
  abs(scheduled_quantity - lag(scheduled_quantity) OVER (PARTITION BY pipeline_name, loc_name
    ORDER BY eff_gas_day, scheduled_quantity)) AS delta FROM flows),
t AS (SELECT pipeline_name, loc_name, count(*) AS n_days, {p_nearest("delta", 0.95)} AS p95,
  median(scheduled_quantity) AS med FROM deltas GROUP BY ALL)
SELECT pipeline_name, loc_name,
  {r6("CASE WHEN p95 IS NULL THEN 0 ELSE p95 / greatest(med, 1) END")} AS ramp_risk,
  n_days, {r6("p95")} AS p95_abs_delta, {r6("med")} AS median_flow FROM t"""

CHECKS: dict[str, Check] = {
    "ramp_risk": flow_check("MET-1", [*LOCATION, DAY, QUANTITY], metrics.ramp_risk, RAMP_SQL),
    "ramp_risk_split": flow_check(
        "MET-1", [*LOCATION, DAY, QUANTITY], metrics.ramp_risk, RAMP_SQL
    ),
    "reversal_freq": flow_check(
        "MET-2",
        ["pipeline_name", "connecting_entity", DAY, SIGN, QUANTITY],
        metrics.reversal_freq,
        f"""WITH d AS (SELECT pipeline_name, connecting_entity, eff_gas_day,
          sum(rec_del_sign * scheduled_quantity) AS net FROM flows GROUP BY ALL),
        t AS (SELECT *, sign(net) <> lag(sign(net)) OVER (PARTITION BY pipeline_name,
          connecting_entity ORDER BY eff_gas_day) AS turned FROM d)
        SELECT pipeline_name, connecting_entity,
          {r6("count(*) FILTER (WHERE turned) / greatest(count(*), 1)")} AS reversal_freq,
          count(*) AS n_days, count(*) FILTER (WHERE turned) AS n_reversals,
          {r6("stddev_samp(net)")} AS net_flow_std FROM t GROUP BY ALL""",
    ),
    "imbalance_pct": flow_check(
        "MET-3",
        ["pipeline_name", DAY, SIGN, QUANTITY],
        metrics.imbalance_pct,
        f"""SELECT pipeline_name, eff_gas_day,
          {r6(f"abs({REC} - {DEL}) / greatest({REC}, 1) * 100")} AS imbalance_pct,
          {r6(REC)} AS total_receipts, {r6(DEL)} AS total_deliveries,
          {r6(f"{REC} - {DEL}")} AS net_flow FROM flows GROUP BY ALL""",
    ),
    "daily_rollup": flow_check("MET-4", ROLLUP_COLUMNS, metrics.daily_rollup, ROLLUP_SQL),
    "daily_rollup_from_stream": Check(
        "MET-4",
        rollup_from_stream,
        f"""SELECT CAST(l_shipdate AS DATE) AS eff_gas_day, l_suppkey,
        {r6("sum(CASE WHEN l_linestatus = 'O' THEN l_quantity ELSE 0 END)")} AS sum_receipts,
        {r6("sum(CASE WHEN l_linestatus <> 'O' THEN l_quantity ELSE 0 END)")} AS sum_deliveries,
        {r6("sum(l_quantity)")} AS sum_all,
        {r6("sum(CASE WHEN l_linestatus = 'O' THEN l_quantity ELSE -l_quantity END)")} AS net
        FROM lineitem GROUP BY ALL""",
    ),
    "metric_by_name": flow_check(
        "MET-5",
        ["pipeline_name", DAY, SIGN, QUANTITY],
        lambda df: metrics.compute_metric(df, "imbalance_pct").select(
            "pipeline_name", DAY, "net_flow"
        ),
        f"""SELECT pipeline_name, eff_gas_day, {r6(f"{REC} - {DEL}")} AS net_flow
        FROM flows GROUP BY ALL""",
    ),
    "pipeline_summary": flow_check(
        "MET-6",
        ["pipeline_name", DAY, QUANTITY],
        metrics.pipeline_summary,
        f"""SELECT pipeline_name, {r6("sum(scheduled_quantity)")} AS total_quantity,
          {r6("avg(scheduled_quantity)")} AS avg_quantity, min(eff_gas_day) AS start_date,
          max(eff_gas_day) AS end_date, count(*) AS record_count FROM flows GROUP BY ALL""",
    ),
    "signed_imbalance_summary": flow_check(
        "MET-7",
        ["pipeline_name", DAY, SIGN, QUANTITY],
        metrics.signed_imbalance_summary,
        f"""WITH b AS (SELECT pipeline_name, eff_gas_day, {REC} AS r, {DEL} AS d FROM flows
          GROUP BY ALL), p AS (SELECT pipeline_name, {SIGNED_PCT} AS pct FROM b)
        SELECT pipeline_name, {r6("avg(pct)")} AS avg_imbalance_pct,
          {r6("stddev_samp(pct)")} AS std_imbalance_pct, count(*) AS days_analyzed
        FROM p GROUP BY ALL""",
    ),
    "monthly_seasonality": flow_check(
        "MET-8",
        ["pipeline_name", DAY, QUANTITY],
        metrics.monthly_seasonality,
        f"""SELECT pipeline_name, month(eff_gas_day) AS month,
          {r6("avg(scheduled_quantity)")} AS avg_monthly_flow,
          {r6("stddev_samp(scheduled_quantity)")} AS std_monthly_flow,
          count(*) AS record_count FROM flows GROUP BY 1, 2""",
    ),
}
