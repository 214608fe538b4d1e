"""Data-quality rules and profiling."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from checks.common import DAY, LOCATION, QUANTITY, SIGN, Check, flow_check, p_nearest, r6, table_check
from checks.metrics import DEL, REC
from weir.operators import profile, rules
from weir.operators.ranking import sample_rows

ALL = [
    DAY,
    "pipeline_name",
    "loc_name",
    "state_abb",
    "connecting_pipeline",
    "category_short",
    SIGN,
    "latitude",
    "longitude",
    QUANTITY,
]
# A date, five texts, a tinyint and three doubles.
ALL_WIDTH = 4 + 5 * 20 + 1 + 3 * 8


def _parts_as_locations(df: DataFrame) -> DataFrame:
    named = df.select(
        F.concat_ws("/", "p_name", "p_size").alias("loc_name"), F.col("p_brand").alias("state_abb")
    )
    return rules.locations_in_many_states(named).withColumn(
        "states", F.array_join("states", ",")
    )


def _short_range(df: DataFrame) -> DataFrame:
    return df.where(F.col(DAY).between("1999-01-01", "1999-02-28"))


ACTIVE = """active AS (SELECT pipeline_name, loc_name FROM flows GROUP BY ALL
  HAVING median(scheduled_quantity) > 0)"""
R001 = """scheduled_quantity > 0 AND (latitude IS NULL OR longitude IS NULL)"""
R005 = "connecting_pipeline IS NOT NULL AND lower(category_short) <> 'interconnect'"
GAPS_SQL = """SELECT pipeline_name, loc_name, min(eff_gas_day) AS first_date,
  max(eff_gas_day) AS last_date, count(eff_gas_day) AS actual_days,
  max(eff_gas_day) - min(eff_gas_day) + 1 - count(eff_gas_day) AS missing_days,
  round(sum(scheduled_quantity), 6) AS total_quantity,
  count(DISTINCT eff_gas_day) AS distinct_days
  FROM {source} GROUP BY pipeline_name, loc_name
  HAVING sum(scheduled_quantity) > 0 AND count(eff_gas_day) < 30"""
COUNTS_SQL = f"""{{flows}} {ACTIVE},
imb AS (SELECT pipeline_name, eff_gas_day, {REC} AS r, {DEL} AS d FROM flows GROUP BY ALL),
counts AS (
  SELECT 'R-001' AS rule_id, count(*) AS violations FROM flows WHERE {R001}
  UNION ALL SELECT 'R-002', count(*) FROM (SELECT loc_name FROM flows GROUP BY ALL
    HAVING count(DISTINCT state_abb) > 1)
  UNION ALL SELECT 'R-003', count(*) FROM (SELECT pipeline_name, loc_name FROM flows
    SEMI JOIN active USING (pipeline_name, loc_name) WHERE scheduled_quantity = 0
    GROUP BY ALL HAVING count(*) >= 7)
  UNION ALL SELECT 'R-004', count(*) FROM imb WHERE abs(r - d) > 5
  UNION ALL SELECT 'R-005', count(*) FROM flows WHERE {R005}
  UNION ALL SELECT 'R-006', count(*) FROM (SELECT pipeline_name, loc_name FROM flows GROUP BY ALL
    HAVING sum(scheduled_quantity) > 0 AND count(eff_gas_day) < 30))"""
TEXT_SQL = "CASE rule_id " + " ".join(
    f"WHEN '{k}' THEN '{v}'" for k, v in rules.RULE_DESCRIPTIONS.items()
) + " ELSE 'All rules' END"

CUSTOMER = ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"]
FLOW_TEXT = ["pipeline_name", "loc_name", "connecting_pipeline", "category_short"]
NULLS_SQL = " UNION ALL ".join(
    f"""SELECT '{c}' AS column_name, count(*) FILTER (WHERE {c} IS NULL) AS null_count,
    {r6(f"count(*) FILTER (WHERE {c} IS NULL) / count(*) * 100")} AS null_pct,
    count(*) AS n_rows FROM flows"""
    for c in FLOW_TEXT
)
DICTIONARY_SQL = " UNION ALL ".join(
    f"""SELECT '{c}' AS column_name, '{t}' AS data_type,
    {r6(f"count(*) FILTER (WHERE {c} IS NULL) / count(*)")} AS null_rate,
    count(*) AS n_rows FROM flows"""
    for c, t in [
        (DAY, "date"),
        ("loc_name", "string"),
        ("connecting_pipeline", "string"),
        (SIGN, "tinyint"),
        ("latitude", "double"),
        ("longitude", "double"),
        (QUANTITY, "double"),
    ]
)
NUMERIC_SQL = " UNION ALL ".join(
    f"""SELECT '{c}' AS column_name, {r6(f"avg({c})")} AS mean, {r6(f"stddev_samp({c})")} AS std,
    {r6(f"min({c})::DOUBLE")} AS min, {r6(f"max({c})::DOUBLE")} AS max,
    {r6(f"median({c})::DOUBLE")} AS median, {r6(p_nearest(c, 0.25) + "::DOUBLE")} AS q25,
    {r6(p_nearest(c, 0.75) + "::DOUBLE")} AS q75,
    count(DISTINCT {c}) + max(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END)::BIGINT AS unique_count
    FROM flows"""
    for c in (SIGN, "latitude", "longitude", QUANTITY)
)
STRING_SQL = " UNION ALL ".join(
    f"""SELECT '{c}' AS column_name, (SELECT count(DISTINCT {c})
      + max(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END)::BIGINT FROM flows) AS unique_count,
    (SELECT {r6(f"avg(length({c}))")} FROM flows) AS avg_length,
    (SELECT string_agg(coalesce(v, 'null') || '=' || n, ',' ORDER BY p) FROM
      (SELECT {c} AS v, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, {c} NULLS LAST)
        AS p FROM flows GROUP BY {c}) WHERE p <= 3) AS most_common"""
    for c in FLOW_TEXT
)


def _strings(df: DataFrame) -> DataFrame:
    shown = F.transform(
        "most_common",
        lambda e: F.concat(
            F.coalesce(e["value"], F.lit("null")), F.lit("="), e["count"].cast("string")
        ),
    )
    return profile.string_profile(df, FLOW_TEXT).withColumn(
        "most_common", F.array_join(shown, ",")
    )


def _quality_sql(columns: list[str], source: str) -> str:
    nulls = " + ".join(f"count(*) FILTER (WHERE {c} IS NULL)" for c in columns)
    unique = " + ".join(
        f"count(DISTINCT {c}) + max(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END)::BIGINT"
        for c in columns
    )
    k = len(columns)
    return f"""SELECT 'data_quality_score' AS metric,
      {r6(f"greatest(0, 100 - ({nulls}) * 100 / count(*) / {k})::DOUBLE")} AS value,
      CAST(NULL AS VARCHAR) AS message FROM {source}
    UNION ALL SELECT 'completeness', {r6(f"(1 - ({nulls}) / (count(*) * {k})) * 100")}, NULL
      FROM {source}
    UNION ALL SELECT 'uniqueness', {r6(f"({unique}) / count(*) / {k} * 100")}, NULL FROM {source}
    UNION ALL SELECT 'beauty', NULL, 'Unknown metric: beauty'"""


def _step_stats(df: DataFrame) -> DataFrame:
    nulls = F.col("null_counts")
    return profile.step_stats(df).select(
        "row_count",
        "column_count",
        "estimated_bytes",
        *[nulls[c].alias(f"nulls_{c}") for c in FLOW_TEXT],
    )


CHECKS: dict[str, Check] = {
    "rule_missing_geo": flow_check(
        "RUL-1",
        ["pipeline_name", "loc_name", DAY, QUANTITY, "latitude", "longitude"],
        rules.missing_geo,
        f"""SELECT pipeline_name, loc_name, scheduled_quantity, eff_gas_day, latitude, longitude
        FROM flows WHERE {R001}""",
    ),
    "rule_locations_in_many_states": table_check(
        "RUL-2",
        "part",
        _parts_as_locations,
        """SELECT p_name || '/' || p_size AS loc_name, count(DISTINCT p_brand) AS n_states,
        string_agg(DISTINCT p_brand, ',' ORDER BY p_brand) AS states
        FROM part GROUP BY 1 HAVING count(DISTINCT p_brand) > 1""",
    ),
    "rule_zero_quantity_days": flow_check(
        "RUL-3",
        [*LOCATION, DAY, QUANTITY],
        lambda df: rules.zero_quantity_days(df, 55),
        f"""WITH {ACTIVE} SELECT pipeline_name, loc_name, count(eff_gas_day) AS zero_days,
          min(eff_gas_day) AS first_zero_date, max(eff_gas_day) AS last_zero_date
        FROM flows JOIN active USING (pipeline_name, loc_name) WHERE scheduled_quantity = 0
        GROUP BY ALL HAVING count(eff_gas_day) >= 55""",
    ),
    "rule_zero_quantity_streaks": flow_check(
        "RUL-3",
        [*LOCATION, DAY, QUANTITY],
        lambda df: rules.zero_quantity_streaks(df, 2),
        f"""WITH {ACTIVE}, days AS (SELECT pipeline_name, loc_name, eff_gas_day FROM flows
          GROUP BY ALL HAVING max(abs(scheduled_quantity)) = 0),
        runs AS (SELECT *, eff_gas_day - CAST(row_number() OVER (PARTITION BY pipeline_name,
          loc_name ORDER BY eff_gas_day) AS INTEGER) AS run FROM days)
        SELECT pipeline_name, loc_name, min(eff_gas_day) AS streak_start,
          max(eff_gas_day) AS streak_end, count(*) AS streak_days
        FROM runs JOIN active USING (pipeline_name, loc_name)
        GROUP BY pipeline_name, loc_name, run HAVING count(*) >= 2""",
    ),
    "rule_pipeline_imbalance": flow_check(
        "RUL-4",
        ["pipeline_name", DAY, SIGN, QUANTITY],
        rules.pipeline_imbalance,
        f"""SELECT pipeline_name, eff_gas_day, {r6(REC)} AS receipts, {r6(DEL)} AS deliveries,
          {r6(f"{REC} - {DEL}")} AS net,
          {r6(f"abs({REC} - {DEL}) / ({REC} + 1)")} AS imbalance_ratio
        FROM flows GROUP BY ALL HAVING abs({REC} - {DEL}) > 5""",
    ),
    "rule_pipeline_imbalance_ratio": flow_check(
        "RUL-4",
        ["pipeline_name", DAY, SIGN, QUANTITY],
        lambda df: rules.pipeline_imbalance(df, 5.0, "ratio"),
        f"""SELECT pipeline_name, eff_gas_day, {r6(REC)} AS receipts, {r6(DEL)} AS deliveries,
          {r6(f"{REC} - {DEL}")} AS net,
          {r6(f"abs({REC} - {DEL}) / ({REC} + 1)")} AS imbalance_ratio
        FROM flows GROUP BY ALL HAVING abs({REC} - {DEL}) / ({REC} + 1) * 100 > 5""",
    ),
    "rule_schema_mismatch": flow_check(
        "RUL-5",
        ["pipeline_name", "loc_name", DAY, "connecting_pipeline", "category_short"],
        rules.schema_mismatch,
        f"""SELECT connecting_pipeline, category_short, pipeline_name, loc_name, eff_gas_day
        FROM flows WHERE {R005}""",
    ),
    "rule_gas_day_gaps": flow_check(
        "RUL-6",
        [*LOCATION, DAY, QUANTITY],
        lambda df: rules.gas_day_gaps(_short_range(df)),
        f"""WITH short AS (SELECT * FROM flows
          WHERE eff_gas_day BETWEEN DATE '1999-01-01' AND DATE '1999-02-28')
        {GAPS_SQL.format(source="short")}""",
    ),
    # The whole table, where locations have about 600 rows each.
    "rule_gas_day_gaps_all": flow_check(
        "RUL-6",
        [*LOCATION, DAY, QUANTITY],
        lambda df: rules.gas_day_gaps(df, 600),
        GAPS_SQL.format(source="flows").replace("< 30", "< 600"),
    ),
    "rule_counts": flow_check(
        "RUL-7",
        ALL,
        rules.violation_counts,
        f"WITH {COUNTS_SQL.format(flows='')} SELECT * FROM counts",
    ),
    "rules_report": flow_check(
        "RUL-8",
        ALL,
        rules.rules_report,
        f"""WITH {COUNTS_SQL.format(flows='')}, t AS (SELECT * FROM counts
          UNION ALL SELECT 'Total', sum(violations)::BIGINT FROM counts)
        SELECT rule_id, {TEXT_SQL} AS description, violations FROM t""",
    ),
    "data_dictionary": flow_check(
        "PRF-1",
        [DAY, "loc_name", "connecting_pipeline", SIGN, "latitude", "longitude", QUANTITY],
        profile.data_dictionary,
        DICTIONARY_SQL,
    ),
    "profile_shape": flow_check(
        "PRF-2 DIA-16",
        ALL,
        profile.table_shape,
        f"""SELECT count(*) AS row_count, {len(ALL)}::BIGINT AS column_count,
        count(*) * {ALL_WIDTH} AS estimated_bytes FROM flows""",
    ),
    "profile_nulls": flow_check(
        "PRF-3", FLOW_TEXT, lambda df: profile.null_profile(df).drop("data_type"), NULLS_SQL
    ),
    "profile_numeric": flow_check(
        "PRF-4", [SIGN, "latitude", "longitude", QUANTITY], profile.numeric_profile, NUMERIC_SQL
    ),
    "profile_strings": flow_check("PRF-5", FLOW_TEXT, _strings, STRING_SQL),
    "profile_scores": flow_check(
        "PRF-6",
        [*FLOW_TEXT, "latitude", QUANTITY],
        lambda df: profile.quality_scores(df, [*profile.QUALITY_METRICS, "beauty"]),
        _quality_sql([*FLOW_TEXT, "latitude", QUANTITY], "flows"),
    ),
    "profile_sample": table_check(
        "PRF-7",
        "customer",
        lambda df: sample_rows(df, 5, "head", ["c_custkey"]),
        """SELECT c_custkey, c_name, CAST(c_nationkey AS BIGINT) AS c_nationkey, c_acctbal,
        c_mktsegment FROM customer ORDER BY c_custkey LIMIT 5""",
    ),
    "profile_step_stats": flow_check(
        "PRF-8",
        FLOW_TEXT,
        _step_stats,
        f"""SELECT count(*) AS row_count, {len(FLOW_TEXT)}::BIGINT AS column_count,
        count(*) * {20 * len(FLOW_TEXT)} AS estimated_bytes,
        {", ".join(f"count(*) FILTER (WHERE {c} IS NULL) AS nulls_{c}" for c in FLOW_TEXT)}
        FROM flows""",
    ),
}
