"""Aggregation and resampling."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from checks.common import DAY, LOCATION, QUANTITY, SIGN, Check, flow_check, p_nearest, r6, table_check
from weir.functions.columns import distinct_with_null
from weir.functions.order import group_quantiles
from weir.operators import aggregate as agg
from weir.operators.resample import monthly_trend, resample, resample_grouped

STATE_QUANTITY = ["state_abb", QUANTITY]


def _by_state(*fns: str):
    metrics = [{"col": QUANTITY, "fn": fn} for fn in fns]
    return lambda df: agg.aggregate(df, ["state_abb"], metrics)


def _state_check(covers: str, fn: str, name: str, expr: str) -> Check:
    return flow_check(
        covers,
        STATE_QUANTITY,
        _by_state(fn),
        f"SELECT state_abb, {expr} AS {name} FROM flows GROUP BY ALL",
    )


def _sum_with_nulls(df: DataFrame) -> DataFrame:
    """Only one segment of the customers has values, so most groups sum nothing."""
    some = df.withColumn("kept", F.when(F.col("c_mktsegment") == "BUILDING", F.col("c_acctbal")))
    return agg.aggregate(
        some, ["c_mktsegment"], [{"col": "kept", "fn": "sum"}, {"col": "kept", "fn": "count"}]
    )


def _first_by_key(df: DataFrame) -> DataFrame:
    order = F.struct("eff_gas_day", QUANTITY, "connecting_entity")
    return df.groupBy("loc_name").agg(
        F.min_by("connecting_entity", order).alias("first_entity"),
        F.max_by("connecting_entity", order).alias("last_entity"),
    )


def _month_means(df: DataFrame) -> DataFrame:
    return df.groupBy("loc_name").agg(
        *[
            F.avg(F.when(F.month(DAY) == m, F.col(QUANTITY))).alias(f"mean_m{m:02d}")
            for m in range(1, 13)
        ]
    )


MONTH_MEANS_SQL = ", ".join(
    f"{r6(f'avg(scheduled_quantity) FILTER (WHERE month(eff_gas_day) = {m})')} AS mean_m{m:02d}"
    for m in range(1, 13)
)
PAIR_COLUMNS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
PAIRS_SQL = " UNION ALL ".join(
    f"""SELECT '{a}' AS col_a, '{b}' AS col_b, {r6(f"corr({a}, {b})")} AS correlation
    FROM lineitem"""
    for i, a in enumerate(PAIR_COLUMNS)
    for b in PAIR_COLUMNS[i + 1 :]
)
TOP_VALUES_SQL = " UNION ALL ".join(
    f"""SELECT * FROM (SELECT '{c}' AS column_name, CAST({c} AS VARCHAR) AS value,
    count(*) AS count, row_number() OVER (ORDER BY count(*) DESC, CAST({c} AS VARCHAR) NULLS LAST)
      AS rank FROM lineitem GROUP BY {c}) WHERE rank <= 3"""
    for c in ("l_returnflag", "l_linestatus", "l_linenumber", "l_partkey")
)
ALL_FNS = ["sum", "count", "avg", "p95", "p50", "min", "max", "std", "var"]
ALL_FNS_SQL = f"""{r6("sum(scheduled_quantity)")} AS sum_scheduled_quantity, count(*) AS count,
{r6("avg(scheduled_quantity)")} AS avg_scheduled_quantity,
{r6(p_nearest("scheduled_quantity", 0.95))} AS p95_scheduled_quantity,
{r6("median(scheduled_quantity)")} AS p50_scheduled_quantity,
{r6("min(scheduled_quantity)")} AS min_scheduled_quantity,
{r6("max(scheduled_quantity)")} AS max_scheduled_quantity,
{r6("stddev_samp(scheduled_quantity)")} AS std_scheduled_quantity,
{r6("var_samp(scheduled_quantity)")} AS var_scheduled_quantity"""


def _events(freq: str, agg_spec: dict[str, str]):
    return lambda df: resample(df.select("ts", "value"), freq, "ts", agg_spec)


def _event_check(freq: str, bucket: str, covers: str = "RSM-1") -> Check:
    return table_check(
        covers,
        "events",
        _events(freq, {"value": "sum"}),
        f"SELECT {bucket} AS ts, {r6('sum(value)')} AS value FROM events GROUP BY ALL",
    )


def _resample_all(df: DataFrame) -> DataFrame:
    rows = df.select("ts", *[F.col("value").alias(c) for c in ("s", "a", "n", "lo", "hi", "f", "l")])
    spec = {"s": "sum", "a": "mean", "n": "count", "lo": "min", "hi": "max", "f": "first", "l": "last"}
    return resample(rows, "1h", "ts", spec)


CHECKS: dict[str, Check] = {
    "aggregate_grouped": flow_check(
        "AGG-1",
        [*LOCATION, QUANTITY],
        lambda df: agg.aggregate(df, LOCATION, [{"col": QUANTITY, "fn": f} for f in ALL_FNS]),
        f"SELECT pipeline_name, loc_name, {ALL_FNS_SQL} FROM flows GROUP BY ALL",
    ),
    "aggregate_global": flow_check(
        "AGG-2",
        [QUANTITY],
        lambda df: agg.aggregate(df, [], [{"col": QUANTITY, "fn": f} for f in ALL_FNS]),
        f"SELECT {ALL_FNS_SQL} FROM flows",
    ),
    "aggregate_single_metric": flow_check(
        "AGG-3",
        ["category_short", QUANTITY],
        lambda df: agg.aggregate_one(df, ["category_short"], QUANTITY, "mean"),
        f"""SELECT category_short, {r6("avg(scheduled_quantity)")} AS avg_scheduled_quantity
        FROM flows GROUP BY ALL""",
    ),
    "aggregate_sum": table_check(
        "AGG-4",
        "customer",
        _sum_with_nulls,
        f"""SELECT c_mktsegment, {r6('''coalesce(sum(c_acctbal)
          FILTER (WHERE c_mktsegment = 'BUILDING'), 0)''')} AS sum_kept,
        count(*) AS count FROM customer GROUP BY ALL""",
    ),
    "aggregate_count": _state_check("AGG-5", "count", "count", "count(*)"),
    "aggregate_mean": _state_check(
        "AGG-6", "avg", "avg_scheduled_quantity", r6("avg(scheduled_quantity)")
    ),
    "aggregate_p95": _state_check(
        "AGG-7", "p95", "p95_scheduled_quantity", r6(p_nearest("scheduled_quantity", 0.95))
    ),
    "aggregate_p95_prices": table_check(
        "AGG-7",
        "lineitem",
        lambda df: agg.aggregate(df, ["l_returnflag"], [{"col": "l_extendedprice", "fn": "p95"}]),
        f"""SELECT l_returnflag, {r6(p_nearest("l_extendedprice", 0.95))} AS p95_l_extendedprice
        FROM lineitem GROUP BY ALL""",
    ),
    "aggregate_p95_by_buckets": table_check(
        "AGG-7",
        "lineitem",
        lambda df: group_quantiles(
            df, ["l_returnflag"], "l_extendedprice", {"p95": 0.95, "p50": "median"}, None, 500
        ),
        f"""SELECT l_returnflag, {r6(p_nearest("l_extendedprice", 0.95))} AS p95,
        {r6("median(l_extendedprice)")} AS p50 FROM lineitem GROUP BY ALL""",
    ),
    "aggregate_median": table_check(
        "AGG-8",
        "customer",
        lambda df: agg.aggregate(df, ["c_nationkey"], [{"col": "c_acctbal", "fn": "p50"}]),
        f"""SELECT CAST(c_nationkey AS BIGINT) AS c_nationkey,
        {r6("median(c_acctbal)")} AS p50_c_acctbal FROM customer GROUP BY ALL""",
    ),
    "aggregate_min_max": flow_check(
        "AGG-9",
        STATE_QUANTITY,
        _by_state("min", "max"),
        f"""SELECT state_abb, {r6("min(scheduled_quantity)")} AS min_scheduled_quantity,
        {r6("max(scheduled_quantity)")} AS max_scheduled_quantity FROM flows GROUP BY ALL""",
    ),
    "aggregate_spread": flow_check(
        "AGG-10",
        STATE_QUANTITY,
        _by_state("std", "var"),
        f"""SELECT state_abb, {r6("stddev_samp(scheduled_quantity)")} AS std_scheduled_quantity,
        {r6("var_samp(scheduled_quantity)")} AS var_scheduled_quantity
        FROM flows GROUP BY ALL""",
    ),
    "aggregate_distinct_count": flow_check(
        "AGG-12",
        ["loc_name", "connecting_pipeline"],
        lambda df: df.groupBy("loc_name").agg(
            distinct_with_null("connecting_pipeline").alias("n_unique")
        ),
        """SELECT loc_name, count(DISTINCT connecting_pipeline)
        + CAST(max(CASE WHEN connecting_pipeline IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS n_unique
        FROM flows GROUP BY ALL""",
    ),
    "aggregate_distinct_rows": flow_check(
        "AGG-14",
        ["pipeline_name", "state_abb", "category_short"],
        lambda df: agg.distinct_rows(df, ["pipeline_name", "state_abb", "category_short"]),
        "SELECT DISTINCT pipeline_name, state_abb, category_short FROM flows",
    ),
    "aggregate_first": flow_check(
        "AGG-15",
        ["loc_name", DAY, QUANTITY, "connecting_entity"],
        _first_by_key,
        """SELECT loc_name,
        first(connecting_entity ORDER BY eff_gas_day, scheduled_quantity, connecting_entity)
          AS first_entity,
        first(connecting_entity ORDER BY eff_gas_day DESC, scheduled_quantity DESC,
          connecting_entity DESC) AS last_entity FROM flows GROUP BY ALL""",
    ),
    "aggregate_filtered_mean": flow_check(
        "AGG-16",
        ["loc_name", DAY, QUANTITY],
        _month_means,
        f"SELECT loc_name, {MONTH_MEANS_SQL} FROM flows GROUP BY ALL",
    ),
    "aggregate_count_true": flow_check(
        "AGG-17",
        STATE_QUANTITY,
        lambda df: df.groupBy("state_abb").agg(F.count_if(F.col(QUANTITY) > 25).alias("large")),
        """SELECT state_abb, count(*) FILTER (WHERE scheduled_quantity > 25) AS large
        FROM flows GROUP BY ALL""",
    ),
    "aggregate_conditional_sum": flow_check(
        "AGG-18",
        ["category_short", SIGN, QUANTITY],
        lambda df: df.groupBy("category_short").agg(
            F.sum(F.when(F.col(SIGN) > 0, F.col(QUANTITY)).otherwise(0.0)).alias("received")
        ),
        f"""SELECT category_short, {r6('''sum(CASE WHEN rec_del_sign > 0 THEN scheduled_quantity
          ELSE 0 END)''')} AS received FROM flows GROUP BY ALL""",
    ),
    "aggregate_top_values": table_check(
        "AGG-19",
        "lineitem",
        lambda df: agg.most_common(
            df, ["l_returnflag", "l_linestatus", "l_linenumber", "l_partkey"]
        ),
        TOP_VALUES_SQL,
    ),
    "aggregate_correlations": table_check(
        "AGG-20", "lineitem", lambda df: agg.correlation_pairs(df, PAIR_COLUMNS), PAIRS_SQL
    ),
    "aggregate_frequency": table_check(
        "AGG-21",
        "orders",
        lambda df: agg.frequency(df, F.month("o_orderdate"), "month"),
        "SELECT month(o_orderdate) AS month, count(*) AS count FROM orders GROUP BY ALL",
    ),
    "resample_15_minutes": _event_check(
        "15min", "time_bucket(INTERVAL 15 MINUTE, ts, TIMESTAMP '1970-01-01')"
    ),
    "resample_hour": _event_check("1h", "date_trunc('hour', ts)"),
    "resample_six_hours": _event_check(
        "6h", "time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01')"
    ),
    "resample_day": _event_check("1d", "CAST(date_trunc('day', ts) AS TIMESTAMP)"),
    "resample_three_days": _event_check(
        "3d", "time_bucket(INTERVAL 3 DAY, ts, TIMESTAMP '1970-01-01')"
    ),
    "resample_all_functions": table_check(
        "RSM-1",
        "events",
        _resample_all,
        f"""SELECT date_trunc('hour', ts) AS ts, {r6("sum(value)")} AS s, {r6("avg(value)")} AS a,
        count(*) AS n_count, {r6("min(value)")} AS lo, {r6("max(value)")} AS hi,
        {r6("first(value ORDER BY ts, value)")} AS f,
        {r6("first(value ORDER BY ts DESC, value DESC)")} AS l FROM events GROUP BY 1""",
    ),
    "resample_day_first": flow_check(
        "RSM-2",
        [DAY, QUANTITY, "loc_name", "state_abb"],
        lambda df: resample(df.select(DAY, QUANTITY, "loc_name", "state_abb"), "1d"),
        f"""SELECT eff_gas_day, {r6("scheduled_quantity")} AS scheduled_quantity, loc_name, state_abb
        FROM flows QUALIFY row_number() OVER (PARTITION BY eff_gas_day
          ORDER BY scheduled_quantity NULLS FIRST, loc_name NULLS FIRST, state_abb NULLS FIRST) = 1""",
    ),
    "resample_week_last": flow_check(
        "RSM-1",
        [DAY, QUANTITY, "loc_name"],
        lambda df: resample(
            df.select(DAY, QUANTITY, "loc_name"), "1w", DAY, {"loc_name": "last", QUANTITY: "last"}
        ),
        f"""SELECT CAST(date_trunc('week', eff_gas_day) AS DATE) AS eff_gas_day,
        {r6("scheduled_quantity")} AS scheduled_quantity, loc_name
        FROM flows QUALIFY row_number() OVER (PARTITION BY date_trunc('week', eff_gas_day)
          ORDER BY eff_gas_day DESC, scheduled_quantity DESC NULLS LAST, loc_name DESC NULLS LAST) = 1""",
    ),
    **{
        f"resample_null_times_{freq}": table_check(
            "RSM-1",
            "events",
            lambda df, freq=freq: resample(
                df.select(F.when(F.col("value") > 10, F.col("ts")).alias("ts"), "value"),
                freq, "ts", {"value": "count"},
            ),
            f"""SELECT date_trunc('{unit}', CASE WHEN value > 10 THEN ts END)::TIMESTAMP AS ts,
            count(*) AS value_count FROM events GROUP BY ALL""",
        )
        for freq, unit in (("1h", "hour"), ("1d", "day"))
    },
    "resample_unsorted_input": flow_check(
        "RSM-3",
        [DAY, QUANTITY],
        lambda df: resample(df.orderBy(F.desc(QUANTITY)), "1w", DAY, {QUANTITY: "mean"}),
        f"""SELECT CAST(date_trunc('week', eff_gas_day) AS DATE) AS eff_gas_day,
        {r6("avg(scheduled_quantity)")} AS scheduled_quantity FROM flows GROUP BY 1""",
    ),
    "resample_grouped_sum": flow_check(
        "RSM-4",
        ["pipeline_name", DAY, QUANTITY],
        lambda df: resample_grouped(df, ["pipeline_name", DAY], "1mo"),
        f"""SELECT pipeline_name, CAST(date_trunc('month', eff_gas_day) AS DATE) AS eff_gas_day,
        {r6("sum(scheduled_quantity)")} AS sum_scheduled_quantity FROM flows GROUP BY 1, 2""",
    ),
    "resample_grouped_mean": flow_check(
        "RSM-4",
        ["state_abb", DAY, QUANTITY],
        lambda df: resample_grouped(df, ["state_abb", DAY], "1q", fn="avg"),
        f"""WITH d AS (SELECT state_abb, eff_gas_day AS day, avg(scheduled_quantity) AS v
          FROM flows GROUP BY ALL)
        SELECT state_abb, CAST(date_trunc('quarter', day) AS DATE) AS eff_gas_day,
        {r6("sum(v)")} AS avg_scheduled_quantity FROM d GROUP BY 1, 2""",
    ),
    "resample_year": flow_check(
        "RSM-1",
        [DAY, QUANTITY],
        lambda df: resample(df, "1y", DAY, {QUANTITY: "max"}),
        f"""SELECT CAST(date_trunc('year', eff_gas_day) AS DATE) AS eff_gas_day,
        {r6("max(scheduled_quantity)")} AS scheduled_quantity FROM flows GROUP BY 1""",
    ),
    "resample_two_weeks": flow_check(
        "RSM-1",
        [DAY, QUANTITY],
        lambda df: resample(df, "2w", DAY, {QUANTITY: "count"}),
        """SELECT CAST(time_bucket(INTERVAL 14 DAY, eff_gas_day, DATE '1970-01-05') AS DATE)
          AS eff_gas_day, count(*) AS scheduled_quantity_count FROM flows GROUP BY 1""",
    ),
    "monthly_trend": flow_check(
        "RSM-5",
        [DAY, QUANTITY],
        monthly_trend,
        f"""SELECT strftime(eff_gas_day, '%Y-%m') AS month,
        {r6("sum(scheduled_quantity)")} AS sum_scheduled_quantity FROM flows GROUP BY 1""",
    ),
}
