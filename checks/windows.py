"""Ranks, row-relative columns, sorts, limits and samples."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from checks.common import DAY, LOCATION, QUANTITY, Check, flow_check, r6, table_check
from weir.functions.columns import total
from weir.operators import ranking
from weir.operators.changepoint import top_contributors
from weir.operators.decompose import daily_series
from checks.filters import _year_starts

ROW = ["l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice"]
ROW_SQL = "l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, l_quantity, l_extendedprice"
RANK_SQL = {
    "average": """rank() OVER (ORDER BY {c} {d})
      + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0::DOUBLE""",
    "min": "rank() OVER (ORDER BY {c} {d})",
    "max": "rank() OVER (ORDER BY {c} {d}) + count(*) OVER (PARTITION BY {c}) - 1",
    "dense": "dense_rank() OVER (ORDER BY {c} {d})",
}


def _rank(method: str, column: str, descending: bool = False, name: str | None = None):
    def run(df: DataFrame) -> DataFrame:
        rows = df.select(*ROW)
        if name:
            return ranking.rank_step(rows, column, descending, method)
        return ranking.rank_columns(rows, [column], method, descending)

    return run


def _rank_check(covers, method, column, descending=False, name=None) -> Check:
    expr = RANK_SQL[method].format(c=column, d="DESC" if descending else "ASC")
    if method == "average":
        expr = r6(expr)
    return table_check(
        covers,
        "lineitem",
        _rank(method, column, descending, name),
        f"SELECT {ROW_SQL}, {expr} AS {name or 'rank_' + column} FROM lineitem",
    )


def _text_rank(df: DataFrame) -> DataFrame:
    return ranking.rank_columns(df.select("p_partkey", "p_name", "p_size"), ["p_name", "p_size"])


def _daily_by_location(df: DataFrame) -> DataFrame:
    return daily_series(df, LOCATION, QUANTITY)


def _shares(df: DataFrame) -> DataFrame:
    totals = df.groupBy("loc_name").agg(total(F.col(QUANTITY)).alias("volume"))
    return ranking.with_share(totals, "volume", "share")


def _percentiles(df: DataFrame) -> DataFrame:
    totals = df.groupBy("loc_name").agg(
        total(F.col(QUANTITY)).alias("volume"), F.avg(QUANTITY).alias("mean")
    )
    return ranking.percentile_ranks(totals, {"volume": "volume_pct", "mean": "mean_pct"})


def _overall(df: DataFrame) -> DataFrame:
    daily = daily_series(df, [], QUANTITY)
    return daily.withColumn("mean", ranking.overall(daily, F.avg(QUANTITY))).withColumn(
        "std", ranking.overall(daily, F.stddev_samp(QUANTITY))
    )


DAILY_SQL = """WITH d AS (SELECT pipeline_name, loc_name, eff_gas_day,
  sum(scheduled_quantity) AS scheduled_quantity FROM flows GROUP BY ALL)"""
DAY_SQL = """WITH d AS (SELECT eff_gas_day, sum(scheduled_quantity) AS scheduled_quantity
  FROM flows GROUP BY ALL)"""
LAG_SQL = """lag(scheduled_quantity) OVER (PARTITION BY pipeline_name, loc_name
  ORDER BY eff_gas_day)"""

CHECKS: dict[str, Check] = {
    "rank_average": _rank_check("WIN-1", "average", "l_extendedprice"),
    "rank_average_ties": _rank_check("WIN-1", "average", "l_quantity", True),
    "rank_min": _rank_check("WIN-1", "min", "l_quantity"),
    "rank_max": _rank_check("WIN-1", "max", "l_quantity"),
    "rank_dense": _rank_check("WIN-1", "dense", "l_extendedprice", True),
    "rank_first": table_check(
        "WIN-1",
        "lineitem",
        _rank("first", "l_quantity"),
        f"""SELECT {ROW_SQL}, row_number() OVER (ORDER BY l_quantity, l_orderkey, l_linenumber,
        l_extendedprice) AS rank_l_quantity FROM lineitem""",
    ),
    "rank_text_and_number": table_check(
        "WIN-1",
        "part",
        _text_rank,
        f"""SELECT p_partkey, p_name, CAST(p_size AS BIGINT) AS p_size,
        {r6(RANK_SQL["average"].format(c="p_name", d=""))} AS rank_p_name,
        {r6(RANK_SQL["average"].format(c="p_size", d=""))} AS rank_p_size FROM part""",
    ),
    "rank_step_ordinal": table_check(
        "WIN-2",
        "lineitem",
        _rank("ordinal", "l_quantity", True, "rank"),
        f"""SELECT {ROW_SQL}, row_number() OVER (ORDER BY l_quantity DESC, l_orderkey,
        l_linenumber, l_extendedprice) AS rank FROM lineitem""",
    ),
    "rank_step_dense": _rank_check("WIN-2", "dense", "l_quantity", True, "rank"),
    "rank_step_min": _rank_check("WIN-2", "min", "l_extendedprice", True, "rank"),
    "rank_step_max": _rank_check("WIN-2", "max", "l_quantity", False, "rank"),
    "window_difference": flow_check(
        "WIN-3",
        [*LOCATION, DAY, QUANTITY],
        lambda df: ranking.with_difference(
            _daily_by_location(df), LOCATION, [DAY], QUANTITY, "change"
        ),
        f"""{DAILY_SQL} SELECT *, {r6(f"scheduled_quantity - {LAG_SQL}")} AS change FROM d""",
    ),
    "window_previous": flow_check(
        "WIN-4",
        [*LOCATION, DAY, QUANTITY],
        lambda df: ranking.with_previous(
            _daily_by_location(df), LOCATION, [DAY], QUANTITY, "previous"
        ),
        f"{DAILY_SQL} SELECT *, {r6(LAG_SQL)} AS previous FROM d",
    ),
    "window_trailing_mean": flow_check(
        "WIN-5",
        [*LOCATION, DAY, QUANTITY],
        lambda df: ranking.with_trailing_mean(
            _daily_by_location(df), LOCATION, DAY, QUANTITY, "rolling"
        ),
        f"""{DAILY_SQL} SELECT *, CASE WHEN count(*) OVER w = 30
          THEN {r6("avg(scheduled_quantity) OVER w")} END AS rolling FROM d
        WINDOW w AS (PARTITION BY pipeline_name, loc_name ORDER BY eff_gas_day
          ROWS BETWEEN 29 PRECEDING AND CURRENT ROW)""",
    ),
    "window_overall": flow_check(
        "WIN-6",
        [DAY, QUANTITY],
        _overall,
        f"""{DAY_SQL} SELECT *, {r6("avg(scheduled_quantity) OVER ()")} AS mean,
        {r6("stddev_samp(scheduled_quantity) OVER ()")} AS std FROM d""",
    ),
    "window_share": flow_check(
        "WIN-7",
        ["loc_name", QUANTITY],
        _shares,
        f"""SELECT loc_name, {r6("sum(scheduled_quantity)")} AS volume,
        {r6("sum(scheduled_quantity) / sum(sum(scheduled_quantity)) OVER ()")} AS share
        FROM flows GROUP BY loc_name""",
    ),
    "window_percentile_rank": flow_check(
        "WIN-8",
        ["loc_name", QUANTITY],
        _percentiles,
        f"""WITH t AS (SELECT loc_name, sum(scheduled_quantity) AS volume,
          avg(scheduled_quantity) AS mean FROM flows GROUP BY ALL)
        SELECT loc_name, volume, {r6("mean")} AS mean,
        {r6(f"({RANK_SQL['average'].format(c='volume', d='')}) / count(*) OVER () * 100")}
          AS volume_pct,
        {r6(f"({RANK_SQL['average'].format(c='mean', d='')}) / count(*) OVER () * 100")}
          AS mean_pct FROM t""",
    ),
    "window_centred_mean": flow_check(
        "WIN-9",
        [*LOCATION, DAY, QUANTITY],
        lambda df: ranking.with_centred_mean(
            _daily_by_location(df), LOCATION, DAY, QUANTITY, "trend", 31
        ),
        f"""{DAILY_SQL} SELECT *, {r6("avg(scheduled_quantity) OVER w")} AS trend FROM d
        WINDOW w AS (PARTITION BY pipeline_name, loc_name ORDER BY eff_gas_day
          ROWS BETWEEN 15 PRECEDING AND 15 FOLLOWING)""",
    ),
    "window_last_days": flow_check(
        "WIN-10",
        [DAY, QUANTITY],
        lambda df: ranking.last_days(daily_series(df, [], QUANTITY), DAY, 30),
        f"{DAY_SQL} SELECT * FROM d ORDER BY eff_gas_day DESC LIMIT 30",
    ),
    "sort_top_rows": table_check(
        "SRT-1",
        "lineitem",
        lambda df: ranking.sort_rows(
            df.select(*ROW), ["l_quantity", "l_extendedprice"], descending=True, limit=50
        ),
        f"""SELECT {ROW_SQL} FROM lineitem ORDER BY l_quantity DESC, l_extendedprice DESC,
        l_orderkey, l_linenumber LIMIT 50""",
    ),
    "limit_with_offset": table_check(
        "SRT-2",
        "orders",
        lambda df: ranking.limit_rows(
            df.select("o_orderkey", "o_totalprice"),
            20,
            100,
            [F.desc("o_totalprice"), "o_orderkey"],
        ),
        """SELECT o_orderkey, o_totalprice FROM orders
        ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 100""",
    ),
    "top_k_groups": flow_check(
        "SRT-3",
        ["loc_name", QUANTITY],
        lambda df: ranking.top_k(df, ["loc_name"], k=10),
        f"""SELECT *, {r6(RANK_SQL["average"].format(c="sum_scheduled_quantity", d="DESC"))}
          AS rank_sum_scheduled_quantity
        FROM (SELECT loc_name, sum(scheduled_quantity) AS sum_scheduled_quantity FROM flows
              GROUP BY ALL) ORDER BY sum_scheduled_quantity DESC, loc_name LIMIT 10""",
    ),
    "top_changes_per_event": flow_check(
        "SRT-4",
        [*LOCATION, DAY, QUANTITY],
        lambda df: top_contributors(df, _year_starts(df), 5),
        f"""WITH events AS (SELECT min(eff_gas_day) AS d FROM flows GROUP BY year(eff_gas_day)),
        t AS (SELECT d AS changepoint_date, pipeline_name, loc_name,
          sum(CASE WHEN eff_gas_day < d THEN scheduled_quantity ELSE 0 END) AS b,
          sum(CASE WHEN eff_gas_day >= d THEN scheduled_quantity ELSE 0 END) AS a
          FROM flows JOIN events ON eff_gas_day BETWEEN d - 30 AND d + 30 GROUP BY ALL)
        SELECT changepoint_date, pipeline_name, loc_name, {r6("b")} AS before_total,
          {r6("a")} AS after_total, {r6("a - b")} AS change, {r6("abs(a - b)")} AS abs_change,
          row_number() OVER (PARTITION BY changepoint_date
            ORDER BY abs(a - b) DESC, pipeline_name, loc_name) AS place
        FROM t QUALIFY place <= 5""",
    ),
    "sample_random": table_check(
        "SRT-5",
        "lineitem",
        lambda df: ranking.sample_rows(df.select(*ROW), 100),
        f"""SELECT {", ".join(ROW).replace("l_linenumber", "l_linenumber::BIGINT AS l_linenumber")} FROM lineitem ORDER BY md5(concat_ws('|', '42', {
            ", ".join(f"coalesce('+' || CAST({c} AS VARCHAR), '-')" for c in ROW)})) LIMIT 100""",
    ),
    "sample_head": table_check(
        "SRT-5",
        "orders",
        lambda df: ranking.sample_rows(
            df.select("o_orderkey", "o_totalprice"), 100, "head", ["o_totalprice", "o_orderkey"]
        ),
        """SELECT o_orderkey, o_totalprice FROM orders
        ORDER BY o_totalprice, o_orderkey LIMIT 100""",
    ),
    "sample_tail": table_check(
        "SRT-5",
        "orders",
        lambda df: ranking.sample_rows(
            df.select("o_orderkey", "o_totalprice"), 100, "tail", ["o_totalprice", "o_orderkey"]
        ),
        """SELECT o_orderkey, o_totalprice FROM orders
        ORDER BY o_totalprice DESC, o_orderkey DESC LIMIT 100""",
    ),
}
