"""Sources, filters, projections, joins and scalar functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks.common import (
    DAY,
    FLOWS,
    LOCATION,
    QUANTITY,
    SIGN,
    Check,
    flow_check,
    r6,
    table,
    table_check,
    tidy,
)
from weir.functions.columns import (
    at_least_one,
    iso_weekday,
    month_label,
    weekday_label,
)
from weir.functions.predicates import date_window
from weir.operators import basic
from weir.operators.changepoint import full_outer_totals, split_stats_at, window_totals
from weir.operators.decompose import daily_series
from weir.operators.metrics import daily_rollup
from weir.session import work_path
from weir.sources.flows import flows_from_star, normalize_flows, read_flows
from weir.sources.sinks import (
    export_results,
    load_dictionary,
    materialize,
    plot_data,
    read_daily_rollup,
    read_saved,
    save_artifact,
    saved_counts,
    write_daily_rollup,
    write_dictionary,
    write_frame,
)
from weir.operators.profile import data_dictionary

ROW = ["loc_name", DAY, QUANTITY]
ROW_SQL = "loc_name, eff_gas_day, scheduled_quantity"


def _rows(columns: list[str], *filters: dict):
    def run(df: DataFrame) -> DataFrame:
        return basic.filter_rows(df, filters).select(*columns)

    return run


def _filter(covers: str, filters: list[dict], where: str, extra: tuple[str, ...] = ()) -> Check:
    columns = [*ROW, *[c for c in extra if c not in ROW]]
    names = ", ".join(f"CAST({c} AS BIGINT) AS {c}" if c == SIGN else c for c in columns)
    return flow_check(
        covers, columns, _rows(columns, *filters), f"SELECT {names} FROM flows WHERE {where}"
    )


def _read(spark: SparkSession, folder: str) -> DataFrame:
    return read_flows(spark, f"{folder}/lineitem.parquet", ["l_suppkey", "l_shipdate", "l_quantity"])


def _broken_types(df: DataFrame) -> DataFrame:
    text = df.select(
        "l_orderkey",
        "l_linenumber",
        F.when(F.col("l_linestatus") == "O", "1")
        .when(F.col("l_linenumber") == 3, "minus one")
        .otherwise("-1")
        .alias(SIGN),
        F.when(F.col("l_linenumber") == 1, "n/a")
        .otherwise(F.col("l_quantity").cast("string"))
        .alias(QUANTITY),
        F.when(F.col("l_linenumber") == 2, "soon")
        .otherwise(F.date_format("l_shipdate", "yyyy-MM-dd"))
        .alias(DAY),
    )
    return normalize_flows(text)


ROLLUP_COLUMNS = [DAY, "pipeline_name", "state_abb", "category_short", SIGN, QUANTITY]
ROLLUP_SQL = f"""
SELECT eff_gas_day, pipeline_name, state_abb, category_short,
       {r6("sum(CASE WHEN rec_del_sign = 1 THEN scheduled_quantity ELSE 0 END)")} AS sum_receipts,
       {r6("sum(CASE WHEN rec_del_sign = -1 THEN scheduled_quantity ELSE 0 END)")}
         AS sum_deliveries,
       {r6("sum(scheduled_quantity)")} AS sum_all,
       {r6("sum(CASE WHEN rec_del_sign = 1 THEN scheduled_quantity ELSE 0 END) "
           "- sum(CASE WHEN rec_del_sign = -1 THEN scheduled_quantity ELSE 0 END)")} AS net
FROM flows GROUP BY ALL
"""


def _rollup_by_year(df: DataFrame) -> DataFrame:
    spark = df.sparkSession
    path = write_daily_rollup(daily_rollup(df), work_path(spark, "rollup"))
    return read_daily_rollup(spark, path)


def _saved(format: str):
    def run(df: DataFrame) -> DataFrame:
        spark = df.sparkSession
        totals = df.groupBy("state_abb").agg(F.sum(QUANTITY).alias("sum_scheduled_quantity"))
        folder = work_path(spark, "artifact")
        meta = save_artifact(totals, folder, "totals", format)
        return meta.select(
            "output_format", "rows", "columns", F.array_join("column_names", ",").alias("names")
        )

    return run


def _saved_rows(format: str):
    """The rows of a saved result, read back."""

    def run(df: DataFrame) -> DataFrame:
        totals = df.groupBy("state_abb").agg(F.count(F.lit(1)).alias("n"), F.max(DAY).alias("last"))
        folder = work_path(df.sparkSession, "artifact")
        save_artifact(totals, folder, "totals", format)
        return read_saved(df.sparkSession, f"{folder}/totals", totals.schema, format)

    return run


def _exported(df: DataFrame) -> DataFrame:
    """Metadata and rows of an exported answer."""
    path = work_path(df.sparkSession, "answer")
    totals = df.groupBy("state_abb").agg(F.count(F.lit(1)).alias("n"))
    about = export_results(totals, path, "How many?", "Rows per state", {"op": "count"}, "run-1")
    rows = df.sparkSession.read.schema(totals.schema).json(path)
    return rows.crossJoin(F.broadcast(about)).withColumn("columns", F.array_join("columns", ","))


def _counted(df: DataFrame) -> DataFrame:
    found = saved_counts(materialize(df.select("loc_name", "connecting_pipeline")))
    return found.select("rows", F.col("nulls.connecting_pipeline").alias("missing"))


def _passed_through(df: DataFrame) -> DataFrame:
    totals = df.groupBy("state_abb").agg(F.sum(QUANTITY).alias("sum_scheduled_quantity"))
    return write_frame(totals, work_path(df.sparkSession, "artifact"), "csv")


def _dictionary_again(df: DataFrame) -> DataFrame:
    path = write_dictionary(data_dictionary(df), work_path(df.sparkSession, "dictionary"))
    return load_dictionary(df.sparkSession, path)


PLOT_SQL = " UNION ALL ".join(
    f"""SELECT '{c}' AS column_name, {r6(f"coalesce(avg({c}), 0)")} AS mean,
    {r6(f"coalesce(stddev_samp({c}), 0)")} AS std, {r6(f"coalesce(min({c}), 0)::DOUBLE")} AS min,
    {r6(f"coalesce(max({c}), 0)::DOUBLE")} AS max, count({c}) AS count FROM lineitem"""
    for c in ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity")
)


def _derived(df: DataFrame) -> DataFrame:
    return basic.with_receipts_deliveries(basic.with_net_flow(df)).withColumn(
        "abs_net", F.abs("net_flow")
    )


def _entities(df: DataFrame) -> DataFrame:
    return basic.entities_with_days(daily_series(df, ["loc_name"], QUANTITY), "loc_name", 525)


def _active_rows(df: DataFrame) -> DataFrame:
    return df.join(basic.active_locations(df), LOCATION, "left_semi").select(*LOCATION, DAY, QUANTITY)


def _year_starts(df: DataFrame) -> DataFrame:
    """Event dates taken from the data: the first day of every year."""
    return df.groupBy(F.year(DAY).alias("y")).agg(F.min(DAY).alias("changepoint_date")).drop("y")


def _around_year_starts(df: DataFrame) -> DataFrame:
    return window_totals(df, _year_starts(df))


SCALARS = {
    "scalar_date_parse": table_check(
        "SCL-1",
        "orders",
        lambda df: df.select(
            "o_orderkey",
            F.to_date(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("parsed"),
            F.substring("o_orderpriority", 1, 10).try_cast("date").alias("failed"),
            F.make_date(F.year("o_orderdate"), F.month("o_orderdate"), F.lit(1)).alias("built"),
        ),
        """SELECT o_orderkey, CAST(strftime(o_orderdate, '%Y-%m-%d') AS DATE) AS parsed,
        TRY_CAST(substr(o_orderpriority, 1, 10) AS DATE) AS failed,
        make_date(year(o_orderdate), month(o_orderdate), 1) AS built FROM orders""",
    ),
    "scalar_date_parts": table_check(
        "SCL-2",
        "orders",
        lambda df: df.select(
            "o_orderkey",
            F.year("o_orderdate").alias("y"),
            F.quarter("o_orderdate").alias("q"),
            F.month("o_orderdate").alias("m"),
            iso_weekday("o_orderdate").alias("wd"),
            F.dayofyear("o_orderdate").alias("yd"),
        ),
        """SELECT o_orderkey, year(o_orderdate) AS y, quarter(o_orderdate) AS q,
        month(o_orderdate) AS m, isodow(o_orderdate) AS wd, dayofyear(o_orderdate) AS yd
        FROM orders""",
    ),
    "scalar_date_arithmetic": table_check(
        "SCL-3",
        "orders",
        lambda df: df.select(
            "o_orderkey",
            F.date_sub(F.col("o_orderdate").cast("date"), 30).alias("before"),
            F.date_add(F.col("o_orderdate").cast("date"), 30).alias("after"),
            F.datediff(F.lit("2001-01-01").cast("date"), F.col("o_orderdate").cast("date")).alias(
                "days"
            ),
        ),
        """SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) - INTERVAL 30 DAY AS DATE) AS before,
        CAST(CAST(o_orderdate AS DATE) + INTERVAL 30 DAY AS DATE) AS after,
        DATE '2001-01-01' - CAST(o_orderdate AS DATE) AS days FROM orders""",
    ),
    "scalar_strings": table_check(
        "SCL-4",
        "part",
        lambda df: df.select(
            "p_partkey",
            F.lower("p_type").alias("lowered"),
            F.col("p_name").rlike("^(red|blue) ").alias("coloured"),
            F.char_length("p_name").alias("length"),
            F.col("p_size").cast("string").alias("size_text"),
        ),
        """SELECT p_partkey, lower(p_type) AS lowered,
        regexp_matches(p_name, '^(red|blue) ') AS coloured, length(p_name) AS length,
        CAST(p_size AS VARCHAR) AS size_text FROM part""",
    ),
    "scalar_math": table_check(
        "SCL-5",
        "customer",
        lambda df: df.select(
            "c_custkey",
            F.abs("c_acctbal").alias("magnitude"),
            F.signum("c_acctbal").alias("direction"),
            F.pow("c_acctbal", F.lit(2)).alias("squared"),
            F.round("c_acctbal", 1).alias("rounded"),
            F.sqrt(F.abs("c_acctbal")).alias("root"),
            F.try_divide(F.col("c_acctbal"), F.col("c_nationkey")).alias("ratio"),
        ),
        f"""SELECT c_custkey, {r6("abs(c_acctbal)")} AS magnitude,
        {r6("CAST(sign(c_acctbal) AS DOUBLE)")} AS direction, {r6("c_acctbal ** 2")} AS squared,
        {r6("round(c_acctbal, 1)")} AS rounded, {r6("sqrt(abs(c_acctbal))")} AS root,
        {r6("c_acctbal / nullif(c_nationkey, 0)")} AS ratio FROM customer""",
    ),
    "scalar_bounds": table_check(
        "SCL-6",
        "customer",
        lambda df: df.select(
            "c_custkey",
            at_least_one(F.col("c_acctbal")).alias("bounded"),
            at_least_one(F.when(F.col("c_acctbal") > 0, F.col("c_acctbal"))).alias("kept_null"),
        ),
        f"""SELECT c_custkey, {r6("greatest(c_acctbal, 1.0::DOUBLE)")} AS bounded,
        {r6("CASE WHEN c_acctbal > 0 THEN greatest(c_acctbal, 1.0::DOUBLE) END")} AS kept_null
        FROM customer""",
    ),
    "scalar_conditional": table_check(
        "SCL-7",
        "lineitem",
        lambda df: df.groupBy(
            F.when(F.col("l_discount") > 0.05, "high").otherwise("low").alias("level"),
            F.col("l_returnflag").isin("A", "R").alias("returned"),
        ).agg(
            F.coalesce(F.sum(F.when(F.col("l_tax") > 0, F.col("l_quantity"))), F.lit(0.0)).alias(
                "taxed"
            ),
            F.count_if(F.when(F.col("l_tax") > 0, F.col("l_tax")).isNull()).alias("untaxed"),
        ),
        f"""SELECT CASE WHEN l_discount > 0.05::DOUBLE THEN 'high' ELSE 'low' END AS level,
        l_returnflag IN ('A', 'R') AS returned,
        {r6("coalesce(sum(l_quantity) FILTER (WHERE l_tax > 0), 0)")} AS taxed,
        count(*) FILTER (WHERE NOT l_tax > 0) AS untaxed FROM lineitem GROUP BY ALL""",
    ),
    "scalar_labels": table_check(
        "SCL-8",
        "orders",
        lambda df: df.groupBy(
            month_label(F.month("o_orderdate")).alias("month"),
            weekday_label(iso_weekday("o_orderdate")).alias("weekday"),
        ).agg(F.count(F.lit(1)).alias("count")),
        """SELECT strftime(o_orderdate, '%b') AS month, strftime(o_orderdate, '%a') AS weekday,
        count(*) AS count FROM orders GROUP BY ALL""",
    ),
    "scalar_distinct_list": table_check(
        "SCL-9 AGG-13",
        "customer",
        lambda df: df.groupBy("c_nationkey").agg(
            F.array_join(F.sort_array(F.collect_set("c_mktsegment")), ",").alias("segments")
        ),
        """SELECT CAST(c_nationkey AS BIGINT) AS c_nationkey,
        string_agg(DISTINCT c_mktsegment, ',' ORDER BY c_mktsegment) AS segments
        FROM customer GROUP BY ALL""",
    ),
}

JOIN_WINDOW_SQL = f"""
WITH events AS (SELECT min(eff_gas_day) AS d FROM flows GROUP BY year(eff_gas_day)),
t AS (
  SELECT d AS changepoint_date, pipeline_name, loc_name,
    sum(CASE WHEN eff_gas_day < d THEN scheduled_quantity ELSE 0 END) AS b,
    sum(CASE WHEN eff_gas_day >= d THEN scheduled_quantity ELSE 0 END) AS a
  FROM flows JOIN events ON eff_gas_day BETWEEN d - 30 AND d + 30 GROUP BY ALL)
SELECT changepoint_date, pipeline_name, loc_name, {r6("b")} AS before_total,
  {r6("a")} AS after_total, {r6("a - b")} AS change, {r6("abs(a - b)")} AS abs_change FROM t
"""

CHECKS: dict[str, Check] = {
    "scan_parquet": Check(
        "SRC-1",
        lambda spark, folder: tidy(_read(spark, folder)),
        "SELECT l_suppkey, l_shipdate, l_quantity FROM lineitem",
    ),
    "normalize_types": table_check(
        "SRC-2",
        "lineitem",
        _broken_types,
        """SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber,
        CAST(CASE WHEN l_linestatus = 'O' THEN 1 WHEN l_linenumber = 3 THEN NULL ELSE -1 END
          AS BIGINT) AS rec_del_sign,
        CASE WHEN l_linenumber = 1 THEN NULL ELSE l_quantity END AS scheduled_quantity,
        CASE WHEN l_linenumber = 2 THEN NULL ELSE CAST(l_shipdate AS DATE) END AS eff_gas_day
        FROM lineitem""",
    ),
    "materialized_step": flow_check(
        "SRC-3 SNK-3",
        ROLLUP_COLUMNS,
        lambda df: materialize(daily_rollup(df)),
        ROLLUP_SQL,
    ),
    "saved_parquet": flow_check(
        "SNK-1",
        ["state_abb", QUANTITY],
        _saved("parquet"),
        """SELECT 'parquet' AS output_format, count(DISTINCT state_abb) AS rows,
        2::BIGINT AS columns, 'state_abb,sum_scheduled_quantity' AS names FROM flows""",
    ),
    "saved_csv": flow_check(
        "SNK-1",
        ["state_abb", QUANTITY],
        _saved("csv"),
        """SELECT 'csv' AS output_format, count(DISTINCT state_abb) AS rows,
        2::BIGINT AS columns, 'state_abb,sum_scheduled_quantity' AS names FROM flows""",
    ),
    "saved_json": flow_check(
        "SNK-1 SNK-5",
        ["state_abb", QUANTITY],
        _saved("json"),
        """SELECT 'json' AS output_format, count(DISTINCT state_abb) AS rows,
        2::BIGINT AS columns, 'state_abb,sum_scheduled_quantity' AS names FROM flows""",
    ),
    **{
        f"saved_rows_{format}": flow_check(
            "SNK-1",
            ["state_abb", DAY],
            _saved_rows(format),
            "SELECT state_abb, count(*) AS n, max(eff_gas_day) AS last FROM flows GROUP BY ALL",
        )
        for format in ("parquet", "csv", "json")
    },
    "exported_answer": flow_check(
        "SNK-5",
        ["state_abb"],
        _exported,
        """SELECT state_abb, count(*) AS n, 'run-1' AS run_id, 'How many?' AS question,
        'Rows per state' AS description, '{"op": "count"}' AS plan,
        count(*) OVER () AS rows_returned, 'state_abb,n' AS columns FROM flows GROUP BY state_abb""",
    ),
    "saved_step_counts": flow_check(
        "SNK-3",
        ["loc_name", "connecting_pipeline"],
        _counted,
        """SELECT count(*) AS rows, count(*) FILTER (WHERE connecting_pipeline IS NULL) AS missing
        FROM flows""",
    ),
    "saved_pass_through": flow_check(
        "SNK-2",
        ["state_abb", QUANTITY],
        _passed_through,
        f"""SELECT state_abb, {r6("sum(scheduled_quantity)")} AS sum_scheduled_quantity
        FROM flows GROUP BY ALL""",
    ),
    "saved_rollup_by_year": flow_check(
        "SNK-4",
        ROLLUP_COLUMNS,
        _rollup_by_year,
        ROLLUP_SQL.replace("SELECT eff_gas_day,", "SELECT eff_gas_day, year(eff_gas_day) AS eff_gas_year,"),
    ),
    "saved_dictionary": table_check(
        "SNK-6",
        "customer",
        lambda df: _dictionary_again(df).select("column_name", "null_rate", "n_rows"),
        " UNION ALL ".join(
            f"""SELECT '{c}' AS column_name,
            {r6(f"count(*) FILTER (WHERE {c} IS NULL) / count(*)")} AS null_rate,
            count(*) AS n_rows FROM customer"""
            for c in ("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment")
        ),
    ),
    "plot_data": table_check("SNK-7", "lineitem", plot_data, PLOT_SQL),
    "filter_equals": _filter(
        "FIL-1",
        [{"column": "loc_name", "op": "=", "value": "Supplier#000000007"}],
        "loc_name = 'Supplier#000000007'",
    ),
    "filter_not_equals": _filter(
        "FIL-2",
        [{"column": "connecting_pipeline", "op": "!=", "value": "Brand#1"}],
        "connecting_pipeline <> 'Brand#1'",
        ("connecting_pipeline",),
    ),
    "filter_in": _filter(
        "FIL-3",
        [{"column": "loc_name", "op": "in", "value": ["Supplier#000000001", "Supplier#000000002"]}],
        "loc_name IN ('Supplier#000000001', 'Supplier#000000002')",
    ),
    "filter_between": _filter(
        "FIL-4",
        [{"column": QUANTITY, "op": "between", "value": [10, 12]}],
        "scheduled_quantity BETWEEN 10 AND 12",
    ),
    "filter_between_dates": _filter(
        "FIL-5",
        [{"column": DAY, "op": "between", "value": ["1999-01-01", "1999-03-31"]}],
        "eff_gas_day BETWEEN DATE '1999-01-01' AND DATE '1999-03-31'",
    ),
    "filter_between_text": _filter(
        "FIL-5",
        [{"column": "loc_name", "op": "between", "value": ["Supplier#00000001", "Supplier#00000003"]}],
        "loc_name BETWEEN 'Supplier#00000001' AND 'Supplier#00000003'",
    ),
    "filter_is_not_null": _filter(
        "FIL-6",
        [{"column": "connecting_pipeline", "op": "is_not_null"}],
        "connecting_pipeline IS NOT NULL",
        ("connecting_pipeline",),
    ),
    "filter_contains_regex": _filter(
        "FIL-7",
        [{"column": "loc_name", "op": "contains", "value": "0[1-3]$"}],
        "regexp_matches(loc_name, '0[1-3]$')",
    ),
    "filter_contains_number": _filter(
        "FIL-7",
        [{"column": SIGN, "op": "contains", "value": "-"}],
        "regexp_matches(CAST(rec_del_sign AS VARCHAR), '-')",
        (SIGN,),
    ),
    "filter_greater": _filter(
        "FIL-8", [{"column": QUANTITY, "op": ">", "value": 45}], "scheduled_quantity > 45"
    ),
    "filter_greater_equal": _filter(
        "FIL-8", [{"column": QUANTITY, "op": ">=", "value": 45}], "scheduled_quantity >= 45"
    ),
    "filter_less": _filter(
        "FIL-8", [{"column": QUANTITY, "op": "<", "value": 5}], "scheduled_quantity < 5"
    ),
    "filter_less_equal": _filter(
        "FIL-8", [{"column": QUANTITY, "op": "<=", "value": 5}], "scheduled_quantity <= 5"
    ),
    "filter_conjunction": _filter(
        "FIL-9",
        [
            {"column": SIGN, "op": "=", "value": 1},
            {"column": QUANTITY, "op": ">", "value": 20},
            {"column": DAY, "op": "between", "value": ["1998-01-01", "1999-12-31"]},
        ],
        """rec_del_sign = 1 AND scheduled_quantity > 20
        AND eff_gas_day BETWEEN DATE '1998-01-01' AND DATE '1999-12-31'""",
        (SIGN,),
    ),
    "filter_open_dates": flow_check(
        "FIL-10",
        ROW,
        lambda df: df.where(date_window(after="1999-06-30", before="1999-09-01")),
        f"""SELECT {ROW_SQL} FROM flows
        WHERE eff_gas_day > DATE '1999-06-30' AND eff_gas_day < DATE '1999-09-01'""",
    ),
    "filter_open_date_since": _filter(
        "FIL-10",
        [{"column": DAY, "op": ">=", "value": "2001-01-01"}],
        "eff_gas_day >= DATE '2001-01-01'",
    ),
    "filter_date_ranges": flow_check(
        "FIL-11",
        ROW,
        lambda df: df.where(
            date_window(year=1998) | date_window(since="2000-02-01", until="2000-02-29")
        ),
        f"""SELECT {ROW_SQL} FROM flows WHERE year(eff_gas_day) = 1998
        OR eff_gas_day BETWEEN DATE '2000-02-01' AND DATE '2000-02-29'""",
    ),
    "filter_scope": flow_check(
        "FIL-12",
        ["pipeline_name", *ROW],
        lambda df: basic.scope(df, "ASIA", "2000-01-01"),
        f"""SELECT pipeline_name, {ROW_SQL} FROM flows
        WHERE pipeline_name = 'ASIA' AND eff_gas_day >= DATE '2000-01-01'""",
    ),
    "filter_name_contains": flow_check(
        "FIL-13",
        ["pipeline_name", *ROW],
        lambda df: basic.pipelines_like(df, "aMeR"),
        f"""SELECT pipeline_name, {ROW_SQL} FROM flows
        WHERE contains(lower(pipeline_name), 'amer')""",
    ),
    "project_present_columns": flow_check(
        "PRJ-1",
        ["loc_name", DAY, QUANTITY, "latitude"],
        lambda df: basic.select_present(df, ["loc_name", "county_name", "latitude", QUANTITY]),
        "SELECT loc_name, latitude, scheduled_quantity FROM flows",
    ),
    "project_derived_columns": flow_check(
        "PRJ-2 PRJ-3 PRJ-4",
        ["loc_name", DAY, SIGN, QUANTITY],
        _derived,
        """SELECT loc_name, eff_gas_day, CAST(rec_del_sign AS BIGINT) AS rec_del_sign,
        scheduled_quantity, (rec_del_sign * scheduled_quantity) + 0.0::DOUBLE AS net_flow,
        CASE WHEN rec_del_sign = 1 THEN scheduled_quantity ELSE 0.0::DOUBLE END AS receipts,
        CASE WHEN rec_del_sign = -1 THEN scheduled_quantity ELSE 0.0::DOUBLE END AS deliveries,
        abs(rec_del_sign * scheduled_quantity) AS abs_net FROM flows""",
    ),
    "join_entities_with_days": flow_check(
        "JON-1",
        ["loc_name", DAY, QUANTITY],
        _entities,
        """WITH daily AS (SELECT loc_name, eff_gas_day, sum(scheduled_quantity)
          AS scheduled_quantity FROM flows GROUP BY ALL)
        SELECT * FROM daily WHERE loc_name IN
          (SELECT loc_name FROM daily GROUP BY loc_name HAVING count(*) >= 525)""",
    ),
    "join_active_locations": flow_check(
        "JON-2",
        [*LOCATION, DAY, QUANTITY],
        _active_rows,
        """SELECT pipeline_name, loc_name, eff_gas_day, scheduled_quantity FROM flows
        JOIN (SELECT pipeline_name, loc_name FROM flows GROUP BY ALL
              HAVING median(scheduled_quantity) > 0) USING (pipeline_name, loc_name)""",
    ),
    "join_before_after_totals": flow_check(
        "JON-3",
        [*LOCATION, DAY, QUANTITY],
        lambda df: full_outer_totals(df, "1999-07-01"),
        f"""WITH b AS (SELECT pipeline_name, loc_name, sum(scheduled_quantity) AS v FROM flows
          WHERE eff_gas_day BETWEEN DATE '1999-06-01' AND DATE '1999-06-30' GROUP BY ALL),
        a AS (SELECT pipeline_name, loc_name, sum(scheduled_quantity) AS v FROM flows
          WHERE eff_gas_day BETWEEN DATE '1999-07-01' AND DATE '1999-07-31' GROUP BY ALL)
        SELECT pipeline_name, loc_name, {r6("coalesce(b.v, 0)")} AS before_total,
          {r6("coalesce(a.v, 0)")} AS after_total,
          {r6("coalesce(a.v, 0) - coalesce(b.v, 0)")} AS change
        FROM b FULL JOIN a USING (pipeline_name, loc_name)""",
    ),
    "join_event_windows": flow_check(
        "JON-4",
        [*LOCATION, DAY, QUANTITY],
        _around_year_starts,
        JOIN_WINDOW_SQL,
    ),
    **SCALARS,
}
