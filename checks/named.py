"""Ready-made questions and step lists."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from checks.common import DAY, LOCATION, QUANTITY, SIGN, Check, flow_check, r6
from checks.series import FEATURE_COLUMNS, FOUND, BY_PIPELINE, TOGETHER, breaks_sql, detected_sql
from checks.windows import RANK_SQL
from weir.plans import named
from weir.plans.steps import run_steps
from weir.session import work_path

AT_PIPELINE = ["pipeline_name", DAY, SIGN, QUANTITY]
SUM = f"{r6('coalesce(sum(scheduled_quantity), 0)')} AS sum_scheduled_quantity"


def _ranked(name: str, expr: str, keys: str, where: str = "TRUE", k: int = 10) -> str:
    """SQL of aggregate, average rank, first k."""
    rank = r6(RANK_SQL["average"].format(c=name, d="DESC"))
    return f"""WITH t AS (SELECT {keys}, {expr} AS {name} FROM flows WHERE {where} GROUP BY ALL)
    SELECT {keys}, {r6(name) if name != "count" else name} AS {name}, {rank} AS rank_{name}
    FROM t ORDER BY {name} DESC, {keys} LIMIT {k}"""


Y2000 = ("2000-01-01", "2000-12-31")
IN_2000 = "year(eff_gas_day) = 2000"

SAMPLE_STEPS = {
    "nodes": [
        {
            "id": "of_pipeline",
            "op": "filter",
            "params": {"column": "pipeline_name", "op": "=", "value": "ASIA"},
        },
        {
            "id": "by_state",
            "op": "aggregate",
            "params": {
                "groupby": ["state_abb"],
                "metrics": [{"col": QUANTITY, "fn": "sum"}],
            },
        },
        {"id": "first", "op": "limit", "params": {"n": 50}},
    ],
    "edges": [
        {"src": "raw", "dst": "of_pipeline"},
        {"src": "of_pipeline", "dst": "by_state"},
        {"src": "by_state", "dst": "first"},
    ],
    "inputs": ["raw"],
    "outputs": ["first"],
}


def _branching(df: DataFrame) -> DataFrame:
    """Two readers of one filter; one branch is saved, the other gives the result."""
    saved = work_path(df.sparkSession, "branch")
    spec = {
        "nodes": [
            {
                "id": "year",
                "op": "filter",
                "params": {"column": DAY, "op": "between", "value": list(Y2000)},
            },
            {
                "id": "by_day",
                "op": "resample",
                "params": {"freq": "1d", "on": DAY, "agg": {QUANTITY: "sum"}},
            },
            {"id": "saved", "op": "save_artifact", "params": {"path": saved}},
            {
                "id": "by_location",
                "op": "aggregate",
                "params": {
                    "groupby": ["loc_name"],
                    "metrics": [{"col": QUANTITY, "fn": "sum"}, {"col": QUANTITY, "fn": "p95"}],
                },
            },
            {
                "id": "ranked",
                "op": "rank",
                "params": {"by": [f"sum_{QUANTITY}"], "method": "min", "descending": True},
            },
            {"id": "top", "op": "limit", "params": {"n": 15, "offset": 5}},
        ],
        "edges": [
            {"src": "raw", "dst": "year"},
            {"src": "year", "dst": "by_day"},
            {"src": "by_day", "dst": "saved"},
            {"src": "year", "dst": "by_location"},
            {"src": "by_location", "dst": "ranked"},
            {"src": "ranked", "dst": "top"},
        ],
        "outputs": ["top"],
    }
    return run_steps(spec, {"raw": df})


def _rank_twice(df: DataFrame, keep: str) -> DataFrame:
    """A rank with two readers: the first rows, and some rows further on."""
    total = {"groupby": ["loc_name"], "metrics": [{"col": QUANTITY, "fn": "sum"}]}
    by = {"by": [f"sum_{QUANTITY}"], "method": "ordinal"}
    spec = chain(
        ("totals", "aggregate", total), ("places", "rank", by), ("front", "limit", {"n": 7})
    )
    spec["nodes"].append({"id": "further", "op": "limit", "params": {"n": 3, "offset": 7}})
    spec["edges"].append({"src": "places", "dst": "further"})
    front = run_steps(spec, {"raw": df}, keep)
    further = run_steps(spec | {"outputs": ["further"]}, {"raw": df}, keep)
    return front.withColumn("part", F.lit("first")).unionByName(
        further.withColumn("part", F.lit("next"))
    )


def _one_of(name: str):
    return lambda df: named.multi_analysis(df, [name, "summary"])[0][name]


def _regime(df: DataFrame) -> DataFrame:
    return named.regime_shifts(df, Y2000)


def chain(*steps: tuple[str, str, dict], output: str | None = None) -> dict:
    """A step list in which each (name, op, params) reads the one before it."""
    names = ["raw", *(name for name, _, _ in steps)]
    return {
        "nodes": [{"id": name, "op": op, "params": params} for name, op, params in steps],
        "edges": [{"src": a, "dst": b} for a, b in zip(names, names[1:])],
        "outputs": [output or names[-1]],
    }


def _regime_steps(df: DataFrame) -> DataFrame:
    daily = {"groupby": ["pipeline_name", DAY], "metrics": [{"col": QUANTITY, "fn": "sum"}]}
    breaks = {"column": "deseasonalized", "groupby": ["pipeline_name"], "min_size": 7}
    spec = chain(
        ("two_thousand", "filter", {"filters": [{"column": DAY, "op": "between", "value": list(Y2000)}]}),
        ("daily_flow", "aggregate", daily),
        ("without_season", "stl_deseasonalize", {"column": f"sum_{QUANTITY}"}),
        ("breaks", "changepoint", breaks | {"penalty": 1.0, "min_confidence": 0.1}),
        ("largest_first", "rank", {"by": ["change_magnitude"], "descending": True}),
        ("largest", "limit", {"n": 10}),
    )
    return run_steps(spec, {"raw": df})


OF_ASIA = TOGETHER.replace("GROUP BY", "WHERE pipeline_name = 'ASIA' GROUP BY")
SINCE_1999 = BY_PIPELINE.replace("GROUP BY", "WHERE eff_gas_day >= DATE '1999-01-01' GROUP BY")
# Deseasonalised daily totals of one year per pipeline.
DESEASONALIZED = f"""WITH s AS (SELECT pipeline_name, eff_gas_day, sum(scheduled_quantity) AS v
  FROM flows WHERE {IN_2000} GROUP BY ALL),
t AS (SELECT *, v - avg(v) OVER (PARTITION BY pipeline_name ORDER BY eff_gas_day
  ROWS BETWEEN 182 PRECEDING AND 182 FOLLOWING) AS x FROM s),
w0 AS (SELECT *, avg(x) OVER (PARTITION BY pipeline_name, isodow(eff_gas_day)) AS wr FROM t),
w AS (SELECT *, wr - avg(wr) OVER (PARTITION BY pipeline_name) AS weekly FROM w0),
a0 AS (SELECT *, avg(x - weekly) OVER (PARTITION BY pipeline_name, dayofyear(eff_gas_day)) AS ar
  FROM w)
SELECT pipeline_name AS g, eff_gas_day AS day,
  v - (weekly + (ar - avg(ar) OVER (PARTITION BY pipeline_name))) AS v FROM a0"""
REGIME_SQL = f"""WITH {breaks_sql(DESEASONALIZED, 7, 1.0, 0.1, "pipeline_name")}
SELECT pipeline_name, changepoint_date, {FOUND},
  {r6(RANK_SQL["average"].format(c="found.change_magnitude", d="DESC"))} AS rank_change_magnitude
FROM found ORDER BY found.change_magnitude DESC LIMIT 10"""
EVENTS_SQL = f"""WITH {breaks_sql(SINCE_1999, 10, 10.0, 0.01, "pipeline_name")},
top AS (SELECT * FROM found ORDER BY confidence DESC LIMIT 10),
t AS (SELECT changepoint_date AS at_day, f.pipeline_name, f.loc_name,
    sum(CASE WHEN eff_gas_day < at_day THEN scheduled_quantity ELSE 0 END) AS b,
    sum(CASE WHEN eff_gas_day >= at_day THEN scheduled_quantity ELSE 0 END) AS a
  FROM flows f JOIN (SELECT DISTINCT changepoint_date FROM top)
    ON eff_gas_day BETWEEN changepoint_date - 30 AND changepoint_date + 30 GROUP BY ALL),
best_five AS (SELECT *, row_number() OVER (PARTITION BY at_day
    ORDER BY abs(a - b) DESC, pipeline_name, loc_name) AS place FROM t QUALIFY place <= 5)
SELECT top.pipeline_name AS event_pipeline, changepoint_date, {r6("confidence")} AS confidence,
  place, best_five.pipeline_name, loc_name, {r6("b")} AS before_total, {r6("a")} AS after_total,
  {r6("a - b")} AS change, {r6("abs(a - b)")} AS abs_change
FROM top JOIN best_five ON at_day = changepoint_date"""


def _events_with_contributors(df: DataFrame) -> DataFrame:
    events = named.change_events(df, since="1999-01-01", min_confidence=0.01)
    return events.select(
        F.col("pipeline_name").alias("event_pipeline"),
        "changepoint_date",
        "confidence",
        F.inline("top_contributors"),
    )


CHECKS: dict[str, Check] = {
    "deliveries_on_day": flow_check(
        "QRY-1",
        AT_PIPELINE,
        lambda df: named.deliveries_on(df, "ASIA", "1999-03-15"),
        f"""SELECT {SUM} FROM flows WHERE pipeline_name = 'ASIA' AND rec_del_sign = -1
        AND eff_gas_day = DATE '1999-03-15'""",
    ),
    "top_states_in_year": flow_check(
        "QRY-2",
        ["state_abb", DAY, QUANTITY],
        lambda df: named.top_states(df, 5, 2000),
        f"""SELECT state_abb, {SUM} FROM flows WHERE {IN_2000} GROUP BY ALL
        ORDER BY sum_scheduled_quantity DESC, state_abb LIMIT 5""",
    ),
    "top_states_all_time": flow_check(
        "QRY-3",
        ["state_abb", QUANTITY],
        lambda df: named.top_states(df, 10),
        f"""SELECT state_abb, {SUM} FROM flows GROUP BY ALL
        ORDER BY sum_scheduled_quantity DESC, state_abb LIMIT 10""",
    ),
    "daily_deliveries": flow_check(
        "QRY-4",
        AT_PIPELINE,
        lambda df: named.daily_deliveries(df, "EUROPE", "1998-01-01", "1998-12-31"),
        f"""SELECT eff_gas_day, {SUM} FROM flows WHERE pipeline_name = 'EUROPE'
        AND rec_del_sign = -1 AND year(eff_gas_day) = 1998 GROUP BY ALL""",
    ),
    "total_receipts": flow_check(
        "QRY-5",
        ["pipeline_name", SIGN, QUANTITY],
        lambda df: named.total_receipts(df, "AFRICA"),
        f"SELECT {SUM} FROM flows WHERE pipeline_name = 'AFRICA' AND rec_del_sign = 1",
    ),
    "total_scheduled": flow_check(
        "QRY-6",
        ["pipeline_name", QUANTITY],
        lambda df: named.total_scheduled(df, "AFRICA"),
        f"SELECT {SUM} FROM flows WHERE pipeline_name = 'AFRICA'",
    ),
    "average_by_state": flow_check(
        "QRY-7",
        ["state_abb", QUANTITY],
        named.average_by_state,
        f"""SELECT state_abb, {r6("avg(scheduled_quantity)")} AS avg_scheduled_quantity
        FROM flows GROUP BY ALL""",
    ),
    "changepoints_of_one": flow_check(
        "QRY-8",
        AT_PIPELINE,
        lambda df: named.pipeline_changepoints(df, "ASIA", 0.04),
        f"""WITH {breaks_sql(OF_ASIA, 10, 10.0, 0.04, None)}
        SELECT changepoint_date, {FOUND} FROM found""",
    ),
    "changepoints_of_all": flow_check(
        "QRY-9",
        AT_PIPELINE,
        lambda df: named.all_pipeline_changepoints(df, 0.03),
        detected_sql(10, 10.0, 0.03),
    ),
    "clusters_of_locations": flow_check("QRY-10", FEATURE_COLUMNS, named.clusters_of),
    "simple_aggregation": flow_check(
        "QRY-11",
        [*LOCATION, QUANTITY],
        lambda df: named.simple_aggregation(df, LOCATION, fn="avg", limit=40),
        f"""SELECT pipeline_name, loc_name, {r6("avg(scheduled_quantity)")}
        AS avg_scheduled_quantity FROM flows GROUP BY ALL ORDER BY ALL LIMIT 40""",
    ),
    "regime_shifts": flow_check("QRY-12", AT_PIPELINE, _regime, REGIME_SQL),
    "top_ranked_groups": flow_check(
        "QRY-13",
        ["category_short", "state_abb", QUANTITY],
        lambda df: named.top_k(df, ["state_abb", "category_short"], fn="p95", k=20),
        f"""WITH t AS (SELECT state_abb, category_short,
          (list(scheduled_quantity ORDER BY scheduled_quantity))[CAST(floor((count(*) - 1)
            * 0.95::DOUBLE + 0.5::DOUBLE) AS BIGINT) + 1] AS p95_scheduled_quantity
          FROM flows GROUP BY ALL)
        SELECT *, {r6(RANK_SQL["average"].format(c="p95_scheduled_quantity", d="DESC"))}
          AS rank_p95_scheduled_quantity FROM t
        ORDER BY p95_scheduled_quantity DESC, state_abb, category_short LIMIT 20""",
    ),
    "top_variability": flow_check(
        "QRY-14",
        ["loc_name", QUANTITY],
        lambda df: named.top_variability(df, ["loc_name"]),
        _ranked("std_scheduled_quantity", "stddev_samp(scheduled_quantity)", "loc_name"),
    ),
    "average_by_state_limited": flow_check(
        "QRY-15",
        ["state_abb", QUANTITY],
        lambda df: named.average_by_state(df, 100),
        f"""SELECT state_abb, {r6("avg(scheduled_quantity)")} AS avg_scheduled_quantity
        FROM flows GROUP BY ALL ORDER BY avg_scheduled_quantity DESC LIMIT 100""",
    ),
    "sum_by_group": flow_check(
        "QRY-16",
        ["state_abb", DAY, QUANTITY],
        lambda df: named.sum_by_group(df, ["state_abb"], Y2000),
        _ranked("sum_scheduled_quantity", "sum(scheduled_quantity)", "state_abb", IN_2000),
    ),
    "daily_totals_by_group": flow_check(
        "QRY-17",
        ["state_abb", DAY, QUANTITY],
        lambda df: named.daily_totals(df, ["state_abb"], Y2000),
        f"SELECT state_abb, eff_gas_day, {SUM} FROM flows WHERE {IN_2000} GROUP BY ALL",
    ),
    "count_by_group": flow_check(
        "QRY-18",
        ["category_short", DAY, QUANTITY],
        lambda df: named.count_by_group(df, ["category_short"], Y2000),
        _ranked("count", "count(*)", "category_short", IN_2000),
    ),
    "steps_filter_aggregate_limit": flow_check(
        "QRY-19 PIP-1",
        ["pipeline_name", "state_abb", QUANTITY],
        lambda df: run_steps(SAMPLE_STEPS, {"raw": df}),
        f"SELECT state_abb, {SUM} FROM flows WHERE pipeline_name = 'ASIA' GROUP BY ALL",
    ),
    **{
        f"steps_rank_kept_{keep}": flow_check(
            "PIP-1 PIP-3 SNK-2 SNK-3",
            [*LOCATION, QUANTITY],
            lambda df, keep=keep: _rank_twice(df, keep),
            f"""WITH t AS (SELECT loc_name, {SUM} FROM flows GROUP BY ALL),
            r AS (SELECT *, row_number() OVER (ORDER BY sum_scheduled_quantity DESC, loc_name) AS rank FROM t)
            SELECT 'first' AS part, * FROM r WHERE rank <= 7
            UNION ALL SELECT 'next', * FROM r WHERE rank BETWEEN 8 AND 10""",
        )
        for keep in ("auto", "all", "never")
    },
    "steps_evidence_profile": flow_check(
        "PIP-1 PRF-2 PRF-3",
        [*LOCATION, QUANTITY],
        lambda df: run_steps(
            chain(("profile", "evidence_collect", {"metrics": ["nulls"], "columns": [*LOCATION, QUANTITY]})),
            {"raw": df},
        ),
        " UNION ALL ".join(
            f"""SELECT 'nulls' AS part, '{c}' AS column_name, name, {r6("value")} AS value FROM (
            SELECT count(*) FILTER (WHERE {c} IS NULL)::DOUBLE AS n, count(*)::DOUBLE AS k FROM flows),
            LATERAL (VALUES ('null_count', n), ('null_pct', n / k * 100)) v(name, value)"""
            for c in [*LOCATION, QUANTITY]
        ),
    ),
    "multi_analysis_summary": flow_check(
        "QRY-20",
        AT_PIPELINE,
        _one_of("summary"),
        f"""SELECT pipeline_name, {r6("sum(scheduled_quantity)")} AS total_quantity,
          {r6("avg(scheduled_quantity)")} AS avg_quantity, min(eff_gas_day) AS start_date,
          max(eff_gas_day) AS end_date, count(*) AS record_count FROM flows GROUP BY ALL""",
    ),
    "multi_analysis_seasonality": flow_check(
        "QRY-20",
        AT_PIPELINE,
        _one_of("seasonality"),
        f"""SELECT pipeline_name, month(eff_gas_day) AS month,
          {r6("avg(scheduled_quantity)")} AS avg_monthly_flow,
          {r6("stddev_samp(scheduled_quantity)")} AS std_monthly_flow,
          count(*) AS record_count FROM flows GROUP BY 1, 2""",
    ),
    "change_events": flow_check(
        "QRY-21 SRT-6",
        [*LOCATION, DAY, QUANTITY],
        _events_with_contributors,
        EVENTS_SQL,
    ),
    "steps_branching": flow_check(
        "PIP-1 PIP-3 SNK-2",
        ["loc_name", DAY, QUANTITY],
        _branching,
        f"""WITH t AS (SELECT loc_name, sum(scheduled_quantity) AS sum_scheduled_quantity,
          (list(scheduled_quantity ORDER BY scheduled_quantity))[CAST(floor((count(*) - 1)
            * 0.95::DOUBLE + 0.5::DOUBLE) AS BIGINT) + 1] AS p95_scheduled_quantity
          FROM flows WHERE {IN_2000} GROUP BY ALL)
        SELECT *, {RANK_SQL["min"].format(c="sum_scheduled_quantity", d="DESC")}
          AS rank_sum_scheduled_quantity FROM t
        ORDER BY sum_scheduled_quantity DESC, loc_name, p95_scheduled_quantity
        LIMIT 15 OFFSET 5""",
    ),
    "steps_regime_shifts": flow_check("QRY-12 PIP-1", AT_PIPELINE, _regime_steps, REGIME_SQL),
}
