"""The physical plans that the operators are meant to get."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from helpers import day, flows
from weir.functions.order import group_quantiles
from weir.operators import changepoint, cluster, decompose, metrics, profile, rules
from weir.operators.aggregate import aggregate, most_common
from weir.plans import named
from weir.sources.flows import read_flows


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("plans") / "flows")
    rows = [
        {"eff_gas_day": day(i % 50), "scheduled_quantity": float(i), "loc_name": f"L{i % 5}"}
        for i in range(200)
    ]
    flows(spark, *rows).repartition(3).write.parquet(path)
    return read_flows(spark, path)


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def shuffles(df) -> int:
    return plan_of(df).count("Exchange hashpartitioning")


def test_series_need_two_shuffles(table):
    """One for the daily totals, one to bring a series together; Python adds none."""
    assert shuffles(changepoint.detect_changepoints(table, ["pipeline_name"])) == 2
    assert shuffles(decompose.deseasonalize(table, series=["pipeline_name"])) == 2
    assert shuffles(cluster.build_features(table)) == 2
    assert shuffles(metrics.reversal_freq(table)) == 2


def test_one_shuffle_for_plain_metrics(table):
    assert shuffles(metrics.daily_rollup(table)) == 1
    assert shuffles(metrics.pipeline_summary(table)) == 1
    assert shuffles(rules.zero_quantity_days(table)) == 1
    assert shuffles(rules.missing_geo(table)) == 0


def test_quantiles_do_not_shuffle_the_table(table):
    plan = plan_of(group_quantiles(table, ["loc_name"], "scheduled_quantity", {"q": 0.95}))
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    # The table side of the join reads only what it needs.
    assert "ReadSchema: struct<loc_name:string,scheduled_quantity:double>" in plan


def test_no_group_is_collected_for_a_quantile(table):
    both = [{"col": "scheduled_quantity", "fn": fn} for fn in ("p95", "p50", "sum")]
    numeric = profile.numeric_profile(table)
    for df in (aggregate(table, ["loc_name"], both), aggregate(table, [], both), metrics.ramp_risk(table), numeric):
        assert "collect_list" not in plan_of(df) and "percentile" not in plan_of(df)


def test_top_values_are_cut_before_the_shuffle(table):
    plan = plan_of(most_common(table, ["loc_name", "state_abb"]))
    assert "row_number(), 3, Partial" in plan


def test_contributors_are_cut_before_the_shuffle(table):
    dates = table.select(F.col("eff_gas_day").alias("changepoint_date")).distinct()
    plan = plan_of(changepoint.top_contributors(table, dates, 5))
    assert "row_number(), 5, Partial" in plan
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_top_states_keeps_a_running_top(table):
    plan = plan_of(named.top_states(table, 5, 2022))
    assert "TakeOrderedAndProject" in plan
    assert "PushedFilters: [IsNotNull(eff_gas_day), GreaterThanOrEqual(eff_gas_day" in plan


def test_nothing_is_joined_without_a_key(table):
    for df in (
        metrics.ramp_risk(table),
        rules.violation_counts(table),
        rules.zero_quantity_streaks(table),
        cluster.standardized(cluster.build_features(table)),
    ):
        plan = plan_of(df)
        assert "NestedLoop" not in plan and "Cartesian" not in plan
