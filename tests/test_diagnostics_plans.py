"""Diagnostics, named questions, step lists, sinks and the stream."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from helpers import day, flows, one, rows_of
from weir.operators import diagnostics as dia
from weir.operators.metrics import ROLLUP_KEYS, daily_rollup
from weir.plans import named
from weir.plans.steps import check_step, load_steps, run_steps
from weir.sources import sinks
from weir.streaming.rollup import read_rollup, start_rollup, stream_flows


def table(spark, n=40):
    rows = [
        {
            "eff_gas_day": day(i),
            "scheduled_quantity": 100.0 + i,
            "rec_del_sign": 1 if i % 2 else -1,
            "connecting_entity": ["C1", "C2", None][i % 3],
            "state_abb": ["TX", "LA"][i % 2],
            "pipeline_name": ["P1", "P2"][i % 2],
        }
        for i in range(n)
    ]
    return flows(spark, *rows)


def test_evidence_of_flows(spark):
    row = one(dia.build_evidence(table(spark)))
    assert row["data_type"] == "pipeline"
    assert row["seasonal_stats"]["data_points"] == 40
    assert row["peer_comparison"]["peer_count"] == 2
    assert row["peer_comparison"]["percentile_total"] == 75.0
    assert row["counterparty_analysis"]["counterparty_count"] == 2
    assert row["calendar_signals"]["weekend_days"] + row["calendar_signals"]["weekday_days"] == 40


def test_evidence_of_nothing_gives_defaults(spark):
    row = one(dia.build_evidence(table(spark).where("false")))
    assert row["seasonal_stats"] == {
        "z_score_current": 0.0,
        "z_score_p95": 0.0,
        "trend_direction": "stable",
        "data_points": 0,
    }
    assert row["peer_comparison"]["percentile_total"] == 50.0
    assert row["balance_analysis"]["imbalance_pct_mean"] == 0.0
    assert row["counterparty_analysis"]["hhi"] == 0.0
    assert row["calendar_signals"]["weekend_effect_pct"] == 0.0


def test_trend_direction(spark):
    def trend(step):
        rows = [{"eff_gas_day": day(i), "scheduled_quantity": 100 + step * i} for i in range(10)]
        return one(dia.seasonal_deviation(flows(spark, *rows)))["trend_direction"]

    assert trend(40.0) == "increasing"
    assert trend(0.5) == "stable"
    assert trend(-9.9) == "decreasing"


def test_concentration_by_hand(spark):
    df = flows(
        spark,
        *[
            {"connecting_entity": c, "scheduled_quantity": q}
            for c, q in [("a", 50.0), ("b", 30.0), ("c", 15.0), ("d", 5.0), (None, 900.0)]
        ],
    )
    row = one(dia.counterparty_concentration(df))
    assert row == {"hhi": 0.365, "top_3_share": 95.0, "counterparty_count": 4}


def changes(spark):
    return spark.createDataFrame(
        [
            (day(0), 0.6, 0.9, 10.0, 16.0, 1.0, 2.0),
            (day(40), 0.2, 0.4, 10.0, 8.0, 2.0, 1.0),
            (day(400), 0.1, 0.7, 0.0, 8.0, 2.0, 2.0),
        ],
        "changepoint_date date, change_magnitude double, confidence double, before_mean double,"
        " after_mean double, before_std double, after_std double",
    )


def test_evidence_of_changepoints(spark):
    row = one(dia.build_evidence(changes(spark)))
    assert row["data_type"] == "changepoint" and row["stats"]["row_count"] == 3
    assert row["magnitude_analysis"]["median_magnitude"] == 0.2
    assert row["magnitude_analysis"]["high_magnitude_count"] == 1
    assert row["confidence_analysis"]["low_confidence_count"] == 1
    volumes = row["volume_change_analysis"]
    assert (volumes["volume_increases"], volumes["volume_decreases"]) == (2, 1)
    assert volumes["avg_pct_change"] == pytest.approx(20.0)  # the zero base is left out
    years = row["temporal_analysis"]["yearly_distribution"]
    assert [(y["key"], y["count"]) for y in years] == [(2022, 2), (2023, 1)]
    assert len(row["correlation_analysis"]["correlations"]) == 15


def test_evidence_with_few_columns(spark):
    row = one(dia.build_evidence(changes(spark).select("changepoint_date", "confidence")))
    assert "confidence_analysis" in row and "magnitude_analysis" not in row


def test_evidence_of_clusters_and_others(spark):
    df = spark.createDataFrame([(0,), (0,), (2,)], "cluster_id int")
    row = one(dia.build_evidence(df))
    assert (row["total_clusters"], row["total_points"]) == (2, 3)
    other = one(dia.build_evidence(spark.range(4)))
    assert (other["data_type"], other["data_points"], other["columns"]) == ("unknown", 4, ["id"])


def test_named_questions(spark):
    df = table(spark)
    assert one(named.total_receipts(df, "P2"))["sum_scheduled_quantity"] == sum(
        100 + i for i in range(40) if i % 2
    )
    assert one(named.deliveries_on(df, "P1", "2022-01-03"))["sum_scheduled_quantity"] == 102.0
    assert one(named.deliveries_on(df, "P9", "2022-01-03"))["sum_scheduled_quantity"] == 0.0
    assert [r.state_abb for r in named.top_states(df, 1, 2022).collect()] == ["TX", "LA"][1:]
    assert named.daily_deliveries(df, "P1", "2022-01-01", "2022-01-10").count() == 5


def test_multi_analysis_reports_failures(spark):
    results, errors = named.multi_analysis(
        table(spark), ["summary", "cluster", "sky"], pipeline_part="p"
    )
    assert results["summary"].count() == 2
    assert set(errors) == {"cluster", "sky"}


def test_events_end_to_end(spark):
    rows = [
        {
            "eff_gas_day": day(i),
            "scheduled_quantity": (100.0 if i < 60 else 300.0) + (i * 7) % 5,
            "loc_name": f"L{i % 2}",
        }
        for i in range(120)
    ]
    found = rows_of(named.change_events(flows(spark, *rows), top=1, since="2022-01-05"))
    assert found[0]["changepoint_date"] == day(59) or found[0]["changepoint_date"] == day(60) or (
        abs((found[0]["changepoint_date"] - day(60)).days) <= 5
    )
    assert {c["loc_name"] for c in found[0]["top_contributors"]} == {"L0", "L1"}


SPEC = {
    "nodes": [
        {"id": "one_pipeline", "op": "filter", "params": {"column": "pipeline_name", "op": "=", "value": "P1"}},
        {
            "id": "per_state",
            "op": "aggregate",
            "params": {"groupby": ["state_abb"], "metrics": [{"col": "scheduled_quantity", "fn": "max"}]},
        },
        {"id": "head", "op": "limit", "params": {"n": 3}},
    ],
    "edges": [
        {"src": "raw", "dst": "one_pipeline"},
        {"src": "one_pipeline", "dst": "per_state"},
        {"src": "per_state", "dst": "head"},
    ],
    "inputs": ["raw"],
    "outputs": ["head"],
}


@pytest.mark.parametrize("keep", ["auto", "all", "never"])
def test_steps_from_a_file(spark, tmp_path, keep):
    path = tmp_path / "steps.json"
    path.write_text(json.dumps(SPEC))
    row = one(run_steps(load_steps(str(path)), {"raw": table(spark)}, keep))
    assert row == {
        "state_abb": "TX",
        "max_scheduled_quantity": 138.0,
    }


@pytest.mark.parametrize("keep", ["auto", "all", "never"])
def test_a_saved_rank_keeps_its_order(spark, monkeypatch, tmp_path, keep):
    """Two readers of a rank over more sort partitions than tasks, none of them merged."""
    spec = {
        "nodes": [
            {"id": "places", "op": "rank", "params": {"by": ["v"], "descending": True}},
            {"id": "copy", "op": "save_artifact", "params": {"path": str(tmp_path / "copy"), "format": "csv"}},
            {"id": "best", "op": "limit", "params": {"n": 4}},
            {"id": "later", "op": "limit", "params": {"n": 3, "offset": 500}},
        ],
        "edges": [
            {"src": "raw", "dst": "places"}, {"src": "places", "dst": "copy"},
            {"src": "copy", "dst": "best"}, {"src": "places", "dst": "later"},
        ],
        "outputs": ["best"],
    }
    settings = {"spark.sql.shuffle.partitions": "12", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    old = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        raw = spark.range(0, 3000, 1, 9).selectExpr("id AS k", "(id * 7919) % 3000 AS v")
        best = [r.v for r in run_steps(spec, {"raw": raw}, keep).collect()]
        later = [r.v for r in run_steps(spec | {"outputs": ["later"]}, {"raw": raw}, keep).collect()]
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert best == [2999, 2998, 2997, 2996] and later == [2499, 2498, 2497]


def test_evidence_is_written_when_nothing_reads_it(spark, tmp_path):
    path = str(tmp_path / "evidence")
    spec = {
        "nodes": [
            {"id": "about", "op": "evidence_collect", "params": {"metrics": ["basic", "strings"], "path": path}},
            {"id": "rows", "op": "limit", "params": {"n": 2}},
        ],
        "edges": [{"src": "raw", "dst": "about"}, {"src": "raw", "dst": "rows"}],
        "outputs": ["rows"],
    }
    assert run_steps(spec, {"raw": table(spark)}).count() == 2
    found = rows_of(spark.read.parquet(path).where("name = 'row_count'"))
    assert [r["value"] for r in found] == [float(table(spark).count())]


def changed(**parts):
    return {**SPEC, **parts}


@pytest.mark.parametrize(
    "spec",
    [
        changed(edges=[{"src": "head", "dst": "one_pipeline"}, *SPEC["edges"][1:]]),
        changed(edges=SPEC["edges"][1:]),
        changed(edges=[*SPEC["edges"], {"src": "raw", "dst": "head"}]),
        changed(edges=[*SPEC["edges"], {"src": "gone", "dst": "head"}]),
        changed(outputs=["gone"]),
        changed(nodes=[*SPEC["nodes"], SPEC["nodes"][0]]),
    ],
)
def test_broken_step_lists(spark, spec):
    with pytest.raises(ValueError):
        run_steps(spec, {"raw": table(spark)})


@pytest.mark.parametrize(
    "op, params",
    [
        ("join", {}),
        ("filter", {"column": "a", "op": "in", "value": 3}),
        ("aggregate", {"groupby": []}),
        ("aggregate", {"metrics": [{"col": "a", "fn": "mode"}]}),
        ("aggregate", {"metrics": [{"col": "a"}]}),
        ("limit", {"n": 0}),
        ("limit", {"n": 3, "offset": -2}),
        ("rank", {"by": []}),
        ("rank", {"by": ["a"], "method": "best"}),
        ("evidence_collect", {"metrics": ["charm"]}),
        ("resample", {"freq": "daily", "on": "d"}),
        ("evidence_collect", {"sample_size": 0}),
        ("changepoint", {}),
        ("save_artifact", {"path": "x", "format": "xlsx"}),
    ],
)
def test_step_parameters_are_checked(op, params):
    with pytest.raises(ValueError):
        check_step(op, params)


@pytest.mark.parametrize("format", ["parquet", "csv", "json"])
def test_artifacts(spark, tmp_path, format):
    df = spark.createDataFrame([(1, "a", 2.5), (2, None, None)], "n int, s string, v double")
    meta = one(
        sinks.save_artifact(df, str(tmp_path), "result", format, include_plots=True)
    )
    assert (meta["rows"], meta["columns"], meta["column_names"]) == (2, 3, ["n", "s", "v"])
    assert meta["column_types"]["v"] == "double" and len(meta["saved_files"]) == 2
    back = sinks.read_saved(spark, str(tmp_path / "result"), df.schema, format)
    assert rows_of(back, "n") == rows_of(df, "n")
    with pytest.raises(Exception, match="already exists"):
        sinks.write_frame(df, str(tmp_path / "result"), format, overwrite=False)


def test_unknown_format(spark, tmp_path):
    with pytest.raises(ValueError):
        sinks.write_frame(spark.range(1), str(tmp_path / "x"), "xlsx")


def test_export_and_dictionary(spark, tmp_path):
    from weir.operators.profile import data_dictionary

    about = one(sinks.export_results(spark.range(2), str(tmp_path / "answer"), "how many?", plan={"n": 2}))
    assert (about["question"], about["rows_returned"], about["columns"]) == ("how many?", 2, ["id"])
    assert json.loads(about["plan"]) == {"n": 2} and about["run_id"]
    assert spark.read.json(str(tmp_path / "answer")).count() == 2
    dictionary = data_dictionary(table(spark))
    sinks.write_dictionary(dictionary, str(tmp_path / "dictionary"))
    again = sinks.load_dictionary(spark, str(tmp_path / "dictionary"))
    assert rows_of(again, "column_name") == rows_of(dictionary, "column_name")


def test_rollup_prunes_years(spark, tmp_path):
    df = flows(spark, *[{"eff_gas_day": day(200 * i), "scheduled_quantity": 1.0} for i in range(5)])
    path = sinks.write_daily_rollup(daily_rollup(df), str(tmp_path / "rollup"))
    year = sinks.read_daily_rollup(spark, path).where(F.col("eff_gas_year") == 2023)
    assert year.count() == 2
    assert "PartitionFilters: [isnotnull(eff_gas_year" in (
        year._jdf.queryExecution().executedPlan().toString()
    )


def test_stream_and_batch_rollups_agree(spark, tmp_path):
    folder, target = str(tmp_path / "in"), str(tmp_path / "out")
    parts = [table(spark, 30), table(spark, 10), table(spark, 40)]
    for number, part in enumerate(parts):
        part.coalesce(1).write.mode("append").parquet(folder)
        stream = stream_flows(spark, folder, part.schema)
        start_rollup(stream, target, str(tmp_path / "checkpoint")).awaitTermination()
        batch = daily_rollup(spark.read.parquet(folder))
        found = rows_of(read_rollup(spark, target), *ROLLUP_KEYS)
        assert found == rows_of(batch, *ROLLUP_KEYS), number


def test_evidence_reads_the_rows_once(spark, tmp_path):
    path = str(tmp_path / "flows")
    table(spark).write.parquet(path)
    read = spark.read.parquet(path)
    evidence = dia.flow_evidence(read, "state")
    # Every part works on written sums; the table itself is not scanned again.
    assert not [f for f in evidence.inputFiles() if "/flows/" in f]
    row = one(evidence)
    assert row["calendar_signals"] == one(dia.weekend_effect(read))
    assert row["peer_comparison"] == one(dia.peer_contrast(read, "state"))
    assert row["balance_analysis"] == one(dia.balance_residual(read))
    assert row["counterparty_analysis"] == one(dia.counterparty_concentration(read))
    assert row["seasonal_stats"] == one(dia.seasonal_deviation(read))
