from __future__ import annotations

import re

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from helpers import day, flows, rows_of
from weir import session
from weir.operators import metrics
from weir.operators.decompose import deseasonalize
from weir.session import build_session, read_twice, work_dir, work_path


def test_work_folder_is_the_configured_one(spark):
    assert work_dir(spark) == spark.sparkContext.getConf().get("spark.checkpoint.dir")
    assert work_path(spark, "a") != work_path(spark, "a")


def test_build_session_returns_the_running_one(spark):
    assert build_session().sparkContext is spark.sparkContext


def test_plain_frames_are_read_again(spark):
    df = spark.range(5).where("id > 1").withColumn("v", F.col("id") * 2)
    assert read_twice(df) is df
    joined = df.join(spark.range(9).toDF("k"), F.col("id") == F.col("k"))
    assert read_twice(joined) is joined


@pytest.mark.parametrize(
    "change",
    [
        lambda df: df.groupBy("id").agg(F.sum("id").alias("s")),
        lambda df: df.withColumn("n", F.row_number().over(Window.orderBy("id"))),
        lambda df: df.limit(2),
        lambda df: df.withColumn("r", F.rand(1)),
        lambda df: df.groupBy("id").applyInPandas(lambda p: p, "id long"),
    ],
)
def test_frames_that_may_change_are_saved(spark, change):
    df = change(spark.range(5))
    saved = read_twice(df)
    assert saved is not df
    assert read_twice(saved) is saved


def test_windows_of_series_run_in_tasks_by_input(spark, tmp_path, monkeypatch):
    first = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
    path = str(tmp_path / "flows")
    rows = [
        {"loc_name": f"L{n % 5}", "eff_gas_day": day(n), "scheduled_quantity": float(n)}
        for n in range(90)
    ]
    flows(spark, *rows).write.parquet(path)
    read = spark.read.parquet(path)
    assert session.tasks_by_input(read) is None
    usual = rows_of(deseasonalize(read, series=["loc_name"]), "loc_name", "eff_gas_day")
    monkeypatch.setattr(session, "BYTES_PER_TASK", 100)
    try:
        tasks = session.tasks_by_input(read)
        assert tasks > 4
        found = deseasonalize(read, series=["loc_name"])
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert re.search(rf"hashpartitioning\(loc_name#\d+, {tasks}\), REPARTITION_BY_NUM", plan)
        assert rows_of(found, "loc_name", "eff_gas_day") == usual
    finally:
        spark.conf.unset(first)


def test_changes_between_rows_are_found_in_tasks_by_input(spark, tmp_path, monkeypatch):
    first = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
    path = str(tmp_path / "flows of [1] day")
    rows = [
        {"loc_name": f"L{n % 5}", "eff_gas_day": day(n // 7), "scheduled_quantity": n * 31.5 % 17}
        for n in range(90)
    ]
    flows(spark, *rows).write.parquet(path)
    read = spark.read.parquet(path.replace("[", "\\[").replace("]", "\\]"))
    usual = rows_of(metrics.ramp_risk(read), "loc_name")
    monkeypatch.setattr(session, "BYTES_PER_TASK", 100)
    try:
        tasks = session.tasks_by_input(read)
        assert tasks > 4
        plan = metrics.row_changes(read)._jdf.queryExecution().executedPlan().toString()
        # Rows by key and day, and the days by key, each in as many tasks as the input asks for.
        dealt = re.findall(rf"hashpartitioning\(([^)]*), {tasks}\), REPARTITION_BY_NUM", plan)
        assert any("eff_gas_day" in keys for keys in dealt)
        assert any("eff_gas_day" not in keys for keys in dealt)
        assert rows_of(metrics.ramp_risk(read), "loc_name") == usual
    finally:
        spark.conf.unset(first)
