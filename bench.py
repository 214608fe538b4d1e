"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

The star tables are laid out once as a flow table (``load_flows``, not in the total); the
queries read that table, as a user's queries read a flow file. Each query is the best of
$BENCH_REPEAT runs (default 2), so that compilation is counted once at most.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from weir.functions.predicates import date_window  # noqa: E402
from weir.operators import (  # noqa: E402
    aggregate,
    changepoint,
    cluster,
    decompose,
    diagnostics,
    metrics,
    profile,
    ranking,
    resample,
    rules,
)
from weir.plans import named  # noqa: E402
from weir.sources.flows import flows_from_star, read_flows  # noqa: E402

QUANTITY = "scheduled_quantity"
SUM = [{"col": QUANTITY, "fn": "sum"}]
BY_PIPELINE = ["pipeline_name"]

QUERIES = {
    "sum_by_pipeline": lambda f: aggregate.aggregate(f, BY_PIPELINE, SUM),
    "sum_by_pipeline_ranked": lambda f: named.sum_by_group(f, BY_PIPELINE, None, 10),
    "deliveries_in_year": lambda f: named.daily_deliveries(f, "ASIA", "2000-01-01", "2000-12-31"),
    "top_states_in_year": lambda f: named.top_states(f, 5, 2000),
    "monthly_trend": lambda f: resample.monthly_trend(f),
    "seasonality": lambda f: metrics.monthly_seasonality(f),
    "p95_by_location": lambda f: aggregate.aggregate(
        f, ["loc_name"], [{"col": QUANTITY, "fn": "p95"}]
    ),
    "rank_all_rows": lambda f: ranking.rank_columns(
        f.select("loc_name", "eff_gas_day", QUANTITY), [QUANTITY]
    ),
    "daily_rollup": lambda f: metrics.daily_rollup(f),
    "ramp_risk": lambda f: metrics.ramp_risk(f),
    "reversal_freq": lambda f: metrics.reversal_freq(f),
    "imbalance_pct": lambda f: metrics.imbalance_pct(f),
    "rules": lambda f: rules.violation_counts(f),
    "profile_numeric": lambda f: profile.numeric_profile(f),
    "profile_strings": lambda f: profile.string_profile(f),
    "decompose": lambda f: decompose.deseasonalize(f, series=BY_PIPELINE),
    "changepoints_by_location": lambda f: changepoint.detect_changepoints(
        f, ["loc_name"], penalty="bic", min_confidence=0.0
    ),
    "changepoints_of_state": lambda f: changepoint.detect_changepoints(
        f.where("state_abb = 'NATION_3'"), None, min_confidence=0.0
    ),
    "regime_shifts": lambda f: named.regime_shifts(f, ("2000-01-01", "2000-12-31")),
    "change_events": lambda f: named.change_events(f, min_confidence=0.05),
    "flow_evidence": lambda f: diagnostics.build_evidence(f),
    "cluster_features": lambda f: cluster.build_features(f),
    "cluster_counterparties": lambda f: cluster.cluster_summary(f, "counterparty"),
    "filter_count": lambda f: aggregate.aggregate(
        f.where(date_window(since="2001-01-01")), [], [{"col": QUANTITY, "fn": "count"}]
    ),
}


def session(cpus: str) -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("weir-bench")
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "12g"))
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    repeat = int(os.environ.get("BENCH_REPEAT", "2"))
    only = sys.argv[1:]
    spark = session(cpus)
    seconds: dict[str, float] = {}
    with tempfile.TemporaryDirectory(prefix="weir-bench-") as scratch:
        path = os.path.join(scratch, "flows")
        start = time.perf_counter()
        flows_from_star(spark, folder).repartition(int(cpus)).write.parquet(path)
        load_seconds = round(time.perf_counter() - start, 3)
        flows = read_flows(spark, path)
        for name, query in QUERIES.items():
            if only and name not in only:
                continue
            runs = []
            for _ in range(repeat):
                spark.catalog.clearCache()
                start = time.perf_counter()
                query(flows).write.format("noop").mode("overwrite").save()
                runs.append(time.perf_counter() - start)
            seconds[name] = round(min(runs), 3)
            print(name, [round(r, 2) for r in runs], file=sys.stderr, flush=True)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "flow_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "load_flows": load_seconds,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
