"""Decomposition, changepoints, event cards and clusters."""

from __future__ import annotations

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from helpers import day, flows, one, rows_of
from weir.functions.segments import best_breaks
from weir.operators import changepoint, cluster
from weir.operators.decompose import deseasonalize


def cheapest(values, min_size, penalty, jump):
    """Least total cost over every allowed set of breaks."""
    n = len(values)
    grid = [b for b in range(jump, n, jump)]

    def cost(breaks):
        edges = [0, *breaks, n]
        if any(b - a < min_size for a, b in zip(edges, edges[1:])):
            return None
        squares = sum(
            ((values[a:b] - values[a:b].mean()) ** 2).sum() for a, b in zip(edges, edges[1:])
        )
        return squares + penalty * (len(edges) - 1)

    costs = [
        (cost(chosen), chosen)
        for size in range(len(grid) + 1)
        for chosen in itertools.combinations(grid, size)
    ]
    return min((c for c in costs if c[0] is not None), key=lambda c: c[0]), cost


@pytest.mark.parametrize("seed", range(12))
@pytest.mark.parametrize("min_size, jump", [(3, 1), (4, 3), (7, 5)])
def test_breaks_are_optimal(seed, min_size, jump):
    rng = np.random.default_rng(seed)
    n = int(rng.integers(2 * min_size, 15 if jump == 1 else 40))
    values = np.cumsum(rng.normal(0, 1, n)) + rng.choice([0, 5], n)
    penalty = float(rng.uniform(0.1, 12))
    (least, _), cost = cheapest(values, min_size, penalty, jump)
    found = best_breaks(values, min_size, penalty, jump)
    assert cost(found) == pytest.approx(least)


def test_short_series_has_no_breaks():
    assert best_breaks(np.arange(13.0), 7, 1.0) == []


def planted(spark, levels, days=50, noise=3.0, **extra):
    rng = random.Random(7)
    return [
        {
            "eff_gas_day": day(i),
            "scheduled_quantity": levels[i // days] + rng.gauss(0, noise),
            **extra,
        }
        for i in range(days * len(levels))
    ]


def test_planted_break_is_found(spark):
    df = flows(spark, *planted(spark, [100.0, 200.0], noise=5.0))
    found = rows_of(changepoint.detect_changepoints(df, penalty=500.0))
    assert [r["changepoint_date"] for r in found] == [day(50)]
    row = found[0]
    assert abs(row["before_mean"] - 100) < 3 and abs(row["after_mean"] - 200) < 3
    assert row["change_magnitude"] == pytest.approx(1.0, abs=0.05)
    assert row["confidence"] > 5


def test_groups_are_separate_and_null_groups_skipped(spark):
    rows = planted(spark, [10.0, 90.0], pipeline_name="A")
    rows += planted(spark, [50.0, 50.0], pipeline_name="B")
    rows += planted(spark, [10.0, 90.0], pipeline_name=None)
    found = rows_of(
        changepoint.detect_changepoints(flows(spark, *rows), ["pipeline_name"], penalty=2000.0)
    )
    assert [(r["pipeline_name"], r["changepoint_date"]) for r in found] == [("A", day(50))]


def test_short_and_empty_series_give_an_empty_table(spark):
    df = flows(spark, *planted(spark, [1.0], days=19))
    empty = changepoint.detect_changepoints(df)
    assert empty.columns[0] == "changepoint_date" and empty.count() == 0
    assert changepoint.detect_changepoints(df.where("false"), ["pipeline_name"]).count() == 0


def test_flat_series_stays_whole(spark):
    df = flows(spark, *planted(spark, [100.0, 100.0], noise=0.5))
    assert changepoint.detect_changepoints(df, penalty=50.0, min_confidence=0.0).count() <= 2


def test_split_statistics_match_numpy(spark):
    rows = planted(spark, [10.0, 30.0], days=10)
    values = np.array([r["scheduled_quantity"] for r in rows])
    stats = changepoint.with_split_stats(flows(spark, *rows), [], "scheduled_quantity")
    row = one(stats.where(F.col("eff_gas_day") == day(13)))
    assert row["before_mean"] == pytest.approx(values[:13].mean())
    assert row["before_std"] == pytest.approx(values[:13].std())
    assert row["after_std"] == pytest.approx(values[13:].std())


@pytest.mark.parametrize(
    "options",
    [{"method": "binseg"}, {"method": "window"}, {"cost": "rbf"}],
)
def test_other_methods_raise(spark, options):
    with pytest.raises(ValueError):
        changepoint.changepoint_step(flows(spark, {}), **options)


def test_event_card_windows(spark):
    rows = [
        {"eff_gas_day": day(29), "scheduled_quantity": 1.0},  # 31 days before: outside
        {"eff_gas_day": day(30), "scheduled_quantity": 2.0},
        {"eff_gas_day": day(59), "scheduled_quantity": 4.0},
        {"eff_gas_day": day(60), "scheduled_quantity": 8.0},
        {"eff_gas_day": day(90), "scheduled_quantity": 16.0},
        {"eff_gas_day": day(91), "scheduled_quantity": 32.0},  # 31 days after: outside
        {"eff_gas_day": day(60), "scheduled_quantity": 5.0, "loc_name": "L2"},
        {"eff_gas_day": day(60), "scheduled_quantity": 5.0, "loc_name": "L3"},
    ]
    events = spark.createDataFrame([(day(60), 0.9)], "changepoint_date date, confidence double")
    card = one(changepoint.event_card(events, flows(spark, *rows), top=2))
    first, second = card["top_contributors"]
    assert (first["loc_name"], first["before_total"], first["after_total"]) == ("L1", 6.0, 24.0)
    assert (second["loc_name"], second["change"]) == ("L2", 5.0)


def test_event_without_rows_around_it_keeps_its_place(spark):
    events = spark.createDataFrame([(day(900),)], "changepoint_date date")
    card = one(changepoint.event_card(events, flows(spark, {})))
    assert card["top_contributors"] is None


def test_event_card_of_one_group(spark):
    rows = [
        {"eff_gas_day": day(60), "scheduled_quantity": q, "pipeline_name": p, "loc_name": p}
        for p, q in [("A", 5.0), ("B", 9.0)]
    ]
    events = spark.createDataFrame(
        [(day(60), "A")], "changepoint_date date, pipeline_name string"
    )
    card = one(changepoint.event_card(events, flows(spark, *rows), match=["pipeline_name"]))
    assert [c["loc_name"] for c in card["top_contributors"]] == ["A"]


def test_detection_scores(spark):
    detected = spark.createDataFrame([(day(10),), (day(50),)], "day date")
    known = spark.createDataFrame([(day(17),), (day(100),), (day(58),)], "day date")
    row = one(changepoint.score_detection(detected, known))
    assert (row["correct_detections"], row["precision"]) == (1, 0.5)
    assert row["f1_score"] == pytest.approx(0.4)
    nothing = one(changepoint.score_detection(detected.where("false"), known))
    assert nothing["f1_score"] == 0.0


def test_decomposition_adds_up(spark):
    rows = [
        {
            "eff_gas_day": day(i),
            "scheduled_quantity": 100 + 0.1 * i + 10 * (i % 7 == 0) + i % 3,
            "pipeline_name": p,
        }
        for i in range(400)
        for p in ("A", "B")
    ]
    parts = deseasonalize(flows(spark, *rows), series=["pipeline_name"], trend_window=29)
    gap = F.col("trend") + F.col("seasonal_weekly") + F.col("seasonal_annual") + F.col("residual")
    season = F.col("seasonal_weekly") + F.col("seasonal_annual")
    worst = parts.agg(
        F.max(F.abs(F.col("scheduled_quantity") - gap)),
        F.max(F.abs(F.col("scheduled_quantity") - season - F.col("deseasonalized"))),
    ).first()
    assert max(worst) < 1e-9
    means = parts.groupBy("pipeline_name").agg(F.avg("seasonal_weekly"), F.avg("seasonal_annual"))
    assert all(abs(v) < 1e-9 for r in means.collect() for v in r[1:])


def test_trend_matches_a_plain_loop(spark):
    values = [float((i * 37) % 11) for i in range(60)]
    df = flows(
        spark, *[{"eff_gas_day": day(i), "scheduled_quantity": v} for i, v in enumerate(values)]
    )
    found = deseasonalize(df, seasonal=(), trend_window=7).orderBy("eff_gas_day").collect()
    for i, row in enumerate(found):
        assert row.trend == pytest.approx(np.mean(values[max(0, i - 3) : i + 4]))
        assert row.deseasonalized == values[i]


def test_short_series_is_left_alone(spark):
    df = flows(spark, *[{"eff_gas_day": day(i), "scheduled_quantity": float(i)} for i in range(13)])
    for row in deseasonalize(df).collect():
        assert row.trend == row.deseasonalized == row.scheduled_quantity
        assert row.seasonal_weekly == row.residual == 0.0


def test_decomposition_needs_numbers(spark):
    with pytest.raises(ValueError):
        deseasonalize(flows(spark, {}), "loc_name")


def behaviours(spark):
    rng = random.Random(1)
    rows = []
    for k in range(9):
        kind = k % 3
        for i in range(60):
            base = [100.0, 1000.0, 20.0][kind] * (2.0 if i % 7 in (kind, kind + 3) else 1.0)
            swing = [1.0, 200.0, 1.0][kind]
            rows.append(
                {
                    "loc_name": f"L{k}",
                    "eff_gas_day": day(i),
                    "scheduled_quantity": max(0.0, base + rng.gauss(0, swing)),
                    "rec_del_sign": -1 if kind == 2 and i % 2 else 1,
                    "connecting_entity": f"C{i % (kind + 1)}",
                }
            )
    return flows(spark, *rows)


def test_features_by_hand(spark):
    quantities = [10.0, 30.0, 20.0]
    df = flows(
        spark,
        *[
            {
                "eff_gas_day": day(i),
                "scheduled_quantity": q,
                "rec_del_sign": s,
                "connecting_entity": c,
            }
            for i, (q, s, c) in enumerate(zip(quantities, (1, -1, -1), ("x", None, "x")))
        ],
    )
    row = one(cluster.build_features(df, min_days=3))
    assert row["mean_flow"] == 20.0 and row["season_m01"] == 1.0 and row["season_m06"] == 1.0
    assert row["dow_6"] == 0.5  # 1 January 2022 is a Saturday
    assert row["ramp_p95"] == 20.0 and row["ramp_mean"] == 5.0
    assert (row["reversals"], row["n_counterparties"], row["dependency_index"]) == (1, 2, 0.5)
    assert cluster.build_features(df, min_days=4).count() == 0


def test_standardized_features(spark):
    scaled = cluster.standardized(cluster.build_features(behaviours(spark)))
    moments = scaled.agg(F.avg("ramp_std"), F.stddev_pop("ramp_std"), F.max("season_m12")).first()
    assert moments[0] == pytest.approx(0.0, abs=1e-9)
    assert moments[1] == pytest.approx(1.0)
    assert moments[2] == 0.0


def test_clusters(spark):
    result = cluster.cluster_entities(behaviours(spark), k=3, restarts=4)
    groups = {}
    for r in rows_of(result.entities):
        groups.setdefault(r["cluster_id"], set()).add(int(r["loc_name"][1:]) % 3)
    assert sorted(len(g) for g in groups.values()) == [1, 1, 1]
    row = one(result.metrics)
    assert (row["n_entities"], row["n_clusters"], row["n_features"]) == (9, 3, 24)
    assert (row["min_cluster_size"], row["max_cluster_size"]) == (3, 3)
    assert -1 <= row["silhouette_sq_euclidean"] <= 1
    names = {r["cluster_name"] for r in rows_of(result.entities)}
    assert any("Ramp" in n or "Reversals" in n or "Dependency" in n for n in names)
    again = cluster.cluster_entities(behaviours(spark), k=3, restarts=4)
    assert rows_of(again.entities, "loc_name") == rows_of(result.entities, "loc_name")
    assert not spark.sparkContext._jsc.getPersistentRDDs()


def test_cluster_names(spark):
    zero = dict.fromkeys(cluster.CLUSTER_FEATURES, 0.0)
    rows = [
        {"cluster_id": 0, **zero, "season_m01": 2.0, "ramp_p95": -1.0, "dow_7": 0.9},
        {"cluster_id": 1, **zero, "dow_1": 0.4},
    ]
    named = cluster.cluster_names(spark.createDataFrame(rows), 3)
    found = {r["cluster_id"]: r["cluster_name"] for r in rows_of(named)}
    assert found == {0: "High_Jan_Low_Ramp", 1: "Cluster_1", 2: "Empty_2"}


def test_too_little_data_for_clusters(spark):
    with pytest.raises(ValueError):
        cluster.cluster_entities(flows(spark, {}))
    with pytest.raises(ValueError):
        cluster.build_features(flows(spark, {}), "state")
