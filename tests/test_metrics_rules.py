"""Hand-computed metric and rule cases."""

from __future__ import annotations

import random
import statistics

import pytest

from helpers import day, flows, one, rows_of
from weir.operators import metrics, profile, rules


def test_ramp_risk_by_hand(spark):
    quantities = [100.0, 110.0, 90.0, 100.0]
    df = flows(
        spark, *[{"eff_gas_day": day(i), "scheduled_quantity": q} for i, q in enumerate(quantities)]
    )
    row = one(metrics.ramp_risk(df))
    assert row["p95_abs_delta"] == 20.0
    assert row["median_flow"] == 100.0
    assert row["ramp_risk"] == pytest.approx(0.2)
    assert row["n_days"] == 4


def test_ramp_risk_of_a_single_day_is_zero(spark):
    row = one(metrics.ramp_risk(flows(spark, {"scheduled_quantity": 5.0})))
    assert row["ramp_risk"] == 0.0 and row["p95_abs_delta"] is None


def test_ramp_risk_of_a_hot_location(spark):
    rng = random.Random(5)
    rows = [
        {
            "loc_name": "hot" if rng.random() < 0.6 else f"L{rng.randrange(4)}",
            "eff_gas_day": day(rng.randrange(40)),
            "scheduled_quantity": rng.choice([None, 0.0, 1.5, rng.uniform(-50, 900)]),
        }
        for _ in range(600)
    ]
    found = {r["loc_name"]: r for r in rows_of(metrics.ramp_risk(flows(spark, *rows)))}
    assert len(found) == 5
    for name, r in found.items():
        own = sorted(
            (x["eff_gas_day"], -1e9 if x["scheduled_quantity"] is None else x["scheduled_quantity"])
            for x in rows if x["loc_name"] == name
        )
        values = [None if q == -1e9 else q for _, q in own]
        deltas = sorted(abs(b - a) for a, b in zip(values, values[1:]) if a is not None and b is not None)
        assert r["n_days"] == len(own)
        assert r["p95_abs_delta"] == deltas[int((len(deltas) - 1) * 0.95 + 0.5)]
        assert r["median_flow"] == pytest.approx(statistics.median(q for q in values if q is not None))


def test_reversals_by_hand(spark):
    signs = [1, -1, -1, 1]
    df = flows(
        spark,
        *[
            {"eff_gas_day": day(i), "rec_del_sign": s, "scheduled_quantity": 10.0}
            for i, s in enumerate(signs)
        ],
    )
    row = one(metrics.reversal_freq(df))
    assert (row["n_days"], row["n_reversals"], row["reversal_freq"]) == (4, 2, 0.5)


def test_zero_is_a_sign_of_its_own(spark):
    df = flows(
        spark,
        *[{"eff_gas_day": day(i), "scheduled_quantity": q} for i, q in enumerate([1.0, 0.0, 1.0])],
    )
    assert one(metrics.reversal_freq(df))["n_reversals"] == 2


def test_imbalance_guards_small_receipts(spark):
    df = flows(
        spark,
        {"eff_gas_day": day(0), "rec_del_sign": 1, "scheduled_quantity": 1000.0},
        {"eff_gas_day": day(0), "rec_del_sign": -1, "scheduled_quantity": 900.0},
        {"eff_gas_day": day(1), "rec_del_sign": -1, "scheduled_quantity": 3.0},
    )
    first, second = metrics.imbalance_pct(df).collect()
    assert first.imbalance_pct == pytest.approx(10.0) and first.net_flow == 100.0
    assert second.imbalance_pct == pytest.approx(300.0)


def test_rollup_by_hand(spark):
    df = flows(
        spark,
        {"rec_del_sign": 1, "scheduled_quantity": 7.0},
        {"rec_del_sign": -1, "scheduled_quantity": 4.0},
        {"rec_del_sign": 0, "scheduled_quantity": 2.0},
        {"rec_del_sign": 1, "scheduled_quantity": None},
    )
    row = one(metrics.daily_rollup(df))
    assert (row["sum_receipts"], row["sum_deliveries"], row["sum_all"], row["net"]) == (7, 4, 13, 3)


def test_metric_names(spark):
    with pytest.raises(ValueError):
        metrics.compute_metric(flows(spark, {}), "luck")


def rule_table(spark):
    return flows(
        spark,
        {"loc_name": "A", "scheduled_quantity": 100.0, "latitude": None},
        {"loc_name": "A", "scheduled_quantity": 100.0, "longitude": None, "state_abb": "LA"},
        {"loc_name": "B", "scheduled_quantity": 0.0, "latitude": None, "longitude": None},
        {
            "loc_name": "C",
            "connecting_pipeline": "P2",
            "category_short": "INTERCONNECT",
            "scheduled_quantity": 4000.0,
        },
        {
            "loc_name": "D",
            "connecting_pipeline": "P2",
            "category_short": "LDC",
            "rec_del_sign": -1,
            "scheduled_quantity": 200.0,
        },
        {"loc_name": "D", "connecting_pipeline": "P2", "category_short": None},
    )


def test_rule_counts(spark):
    counts = {r["rule_id"]: r["violations"] for r in rows_of(rules.violation_counts(rule_table(spark)))}
    assert counts["R-001"] == 2
    assert counts["R-002"] == 1
    assert counts["R-004"] == 1
    assert counts["R-005"] == 1


def test_rule_samples_and_report(spark):
    found = rules.run_rules(rule_table(spark))
    assert set(found) == {"summary", *rules.RULES}
    assert all(found[r].count() <= 3 for r in rules.RULES)
    report = rules.rules_report(rule_table(spark)).collect()
    assert report[-1].rule_id == "Total"
    assert report[-1].violations == sum(r.violations for r in report[:-1])


def test_scope(spark):
    counts = rules.violation_counts(rule_table(spark), pipeline="other")
    assert sum(r["violations"] for r in rows_of(counts)) == 0


def test_states_are_listed(spark):
    row = one(rules.locations_in_many_states(rule_table(spark)))
    assert (row["loc_name"], row["n_states"], row["states"]) == ("A", 2, ["LA", "TX"])


def test_rules_without_their_columns(spark):
    df = spark.createDataFrame([(1.0,)], "scheduled_quantity double")
    counts = {r["rule_id"]: r["violations"] for r in rows_of(rules.violation_counts(df))}
    assert counts.pop("R-001") == 1
    assert set(counts.values()) == {0}


def test_zero_days_counted_and_consecutive(spark):
    quantities = [5.0, 0.0, 0.0, 9.0, 0.0, 0.0, 0.0, 8.0, 9.0, 9.0, 9.0, 9.0]
    df = flows(
        spark, *[{"eff_gas_day": day(i), "scheduled_quantity": q} for i, q in enumerate(quantities)]
    )
    assert one(rules.zero_quantity_days(df, 5))["zero_days"] == 5
    streak = one(rules.zero_quantity_streaks(df, 3))
    assert (streak["streak_start"], streak["streak_end"]) == (day(4), day(6))
    assert rules.zero_quantity_streaks(df, 4).count() == 0


def test_inactive_location_has_no_zero_days(spark):
    df = flows(spark, *[{"eff_gas_day": day(i)} for i in range(10)])
    assert rules.zero_quantity_days(df, 1).count() == 0


def test_gaps(spark):
    df = flows(
        spark, *[{"eff_gas_day": day(i), "scheduled_quantity": 1.0} for i in (0, 0, 1, 5)]
    )
    row = one(rules.gas_day_gaps(df))
    assert (row["actual_days"], row["distinct_days"], row["missing_days"]) == (4, 3, 2)


def test_dictionary_of_an_empty_table(spark):
    df = flows(spark, {}).where("false")
    found = rows_of(profile.data_dictionary(df))
    assert {r["null_rate"] for r in found} == {0.0}
    assert {r["n_rows"] for r in found} == {0}
    assert {r["column_name"]: r["data_type"] for r in found}["rec_del_sign"] == "tinyint"


def test_profile_parts(spark):
    df = spark.createDataFrame(
        [(1, "aa"), (2, "aa"), (3, None), (None, "b")], "n int, s string"
    )
    parts = profile.profile(df, [*profile.QUALITY_METRICS, "charm"], 2, ["n"])
    assert one(parts["basic"]) == {"row_count": 4, "column_count": 2, "estimated_bytes": 96}
    numbers = one(parts["numeric"])
    assert (numbers["median"], numbers["q25"], numbers["unique_count"]) == (2.0, 2.0, 4)
    text = one(parts["strings"])
    assert text["unique_count"] == 3 and text["avg_length"] == pytest.approx(5 / 3)
    assert text["most_common"][0] == {"rank": 1, "value": "aa", "count": 2}
    scores = {r["metric"]: r for r in rows_of(parts["scores"])}
    assert scores["data_quality_score"]["value"] == 75.0
    assert scores["completeness"]["value"] == 75.0
    assert scores["uniqueness"]["value"] == pytest.approx(87.5)
    assert scores["charm"]["message"] == "Unknown metric: charm"
    assert parts["sample"].count() == 2


def test_rule_counts_read_the_rows_once(spark, tmp_path):
    path = str(tmp_path / "flows")
    rule_table(spark).write.parquet(path)
    counts = rules.violation_counts(spark.read.parquet(path))
    # All rules are counted from written groups; the table itself is not scanned again.
    assert not [f for f in counts.inputFiles() if "/flows/" in f]
    assert {r["rule_id"] for r in rows_of(counts)} == set(rules.RULES)


def test_rule_counts_equal_the_rules(spark):
    df = flows(
        spark,
        # Median 0.5 in both states together, and at or below zero in each of most rows.
        *[{"loc_name": None, "eff_gas_day": day(n), "scheduled_quantity": 0.0} for n in range(8)],
        *[
            {"loc_name": None, "state_abb": None, "eff_gas_day": day(n), "scheduled_quantity": 1.0}
            for n in range(8)
        ],
        {"pipeline_name": None, "eff_gas_day": None, "scheduled_quantity": None},
        {"pipeline_name": None, "rec_del_sign": -1, "scheduled_quantity": 9.0, "latitude": None},
    )
    counts = {r["rule_id"]: r["violations"] for r in rows_of(rules.violation_counts(df))}
    assert counts == {rule_id: rule(df).count() for rule_id, rule in rules.RULES.items()}
    empty = {r["rule_id"]: r["violations"] for r in rows_of(rules.violation_counts(df.limit(0)))}
    assert empty == dict.fromkeys(rules.RULES, 0)
