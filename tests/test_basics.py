"""Predicates, aggregation, resampling, ranks, limits."""

from __future__ import annotations

from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from helpers import day, flows, one, rows_of
from weir.functions.order import (
    group_quantiles,
    order_bucket,
    with_row_position,
)
from weir.functions.predicates import check_filter, date_window, predicate
from weir.operators.aggregate import aggregate, correlation_pairs, most_common
from weir.operators.ranking import (
    limit_rows,
    rank_columns,
    rank_step,
    sample_rows,
    sort_rows,
    top_k,
    with_share,
)
from weir.operators.resample import parse_freq, resample, resample_grouped
from weir.sources.flows import flows_from_star, normalize_flows, read_flows


@pytest.mark.parametrize(
    "op, value",
    [
        ("between", [1]),
        ("between", 3),
        ("in", "abc"),
        ("is_not_null", 1),
        ("=", None),
        ("~", 1),
    ],
)
def test_filter_shapes_are_checked(op, value):
    with pytest.raises(ValueError):
        check_filter("a", op, value)


def test_null_rows_fail_every_comparison(spark):
    df = spark.createDataFrame([(1, None), (2, "x"), (3, "y")], "id int, v string")
    assert [r.id for r in df.where(predicate("v", "!=", "x")).collect()] == [3]
    assert [r.id for r in df.where(predicate("v", "is_not_null")).collect()] == [2, 3]


def test_contains_is_a_case_sensitive_pattern(spark):
    df = spark.createDataFrame([("Abc",), ("abc",), ("xbz",)], "v string")
    assert [r.v for r in df.where(predicate("v", "contains", "^a.c")).collect()] == ["abc"]


def test_between_text_that_is_no_date_compares_text(spark):
    df = spark.createDataFrame([("a",), ("m",), ("z",)], "v string")
    assert [r.v for r in df.where(predicate("v", "between", ["b", "n"])).collect()] == ["m"]


def test_date_window_ends(spark):
    df = flows(spark, *[{"eff_gas_day": day(i)} for i in range(5)])
    assert df.where(date_window(since="2022-01-02", until="2022-01-04")).count() == 3
    assert df.where(date_window(after="2022-01-02", before="2022-01-04")).count() == 1
    assert df.where(date_window(year=2021)).count() == 0
    with pytest.raises(ValueError):
        date_window(since="soon")


def test_normalize_turns_bad_values_into_null(spark):
    df = spark.createDataFrame(
        [("1", "2.5", "2022-01-03"), ("x", "y", "z")],
        "rec_del_sign string, scheduled_quantity string, eff_gas_day string",
    )
    good, bad = normalize_flows(df).orderBy(F.col("eff_gas_day").asc_nulls_last()).collect()
    assert tuple(good) == (1, 2.5, date(2022, 1, 3))
    assert tuple(bad) == (None, None, None)


def test_normalize_leaves_typed_columns_alone(spark):
    df = flows(spark, {})
    assert normalize_flows(df) is df


def test_flow_filter_reaches_the_scan(spark, tmp_path):
    path = str(tmp_path / "flows")
    flows(spark, *[{"eff_gas_day": day(i)} for i in range(5)]).write.parquet(path)
    df = read_flows(spark, path).where(date_window(since="2022-01-03")).select("loc_name")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(eff_gas_day), GreaterThanOrEqual(eff_gas_day" in plan
    assert "ReadSchema: struct<loc_name:string,eff_gas_day:date>" in plan


def test_star_view_refuses_unknown_columns(spark):
    with pytest.raises(ValueError):
        flows_from_star(spark, "/nowhere", ["county_name"])


def test_p95_is_the_nearest_value_and_p50_the_interpolated_one(spark):
    df = spark.createDataFrame([(v,) for v in (10.0, 20.0, 10.0)], "v double")
    row = one(aggregate(df, [], [{"col": "v", "fn": "p95"}, {"col": "v", "fn": "p50"}]))
    assert row == {"p95_v": 20.0, "p50_v": 10.0}
    even = spark.createDataFrame([(1.0,), (2.0,)], "v double")
    assert one(aggregate(even, [], [{"col": "v", "fn": "median"}])) == {"p50_v": 1.5}


def test_aggregate_of_nothing(spark):
    df = spark.createDataFrame([("a", None), ("b", 2.0)], "g string, v double")
    metrics = [{"col": "v", "fn": fn} for fn in ("sum", "count", "avg", "std", "p95", "p50")]
    a, b = rows_of(aggregate(df, ["g"], metrics), "g")
    assert a == {
        "g": "a",
        "sum_v": 0.0,
        "count": 1,
        "avg_v": None,
        "std_v": None,
        "p95_v": None,
        "p50_v": None,
    }
    assert b["std_v"] is None and b["p95_v"] == 2.0


def test_null_group_keeps_its_quantile(spark):
    df = spark.createDataFrame([(None, 1.0), (None, 3.0), ("b", 2.0)], "g string, v double")
    middle = aggregate(df, ["g"], [{"col": "v", "fn": "p50"}])
    assert {r["g"]: r["p50_v"] for r in rows_of(middle)} == {None: 2.0, "b": 2.0}


def test_dates_may_be_given_as_text(spark):
    df = flows(spark, *[{"eff_gas_day": day(i)} for i in range(4)])
    assert df.where(predicate("eff_gas_day", "in", ["2022-01-01", "2022-01-03"])).count() == 2
    assert df.where(predicate("eff_gas_day", "=", "2022-01-02")).count() == 1
    assert df.where(predicate("eff_gas_day", ">", "2022-01-02")).count() == 2


def test_unknown_function_raises(spark):
    df = spark.range(1)
    with pytest.raises(ValueError):
        aggregate(df, [], [{"col": "id", "fn": "mode"}])


@pytest.mark.parametrize("rows_per_bucket", [1, 10**6])
@pytest.mark.parametrize("partitions", ["1", "7"])
def test_quantiles_agree_with_sorting_whatever_the_partitioning(spark, partitions, rows_per_bucket):
    import numpy as np

    rng = np.random.default_rng(3)
    values = np.concatenate(
        [rng.normal(0, 1e-3, 300), rng.normal(5, 1e6, 300), [0.0, -0.0, 1e300, -1e-300, 7, 7, 7]]
    )
    rows = [("hot" if i % 4 else "cold", float(v)) for i, v in enumerate(values)]
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        wanted = {"q10": 0.1, "q95": 0.95, "mid": "median"}
        found = group_quantiles(
            spark.createDataFrame(rows, "g string, v double"), ["g"], "v", wanted,
            rows_per_bucket=rows_per_bucket,
        )
        for row in rows_of(found, "g"):
            own = sorted(v for g, v in rows if g == row["g"])
            n = len(own)
            assert row["q10"] == own[int((n - 1) * 0.1 + 0.5)]
            assert row["q95"] == own[int((n - 1) * 0.95 + 0.5)]
            assert row["mid"] == pytest.approx(np.median(own), rel=1e-12)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_weighted_quantiles_count_repeats(spark):
    df = spark.createDataFrame([(1.0, 5), (2.0, 1), (9.0, 0), (3.0, 4)], "v double, w int")
    row = one(group_quantiles(df, [], "v", {"mid": "median", "top": 1.0}, weight="w"))
    assert row == {"mid": 1.5, "top": 3.0}


def test_order_bucket_never_decreases(spark):
    values = [-1e300, -5.0, -4.999, -1e-9, 0.0, 1e-9, 0.5, 1.0, 1.0001, 2.0, 3.0, 1e15, 1e300]
    values += [float("inf")]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    found = [r[0] for r in df.select(order_bucket("v")).collect()]
    assert found == sorted(found)


def test_row_positions(spark):
    df = spark.range(1000).withColumn("k", (F.col("id") * 7) % 13)
    placed = with_row_position(df, ["k", "id"], "pos").orderBy("k", "id").collect()
    assert [r.pos for r in placed] == list(range(1000))


def test_correlations_of_all_pairs(spark):
    df = spark.createDataFrame([(1.0, 2.0, 3.0), (2.0, 4.0, 1.0), (3.0, 6.0, 2.0)], "a double, b double, c double")
    found = {(r["col_a"], r["col_b"]): r["correlation"] for r in rows_of(correlation_pairs(df, ["a", "b", "c"]))}
    assert found[("a", "b")] == pytest.approx(1.0)
    assert found[("a", "c")] == pytest.approx(-0.5)


def test_most_common_settles_ties_by_value(spark):
    df = spark.createDataFrame([(v,) for v in ("b", "a", "c", "d", "d", None)], "v string")
    assert [r["value"] for r in rows_of(most_common(df, ["v"]), "rank")] == ["d", "a", "b"]


@pytest.mark.parametrize("text", ["d", "0d", "1x", "", "1.5h"])
def test_bad_frequencies(text):
    with pytest.raises(ValueError):
        parse_freq(text)


def test_buckets_are_left_closed(spark):
    rows = [(datetime(2022, 1, 1, 0, 0), 1.0), (datetime(2022, 1, 1, 0, 59, 59), 2.0), (datetime(2022, 1, 1, 1), 4.0)]
    df = spark.createDataFrame(rows, "t timestamp_ntz, v double")
    found = rows_of(resample(df, "1h", "t", {"v": "sum"}), "t")
    assert [(r["t"].hour, r["v"]) for r in found] == [(0, 3.0), (1, 4.0)]


def test_weeks_start_on_monday(spark):
    df = flows(spark, {"eff_gas_day": date(2022, 1, 2)}, {"eff_gas_day": date(2022, 1, 3)})
    found = rows_of(resample(df, "1w", "eff_gas_day", {"scheduled_quantity": "count"}), "eff_gas_day")
    assert [r["eff_gas_day"] for r in found] == [date(2021, 12, 27), date(2022, 1, 3)]
    assert found[0]["scheduled_quantity_count"] == 1


def test_grouped_mean_sums_the_daily_means(spark):
    df = flows(
        spark,
        {"eff_gas_day": day(0), "scheduled_quantity": 2.0},
        {"eff_gas_day": day(0), "scheduled_quantity": 4.0},
        {"eff_gas_day": day(1), "scheduled_quantity": 10.0},
    )
    row = one(resample_grouped(df, ["loc_name", "eff_gas_day"], "1mo", fn="avg"))
    assert row["avg_scheduled_quantity"] == 13.0


def test_rank_methods_with_ties_and_nulls(spark):
    df = spark.createDataFrame([(10.0,), (20.0,), (20.0,), (30.0,), (None,)], "v double")
    expected = {
        "average": [1.0, 2.5, 2.5, 4.0, None],
        "min": [1, 2, 2, 4, None],
        "max": [1, 3, 3, 4, None],
        "dense": [1, 2, 2, 3, None],
        "first": [1, 2, 3, 4, None],
    }
    for method, ranks in expected.items():
        assert [r["rank_v"] for r in rank_columns(df, ["v"], method).collect()] == ranks
    down = rank_columns(df, ["v"], "min", descending=True).collect()
    assert [r["rank_v"] for r in down] == [1, 2, 2, 4, None]
    with pytest.raises(ValueError):
        rank_columns(df, ["v"], "ordinal")


def test_rank_step_numbers_rows(spark):
    df = spark.createDataFrame([("a", 1), ("b", 3), ("c", 3)], "k string, v int")
    found = rank_step(df, "v").collect()
    assert [(r.k, r["rank"]) for r in found] == [("b", 1), ("c", 2), ("a", 3)]


def test_text_ranks(spark):
    df = spark.createDataFrame([("b",), ("a",), ("b",), ("c",)], "v string")
    found = rank_columns(df, ["v"], "average", descending=True).collect()
    assert [(r.v, r.rank_v) for r in found] == [("c", 1.0), ("b", 2.5), ("b", 2.5), ("a", 4.0)]


def test_limits(spark):
    df = spark.range(10)
    assert [r.id for r in limit_rows(df, 3, 2, ["id"]).collect()] == [2, 3, 4]
    for bad in ({"n": 0}, {"n": 1, "offset": -1}):
        with pytest.raises(ValueError):
            limit_rows(df, **bad)


def test_sorting_puts_nulls_last(spark):
    df = spark.createDataFrame([(None,), (1,), (2,)], "v int")
    assert [r.v for r in sort_rows(df, ["v"], descending=True).collect()] == [2, 1, None]
    assert [r.v for r in sort_rows(df, ["v"], limit=2).collect()] == [1, 2]


def test_samples(spark):
    df = spark.range(50)
    assert [r.id for r in sample_rows(df, 3, "tail").collect()] == [47, 48, 49]
    assert sample_rows(df, 7).count() == 7
    assert sample_rows(df, 100).count() == 50


def test_top_k_breaks_ties_by_group(spark):
    df = flows(
        spark,
        *[{"loc_name": n, "scheduled_quantity": q} for n, q in [("b", 5.0), ("a", 5.0), ("c", 1.0)]],
    )
    found = top_k(df, ["loc_name"], k=2).collect()
    assert [(r.loc_name, r.rank_sum_scheduled_quantity) for r in found] == [("a", 1.5), ("b", 1.5)]


def test_share_of_nothing_is_null(spark):
    df = spark.createDataFrame([(0.0,), (0.0,)], "v double")
    assert [r.s for r in with_share(df, "v", "s").collect()] == [None, None]


def test_median_sign_matches_the_median(spark):
    import random

    import numpy as np

    from weir.functions.order import median_is_positive

    rng = random.Random(11)
    rows = [(g, rng.choice([-3.0, -1.0, 0.0, 1.0, 2.0, None])) for g in range(60) for _ in range(g % 7)]
    found = {
        r.g: r.positive
        for r in spark.createDataFrame(rows, "g int, v double")
        .groupBy("g")
        .agg(median_is_positive(F.col("v")).alias("positive"))
        .collect()
    }
    for g in found:
        own = [v for k, v in rows if k == g and v is not None]
        assert found[g] == (bool(own) and float(np.median(own)) > 0), own


def test_quantiles_split_and_shuffle_joined(spark):
    """Tiny limits force the finer passes and the shuffle join; the result stays the same."""
    import random

    rng = random.Random(4)
    rows = [(g, 1e9 + rng.random() * 10 ** -(g * 2)) for g in range(4) for _ in range(200)]
    rows += [(9, 5.0)] * 50
    df = spark.createDataFrame(rows, "g int, v double")
    wanted = {"mid": "median", "q": 0.7}
    usual = rows_of(group_quantiles(df, ["g"], "v", wanted), "g")
    tight = group_quantiles(df, ["g"], "v", wanted, rows_per_bucket=1, broadcast_bytes=0)
    assert rows_of(tight, "g") == usual
    for row in usual:
        own = sorted(v for g, v in rows if g == row["g"])
        assert row["q"] == own[int((len(own) - 1) * 0.7 + 0.5)]


@pytest.mark.parametrize("descending", [False, True])
@pytest.mark.parametrize("method", ["average", "min", "max", "dense"])
def test_ranks_as_by_hand(spark, method, descending):
    from weir.operators.ranking import with_rank

    df = spark.range(300).select("id", F.when(F.col("id") % 9 != 0, (F.col("id") * 7) % 41 - 20.5).alias("v"))
    values = sorted((r.v for r in df.collect() if r.v is not None), reverse=descending)
    distinct = list(dict.fromkeys(values))
    for r in rows_of(with_rank(df, "v", method, descending, "r"), "id"):
        if r["v"] is None:
            assert r["r"] is None
            continue
        low, ties = values.index(r["v"]) + 1, values.count(r["v"])
        want = {"average": low + (ties - 1) / 2, "min": low, "max": low + ties - 1, "dense": distinct.index(r["v"]) + 1}
        assert r["r"] == want[method]


def test_previous_row_crosses_partitions(spark):
    from weir.functions.order import with_previous_row

    df = spark.range(500).select((F.col("id") * 3).alias("k"))
    found = with_previous_row(df, ["k"], ["k"]).select("k", "previous.k").toDF("k", "p")
    pairs = sorted((r.k, r.p) for r in found.collect())
    assert pairs[0] == (0, None)
    assert all(p == k - 3 for k, p in pairs[1:])


def test_first_and_last_come_from_one_row(spark):
    df = spark.createDataFrame([("b", 1.0, 9), ("a", 5.0, 3), ("c", None, 1)], "k string, v double, n int")
    df = df.withColumn("t", F.to_date(F.lit("2022-01-01"))).select("t", "v", "k", "n")
    assert rows_of(resample(df, "1d", "t"))[0] | {"t": 0} == {"t": 0, "v": None, "k": "c", "n": 1}
    last = rows_of(resample(df, "1d", "t", {"n": "last", "k": "last", "v": "sum"}))[0]
    assert last | {"t": 0} == {"t": 0, "n": 3, "k": "a", "v": 6.0}


def test_null_times_are_a_bucket_at_every_frequency(spark):
    df = spark.createDataFrame([("2022-01-01 00:30:00", 1), (None, 2)], "t string, v int")
    df = df.withColumn("t", F.col("t").cast("timestamp"))
    for freq in ("15min", "1h", "1d", "3d", "1w", "1mo"):
        found = rows_of(resample(df, freq, "t", {"v": "sum"}))
        assert sorted((r["t"] is None, r["v"]) for r in found) == [(False, 1), (True, 2)], freq


def test_between_dates_on_a_text_column(spark):
    df = spark.createDataFrame([("2022-01-02",), ("no date",), (None,)], "s string")
    kept = df.where(predicate("s", "between", ["2022-01-01", "2022-01-31"]))
    assert [r.s for r in kept.collect()] == ["2022-01-02"]


def test_star_joins_the_names_of_suppliers_last(spark, tmp_path):
    tables = {
        "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_quantity double,"
        " l_discount double, l_tax double, l_returnflag string, l_linestatus string,"
        " l_shipdate timestamp",
        "orders": "o_orderkey bigint, o_custkey bigint, o_orderpriority string",
        "customer": "c_custkey bigint, c_nationkey int",
        "part": "p_partkey bigint, p_brand string",
        "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
        "nation": "n_nationkey int, n_name string, n_regionkey int",
        "region": "r_regionkey int, r_name string",
    }
    for name, columns in tables.items():
        spark.createDataFrame([], columns).write.parquet(f"{tmp_path}/{name}.parquet")
    plan = flows_from_star(spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    joins = [line for line in plan.splitlines() if "Join Inner" in line]
    # Outermost first; line items do not travel by customer.
    assert "l_suppkey" in joins[0]
    assert not [line for line in joins if "l_" in line and "custkey" in line]
    assert sum("l_" in line for line in joins) == 3
