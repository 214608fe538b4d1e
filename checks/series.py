"""Decomposition, changepoints and clustering."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from checks.common import DAY, LOCATION, QUANTITY, SIGN, Check, flow_check, p_nearest, r6
from checks.filters import _year_starts
from weir.functions.columns import MONTH_NAMES, WEEKDAY_NAMES
from weir.operators import changepoint, cluster
from weir.operators.decompose import daily_series, deseasonalize, with_seasonal
from weir.session import written

SERIES_SQL = """WITH s AS (SELECT pipeline_name, eff_gas_day, sum(scheduled_quantity) AS v
  FROM flows GROUP BY ALL)"""
STL_SQL = f"""{SERIES_SQL},
t AS (SELECT *, avg(v) OVER (PARTITION BY pipeline_name ORDER BY eff_gas_day
  ROWS BETWEEN 182 PRECEDING AND 182 FOLLOWING) AS trend FROM s),
w0 AS (SELECT *, v - trend AS x, avg(v - trend) OVER (PARTITION BY pipeline_name,
  isodow(eff_gas_day)) AS wr FROM t),
w AS (SELECT *, wr - avg(wr) OVER (PARTITION BY pipeline_name) AS weekly FROM w0),
a0 AS (SELECT *, x - weekly AS y, avg(x - weekly) OVER (PARTITION BY pipeline_name,
  dayofyear(eff_gas_day)) AS ar FROM w),
a AS (SELECT *, ar - avg(ar) OVER (PARTITION BY pipeline_name) AS annual FROM a0)
SELECT pipeline_name, eff_gas_day, {r6("v")} AS scheduled_quantity,
  {r6("v - (weekly + annual)")} AS deseasonalized, {r6("trend")} AS trend,
  {r6("weekly")} AS seasonal_weekly, {r6("annual")} AS seasonal_annual,
  {r6("y - annual")} AS residual FROM a"""


def _splits(df: DataFrame) -> DataFrame:
    """Split days from the data: each pipeline's first day of every quarter."""
    return df.groupBy("pipeline_name", F.year(DAY).alias("y"), F.quarter(DAY).alias("q")).agg(
        F.min(DAY).alias(DAY)
    ).drop("y", "q")


def changes_at_quarters(df: DataFrame) -> DataFrame:
    """A changepoint table whose dates come from the calendar, so that SQL can repeat it."""
    return changepoint.split_stats_at(df, _splits(df), ["pipeline_name"])


# Changepoint table of the function above, for the SQL side.
CHANGES = """d AS (SELECT pipeline_name, eff_gas_day, sum(scheduled_quantity) AS v
  FROM flows GROUP BY ALL),
sp AS (SELECT pipeline_name, min(eff_gas_day) AS day FROM flows
  GROUP BY pipeline_name, year(eff_gas_day), quarter(eff_gas_day)),
st AS (SELECT sp.pipeline_name, sp.day AS changepoint_date,
  avg(v) FILTER (WHERE eff_gas_day < sp.day) AS before_mean,
  avg(v) FILTER (WHERE eff_gas_day >= sp.day) AS after_mean,
  stddev_pop(v) FILTER (WHERE eff_gas_day < sp.day) AS before_std,
  stddev_pop(v) FILTER (WHERE eff_gas_day >= sp.day) AS after_std
  FROM sp JOIN d ON sp.pipeline_name = d.pipeline_name GROUP BY ALL),
ch AS (SELECT *, abs(after_mean - before_mean) / (abs(before_mean) + 1e-8) AS change_magnitude,
  abs(after_mean - before_mean) / (sqrt((before_std ** 2 + after_std ** 2) / 2) + 1e-8)
    AS confidence FROM st)"""
CHANGE_COLUMNS = ["pipeline_name", DAY, QUANTITY]


def _card(df: DataFrame) -> DataFrame:
    """Event card of the year starts, one row per contributor."""
    card = changepoint.event_card(_year_starts(df), df, top=3)
    return card.select("changepoint_date", F.inline("top_contributors"))


def _score(df: DataFrame) -> DataFrame:
    detected = _splits(df).select(F.col(DAY).alias("day")).distinct()
    known = df.groupBy(F.year(DAY).alias("y")).agg(F.date_add(F.min(DAY), 5).alias("day"))
    return changepoint.score_detection(detected, known.select("day"))


def _detected(**options):
    return lambda df: changepoint.detect_changepoints(df, **options)


def breaks_sql(
    daily: str, min_size: int, penalty: float | str, min_confidence: float, group: str | None
) -> str:
    """Changepoint table in SQL, unrounded: CTEs ending in ``found``.

    ``daily`` is a query with the columns g, day, v. The recursion ``best`` walks over the
    allowed end points and keeps, per series, the least cost and the last break of each;
    ``walk`` follows the last breaks back from the end.
    """
    pen = "2 * spread * ln(n)" if penalty == "bic" else f"{penalty}::DOUBLE"
    end = "e.ends[r.k + 1]"
    gap = f"(e.s1[{end} + 1] - e.s1[r.pos[j] + 1])"
    cost = f"""r.f[j] + greatest(e.s2[{end} + 1] - e.s2[r.pos[j] + 1]
      - {gap} ** 2 / ({end} - r.pos[j]), 0.0::DOUBLE)"""
    name = f"g AS {group}, " if group else ""
    return f"""daily AS ({daily}),
    placed AS (SELECT *, v - avg(v) OVER (PARTITION BY g) AS y,
      row_number() OVER (PARTITION BY g ORDER BY day) AS i FROM daily),
    sums AS (SELECT *, sum(y) OVER w AS s1, sum(y * y) OVER w AS s2 FROM placed
      WINDOW w AS (PARTITION BY g ORDER BY i)),
    lists AS (SELECT g, count(*) AS n, var_pop(v) AS spread, list(s1 ORDER BY i) AS s1,
      list(s2 ORDER BY i) AS s2 FROM sums GROUP BY g HAVING count(*) >= 2 * {min_size}),
    e AS MATERIALIZED (SELECT g, {pen} AS pen, [0.0::DOUBLE] || s1 AS s1,
      [0.0::DOUBLE] || s2 AS s2,
      list_filter(range(5, n, 5), lambda x: x >= {min_size}) || [n] AS ends FROM lists),
    best AS MATERIALIZED (WITH RECURSIVE r AS (
      SELECT g, 0::BIGINT AS k, [0::BIGINT] AS pos, [0.0::DOUBLE] AS f, [0::BIGINT] AS prev
      FROM e
      UNION ALL
      SELECT g, k + 1, pos || [b], f || [t.c + pen], prev || [t.p] FROM (
        SELECT r.g, r.k, r.pos, r.f, r.prev, e.pen, {end} AS b,
          list_min(list_transform(range(1, len(r.pos) + 1), lambda j:
            CASE WHEN {end} - r.pos[j] >= {min_size}
              THEN {{'c': {cost}, 'p': r.pos[j]}} END)) AS t
        FROM r JOIN e ON r.g = e.g WHERE r.k < len(e.ends)))
      SELECT g, pos, prev FROM r
      QUALIFY row_number() OVER (PARTITION BY g ORDER BY k DESC) = 1),
    walk AS (WITH RECURSIVE w AS (
      SELECT g, pos, prev, prev[len(prev)] AS brk FROM best
      UNION ALL
      SELECT g, pos, prev, prev[list_position(pos, brk)] FROM w WHERE brk > 0)
      SELECT g, brk FROM w WHERE brk > 0),
    halves AS (SELECT w.g, w.brk, min(day) FILTER (WHERE i > brk) AS changepoint_date,
      avg(v) FILTER (WHERE i <= brk) AS before_mean, avg(v) FILTER (WHERE i > brk) AS after_mean,
      stddev_pop(v) FILTER (WHERE i <= brk) AS before_std,
      stddev_pop(v) FILTER (WHERE i > brk) AS after_std
      FROM walk w JOIN placed p ON w.g = p.g GROUP BY ALL),
    measured AS (SELECT {name}changepoint_date, before_mean, after_mean, before_std, after_std,
      abs(after_mean - before_mean) / (abs(before_mean) + 1e-8) AS change_magnitude,
      abs(after_mean - before_mean) / (sqrt((before_std ** 2 + after_std ** 2) / 2) + 1e-8)
        AS confidence FROM halves),
    found AS (SELECT * FROM measured
      WHERE {min_confidence} <= 0 OR confidence >= {min_confidence})"""


FOUND = ", ".join(f"{r6(c)} AS {c}" for c in changepoint.STAT_COLUMNS)
BY_PIPELINE = """SELECT pipeline_name AS g, eff_gas_day AS day, sum(scheduled_quantity) AS v
  FROM flows GROUP BY ALL"""
TOGETHER = """SELECT 'all' AS g, eff_gas_day AS day, sum(scheduled_quantity) AS v
  FROM flows GROUP BY ALL"""


def detected_sql(
    min_size: int, penalty: float | str, min_confidence: float, grouped: bool = True
) -> str:
    group = "pipeline_name" if grouped else None
    daily = BY_PIPELINE if grouped else TOGETHER
    return f"""WITH {breaks_sql(daily, min_size, penalty, min_confidence, group)}
    SELECT {"pipeline_name, " if grouped else ""}changepoint_date, {FOUND} FROM found"""


def _features_sql(entity: str, other: str) -> str:
    months = ", ".join(
        f"""{r6(f"coalesce(avg(v) FILTER (WHERE month(day) = {m}) / greatest(avg(v), 1), 1)")}
        AS season_m{m:02d}"""
        for m in range(1, 13)
    )
    days = ", ".join(
        f"""{r6(f"coalesce(avg(v) FILTER (WHERE isodow(day) = {d}) / greatest(avg(v), 1), 1)")}
        AS dow_{d}"""
        for d in range(1, 8)
    )
    return f"""WITH daily AS (SELECT {entity} AS e, eff_gas_day AS day,
      sum(scheduled_quantity) AS v,
      first(rec_del_sign ORDER BY scheduled_quantity, rec_del_sign, {other}) AS sign,
      first({other} ORDER BY scheduled_quantity, rec_del_sign, {other}) AS partner
      FROM flows GROUP BY ALL),
    kept AS (SELECT * FROM daily QUALIFY count(*) OVER (PARTITION BY e) >= 30),
    moved AS (SELECT *, v - lag(v) OVER w AS diff, sign <> lag(sign) OVER w AS turned FROM kept
      WINDOW w AS (PARTITION BY e ORDER BY day))
    SELECT e AS {entity}, count(*) AS n_days, {r6("avg(v)")} AS mean_flow,
      {r6("stddev_samp(v)")} AS std_flow, {r6("median(v)")} AS median_flow, {months},
      {r6(p_nearest("abs(diff)", 0.95))} AS ramp_p95, {r6("stddev_samp(diff)")} AS ramp_std,
      {r6("avg(diff)")} AS ramp_mean, count(*) FILTER (WHERE turned) AS reversals, {days},
      count(DISTINCT partner) AS n_counterparties,
      {r6("count(*) FILTER (WHERE turned) / greatest(count(*), 1)")} AS reversal_freq,
      {r6("1 / greatest(count(DISTINCT partner), 1)")} AS dependency_index
    FROM moved GROUP BY e"""


FEATURE_COLUMNS = ["loc_name", "connecting_entity", DAY, SIGN, QUANTITY]
SCALED = ["ramp_p95", "ramp_std", "reversal_freq", "season_m01", "dow_7", "dependency_index"]


def _scaled(df: DataFrame) -> DataFrame:
    return cluster.standardized(cluster.build_features(df)).select("loc_name", *SCALED)


def _scaled_sql() -> str:
    features = _features_sql("loc_name", "connecting_entity").replace("1000000.0", "1e12")
    z = ", ".join(
        f"""{r6(f'''CASE WHEN stddev_pop({c}) OVER () > 0
          THEN ({c} - avg({c}) OVER ()) / stddev_pop({c}) OVER () ELSE 0 END''')} AS {c}"""
        for c in SCALED
    )
    head, tail = features.rsplit("SELECT e AS", 1)
    return f"{head}, f AS (SELECT e AS{tail}) SELECT loc_name, {z} FROM f"


# Clusters by rule in place of KMeans: entities of steep, of gentle and of usual changes.
K_BY_RULE = 4


def _by_rule(df: DataFrame) -> DataFrame:
    rows = written(cluster.build_features(df), "labelled-features")
    steep = F.col("ramp_p95")
    label = F.when(steep > 0.5, 0).when(steep < -0.5, 1).otherwise(2)
    return cluster.with_vectors(rows).withColumn("cluster_id", label)


def _names_by_rule(df: DataFrame) -> DataFrame:
    return cluster.cluster_names(_by_rule(df), K_BY_RULE)


def _summary_by_rule(df: DataFrame) -> DataFrame:
    rows = _by_rule(df)
    named = rows.join(cluster.cluster_names(rows, K_BY_RULE), "cluster_id")
    return cluster.summarize_clusters(named)


def _nearest_centres(df: DataFrame) -> DataFrame:
    """Every entity, and whether no centre is nearer than that of its cluster."""
    found = cluster.cluster_entities(df)
    centres = found.model.clusterCenters()
    own = found.entities.select("loc_name", "cluster_id").join(found.rows, "loc_name")
    away = F.array(
        *[
            reduce(lambda a, b: a + b, [(F.col(f) - F.lit(float(x))) ** 2 for f, x in zip(cluster.CLUSTER_FEATURES, c)])
            for c in centres
        ]
    )
    nearest = F.element_at(away, F.col("cluster_id") + 1) <= F.array_min(away) + 1e-9
    return own.select("loc_name", nearest.alias("nearest"))


def _falling_costs(df: DataFrame) -> DataFrame:
    """Whether more clusters cost less, and the squares of all features, their upper bound."""
    found = [cluster.cluster_entities(df, k=k) for k in (2, 4, 8)]
    costs = [x.model.summary.trainingCost for x in found]
    falls = all(a > b for a, b in zip(costs, costs[1:]))
    squares = F.sum(reduce(lambda a, b: a + b, [F.col(c) ** 2 for c in cluster.CLUSTER_FEATURES]))
    return found[0].rows.agg(F.count(F.lit(1)).alias("entities"), squares.alias("squares")).select(
        "entities", F.lit(falls).alias("falls"), (F.col("squares") > costs[0]).alias("bounded"), "squares"
    )


def _all_scaled_sql() -> str:
    """CTEs up to ``z``: every scaled feature of every location, with the cluster by rule."""
    features = _features_sql("loc_name", "connecting_entity").replace("1000000.0", "1e12")
    z = ", ".join(
        f"""CASE WHEN stddev_pop(coalesce({c}, 0)) OVER () > 1e-11
          THEN (coalesce({c}, 0) - avg(coalesce({c}, 0)) OVER ()) / stddev_pop(coalesce({c}, 0)) OVER ()
          ELSE 0 END AS {c}"""
        for c in cluster.CLUSTER_FEATURES
    )
    head, tail = features.rsplit("SELECT e AS", 1)
    return f"""{head}, f AS (SELECT e AS{tail}), y AS (SELECT loc_name, n_days, mean_flow, {z} FROM f),
    z AS (SELECT *, CASE WHEN ramp_p95 > 0.5 THEN 0 WHEN ramp_p95 < -0.5 THEN 1 ELSE 2 END AS cluster_id FROM y)"""


_LABELS = dict(zip(cluster.SEASON, MONTH_NAMES)) | dict(zip(cluster.WEEKDAY, WEEKDAY_NAMES))
_LABELS |= dict.fromkeys(("ramp_p95", "ramp_std", "ramp_mean"), "Ramp")
_LABELS |= {"reversal_freq": "Reversals", "dependency_index": "Dependency"}
# (cluster, feature number, label, mean) of every cluster and feature, and the names from it.
_NAMES_SQL = f"""{_all_scaled_sql()}, m AS ({" UNION ALL ".join(
    f"SELECT cluster_id, {i} AS i, '{_LABELS[c]}' AS label, avg({c}) AS v FROM z GROUP BY cluster_id"
    for i, c in enumerate(cluster.CLUSTER_FEATURES))}),
  strong AS (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY abs(v) DESC, i DESC) AS place FROM m),
  parts AS (SELECT cluster_id, list(CASE WHEN v > 0 THEN 'High_' ELSE 'Low_' END || label ORDER BY place)
    FILTER (WHERE place <= 3 AND abs(v) > 0.5) AS p FROM strong GROUP BY cluster_id),
  named AS (SELECT k.cluster_id, CASE WHEN c.cluster_id IS NULL THEN 'Empty_' || k.cluster_id
    WHEN p IS NULL THEN 'Cluster_' || k.cluster_id ELSE array_to_string(p[1:2], '_') END AS cluster_name
    FROM (SELECT unnest(range({K_BY_RULE})) AS cluster_id) k LEFT JOIN parts c ON c.cluster_id = k.cluster_id)"""
_SQUARES = " + ".join(f"(a.{c} - b.{c}) ** 2" for c in cluster.CLUSTER_FEATURES)

CHECKS: dict[str, Check] = {
    "seasonal_decomposition": flow_check(
        "STL-1",
        CHANGE_COLUMNS,
        lambda df: deseasonalize(df, series=["pipeline_name"]),
        STL_SQL,
    ),
    "seasonal_component_other_period": flow_check(
        "STL-2",
        CHANGE_COLUMNS,
        lambda df: with_seasonal(
            daily_series(df, ["pipeline_name"], QUANTITY), QUANTITY, 30, "season", ["pipeline_name"]
        ),
        f"""{SERIES_SQL}, k AS (SELECT *, (row_number() OVER (PARTITION BY pipeline_name
          ORDER BY eff_gas_day) - 1) % 30 AS key FROM s),
        m AS (SELECT *, avg(v) OVER (PARTITION BY pipeline_name, key) AS raw FROM k)
        SELECT pipeline_name, eff_gas_day, v AS scheduled_quantity,
          {r6("raw - avg(raw) OVER (PARTITION BY pipeline_name)")} AS season FROM m""",
    ),
    "seasonal_short_series": flow_check(
        "STL-3",
        ["loc_name", "connecting_entity", DAY, QUANTITY],
        lambda df: deseasonalize(df, series=["loc_name", "connecting_entity"])
        .groupBy("loc_name", "connecting_entity")
        .agg(
            F.count(F.lit(1)).alias("days"),
            F.count_if(F.abs(F.col("deseasonalized") - F.col(QUANTITY)) > 1e-9).alias("changed"),
        )
        .where(F.col("days") < 14),
        """WITH d AS (SELECT DISTINCT loc_name, connecting_entity, eff_gas_day FROM flows)
        SELECT loc_name, connecting_entity, count(*) AS days, 0::BIGINT AS changed FROM d
        GROUP BY ALL HAVING count(*) < 14""",
    ),
    "changepoints_grouped": flow_check(
        "CP-1",
        CHANGE_COLUMNS,
        _detected(groupby=["pipeline_name"], min_confidence=0.05),
        detected_sql(10, 10.0, 0.05),
    ),
    "changepoints_single_series": flow_check(
        "CP-1",
        [DAY, QUANTITY],
        _detected(penalty=4000.0, min_confidence=0.0),
        detected_sql(10, 4000.0, 0.0, grouped=False),
    ),
    "changepoints_bic": flow_check(
        "CP-1",
        ["loc_name", DAY, QUANTITY],
        _detected(groupby=["loc_name"], penalty="bic", min_confidence=0.0),
        f"""WITH {breaks_sql("""SELECT loc_name AS g, eff_gas_day AS day,
          sum(scheduled_quantity) AS v FROM flows GROUP BY ALL""", 10, "bic", 0.0, "loc_name")}
        SELECT loc_name, changepoint_date, {FOUND} FROM found""",
    ),
    "changepoint_statistics": flow_check(
        "CP-2",
        CHANGE_COLUMNS,
        changes_at_quarters,
        f"""WITH {CHANGES} SELECT pipeline_name, changepoint_date, {r6("before_mean")}
          AS before_mean, {r6("after_mean")} AS after_mean, {r6("before_std")} AS before_std,
          {r6("after_std")} AS after_std, {r6("change_magnitude")} AS change_magnitude,
          {r6("confidence")} AS confidence FROM ch""",
    ),
    "event_card": flow_check(
        "CP-3",
        [*LOCATION, DAY, QUANTITY],
        _card,
        f"""WITH events AS (SELECT min(eff_gas_day) AS d FROM flows GROUP BY year(eff_gas_day)),
        t AS (SELECT d AS changepoint_date, pipeline_name, loc_name,
          sum(CASE WHEN eff_gas_day < d THEN scheduled_quantity ELSE 0 END) AS b,
          sum(CASE WHEN eff_gas_day >= d THEN scheduled_quantity ELSE 0 END) AS a
          FROM flows JOIN events ON eff_gas_day BETWEEN d - 30 AND d + 30 GROUP BY ALL)
        SELECT changepoint_date, row_number() OVER (PARTITION BY changepoint_date
            ORDER BY abs(a - b) DESC, pipeline_name, loc_name) AS place, pipeline_name, loc_name,
          {r6("b")} AS before_total, {r6("a")} AS after_total, {r6("a - b")} AS change,
          {r6("abs(a - b)")} AS abs_change FROM t QUALIFY place <= 3""",
    ),
    "changepoint_step": flow_check(
        "CP-4",
        CHANGE_COLUMNS,
        lambda df: changepoint.changepoint_step(
            df, min_confidence=0.05, groupby=["pipeline_name"]
        ),
        detected_sql(7, 10.0, 0.05),
    ),
    "changepoints_sensitive": flow_check(
        "CP-5",
        CHANGE_COLUMNS,
        changepoint.sensitive_changepoints,
        detected_sql(3, 0.5, 0.3),
    ),
    "changepoint_score": flow_check(
        "CP-6",
        CHANGE_COLUMNS,
        _score,
        f"""WITH det AS (SELECT DISTINCT min(eff_gas_day) AS day FROM flows
          GROUP BY pipeline_name, year(eff_gas_day), quarter(eff_gas_day)),
        known AS (SELECT min(eff_gas_day) + 5 AS day FROM flows GROUP BY year(eff_gas_day)),
        n AS (SELECT (SELECT count(*) FROM known k WHERE EXISTS
            (SELECT 1 FROM det WHERE abs(det.day - k.day) <= 7)) AS c,
          (SELECT count(*) FROM det) AS d, (SELECT count(*) FROM known) AS t)
        SELECT c AS correct_detections, d AS total_detected, t AS total_true,
          {r6("c / d")} AS precision, {r6("c / t")} AS recall,
          {r6("2 * (c / d) * (c / t) / (c / d + c / t)")} AS f1_score FROM n""",
    ),
    "cluster_features_locations": flow_check(
        "CLU-1",
        FEATURE_COLUMNS,
        cluster.build_features,
        _features_sql("loc_name", "connecting_entity"),
    ),
    "cluster_features_counterparties": flow_check(
        "CLU-1",
        FEATURE_COLUMNS,
        lambda df: cluster.build_features(df, "counterparty"),
        _features_sql("connecting_entity", "loc_name"),
    ),
    "cluster_features_scaled": flow_check("CLU-2", FEATURE_COLUMNS, _scaled, _scaled_sql()),
    "cluster_names_by_rule": flow_check(
        "CLU-5", FEATURE_COLUMNS, _names_by_rule, f"{_NAMES_SQL} SELECT cluster_id, cluster_name FROM named"
    ),
    "cluster_summary_by_rule": flow_check(
        "CLU-7",
        FEATURE_COLUMNS,
        _summary_by_rule,
        f"""{_NAMES_SQL} SELECT CAST(z.cluster_id AS BIGINT) AS cluster_id, cluster_name, count(*) AS count,
          {r6("avg(mean_flow)")} AS avg_flow, {r6("stddev_samp(mean_flow)")} AS std_flow,
          {r6("avg(n_days)")} AS avg_days FROM z JOIN named n ON n.cluster_id = z.cluster_id GROUP BY ALL""",
    ),
    "cluster_metrics_by_rule": flow_check(
        "CLU-4 CLU-6",
        FEATURE_COLUMNS,
        lambda df: cluster.cluster_metrics(_by_rule(df), K_BY_RULE),
        f"""{_all_scaled_sql()}, n AS (SELECT cluster_id, count(*) AS n FROM z GROUP BY ALL),
        d AS (SELECT a.loc_name, a.cluster_id AS own, b.cluster_id AS other, sum({_SQUARES}) AS d
          FROM z a CROSS JOIN z b GROUP BY ALL),
        w AS (SELECT loc_name, any_value(own) AS own,
          max(d.d / nullif(n.n - 1, 0)) FILTER (WHERE own = other) AS a,
          min(d.d / n.n) FILTER (WHERE own <> other) AS b
          FROM d JOIN n ON n.cluster_id = other GROUP BY loc_name)
        SELECT {r6("avg(CASE WHEN a IS NULL THEN 0 ELSE (b - a) / greatest(a, b) END)")}
            AS silhouette_sq_euclidean, count(*) AS n_entities, CAST({K_BY_RULE} AS BIGINT) AS n_clusters,
          CAST({len(cluster.CLUSTER_FEATURES)} AS BIGINT) AS n_features,
          (SELECT min(n) FROM n) AS min_cluster_size, (SELECT max(n) FROM n) AS max_cluster_size FROM w""",
    ),
    "cluster_nearest_centres": flow_check(
        "CLU-3", FEATURE_COLUMNS, _nearest_centres, f"{_all_scaled_sql()} SELECT loc_name, true AS nearest FROM z"
    ),
    "cluster_falling_costs": flow_check(
        "CLU-3",
        FEATURE_COLUMNS,
        _falling_costs,
        f"""{_all_scaled_sql()} SELECT count(*) AS entities, true AS falls, true AS bounded,
          {r6("sum(" + " + ".join(f"{c} ** 2" for c in cluster.CLUSTER_FEATURES) + ")")} AS squares FROM z""",
    ),
    "cluster_locations": flow_check(
        "CLU-3 CLU-5", FEATURE_COLUMNS, lambda df: cluster.cluster_entities(df).entities
    ),
    "cluster_metrics": flow_check(
        "CLU-4 CLU-6", FEATURE_COLUMNS, lambda df: cluster.cluster_entities(df, k=4).metrics
    ),
    "cluster_summary": flow_check(
        "CLU-7 QRY-10", FEATURE_COLUMNS, lambda df: cluster.cluster_summary(df, "counterparty")
    ),
}
