"""Shared pieces of the registered queries."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weir.sources.flows import flows_from_star

# The flow table over the star schema, for the SQL side.
FLOWS = """
WITH flows AS (
  SELECT CAST(l_shipdate AS DATE) AS eff_gas_day, r_name AS pipeline_name, s_name AS loc_name,
         n.n_name AS state_abb, cn.n_name AS connecting_entity,
         CASE WHEN l_returnflag = 'N' THEN NULL ELSE p_brand END AS connecting_pipeline,
         CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'Interconnect'
              WHEN o_orderpriority = '3-MEDIUM' THEN 'LDC' ELSE 'Industrial' END AS category_short,
         CASE WHEN l_linestatus = 'O' THEN 1 ELSE -1 END AS rec_del_sign,
         CASE WHEN l_tax = 0 THEN NULL ELSE s_acctbal END AS latitude,
         CASE WHEN l_discount = 0 THEN NULL ELSE s_acctbal END AS longitude,
         CASE WHEN l_discount = 0.1::DOUBLE THEN 0.0::DOUBLE ELSE l_quantity END
           AS scheduled_quantity
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey
  JOIN supplier ON l_suppkey = s_suppkey
  JOIN nation n ON s_nationkey = n.n_nationkey JOIN region ON n.n_regionkey = r_regionkey
  JOIN part ON l_partkey = p_partkey JOIN customer ON o_custkey = c_custkey
  JOIN nation cn ON c_nationkey = cn.n_nationkey
)"""

LOCATION = ["pipeline_name", "loc_name"]
DAY, QUANTITY, SIGN = "eff_gas_day", "scheduled_quantity", "rec_del_sign"


@dataclass(frozen=True)
class Check:
    """A query, the survey rows it covers, and its SQL (None: checked by our own tests)."""

    covers: str
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None = None


def r6(expr: str) -> str:
    """Round in SQL to six places, halves up, by the same arithmetic as :func:`tidy`."""
    return f"(floor(({expr}) * 1000000.0::DOUBLE + 0.5::DOUBLE) / 1000000.0::DOUBLE)"


def tidy(df: DataFrame) -> DataFrame:
    """Doubles to six places, all integers to bigint, as the SQL side writes them."""
    small = (T.ByteType, T.ShortType, T.IntegerType)
    changes = {}
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            changes[f.name] = F.floor(F.col(f.name) * 1000000.0 + 0.5) / F.lit(1000000.0)
        elif isinstance(f.dataType, small):
            changes[f.name] = F.col(f.name).cast("bigint")
    return df.withColumns(changes) if changes else df


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def flow_check(
    covers: str,
    columns: Sequence[str],
    run: Callable[[DataFrame], DataFrame],
    sql: str | None = None,
) -> Check:
    """A query over the flow table; the SQL is put behind the FLOWS prefix."""

    def start(spark: SparkSession, folder: str) -> DataFrame:
        return tidy(run(flows_from_star(spark, folder, columns)))

    if sql is not None:
        body = sql.strip()
        sql = f"{FLOWS}, {body[5:]}" if body.upper().startswith("WITH ") else f"{FLOWS} {body}"
    return Check(covers, start, sql)


def table_check(
    covers: str, name: str, run: Callable[[DataFrame], DataFrame], sql: str | None = None
) -> Check:
    """A query over one given table."""

    def start(spark: SparkSession, folder: str) -> DataFrame:
        return tidy(run(table(spark, folder, name)))

    return Check(covers, start, sql)


def p_nearest(column: str, q: float, where: str = "") -> str:
    """Nearest-rank quantile as a SQL aggregate over non-null values."""
    keep = f"FILTER (WHERE {column} IS NOT NULL" + (f" AND {where})" if where else ")")
    place = f"CAST(floor((count({column}) {keep} - 1) * {q}::DOUBLE + 0.5::DOUBLE) AS BIGINT) + 1"
    return f"(list({column} ORDER BY {column}) {keep})[{place}]"
