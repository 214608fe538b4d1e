"""The daily flow table: schema, parquet scan, type normalisation, test-data view."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

FLOW_SCHEMA = T.StructType(
    [
        T.StructField("pipeline_name", T.StringType()),
        T.StructField("loc_name", T.StringType()),
        T.StructField("connecting_pipeline", T.StringType()),
        T.StructField("connecting_entity", T.StringType()),
        T.StructField("rec_del_sign", T.ByteType()),
        T.StructField("category_short", T.StringType()),
        T.StructField("country_name", T.StringType()),
        T.StructField("state_abb", T.StringType()),
        T.StructField("county_name", T.StringType()),
        T.StructField("latitude", T.DoubleType()),
        T.StructField("longitude", T.DoubleType()),
        T.StructField("eff_gas_day", T.DateType()),
        T.StructField("scheduled_quantity", T.DoubleType()),
    ]
)

FORCED_TYPES = {
    "rec_del_sign": T.ByteType(),
    "scheduled_quantity": T.DoubleType(),
    "eff_gas_day": T.DateType(),
}


def normalize_flows(df: DataFrame) -> DataFrame:
    """Force the three typed columns; a value that does not parse becomes null.

    Columns that already have the type are left alone: a cast around them would keep
    their filters out of the parquet scan. Absent columns are skipped.
    """
    casts = {
        name: F.col(name).try_cast(dtype)
        for name, dtype in FORCED_TYPES.items()
        if name in df.columns and df.schema[name].dataType != dtype
    }
    return df.withColumns(casts) if casts else df


def read_flows(spark: SparkSession, path: str, columns: Iterable[str] | None = None) -> DataFrame:
    """Lazy parquet scan with normalised types."""
    df = normalize_flows(spark.read.parquet(path))
    return df.select(*columns) if columns is not None else df


# Which star-schema tables a flow column needs beyond the line items.
_COLUMN_TABLES = {
    "pipeline_name": {"supplier", "nation", "region"},
    "loc_name": {"supplier"},
    "state_abb": {"supplier", "nation"},
    "connecting_entity": {"orders", "customer", "customer_nation"},
    "connecting_pipeline": {"part"},
    "category_short": {"orders"},
    "rec_del_sign": set(),
    "latitude": {"supplier"},
    "longitude": {"supplier"},
    "eff_gas_day": set(),
    "scheduled_quantity": set(),
}


def flows_from_star(
    spark: SparkSession, folder: str, columns: Iterable[str] | None = None
) -> DataFrame:
    """The flow table seen through a retail star schema (line items as daily flows).

    Only the dimensions behind the asked columns are joined. Every line item has
    exactly one match in each dimension, so leaving one out changes no row. Dimensions are
    joined with each other first: line items travel once per key of their own, and the names
    of the supplier, which are the widest, come last.
    """
    wanted = list(columns) if columns is not None else list(_COLUMN_TABLES)
    unknown = [c for c in wanted if c not in _COLUMN_TABLES]
    if unknown:
        raise ValueError(f"not in the test view: {unknown}")
    tables = set().union(*[_COLUMN_TABLES[c] for c in wanted]) if wanted else set()

    def read(name: str) -> DataFrame:
        return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")

    # What a line item says by itself; names of other tables are not carried through its shuffles.
    own = {
        "connecting_pipeline": (F.col("l_returnflag") == "N").alias("no_brand"),
        "rec_del_sign": F.when(F.col("l_linestatus") == "O", 1)
        .otherwise(-1)
        .cast("tinyint")
        .alias("rec_del_sign"),
        "latitude": (F.col("l_tax") == 0).alias("no_latitude"),
        "longitude": (F.col("l_discount") == 0).alias("no_longitude"),
        "eff_gas_day": F.col("l_shipdate").cast("date").alias("eff_gas_day"),
        "scheduled_quantity": F.when(F.col("l_discount") == 0.1, 0.0)
        .otherwise(F.col("l_quantity"))
        .alias("scheduled_quantity"),
    }
    keys = {"part": "l_partkey", "orders": "l_orderkey", "supplier": "l_suppkey"}
    df = read("lineitem").select(
        *[key for name, key in keys.items() if name in tables],
        *[c for name, c in own.items() if name in wanted],
    )
    if "part" in tables:
        df = df.join(read("part"), F.col("l_partkey") == F.col("p_partkey"))
    if "orders" in tables:
        urgent = F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")
        medium = F.col("o_orderpriority") == "3-MEDIUM"
        category = (
            F.when(urgent, "Interconnect").when(medium, "LDC").otherwise("Industrial")
        ).alias("category_short")
        orders = read("orders").select("o_orderkey", "o_custkey", category)
        if "customer" in tables:
            orders = orders.join(read("customer"), F.col("o_custkey") == F.col("c_custkey"))
        if "customer_nation" in tables:
            buyers = read("nation").select(
                F.col("n_nationkey").alias("cn_key"), F.col("n_name").alias("cn_name")
            )
            orders = orders.join(buyers, F.col("c_nationkey") == F.col("cn_key"))
        df = df.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    if "supplier" in tables:
        suppliers = read("supplier")
        if "nation" in tables:
            suppliers = suppliers.join(read("nation"), F.col("s_nationkey") == F.col("n_nationkey"))
        if "region" in tables:
            suppliers = suppliers.join(read("region"), F.col("n_regionkey") == F.col("r_regionkey"))
        df = df.join(suppliers, F.col("l_suppkey") == F.col("s_suppkey"))

    view = {
        "pipeline_name": F.col("r_name"),
        "loc_name": F.col("s_name"),
        "state_abb": F.col("n_name"),
        "connecting_entity": F.col("cn_name"),
        "connecting_pipeline": F.when(F.col("no_brand"), None).otherwise(F.col("p_brand")),
        "category_short": F.col("category_short"),
        "rec_del_sign": F.col("rec_del_sign"),
        "latitude": F.when(F.col("no_latitude"), None).otherwise(F.col("s_acctbal")),
        "longitude": F.when(F.col("no_longitude"), None).otherwise(F.col("s_acctbal")),
        "eff_gas_day": F.col("eff_gas_day"),
        "scheduled_quantity": F.col("scheduled_quantity"),
    }
    return df.select(*[view[c].alias(c) for c in wanted])
