from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession

FLOW = (
    "pipeline_name string, loc_name string, connecting_pipeline string, connecting_entity string,"
    " rec_del_sign tinyint, category_short string, state_abb string, latitude double,"
    " longitude double, eff_gas_day date, scheduled_quantity double"
)
DEFAULTS = {
    "pipeline_name": "P1",
    "loc_name": "L1",
    "connecting_pipeline": None,
    "connecting_entity": "C1",
    "rec_del_sign": 1,
    "category_short": "LDC",
    "state_abb": "TX",
    "latitude": 30.0,
    "longitude": -95.0,
    "eff_gas_day": date(2022, 1, 1),
    "scheduled_quantity": 0.0,
}


def day(n: int, start: date = date(2022, 1, 1)) -> date:
    return start + timedelta(days=n)


def flows(spark: SparkSession, *rows: dict) -> DataFrame:
    data = [tuple({**DEFAULTS, **r}[c] for c in DEFAULTS) for r in rows]
    return spark.createDataFrame(data, FLOW)


def rows_of(df: DataFrame, *order: str) -> list[dict]:
    found = [r.asDict(recursive=True) for r in df.collect()]
    return sorted(found, key=lambda r: [str(r[c]) for c in order]) if order else found


def one(df: DataFrame) -> dict:
    found = df.collect()
    assert len(found) == 1, found
    return found[0].asDict(recursive=True)
