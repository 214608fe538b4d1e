"""Run registered queries against their SQL in DuckDB: python -m checks.compare [folder] [names]."""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb
from pyspark.sql import DataFrame, SparkSession

from checks import all_checks

SF_DIR = "/root/testdata/sf0.01"


def plain(value):
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return repr(value)
    if isinstance(value, bool) or value is None:
        return str(value)
    return str(value)


def as_rows(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in rows)


def duck(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for file in sorted(os.listdir(folder)):
        name = file.removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{file}'")
    return con


def difference(df: DataFrame, con: duckdb.DuckDBPyConnection, sql: str) -> str | None:
    """None when both sides agree in columns, kinds of types, and rows."""
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    types = {d[0]: str(d[1]) for d in result.description}
    expected = as_rows(names, result.fetchall())
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} against {sorted(names)}"
    kinds = {"bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "date": "DATE"}
    odd = {c: (t, types[c]) for c, t in df.dtypes if t in kinds and kinds[t] != types[c]}
    if odd:
        return f"types {odd}"
    found = as_rows(df.columns, df.collect())
    if found == expected:
        return None
    only_found = sorted(set(found) - set(expected))[:3]
    only_sql = sorted(set(expected) - set(found))[:3]
    return f"{len(found)} rows against {len(expected)}; spark {only_found}; sql {only_sql}"


def main() -> int:
    args = sys.argv[1:]
    folder = args.pop(0) if args and os.path.isdir(args[0]) else SF_DIR
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(folder)
    wrong = 0
    for name, check in all_checks().items():
        if args and not any(a in name or a in check.covers.split() for a in args):
            continue
        start = time.perf_counter()
        try:
            df = check.run(spark, folder)
            if check.sql is None:
                note = f"rows {df.count()}"
            else:
                bad = difference(df, con, check.sql)
                note = "ok" if bad is None else f"WRONG {bad}"
                wrong += bad is not None
        except Exception as error:
            wrong += 1
            note = f"FAILED {type(error).__name__}: {str(error)[:600]}"
        print(f"{name:34s} {time.perf_counter() - start:6.2f}s {note}", flush=True)
    print(f"{wrong} wrong")
    return 1 if wrong else 0


if __name__ == "__main__":
    sys.exit(main())
