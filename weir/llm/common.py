"""What the text operators share: reading tables, folds, and per-row Python over Arrow batches."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

from weir.session import work_path

# Rows that are handed from Arrow to Python at once.
ROWS_AT_ONCE = 256
# Rows of a batch that Spark hands to Python: whole texts, of which a task holds some copies.
BATCH_ROWS = 1_000


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Let Spark hand whole texts to Python in batches of no more than ``BATCH_ROWS`` rows.

    A setting of the session; one that is smaller already stays. It changes no result, and
    a worker holds a tenth of the texts at a time that it would by default.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(name))
    if now <= 0 or now > BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


def seldom_collect() -> None:
    """Let Python look for reference cycles seldom.

    Batches make many small objects that die without cycles; looking through the memories of
    words again and again for garbage took up to two fifths of a task.
    """
    gc.set_threshold(100_000, 50, 100)


# What an operator keeps in a Python worker for its next tasks, by name.
_kept: dict[str, Any] = {}


def kept_by_worker(name: str, make: Callable[[], Any]) -> Any:
    """A thing that this Python worker makes once and keeps for the tasks to come.

    It goes when the worker turns to a :func:`text_function`, as a later stage of a session does.
    """
    if name not in _kept:
        _kept[name] = make()
    return _kept[name]


def return_memory() -> None:
    """Give freed memory back to the system; Python and Arrow would keep it for themselves."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def clear_worker() -> None:
    """Drop what operators before kept in this Python worker.

    Spark hands its workers from stage to stage, and an executor's limit holds for all that they
    have at a time.
    """
    if _kept:
        _kept.clear()
        gc.collect()
    return_memory()


def fold(row_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; null for a null id."""
    return F.crc32(row_id.cast("string").cast("binary")) % folds


def in_fold(row_id: Column, folds: int, k: int) -> Column:
    """Whether a row lies in fold ``k``; rows without an id lie in none."""
    return F.coalesce(fold(row_id, folds) == k, F.lit(False))


def map_rows(
    df: DataFrame,
    schema: str | StructType,
    start: Callable[[], Callable[[list[tuple]], list[tuple]]],
    at_once: int = ROWS_AT_ONCE,
) -> DataFrame:
    """Pass the rows through Python, some hundred at a time, in the partitions they are in.

    ``start`` is called once per task and returns a function from a list of row tuples to a
    list of row tuples of ``schema``; batches are small, so a task holds few rows at once. What
    a task has freed goes back to the system at its end, as its worker may wait idle.
    """
    kind = _parse_datatype_string(schema) if isinstance(schema, str) else schema
    out = to_arrow_schema(kind)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seldom_collect()
        rows_of = start()
        for batch in batches:
            for at in range(0, batch.num_rows, at_once):
                part = batch.slice(at, at_once)
                found = rows_of(list(zip(*[c.to_pylist() for c in part.columns])))
                if found:
                    columns = [pa.array(c, f.type) for c, f in zip(zip(*found), out)]
                    yield pa.RecordBatch.from_arrays(columns, schema=out)
        rows_of = batch = part = found = columns = None
        return_memory()

    return df.mapInArrow(work, kind)


def text_function(
    schema: str,
    start: Callable[[], Callable[[list], list[tuple]]],
    at_once: int = ROWS_AT_ONCE,
):
    """A column function of texts whose values are structs of ``schema``.

    ``start`` is called once per task and returns a function from a list of texts (or nulls)
    to a list of tuples. A worker holds no more than this function's memory while it runs, and
    none of it afterwards.
    """
    kind = _parse_datatype_string(schema)
    names = kind.fieldNames()

    def work(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        seldom_collect()
        clear_worker()
        rows_of = start()
        for texts in batches:
            found = []
            for at in range(0, len(texts), at_once):
                part = texts.iloc[at : at + at_once]
                found += rows_of([x if isinstance(x, str) else None for x in part])
            yield pd.DataFrame(found, columns=names)
        rows_of = texts = part = found = None
        return_memory()

    return F.pandas_udf(work, kind, F.PandasUDFType.SCALAR_ITER)


def saved(df: DataFrame, name: str) -> DataFrame:
    """Write a frame below the shared work folder and read it back.

    The files cut the lineage: a lost executor costs a read and no second computation, and
    later steps see the same rows whatever order they arrived in.
    """
    path = work_path(df.sparkSession, name.replace(" ", "-"))
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
