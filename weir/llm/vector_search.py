"""Exact top-k by inner product over a vector-approximation file.

The vectors are stored twice. The approximation file holds a byte per component: the number of
the *cell* it lies in, on a grid of its own for every vector (lowest component and cell width,
as whole numbers), and the distance of the vector from the centres of its cells. The centres
give an approximate product, and by Cauchy and Schwarz it is off by no more than the query's
length times that distance. So every pair has a lower and an upper bound for its score.

1. Blocks of the approximation file meet blocks of queries. Each pair of blocks keeps the rows
   whose upper bound reaches the k-th best lower bound of the query in it.
2. Over all blocks, only rows that reach the k-th best lower bound of the query are left.
3. The exact vectors of the k highest upper bounds are read, and their scores worked out. Of the
   others only those whose upper bound reaches the k-th exact score are read as well: after
   them no other row can be among the best, so the result is certain.

Exact vectors are read by a join on the row number, for the rows that are left alone.

Definite results: rows whose vector is null, has null or non-finite components, or lacks an
id take no part, and neither do components' counts that differ from the query's. Ties go to
the smaller id. Rows that share an id count one by one; a query leaves out every row with its
own id, and an id that asks twice gets the partners of both rows in its k ranks, as in the SQL.
Other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weir.llm.common import map_rows, saved

# Cells per component; a number of a cell is one byte.
CELLS = 256
# Rows and queries that meet in one task at a time, and queries whose bounds are held at once.
ROWS_PER_BLOCK, QUERIES_PER_BLOCK = 8_192, 2_048
QUERIES_AT_ONCE = 256
# Rounding of sums of doubles is far below this part of the lengths' product.
ROUNDING = 1e-9


def whole_numbers(vector: Column, scale: int = 64) -> Column:
    """floor(scale * x) of every component, x as double."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * scale))


def usable(vector: Column) -> Column:
    """Whether a vector is there and all its components are finite numbers."""
    bad = F.exists(
        vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf"))
    )
    return vector.isNotNull() & ~F.coalesce(bad, F.lit(False))


def approximated(rows: DataFrame, cells: int) -> DataFrame:
    """The approximation file (row, id, size, cells, low, width, off) of vectors (row, id, vector).

    ``off`` is the distance of the vector from the centres of its cells.
    """

    def start():
        def encode(batch):
            out = []
            for row, row_id, vector in batch:
                low, high = min(vector, default=0), max(vector, default=0)
                width = max(1, -(-(high - low + 1) // cells))
                # Components are whole numbers of any size; their place on the grid is small.
                places = [(x - low) // width for x in vector]
                off = math.sqrt(sum((2 * (x - low - p * width) - width + 1) ** 2 for x, p in zip(vector, places))) / 2
                out.append((row, row_id, len(vector), bytes(places), low, width, off))
            return out

        return encode

    schema = "row bigint, id bigint, size int, cells binary, low bigint, width bigint, off double"
    return map_rows(rows.select("row", "id", "vector"), schema, start)


def centres(frame: pd.DataFrame) -> np.ndarray:
    """Centres of the cells of some rows of the approximation file with equally many components."""
    cells = np.frombuffer(b"".join(frame["cells"]), np.uint8).reshape(len(frame), -1)
    low, width = (frame[c].to_numpy(np.float64)[:, None] for c in ("low", "width"))
    return cells * width + low + (width - 1) / 2


def bounds_in_block(rows: pd.DataFrame, queries: pd.DataFrame, k: int) -> list[tuple[np.ndarray, ...]]:
    """(query rows, row numbers, lower, upper) of the rows of a block that may be a query's best."""
    at, to = centres(rows), centres(queries)
    off, query_off = rows["off"].to_numpy(), queries["off"].to_numpy()
    length, query_length = np.linalg.norm(at, axis=1), np.linalg.norm(to, axis=1)
    row_ids, numbers = rows["id"].to_numpy(), rows["row"].to_numpy()
    query_ids, query_numbers = queries["id"].to_numpy(), queries["row"].to_numpy()
    by_id = np.argsort(row_ids, kind="stable")
    first = np.searchsorted(row_ids[by_id], query_ids, "left")
    last = np.searchsorted(row_ids[by_id], query_ids, "right")
    found = []
    for start in range(0, len(to), QUERIES_AT_ONCE):
        part = slice(start, start + QUERIES_AT_ONCE)
        middle = to[part] @ at.T
        # |x||y| bounds: each factor is its centre, off by no more than its distance from it.
        slack = query_length[part, None] * off + query_off[part, None] * (length + off)
        slack += ROUNDING * (query_length[part, None] + query_off[part, None]) * (length + off)
        lower, upper = middle - slack, middle + slack
        for q in np.flatnonzero(last[part] > first[part]).tolist():
            own = by_id[first[start + q] : last[start + q]]
            lower[q, own] = upper[q, own] = -np.inf
        least = np.full(len(lower), -np.inf)
        if len(at) > k:
            least = np.partition(lower, len(at) - k, axis=1)[:, len(at) - k]
        q, r = np.nonzero((upper >= least[:, None]) & (upper > -np.inf))
        found.append((query_numbers[part][q], numbers[r], lower[q, r], upper[q, r]))
    return found


def top_k(
    df: DataFrame,
    queries: DataFrame,
    k: int = 20,
    id_col: str = "vec_id",
    vector_col: str = "vector",
    rows_per_block: int = ROWS_PER_BLOCK,
    queries_per_block: int = QUERIES_PER_BLOCK,
    cells: int = CELLS,
) -> DataFrame:
    """(query_id, rank, id, score): the k rows with the highest inner product per query.

    Both frames hold an id and an array of integers.
    """

    def stored(frame: DataFrame, name: str, size: int) -> tuple[DataFrame, DataFrame, int]:
        v = F.col(vector_col)
        rows = frame.where(v.isNotNull() & ~F.exists(v, lambda x: x.isNull()))
        rows = rows.where(F.col(id_col).isNotNull()).select(
            F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("bigint").alias("id"),
            F.transform(v, lambda x: x.cast("bigint")).alias("vector"),
        )
        exact = saved(rows, f"vectors-{name}")
        near = saved(approximated(exact, cells), f"cells-{name}")
        return exact, near, max(1, -(-near.count() // size))

    exact, near, row_blocks = stored(df, "rows", rows_per_block)
    asked, asking, query_blocks = stored(queries, "queries", queries_per_block)

    def block(n: int) -> Column:
        return F.pmod(F.xxhash64("row"), F.lit(n)).cast("int")

    # Every row goes to each block of queries and every query to each block of rows.
    left = near.withColumns({"asks": F.lit(False), "a": block(row_blocks)})
    left = left.withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))))
    right = asking.withColumns({"asks": F.lit(True), "b": block(query_blocks)})
    right = right.withColumn("a", F.explode(F.sequence(F.lit(0), F.lit(row_blocks - 1))))
    names = ["query", "row", "lower", "upper"]

    def meet(_: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        asks = frame["asks"].to_numpy(bool)
        found = []
        if asks.any() and not asks.all():
            found = bounds_in_block(frame[~asks], frame[asks], k)
        columns = [np.concatenate(x) for x in zip(*found)] if found else [[]] * 4
        return pd.DataFrame(dict(zip(names, columns)))

    candidates = saved(
        left.unionByName(right).groupBy("size", "a", "b").applyInPandas(
            meet, "query bigint, row bigint, lower double, upper double"
        ),
        "vectors-bounds",
    )

    def kth(frame: DataFrame, value: str, name: str) -> DataFrame:
        """(query, the k-th highest value), for queries that have as many."""
        order = Window.partitionBy("query").orderBy(F.desc(value))
        top = frame.withColumn("__n", F.row_number().over(order)).where(F.col("__n") <= k)
        few = top.groupBy("query").agg(F.min(value).alias(name), F.count(F.lit(1)).alias("__n"))
        return few.where(F.col("__n") == k).drop("__n")

    def at_least(frame: DataFrame, limits: DataFrame, name: str) -> DataFrame:
        met = frame.join(limits, "query", "left")
        return met.where(F.col(name).isNull() | (F.col("upper") >= F.col(name))).drop(name)

    def scored(frame: DataFrame) -> DataFrame:
        """(query, row, query_id, id, score) of the exact vectors."""
        mine = asked.select(F.col("row").alias("query"), F.col("id").alias("query_id"), F.col("vector").alias("asked"))
        product = F.aggregate(
            F.zip_with("asked", "vector", lambda x, y: x * y), F.lit(0).cast("bigint"), lambda a, x: a + x
        )
        return frame.join(mine, "query").join(exact, "row").select(
            "query", "row", "query_id", "id", product.alias("score")
        )

    left_over = saved(at_least(candidates, kth(candidates, "lower", "least"), "least"), "vectors-left")
    best_first = Window.partitionBy("query").orderBy(F.desc("upper"), "row")
    first = left_over.withColumn("__n", F.row_number().over(best_first)).where(F.col("__n") <= k)
    sure = saved(scored(first.select("query", "row")), "vectors-first")
    more = at_least(left_over, kth(sure, "score", "least"), "least").select("query", "row")
    rest = scored(more.join(sure.select("query", "row"), ["query", "row"], "left_anti"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    ranked = sure.unionByName(rest).withColumn("rank", F.row_number().over(order))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias(id_col), "score")
