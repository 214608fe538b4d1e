"""Line dedup: repeated windows of three lines keep their first occurrence.

Lines are trimmed and blank ones skipped; every three consecutive lines of a document form a
window, named by two 64-bit hashes. The first occurrence of a window, by document id and
line, stays. All later ones go: the lines that they cover are merged and removed, with the
blank lines between them.

Only windows that occur again are joined back, from a written table, so that adaptive
execution can split the partition of a very frequent one.

Definite results: documents with fewer than three non-blank lines, null and empty texts stay
as they are. A null id sorts first. Rows with the same id count as one place: the same window
at the same line of both is no repeat; rows that are equal altogether get equal results.
Other columns pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weir.llm.common import saved

LINES = 3


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def windows_of(text: Column, lines: int = LINES) -> Column:
    """array<struct<first, last, h1, h2>>: the windows of a text with the lines they span."""
    trimmed = F.transform(
        lines_of(text), lambda x, i: F.struct(F.btrim(x, F.lit(" \t\r\f\x0b")).alias("t"), i.alias("i"))
    )
    full = F.filter(trimmed, lambda x: x["t"] != "")

    def window(a: Column, i: Column) -> Column:
        part = [a[i + j]["t"] for j in range(lines)]
        return F.struct(
            a[i]["i"].alias("first"), a[i + (lines - 1)]["i"].alias("last"),
            F.xxhash64(*part).alias("h1"), F.xxhash64(F.lit("again"), *reversed(part)).alias("h2"),
        )

    def all_windows(a: Column) -> Column:
        # Bound to a name, the filtered lines are worked out once and not once per window.
        ends = F.sequence(F.lit(0), F.greatest(F.size(a) - lines, F.lit(0)))
        return F.when(F.size(a) >= lines, F.transform(ends, lambda i: window(a, i)))

    return F.transform(F.array(full), all_windows)[0]


def remove_repeats(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lines: int = LINES
) -> DataFrame:
    """The rows with their text cleaned, and ``n_lines``, ``n_removed`` (both counts of lines)."""
    text, row_id = F.col(text_col), F.col(id_col)
    found = df.select(
        row_id.alias("id"), F.xxhash64(text).alias("th"), F.explode(windows_of(text, lines)).alias("w")
    ).select("id", "th", "w.*")
    place = F.struct("id", "first")
    again = saved(
        found.groupBy("h1", "h2")
        .agg(F.min(place).alias("kept"), F.max(place).alias("end"))
        .where(F.col("kept") < F.col("end"))
        .select("h1", "h2", "kept"),
        "repeated-windows",
    )
    covered = (
        found.join(again, ["h1", "h2"])
        .where(place > F.col("kept"))
        .groupBy("id", "th")
        .agg(F.collect_set(F.sequence("first", "last")).alias("__spans"))
        .withColumnsRenamed({"id": "__id", "th": "__th"})
    )
    same = row_id.eqNullSafe(F.col("__id")) & (F.xxhash64(text) == F.col("__th"))
    joined = df.join(covered, same, "left").drop("__id", "__th")

    def rest(a: Column) -> Column:
        gone = F.flatten("__spans")
        left = F.array_except(F.sequence(F.lit(0), F.size(a) - 1), gone)
        return F.struct(
            F.array_join(F.transform(left, lambda i: a[i]), "\n").alias("text"),
            F.size(left).alias("n"),
        )

    cleaned = F.when(
        F.col("__spans").isNotNull(), F.transform(F.array(lines_of(text)), rest)[0]
    )
    n_lines = F.size(lines_of(text))
    others = [c for c in df.columns if c not in (text_col, "n_lines", "n_removed")]
    return joined.withColumn("__rest", cleaned).select(
        *others,
        F.coalesce("__rest.text", text).alias(text_col),
        n_lines.cast("bigint").alias("n_lines"),
        F.coalesce(n_lines - F.col("__rest.n"), F.lit(0)).cast("bigint").alias("n_removed"),
    )
