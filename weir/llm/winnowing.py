"""Document fingerprints by winnowing.

A text is cut into units, runs of up to ``UNIT`` characters other than white space, so that
words stay whole and unbroken text still has parts. Every ``k`` consecutive units are hashed,
and of every ``w`` consecutive hashes the smallest is kept, of equal ones the rightmost, with
its position. Two texts that share a run of ``k + w - 1`` units therefore share a kept hash.
Units of an unbroken run are counted from its start, so this does not hold in text without
ASCII white space (Chinese, Japanese, Thai, base64, long urls): a passage whose offset in its run
differs modulo ``UNIT`` has other units, and may share no hash. Each hash is the md5 of its units;
there is no rolling hash.

Everything is built from array functions; intermediate arrays are bound to names by
``transform(array(x), ...)``, which works them out once.

Definite results: null and empty texts, and texts of white space alone, have an empty
fingerprint; a text of fewer than ``k`` units has one hash of them all. Two empty fingerprints
are alike (1.0), an empty and another are not (0.0). In the order of ids null comes last and
rows with the same id are ordered by text. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

K, W, UNIT = 3, 6, 8
SPACE = r"[^ \t\n\x0B\f\r]"
SLOTS_PER_PARTITION = 3


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value worked out once."""
    return F.transform(F.array(value), use)[0]


def upto(n: Column) -> Column:
    return F.sequence(F.lit(0), F.greatest(n, F.lit(0)))


def fingerprint(text: Column, k: int = K, w: int = W, unit: int = UNIT) -> Column:
    """struct<hashes: array<bigint>, positions: array<int>>: what is kept, in text order."""
    units = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"{SPACE}{{1,{unit}}}"), F.lit(0))

    def hashes(u: Column) -> Column:
        def gram(i: Column) -> Column:
            # Units beyond the end of a short text are null, which concat_ws leaves out.
            joined = F.concat_ws(" ", *[F.get(u, i + j) for j in range(k)])
            return F.conv(F.substring(F.md5(joined), 1, 15), 16, 10).cast("bigint")

        none = F.array().cast("array<bigint>")
        return F.when(F.size(u) > 0, F.transform(upto(F.size(u) - k), gram)).otherwise(none)

    def winnow(h: Column) -> Column:
        least = F.transform(
            F.when(F.size(h) > 0, upto(F.size(h) - w)).otherwise(F.array().cast("array<int>")),
            lambda i: F.least(*[F.get(h, i + j) for j in range(w)]),
        )

        def rightmost(smallest: Column, i: Column) -> Column:
            place = F.when(F.get(h, i + (w - 1)) == smallest, i + (w - 1))
            for j in range(w - 2, 0, -1):
                place = place.when(F.get(h, i + j) == smallest, i + j)
            return place.otherwise(i)

        # The places never go back, so equal ones follow one another.
        changed = bound(
            F.transform(least, rightmost),
            lambda p: F.filter(p, lambda x, i: (i == 0) | (x != F.get(p, i - 1))),
        )
        return bound(
            changed,
            lambda p: F.struct(
                F.transform(p, lambda x: F.get(h, x)).alias("hashes"), p.alias("positions")
            ),
        )

    return bound(bound(units, hashes), winnow)


def likeness(a: Column, b: Column) -> Column:
    """Share of the distinct hashes of two arrays that both have."""
    both = F.size(F.array_union(a, b))
    return F.when(both == 0, F.lit(1.0)).otherwise(
        F.size(F.array_intersect(a, b)).cast("double") / both.cast("double")
    )


def with_next(df: DataFrame, id_col: str, columns: list[str], tie: str) -> DataFrame:
    """Put columns ``next_...`` of the next row, by descending id, next to every row.

    The row after the last is the first.
    Ids are cut into ranges at values that some rows have. A range takes a copy of the rows
    that begin the next one, so every range is worked on alone and rows move once.
    """
    row_id = F.col(id_col)
    slots = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) * SLOTS_PER_PARTITION
    shares = [i / slots for i in range(1, slots)]
    cuts, top = df.agg(F.percentile_approx(row_id, shares, 20_000), F.max(row_id)).first()
    cuts = sorted(set(cuts or []))
    begins = F.array(*[F.lit(c).cast("bigint") for c in cuts]).cast("array<bigint>")
    slot = F.size(F.filter(begins, lambda c: row_id.isNull() | (c >= row_id)))
    last = F.lit(len(cuts))
    starts = F.when(F.array_contains(begins, row_id), F.struct((slot - 1).alias("slot"), F.lit(1).alias("copy")))
    first = F.when(row_id.eqNullSafe(F.lit(top)), F.struct(last.alias("slot"), F.lit(2).alias("copy")))
    own = F.struct(slot.alias("slot"), F.lit(0).alias("copy"))
    spread = df.select("*", F.explode(F.array_compact(F.array(own, starts, first))).alias("__in"))
    order = Window.partitionBy("__in.slot").orderBy(
        F.expr("__in.copy = 2"), row_id.desc_nulls_last(), F.col(tie)
    )
    # Each column by itself: a struct of them would be shuffled as a second copy.
    ahead = {f"next_{c}": F.lead(c).over(order) for c in columns}
    return spread.withColumns(ahead).where("__in.copy = 0").drop("__in")


def edited_likeness(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, w: int = W
) -> DataFrame:
    """Fingerprints of every text and of the text with its last third taken from the next one.

    (id, n_chars, edited_text, prints, edited_prints, near_edited, near_next)
    """
    texts = df.select(id_col, F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    n = F.length("text")
    third = F.floor(n / 3).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - third), F.substring("next_text", F.lit(1), third))
    # Only texts move. A fingerprint takes more room than its text, so that of the next text
    # is worked out again where it is needed.
    found = with_next(texts, id_col, ["text"], "text").withColumn("edited_text", edited)
    found = found.withColumns(
        {
            "prints": fingerprint(F.col("text"), k, w),
            "edited_prints": fingerprint(F.col("edited_text"), k, w),
            "next_prints": fingerprint(F.col("next_text"), k, w),
        }
    )
    return found.select(
        id_col, n.cast("bigint").alias("n_chars"), "edited_text", "prints", "edited_prints",
        likeness(F.col("prints.hashes"), F.col("edited_prints.hashes")).alias("near_edited"),
        likeness(F.col("prints.hashes"), F.col("next_prints.hashes")).alias("near_next"),
    )
