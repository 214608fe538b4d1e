"""How far the sources of a language are from each other, and the terms that mark a source.

A *group* is a (language, source). Each language keeps the terms that enough of its documents
hold, and each group gives every kept term a smoothed share ``p`` in billionths, from its count
and its total over kept terms; ``q`` is the same for the whole language. Two results:

* ``pair``: the sum of ``|p - p'|`` over all kept terms for every two sources of a language;
* ``term``: per group the ``top`` terms with the largest ``p - q`` above 0 that occur in it.

**Terms by a dominance skyband.** Rows whose share is surely not above the language's go
first, as they mark no source. In a group ``p - q`` cannot fall when the group's count rises
or the language's count falls, and ties go to the earlier term in UTF-8. So a term that ``top``
others *dominate* (no smaller group count, no larger language count, earlier in UTF-8) is none
of the best. Each partition of the counts keeps the terms dominated by
fewer than ``top`` others, reading them in order of group count; the skybands of all partitions
are merged by the same rule, and only what is left is given exact shares and ranked.

**Pairs from what occurs.** A term that neither source holds adds ``|base - base'|``, the
difference of the shares of count 0. Terms of one source depend on the other through its base
alone, so they come from the source's histogram of shares. Only terms that both hold need
both: per term a matrix over the sources that hold it, added up in blocks of ``BLOCK`` sources.
Nothing is proportional to terms times pairs beyond these matrices, and no pair of rows of a
term leaves a task; blocks are sent on when they are many.

Counts are divided as decimals, so nothing overflows or is rounded. Words are counted in the
tasks that read the documents; a task sends its counts on whenever it holds ``HELD_COUNTS``.

Definite results: null texts, languages and sources are read as ''. A group without terms takes
part like any other. A language that keeps no term gives its pairs 0 and no terms, a group that
is alone in its language no pairs, and no documents no rows. Repeated rows count as documents
of their own. Other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weir.llm.common import saved, seldom_collect

LEAST_DOCS = 30
SMOOTHING = 5
WHOLE = 1_000_000_000
TOP = 50
# Relative leeway of shares that are compared as doubles.
LEEWAY = 1e-9
# Different (group, term) counts that a task holds before it sends them on.
HELD_COUNTS = 300_000
# Sources per side of a matrix of pairs, and matrices that a task holds at once.
BLOCK, HELD_BLOCKS = 256, 64
# Parts into which the sources of a language are dealt to meet the others.
PARTS = 32
ROWS_OUT = 65_536

# Letters of ASCII in lower case and all bytes of other characters stay, the rest separates.
LETTERS = bytes(
    b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)

_COUNTS = pa.schema(
    [("lang", pa.string()), ("source", pa.string()), ("term", pa.string()),
     ("n", pa.int64()), ("docs", pa.int64())]
)


def terms_of(text: str) -> list[bytes]:
    """The terms of a text in order."""
    return text.encode().translate(LETTERS).split()


def count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, term, n, docs) of the documents of a task, in as many parts as it takes.

    The term '' stands for the group itself.
    """
    seldom_collect()
    counts: dict[tuple[str, str], tuple[Counter, Counter]] = {}

    def held() -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, docs) in counts.items():
            n[b""] = docs[b""] = 0
            terms = list(n)
            for at in range(0, len(terms), ROWS_OUT):
                part = terms[at : at + ROWS_OUT]
                columns = [
                    pa.repeat(pa.scalar(lang, pa.string()), len(part)),
                    pa.repeat(pa.scalar(source, pa.string()), len(part)),
                    pa.array(part, pa.binary()).cast(pa.string()),
                    pa.array([n[t] for t in part], pa.int64()),
                    pa.array([docs[t] for t in part], pa.int64()),
                ]
                yield pa.RecordBatch.from_arrays(columns, schema=_COUNTS)
        counts.clear()

    size = 0
    for batch in batches:
        for lang, source, text in zip(*[c.to_pylist() for c in batch.columns]):
            n, docs = counts.setdefault((lang, source), (Counter(), Counter()))
            before = len(n)
            words = terms_of(text)
            n.update(words)
            docs.update(set(words))
            size += len(n) - before
            if size >= HELD_COUNTS:
                yield from held()
                size = 0
    yield from held()


def share(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(WHOLE * (count + 5) / (total + 5 * terms)), exact for counts of any size."""
    wide = "decimal(20,0)"
    above = F.lit(WHOLE).cast("decimal(10,0)") * (count.cast(wide) + F.lit(SMOOTHING).cast("decimal(1,0)"))
    below = total.cast(wide) + terms.cast(wide) * F.lit(SMOOTHING).cast("decimal(1,0)")
    return F.lit(1) + F.call_function("div", above, below)


class Skyband:
    """Terms of one group that fewer than ``k`` others dominate, fed by falling group count.

    Whatever dominates a term was fed before it. Terms left out need not be remembered: one
    with ``k`` dominators has ``k`` of them among those kept, its first ones.
    """

    def __init__(self, k: int):
        self.k = k
        self.size = 0
        self.langs = np.zeros(1024, np.int64)
        self.heads = np.zeros(1024, np.uint64)
        self.terms: list[bytes] = []

    def _dominators(self, lang: int, head: int, term: bytes, first: int) -> int:
        """How many of the kept terms from number ``first`` on dominate a term."""
        low = self.langs[first : self.size] <= lang
        heads = self.heads[first : self.size]
        found = int(np.count_nonzero(low & (heads < head)))
        same = np.flatnonzero(low & (heads == head))
        return found + sum(self.terms[first + i] < term for i in same.tolist())

    def feed(self, langs: np.ndarray, heads: np.ndarray, terms: list[bytes]) -> list[int]:
        """Numbers of the kept ones among the next terms, at most a few hundred at a time."""
        kept, before = [], self.size
        below = np.zeros(len(langs), np.int64)
        if before:
            low = self.langs[None, :before] <= langs[:, None]
            below = np.count_nonzero(low & (self.heads[None, :before] < heads[:, None]), axis=1)
        for i in np.flatnonzero(below < self.k).tolist():
            lang, head, term = langs[i], heads[i], terms[i]
            n = int(below[i]) + self._dominators(lang, head, term, before)
            if before and n < self.k:
                same = np.flatnonzero((self.heads[:before] == head) & (self.langs[:before] <= lang))
                n += sum(self.terms[j] < term for j in same.tolist())
            if n >= self.k:
                continue
            if self.size == len(self.langs):
                self.langs = np.concatenate([self.langs, np.zeros_like(self.langs)])
                self.heads = np.concatenate([self.heads, np.zeros_like(self.heads)])
            self.langs[self.size], self.heads[self.size] = lang, head
            self.terms.append(term)
            self.size += 1
            kept.append(i)
        return kept


def _runs(columns: list[list]) -> Iterator[tuple[int, int]]:
    """Starts and ends of the runs of rows that agree in all columns."""
    rows = list(zip(*columns))
    start = 0
    for i in range(1, len(rows) + 1):
        if i == len(rows) or rows[i] != rows[start]:
            yield start, i
            start = i


def skybands(rows: DataFrame, k: int) -> DataFrame:
    """Rows (lang, source, term, n, lang_n) left by a skyband of every group in every partition."""
    order = ["lang", "source", F.desc("n"), "lang_n", "term"]

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, band = None, Skyband(k)
        for batch in batches:
            langs, sources = (batch.column(i).to_pylist() for i in (0, 1))
            terms = batch.column(2).cast(pa.binary()).to_pylist()
            heads = np.frombuffer(b"".join(t[:8].ljust(8, b"\0") for t in terms), ">u8").astype(np.uint64)
            counts = batch.column(4).to_numpy()
            kept = []
            for start, end in _runs([langs, sources]):
                if key != (langs[start], sources[start]):
                    key, band = (langs[start], sources[start]), Skyband(k)
                for at in range(start, end, 256):
                    to = min(at + 256, end)
                    kept += [at + i for i in band.feed(counts[at:to], heads[at:to], terms[at:to])]
            if kept:
                yield batch.take(pa.array(kept, pa.int64()))

    rows = rows.select("lang", "source", "term", "n", "lang_n")
    return rows.sortWithinPartitions(*order).mapInArrow(keep, rows.schema)


def may_mark(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """The rows whose share in the group may be above the one in the language.

    Rounding down keeps the order of shares, so the fractions tell; in doubles, with more
    leeway than these can be wrong by. The exact shares of what is left are compared later.
    """
    totals = groups.select("lang", "source", "total", "terms", "lang_total")
    n, lang_n, total, terms, lang_total = (
        F.col(c).cast("double") for c in ("n", "lang_n", "total", "terms", "lang_total")
    )
    own = (n + SMOOTHING) * (lang_total + SMOOTHING * terms)
    whole = (lang_n + SMOOTHING) * (total + SMOOTHING * terms)
    return rows.join(totals, ["lang", "source"]).where(own * (1 + LEEWAY) >= whole).select(*rows.columns)


_SUMS = pa.schema(
    [("lang", pa.string()), ("lo", pa.int64()), ("hi", pa.int64()), ("value", pa.int64())]
)


class PairSums:
    """Sums per pair of sources in blocks, handed on when a task holds many."""

    def __init__(self) -> None:
        self.blocks: dict[tuple[str, int, int], np.ndarray] = {}

    def handed_on(self) -> Iterator[pa.RecordBatch]:
        for (lang, i, j), block in self.blocks.items():
            a, b = np.nonzero(block)
            lo, hi = a + i * BLOCK, b + j * BLOCK
            use = lo < hi
            values = [pa.array(x[use]) for x in (lo, hi, block[a, b])]
            langs = pa.repeat(pa.scalar(lang, pa.string()), len(values[0]))
            yield pa.RecordBatch.from_arrays([langs, *values], schema=_SUMS)
        self.blocks.clear()

    def add(self, lang: str, place: np.ndarray, p: np.ndarray, base: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Add one term: the sources that hold it, their shares and their shares of count 0."""
        order = np.argsort(place)
        place, p, base = place[order], p[order], base[order]
        # The sources of a block lie together.
        cuts = [0, *(np.flatnonzero(np.diff(place // BLOCK)) + 1).tolist(), len(place)]
        sides = [slice(a, b) for a, b in zip(cuts, cuts[1:])]
        for x, left in enumerate(sides):
            pa_, ba = p[left, None], base[left, None]
            for right in sides[x:]:
                pb, bb = p[None, right], base[None, right]
                more = np.abs(pa_ - pb) - np.abs(pa_ - bb) - np.abs(ba - pb) + np.abs(ba - bb)
                at = (lang, int(place[left][0]) // BLOCK, int(place[right][0]) // BLOCK)
                if at not in self.blocks:
                    if len(self.blocks) >= HELD_BLOCKS:
                        yield from self.handed_on()
                    self.blocks[at] = np.zeros((BLOCK, BLOCK), np.int64)
                self.blocks[at][np.ix_(place[left] % BLOCK, place[right] % BLOCK)] += more


def add_common(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of pairs for rows (lang, term, place, p, base) in the order of language and term."""
    sums = PairSums()
    # The last term of a batch may go on in the next one.
    held: list[tuple[np.ndarray, ...]] = []
    key = None
    for batch in batches:
        langs, terms = (batch.column(i).to_pylist() for i in (0, 1))
        values = [batch.column(i).to_numpy() for i in (2, 3, 4)]
        for start, end in _runs([langs, terms]):
            if key is not None and key != (langs[start], terms[start]):
                yield from sums.add(key[0], *map(np.concatenate, zip(*held)))
                held = []
            key = (langs[start], terms[start])
            held.append(tuple(v[start:end] for v in values))
    if key is not None:
        yield from sums.add(key[0], *map(np.concatenate, zip(*held)))
    yield from sums.handed_on()


def common_terms(rows: DataFrame) -> DataFrame:
    """(lang, lo, hi, value): what the terms that two sources share change in their distance.

    ``rows`` holds (lang, term, place, p, base), ``place`` being the number of a source in its
    language; ``lo`` < ``hi`` are such numbers. Several rows of a pair are parts of one sum.
    """
    rows = rows.select("lang", "term", "place", "p", "base").repartition("lang", "term")
    ordered = rows.sortWithinPartitions("lang", "term")
    return ordered.mapInArrow(add_common, "lang string, lo bigint, hi bigint, value bigint")


def source_pairs(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, source, item, value) for every two different sources of a language.

    ``rows`` holds (lang, term, place, p, base), ``groups`` (lang, source, place, base, terms).
    """
    shares = rows.groupBy("lang", "place", "p").agg(F.count(F.lit(1)).alias("n"))
    # A group has no more different shares than different counts of its terms.
    shares = shares.groupBy("lang", "place").agg(F.collect_list(F.struct("p", "n")).alias("shares"))
    some = groups.join(shares, ["lang", "place"], "left").withColumn("part", F.col("place") % PARTS)
    some = some.select("lang", "part", "place", "base", "terms", "shares")
    others = groups.select(
        "lang", F.col("place").alias("to"), F.col("base").alias("to_base"),
        F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(PARTS - 1).cast("bigint"))).alias("part"),
    )
    base, to_base = F.col("base"), F.col("to_base")
    apart = F.abs(base - to_base)
    own = F.aggregate(
        F.coalesce("shares", F.array().cast("array<struct<p:bigint,n:bigint>>")),
        F.lit(0).cast("bigint"),
        lambda sum_, x: sum_ + x["n"] * (F.abs(x["p"] - to_base) - apart),
    )
    # What no source holds is added once per pair.
    neither = F.when(F.col("place") < F.col("to"), F.col("terms") * apart).otherwise(0)
    single = some.join(others, ["lang", "part"]).where("place <> to").select(
        "lang", F.least("place", "to").alias("lo"), F.greatest("place", "to").alias("hi"),
        (own + neither).alias("value"),
    )
    sums = single.unionByName(common_terms(rows)).groupBy("lang", "lo", "hi").agg(F.sum("value").alias("value"))
    both = sums.select(
        "lang", "value",
        F.explode(F.array(
            F.struct(F.col("lo").alias("place"), F.col("hi").alias("other")),
            F.struct(F.col("hi").alias("place"), F.col("lo").alias("other")),
        )).alias("x"),
    ).select("lang", "x.place", "x.other", "value")
    names = groups.select("lang", "place", "source")
    items = groups.select("lang", F.col("place").alias("other"), F.col("source").alias("item"))
    return both.join(names, ["lang", "place"]).join(items, ["lang", "other"]).select(
        "lang", "source", "item", "value"
    )


def ranked(rows: DataFrame, part: str) -> DataFrame:
    """(lang, source, part, item, value, rank), the largest value first."""
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return rows.select(
        "lang", "source", F.lit(part).alias("part"), "item", "value", F.row_number().over(order).alias("rank")
    )


def audit(
    df: DataFrame,
    lang_col: str = "lang",
    source_col: str = "source",
    text_col: str = "text",
    least_docs: int = LEAST_DOCS,
    top: int = TOP,
) -> DataFrame:
    """(lang, source, part, item, value, rank): parts ``pair`` (all ranks) and ``term``."""
    texts = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in (lang_col, source_col, text_col)]
    read = df.select(texts[0].alias("lang"), texts[1].alias("source"), texts[2].alias("text"))
    counted = read.mapInArrow(count_terms, "lang string, source string, term string, n bigint, docs bigint")
    counts = saved(
        counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")),
        "divergence-counts",
    )
    real = counts.where("term <> ''")
    kept = saved(
        real.groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("docs").alias("docs"))
        .where(F.col("docs") >= least_docs).drop("docs"),
        "divergence-kept",
    )
    rows = saved(
        real.join(kept, ["lang", "term"]).select("lang", "source", "term", "n", "lang_n"), "divergence-terms"
    )

    languages = kept.groupBy("lang").agg(
        F.count(F.lit(1)).alias("terms"), F.sum("lang_n").alias("lang_total")
    )
    totals = rows.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    none = F.lit(0).cast("bigint")
    base = F.when(F.col("terms") > 0, share(none, F.col("total"), F.col("terms"))).otherwise(none)
    number = F.row_number().over(Window.partitionBy("lang").orderBy("source")).cast("bigint")
    groups = saved(
        counts.where("term = ''").select("lang", "source")
        .join(totals, ["lang", "source"], "left").join(languages, "lang", "left")
        .withColumns({c: F.coalesce(c, none) for c in ("total", "terms", "lang_total")})
        .withColumns({"base": base, "place": number}),
        "divergence-groups",
    )

    merged = skybands(skybands(may_mark(rows, groups), top).repartition("lang", "source"), top)
    p = share(F.col("n"), F.col("total"), F.col("terms"))
    q = share(F.col("lang_n"), F.col("lang_total"), F.col("terms"))
    over = merged.join(groups, ["lang", "source"]).select(
        "lang", "source", F.col("term").alias("item"), (p - q).alias("value")
    )
    terms = ranked(over.where("value > 0"), "term").where(F.col("rank") <= top)

    placed = rows.join(groups, ["lang", "source"]).select("lang", "term", "place", p.alias("p"), "base")
    return ranked(source_pairs(placed, groups), "pair").unionByName(terms)
