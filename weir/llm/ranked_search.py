"""Ranked lexical search in an index stratified by document length.

The score of a document is the sum over an item's terms of ``w * impact(tf, m)`` with

    impact(tf, m) = (10^9 * tf) div (1000 * tf + 20 * m),    m = 50 + (50 * n * N) div L,

``n`` being the document's terms, ``N`` the number of documents with terms, ``L`` all their
terms, and ``w = floor(1000 * ln((2N + 2) / (2 df + 1)))``. Documents of equal ``m`` form a
*stratum*, in which an impact depends on the term frequency alone:

* the index is sorted by ``m`` over range partitions, so strata lie together and a stratum with
  very many documents is cut between tasks; each task reads it in portions of ``PORTION``
  postings and orders those by (stratum, term, frequency, falling);
* impacts are worked out once per stratum and frequency. The first posting of a term in a
  stratum gives its best impact there, and the sum of these with the weights bounds every
  score in the stratum;
* per item strata are visited by falling bound, until ``top`` documents beat the next bound.
  A stratum whose bound equals the last score is visited: its ids may be smaller.

A task keeps ``top`` documents per item; the best of those of all tasks are the result.

The index holds the terms that are asked for: the items come in blocks of about ``ASKED`` terms,
and each block reads the documents once. Everything that depends on the collection (N, L, df)
is counted over all documents. What goes to the driver and out to the tasks is one block's
terms and weights.

Definite results: null texts and texts without terms rank nowhere and do not count in N. Rows
are documents each, also when ids repeat; null ids come last among equal scores. Rows of one
item id (null included) are one item with the terms of all of them; an item without terms, or
none of whose terms occur, has no rows. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from weir.llm.common import map_rows, saved, seldom_collect

TOP = 50
# Terms of items that are searched with one reading of the documents.
ASKED = 200_000
# Postings that a task holds at once.
PORTION = 2_000_000
ROWS_OUT = 4_096
UNIT = 1_000_000_000

# Digits and lower-case letters of ASCII and all bytes of other characters stay.
SIGNS = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32
    for b in range(256)
)


def terms_of(text: str | None) -> list[bytes]:
    """The terms of a text in order."""
    return (text or "").encode().translate(SIGNS).split()


def weight(documents: int, holding: int) -> int:
    """Weight of a term that ``holding`` of ``documents`` hold."""
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * holding + 1)))


def item_terms(items: DataFrame, item_col: str, text_col: str) -> DataFrame:
    """(item, term): the distinct terms of every item."""

    def start():
        return lambda rows: [(i, t.decode()) for i, text in rows for t in dict.fromkeys(terms_of(text))]

    kind = dict(items.dtypes)[item_col]
    read = items.select(F.col(item_col).alias("item"), F.col(text_col).cast("string"))
    return map_rows(read, f"item {kind}, term string", start).distinct()


def term_counts(df: DataFrame, id_col: str, text_col: str, terms: dict[bytes, int]) -> DataFrame:
    """(id, n, terms, tfs) of the documents with terms.

    ``n`` counts all terms, ``terms`` holds the numbers of the asked ones that occur and
    ``tfs`` how often.
    """
    kind = dict(df.dtypes)[id_col]
    out = _parse_datatype_string(f"id {kind}, n bigint, terms array<int>, tfs array<int>")
    schema = to_arrow_schema(out)
    shared = df.sparkSession.sparkContext.broadcast(terms)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seldom_collect()
        number = shared.value.get
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                rows, sizes, found, times = [], [], [], []
                for i, text in enumerate(batch.column(1).to_pylist()):
                    words = terms_of(text)
                    if not words:
                        continue
                    # Numbers start at 1, so unknown words drop out.
                    known = np.fromiter(filter(None, map(number, words)), np.int32)
                    ids, tf = np.unique(known, return_counts=True)
                    rows.append(i)
                    sizes.append((len(words), len(ids)))
                    found.append(ids)
                    times.append(tf.astype(np.int32))
                if not rows:
                    continue
                ends = pa.array(np.cumsum([0, *(s for _, s in sizes)]), pa.int32())
                columns = [
                    batch.column(0).take(pa.array(rows)),
                    pa.array([n for n, _ in sizes], pa.int64()),
                    pa.ListArray.from_arrays(ends, pa.array(np.concatenate(found), pa.int32())),
                    pa.ListArray.from_arrays(ends, pa.array(np.concatenate(times), pa.int32())),
                ]
                columns = [c.cast(f.type) for c, f in zip(columns, schema)]
                yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return df.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(count, out)


def spans(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The numbers of all given spans, one after another."""
    sizes = ends - starts
    before = np.cumsum(sizes) - sizes
    return np.repeat(starts - before, sizes) + np.arange(int(sizes.sum()))


class Strata:
    """Postings of documents sorted by ``m``, ordered by stratum, term and falling frequency."""

    def __init__(self, ids: np.ndarray, known: np.ndarray, m: np.ndarray,
                 sizes: np.ndarray, terms: np.ndarray, tfs: np.ndarray):
        self.ids, self.known = ids, known
        self.m, first = np.unique(m, return_index=True)
        self.first = np.append(first, len(m))
        row = np.repeat(np.arange(len(m)), sizes)
        stratum = np.searchsorted(self.first, row, "right") - 1
        order = np.lexsort((-tfs, terms, stratum))
        row, stratum, terms, tfs = row[order], stratum[order], terms[order], tfs[order].astype(np.int64)
        self.row = row
        # One impact per stratum and frequency.
        pairs, place = np.unique((stratum.astype(np.int64) << 32) | tfs, return_inverse=True)
        tf, at = pairs & 0xFFFFFFFF, pairs >> 32
        self.impact = (UNIT * tf // (1000 * tf + 20 * self.m[at]))[place]
        # Lists: the postings of a term in a stratum, found by term.
        new = np.flatnonzero(np.r_[True, (np.diff(stratum) != 0) | (np.diff(terms) != 0)]) if len(row) else []
        new = np.asarray(new, np.int64)
        end = np.append(new[1:], len(row))
        by_term = np.lexsort((stratum[new], terms[new]))
        self.start, self.end = new[by_term], end[by_term]
        self.term, self.stratum = terms[new][by_term], stratum[new][by_term]
        self.best = self.impact[self.start]

    def search(self, terms: np.ndarray, weights: np.ndarray, found: Best) -> None:
        """Offer the documents of every stratum that may hold one of the best."""
        low, high = np.searchsorted(self.term, terms), np.searchsorted(self.term, terms, "right")
        lists = spans(low, high)
        if not len(lists):
            return
        w = np.repeat(weights, high - low)
        order = np.argsort(self.stratum[lists], kind="stable")
        lists, w = lists[order], w[order]
        strata, begin = np.unique(self.stratum[lists], return_index=True)
        bound = np.add.reduceat(w * self.best[lists], begin)
        begin = np.append(begin, len(lists))
        for i in np.argsort(-bound, kind="stable").tolist():
            if bound[i] < max(found.least, 1):
                break
            mine = lists[begin[i] : begin[i + 1]]
            first, last = self.first[strata[i]], self.first[strata[i] + 1]
            postings = spans(self.start[mine], self.end[mine])
            each = np.repeat(w[begin[i] : begin[i + 1]], self.end[mine] - self.start[mine])
            scores = np.zeros(last - first, np.int64)
            np.add.at(scores, self.row[postings] - first, each * self.impact[postings])
            good = np.flatnonzero(scores >= max(found.least, 1))
            if len(good):
                found.offer(scores[good], self.ids[first + good], self.known[first + good])


class Best:
    """The ``top`` highest scores of one item; smaller ids first, unknown ids last."""

    def __init__(self, top: int):
        self.top = top
        self.least = 0
        self.scores, self.ids = np.zeros(0, np.int64), np.zeros(0, object)
        self.known = np.zeros(0, bool)

    def offer(self, scores: np.ndarray, ids: np.ndarray, known: np.ndarray) -> None:
        scores, ids = np.concatenate([self.scores, scores]), np.concatenate([self.ids, ids])
        known = np.concatenate([self.known, known])
        order = np.lexsort((ids, ~known, -scores))[: self.top]
        self.scores, self.ids, self.known = scores[order], ids[order], known[order]
        if len(order) == self.top:
            self.least = int(self.scores[-1])


def best_of_parts(index: DataFrame, items: list[tuple], top: int, portion: int, item_kind: str) -> DataFrame:
    """(item, id, score): the best of every partition of an index (id, m, terms, tfs) sorted by m.

    ``items`` holds (item, term numbers, weights).
    """
    kind = dict(index.dtypes)["id"]
    out = _parse_datatype_string(f"item {item_kind}, id {kind}, score bigint")
    schema = to_arrow_schema(out)
    shared = index.sparkSession.sparkContext.broadcast(items)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = shared.value
        found = [Best(top) for _ in asked]
        held: list[pa.RecordBatch] = []
        size = 0

        def look() -> None:
            whole = pa.Table.from_batches(held).combine_chunks()
            ids = whole["id"].combine_chunks()
            lists = [whole[c].combine_chunks() for c in ("terms", "tfs")]
            known = ids.is_valid().to_numpy(zero_copy_only=False)
            strata = Strata(
                ids.fill_null(0).to_numpy(zero_copy_only=False), known, whole["m"].to_numpy(),
                np.diff(lists[0].offsets.to_numpy()), *[x.flatten().to_numpy() for x in lists],
            )
            for (_, terms, weights), best in zip(asked, found):
                strata.search(terms, weights, best)

        for whole in batches:
            for at in range(0, whole.num_rows, ROWS_OUT):
                batch = whole.slice(at, ROWS_OUT)
                held.append(batch)
                size += len(batch.column(2).flatten())
                if size >= portion:
                    look()
                    held, size = [], 0
        if held:
            look()
        for (item, *_), best in zip(asked, found):
            n = len(best.scores)
            if n:
                ids = pa.array(best.ids.tolist(), schema.field("id").type, mask=~best.known)
                columns = [pa.array([item] * n, schema.field("item").type), ids, pa.array(best.scores)]
                yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return index.select("id", "m", "terms", "tfs").mapInArrow(search, out)


def search(
    df: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    top: int = TOP,
    asked: int = ASKED,
    portion: int = PORTION,
) -> DataFrame:
    """(item, rank, id, score): the ``top`` documents of every item with a score above 0.

    Ids of documents are whole numbers.
    """
    wanted = saved(item_terms(items, item_col, item_text_col), "search-items")
    blocks = max(1, -(-wanted.count() // asked))
    kind = dict(items.dtypes)[item_col]
    parts = []
    for block in range(blocks):
        # The terms of one block; an item is not split.
        rows = wanted.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == block).collect()
        numbers = {t: i + 1 for i, t in enumerate(sorted({r.term.encode() for r in rows}))}
        docs = saved(term_counts(df, id_col, text_col, numbers), f"search-documents-{block}")
        total = docs.agg(F.count(F.lit(1)).alias("n"), F.sum("n").alias("terms")).first()
        holding = docs.select(F.explode("terms").alias("term")).groupBy("term").count()
        df_of = {r["term"]: r["count"] for r in holding.collect()}
        per_item: dict = {}
        for r in rows:
            term = numbers[r.term.encode()]
            if term in df_of:
                per_item.setdefault(r.item, []).append((term, weight(total["n"], df_of[term])))
        asked_items = [
            (item, *[np.array(x, np.int64) for x in zip(*sorted(terms))]) for item, terms in per_item.items()
        ]
        wide = F.lit(50) * F.col("n").cast("decimal(20,0)") * F.lit(total["n"]).cast("decimal(15,0)")
        m = F.lit(50) + F.call_function("div", wide, F.lit(total["terms"] or 1).cast("decimal(20,0)"))
        index = docs.where(F.size("terms") > 0).select("id", m.alias("m"), "terms", "tfs")
        # Equal m are spread by the hash of the id, so no stratum needs to fit a task.
        index = index.repartitionByRange("m", F.xxhash64("id")).sortWithinPartitions("m")
        parts.append(best_of_parts(index, asked_items, top, portion, kind))
    near = parts[0]
    for more in parts[1:]:
        near = near.unionByName(more)
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("id"))
    ranked = near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.select(F.col("item").alias(item_col), "rank", F.col("id").alias(id_col), "score")
