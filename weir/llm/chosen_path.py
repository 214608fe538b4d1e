"""Near-duplicates by a Chosen Path similarity join of shingle sets.

Every set is embedded as ``TOKENS`` minwise tokens. A tree splits the documents by the value
of one token; every node that is still large chooses one or two more tokens by a hash of its
path and splits its documents by their values, and so on. Documents as similar as asked for
stay together along some path with good odds, others part soon. ``TREES`` independent trees
lift the recall of what one tree may miss. Small nodes are compared exhaustively.

Candidate pairs are those whose tokens agree often enough, 4.5 standard errors below the
threshold, and whose odd sketches allow it: an odd sketch is a row of bits, each turned over
once per shingle that falls on it, so two sets differ in at least as many shingles as their
sketches in bits. That bound is never wrong, and it is sharp where tokens alone leave a large
group of copies somewhat below the threshold undecided. Each candidate is confirmed on the
full sets:

1. in each of ``PIVOTS`` rounds every root node has a pivot, and each document is confirmed
   against the most similar pivot of another component that it met; this links large groups
   of near copies without comparing all of them;
2. nodes whose documents are in one component are done, the others are split until they are
   small, and compared across components only;
3. the components of all links are the result.

Equal sets are one document from the start, so copies cost nothing. Nothing is capped: a node
that stays large to the last level is compared in blocks.

Definite results: documents without words have an empty set and are linked with nothing, as
are rows without an id. Rows that share an id are one document, with a set for each of their
texts. Repeated rows get equal results; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weir.llm.common import map_rows, return_memory, saved
from weir.llm.components import components

SHINGLE = 5
PERCENT = 75
TREES, TOKENS = 16, 128
# A node is split while more documents than this are outside its main component.
SMALL_NODE = 512
LEVELS = 16
# Pivots that the documents of a root node are compared with before all others.
PIVOTS = 4
# Members that are sent to one copy of a document to be compared with it.
MEMBERS = 64
ERRORS = 4.5
# Bits of the odd sketch; sharp up to about half as many shingles, a valid bound for more.
ODD_BITS = 2048
# A sketch: a byte of each token, the odd sketch, and the size of the set.
_ODD = slice(TOKENS, TOKENS + ODD_BITS // 8)
_SIZE = slice(_ODD.stop, _ODD.stop + 8)
# Pairs of a block that are compared at once.
PAIRS = 2048
KEPT_WORDS = 400_000

_SEEDS = np.array(
    [xxhash.xxh64_intdigest(f"token {i}") | 1 for i in range(TOKENS)], np.uint64
)
_ADDED = np.array([xxhash.xxh64_intdigest(f"shift {i}") for i in range(TOKENS)], np.uint64)
_BASE, _MIX, _TOP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(56)


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= KEPT_WORDS:
            self.clear()
        found = self[word] = xxhash.xxh64_intdigest(word)
        return found


class Shingles:
    """Hashed shingle sets of texts."""

    def __init__(self, size: int = SHINGLE):
        self.size = size
        self.hashes = _Hashes()

    def of(self, text: str | None) -> np.ndarray:
        """Sorted distinct 64-bit hashes of the runs of ``size`` words; shorter texts are one run."""
        words = (text or "").encode().lower().split()
        if not words:
            return np.zeros(0, np.uint64)
        if len(words) < self.size:
            return np.array([xxhash.xxh64_intdigest(b" ".join(words), 1)], np.uint64)
        h = np.fromiter(map(self.hashes.__getitem__, words), np.uint64, len(words))
        n = len(h) - self.size + 1
        total = h[:n].copy()
        for i in range(1, self.size):
            total = total * _BASE + h[i : n + i]
        total ^= total >> np.uint64(32)
        total *= _MIX
        total ^= total >> np.uint64(29)
        return np.unique(total)


def minima(found: np.ndarray) -> np.ndarray:
    """The minwise token values of a set."""
    best = np.full(TOKENS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(found), 1024):
        part = found[None, at : at + 1024] * _SEEDS[:, None] + _ADDED[:, None]
        np.minimum(best, part.min(1), out=best)
    return best


def odd_sketch(found: np.ndarray) -> np.ndarray:
    """Bits, packed to bytes, that tell on which places an odd number of the set falls."""
    at = (found >> np.uint64(13)) & np.uint64(ODD_BITS - 1)
    return np.packbits(np.bincount(at.astype(np.int64), minlength=ODD_BITS).astype(np.uint8) & 1)


def sketch_of(found: np.ndarray, best: np.ndarray) -> bytes:
    """The sketch of a set with the token values ``best``."""
    tokens = ((best * _MIX) >> _TOP).astype(np.uint8)
    return tokens.tobytes() + odd_sketch(found).tobytes() + len(found).to_bytes(8, "little")


def sketches_of(column: Iterable[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.uint8).reshape(-1, _SIZE.stop)


def may_link(a: np.ndarray, b: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """Whether rows of two tables of sketches can reach the threshold.

    With S the sum of both sizes and D the number of different bits the sets share at most
    (S - D) / 2 shingles; they are not alike enough if that is too few.
    """
    apart = np.bitwise_count(a[:, _ODD] ^ b[:, _ODD]).sum(1, dtype=np.int64)
    total = sum(np.ascontiguousarray(x[:, _SIZE]).view("<i8")[:, 0] for x in (a, b))
    return (100 - percent) * total >= (100 + percent) * apart


def sketched(df: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    """(id, n, digest, first, sketch): set size, name of the set, its tokens in full for the
    roots of the trees, and its sketch."""

    def start():
        shingles = Shingles(size)

        def sketch(rows):
            out = []
            for row_id, text in rows:
                found = shingles.of(text)
                if not len(found):
                    out.append((row_id, 0, None, None, None))
                    continue
                best = minima(found)
                digest = xxhash.xxh3_128_digest(found.tobytes())
                first = best[:TREES].astype(np.int64).tolist()
                out.append((row_id, len(found), digest, first, sketch_of(found, best)))
            return out

        return sketch

    schema = "id bigint, n bigint, digest binary, first array<bigint>, sketch binary"
    return map_rows(df.select(F.col(id_col).cast("bigint"), text_col), schema, start)


def agreement(left: pd.Series, right: pd.Series) -> pd.Series:
    """Share of tokens that two columns of sketches have in common; 0 for pairs that the odd
    sketches rule out."""
    a, b = sketches_of(left), sketches_of(right)
    same = (a[:, :TOKENS] == b[:, :TOKENS]).mean(1)
    return pd.Series(np.where(may_link(a, b), same, 0.0))


def least_agreement(percent: int, errors: float) -> float:
    p = percent / 100
    return p + errors * float(np.sqrt(p * (1 - p) / TOKENS))


def mixed_nodes(rows: DataFrame, level: int) -> DataFrame:
    """(node, main, others, size) of every node whose documents are in several components.

    ``main`` is the component with most documents in the node and ``others`` the number of
    documents outside it.
    """
    parts = rows.groupBy("node", "root").agg(F.count(F.lit(1)).alias("n"))
    return saved(
        parts.groupBy("node")
        .agg(F.sum("n").alias("size"), F.max(F.struct("n", "root")).alias("most"))
        .where("most.n < size")
        .select("node", F.col("most.root").alias("main"), (F.col("size") - F.col("most.n")).alias("others"), "size"),
        f"nodes-{level}",
    )


def children(rows: DataFrame) -> DataFrame:
    """Rows of the next level: each node chooses one or two tokens by a hash of its path.

    Four tokens in three nodes: documents at the threshold share one child on average.
    """
    node = F.col("node")

    def chosen(i: int) -> Column:
        place = F.pmod(F.xxhash64(node, F.lit(i)), F.lit(TOKENS)).cast("int")
        return F.xxhash64(node, place, F.substring("sketch", place + 1, F.lit(1)))

    second = F.when(F.pmod(F.xxhash64(node, F.lit("second")), F.lit(3)) == 0, chosen(1))
    return rows.select(
        F.explode(F.array_compact(F.array(chosen(0), second))).alias("node"), "rep", "root", "sketch"
    )


def pairs_in_nodes(rows: DataFrame, least: float) -> DataFrame:
    """(a, b) across components in nodes (node, main, others, size, rep, root, sketch, homes).

    The documents outside a node's main component ask, all of them answer; so a large group
    costs its size times the few that are not in it. Askers and answerers are cut into blocks,
    and each pair of blocks is compared by itself. Two documents that meet in several root
    nodes (``homes``) are compared in the first of them.
    """
    chunks = F.ceil(F.col("size") / (4 * SMALL_NODE)).cast("int")
    parts = F.ceil(F.col("others") / SMALL_NODE).cast("int")

    def place(n: Column) -> Column:
        return F.pmod(F.xxhash64("rep"), n).cast("int")

    columns = ["node", "i", "j", "asks", "rep", "root", "sketch", "homes"]
    answers = rows.withColumns({"i": place(chunks), "asks": F.lit(False)})
    answers = answers.withColumn("j", F.explode(F.sequence(F.lit(0), parts - 1))).select(*columns)
    asking = rows.where("root <> main").withColumns({"j": place(parts), "asks": F.lit(True)})
    asking = asking.withColumn("i", F.explode(F.sequence(F.lit(0), chunks - 1))).select(*columns)

    def pairs_of(node: int, asks, rep, root, sketch, homes) -> Iterator[tuple[int, int]]:
        asking, answer = np.flatnonzero(asks), np.flatnonzero(~asks)
        if not len(asking) or not len(answer):
            return
        theirs = sketch[answer, :TOKENS]
        asking_reps = set(rep[asking].tolist())
        step = max(1, PAIRS // len(answer))
        for at in range(0, len(asking), step):
            mine = asking[at : at + step]
            same = np.count_nonzero(sketch[mine, None, :TOKENS] == theirs, axis=2)
            i, j = np.nonzero((same >= least * TOKENS) & (root[mine, None] != root[answer]))
            x, y = mine[i], answer[j]
            kept = may_link(sketch[x], sketch[y])
            for one, other in zip(x[kept].tolist(), y[kept].tolist()):
                a, b = int(rep[one]), int(rep[other])
                # Two askers find each other twice, and blocks that meet again do so in order.
                if b in asking_reps and b < a:
                    continue
                mine_at, theirs_at = homes[one].as_py(), homes[other].as_py()
                if node not in mine_at or min(set(mine_at) & set(theirs_at), default=node) == node:
                    yield min(a, b), max(a, b)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found_in(rows: pa.RecordBatch, cuts: list[int]) -> pa.RecordBatch:
            node, asks, rep, root = (
                rows.column(c).to_numpy(zero_copy_only=False) for c in ("node", "asks", "rep", "root")
            )
            sketch, homes = sketches_of(rows.column("sketch").to_pylist()), rows.column("homes")
            pairs = []
            for at, end in zip(cuts, cuts[1:]):
                part = slice(at, end)
                pairs += pairs_of(
                    int(node[at]), asks[part], rep[part], root[part], sketch[part], homes[part]
                )
            a, b = zip(*pairs) if pairs else ((), ())
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

        # Rows come sorted by block; the last block of a batch may go on in the next one.
        held: pa.RecordBatch | None = None
        for batch in batches:
            rows = pa.concat_batches([held, batch]) if held else batch
            keys = np.array([rows.column(c).to_numpy() for c in ("node", "i", "j")])
            cuts = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(0)) + 1).tolist()]
            if len(cuts) > 1:
                yield found_in(rows, cuts)
            held = rows.slice(cuts[-1])
        if held:
            yield found_in(held, [0, held.num_rows])
        held = rows = batch = None
        return_memory()

    spread = answers.unionByName(asking)
    ordered = spread.repartition("node", "i", "j").sortWithinPartitions("node", "i", "j")
    return ordered.mapInArrow(compare, "a bigint, b bigint")


def confirm(pairs: DataFrame, df: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    """The pairs (a, b) whose full sets reach the threshold.

    A document with many partners is copied once per ``MEMBERS`` of them, and each copy is
    compared with its members as they stream by in sorted order.
    """
    pairs = saved(pairs.select("a", "b").distinct(), "pairs")
    degree = pairs.groupBy("a").agg(F.count(F.lit(1)).alias("d"))
    wide = saved(degree.where(F.col("d") > MEMBERS), "hubs")
    part = F.pmod(F.xxhash64("b"), F.coalesce(F.ceil(F.col("d") / MEMBERS), F.lit(1))).cast("int")
    placed = saved(pairs.join(wide, "a", "left").select("a", "b", part.alias("part")), "placed")
    hubs = placed.select(F.col("a").alias("id"), "a", "part").distinct().withColumn("member", F.lit(0))
    members = placed.select(F.col("b").alias("id"), "a", "part", F.lit(1).alias("member"))
    wanted = hubs.unionByName(members)
    needed = saved(wanted.select("id").distinct(), "needed")
    texts = df.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))

    def start():
        shingles = Shingles(size)
        return lambda rows: [(i, shingles.of(text).tobytes()) for i, text in rows]

    sets = saved(
        map_rows(texts.join(needed, "id"), "id bigint, set binary", start).dropDuplicates(), "sets"
    )
    rows = wanted.join(sets, "id").select("a", "part", "member", "id", "set")
    ordered = rows.repartition("a", "part").sortWithinPartitions("a", "part", "member")

    def compare():
        hub: dict = {"key": None, "sets": []}

        def links(batch):
            out = []
            for a, k, member, row_id, raw in batch:
                found = np.frombuffer(raw, np.uint64)
                if hub["key"] != (a, k):
                    hub["key"], hub["sets"] = (a, k), []
                if not member:
                    hub["sets"].append(found)
                    continue
                for other in hub["sets"]:
                    few, many = sorted((found, other), key=len)
                    if 100 * len(few) < PERCENT * len(many):
                        continue
                    at = np.searchsorted(many, few)
                    at[at == len(many)] = 0
                    both = int(np.count_nonzero(many[at] == few))
                    if 100 * both >= PERCENT * (len(few) + len(many) - both):
                        out.append((a, row_id))
                        break
            return out

        return links

    return map_rows(ordered, "a bigint, b bigint", compare)


def near_duplicates(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE
) -> DataFrame:
    """(id, n_shingles, component_id, kept, n_links) for every row.

    ``component_id`` is the smallest id in the component and ``kept`` tells whether it is the
    row's own. ``n_links`` counts the confirmed links of the row's set, a spanning part of all.
    """
    rows = saved(sketched(df, id_col, text_col, size), "sketches")
    linked = rows.where("n > 0 and id is not null")
    named = saved(linked.groupBy("digest").agg(F.min("id").alias("rep")), "sets-named")
    reps = saved(
        linked.join(named, "digest").where("id = rep")
        .select("rep", "digest", "first", "sketch").dropDuplicates(["rep", "digest"]).drop("digest"),
        "reps",
    )

    trees = reps.select("rep", F.posexplode("first").alias("tree", "value")).select(
        F.xxhash64("tree", "value").alias("node"), "rep"
    )
    # Most nodes hold one document; they go first.
    shared = saved(
        trees.groupBy("node").agg(F.min("rep").alias("pivot"), F.max("rep").alias("last"))
        .where("pivot < last").select("node", "pivot"),
        "shared",
    )
    level = saved(trees.join(shared, "node"), "roots-met")

    sketches = reps.select("rep", "sketch").dropDuplicates(["rep"])
    its = sketches.select(F.col("rep").alias("pivot"), F.col("sketch").alias("its"))
    measure = F.pandas_udf(agreement, "double")
    least = least_agreement(PERCENT, -ERRORS)
    roots = saved(level.select("node", "rep"), "root-nodes")

    def linked_to_pivots(met: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(candidates, links): pairs (rep, pivot) alike by tokens, the best of each confirmed."""
        like = met.join(sketches, "rep").join(its, "pivot").withColumn("like", measure("sketch", "its"))
        found = saved(like.where(F.col("like") >= least).select("rep", "pivot", "like"), "candidates")
        best = found.groupBy("rep").agg(
            F.max_by("pivot", F.struct("like", -F.col("pivot"))).alias("pivot")
        )
        pairs = best.select(F.col("pivot").alias("a"), F.col("rep").alias("b"))
        return found, saved(confirm(pairs, df, id_col, text_col, size), "links-pivots")

    candidates, first = linked_to_pivots(level.where("rep <> pivot").select("rep", "pivot").distinct())
    known = components(first).select(F.col("x").alias("rep"), "root")

    def rooted(frame: DataFrame, column: str, name: str) -> DataFrame:
        found = known.select(F.col("rep").alias(column), F.col("root").alias(name))
        return frame.join(found, column, "left").withColumn(name, F.coalesce(name, column))

    for again in range(1, PIVOTS):
        # Another pivot per node, and only the documents of other components meet it.
        seen = saved(rooted(roots, "rep", "root"), "roots-again")
        pivots = seen.groupBy("node").agg(
            F.min_by(F.struct("rep", "root"), F.xxhash64("rep", F.lit(again))).alias("p")
        )
        met = seen.join(pivots, "node").where(F.col("root") != F.col("p.root"))
        met = met.select("rep", F.col("p.rep").alias("pivot")).distinct()
        more, links = linked_to_pivots(met)
        candidates = candidates.unionByName(more)
        first = saved(first.unionByName(links).distinct(), "links-so-far")
        known = components(first).select(F.col("x").alias("rep"), "root")

    level = saved(rooted(roots, "rep", "root"), "level-0")
    small = []
    for depth in range(LEVELS):
        level = level.join(mixed_nodes(level, depth), "node")
        if depth == 0:
            level = level.join(sketches, "rep")
        columns = ["node", "main", "others", "size", "rep", "root", "sketch"]
        level = saved(level.select(*columns), f"mixed-{depth}")
        few = (F.col("others") <= SMALL_NODE) | F.lit(depth == LEVELS - 1)
        small.append(level.where(few))
        large = level.where(~few)
        if large.isEmpty():
            break
        # Counting its nodes and joining them are two readings; the children are made once.
        level = saved(children(large), f"level-{depth + 1}")
    homes = small[0].groupBy("rep").agg(F.collect_set("node").alias("homes"))
    leaves = small[0]
    for more in small[1:]:
        leaves = leaves.unionByName(more)
    none = F.array().cast("array<bigint>")
    leaves = leaves.join(homes, "rep", "left").withColumn("homes", F.coalesce("homes", none))
    across = rooted(rooted(candidates, "rep", "ra"), "pivot", "rb").where("ra <> rb")
    rest = pairs_in_nodes(leaves, least).unionByName(
        across.select(F.col("pivot").alias("a"), F.col("rep").alias("b"))
    )
    second = confirm(rest, df, id_col, text_col, size)
    links = saved(first.unionByName(second).distinct(), "links-all")
    final = components(links)
    degree = links.select(F.col("a").alias("rep")).unionByName(links.select(F.col("b").alias("rep")))
    degree = degree.groupBy("rep").agg(F.count(F.lit(1)).alias("n_links"))
    of_set = saved(
        named.join(final.select(F.col("x").alias("rep"), "root"), "rep", "left").join(degree, "rep", "left")
        .select("digest", F.coalesce("root", "rep").alias("root"), F.coalesce("n_links", F.lit(0)).alias("n_links")),
        "components",
    )
    own = rows.select("id", "n", F.when(F.col("id").isNotNull(), F.col("digest")).alias("digest"))
    component = F.coalesce("root", "id")
    return own.join(of_set, "digest", "left").select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"),
        F.coalesce(component == F.col("id"), F.lit(True)).alias("kept"),
        F.coalesce("n_links", F.lit(0)).alias("n_links"),
    )
