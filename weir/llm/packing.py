"""Packing along a space-filling curve: like documents share sequences, with no padding.

Every document is tokenised whole and becomes a vector: its tokens, hashed to signs in a few
dimensions and summed (a random projection of the hashed count vector). The dimensions are
scaled by the corpus mean and spread and cut into cells, and the cells are numbered along a
Hilbert curve. Sorted by that number, documents lie next to similar ones. Laid end to end in
this order and cut every ``length`` tokens they fill all sequences but the last, which is
cut into sequences of a power of two, so nothing is padded.

The order is made from one row per document without its tokens: a range sort spreads it
evenly whatever the keys, and running sums per sorted partition give each document its start.

Definite results: null and empty texts are documents of the end token alone. Rows with equal
keys are ordered by id, then by text hash; identical rows follow one another and each is
packed. Null ids come first. Other columns are ignored.
"""

from __future__ import annotations

import functools
import json
import math
import os
import unicodedata
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from weir.llm.common import BATCH_ROWS, kept_by_worker, map_rows, saved

VOCABULARY = "word_bpe_49k.json"
LENGTH = 4096
END = 2
DIMENSIONS, BITS = 4, 8
KEPT_WORDS = 500_000
# Characters of texts whose words are looked up at once.
CHARS_AT_ONCE = 4_000_000
# Splitting at white space leaves the tokens as they are, unless one of these separators,
# which the tokenizer treats as signs, is in the text.
_ODD_SPACES = "\x1c\x1d\x1e\x1f"
# Signs that never join a letter in one token; an apostrophe may.
_SIGNS = ",.!?;:*#&%$|@+-/()[]{}<>=_~^\"\\"


@functools.cache
def _long_a_letter(char: str) -> bool:
    """Whether all Unicode tables since 3.2 know the character as a letter."""
    return unicodedata.ucd_3_2_0.category(char).startswith("L")


class Merges:
    """The merges of a byte-level vocabulary, for many short words at a time.

    Every word takes its steps as the tokenizer does: of the pairs that have a rank the lowest
    one is merged, the leftmost of equal ones, until none is left. One column per word holds its
    symbols, and all columns take a step at once. Pairs are found in a hash table.
    """

    # The place of a pair in its word takes so many bits beside its rank.
    PLACE_BITS = 6
    LONGEST = (1 << PLACE_BITS) - 2
    AT_ONCE = 2048
    DONE = np.iinfo(np.int32).max
    SLOT_BITS = 18

    def __init__(self, model: dict, kind: np.dtype):
        vocabulary, suffix = model["vocab"], model.get("end_of_word_suffix") or ""
        letters = byte_letters()
        self.kind = kind
        self.none = max(vocabulary.values()) + 1
        self.inner = np.array([vocabulary[letters[b]] for b in range(256)])
        self.last = np.array([vocabulary[letters[b] + suffix] for b in range(256)])
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.made = np.array([vocabulary[a + b] for a, b in pairs])
        left = np.array([vocabulary[a] for a, _ in pairs])
        keys = self.key(left, np.array([vocabulary[b] for _, b in pairs]))
        self.keys = np.full(1 << self.SLOT_BITS, -1)
        self.ranks = np.zeros(1 << self.SLOT_BITS, np.int64)
        for rank, (key, slot) in enumerate(zip(keys.tolist(), self.slot(keys).tolist())):
            while self.keys[slot] not in (-1, key):
                slot = self.next_slot(slot)
            self.keys[slot], self.ranks[slot] = key, rank

    def key(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        return left * (self.none + 1) + right

    def slot(self, key: np.ndarray) -> np.ndarray:
        return (key * 0x9E3779B1 & 0xFFFFFFFF) >> (32 - self.SLOT_BITS)

    def next_slot(self, slot):
        return slot + 1 & (1 << self.SLOT_BITS) - 1

    def pair(self, left: np.ndarray, right: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Rank and place of pairs as one number; ``DONE`` without a rank."""
        key = self.key(left, right)
        slot = self.slot(key)
        there = self.keys.take(slot)
        taken = np.flatnonzero((there != key) & (there != -1))
        while len(taken):
            slot[taken] = self.next_slot(slot[taken])
            there[taken] = self.keys[slot[taken]]
            taken = taken[(there[taken] != key[taken]) & (there[taken] != -1)]
        return np.where(there == key, self.ranks.take(slot) << self.PLACE_BITS | place, self.DONE)

    def of_words(self, raw: np.ndarray, at: np.ndarray, sizes: np.ndarray):
        """Where the ids of each word begin, how many these are, and all ids.

        A word is the 1 to ``LONGEST`` bytes of ``raw`` from its ``at``.
        """
        order = sizes.argsort(kind="stable")
        counts, ids = np.zeros(len(sizes), np.int64), [np.empty(0, self.kind)]
        for begin in range(0, len(order), self.AT_ONCE):
            part = order[begin : begin + self.AT_ONCE]
            counts[part], found = self.columns(raw, at[part], sizes[part])
            ids.append(found)
        begins = np.zeros(len(sizes), np.int64)
        begins[order] = counts[order].cumsum() - counts[order]
        return begins, counts, np.concatenate(ids)

    def columns(self, raw: np.ndarray, at: np.ndarray, sizes: np.ndarray):
        n, rows = len(sizes), int(sizes[-1]) + 2
        every = np.arange(n)
        # Symbols lie in rows 1 to their number; the rows around them stay without one.
        place = np.arange(rows)[:, None]
        inside = (place > 0) & (place <= sizes)
        letters = raw[np.where(inside, at + place - 1, 0)]
        symbols = np.where(inside, self.inner[letters], self.none)
        symbols[sizes, every] = self.last[letters[sizes, every]]
        place = np.repeat(place, n, 1)
        table = np.full((rows, n), self.DONE, np.int32)
        paired = inside[:-1] & inside[1:]
        table[:-1][paired] = self.pair(symbols[:-1][paired], symbols[1:][paired], place[:-1][paired])
        after, before = (place + 1).ravel(), (place - 1).ravel()
        symbols, best = symbols.ravel(), table.ravel()
        while True:
            first = table.min(0)
            c = np.flatnonzero(first != self.DONE)
            if not len(c):
                break
            first = first[c]
            p, made = first & ((1 << self.PLACE_BITS) - 1), self.made[first >> self.PLACE_BITS]
            here = p * n + c
            gone = after[here] * n + c
            q, b = after[gone], before[here]
            right, left = q * n + c, b * n + c
            symbols[here], symbols[gone], best[gone] = made, self.none, self.DONE
            after[here], before[right] = q, p
            best[here] = self.pair(made, symbols[right], p)
            best[left] = self.pair(symbols[left], made, b)
        cells = symbols.reshape(rows, n).T
        kept = cells != self.none
        return kept.sum(1), cells[kept].astype(self.kind)


class Words:
    """Token ids of texts as 16- or 32-bit integers, by their different words.

    A word of letters and signs after them is two pieces, any other word is one. Runs of letters
    go to the merges directly, all of some texts together: normalising a run and finding that it
    is one piece would cost more than its merges. Other pieces are remembered, in two
    generations, so common ones outlive the many that occur once.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.normal = self.tokenizer.normalizer
        self.size = self.tokenizer.get_vocab_size()
        self.kind = np.dtype("<u2" if self.size <= 1 << 16 else "<u4")
        with open(path, encoding="utf-8") as file:
            self.merges = Merges(json.load(file)["model"], self.kind)
        self.known: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}

    def pack(self, ids: list[int]) -> bytes:
        return np.array(ids, self.kind).tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of several texts."""
        out = [b""] * len(texts)
        group, chars = [], 0
        for i, text in enumerate(texts):
            if any(c in text for c in _ODD_SPACES):
                out[i] = self.whole(text)
                continue
            group.append(i)
            chars += len(text)
            if chars > CHARS_AT_ONCE:
                self.fill(out, group, texts)
                group, chars = [], 0
        self.fill(out, group, texts)
        return out

    def fill(self, out: list[bytes], group: list[int], texts: list[str]) -> None:
        """Set the ids of a group of texts."""
        split = pc.utf8_split_whitespace(pa.array([texts[i] for i in group], pa.large_string()))
        words = split.flatten().dictionary_encode()
        pieces, begins, counts, ids = self.of_words(words.dictionary)
        pieces = pieces[words.indices.to_numpy()].ravel()
        lengths = counts[pieces]
        ends = np.concatenate([[0], lengths.cumsum()])
        found = ids[np.arange(ends[-1]) + np.repeat(begins[pieces] - ends[:-1], lengths)]
        bounds = ends[2 * split.offsets.to_numpy()].tolist()
        for i, a, b in zip(group, bounds, bounds[1:]):
            out[i] = found[a:b].tobytes()

    def whole(self, text: str) -> bytes:
        return self.pack(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def of_words(self, words: pa.Array):
        """For different words the numbers of their two pieces, and for all pieces where their ids
        begin, how many these are, and the ids."""
        # Signs after a run of letters are a token run of their own, and capitals of ASCII
        # are read as small letters; so fewer different runs are left to tokenise.
        cores = pc.utf8_rtrim(words, characters=_SIGNS)
        alpha = pc.utf8_is_alpha(cores)
        cores = pc.if_else(pc.string_is_ascii(cores), pc.ascii_lower(cores), cores)
        runs = cores.filter(alpha).dictionary_encode()
        good, raw, at, sizes = self.normalised(runs.dictionary)
        begins, counts, ids = self.merges.of_words(raw, at, sizes)

        # Piece 0 is empty; then come the runs, and all that the tokenizer itself has to read.
        number = np.zeros(len(good) + 1, np.int64)
        number[:-1][good] = 1 + np.arange(len(at))
        first, second = np.zeros((2, len(words)), np.int64)
        first[alpha.to_numpy(zero_copy_only=False)] = number[runs.indices.to_numpy()]
        word, core = (x.to_numpy(zero_copy_only=False) for x in (words, cores))
        sizes = pc.binary_length(words).to_numpy() - pc.binary_length(cores).to_numpy()
        odd, tailed = np.flatnonzero(first == 0), np.flatnonzero((first > 0) & (sizes > 0))
        rest = word[odd].tolist()
        rest += [w[len(c) :] for w, c in zip(word[tailed].tolist(), core[tailed].tolist())]
        different: dict[str, int] = {}
        places = np.array([different.setdefault(x, len(different)) for x in rest], np.int64)
        first[odd], second[tailed] = np.split(places + 1 + len(at), [len(odd)])

        found = self.remembered(list(different))
        more = np.array([len(x) for x in found], np.int64) // self.kind.itemsize
        counts = np.concatenate([[0], counts, more])
        begins = np.concatenate([[0], begins, len(ids) + more.cumsum() - more])
        ids = np.concatenate([ids, np.frombuffer(b"".join(found), self.kind)])
        return np.stack([first, second], 1), begins, counts, ids

    def remembered(self, pieces: list[str]) -> list[bytes]:
        """The ids of pieces that the tokenizer itself has to read."""
        if len(self.known) > KEPT_WORDS // 2:
            self.known, self.before = {}, self.known
        found = []
        for piece in pieces:
            ids = self.known.get(piece)
            if ids is None:
                ids = self.before.get(piece)
                self.known[piece] = ids = self.whole(piece) if ids is None else ids
            found.append(ids)
        return found

    def normalised(self, runs: pa.Array):
        """Runs of letters as the tokenizer normalises them: which are good for the merges, their
        bytes, and where they begin there and how many they are."""
        found = runs.to_numpy(zero_copy_only=False).copy()
        other = ~pc.string_is_ascii(runs).to_numpy(zero_copy_only=False)
        odd = found[other].tolist()
        # Nothing is composed with a space before or after it.
        normal = self.normal.normalize_str(" ".join(odd)).split(" ") if odd else []
        if len(normal) != len(odd):
            normal = [""] * len(odd)
        strange = {c for c in set("".join(normal)) if not _long_a_letter(c)}
        if strange:
            normal = ["" if strange.intersection(run) else run for run in normal]
        found[other] = np.array(normal, object)
        raw = np.frombuffer((" ".join(found.tolist()) + " ").encode(), np.uint8)
        ends = np.flatnonzero(raw == ord(" "))[: len(found)]
        at = np.concatenate([[0], ends + 1])[: len(found)]
        sizes = ends - at
        good = (sizes > 0) & (sizes <= Merges.LONGEST)
        return good, raw, at[good], sizes[good]


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in a byte-level vocabulary: printable Latin-1
    characters stand for themselves, the others are numbered from U+0100."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


def words_of(path: str) -> Words:
    """One memory of words per Python worker, which serves one task after the other."""
    return kept_by_worker(f"words of {path}", lambda: Words(path))


def signs(size: int, dimensions: int) -> np.ndarray:
    """A fixed random sign per token and dimension, from a hash of the token."""
    bits = np.array([xxhash.xxh32_intdigest(str(i)) for i in range(size)], np.int64)
    return 1.0 - 2.0 * (bits[:, None] >> np.arange(dimensions) & 1)


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """Numbers along the Hilbert curve for rows of non-negative cell coordinates.

    The coordinates are turned, bit by bit from the top, into the transposed Hilbert index
    (exchange and inversion of the lower bits, then Gray coding), whose bits are interleaved.
    """
    x = cells.astype(np.int64).T.copy()
    n = len(x)
    bit = 1 << (bits - 1)
    while bit > 1:
        low = bit - 1
        for i in range(n):
            high = (x[i] & bit) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & low)
            x[0] = np.where(high, x[0] ^ low, x[0] ^ swap)
            x[i] ^= swap
        bit >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    flip = np.zeros_like(x[0])
    bit = 1 << (bits - 1)
    while bit > 1:
        flip = np.where((x[n - 1] & bit) != 0, flip ^ (bit - 1), flip)
        bit >>= 1
    x ^= flip
    out = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            out = out << 1 | (x[i] >> b & 1)
    return out


def tokenised(df: DataFrame, id_col: str, text_col: str, path: str, dimensions: int) -> DataFrame:
    """(id, __hash, __n, __ids, __at): token ids as bytes and the projected vector."""

    def start():
        words = words_of(path)
        table = np.ascontiguousarray(signs(words.size, dimensions).T)
        end = words.pack([END])

        def encode(rows):
            out = []
            coded = words.encode([text or "" for _, text in rows])
            for (row_id, text), ids in zip(rows, coded):
                ids += end
                found = np.frombuffer(ids, words.kind)
                at = [float(s.take(found).sum()) / math.sqrt(len(found)) for s in table]
                digest = xxhash.xxh64_intdigest(text or "") - (1 << 63)
                out.append((row_id, digest, len(found), ids, at))
            return out

        return encode

    kind = dict(df.dtypes)[id_col]
    schema = f"{id_col} {kind}, __hash bigint, __n bigint, __ids binary, __at array<double>"
    return map_rows(df.select(id_col, text_col), schema, start, at_once=BATCH_ROWS)


def placed(docs: DataFrame, id_col: str, dimensions: int, bits: int) -> DataFrame:
    """(__row, __start): where each document starts when all are laid along the curve."""
    at = [F.col("__at")[i] for i in range(dimensions)]
    stats = docs.agg(
        *[F.coalesce(F.avg(x), F.lit(0.0)).alias(f"m{i}") for i, x in enumerate(at)],
        *[F.coalesce(F.stddev_pop(x), F.lit(1.0)).alias(f"s{i}") for i, x in enumerate(at)],
    ).first()
    mean = np.array([stats[f"m{i}"] for i in range(dimensions)])
    spread = np.array([stats[f"s{i}"] or 1.0 for i in range(dimensions)])
    top = (1 << bits) - 1

    def start():
        def key(rows):
            z = (np.array([r[-1] for r in rows]) - mean) / spread
            cells = np.clip((z + 3.0) / 6.0 * (top + 1), 0, top).astype(np.int64)
            return [(*r[:-1], k) for r, k in zip(rows, hilbert(cells, bits).tolist())]

        return key

    kind = dict(docs.dtypes)[id_col]
    light = map_rows(
        docs.select("__row", id_col, "__hash", "__n", "__at"),
        f"__row bigint, {id_col} {kind}, __hash bigint, __n bigint, __key bigint",
        start, at_once=4096,
    )
    order = ["__key", id_col, "__hash", "__row"]
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = saved(
        light.repartitionByRange(parts, *order)
        .sortWithinPartitions(*order)
        .withColumn("__place", F.monotonically_increasing_id()),
        "packing-order",
    ).withColumn("__slot", F.shiftright("__place", 33))
    # One row per sorted partition; their number is set by the session.
    earlier = Window.orderBy("__slot").rowsBetween(Window.unboundedPreceding, -1)
    before = ordered.groupBy("__slot").agg(F.sum("__n").alias("n"))
    before = before.select("__slot", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    running = Window.partitionBy("__slot").orderBy("__place")
    ahead = F.sum("__n").over(running.rowsBetween(Window.unboundedPreceding, -1))
    return ordered.withColumn("__ahead", F.coalesce(ahead, F.lit(0))).join(before, "__slot").select(
        "__row", (F.col("base") + F.col("__ahead")).alias("__start")
    )


def cut_points(total: int, length: int) -> list[int]:
    """Starts of the sequences after the last full one: what is left, in powers of two."""
    at = total - total % length
    starts = []
    while at < total:
        starts.append(at)
        at += 1 << ((total - at).bit_length() - 1)
    return starts


def pack(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    length: int = LENGTH,
    path: str | None = None,
    dimensions: int = DIMENSIONS,
    bits: int = BITS,
    with_ids: bool = True,
) -> DataFrame:
    """One row per piece of a document in a sequence.

    (id, start, length, ids_crc32, doc_tokens, sequence_id, offset[, ids]): ``start`` counts
    the document's tokens before the piece, ``offset`` those of the sequence; ``ids`` are the
    tokens themselves and ``ids_crc32`` their checksum as 32-bit little-endian integers.
    """
    path = path or public_tokenizers.path(VOCABULARY)
    docs = saved(
        tokenised(df, id_col, text_col, path, dimensions).withColumn(
            "__row", F.monotonically_increasing_id()
        ),
        "packing-tokens",
    )
    total = docs.agg(F.coalesce(F.sum("__n"), F.lit(0))).first()[0]
    full, tail = total // length, cut_points(total, length)
    ends = [*tail[1:], total] if tail else []
    starts = placed(docs, id_col, dimensions, bits)
    kind = dict(df.dtypes)[id_col]

    def start():
        size = Tokenizer.from_file(path).get_vocab_size()
        width = np.dtype("<u2" if size <= 1 << 16 else "<u4")

        def pieces(rows):
            out = []
            for row_id, n, raw, begin in rows:
                ids = np.frombuffer(raw, width).astype("<u4")
                at = begin
                while at < begin + n:
                    if at < full * length:
                        number, first = at // length, at // length * length
                        end = first + length
                    else:
                        k = np.searchsorted(tail, at, "right") - 1
                        number, first, end = full + int(k), tail[k], ends[k]
                    end = min(end, begin + n)
                    part = ids[at - begin : end - begin]
                    row = (row_id, at - begin, end - at, zlib.crc32(part.tobytes()), n, number)
                    row += (at - first,)
                    out.append((*row, part.tolist()) if with_ids else row)
                    at = end
            return out

        return pieces

    schema = (
        f"{id_col} {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint,"
        " sequence_id bigint, offset bigint" + (", ids array<int>" if with_ids else "")
    )
    joined = docs.select("__row", id_col, "__n", "__ids").join(starts, "__row")
    return map_rows(joined.select(id_col, "__n", "__ids", "__start"), schema, start, at_once=64)
