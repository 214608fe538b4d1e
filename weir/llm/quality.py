"""Quality scores: support vectors over n-grams scaled by naive Bayes.

An n-gram is an indicator: it occurs in a text or not. From a bounded sample of labelled rows
each n-gram gets the log-count ratio of the classes (its share among the n-gram occurrences of
good texts over that among the others, smoothed by one), and a text is the sum of the
indicators scaled by these ratios, with length 1. A linear model with the squared hinge loss is
fitted on it by dual coordinate descent: one dual variable per text, each in turn set to its
best value while the weights follow. The classes weigh the same. A logistic curve turns the
margin into a probability; it is fitted on texts the model did not see.

N-grams are of two kinds, in one hashed space of ``SLOTS`` features: runs of one and two words
(lower case, without signs at the ends), and runs of one to three *shapes*. The shape of a token
says how its letters are cased and which signs surround them; a token equal to the one before
is a shape of its own. So repeated words, shouting or signs on every word are n-grams that occur.

Indicators ignore how often, so runs of shapes are also counted: the indicator that a run makes
up more than 1/2, 1/4, 1/8 .. of a text's runs is an n-gram of its own.

Fitting reads about ``ROWS`` labelled rows per class, chosen by a hash of the id; nothing but the
text enters a score. The sample's features go to one task, whose work is bounded by the sample.

Definite results: null and empty texts have the n-grams of an empty text (none) and score by
the model's bias. Without two classes among the labels the score is the share of good rows seen
(0 without labels). Null labels are left out, and an id with several labels is good if all of
them are. Repeated rows and null ids are scored like any other; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weir.llm.common import map_rows, saved, text_function

# About so many labelled rows per class are learned from.
ROWS = 6_000
# Tenths of the sample that fit the model; the rest fits the curve.
FIT_TENTHS = 8
BITS = 20
SLOTS = 1 << BITS
# N-grams in fewer texts of the sample are left out.
LEAST_TEXTS = 3
COST, ROUNDS, SEED = 1.0, 30, 11
KEPT_TOKENS = 300_000
# A text's n-grams are taken from so many tokens at a time.
TOKENS_AT_ONCE = 100_000
HALVINGS = 5

_MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)
_SHIFT = np.uint64(64 - BITS)
_AGAIN = "="


def parts(token: str) -> tuple[str, str]:
    """(word, shape) of a token.

    The word is in lower case without signs at its ends. The shape is the casing of the letters
    with the signs around them, equal neighbours once: 'Word,' is 'Aa,' and 'on###' is 'a#'.
    """
    core = token.rstrip(",.")
    if core.isalpha():
        # Most tokens are plain words.
        low = core.lower()
        kind = "a" if core == low else "Aa" if core[1:] == low[1:] else "A" if core.isupper() else ""
        if kind:
            return low, kind + token[len(core) : len(core) + 1]
    kinds: list[str] = []
    for c in token:
        kind = "A" if c.isupper() else "a" if c.isalpha() else "0" if c.isdigit() else c
        if not kinds or kinds[-1] != kind:
            kinds.append(kind)
        if len(kinds) == 6:
            break
    low = token.lower()
    start, end = 0, len(low)
    while start < end and not low[start].isalnum():
        start += 1
    while end > start and not low[end - 1].isalnum():
        end -= 1
    return low[start:end], "".join(kinds)


class _Tokens(dict):
    """(hash of the word, hash of the shape) of tokens, as one number per token."""

    def __init__(self) -> None:
        super().__init__()
        self.words = np.zeros(1024, np.uint64)
        self.shapes = np.zeros(1024, np.uint64)

    def __missing__(self, token: str) -> int:
        n = self[token] = len(self)
        if n == len(self.words):
            self.words = np.concatenate([self.words, np.zeros_like(self.words)])
            self.shapes = np.concatenate([self.shapes, np.zeros_like(self.shapes)])
        word, shape = parts(token)
        self.words[n] = xxhash.xxh64_intdigest(word)
        self.shapes[n] = xxhash.xxh64_intdigest(shape, 1)
        return n


class Grams:
    """The features of texts: numbers of slots."""

    def __init__(self) -> None:
        self.tokens = _Tokens()
        self.again = np.uint64(xxhash.xxh64_intdigest(_AGAIN, 1))
        self.place = np.zeros(SLOTS, np.int32)

    def _runs(self, hashes: np.ndarray, n: int, kind: int) -> np.ndarray:
        """Slots of all runs of n tokens."""
        size = len(hashes) - n + 1
        if size <= 0:
            return np.zeros(0, np.int64)
        total = hashes[:size] * _MULTIPLIERS[0] + np.uint64(kind)
        for i in range(1, n):
            total = (total ^ (total >> np.uint64(31))) * _MULTIPLIERS[1] + hashes[i : size + i]
        return self._slots(total)

    def _slots(self, hashes: np.ndarray) -> np.ndarray:
        return (((hashes ^ (hashes >> np.uint64(29))) * _MULTIPLIERS[2]) >> _SHIFT).astype(np.int64)

    def _distinct(self, slots: np.ndarray, times: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Different slots and how often each occurs, without sorting.

        Every slot names the last place that holds it.
        """
        self.place[slots] = np.arange(len(slots), dtype=np.int32)
        counts = np.bincount(self.place[slots], times, len(slots))
        last = np.flatnonzero(counts)
        return slots[last], counts[last]

    def of(self, text: str | None) -> np.ndarray:
        """Different slots of a text, in no order."""
        tokens = (text or "").split()
        if not tokens:
            return np.zeros(0, np.int64)
        if len(self.tokens) > KEPT_TOKENS:
            self.tokens = _Tokens()
        found: list[np.ndarray] = []
        runs: list[tuple[np.ndarray, np.ndarray]] = []
        for at in range(0, len(tokens), TOKENS_AT_ONCE):
            # Runs that start in this portion reach two tokens into the next one.
            part = tokens[at : at + TOKENS_AT_ONCE + 2]
            numbers = np.fromiter(map(self.tokens.__getitem__, part), np.int64, len(part))
            words, shapes = self.tokens.words[numbers], self.tokens.shapes[numbers]
            shapes[1:][numbers[1:] == numbers[:-1]] = self.again
            if at and tokens[at - 1] == tokens[at]:
                shapes[0] = self.again
            ends = [TOKENS_AT_ONCE + n - 1 for n in (1, 2, 3)]
            slots = [self._runs(words[:end], n, n) for n, end in zip((1, 2), ends)]
            found.append(self._distinct(np.concatenate(slots))[0])
            runs += [self._distinct(self._runs(shapes[:end], n, 10 + n)) for n, end in zip((1, 2, 3), ends)]
        for k in range(3):
            slots, times = map(np.concatenate, zip(*runs[k::3]))
            slots, times = self._distinct(slots, times)
            found.append(slots)
            for h in range(1, HALVINGS + 1):
                many = slots[times * (1 << h) > times.sum()]
                found.append(self._slots(many.astype(np.uint64) * _MULTIPLIERS[1] + np.uint64(100 + h)))
        return self._distinct(np.concatenate(found))[0]


def dual_descent(rows: list[np.ndarray], values: list[np.ndarray], y: np.ndarray, cost: np.ndarray,
                 size: int, rounds: int = ROUNDS, seed: int = SEED) -> np.ndarray:
    """Weights of the linear model with the least squared hinge loss.

    ``rows`` holds the slots of each text and ``values`` their values; ``y`` is 1 or -1. The
    dual variable of a text moves by its projected gradient over its diagonal, until no
    gradient of a round is above 0.001.
    """
    weights, alpha = np.zeros(size), np.zeros(len(rows))
    slack = 0.5 / cost
    diagonal = np.array([float(v @ v) for v in values]) + slack
    rnd = np.random.default_rng(seed)
    for _ in range(rounds):
        largest = 0.0
        for i in rnd.permutation(len(rows)).tolist():
            gradient = y[i] * float(weights[rows[i]] @ values[i]) - 1.0 + slack[i] * alpha[i]
            if alpha[i] == 0.0 and gradient >= 0.0:
                continue
            largest = max(largest, abs(gradient))
            new = max(alpha[i] - gradient / diagonal[i], 0.0)
            weights[rows[i]] += (new - alpha[i]) * y[i] * values[i]
            alpha[i] = new
        if largest < 1e-3:
            break
    return weights


def logistic_curve(margin: np.ndarray, good: np.ndarray) -> tuple[float, float]:
    """(slope, shift) of the likeliest logistic curve, towards smoothed targets."""
    n1, n0 = good.sum(), (~good).sum()
    target = np.where(good, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    weight = np.where(good, 0.5 / max(n1, 1), 0.5 / max(n0, 1)) * len(good)
    at = np.zeros(2)
    x = np.stack([margin, np.ones_like(margin)], 1)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ at, -30, 30)))
        step = np.linalg.solve(
            (x * (weight * p * (1 - p))[:, None]).T @ x + 1e-6 * np.eye(2), x.T @ (weight * (target - p)) - 1e-6 * at
        )
        at += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return float(at[0]), float(at[1])


@dataclass
class Model:
    """Weights by slot; without them ``share`` is every score."""

    slots: np.ndarray
    ratios: np.ndarray
    weights: np.ndarray
    bias: float
    slope: float
    shift: float
    share: float


def log_ratios(rows: list[np.ndarray], good: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(slots, log-count ratios) of the n-grams that enough texts hold."""
    counts = [np.zeros(SLOTS) for _ in range(2)]
    for found, is_good in zip(rows, good.tolist()):
        counts[is_good][found] += 1
    slots = np.flatnonzero(counts[0] + counts[1] >= LEAST_TEXTS)
    p, q = counts[1][slots] + 1, counts[0][slots] + 1
    return slots, np.log(p / p.sum()) - np.log(q / q.sum())


def scaled(found: np.ndarray, slots: np.ndarray, ratios: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places in ``slots``, values) of a text with length 1."""
    if not len(slots):
        return np.zeros(0, np.int64), np.zeros(0)
    at = np.minimum(np.searchsorted(slots, found), len(slots) - 1)
    at = at[slots[at] == found]
    values = ratios[at]
    size = math.sqrt(float(values @ values))
    return at, values / size if size else values


def learn(rows: list[np.ndarray], good: np.ndarray, fits: np.ndarray) -> Model:
    """A model from the features of labelled texts; those not in ``fits`` make the curve."""
    share = float(good.mean()) if len(good) else 0.0
    none = np.zeros(0)
    if len(set(good[fits].tolist())) < 2:
        return Model(none, none, none, 0.0, 1.0, 0.0, share)
    used = np.flatnonzero(fits)
    slots, ratios = log_ratios([rows[i] for i in used], good[fits])
    coded = [scaled(r, slots, ratios) for r in rows]
    # The bias is one more feature of every text.
    with_bias = [(np.append(a, len(slots)), np.append(v, 1.0)) for a, v in coded]
    y = np.where(good, 1.0, -1.0)
    each = {k: len(used) / (2 * max(np.count_nonzero(good[fits] == k), 1)) for k in (True, False)}
    cost = COST * np.array([each[g] for g in good[fits].tolist()])
    weights = dual_descent(
        [with_bias[i][0] for i in used], [with_bias[i][1] for i in used], y[fits], cost, len(slots) + 1
    )
    margin = np.array([float(weights[a] @ v) for a, v in with_bias])
    rest = ~fits if len(set(good[~fits].tolist())) == 2 else fits
    slope, shift = logistic_curve(margin[rest], good[rest])
    return Model(slots, ratios, weights[:-1], float(weights[-1]), slope, shift, share)


def labelled_sample(
    df: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, allowed: Column | None, rows: int
) -> DataFrame:
    """(text, good, part): about ``rows`` rows of each class, equal texts once."""
    marks = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
    if allowed is not None:
        marks = marks.where(allowed)
    marks = marks.groupBy(id_col).agg(F.min((F.col(label_col) > 0).cast("int")).alias("good"))
    n = {r["good"]: r["count"] for r in marks.groupBy("good").count().collect()}
    share = F.when(F.col("good") == 1, rows / max(n.get(1, 1), 1)).otherwise(rows / max(n.get(0, 1), 1))
    place = F.pmod(F.xxhash64(F.col(id_col), F.lit("quality")), F.lit(1_000_003))
    part = F.pmod(F.xxhash64(F.col(id_col), F.lit("quality part")), F.lit(10))
    chosen = marks.where(place < share * 1_000_003).select(
        F.col(id_col).alias("__id"), "good", part.cast("int").alias("part")
    )
    # The sample is bounded by the argument, so its ids may be broadcast.
    texts = df.select(F.col(id_col).alias("__id"), F.col(text_col).alias("text"))
    return texts.join(F.broadcast(chosen), "__id").dropDuplicates(["text"]).drop("__id")


def fit(
    df: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    allowed: Column | None = None,
    rows: int = ROWS,
) -> Model:
    """Learn from labelled rows whose ``labels`` row ``allowed`` admits."""

    def start():
        grams = Grams()
        return lambda texts: [
            (good, part, grams.of(text).astype("<i4").tobytes()) for text, good, part in texts
        ]

    sample = labelled_sample(df, labels, id_col, text_col, label_col, allowed, rows)
    coded = saved(
        map_rows(sample.select("text", "good", "part"), "good int, part int, grams binary", start),
        "quality-sample",
    )

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = [r for b in batches for r in zip(*[c.to_pylist() for c in b.columns])]
        # Files arrive in any order; the result must not depend on it.
        seen.sort(key=lambda r: (r[1], r[0], r[2]))
        good = np.array([g == 1 for g, _, _ in seen], bool)
        fits = np.array([p < FIT_TENTHS for _, p, _ in seen], bool)
        model = learn([np.frombuffer(g, "<i4").astype(np.int64) for _, _, g in seen], good, fits)
        arrays = [np.asarray(x, np.float64).tobytes() for x in (model.slots, model.ratios, model.weights)]
        numbers = [model.bias, model.slope, model.shift, model.share]
        yield pa.RecordBatch.from_arrays(
            [pa.array([x], pa.binary()) for x in arrays] + [pa.array([x], pa.float64()) for x in numbers],
            names=["slots", "ratios", "weights", "bias", "slope", "shift", "share"],
        )

    schema = "slots binary, ratios binary, weights binary, bias double, slope double, shift double, share double"
    row = coded.repartition(1).mapInArrow(solve, schema).first()
    if row is None:
        return Model(np.zeros(0), np.zeros(0), np.zeros(0), 0.0, 1.0, 0.0, 0.0)
    slots, ratios, weights = (np.frombuffer(row[c], np.float64) for c in ("slots", "ratios", "weights"))
    return Model(slots.astype(np.int64), ratios, weights, *[row[c] for c in ("bias", "slope", "shift", "share")])


class Scorer:
    """Probabilities of texts under a model."""

    def __init__(self, model: Model):
        self.model = model
        self.grams = Grams()
        # Ratio and scaled weight per slot, for one look-up each.
        self.ratio, self.pull = np.zeros(SLOTS), np.zeros(SLOTS)
        self.ratio[model.slots] = model.ratios
        if len(model.slots):
            self.pull[model.slots] = model.ratios * model.weights

    def score(self, text: str | None) -> float:
        model = self.model
        if not len(model.slots):
            return model.share
        found = self.grams.of(text)
        ratios = self.ratio[found]
        size = math.sqrt(float(ratios @ ratios))
        margin = model.bias + (float(self.pull[found].sum()) / size if size else 0.0)
        return 1 / (1 + math.exp(-max(min(model.slope * margin + model.shift, 30.0), -30.0)))


def with_score(df: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The frame with a column ``__score`` of every text."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    def start():
        scorer = Scorer(shared.value)
        return lambda texts: [(scorer.score(text),) for text in texts]

    return df.withColumn("__score", text_function("score double", start)(F.col(text_col))["score"])


def score(
    df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", least: float = 0.3
) -> DataFrame:
    """(id, score, predicted) for every row; predicted is 1 from a score of ``least`` on."""
    found = with_score(df.select(id_col, text_col), model, text_col)
    return found.select(
        id_col, F.col("__score").alias("score"), (F.col("__score") >= least).cast("int").alias("predicted")
    )
