"""Toxicity scores: boosted trees over dense features of a text, with isotonic calibration.

Fitting takes three disjoint parts of a bounded sample of labelled rows. From the first, a
lexicon: words and word beginnings that toxic texts hold far more often than others. On the
second, gradient-boosted trees over the features below. On the third, an isotonic curve
turns the trees' output into a probability. Nothing but the text enters a score.

Features: densities of strong and weak lexicon words, how close they come to a word of
second person, rates of capitals, punctuation, exclamation, digits and obfuscated spelling
(letters replaced by digits or signs), and the length.

Definite results: null and empty texts are scored as texts of no words. Without any labelled
row of one class the score is the share of toxic rows seen (0 when there are no labels).
Labels that are null are left out, several labels of one id count as toxic if one does.
Repeated rows and null ids are scored like any other; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

import numpy as np
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weir.llm.common import map_rows, saved, text_function

# About so many labelled rows of each class are used, chosen by a hash of the id.
TOXIC_ROWS, OTHER_ROWS = 6_000, 12_000
# Shares of the sample, in tenths, for the lexicon and the trees; the rest calibrates.
LEXICON_TENTHS, TREE_TENTHS = 5, 3
LEXICON_SIZE = 4_000
LEAST_ODDS, STRONG_ODDS, LEAST_Z = 2.0, 4.0, 2.5
TREES, DEPTH, STEP = 20, 3, 0.3
KEPT_WORDS = 300_000

# Second-person words of English, German, French and Spanish.
SECOND_PERSON = set(
    "you your yours yourself yourselves u ur ya du dich dir dein deine deinen deinem deiner "
    "ihr euch euer eure tu toi ton tes vous votre vos tú ti usted ustedes vosotros tus tuyo".split()
)
# Signs and digits that stand for letters.
LOOKALIKES = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t",
                            "@": "a", "$": "s", "!": "i", "|": "l", "€": "e"})
STRONG, WEAK, SECOND, CAPITAL, HIDDEN = 1, 2, 4, 8, 16
FEATURES = 16
_EDGES = re.compile(r"^\W+|\W+$")
_INSIDE = re.compile(r"[\W_]+")


def plain_word(token: str) -> tuple[str, bool]:
    """(lower-case word without signs, whether letters seem to be hidden)."""
    core = _EDGES.sub("", token)
    low = core.lower()
    if low.isalpha() or not any(map(str.isalpha, low)):
        return low, False
    # A sign at the end is punctuation, one at the start may stand for a letter.
    word = _INSIDE.sub("", token.rstrip("!|.,;:?").lower().translate(LOOKALIKES))
    return word, word.isalpha()


def terms_of(word: str) -> list[str]:
    """A word and its beginnings of four to six letters; a beginning ends in '*'."""
    return [word, *(word[:n] + "*" for n in (4, 5, 6) if len(word) >= n)]


class Reader:
    """Turns texts into feature rows under a lexicon of term -> log odds."""

    def __init__(self, lexicon: dict[str, float]):
        self.codes: dict[str, int] = _Codes(lexicon)

    def features(self, text: str | None) -> list[float]:
        text = text or ""
        codes = np.frombuffer(bytes(map(self.codes.__getitem__, text.split())), np.uint8)
        chars = np.bincount(np.frombuffer(text.encode(), np.uint8), minlength=256)
        n, size = max(len(codes), 1), max(len(text), 1)
        count = {b: int(np.count_nonzero(codes & b)) for b in (STRONG, WEAK, SECOND, CAPITAL, HIDDEN)}
        hits = np.flatnonzero(codes & (STRONG | WEAK))
        seconds = np.flatnonzero(codes & SECOND)
        near = close = 0.0
        if len(hits) and len(seconds):
            at = np.searchsorted(seconds, hits)
            after = seconds[np.minimum(at, len(seconds) - 1)]
            before = seconds[np.maximum(at - 1, 0)]
            gaps = np.minimum(np.abs(after - hits), np.abs(before - hits))
            near, close = float(1.0 / (1 + gaps.min())), float(np.mean(gaps <= 3))
        letters = int(chars[65:91].sum() + chars[97:123].sum())
        signs = int(chars[33:48].sum() + chars[58:65].sum() + chars[91:97].sum())
        return [
            100.0 * count[STRONG] / n, math.log1p(count[STRONG]),
            100.0 * count[WEAK] / n, math.log1p(count[WEAK]),
            100.0 * count[SECOND] / n, near, close,
            count[CAPITAL] / n, int(chars[65:91].sum()) / max(letters, 1),
            signs / size, (int(chars[33]) + int(chars[63])) / size, int(chars[48:58].sum()) / size,
            count[HIDDEN] / n, float(np.count_nonzero((codes & HIDDEN > 0) & (codes & 3 > 0))),
            math.log1p(len(codes)), len(text) / n,
        ]


class _Codes(dict):
    """Codes of tokens, remembered while memory allows. Without a cycle of references, so that
    they go with their reader."""

    def __init__(self, lexicon: dict[str, float]):
        super().__init__()
        self.lexicon = lexicon

    def code(self, token: str) -> int:
        word, hidden = plain_word(token)
        odds = max((self.lexicon.get(t, 0.0) for t in terms_of(word)), default=0.0)
        return (
            STRONG * (odds >= STRONG_ODDS)
            + WEAK * (0 < odds < STRONG_ODDS)
            + SECOND * (word in SECOND_PERSON)
            + CAPITAL * (len(word) > 1 and token.isupper())
            + HIDDEN * hidden
        )

    def __missing__(self, token: str) -> int:
        if len(self) >= KEPT_WORDS:
            self.clear()
        code = self[token] = self.code(token)
        return code


@dataclass
class Model:
    """A fitted scorer; without trees it gives ``share`` for every text."""

    lexicon: dict[str, float]
    trees: GBTClassificationModel | None
    curve: IsotonicRegressionModel | None
    share: float


def featured(df: DataFrame, lexicon: dict[str, float], text_col: str) -> DataFrame:
    """The frame with a vector ``__features`` of every text."""
    shared = df.sparkSession.sparkContext.broadcast(lexicon)

    def start():
        reader = Reader(shared.value)
        return lambda texts: [(reader.features(text),) for text in texts]

    row = text_function("row array<double>", start)(F.col(text_col))
    return df.withColumn("__row", row).withColumn("__features", array_to_vector("__row.row")).drop("__row")


def labelled_sample(
    df: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str,
    allowed: Column | None, toxic_rows: int, other_rows: int,
) -> DataFrame:
    """(text, label, part): about the given number of rows per class, equal texts once."""
    marks = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
    if allowed is not None:
        marks = marks.where(allowed)
    marks = marks.groupBy(id_col).agg(F.max((F.col(label_col) > 0).cast("int")).alias("label"))
    n = {r["label"]: r["count"] for r in marks.groupBy("label").count().collect()}
    share = F.when(F.col("label") == 1, toxic_rows / max(n.get(1, 1), 1)).otherwise(
        other_rows / max(n.get(0, 1), 1)
    )
    place = F.pmod(F.xxhash64(F.col(id_col), F.lit("toxicity")), F.lit(1_000_003))
    part = F.pmod(F.xxhash64(F.col(id_col), F.lit("part")), F.lit(10))
    chosen = marks.where(place < share * 1_000_003).select(
        F.col(id_col).alias("__id"), "label", part.alias("part")
    )
    # The sample is bounded by the arguments, so its ids may be broadcast.
    rows = df.select(F.col(id_col).alias("__id"), F.col(text_col).alias("text"))
    return rows.join(F.broadcast(chosen), "__id").dropDuplicates(["text"]).drop("__id")


def learn_lexicon(sample: DataFrame) -> dict[str, float]:
    """Terms that toxic texts hold far more often, with their log odds."""

    def start():
        def terms(rows):
            found: dict[tuple[str, int], int] = {}
            for text, label in rows:
                words = {plain_word(t)[0] for t in (text or "").split()}
                for t in {t for w in words for t in terms_of(w)}:
                    found[t, label] = found.get((t, label), 0) + 1
            return [(t, label, n) for (t, label), n in found.items()]

        return terms

    counted = map_rows(sample.select("text", "label"), "term string, label int, n bigint", start)
    docs = {r["label"]: r["count"] for r in sample.groupBy("label").count().collect()}
    a, b = F.sum(F.when(F.col("label") == 1, F.col("n")).otherwise(0)), F.sum("n")
    t, n = F.col("toxic") + 0.5, F.col("all") - F.col("toxic") + 0.5
    odds = F.log(t / F.lit(docs.get(1, 0) + 1.0)) - F.log(n / F.lit(docs.get(0, 0) + 1.0))
    top = (
        counted.groupBy("term")
        .agg(a.alias("toxic"), b.alias("all"))
        .where("toxic >= 3 and term <> ''")
        .withColumn("odds", odds)
        .withColumn("z", F.col("odds") / F.sqrt(1 / t + 1 / n))
        .where((F.col("odds") >= LEAST_ODDS) & (F.col("z") >= LEAST_Z))
        .orderBy(F.desc("z"), "term")
        .limit(LEXICON_SIZE)
    )
    return {r["term"]: r["odds"] for r in top.select("term", "odds").collect()}


def fit(
    df: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    allowed: Column | None = None,
    toxic_rows: int = TOXIC_ROWS,
    other_rows: int = OTHER_ROWS,
) -> Model:
    """Learn from labelled rows whose ``labels`` row ``allowed`` admits."""
    sample = saved(
        labelled_sample(df, labels, id_col, text_col, label_col, allowed, toxic_rows, other_rows),
        "toxicity-sample",
    )
    seen = {r["label"]: r["count"] for r in sample.groupBy("label").count().collect()}
    share = seen.get(1, 0) / max(sum(seen.values()), 1)
    lexicon = learn_lexicon(sample.where(F.col("part") < LEXICON_TENTHS))
    rest = saved(
        featured(sample.where(F.col("part") >= LEXICON_TENTHS), lexicon, "text").select(
            F.col("label").cast("double").alias("label"), "part", "__features"
        ),
        "toxicity-features",
    ).coalesce(4)
    for_trees = rest.where(F.col("part") < LEXICON_TENTHS + TREE_TENTHS)
    if for_trees.select("label").distinct().count() < 2:
        return Model(lexicon, None, None, share)
    learner = GBTClassifier(
        featuresCol="__features", predictionCol="__class", seed=7,
        maxIter=TREES, maxDepth=DEPTH, stepSize=STEP,
    )
    learner.setRawPredictionCol("__margin").setProbabilityCol("__odds")
    trees = learner.fit(for_trees)
    held = rest.where(F.col("part") >= LEXICON_TENTHS + TREE_TENTHS)
    held = held.select("label", "__features")
    if held.select("label").distinct().count() < 2:
        return Model(lexicon, trees, None, share)
    raw = trees.transform(held).select("label", vector_to_array("__odds")[1].alias("__raw"))
    curve = IsotonicRegression(featuresCol="__raw", predictionCol="__step").fit(raw)
    return Model(lexicon, trees, curve, share)


def with_score(df: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The frame with a column ``__score`` of every text.

    The calibrated value is a step curve; a hundredth of the trees' own probability is mixed
    in, so that texts on one step keep their order.
    """
    if model.trees is None:
        return df.withColumn("__score", F.lit(model.share))
    found = model.trees.transform(featured(df, model.lexicon, text_col))
    raw = vector_to_array("__odds")[1]
    if model.curve is None:
        return found.select(*[f"`{c}`" for c in df.columns], raw.alias("__score"))
    found = model.curve.transform(found.withColumn("__raw", raw))
    step = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("__step")))
    score = 0.99 * step + 0.01 * F.col("__raw")
    return found.select(*[f"`{c}`" for c in df.columns], score.alias("__score"))


def score(
    df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(id, score, predicted) for every row; predicted is 1 from a score of 0.5 on."""
    found = with_score(df.select(id_col, text_col), model, text_col)
    return found.select(
        id_col, F.col("__score").alias("score"), (F.col("__score") >= 0.5).cast("int").alias("predicted")
    )


def drop_toxic(df: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows that score under 0.5."""
    return with_score(df, model, text_col).where(F.col("__score") < 0.5).drop("__score")
