"""Language of texts: script ranges, word scores from character n-grams, Viterbi over words.

A word's script narrows the candidate languages to those that were learned with it. Each
candidate scores the word by how likely its character n-grams are in that language. Viterbi
then picks the sequence of labels with the highest total, where each change of language
costs ``SWITCH``; so a foreign word alone does not open a span, but a foreign sentence does.
The text's language is the one that labels most of its letters.

Definite results: a text that is null, empty or without letters is ``und`` with score 0, and
so is every text when nothing could be learned; ties go to the alphabetically first language.
Repeated rows and null ids are scored like any other; other columns are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weir.llm.common import map_rows, saved, text_function

UNKNOWN = "und"
SWITCH = 9.0
# The model is fitted on about so many labelled texts per language, chosen by a hash of
# the id, and keeps so many n-grams per language; both bound what is collected and broadcast.
TEXTS_PER_LANGUAGE = 2_000
GRAMS_PER_LANGUAGE = 20_000
LANGUAGES = 200
SMOOTHING = 0.5
# Languages that hold at least this share of their letters in a script are candidates for it.
SCRIPT_SHARE = 0.02
KEPT_WORDS = 300_000

# The first code point of each run of letters and its script.
SCRIPTS = [
    (0x0000, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"),
    (0x0590, "hebrew"), (0x0600, "arabic"), (0x0700, "other"), (0x0900, "devanagari"),
    (0x0980, "bengali"), (0x0A00, "gurmukhi"), (0x0A80, "gujarati"), (0x0B00, "oriya"),
    (0x0B80, "tamil"), (0x0C00, "telugu"), (0x0C80, "kannada"), (0x0D00, "malayalam"),
    (0x0D80, "sinhala"), (0x0E00, "thai"), (0x0E80, "lao"), (0x0F00, "tibetan"),
    (0x1000, "myanmar"), (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, "ethiopic"),
    (0x13A0, "other"), (0x1780, "khmer"), (0x1800, "mongolian"), (0x18B0, "other"),
    (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "other"), (0x2C60, "latin"),
    (0x2C80, "other"), (0x3040, "kana"), (0x3100, "other"), (0x3130, "hangul"),
    (0x3190, "other"), (0x3400, "han"), (0xA000, "other"), (0xAC00, "hangul"),
    (0xD7B0, "other"), (0xF900, "han"), (0xFB00, "latin"), (0xFB13, "other"),
    (0xFF21, "latin"), (0xFF66, "kana"), (0xFFA0, "hangul"), (0x10000, "other"),
    (0x20000, "han"), (0x32000, "other"),
]
_STARTS = [first for first, _ in SCRIPTS]
WORD = re.compile(r"[^\W\d_]+")


def script_of(word: str) -> str:
    """The script of a word's first letter."""
    return SCRIPTS[bisect_right(_STARTS, ord(word[0])) - 1][1]


def grams_of(word: str) -> list[str]:
    """The word itself and its pieces of two and three characters, ends marked."""
    marked = f"^{word}$"
    pairs = list(map("".join, zip(marked, marked[1:])))
    return [f" {word}", *pairs, *map("".join, zip(pairs, marked[2:]))]


def lowered(text: str) -> str:
    """Lower case, except for the few letters that would become longer; keeps offsets."""
    low = text.lower()
    if len(low) == len(text):
        return low
    return "".join(x if len(x) == 1 else c for c, x in ((c, c.lower()) for c in text))


@dataclass
class Model:
    """Languages, log probabilities of n-grams (one row each), and scripts per language."""

    languages: list[str]
    rows: dict[str, int]
    logs: np.ndarray
    scripts: dict[str, list[str]]


@dataclass
class Scorer:
    """Scores of words under a model, remembered while memory allows."""

    model: Model
    index: dict[str, int] = field(default_factory=dict)

    def __post_init__(self):
        languages, scripts = self.model.languages, self.model.scripts
        self.all = np.zeros((KEPT_WORDS, len(languages)), np.float32)
        self.barred = {x: [y not in known for y in languages] for x, known in scripts.items()}
        self.none_barred = [False] * len(languages)

    def scores(self, words: list[str]) -> np.ndarray:
        """A row per word, its best language at 0; one without the word's script is far below."""
        model = self.model
        grams = [grams_of(w) for w in words]
        sizes = np.fromiter(map(len, grams), np.int64, len(grams))
        rows = np.fromiter((model.rows.get(g, 0) for x in grams for g in x), np.int64, sizes.sum())
        found = np.add.reduceat(model.logs[rows], np.concatenate([[0], np.cumsum(sizes)[:-1]]))
        scripts = [script_of(w) for w in words]
        barred = np.array([self.barred.get(x, self.none_barred) for x in scripts])
        found = np.where(barred, found.min(1, keepdims=True) - 30.0, found)
        found = (found - found.max(1, keepdims=True)) * (2.0 / np.sqrt(sizes))[:, None]
        return np.maximum(found, -12.0)

    def numbers(self, words: list[str]) -> np.ndarray:
        """Rows of ``all`` for the words of a text."""
        index = self.index
        if len(index) + len(words) > len(self.all):
            index.clear()
            if len(words) > len(self.all):
                self.all = np.zeros((2 * len(words), self.all.shape[1]), np.float32)
        new = [w for w in set(words) if w not in index]
        if new:
            at = len(index)
            index.update(zip(new, range(at, at + len(new))))
            self.all[at : at + len(new)] = self.scores(new)
        return np.fromiter(map(index.__getitem__, words), np.int64, len(words))


def viterbi(scores: list[np.ndarray], switch: float = SWITCH) -> list[np.ndarray]:
    """Best labels for several texts at once, each given as a (words, languages) array.

    Staying costs nothing and every change costs ``switch``, so a step only needs the
    best score so far next to the score of the same language.
    """
    order = sorted(range(len(scores)), key=lambda i: -len(scores[i]))
    sizes = np.array([len(scores[i]) for i in order])
    if not len(sizes) or not sizes[0]:
        return [np.zeros(0, np.int64) for _ in scores]
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    flat = np.concatenate([scores[i] for i in order])
    back = np.zeros(flat.shape, np.uint8)
    languages = np.arange(flat.shape[1])
    best = flat[starts[: np.count_nonzero(sizes)]].astype(np.float64)
    last = best.copy()
    for t in range(1, sizes[0]):
        k = int(np.searchsorted(-sizes, -t, "left"))
        best = best[:k]
        at = starts[:k] + t
        top = best.argmax(1)
        jump = best[np.arange(k), top] - switch
        stay = best >= jump[:, None]
        back[at] = np.where(stay, languages, top[:, None])
        best = np.where(stay, best, jump[:, None]) + flat[at]
        last[:k] = best
    labels = np.zeros(len(flat), np.uint8)
    now = last.argmax(1)
    for t in range(sizes[0] - 1, -1, -1):
        k = int(np.searchsorted(-sizes, -t, "left"))
        at = starts[:k] + t
        labels[at] = now[:k]
        now[:k] = back[at, now[:k]]
    out: list[np.ndarray] = [np.zeros(0, np.uint8)] * len(scores)
    for i, start, size in zip(order, starts, sizes):
        out[i] = labels[start : start + size]
    return out


def fit(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    allowed: Column | None = None,
    texts_per_language: int = TEXTS_PER_LANGUAGE,
) -> Model | None:
    """Learn n-gram probabilities from labelled rows (those that ``allowed`` admits).

    The texts of a language are thinned by a hash of the id to about ``texts_per_language``,
    and counted in Spark; only the most frequent n-grams of each language reach the driver.
    None when no labelled text has a letter.
    """
    rows = df.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    if allowed is not None:
        rows = rows.where(allowed)
    rows = rows.select(
        F.col(lang_col).alias("lang"), F.col(text_col).alias("text"),
        F.xxhash64(F.col(id_col), F.lit("language")).alias("h"),
    )
    sizes = rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(LANGUAGES)
    share = {r["lang"]: min(1.0, texts_per_language / r["count"]) for r in sizes.collect()}
    if not share:
        return None
    limit = F.create_map(*[F.lit(x) for kv in share.items() for x in kv])
    sample = rows.where(F.pmod("h", F.lit(1_000_003)) < limit[F.col("lang")] * 1_000_003)

    def start():
        def count(batch):
            total: dict[str, Counter] = {}
            for lang, text in batch:
                words = Counter(WORD.findall(lowered(text)))
                into = total.setdefault(lang, Counter())
                for word, n in words.items():
                    into["\t" + script_of(word)] += n * len(word)
                    for g in grams_of(word):
                        into[g] += n
            return [(lang, g, n) for lang, found in total.items() for g, n in found.items()]

        return count

    counted = map_rows(sample.select("lang", "text"), "lang string, gram string, n bigint", start)
    totals = saved(counted.groupBy("lang", "gram").agg(F.sum("n").alias("n")), "grams")
    counts: dict[str, Counter] = {lang: Counter() for lang in share}
    for lang in share:
        top = totals.where(F.col("lang") == lang).orderBy(F.desc("n"), "gram")
        counts[lang].update({r["gram"]: r["n"] for r in top.limit(GRAMS_PER_LANGUAGE).collect()})
    return model_of(counts)


def model_of(counts: dict[str, Counter]) -> Model | None:
    """A model from n-gram counts per language (script counts under tab-marked names)."""
    languages = sorted(x for x, c in counts.items() if c)
    if not languages:
        return None
    grams = sorted({g for c in counts.values() for g in c if g[0] != "\t"})
    rows = {g: i + 1 for i, g in enumerate(grams)}
    logs = np.zeros((len(rows) + 1, len(languages)))
    scripts: dict[str, list[str]] = {}
    for j, lang in enumerate(languages):
        found = counts[lang]
        total = sum(n for g, n in found.items() if g[0] != "\t")
        letters = sum(n for g, n in found.items() if g[0] == "\t")
        counted = np.array([0, *(found.get(g, 0) for g in grams)])
        logs[:, j] = np.log((counted + SMOOTHING) / (total + SMOOTHING * (len(grams) + 1)))
        for g, n in found.items():
            if g[0] == "\t" and n >= SCRIPT_SHARE * letters:
                scripts.setdefault(g[1:], []).append(lang)
    return Model(languages, rows, logs.astype(np.float32), scripts)


def labeller(df: DataFrame, model: Model | None, with_spans: bool = False):
    """A column function of texts: struct (lang_pred, score, n_spans[, spans]).

    ``score`` is the share of letters that Viterbi labels with the predicted language.
    ``spans`` lists (start, end, lang) in code points of the text, one per run of words with
    the same label.
    """
    spans = ", spans array<struct<start: int, end: int, lang: string>>" if with_spans else ""
    shared = df.sparkSession.sparkContext.broadcast(model)

    def start():
        scorer = Scorer(shared.value) if shared.value else None

        def label(batch):
            texts = [lowered(text or "") if scorer else "" for text in batch]
            # Words go as soon as their lengths and scores are known, which take less room. Rows of
            # the score table are taken at once: it may start anew with the next text.
            sizes, scores = [], []
            for text in texts:
                words = WORD.findall(text)
                sizes.append(np.fromiter(map(len, words), np.int32, len(words)))
                if words:
                    scores.append(scorer.all[scorer.numbers(words)])
            some = [i for i, found in enumerate(sizes) if len(found)]
            labels = dict(zip(some, viterbi(scores)))
            out = []
            for i, text in enumerate(texts):
                if not len(sizes[i]):
                    out.append((UNKNOWN, 0.0, 0, *([[]] if with_spans else [])))
                    continue
                got = labels[i]
                held = np.bincount(got, sizes[i], len(scorer.model.languages))
                first = np.flatnonzero(np.diff(got.astype(np.int16), prepend=-1))
                winner = int(held.argmax())
                row = [scorer.model.languages[winner], float(held[winner] / held.sum()), len(first)]
                if with_spans:
                    places = [m.span() for m in WORD.finditer(text)]
                    names = scorer.model.languages
                    row.append([
                        {"start": places[a][0], "end": places[b - 1][1], "lang": names[got[a]]}
                        for a, b in zip(first, [*first[1:], len(got)])
                    ])
                out.append(tuple(row))
            return out

        return label

    schema = f"lang_pred string, score double, n_spans int{spans}"
    return text_function(schema, start, at_once=1024)


def predict(
    df: DataFrame,
    model: Model | None,
    id_col: str = "doc_id",
    text_col: str = "text",
    with_spans: bool = True,
) -> DataFrame:
    """(id, lang_pred, score, n_spans[, spans]) per row, see :func:`labeller`."""
    label = labeller(df, model, with_spans)
    return df.select(id_col, label(F.col(text_col)).alias("__found")).select(id_col, "__found.*")


def keep_known(
    df: DataFrame, model: Model | None, text_col: str = "text", least_score: float = 0.5
) -> DataFrame:
    """The rows whose text has a language that labels at least this share of its letters."""
    found = labeller(df, model)(F.col(text_col))
    # Null texts are und, so nothing is null here.
    return df.where((found["lang_pred"] != UNKNOWN) & (found["score"] >= least_score))
