from __future__ import annotations

import gc
import itertools
import random
import weakref

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from weir.llm import common, language, toxicity

DOC = "doc_id bigint, text string, lang string, source string, score string"
WORDS = {
    "aa": ["kalu", "kamo", "kari", "kasu"],
    "bb": ["torin", "tobel", "tosk", "toff"],
    "cc": ["дом", "мир", "сон"],
}


def texts(seed, n=90):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        lang = "abc"[i % 3] * 2
        rows.append((i, " ".join(rnd.choices(WORDS[lang], k=rnd.randint(6, 30))), lang, "s", "x"))
    return rows


def odd_rows(first):
    return [
        (first, None, "aa", None, None), (first + 1, "", "aa", "", ""), (first + 2, "12 !? 3", "bb", "", ""),
        (None, "kalu kamo", None, None, None), (first + 3, "KALU " * 3000, None, "", ""),
        (first + 3, "KALU " * 3000, None, "", ""), (first + 4, "漢字 漢字", None, "", ""), (first + 5, "İ kalu", None, "", ""),
    ]


def test_viterbi_finds_the_best_path():
    rnd = np.random.default_rng(0)
    scores = [rnd.normal(size=(n, 3)) for n in (1, 5, 3, 7)]
    for found, s in zip(language.viterbi(scores, 0.7), scores):
        def value(path):
            changes = sum(a != b for a, b in zip(path, path[1:]))
            return s[np.arange(len(s)), list(path)].sum() - 0.7 * changes

        best = max(value(p) for p in itertools.product(range(3), repeat=len(s)))
        assert value(found.tolist()) == pytest.approx(best)


def test_languages(spark):
    df = spark.createDataFrame(texts(1) + odd_rows(500), DOC)
    model = language.fit(df, allowed=F.col("doc_id") % 3 != 5)
    assert model.scripts["cyrillic"] == ["cc"]
    held = spark.createDataFrame(texts(2) + odd_rows(500), DOC)
    found = language.predict(held, model).collect()
    assert len(found) == 98
    by_id = {r.doc_id: r for r in found}
    assert all(by_id[i].lang_pred == "abc"[i % 3] * 2 for i in range(90))
    assert [(by_id[500 + i].lang_pred, by_id[500 + i].score) for i in range(3)] == [("und", 0.0)] * 3
    assert by_id[None].lang_pred == by_id[503].lang_pred == by_id[505].lang_pred == "aa"
    assert by_id[504].lang_pred in ("aa", "bb", "cc")
    kept = language.keep_known(held, model)
    assert kept.columns == held.columns and kept.where("doc_id in (500, 501, 502)").isEmpty()


def test_spans_of_mixed_text(spark):
    model = language.fit(spark.createDataFrame(texts(1), DOC))
    text = "kalu kamo kari kasu, дом мир сон дом!"
    row = language.predict(spark.createDataFrame([(1, text)], "doc_id bigint, text string"), model).first()
    assert [(text[s.start : s.end], s.lang) for s in row.spans] == [
        ("kalu kamo kari kasu", "aa"), ("дом мир сон дом", "cc"),
    ]


def test_nothing_to_learn(spark):
    empty = spark.createDataFrame([], DOC)
    assert language.fit(empty) is None
    assert language.predict(empty, None).collect() == []
    row = language.predict(spark.createDataFrame(texts(1)[:1], DOC), None).first()
    assert (row.lang_pred, row.score) == ("und", 0.0)
    model = toxicity.fit(empty, spark.createDataFrame([], "doc_id bigint, toxic int"))
    assert toxicity.score(empty, model).collect() == []
    assert toxicity.score(spark.createDataFrame(texts(1)[:1], DOC), model).first().score == 0.0


def test_hidden_words():
    assert toxicity.plain_word("st*pid,") == ("stpid", True)
    assert toxicity.plain_word("1d10t!") == ("idiot", True)
    assert toxicity.plain_word('"Idiot"') == ("idiot", False)
    assert toxicity.plain_word("1999") == ("1999", False)


def test_toxicity_on_held_out_rows(spark):
    rnd = random.Random(3)
    plain = [f"word{i:02d}x".replace("0", "o").replace("1", "l") for i in range(40)]
    plain = ["".join(c for c in w if c.isalpha()) + chr(97 + i % 26) for i, w in enumerate(plain)]
    rows, labels = [], []
    for i in range(600):
        words, toxic = rnd.choices(plain, k=rnd.randint(20, 60)), int(i % 5 == 0)
        if toxic:
            for _ in range(3):
                words.insert(rnd.randrange(len(words)), rnd.choice(["grobian", "wretch", "mudface"]))
        rows.append((i, " ".join(words), "aa", "s", "x"))
        labels += [(i, toxic, "l")] * rnd.choice([1, 1, 2])
    labels += [(3, None, "l"), (None, 1, "l"), (9999, 1, "l")]
    df = spark.createDataFrame(rows + odd_rows(2000), DOC)
    marks = spark.createDataFrame(labels, "doc_id bigint, toxic int, text string")
    model = toxicity.fit(df, marks, allowed=F.col("doc_id") % 4 != 0)
    assert "grobian" in model.lexicon
    found = {r.doc_id: r for r in toxicity.score(df, model).collect()}
    held = [i for i in range(600) if i % 4 == 0]
    right = sum(found[i].predicted == int(i % 5 == 0) for i in held)
    assert right >= 0.95 * len(held)
    assert all(0 <= r.score <= 1 for r in found.values()) and found[2000].predicted == 0
    kept = toxicity.drop_toxic(df, model)
    assert kept.columns == df.columns and kept.where("doc_id = 1").count() == 1


def test_a_worker_holds_one_operators_memory_at_a_time():
    """Spark hands Python workers from stage to stage."""
    made = []

    def words():
        return common.kept_by_worker("words", lambda: made.append(1) or {"a": 1})

    assert words() is words() and len(made) == 1

    def start():
        assert not common._kept
        return lambda texts: [(len(text or ""),) for text in texts]

    work = common.text_function("n int", start).func
    found = list(work(iter([pd.Series(["ab", None]), pd.Series(["c"])])))
    assert [n for part in found for n in part["n"]] == [2, 0, 1]
    assert words() == {"a": 1} and len(made) == 2
    common.clear_worker()


def test_codes_of_tokens_go_with_their_reader():
    gc.disable()
    try:
        reader = toxicity.Reader({"bad": 5.0})
        reader.features("a bad b@d word")
        codes = weakref.ref(reader.codes)
        del reader
        assert codes() is None
    finally:
        gc.enable()
