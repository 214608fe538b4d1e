from __future__ import annotations

import collections
import itertools
import math
import random

import numpy as np
import pyarrow as pa
import pytest

from weir.llm import divergence, quality, ranked_search

DOC = "doc_id bigint, text string, lang string, source string, n bigint, term string, rank string, score string"


def doc(i, text, lang="en", source="a"):
    return (i, text, lang, source, 7, "x", "y", "z")


def texts(seed, n, words):
    rnd = random.Random(seed)
    size = len(words)
    return [" ".join(words[min(int(rnd.expovariate(6 / size)), size - 1)] for _ in range(rnd.randint(0, 25))) for _ in range(n)]


WORDS = [f"{w}{c}" for w in ("Abcdefgh", "the", "über", "漢字", "of") for c in "abcdefgh"]


def divergence_by_hand(rows, least_docs, top):
    def words(text):
        out = "".join(c.lower() if "A" <= c <= "Z" else c if c.islower() and c < "\x80" or c >= "\x80" else " " for c in text or "")
        return [w for w in out.split(" ") if w]

    counts, docs, groups = collections.defaultdict(collections.Counter), collections.defaultdict(collections.Counter), set()
    for _, text, lang, source, *_ in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        counts[lang, source].update(words(text))
        docs[lang].update(set(words(text)))
    out = []
    for lang in {g[0] for g in groups}:
        kept = [t for t, n in docs[lang].items() if n >= least_docs]
        whole = collections.Counter()
        for g in groups:
            if g[0] == lang:
                whole.update(counts[g])

        def shares(c):
            total = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 5) // (total + 5 * len(kept)) for t in kept}

        q, sources = shares(whole), sorted(s for x, s in groups if x == lang)
        p = {s: shares(counts[lang, s]) for s in sources}
        for s in sources:
            pairs = [(-sum(abs(p[s][t] - p[o][t]) for t in kept), o.encode()) for o in sources if o != s]
            out += [(lang, s, "pair", o.decode(), -v, r + 1) for r, (v, o) in enumerate(sorted(pairs))]
            terms = [(q[t] - p[s][t], t.encode()) for t in kept if counts[lang, s][t] and p[s][t] > q[t]]
            out += [(lang, s, "term", t.decode(), -v, r + 1) for r, (v, t) in enumerate(sorted(terms)[:top])]
    return sorted(out)


@pytest.mark.parametrize("seed, top", [(1, 3), (2, 50)])
def test_divergence_as_by_hand(spark, seed, top):
    rnd = random.Random(seed)
    rows = [
        doc(i, t, rnd.choice(["en", "en", "de"]), rnd.choice(["a", "b", "ä", "c d", "e"]))
        for i, t in enumerate(texts(seed, 150, WORDS))
    ]
    rows += rows[:3]
    rows += [doc(900, None), doc(901, ""), doc(None, "the", None, None), doc(902, "", "en", None), doc(903, "12 ;", "xx", "only")]
    rows += [doc(904, "thea " * 4000), doc(905, "x", "xx", "two"), doc(906, "abcdefghi abcdefghj", "en", "")]
    df = spark.createDataFrame(rows, DOC).repartition(5)
    found = divergence.audit(df, least_docs=4, top=top).collect()
    assert sorted(map(tuple, found)) == divergence_by_hand(rows, 4, top)
    none = divergence.audit(df.where("doc_id < 0"))
    assert none.collect() == [] and dict(none.dtypes)["rank"] == "int" and dict(none.dtypes)["value"] == "bigint"


def test_skybands_meet_no_term_below_its_language(spark, monkeypatch):
    rows = [doc(i, text, source="ab"[i % 2]) for i, text in enumerate(texts(3, 60, WORDS))]
    met = []
    kept = divergence.skybands

    def watched(terms, k):
        met.append(terms.collect())
        return kept(terms, k)

    monkeypatch.setattr(divergence, "skybands", watched)
    found = divergence.audit(spark.createDataFrame(rows, DOC), least_docs=4, top=2).collect()
    assert sorted(map(tuple, found)) == divergence_by_hand(rows, 4, 2)
    counts, docs = {"a": collections.Counter(), "b": collections.Counter()}, collections.Counter()
    for _, text, _, source, *_ in rows:
        words = [w.decode() for w in divergence.terms_of(text)]
        counts[source].update(words)
        docs.update(set(words))
    v = [t for t in docs if docs[t] >= 4]
    total = {s: sum(c[t] for t in v) + 5 * len(v) for s, c in counts.items()}
    whole = sum(total.values()) - 5 * len(v)
    above = {
        (s, t) for s, c in counts.items() for t in v
        if c[t] and (c[t] + 5) * whole >= (counts["a"][t] + counts["b"][t] + 5) * total[s]
    }
    assert {(r.source, r.term) for r in met[0]} == above
    assert len(above) < sum(t in c for c in counts.values() for t in v)


def test_shares_of_counts_beyond_64_bits(spark):
    df = spark.createDataFrame([(10**17, 10**18, 10**6)], "n bigint, total bigint, terms bigint")
    found = df.select(divergence.share(df["n"], df["total"], df["terms"])).first()[0]
    assert found == 1 + 10**9 * (10**17 + 5) // (10**18 + 5 * 10**6)


@pytest.mark.parametrize("k", [1, 3])
def test_skyband_keeps_what_few_dominate(k):
    rnd = random.Random(k)
    rows = {"prefixed" + "".join(rnd.choices("ab", k=rnd.randint(0, 4))): (rnd.randint(1, 6), rnd.randint(6, 12)) for _ in range(200)}
    items = sorted((-n, lang, t.encode()) for t, (n, lang) in rows.items())
    band, kept = divergence.Skyband(k), []
    for at in range(0, len(items), 7):
        part = items[at : at + 7]
        heads = np.array([int.from_bytes(t[:8].ljust(8, b"\0"), "big") for *_, t in part], np.uint64)
        kept += [part[i] for i in band.feed(np.array([x[1] for x in part]), heads, [t for *_, t in part])]

    def dominators(x):
        return sum(y[0] <= x[0] and y[1] <= x[1] and y[2] < x[2] for y in items)

    assert kept == [x for x in items if dominators(x) < k]


def test_counts_and_sums_are_handed_on_in_parts(monkeypatch):
    monkeypatch.setattr(divergence, "HELD_COUNTS", 3)
    batch = pa.RecordBatch.from_pydict({"lang": ["en", "de", "en"], "source": ["a", "a", "a"], "text": ["a b c A", "", "a d"]})
    total = collections.Counter()
    for out in divergence.count_terms(iter([batch])):
        for lang, source, term, n, docs in zip(*[c.to_pylist() for c in out.columns]):
            total[lang, source, term] += n + 100 * docs
    assert total == {("en", "a", ""): 0, ("de", "a", ""): 0, ("en", "a", "a"): 203, ("en", "a", "b"): 101,
                     ("en", "a", "c"): 101, ("en", "a", "d"): 101}

    monkeypatch.setattr(divergence, "BLOCK", 2)
    monkeypatch.setattr(divergence, "HELD_BLOCKS", 1)
    rnd = random.Random(3)
    base = [rnd.randint(1, 50) for _ in range(7)]
    rows = [("en", t, s, base[s] + rnd.randint(0, 90), base[s]) for t in "pqr" for s in rnd.sample(range(7), 5)]
    names = ["lang", "term", "place", "p", "base"]
    batches = [pa.RecordBatch.from_pydict(dict(zip(names, map(list, zip(*rows[i : i + 4]))))) for i in range(0, len(rows), 4)]
    sums = collections.Counter()
    for out in divergence.add_common(iter(batches)):
        for _, lo, hi, value in zip(*[c.to_pylist() for c in out.columns]):
            sums[lo, hi] += value
    p = {(t, s): v for _, t, s, v, _ in rows}
    for lo, hi in itertools.combinations(range(7), 2):
        both = [(p[t, lo], p[t, hi]) for t in "pqr" if (t, lo) in p and (t, hi) in p]
        a, b = base[lo], base[hi]
        assert sums[lo, hi] == sum(abs(x - y) - abs(x - b) - abs(a - y) + abs(a - b) for x, y in both)


ITEM = "item_id bigint, text string, score string, rank string"


def search_by_hand(rows, items, top):
    def words(text):
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        return [w for w in "".join(c if c.isdigit() or "a" <= c <= "z" or c >= "\x80" else " " for c in low).split(" ") if w]

    docs = [(i, collections.Counter(words(t))) for i, t, *_ in rows]
    docs = [(i, c, sum(c.values())) for i, c in docs if c]
    total, length = len(docs), sum(n for *_, n in docs)
    holding = collections.Counter(t for _, c, _ in docs for t in c)
    asked = collections.defaultdict(set)
    for i, text, *_ in items:
        asked[i] |= set(words(text))
    out = []
    for item, terms in asked.items():
        scored = []
        for i, c, n in docs:
            m = 50 + 50 * n * total // length
            score = sum(
                math.floor(1000 * math.log((2 * total + 2) / (2 * holding[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 20 * m))
                for t in terms if c[t]
            )
            if score > 0:
                scored.append((-score, i is None, i or 0, i))
        out += [(item, r + 1, i, -s) for r, (s, _, _, i) in enumerate(sorted(scored)[:top])]
    return sorted(out, key=str)


@pytest.mark.parametrize("asked, portion, top", [(10**6, 10**6, 5), (9, 40, 50)])
def test_search_as_by_hand(spark, asked, portion, top):
    rows = [doc(i, t) for i, t in enumerate(texts(4, 200, WORDS))]
    rows += rows[5:8] + [doc(900, None), doc(901, ""), doc(None, "thea 42 ofb"), doc(902, "thea 42 " * 3000), doc(903, "?!")]
    items = [(i, t, "x", "y") for i, t in enumerate(texts(5, 9, WORDS))]
    items += [(50, None, "", ""), (51, "", "", ""), (52, "unseen", "", ""), (53, "THEA the 42 42", "", ""), (None, "ofa", "", "")]
    items += [(1, "42", None, None)]
    df, what = spark.createDataFrame(rows, DOC).repartition(3), spark.createDataFrame(items, ITEM)
    found = ranked_search.search(df, what, top=top, asked=asked, portion=portion).collect()
    assert sorted(map(tuple, found), key=str) == search_by_hand(rows, items, top)


def test_search_without_documents_or_items(spark):
    df, what = spark.createDataFrame([], DOC), spark.createDataFrame([(1, "a", "", "")], ITEM)
    assert ranked_search.search(df, what).collect() == []
    some = spark.createDataFrame([doc(1, "a b")], DOC)
    assert ranked_search.search(some, what.limit(0)).collect() == []
    only = ranked_search.search(some, what).collect()
    assert [tuple(r) for r in only] == search_by_hand([doc(1, "a b")], [(1, "a")], 50)


def test_bounds_leave_strata_unseen(monkeypatch):
    """Short documents that hold the term often beat the bound of all longer ones."""
    sizes = np.ones(60, np.int64)
    m = np.repeat([60, 2000, 3000], 20)
    strata = ranked_search.Strata(np.arange(60), np.ones(60, bool), m, sizes, np.ones(60, np.int64), np.repeat([5, 1, 1], 20))
    best, offers = ranked_search.Best(3), []
    monkeypatch.setattr(best, "offer", lambda *x: (offers.append(len(x[0])), ranked_search.Best.offer(best, *x)))
    strata.search(np.array([1]), np.array([10]), best)
    assert offers == [20] and best.ids.tolist() == [0, 1, 2]
    assert best.least == 10 * (5 * 10**9 // (5000 + 20 * 60))


def test_dual_descent_finds_the_least_loss():
    rnd = np.random.default_rng(5)
    rows = [np.sort(rnd.choice(6, 3, replace=False)) for _ in range(40)]
    values = [rnd.normal(size=3) for _ in rows]
    y, cost = np.where(rnd.random(40) < 0.5, 1.0, -1.0), np.full(40, 0.7)
    w = quality.dual_descent(rows, values, y, cost, 6, rounds=2000)
    dense = np.zeros((40, 6))
    for i, (r, v) in enumerate(zip(rows, values)):
        dense[i, r] = v

    def loss(w):
        return 0.5 * w @ w + (cost * np.maximum(1 - y * (dense @ w), 0) ** 2).sum()

    slope = w - 2 * dense.T @ (cost * y * np.maximum(1 - y * (dense @ w), 0))
    assert np.abs(slope).max() < 1e-2
    assert all(loss(w) <= loss(w + 0.05 * rnd.normal(size=6)) for _ in range(50))


def test_ratios_and_features():
    slots, ratios = quality.log_ratios([np.array([1, 2]), np.array([1]), np.array([1, 3])], np.array([True, True, False]))
    assert slots.tolist() == [1] and ratios.tolist() == [0.0]
    grams = quality.Grams()
    assert len(grams.of(None)) == len(grams.of("")) == len(grams.of(" \n")) == 0
    a, b = set(grams.of("one two one two")), set(quality.Grams().of("one two one two"))
    assert a == b and len(a) == len(grams.of("one two one two"))
    assert quality.parts("Word,") == ("word", "Aa,") and quality.parts("on###") == ("on", "a#")
    assert quality.parts("A1-b!!") == ("a1-b", "A0-a!") and quality.parts("***") == ("", "*")
    assert set(grams.of("one " * 50)) != set(grams.of("one two " * 25))


@pytest.mark.parametrize("size", [2, 17, 10_000])
def test_long_texts_in_portions(monkeypatch, size):
    text = " ".join(texts(6, 20, WORDS)) + " on on on on" * 30
    whole = set(quality.Grams().of(text))
    monkeypatch.setattr(quality, "TOKENS_AT_ONCE", size)
    assert set(quality.Grams().of(text)) == whole


def quality_rows(seed, first, n=120):
    rnd = random.Random(seed)
    rows, marks = [], []
    for i in range(first, first + n):
        text = " ".join(rnd.choices(WORDS, k=rnd.randint(8, 40)))
        good = i % 3 != 0
        if not good:
            words = text.split()
            repeated = " ".join(w for w in words[:3] for _ in range(9))
            text = [text.upper(), " ".join(w + "#%" for w in words), repeated][i % 9 // 3]
        rows.append(doc(i, text))
        marks.append((i, int(good), "x"))
    return rows, marks


def test_quality_on_held_out_rows(spark):
    rows, marks = quality_rows(1, 0)
    more, held = quality_rows(2, 1000)
    odd = [doc(5000, None), doc(5001, ""), doc(None, "the of"), doc(5002, "THE " * 5000), doc(5002, "THE " * 5000), doc(5003, "漢字")]
    df = spark.createDataFrame(rows + more + odd, DOC)
    labels = spark.createDataFrame(marks + held + [(1, None, None), (None, 1, None), (4, 1, "")], "doc_id bigint, quality int, text string")
    model = quality.fit(df, labels, allowed=labels["doc_id"] < 1000)
    found = quality.score(df, model).collect()
    assert len(found) == 246 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in found)
    by_id = {r.doc_id: r for r in found}
    right = sum(by_id[i].predicted == good for i, good, _ in held)
    assert right >= 116
    assert by_id[5000].score == by_id[5001].score
    again = quality.fit(df.repartition(7), labels, allowed=labels["doc_id"] < 1000)
    assert again.weights.tolist() == model.weights.tolist() and again.slope == model.slope


def test_quality_without_two_classes(spark):
    df = spark.createDataFrame([doc(1, "a b"), doc(2, None)], DOC)
    kind = "doc_id bigint, quality int, text string"
    good = quality.score(df, quality.fit(df, spark.createDataFrame([(1, 1, ""), (2, 1, "")], kind))).collect()
    assert [(r.score, r.predicted) for r in good] == [(1.0, 1)] * 2
    none = quality.fit(df, spark.createDataFrame([], kind))
    assert [(r.score, r.predicted) for r in quality.score(df, none).collect()] == [(0.0, 0)] * 2
    assert quality.score(df.limit(0), none).collect() == []
