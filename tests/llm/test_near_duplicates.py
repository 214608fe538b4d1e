from __future__ import annotations

import random

import numpy as np
import pytest

from weir.llm import chosen_path
from weir.llm.components import components

DOC = "doc_id bigint, text string, node string, rep string"


def words_of(text):
    return (text or "").encode().lower().split()


def brute_force(rows):
    """component per id by comparing all pairs of shingle sets."""
    sets = {}
    for i, text, *_ in rows:
        w = words_of(text)
        s = {tuple(w[j : j + 5]) for j in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
        sets.setdefault(i, []).append(s)
    ids = [i for i in sets if i is not None]
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            if any(s and t and 100 * len(s & t) >= 75 * len(s | t) for s in sets[a] for t in sets[b]):
                ra, rb = sorted((find(a), find(b)))
                root[rb] = ra
    return {i: find(i) for i in ids}


def corpus(seed, n=160):
    """Chains of edited texts, copies, short and empty texts, nulls and repeated rows."""
    rnd = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    rows = []
    while len(rows) < n:
        text = rnd.choices(vocabulary, k=rnd.choice([0, 2, 4, 5, 30, 60, 200]))
        for _ in range(rnd.choice([1, 1, 2, 6])):
            rows.append((len(rows) * 7 % 1000, " ".join(text), "n", None))
            if text and rnd.random() < 0.8:
                text = list(text)
                text[rnd.randrange(len(text))] = rnd.choice(vocabulary)
    rows += [rows[3], rows[3], (2001, None, None, None), (2002, "", "", ""), (None, rows[5][1], "n", "r")]
    rows += [(2003, "A b C d E f", None, None), (2004, "a B c\td\x0be F", None, None), (2005, "É é", None, None)]
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_components_match_brute_force(spark, monkeypatch, seed):
    monkeypatch.setattr(chosen_path, "SMALL_NODE", 3)
    rows = corpus(seed)
    want = brute_force(rows)
    found = chosen_path.near_duplicates(spark.createDataFrame(rows, DOC)).collect()
    assert len(found) == len(rows)
    for r in found:
        if r.doc_id is None:
            assert (r.component_id, r.kept) == (None, True)
        else:
            assert (r.component_id, r.kept) == (want[r.doc_id], want[r.doc_id] == r.doc_id), r
    sizes = {r.doc_id: r.n_shingles for r in found}
    assert (sizes[2001], sizes[2002], sizes[2003], sizes[2005]) == (0, 0, 2, 1)


def test_one_large_group_of_near_copies(spark):
    rnd = random.Random(5)
    base = [f"w{rnd.randrange(10_000)}" for _ in range(120)]
    rows = []
    for i in range(300):
        text = list(base)
        text[rnd.randrange(120)] = f"x{i}"
        rows.append((i, " ".join(text), "", ""))
    rows += [(1000 + i, " ".join(base[:60] + [f"y{i}_{j}" for j in range(60)]), "", "") for i in range(200)]
    found = chosen_path.near_duplicates(spark.createDataFrame(rows, DOC)).collect()
    assert {r.component_id for r in found if r.doc_id < 1000} == {0}
    assert all(r.kept for r in found if r.doc_id >= 1000)


def test_empty_table(spark):
    assert chosen_path.near_duplicates(spark.createDataFrame([], DOC)).collect() == []


def test_components_of_a_shuffled_chain(spark):
    order = list(range(200))
    random.Random(3).shuffle(order)
    links = list(zip(order, order[1:])) + [(500, 501), (501, 500), (7, 7)]
    found = components(spark.createDataFrame(links, "a bigint, b bigint")).collect()
    assert {r.root for r in found if r.x < 500} == {0} and len(found) == 202


def test_odd_sketches_never_rule_out_a_link():
    """Sets from far below to above the threshold, small and beyond the size of the sketch."""
    rng = np.random.default_rng(5)
    ruled_out = 0
    for size in (1, 7, 150, 3000):
        for shared in np.linspace(0, 1, 41):
            both = int(size * shared)
            a, b, common = (rng.integers(0, 2**64, n, np.uint64) for n in (size - both, size - both, both))
            a, b = np.union1d(a, common), np.union1d(b, common)
            rows = [np.zeros(chosen_path.TOKENS, np.uint64)] * 2
            x, y = (chosen_path.sketches_of([chosen_path.sketch_of(s, t)]) for s, t in zip((a, b), rows))
            may = bool(chosen_path.may_link(x, y)[0])
            linked = 100 * len(np.intersect1d(a, b)) >= 75 * len(np.union1d(a, b))
            assert may or not linked
            ruled_out += not may
    assert ruled_out > 100


def test_large_group_of_copies_around_the_threshold(spark):
    """Most pairs of the group lie a little below the threshold: few are left to confirm."""
    rng = random.Random(11)
    base = [rng.choice("abcdefghij") + str(rng.randrange(10_000)) for _ in range(150)]
    rows = []
    for i in range(300):
        words = list(base)
        for at in rng.sample(range(150), rng.randrange(10)):
            words[at] = f"edit{i}x{at}"
        rows.append((i, " ".join(words), None, ""))
    found = chosen_path.near_duplicates(spark.createDataFrame(rows, DOC)).collect()
    assert {r.doc_id: r.component_id for r in found} == brute_force(rows)


def test_children_of_a_level_are_made_once(spark, monkeypatch):
    """Both readers of a level read what was written, neither splits the nodes above again."""
    plans = []
    counted = chosen_path.mixed_nodes

    def watched(rows, level):
        plans.append(rows._jdf.queryExecution().optimizedPlan().toString())
        return counted(rows, level)

    monkeypatch.setattr(chosen_path, "SMALL_NODE", 3)
    monkeypatch.setattr(chosen_path, "mixed_nodes", watched)
    rows = corpus(1)
    found = chosen_path.near_duplicates(spark.createDataFrame(rows, DOC)).collect()
    expected = brute_force(rows)
    assert {r.doc_id: r.component_id for r in found if r.doc_id is not None} == expected
    assert len(plans) > 1
    assert not any("Generate" in plan for plan in plans)
