from __future__ import annotations

import hashlib
import random
import re

import pytest

from checks.compare import difference
from weir.llm import line_windows, queries_native, winnowing

import duckdb


def pieces(text, k=winnowing.K, w=winnowing.W):
    """The kept (hash, position) of a text, window by window."""
    units = re.findall(r"[^ \t\n\x0b\f\r]{1,8}", text or "")
    grams = [" ".join(units[i : i + k]) for i in range(max(len(units) - k, 0) + 1)] if units else []
    hashes = [hashlib.md5(g.encode()).hexdigest()[:15] for g in grams]
    kept = []
    for i in range(max(len(hashes) - w, 0) + 1 if hashes else 0):
        window = hashes[i : i + w]
        at = max(i + j for j, h in enumerate(window) if h == min(window))
        if not kept or kept[-1][1] != at:
            kept.append((hashes[at], at))
    return kept


def test_fingerprints_and_next_texts(spark):
    rnd = random.Random(1)
    texts = [" ".join(rnd.choices(["ab", "c", "longerthaneight", "é"], k=n)) for n in (1, 2, 3, 9, 40, 200)]
    rows = [(i, rnd.choice(texts), "x", "y") for i in range(60)]
    rows += [(7, texts[4], "", ""), (7, texts[4], "", ""), (7, texts[5], "", ""), (100, None, None, None)]
    rows += [(101, "", "", ""), (None, texts[3], "", ""), (None, texts[2], "", ""), (102, " \n\t", "", ""), (103, "z" * 70, "", "")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, next string, prints string")
    found = winnowing.edited_likeness(df).collect()
    order = sorted(((i, t or "") for i, t, *_ in rows), key=lambda x: (x[0] is None, -(x[0] or 0), x[1]))
    want = []
    for (i, text), (_, after) in zip(order, order[1:] + order[:1]):
        third = len(text) // 3
        edited = text[: len(text) - third] + after[:third]
        a, b, c = (pieces(t) for t in (text, edited, after))
        sets = [{h for h, _ in x} for x in (a, b, c)]
        like = [len(sets[0] & s) / len(sets[0] | s) if sets[0] | s else 1.0 for s in sets[1:]]
        want.append((str(i), len(text), edited, a, b, *like))
    def prints(x):
        return list(zip([f"{h:015x}" for h in x.hashes], x.positions))

    got = [
        (str(r.doc_id), r.n_chars, r.edited_text, prints(r.prints), prints(r.edited_prints), r.near_edited, r.near_next) for r in found
    ]
    assert sorted(got) == sorted(want)


def test_a_shared_run_is_found(spark):
    run = " ".join(f"r{i}" for i in range(winnowing.K + winnowing.W - 1))
    a, b = ("x1 x2 x3 " + run + " x4", "y1 " + run + " y2 y3 y4 y5")
    assert {h for h, _ in pieces(a)} & {h for h, _ in pieces(b)}


@pytest.mark.parametrize("use", [winnowing.edited_likeness, line_windows.remove_repeats])
def test_empty_tables(spark, use):
    assert use(spark.createDataFrame([], "doc_id bigint, text string")).collect() == []


def test_one_document_is_its_own_next(spark):
    row = winnowing.edited_likeness(spark.createDataFrame([(4, "a b c")], "doc_id bigint, text string")).first()
    assert row.edited_text == "a b ca"[:4] + "a"[:1] or row.edited_text == "a b " + "a"


def test_repeated_windows_go_but_the_first(spark):
    one = "a\nb\nc\nd"
    rows = [
        (5, "x\n a \n\nb\t\nc\ny", "q"), (2, one, "q"), (9, "a\nb", None), (7, one + "\ne", "q"),
        (3, None, "q"), (4, "", "q"), (None, "n1\nn2\nn3", "q"), (8, "n1\nn2\nn3\nn4", "q"),
        (11, "r\nr\nr\nr\nr", "q"), (2, one, "q"), (12, "\n\n\n\n\n", "q"),
    ]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, n_lines string")
    found = sorted(
        ((r.doc_id if r.doc_id is not None else -1, r.text, r.n_removed) for r in line_windows.remove_repeats(df).collect()),
        key=str,
    )
    assert found == sorted([
        (5, "x\ny", 4), (2, one, 0), (2, one, 0), (9, "a\nb", 0), (7, "e", 4), (3, None, 0), (4, "", 0),
        (-1, "n1\nn2\nn3", 0), (8, "n4", 3), (11, "r", 4), (12, "\n\n\n\n\n", 0),
    ], key=str)


@pytest.mark.parametrize("name", list(queries_native.QUERIES))
def test_sql_agrees(spark, tmp_path, name):
    rnd = random.Random(6)
    lines = [f"line {i} of some text" for i in range(12)] + ["", " "]
    rows = [(i, "\n".join(rnd.choices(lines, k=rnd.randint(0, 9)))) for i in range(80)] + [(200, None)]
    path = str(tmp_path / "documents.parquet")
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(path)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{path}/*.parquet'")
    query, sql = queries_native.QUERIES[name], queries_native.ORACLE_SQL[name]
    assert difference(query(spark, str(tmp_path)), con, sql) is None
