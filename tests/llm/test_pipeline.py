from __future__ import annotations

import os
import shutil

import pandas as pd
import pytest
from test_near_duplicates import brute_force
from test_packing import check

import corpus_pipeline
from weir.llm import language, toxicity

SMALL = "/root/testdata/sf0.01"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def without_repeats(rows):
    """(id, text) with the later occurrences of three lines in a row removed, texts left empty dropped."""
    windows = []
    for i, text in rows:
        lines = [(at, x.strip(" \t\r\f\x0b")) for at, x in enumerate(text.split("\n"))]
        full = [(at, x) for at, x in lines if x]
        windows += [
            ((i, full[k][0]), full[k + 2][0], tuple(x for _, x in full[k : k + 3])) for k in range(len(full) - 2)
        ]
    first, gone = {}, {}
    for place, _, key in sorted(windows):
        first.setdefault(key, place)
    for place, last, key in windows:
        if place != first[key]:
            gone.setdefault(place[0], set()).update(range(place[1], last + 1))
    out = []
    for i, text in rows:
        if i not in gone:
            out.append((i, text))
            continue
        left = "\n".join(x for at, x in enumerate(text.split("\n")) if at not in gone[i])
        if left.strip(" "):
            out.append((i, left))
    return out


@pytest.fixture
def folder(tmp_path):
    """Small tables, with labels enough to learn from, and some rows more: copies, repeated lines, nulls, no letters, no text."""
    docs = pd.read_parquet(f"{SMALL}/documents.parquet")
    long = docs[docs.text.str.split().str.len() > 60].head(4)
    copies = long.assign(doc_id=range(900_000, 900_000 + len(long)))
    edited = long.assign(
        doc_id=range(900_100, 900_100 + len(long)), text=[" ".join(x.split()[:-2]) + " zz" for x in long.text]
    )
    odd = pd.DataFrame(
        [(900_200 + i, x, None, "a", 0) for i, x in enumerate([None, "", "12 34 !", " \n\t"])], columns=COLUMNS
    )
    table = pd.concat([docs, copies, edited, odd], ignore_index=True)[COLUMNS]
    table.to_parquet(tmp_path / "documents.parquet", index=False)
    shutil.copy(f"{SMALL}/labels.parquet", tmp_path / "labels.parquet")
    return str(tmp_path)


def test_stages_one_by_one(spark, folder):
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["language", "toxicity", "lines", "near_duplicates", "packing"]

    def run(name, docs):
        found = stages[name](spark, docs, folder)
        path = os.path.join(folder, f"stage-{name}")
        found.write.parquet(path)
        return spark.read.parquet(path)

    def rows_of(df):
        assert df.columns == COLUMNS
        return sorted((r.doc_id, r.text) for r in df.collect())

    docs = spark.read.parquet(f"{folder}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}

    known = run("language", docs)
    labels = language.predict(docs, language.fit(docs), with_spans=False).collect()
    want = sorted((r.doc_id, texts[r.doc_id]) for r in labels if r.lang_pred != "und" and r.score >= 0.5)
    assert rows_of(known) == want
    assert not {i for i, _ in want} & set(range(900_200, 900_204))

    mild = run("toxicity", known)
    model = toxicity.fit(known, spark.read.parquet(f"{folder}/labels.parquet"))
    scores = toxicity.score(known, model).collect()
    want = sorted((r.doc_id, texts[r.doc_id]) for r in scores if not r.predicted)
    assert rows_of(mild) == want and len(want) < len(scores)

    lines = run("lines", mild)
    want = without_repeats(want)
    assert rows_of(lines) == sorted(want)
    assert all(r.n_chars == len(r.text) for r in lines.collect())

    alone = run("near_duplicates", lines)
    roots = brute_force(want)
    want = [(i, text) for i, text in want if roots[i] == i]
    assert rows_of(alone) == sorted(want) and len(want) < len(roots)

    packed = run("packing", alone)
    check(want, packed.collect(), 4096)


def test_empty_tables(spark, tmp_path):
    for name in ("documents", "labels"):
        source = spark.read.parquet(f"{SMALL}/{name}.parquet")
        source.limit(0).write.parquet(str(tmp_path / f"{name}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
