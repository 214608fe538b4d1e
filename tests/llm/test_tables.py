from __future__ import annotations

import random
from datetime import datetime, timezone

import numpy as np
import pandas as pd
import pytest

from weir.llm import html_text, queries_tables, revisits, vector_search

VECTOR = "vec_id bigint, vector array<bigint>, score string, rank string"


@pytest.mark.parametrize("width, size, cells", [(3, 2, 256), (8, 6, 3), (8, 900, 2), (8, 10**6, 256)])
def test_top_k_as_brute_force(spark, width, size, cells):
    rnd = np.random.default_rng(width)
    rows = [(int(i), [int(x) for x in rnd.integers(-size, size + 1, width)], "", "") for i in range(300)]
    rows += [(7, rows[7][1], "", ""), (900, None, None, None), (901, [1, None, 2], "", ""), (None, [1] * width, "", "")]
    rows += [(902, [1] * (width + 1), "", ""), (903, [0] * width, "", ""), (904, rows[0][1], None, None)]
    df = spark.createDataFrame(rows, VECTOR)
    asked = df.where("vec_id % 9 = 0 or vec_id = 7")
    found = vector_search.top_k(df, asked, 5, rows_per_block=40, queries_per_block=7, cells=cells).collect()
    real = [(i, v) for i, v, *_ in rows if i is not None and v is not None and None not in v]
    asks = [(i, v) for i, v in real if i % 9 == 0 or i == 7]
    want = []
    for q, v in asks:
        scored = sorted((-int(np.dot(v, x)), i) for i, x in real if i != q and len(x) == len(v))[:5]
        if q != 7:  # asked twice, so its ranks interleave
            want += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scored)]
    got = [(r.query_id, r["rank"], r.vec_id, r.score) for r in found if r.query_id != 7]
    assert sorted(got) == sorted(want)


def test_bounds_hold_for_every_pair():
    rnd = np.random.default_rng(2)
    rows = [(i, 100 + i, [int(x) for x in rnd.integers(-500, 700, 6)]) for i in range(50)]
    for cells in (2, 5, 256):
        kept: list = []
        with_cells = vector_search.approximated

        class Frame:
            def select(self, *_):
                return self

        def taken(_, schema, start):
            kept.extend(start()(rows))

        with pytest.MonkeyPatch.context() as patch:
            patch.setattr(vector_search, "map_rows", taken)
            with_cells(Frame(), cells)
        table = pd.DataFrame(kept, columns=["row", "id", "size", "cells", "low", "width", "off"])
        exact = np.array([v for *_, v in rows])
        assert np.allclose(np.linalg.norm(vector_search.centres(table) - exact, axis=1), table["off"])
        queries = table.iloc[:9].assign(id=-1)
        seen = set()
        for q, r, low, high in vector_search.bounds_in_block(table, queries, 5):
            scores = (exact[q] * exact[r]).sum(1)
            assert (low <= scores).all() and (scores <= high).all()
            seen |= set(zip(q.tolist(), r.tolist()))
        for q in range(9):
            best = np.argsort(-(exact @ exact[q]), kind="stable")[:5]
            assert {(q, int(r)) for r in best} <= seen


def test_top_k_of_nothing_and_unusable_vectors(spark):
    df = spark.createDataFrame([], VECTOR)
    assert vector_search.top_k(df, df).collect() == []
    rows = [(1, [1.0, 2.0]), (2, [float("nan"), 1.0]), (3, [float("inf"), 1.0]), (4, [None, 1.0]), (5, None)]
    df = spark.createDataFrame(rows, "vec_id bigint, e array<float>")
    assert [r.vec_id for r in df.where(vector_search.usable(df["e"])).collect()] == [1]


PAGE = "page_id bigint, url string, html string, text string, hash string"


def page(i, body, host="a.example"):
    html = (
        f"<html><head><title>t{i}</title><style>p{{}}</style></head><body><nav><a>Home</a> | News</nav>"
        f"<div>Made by the house</div><!-- x -->{body}<footer>&copy; 20{i}</footer></body></html>"
    )
    return (i, f"https://{host}/p/{i}", html, "x", "y")


def test_templates_and_marked_elements_go(spark):
    rows = [page(i, f"<article><h1>Head {i}</h1><p>One &amp; two<br>three {i}<p>Same for all</article>") for i in range(8)]
    rows += [page(20 + i, f"<div>Only {i}<script>var a='</p>';</script> here</div>") for i in range(6)]
    rows += [
        (30, None, "<p>No host<p>kept</p>", "", ""), (31, "http://b.example/", None, "", ""), (32, "http://b.example/", "", "", ""),
        (33, "http://b.example/x", "<body><form>f</form><div class='side-bar sidebar'>s</div><main>M<!-- cut", "", ""),
        (34, "http://b.example/y", "plain &lt;text&gt; <b", "", ""), (None, "http://b.example/z", "<aside>x</aside>", "", ""),
        (35, "http://b.example/w", "<article>a<section class=comments><p>c</p></section> b</article>", "", ""),
        (36, "http://b.example/v", "<ul><li>1<li>2</ul>" + "<div>" * 3000 + "deep", "", ""), (36, "http://b.example/v", "1 < 2 &am 3", "", ""),
    ]
    found = [(r.page_id, r.text, r.n_chars) for r in html_text.extract(spark.createDataFrame(rows, PAGE)).collect()]
    text = {i: t for i, t, _ in found if i != 36}
    assert len(found) == len(rows) and all(n == len(t) for _, t, n in found)
    for i in range(8):
        assert text[i] == f"Head {i}\nOne & two three {i}\nSame for all"
    for i in range(6):
        assert text[20 + i] == f"Only {i} here"
    assert (text[30], text[31], text[32], text[33]) == ("No host\nkept", "", "", "M")
    assert (text[34], text[None], text[35]) == ("plain <text>", "", "a\nb")
    assert sorted(t for i, t, _ in found if i == 36) == ["1\n2\ndeep", "1 < 2 &am 3"]


def test_no_pages(spark):
    assert html_text.extract(spark.createDataFrame([], PAGE)).collect() == []


RECORD = "record_id bigint, url string, captured timestamp, kind string, headers map<string,string>, digest string, state string"


def at(hour):
    return datetime(2024, 1, 1, hour, tzinfo=timezone.utc)


def test_canonical_urls(spark):
    same = ["http://WWW.A.com:80/x/?b=2&a=1&utm_source=q#f", "https://u:p@a.com/x?a=1&b=2", " http://a.com:443/x/?a=1&b=2&ref=z "]
    rows = [(u,) for u in [*same, "mailto:x", None, "http://a.com/", "http://a.com"]]
    df = spark.createDataFrame(rows, "u string")
    found = [r[0] for r in df.select(revisits.canonical_url(df["u"])).collect()]
    assert found == ["a.com/x?a=1&b=2"] * 3 + [None, None, "a.com", "a.com"]


def test_revisits(spark):
    u = "http://a.com/x"
    rows = [
        (1, u, at(1), "response", {"ETag": '"1"', "Content-Type": "t", "Date": "d1"}, "g1", ""),
        (2, u + "#z", at(2), "revisit", {"etag": 'W/"1"', "Date": "d2", "Content-Length": "0"}, None, ""),
        (3, u, at(3), "revisit", {"ETag": '"other"'}, None, ""),
        (4, u, at(4), "response", {"Last-Modified": "m"}, "g4", None),
        (5, u, at(5), "revisit", {"last-modified": "m", "Vary": "v"}, "else", ""),
        (6, u, at(6), "revisit", None, "g4", ""), (7, u, at(7), "revisit", {}, None, ""),
        (8, u, at(0), "revisit", {"etag": '"1"'}, None, ""), (9, None, at(9), "revisit", None, None, ""),
        (10, u, None, "revisit", {"etag": '"1"'}, None, ""), (11, u, at(8), None, None, None, ""),
        (2, u + "#z", at(2), "revisit", {"etag": 'W/"1"', "Date": "d2", "Content-Length": "0"}, None, ""),
        (12, "http://b.com", at(9), "revisit", {"etag": '"1"'}, None, ""), (None, u, at(10), "revisit", {}, "g4", ""),
    ]
    found = revisits.resolve(spark.createDataFrame(rows, RECORD)).collect()
    assert len(found) == len(rows)
    by = {r.record_id: r for r in found}
    states = {i: (r.state, r.resolved_id) for i, r in by.items()}
    assert states == {
        1: ("full", 1), 2: ("resolved", 1), 3: ("mismatch", None), 4: ("full", 4), 5: ("resolved", 4),
        6: ("resolved", 4), 7: ("unchecked", None), 8: ("orphan", None), 9: ("orphan", None),
        10: ("orphan", None), 11: ("other", None), 12: ("orphan", None), None: ("resolved", 4),
    }
    assert by[2].headers == {"etag": 'W/"1"', "content-type": "t", "date": "d2"}
    assert by[5].headers == {"last-modified": "m", "vary": "v"} and by[5].digest == "g4"
    assert by[7].headers == {}


def test_one_url_over_many_partitions(spark):
    rnd = random.Random(2)
    rows = [(i, "http://a.com", at(0).replace(minute=i % 60, hour=i // 60), rnd.choice(["revisit"] * 30 + ["response"]), {}, "g", "") for i in range(900)]
    found = sorted(revisits.resolve(spark.createDataFrame(rows, RECORD)).collect(), key=lambda r: r.record_id)
    last = None
    for r in found:
        if r.kind == "response":
            last = r.record_id
        assert r.resolved_id == last


def test_no_records(spark):
    assert revisits.resolve(spark.createDataFrame([], RECORD)).collect() == []


def test_queries_of_tables_have_sql():
    assert set(queries_tables.QUERIES) - set(queries_tables.ORACLE_SQL) == {"op10_html_text"}
