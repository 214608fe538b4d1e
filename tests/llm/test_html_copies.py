from __future__ import annotations

from weir.llm import html_text

PAGE = "page_id bigint, url string, html string"


def texts(spark, htmls, host="a.example"):
    rows = [(i, f"https://{host}/{i}", h) for i, h in enumerate(htmls)]
    found = html_text.extract(spark.createDataFrame(rows, PAGE)).collect()
    assert len(found) == len(rows)
    return [r.text for r in sorted(found, key=lambda r: r.page_id)]


BODY = "<section><h2>One</h2><p>first part of it</section><section><h2>Two</h2><p>second part of it</section>"
WANT = "One\nfirst part of it\nTwo\nsecond part of it"


def test_copies_keep_their_text(spark):
    others = [f"<div>Made by us</div><nav>m{i}</nav><div>Other page {i}, with text of its own</div>" for i in range(5)]
    same = [f"<div>Made by us</div><article>{BODY}</article>"] * 6 + [f"<div>{BODY}</div>"] * 5
    assert texts(spark, same + others) == [WANT] * 11 + [f"Other page {i}, with text of its own" for i in range(5)]


def test_equal_articles_between_other_menus(spark):
    wrapped = "<nav>menu {0}</nav><div id=wrap><article>" + BODY + "</article></div><footer>foot {0}</footer>"
    bare = "<nav>menu {0}</nav>" + BODY + "<footer>foot {0}</footer>"
    for form in (wrapped, bare):
        assert texts(spark, [form.format(i) for i in range(7)]) == [WANT] * 7


def test_boxes_that_recur_inside_articles_go(spark):
    box = "<div class=x><h3>Letters</h3><p>Get our letters each week</p></div>"
    page = "<main><article><h1>Head {0}</h1><p>Long text of page {0} and more of it</p>" + box + "<p>End</p></article></main>"
    want = [f"Head {i}\nLong text of page {i} and more of it\nEnd" for i in range(6)]
    assert texts(spark, [page.format(i) for i in range(6)]) == want
    once = texts(spark, [page.format(1)])
    assert once == ["Head 1\nLong text of page 1 and more of it\nLetters\nGet our letters each week\nEnd"]


def test_zone_by_amount_of_text(spark):
    teaser = "<article>Teaser</article>"
    inside = f"<main><p>The content of this page, at some length</p>{teaser}</main>"
    beside = f"<div>The content of this page, at some length</div>{teaser}"
    found = texts(spark, [inside, beside, "<div>Chrome</div><article>The content</article>"])
    assert found == ["The content of this page, at some length\nTeaser"] * 2 + ["The content"]


def test_marks_do_not_empty_pages(spark):
    body = "<h1 class='entry-header'>Head</h1><p>Some text of the page</p><section id='related-work'><p>Related</p></section>"
    want = "Head\nSome text of the page\nRelated"
    article, plain = f"<article>{body}</article>", f"<div>{body}</div>"
    names = ["content with-sidebar", "has-comments", "page-header", "search-result", "share-enabled", "no-sidebar", "sidebar", "widget"]
    pages = [f"<div class='{name}'>{inner}</div><footer>f</footer>" for name in names for inner in (article, plain)]
    pages += [f"<form action=x>{inner}<div class=sidebar>s</div></form>" for inner in (article, plain)]
    assert texts(spark, pages) == [want] * len(pages)
    unclosed = [f"<body><{tag}><a>Home</a>{article}</body>" for tag in ("nav", "aside", "form", "div class=menu")]
    assert texts(spark, unclosed) == [want] * 4
    assert texts(spark, [f"<body><div><nav><a>Home</a>{plain}</div>"]) == ["Home\n" + want]


def test_marks_that_hold(spark):
    comments = "<div class=comments><article>First, a long comment on it</article></div>"
    marked = "<div class='cookie-banner'>c</div><div id=sidebar>s</div><aside>a long aside, longer than the text</aside>"
    assert texts(spark, [f"{marked}<article>The text</article>{comments}", f"{marked}<p>Nothing else but text, which is the most</p>"]) == [
        "The text", "Nothing else but text, which is the most",
    ]
    inside = "<main><p>The text of it</p><section class=comments><article>{}</article></section></main>"
    assert texts(spark, [inside.format("A comment"), inside.format("A comment longer than the text")]) == [
        "The text of it", "The text of it\nA comment longer than the text",
    ]


def test_unrelated_pages_change_nothing(spark):
    section = ["<div>Notice of this section</div><div>Content of page %d, some more of it</div>" % i for i in range(5)]
    other = ["<div>Elsewhere %d</div><div>Text number %d of another kind</div>" % (i, i) for i in range(400)]
    want = ["Content of page %d, some more of it" % i for i in range(5)]
    assert texts(spark, section) == want
    assert texts(spark, section + other)[:5] == want


def test_unclosed_raw_elements_cut_nothing(spark):
    tags = ["svg", "math", "object", "template", "noscript", "iframe", "select><option>a<option"]
    pages = [f"<body><div><{tag}></div><article>The text</article>" for tag in tags]
    pages += ["<svg><article>The text</article><svg><title>t</title></svg>", "<svg><svg></svg>in it</svg><article>The text</article>"]
    assert texts(spark, pages) == ["The text"] * len(pages)
    assert texts(spark, ["<p>Before<script>x<article>The text</article>"]) == ["Before"]
