"""Main text of web pages by removing what a site repeats.

Each page is read into blocks of text and a hash per element subtree. Spark counts in how
many different elements of its host's pages every subtree occurs; subtrees that recur at least
``LEAST_PAGES`` are the site's template and go, so other pages of a host change no result. A page under several urls, or an article with other menus
around it, has its parts in equal elements, which count once. A subtree that holds the article
(or main) or most of a page's text never goes, and templates alone leave no page without text. Elements whose tag, class or role says that they are no content
(menus, adverts, forms, comments ...) go as well, for sites with too few pages to count. Such a
mark does not hold for an element that is never closed, that has the page's only article or main
inside, or that has most of the page's text and is marked by class, id, role or as a form.
What is left of the article elements is the text if it is at least half of what is left of
main and articles, else both; and if that is less than a quarter of all that is left, all is.
Inside articles boxes are counted too (div, section, list ...), but not single paragraphs: they
are content on every page.

Definite results: null or empty html gives an empty text; so does a page without text. Pages
without a host have no site to compare with and keep all but the marked elements. Tags that
never close end with their parent (svg, object and the like are passed over, a script, style,
textarea or title takes the rest), a tag or comment cut off at the end is dropped. Repeated
rows keep their rows and count once; other columns are ignored.
"""

from __future__ import annotations

import re
from html import unescape

import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weir.llm.common import map_rows, saved

# A subtree is template from this many places on its host on, however large the host is.
LEAST_PAGES = 4

# Elements of HTML by what they mean here.
BLOCKS = set(
    "html body div section article main nav header footer aside form fieldset ul ol li dl dt dd "
    "table thead tbody tfoot tr td th caption p h1 h2 h3 h4 h5 h6 hgroup blockquote pre figure "
    "figcaption details summary address hr center dialog menu".split()
)
RAW = set("script style noscript template textarea title svg math iframe object select head".split())
# Those of RAW that swallow all that follows when they are never closed, as in browsers.
SWALLOWS = {"script", "style", "textarea", "title"}
OPTIONS = re.compile(r"(?:\s*</?opt(?:ion|group)\b[^>]*>[^<]*)*", re.I)
VOID = set("area base br col embed hr img input link meta source track wbr".split())
NO_CONTENT = set("nav footer aside form menu dialog button label fieldset".split())
FORMS = {"form", "fieldset"}
NEVER_MARKED = set("html body article main h1 h2 h3 h4 h5 h6".split())
MAY_STAY_OPEN = set("p li dt dd tr td th thead tbody tfoot caption".split())
PARAGRAPH_ENDS = BLOCKS - {"html", "body"}
SAME_LEVEL = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"table", "tr"}),
    "th": ({"td", "th"}, {"table", "tr"}),
}
# Words in class, id or role attributes that mark something beside the content.
MARKS = set(
    "ad ads advert advertisement adverts banner sponsor sponsored promo promotion nav navbar "
    "navigation menu breadcrumb breadcrumbs sidebar footer header masthead cookie cookies consent "
    "notice notices gdpr popup modal overlay newsletter subscribe subscription signup share sharing "
    "social related recommended comment comments disqus respond reply replies widget toolbar "
    "pagination pager search login skip complementary contentinfo alert dialog".split()
)
MARKED = re.compile(r"""\b(?:class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
TAG = re.compile(
    r"""<(?:(!--)|(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)>|[!?/][^>]*>)""", re.S
)
LOOSE = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*)>", re.S)
CUT_OFF = re.compile(r"<[/!?a-zA-Z][^>]*\Z", re.S)
SPACE = re.compile(r"[\s\x1c-\x1f]+")
OTHER, MAIN, ARTICLE = 0, 1, 2
ZONES = {"main": MAIN, "article": ARTICLE}
NOT, BY_WORD, BY_TAG = 0, 1, 2
# Single values of tables: equal ones say nothing.
CELLS = {"td", "th", "dd"}
# Subtrees that are looked at inside an article, where single paragraphs are content.
BOXES = set(
    "div section header footer nav aside form fieldset ul ol dl table figure details dialog menu "
    "center".split()
)
# An article is taken for the text from this share of the text of main and articles on, main and
# articles from that share of all text.
ARTICLE_SHARE, MAIN_SHARE = 0.5, 0.25


def marked(tag: str, attributes: str) -> int:
    """How tag or attributes say that an element is no content: BY_TAG, BY_WORD or NOT."""
    if tag in NO_CONTENT:
        return BY_WORD if tag in FORMS else BY_TAG
    if tag in NEVER_MARKED:
        return NOT
    for found in MARKED.finditer(attributes):
        for name in found[1].lower().strip("\"'").split():
            # All words of a name have to be marks: "with-sidebar" says nothing of the element.
            if MARKS.issuperset(w for w in re.split("[_-]+", name) if w):
                return BY_WORD
    return NOT


def ends_of(tag: str, html: str) -> dict[int, int]:
    """Where the elements of this tag start and end; those that are never closed are left out."""
    found, begun = {}, []
    for m in re.finditer(rf"<(/?){tag}(?=[\s/>])(?:[^>\"']|\"[^\"]*\"|'[^']*')*>", html, re.I):
        if not m[1]:
            if not m[0].endswith("/>"):
                begun.append(m.start())
        elif begun:
            found[begun.pop()] = m.end()
    return found


class Element:
    """An element of a page: where its blocks lie and what its hash is made of."""

    __slots__ = ("number", "tag", "parent", "zone", "mark", "off", "first", "end", "parts", "digest", "holds")

    def __init__(self, number: int, tag: str, parent: int, zone: int, mark: int, first: int):
        self.number, self.tag, self.parent = number, tag, parent
        self.zone, self.mark, self.first = zone, mark, first
        self.off, self.end, self.digest, self.holds = False, first, 0, OTHER
        # Own texts, and the numbers of the elements inside.
        self.parts: list[str | int] = [tag]


class Page:
    """Blocks of text with their zones, and the hashed subtrees that cover them.

    ``nodes`` has the subtrees that may be template: digest, digest of the element around it,
    first block and the block after the last. Marked elements take no part in digests.
    """

    def __init__(self, html: str):
        self.blocks: list[tuple[str, int, bool]] = []
        self.nodes: list[tuple[int, int, int, int]] = []
        self.elements: list[Element] = []
        self.open: list[Element] = []
        self.text: list[str] = []
        self.push("", "")
        self.read(html)
        while self.open:
            self.pop()
        self.settle()

    def push(self, tag: str, attributes: str) -> None:
        self.end_block()
        n, above = len(self.elements), self.open[-1] if self.open else None
        zone = above.zone if above else OTHER
        mark = marked(tag, attributes)
        if tag == "header" and zone == OTHER:
            mark = BY_WORD
        zone = max(zone, ZONES.get(tag, OTHER))
        parent = -1
        if above:
            parent = above.number
            above.parts.append(n)
        new = Element(n, tag, parent, zone, mark, len(self.blocks))
        self.elements.append(new)
        self.open.append(new)

    def pop(self, closed: bool = False) -> None:
        self.end_block()
        last = self.open.pop()
        last.end = len(self.blocks)
        if not closed and last.tag not in MAY_STAY_OPEN:
            # It has taken in what follows it, so its mark says nothing.
            last.mark = NOT

    def end_block(self) -> None:
        if self.text:
            found = SPACE.sub(" ", unescape("".join(self.text))).strip()
            self.text.clear()
            if found:
                inner = self.open[-1]
                inner.parts.append(found)
                self.blocks.append((found, inner.zone, inner.number))

    def settle(self) -> None:
        """Settle which marks hold, hash the elements from the inside out, list possible template."""
        upto = [0]
        for text, _, _ in self.blocks:
            upto.append(upto[-1] + len(text))
        for e in reversed(self.elements):
            inside = (self.elements[x].holds for x in e.parts if isinstance(x, int))
            e.holds = max(inside, default=OTHER)
            if e.first < e.end:
                e.holds = max(e.holds, ZONES.get(e.tag, OTHER))
        self.spread()
        zones = [zone for _, zone, _ in self.blocks]
        alone = all(z == OTHER or self.elements[n].off for z, (_, _, n) in zip(zones, self.blocks))
        for e in self.elements:
            if e.mark == BY_WORD and 2 * (upto[e.end] - upto[e.first]) > upto[-1]:
                e.mark = NOT
                if e.zone:
                    # Articles inside are as much content as what is around it, not more.
                    zones[e.first : e.end] = [min(z, e.zone) for z in zones[e.first : e.end]]
            elif e.mark and e.holds and alone:
                e.mark = NOT
        self.spread()
        self.blocks = [(text, z, self.elements[n].off) for (text, _, n), z in zip(self.blocks, zones)]
        for e in reversed(self.elements):
            parts = [x if isinstance(x, str) else str(self.elements[x].digest)
                     for x in e.parts if isinstance(x, str) or not self.elements[x].off]
            e.digest = xxhash.xxh64_intdigest("\x00".join(parts)) - (1 << 63)
        for e in self.elements[1:]:
            size = upto[e.end] - upto[e.first]
            cell = e.tag in CELLS and e.first + 1 == e.end
            counted = e.tag in BOXES or (e.zone != ARTICLE and not cell)
            if size and counted and not e.off and not e.holds and 2 * size <= upto[-1]:
                self.nodes.append((e.digest, self.elements[e.parent].digest, e.first, e.end))

    def spread(self) -> None:
        """What lies in a marked element is off."""
        for e in self.elements:
            e.off = e.mark != NOT or (e.parent >= 0 and self.elements[e.parent].off)

    def hashes(self) -> list[tuple[int, int]]:
        """The digests of ``nodes``, each once, with the least digest of an element around it."""
        found: dict[int, int] = {}
        for digest, around, _, _ in self.nodes:
            found[digest] = min(around, found.get(digest, around))
        return sorted(found.items())

    def close(self, names: set[str], within: set[str], closed: bool = False) -> None:
        """Close up to the innermost element of these names, not reaching past ``within``."""
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag in names:
                while len(self.open) > i + 1:
                    self.pop()
                self.pop(closed)
                return
            if self.open[i].tag in within:
                return

    def read(self, html: str) -> None:
        at, n = 0, len(html)
        ends: dict[str, dict[int, int]] = {}
        while at < n:
            start = html.find("<", at)
            if start < 0:
                self.text.append(html[at:])
                return
            if start > at:
                self.text.append(html[at:start])
            found = TAG.match(html, start)
            if found is None:
                found = LOOSE.match(html, start)
                if found is None:
                    if CUT_OFF.match(html, start):
                        return
                    self.text.append("<")
                    at = start + 1
                    continue
                closing, name, attributes = found.groups()
            elif found[1]:
                end = html.find("-->", start + 2)
                at = n if end < 0 else end + 3
                continue
            else:
                _, closing, name, attributes = found.groups()
            at = found.end()
            if name is None:
                continue
            tag = name.lower()
            if tag == "br":
                self.text.append(" ")
            elif tag in RAW and not closing:
                if not attributes.endswith("/"):
                    if tag in SWALLOWS or tag == "head":
                        end = re.compile(rf"</{tag}\s*[^>]*>", re.I).search(html, at)
                        if end:
                            at = end.end()
                        elif tag != "head":
                            return
                    else:
                        if tag not in ends:
                            ends[tag] = ends_of(tag, html)
                        # Without an end only the tag is skipped, and the options of a select.
                        if start in ends[tag]:
                            at = ends[tag][start]
                        elif tag == "select":
                            at = OPTIONS.match(html, at).end()
            elif tag in VOID - {"hr"} or tag not in BLOCKS | NO_CONTENT:
                continue
            elif closing:
                if tag == "p" or tag in BLOCKS | NO_CONTENT:
                    self.end_block()
                    self.close({tag}, {"article", "body", "td"} - {tag} if tag == "p" else set(), True)
            else:
                if tag in PARAGRAPH_ENDS:
                    self.close({"p"}, {"article", "section", "div", "td", "li", "blockquote"})
                if tag in SAME_LEVEL:
                    self.close(*SAME_LEVEL[tag])
                if tag == "hr":
                    self.end_block()
                else:
                    self.push(tag, attributes)


def main_text(page: Page, template: set[int]) -> str:
    """The blocks of a page outside template subtrees and marked elements."""
    gone = [off for _, _, off in page.blocks]
    for digest, _, first, end in page.nodes:
        if digest in template:
            gone[first:end] = [True] * (end - first)
    if all(gone):
        # Templates alone leave no page without text.
        gone = [off for _, _, off in page.blocks]
    left = [(text, zone) for (text, zone, _), off in zip(page.blocks, gone) if not off]
    sizes = [sum(len(text) for text, zone in left if zone >= least) for least in (OTHER, MAIN, ARTICLE)]
    best = ARTICLE if sizes[ARTICLE] and sizes[ARTICLE] >= ARTICLE_SHARE * sizes[MAIN] else MAIN
    if not sizes[best] or sizes[best] < MAIN_SHARE * sizes[OTHER]:
        best = OTHER
    return "\n".join(text for text, zone in left if zone >= best)


def host_of(url_col: str):
    """Host of a url in lower case, without user, port and a leading www; null without one."""
    host = F.regexp_extract(F.lower(F.col(url_col)), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)
    return F.when(host != "", F.regexp_replace(host, r"^www\.", ""))


def extract(
    df: DataFrame,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
    least_pages: int = LEAST_PAGES,
) -> DataFrame:
    """(id, url, text, n_chars) of every page."""
    kinds = dict(df.dtypes)
    key = F.xxhash64(html_col)

    def start():
        def parse(rows):
            # The hashes of a page, each once; its text is read again when it is wanted.
            return [
                (row_id, k, host, [{"hash": h, "around": a} for h, a in Page(html or "").hashes()])
                for row_id, k, host, html in rows
            ]

        return parse

    pages = df.select(
        F.col(id_col).alias("__id"), key.alias("__key"), host_of(url_col).alias("__host"), html_col
    )
    nodes = saved(
        map_rows(
            pages.where(F.col("__host").isNotNull()),
            f"__id {kinds[id_col]}, __key bigint, __host string, __hashes array<struct<hash:bigint,around:bigint>>",
            start,
        ),
        "page-nodes",
    )
    seen = nodes.select("__id", "__key", "__host", F.inline("__hashes"))
    # Copies of a page have the same element around a subtree, so they count once.
    places = seen.select("__host", "hash", "around").distinct()
    counts = places.groupBy("__host", "hash").agg(F.count(F.lit(1)).alias("n"))
    template = saved(counts.where(F.col("n") >= least_pages).select("__host", "hash"), "page-template")
    hit = seen.join(template, ["__host", "hash"]).groupBy("__id", "__key", "__host").agg(
        F.collect_set("hash").alias("__template")
    )

    def finish():
        def text(rows):
            out = []
            for row_id, url, html, template in rows:
                found = main_text(Page(html or ""), set(template or ()))
                out.append((row_id, url, found, len(found)))
            return out

        return text

    same = F.col(id_col).eqNullSafe(F.col("__id")) & (key == F.col("__key"))
    same &= host_of(url_col) == F.col("__host")
    joined = df.select(id_col, url_col, html_col).join(
        hit.select("__id", "__key", "__host", "__template"), same, "left"
    )
    return map_rows(
        joined.select(id_col, url_col, html_col, "__template"),
        f"{id_col} {kinds[id_col]}, {url_col} {kinds[url_col]}, text string, n_chars bigint",
        finish,
    )
