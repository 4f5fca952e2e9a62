"""Main text of pages: one pass of an HTML reader over a page, in its task, with furniture matched by selectors."""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator, Sequence
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Tags of page furniture, the selectors of furniture and of places where articles stand.
DROPPED = ["script", "style", "noscript", "svg", "nav", "footer", "header", "aside", "form"]
FURNITURE = [
    ".related", ".related-news", ".related-posts", ".related-items", ".most-visited", ".most-viewed", ".popular", ".sidebar", ".widget", ".tags", ".tag-list", ".breadcrumbs",
    ".breadcrumb", ".share", ".social", ".ads", ".advertisement", "[class*='related']", "[class*='most-view']", "[class*='most-visit']", "[class*='sidebar']", "[class*='ticker']",
    "[id*='related']", "[id*='sidebar']",
]
ARTICLES = ["article", "[itemprop='articleBody']", ".article-body", ".article__body", ".news-body", ".news-content", ".content", "main"]
#: Tags without an end, and tags that end one of their own kind before them.
VOID = {"br", "img", "meta", "link", "input", "hr", "source", "wbr", "area", "base", "col", "embed", "track"}
ENDS_ITSELF = {"p", "li", "td", "th", "tr", "dt", "dd", "option"}
#: Phrases that tell page furniture inside an article.
PHRASES = ["sign up for our newsletter", "copy link", "related articles", "subscribe to"]


class Selectors:
    """A list of simple selectors (tag, .class, [attr], [attr='v'], [attr*='v'], [attr^='v'], [attr$='v']) made into look-ups by tag
    and class, and tests of single attributes; match() gives the places in the list that fit an element."""

    _ATTR = re.compile(r"\[\s*([\w-]+)\s*(?:([*^$]?=)\s*(['\"]?)(.*?)\3\s*)?\]")

    def __init__(self, selectors: Sequence[str]) -> None:
        self.tags: dict[str, list[int]] = {}
        self.classes: dict[str, list[int]] = {}
        self.attrs: list[tuple[str, str, str, int]] = []
        for k, s in enumerate(selectors):
            found = self._ATTR.fullmatch(s)
            if found:
                self.attrs.append((found[1].lower(), found[2] or "", found[4] or "", k))
            elif re.fullmatch(r"\.[\w-]+", s):
                self.classes.setdefault(s[1:], []).append(k)
            elif re.fullmatch(r"[\w-]+", s):
                self.tags.setdefault(s.lower(), []).append(k)
            else:
                raise ValueError(f"not a simple selector: {s}")

    def match(self, tag: str, given: dict[str, str]) -> list[int]:
        out = list(self.tags.get(tag, ()))
        if given:
            for name in given.get("class", "").split():
                out += self.classes.get(name, ())
            for attr, how, value, k in self.attrs:
                has = given.get(attr)
                if has is not None and (
                    not how or (how == "=" and has == value) or (value != "" and ((how == "*=" and value in has) or (how == "^=" and has.startswith(value)) or (how == "$=" and has.endswith(value))))
                ):
                    out.append(k)
        return sorted(set(out))


class _Page(HTMLParser):
    """The pieces of text of a page outside furniture, and the spans of pieces that links, lists, paragraphs and articles hold.

    Nothing is kept of an element but its span, so a page is read in one pass, in memory of its own size.
    """

    def __init__(self, furniture: Selectors, articles: Selectors) -> None:
        super().__init__()
        self.furniture, self.articles = furniture, articles
        self.open: list[tuple[str, bool, int, list[int], int]] = []  # tag, inside furniture, first piece, articles' selectors, number
        self.count: dict[str, int] = {}  # how many of a tag are open
        self.pieces: list[str] = []
        self.buffer: list[str] = []
        self.elements = 0
        self.links: list[tuple[int, int, int]] = []  # number, first piece, end
        self.lists: list[tuple[int, int, int, int]] = []  # number, the last number inside, first piece, end
        self.paragraphs: list[tuple[int, int]] = []
        self.homes: list[tuple[int, int, int]] = []  # selector, first piece, end

    def flush(self) -> None:
        text = " ".join("".join(self.buffer).split())
        self.buffer.clear()
        if text:
            self.pieces.append(text)

    def _pop(self) -> None:
        tag, bad, first, homes, number = self.open.pop()
        self.count[tag] -= 1
        if bad:
            return
        span = (first, len(self.pieces))
        if tag == "a":
            self.links.append((number, *span))
        elif tag in ("ul", "ol"):
            self.lists.append((number, self.elements, *span))
        elif tag == "p":
            self.paragraphs.append(span)
        self.homes += [(k, *span) for k in homes]

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.flush()
        if tag in VOID:
            return
        if tag in ENDS_ITSELF and self.open and self.open[-1][0] == tag:
            self._pop()
        given = {k: v or "" for k, v in attrs}
        bad = bool(self.open and self.open[-1][1]) or bool(self.furniture.match(tag, given))
        self.elements += 1
        self.open.append((tag, bad, len(self.pieces), [] if bad else self.articles.match(tag, given), self.elements))
        self.count[tag] = self.count.get(tag, 0) + 1

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.flush()

    def handle_endtag(self, tag: str) -> None:
        self.flush()
        if self.count.get(tag):
            while self.open[-1][0] != tag:
                self._pop()
            self._pop()

    def handle_comment(self, data: str) -> None:
        self.flush()

    def handle_data(self, data: str) -> None:
        if not (self.open and self.open[-1][1]):
            self.buffer.append(data)

    def read(self, page: str | None) -> _Page:
        self.feed(page or "")
        self.close()
        self.flush()
        while self.open:
            self._pop()
        return self


_FURNITURE, _ARTICLES = Selectors(DROPPED + FURNITURE), Selectors(ARTICLES)


def _kept(page: _Page, least_links: int, most_links: float) -> list[bool]:
    """Which pieces stand in no list that is mostly links, by the whole contents of each list."""
    total = [0]
    for text in page.pieces:
        total.append(total[-1] + len(text))
    chars = lambda first, end: total[end] - total[first] + max(end - first - 1, 0)
    links = sorted(page.links)
    linked = [0]
    for _, first, end in links:
        linked.append(linked[-1] + chars(first, end))
    kept = [True] * len(page.pieces)
    for number, last, first, end in page.lists:
        a, b = bisect_left(links, (number,)), bisect_right(links, (last + 1,))
        if b - a >= least_links and (linked[b] - linked[a]) / max(1, chars(first, end)) >= most_links:
            kept[first:end] = [False] * (end - first)
    return kept


def article_of(
    page: str | None, least: int = 40, most_links: float = 0.65, shortest: int = 150, phrases: Sequence[str] = PHRASES, penalty: int = 500, furniture: Selectors = _FURNITURE, articles: Selectors = _ARTICLES
) -> tuple[int, str] | None:
    """(pieces, text) of the best candidate for a page's article, None without one; see main_text."""
    read = _Page(furniture, articles).read(page)
    kept = _kept(read, 3, most_links)
    said = lambda first, end: [t for t, k in zip(read.pieces[first:end], kept[first:end], strict=True) if k]
    spans = dict.fromkeys((first, end) for _, first, end in sorted(read.homes))  # elements of the same pieces are one candidate
    found = [(len(x), text) for x in (said(*s) for s in spans) if len(text := " ".join(x)) > shortest]
    if not found:
        texts = [" ".join(said(*s)) for s in sorted(read.paragraphs)]
        whole = [t for t in texts if len(t) >= least]
        found = [(len(whole), text)] if len(text := " ".join(whole)) >= shortest else []
    score = lambda x: len(x[1]) - penalty * sum(p in x[1].lower() for p in phrases)
    return max(found, key=score) if found else None


def main_text(pages: DataFrame, id_column: str = "page_id", html: str = "html", furniture: Sequence[str] = (*DROPPED, *FURNITURE), articles: Sequence[str] = ARTICLES, **limits: float | Sequence[str]) -> DataFrame:
    """(id, blocks, text): the best candidate for a page's article; pages without one (null and empty ones too) have no row.

    Elements that a furniture selector fits are left out with all they hold, as are lists of three links and more whose texts are
    `most_links` of the list's. Every element that an article selector fits is a candidate if its text is longer than `shortest`;
    without one, the paragraphs of at least `least` characters together are. Pieces of text between tags are joined by one space;
    blocks counts them (paragraphs in the second case). A candidate's score is its length less `penalty` for each phrase of page
    furniture in it; the best stays, of equals the first by its selector's place, then the page's order. A page is read once, in
    its task, and only its article leaves it. limits: least, most_links, shortest, phrases, penalty.
    """
    bad, good = Selectors(furniture), Selectors(articles)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = [(i, article_of(page, furniture=bad, articles=good, **limits)) for i, page in pdf.itertuples(index=False)]
            yield pd.DataFrame([(i, *x) for i, x in found if x is not None], columns=["id", "blocks", "text"])

    rows = pages.select(F.col(id_column).alias("id"), F.col(html).alias("html"))
    return rows.mapInPandas(run, "id long, blocks int, text string").withColumnRenamed("id", id_column)
