"""Article extraction on pages written for it, and a replay over the tables' pages with a reader of its own."""

from __future__ import annotations

import html
import re

import pytest

from newsloom.plans import catalog
from newsloom.sources import html_text

SF = "/root/testdata/sf0.001"
LONG = "This sentence says what happened in the town and why it matters to those who live there. " * 3
SAID = " ".join(LONG.split())


def extract(spark, *pages, **limits):
    df = spark.createDataFrame(list(enumerate(pages)), "page_id long, html string")
    return {r.page_id: r.text for r in html_text.main_text(df, **limits).collect()}


def test_articles(spark):
    links = "<ul>" + "".join(f"<li><a href=x>Another story {k}</a></li>" for k in range(4)) + "</ul>"
    pages = [
        f"<nav>{LONG}</nav><div class='sidebar'>{LONG}</div><article><h1>Head</h1><p>{LONG}{links}</article><footer>x</footer>",
        f"<div class='content'><p>{LONG}</p><p>Sign up for our newsletter</p></div><div itemprop='articleBody'><p>{LONG[:200]}</p></div>",
        f"<p>{LONG}</p><p>short</p><div>Loose text</div>", "<p>too short</p>", None, "<article>tiny</article><p>" + LONG,
        f"<main><div id='related-posts'>{LONG}</div>{LONG}<script>if (a < b) {{}}</script></main>", "<p>" + "<b>" * 3000 + "x" * 200, "",
        f"<article>{LONG}<span>a<b>b</b>c</span> 1 < 2 &amp; <!-- no -->3</article>",
    ]
    got = extract(spark, *pages)
    assert got == {0: f"Head {SAID}", 1: " ".join(LONG[:200].split()), 2: SAID, 5: SAID, 6: SAID, 7: "x" * 200, 9: f"{SAID} a b c 1 < 2 & 3"}


def test_selectors():
    s = html_text.Selectors(["div", ".one", "[id*='x']", "[data-k='v']", "[lang]", "[href^=http]", '[src$="png"]'])
    assert s.match("div", {}) == [0] and s.match("p", {"class": "two one", "id": "axb", "lang": ""}) == [1, 2, 4]
    assert s.match("a", {"href": "http://x", "src": "a.png", "data-k": "v"}) == [3, 5, 6] and s.match("a", {"class": "onely", "id": "", "data-k": "vv"}) == []
    with pytest.raises(ValueError):
        html_text.Selectors(["div > p"])


@pytest.mark.parametrize("selector", html_text.FURNITURE)
def test_every_furniture_selector_drops_its_element(selector):
    name = re.search(r"[\w-]+'|\.([\w-]+)", selector)[0].strip(".'")
    attr = "id" if selector.startswith("[id") else "class"
    value = name if selector.startswith(".") else f"a-{name}-b"
    page = f"<main><p>{LONG}</p><div {attr}='x {value}'><p>{LONG}</p></div><p>End.</p></main>"
    assert html_text.article_of(page) == (2, f"{SAID} End.")


def test_lists_of_links_are_measured_whole():
    li = "".join(f"<li><a>Another story told {k}</a></li>" for k in range(3))
    outer = f"<ul><li>{'plain words ' * 9}</li><li><ol>{li}</ol></li></ul>"
    text = html_text.article_of(f"<article>{LONG}{outer}</article>")[1]
    assert "plain words" in text and "Another story" not in text  # the outer list is mostly text, the inner one goes
    both = f"<ul><li>few</li><li><ol>{li}</ol></li></ul>"
    assert html_text.article_of(f"<article>{LONG}{both}</article>")[1] == SAID
    two = "<ul><li><a>One of only two links</a></li><li><a>Another of the two</a></li></ul>"
    assert html_text.article_of(f"<article>{LONG}{two}</article>")[1].endswith("Another of the two")
    around = f"<a></a><a>before</a><ul><li><a>One linked line of text</a></li><li><a>Another one</a></li></ul><a>after</a>"
    assert html_text.article_of(f"<article>{LONG}{around}</article>")[1].endswith("before One linked line of text Another one after")


# A reader of its own: tags by a pattern, a tree of lists, texts by recursion.
TOKEN = re.compile(r"<!--.*?-->|<!\w[^>]*>|<(script|style)\b[^>]*>.*?</\1\s*>|<(/?)([a-zA-Z][\w-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|[^<]+|<", re.S)


def tree(page):
    root = ["#", {}, []]
    path, text = [root], []

    def flush():
        said = " ".join(html.unescape("".join(text)).split())
        text.clear()
        if said:
            path[-1][2].append(said)

    for m in TOKEN.finditer(page):
        if m[0][0] != "<" or m[0] == "<":
            text.append(m[0])
            continue
        flush()
        if not m[3]:
            continue
        tag = m[3].lower()
        if m[2]:
            if any(n[0] == tag for n in path[1:]):
                while path.pop()[0] != tag:
                    pass
        elif tag not in html_text.VOID and not m[4].endswith("/"):
            if path[-1][0] == tag and tag in html_text.ENDS_ITSELF:
                path.pop()
            attrs = {a[0].lower(): a[1] or a[2] or a[3] for a in re.findall(r"([\w-]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", m[4])}
            node = [tag, attrs, []]
            path[-1][2].append(node)
            path.append(node)
    flush()
    return root


def nodes(node):
    for x in node[2]:
        if isinstance(x, list):
            yield x
            yield from nodes(x)


def texts(node):
    return [t for x in node[2] for t in ([x] if isinstance(x, str) else texts(x))]


def is_furniture(node):
    names, ident = node[1].get("class", ""), node[1].get("id", "")
    plain = set("related related-news related-posts related-items most-visited most-viewed popular sidebar widget tags tag-list breadcrumbs breadcrumb share social ads advertisement".split())
    return (
        node[0] in "script style noscript svg nav footer header aside form".split() or bool(plain & set(names.split()))
        or any(p in names for p in ("related", "most-view", "most-visit", "sidebar", "ticker")) or any(p in ident for p in ("related", "sidebar"))
    )


def is_link_list(node):
    links = [n for n in nodes(node) if n[0] == "a"]
    return node[0] in ("ul", "ol") and len(links) >= 3 and sum(len(" ".join(texts(a))) for a in links) / max(1, len(" ".join(texts(node)))) >= 0.65


def without(node, bad):
    node[2] = [x for x in node[2] if isinstance(x, str) or not bad(x)]
    for x in node[2]:
        if isinstance(x, list):
            without(x, bad)


def replayed(page):
    root = tree(page)
    without(root, is_furniture)
    without(root, is_link_list)
    has = lambda n, c: c in n[1].get("class", "").split()
    kinds = [lambda n: n[0] == "article", lambda n: n[1].get("itemprop") == "articleBody", *[lambda n, c=c: has(n, c) for c in ("article-body", "article__body", "news-body", "news-content", "content")], lambda n: n[0] == "main"]
    found = [t for k in kinds for n in nodes(root) if k(n) and len(t := " ".join(texts(n))) > 150]
    if not found:
        joined = " ".join(t for n in nodes(root) if n[0] == "p" and len(t := " ".join(texts(n))) >= 40)
        found = [joined] if len(joined) >= 150 else []
    return max(found, key=lambda t: len(t) - 500 * sum(p in t.lower() for p in html_text.PHRASES)) if found else None


def test_main_text_of_the_tables(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "html").collect()
    want = {r.page_id: text for r in pages if (text := replayed(r.html or ""))}
    assert want and {r.page_id: r.text for r in catalog.QUERIES["html_main_text"](spark, SF).collect()} == want
