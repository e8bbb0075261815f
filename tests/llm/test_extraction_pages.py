"""Extraction against the article that a plain parser of the standard library finds, and odd pages."""

import html
import re
import time
from html.parser import HTMLParser

import pytest

from tabulith.llm import extraction
from tests.conftest import SMALL

AWAY = {"nav", "footer", "aside", "form", "script", "style", "noscript", "button", "title", "head", "iframe", "svg", "select", "textarea"}
WORDS = re.compile(r"\b(ad|ads|advert|advertisement|banner|comments?|cookie|menu|newsletter|notice|promo|related|share|sidebar|sponsored|subscribe|breadcrumbs?)\b")
INLINE = {"a", "b", "i", "em", "strong", "span", "code", "u", "small", "sub", "sup", "abbr", "cite", "q", "mark", "time", "img", "font", "wbr", "input"}
VOID = {"br", "hr", "img", "input", "meta", "link", "wbr", "source"}


class Article(HTMLParser):
    """The text below <article>, without elements that are not its text; blocks are set apart."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack, self.blocks, self.now = [], [], []

    def flush(self):
        text = re.sub(r"\s+", " ", "".join(self.now)).strip()
        self.blocks += [text] if text else []
        self.now = []

    def handle_starttag(self, tag, attrs):
        if tag not in INLINE:
            self.flush()
        if tag in VOID:
            return
        said = " ".join(v or "" for k, v in attrs if k in ("class", "id", "role")).lower()
        if tag == "p" and self.stack and self.stack[-1][0] == "p":
            self.stack.pop()
        self.stack.append((tag, tag in AWAY or any(k == "hidden" for k, _ in attrs) or bool(tag != "article" and WORDS.search(said.replace("-", " ").replace("_", " ")))))

    def handle_endtag(self, tag):
        if tag not in INLINE:
            self.flush()
        if tag in [t for t, _ in self.stack]:
            while self.stack.pop()[0] != tag:
                pass

    def handle_data(self, data):
        if any(t in ("article", "main") for t, _ in self.stack) and not any(away for _, away in self.stack):
            self.now.append(data)


def article(page):
    p = Article()
    p.feed(page)
    p.close()
    p.flush()
    return " ".join(p.blocks)


@pytest.mark.parametrize("top", [SMALL, SMALL.replace("0.001", "0.01")])
def test_every_page(spark, top):
    rows = spark.read.parquet(f"{top}/pages.parquet").collect()
    got = {r.page_id: r for r in extraction.extract_pages(spark.read.parquet(f"{top}/pages.parquet")).collect()}
    assert len(got) == len(rows)
    for r in rows:
        assert got[r.page_id].text == article(r.html), r.page_id
        assert (got[r.page_id].url, got[r.page_id].n_chars) == (r.url, len(got[r.page_id].text))


LONG = "It is the text of this and that, which was written for the reader who has the time to see all of it as it is. " * 2


def test_quotes():
    for bad, want in (
        ('<b title="x>bold</b> and more', "bold and more"), ("<b title='x>bold</b> and it's more", "bold and it's more"), ('<b title="a > b">bold</b>', "bold"), ("<b don't>bold</b>", "bold"),
        ('<b data-x="<i>t</i>" y>bold</b>', "bold"), ("a < b and 1<2", "a < b and 1<2"), ("<!-- <p> -->bold", "bold"), ('<b x = "y>z" >bold</b>', "bold"), ("<b/>bold", "bold"), ("x <b", "x"),
    ):
        assert extraction.extract(f'<article><p class="a">{LONG}</p><p>{bad}</p></article>'.replace("x <b</p></article>", "x <b")) == f"{html.unescape(LONG.strip())} {want}", bad


def test_time_grows_with_the_page():
    for page in ("<a " * 350_000, "<a ='" * 200_000, "<div>" * 100_000 + "</p>" * 100_000, "<b hidden><i hidden>" * 40_000 + "</u>" * 50_000, "<script " * 100_000, "<!--" * 200_000, '<x ="' + "y" * 900_000):
        at = time.perf_counter()
        extraction.extract(page)
        assert time.perf_counter() - at < 5


def test_nearest_neighbour_decides():
    links = "<p><a href='/x'>one link after the other stands in this block of the page</a></p>"
    between = f"<article><p>{LONG}</p><p>near the text</p><p>near links</p>{links}</article>"
    assert extraction.extract(between).endswith("near the text")  # the second short block is nearer to the links
    assert extraction.extract(f"<article><p>{LONG}</p><p>half way</p>{links}</article>").endswith("half way")
    assert extraction.extract("<article><p>alone</p></article>") == "alone"


def test_odd(spark):
    long = "<article>" + f"<p>{LONG}</p>" * 5000 + "</article>"
    rows = [(1, "u", long), (1, "u", long), (None, None, "<p>x</p>"), (2, "v", "<p>&lt;&#233;&nbsp;&amp;</p>" * 3), (3, "w", "  "), (4, "x", "<nav>a</nav>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 AS text", "2 AS n_chars", "3 AS tag")
    got = extraction.extract_pages(df).collect()
    assert len(got) == 6 and [r.n_chars for r in got if r.page_id == 1] == [len(" ".join([LONG.strip()] * 5000))] * 2
    assert {r.page_id: r.text for r in got if r.page_id in (3, 4)} == {3: "", 4: ""}
    assert extraction.extract_pages(df.limit(0)).count() == 0
