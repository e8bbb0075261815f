"""Main-text extraction from HTML by two-pass block rules.

The page is cut into blocks at block-level tags. Pass one classifies each block by length, share
of its characters inside links, and stop-word density: long prose is content; blocks that are
mostly links, or that stand in a boilerplate region of the page (navigation, header outside the
article, footer, sidebar, form, advert, notice, comments), are not; short or unclear blocks stay
ambiguous. Pass two gives each ambiguous block the label of its nearest decided neighbours of
the same region: where both sides agree that one, else the nearer's, and content at equal distance.

Where a page marks its article (<article> or <main>), only blocks inside it are looked at, and
ambiguous ones that have no decided neighbour count as content; without such a mark the whole
body is searched.

Tags are read as browsers read them, in one pass: time grows with a page's length, whatever is in
it. An attribute's quote that no fitting quote closes (none follows, or what follows it cannot
follow a value) ends at the tag's first ">"; a tag that never ends swallows the rest of the page.

Defined results: null, empty or mark-up-only html gives empty text; text outside any tag is a
block; unclosed tags end with their parent; pages of any length are read whole; blocks at equal
distance decide as above; repeated rows each give a row; an empty table gives an empty result;
other columns are never read, so their names cannot clash.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulith.llm.common import lean

# Tags by role.
RAW = ("script", "style", "noscript", "template", "iframe", "svg", "math", "object", "textarea", "select", "title", "canvas", "video", "audio")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body br button caption center dd details dialog div dl dt fieldset figcaption figure footer "
    "form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
AWAY = frozenset("nav footer aside form head menu dialog button".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Words of a class, id or role that mark a region as boilerplate.
AWAY_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies copyright disclaimer disqus footer "
    "gdpr header masthead menu modal nav navbar navigation newsletter notice notices pager pagination paywall popup promo promoted "
    "related respond reply replies search share sharing sidebar signup social sponsor sponsored subscribe toolbar widget".split()
)
#: Stop words of English, French, German and Spanish.
STOP = frozenset(
    "a an and are as at be but by for from has he in is it its of on or not she that the their they this to was were which will with you "
    "au aux avec ce ces dans de des du elle en est et eux il je la le les leur lui mais ne nous ou par pas pour que qui sa se ses son sur un une vous "
    "als am auf aus bei das dem den der des die durch ein eine einen einer er es für hat ich im ist mit nicht noch oder sich sie sind so und über um vom von war wie zu zum zur "
    "al como con del el ella entre era esta este fue ha hay lo los las más muy no o para pero por su sus también una uno y".split()
)
RAW_SET = frozenset(RAW)
RAW_END = {tag: re.compile(rf"</{tag}(?=[\s/>])[^>]*>", re.I) for tag in RAW}
NAME = re.compile(r"/?[a-zA-Z][^\s/>]*")
STOPS = re.compile(r"[>\"']")
#: One attribute with its value, or a quoted string that belongs to none.
ATTR = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?|"[^"]*"|'[^']*'""")
AFTER_VALUE = " \t\n\f\r/>"
SPLIT = re.compile(r"[^a-z]+")
WHITE = re.compile(r"\s+")

LONG, SHORT = 140, 40
MOST_LINKS, SOME_LINKS = 0.5, 0.2
STOP_HIGH, STOP_LOW = 0.30, 0.05


class Block:
    __slots__ = ("text", "links", "away", "inside", "heading", "label")

    def __init__(self, text: str, links: int, away: bool, inside: bool, heading: bool):
        self.text, self.links, self.away, self.inside, self.heading, self.label = text, links, away, inside, heading, None


def tokens(page: str) -> Iterator[tuple[str, bool, str, int, int]]:
    """Tags as (name in small letters, whether it ends, attributes, first place, place after it); comments,
    declarations and elements that are not text have no name. Every character is looked at a fixed number of times."""
    at, last = 0, {q: page.rfind(q) for q in "\"'>"}
    while (at := page.find("<", at)) >= 0:
        start, m = at, NAME.match(page, at + 1)
        if not m:
            if page.startswith("<!--", at):
                end = page.find("-->", at + 4)
                at = end + 3 if end >= 0 else len(page)
            elif page[at + 1 : at + 2] in ("!", "?", "/"):
                end = page.find(">", at)
                at = end + 1 if end >= 0 else len(page)
            else:
                at += 1  # a sign in the text
                continue
            yield "", False, "", start, at
            continue
        end = tag_end(page, m.end(), last)
        name, attr, at = m[0].lower(), page[m.end() : end], min(len(page), end + 1)
        if name in RAW_SET:
            close = RAW_END[name].search(page, at)
            at = close.end() if close else len(page)
            yield "", False, "", start, at
        else:
            yield name.removeprefix("/"), name[0] == "/", attr, start, at


def tag_end(page: str, at: int, last: dict[str, int]) -> int:
    """The place of the ">" that ends a tag, or the page's end; `last` has the last place of each sign."""
    while at <= last[">"] and (m := STOPS.search(page, at)):
        k, sign = m.start(), m[0]
        if sign == ">":
            return k
        at = k + 1
        if page[max(0, k - 64) : k].rstrip()[-1:] != "=":
            continue  # a quote counts only where a value begins
        close = page.find(sign, at) if at <= last[sign] else -1
        if close < 0 or page[close + 1 : close + 2] not in AFTER_VALUE:
            end = page.find(">", at)
            return end if end >= 0 else len(page)
        at = close + 1
    return len(page)


def marked_away(tag: str, attr: str, inside: bool) -> bool:
    if tag in AWAY or tag == "header" and not inside:
        return True
    if tag in ("article", "main", "body", "html") or not attr:
        return False
    for name, a, b, c in ATTR.findall(attr):
        value = (a or b or c).lower()
        if name.lower() == "hidden" or name.lower() == "aria-hidden" and value == "true":
            return True
        if name.lower() in ("class", "id", "role") and any(w in AWAY_WORDS for w in SPLIT.split(value)):
            return True
    return False


def blocks_of(page: str) -> list[Block]:
    out: list[Block] = []
    stack: list[tuple[str, bool, bool]] = []  # tag, away, inside an article
    levels: list[Counter] = [Counter()]  # open tags that are no blocks, by the block they stand in
    blocks_open: Counter = Counter()
    parts: list[str] = []
    links = 0
    in_link = 0
    away = inside = False
    heading = False

    def flush() -> None:
        nonlocal links, parts
        if parts:
            text = WHITE.sub(" ", html.unescape("".join(parts))).strip()
            if text:
                out.append(Block(text, links, away, inside, heading))
        parts, links = [], 0

    def add(piece: str) -> None:
        nonlocal links
        if piece:
            parts.append(piece)
            if in_link:
                links += len(piece.strip())

    def push(entry: tuple[str, bool, bool]) -> None:
        stack.append(entry)
        if entry[0] in BLOCK:
            blocks_open[entry[0]] += 1
            levels.append(Counter())
        else:
            levels[-1][entry[0]] += 1

    def pop() -> str:
        tag = stack.pop()[0]
        if tag in BLOCK:
            blocks_open[tag] -= 1
            levels.pop()
        else:
            levels[-1][tag] -= 1
        return tag

    at = 0
    for tag, ends, attr, start, stop in tokens(page):
        add(page[at:start])
        at = stop
        if not tag:
            continue
        if tag in BLOCK:
            flush()
        if tag == "a":
            in_link = 0 if ends else 1
        if tag in VOID:
            continue
        if ends:
            # An end tag of no open element is passed over; one that is no block closes no blocks.
            if blocks_open[tag] if tag in BLOCK else levels[-1][tag]:
                while pop() != tag:
                    pass
        elif tag in BLOCK or marked_away(tag, attr, inside):
            if tag in ("p", "li", "dt", "dd", "option") or tag in HEADINGS:
                while stack and (stack[-1][0] == "p" or stack[-1][0] == tag and tag in ("li", "dt", "dd", "option")):
                    pop()
            now_inside = tag in ("article", "main") or (stack[-1][2] if stack else False)
            now_away = (stack[-1][1] if stack else False) or marked_away(tag, attr, now_inside)
            if not attr.rstrip().endswith("/") or tag in BLOCK:
                push((tag, now_away, now_inside))
        away, inside = (stack[-1][1], stack[-1][2]) if stack else (False, False)
        heading = any(t in HEADINGS for t, _, _ in stack[-2:])
    add(page[at:])
    flush()
    return out


def stop_density(text: str) -> float:
    words = [w.strip("\"'.,;:!?()[]{}#%&$*|") for w in text.lower().split()]
    return sum(w in STOP for w in words) / len(words) if words else 0.0


def first_pass(b: Block) -> bool | None:
    if b.away:
        return False
    n = len(b.text)
    share = b.links / n
    if share > MOST_LINKS:
        return False
    if b.heading or n < SHORT:
        return None
    density = stop_density(b.text)
    if n >= LONG and density >= STOP_LOW and share <= SOME_LINKS or density >= STOP_HIGH and share <= SOME_LINKS:
        return True
    if b.inside:
        return None
    return False if density < STOP_LOW and share > SOME_LINKS else None


def second_pass(blocks: list[Block]) -> None:
    """Ambiguous blocks inherit from the nearest decided neighbours of their own region."""
    n = len(blocks)
    first = [b.label for b in blocks]
    before: list[tuple[int, bool] | None] = [None] * n
    after: list[tuple[int, bool] | None] = [None] * n
    for seen, order in ((before, range(n)), (after, range(n - 1, -1, -1))):
        last: dict[bool, tuple[int, bool]] = {}
        for i in order:
            b = blocks[i]
            if first[i] is None:
                seen[i] = last.get(b.inside)
            elif not b.away:
                last[b.inside] = (i, first[i])
    for i, b in enumerate(blocks):
        if first[i] is None:
            near = [x for x in (before[i], after[i]) if x]
            if not near:
                b.label = b.inside
            elif len(near) == 2 and near[0][1] == near[1][1] or len(near) == 1:
                b.label = near[0][1]
            else:
                b.label = min(near, key=lambda x: (abs(x[0] - i), not x[1]))[1]


def extract(page: str | None) -> str:
    if not page:
        return ""
    blocks = blocks_of(page)
    if any(b.inside and not b.away for b in blocks):
        blocks = [b for b in blocks if b.inside]
    for b in blocks:
        b.label = first_pass(b)
    second_pass(blocks)
    return " ".join(b.text for b in blocks if b.label)


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every page; one Arrow pass, no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [extract(h.as_py()) for h in b.column(2)]
            n = pa.array([len(t) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), n], names=["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    return rows.mapInArrow(lean(run), "page_id long, url string, text string, n_chars long")
