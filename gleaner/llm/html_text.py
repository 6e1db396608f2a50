"""Main text of web pages by two passes of block rules.

The first pass looks at each block by itself: the elements it stands in, the share of its text in links, its
length and its share of stop words make it good, bad or ambiguous. To stand in an article speaks for a block, not
against those outside. The second gives ambiguous blocks the label of their nearest decided neighbours, on the same
side of an article's border, and keeps what is rich in links between good neighbours.
"""

from __future__ import annotations

import html
import re
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm.common import in_batches

# fixed values: frequent words of English, German, French and Spanish
STOP_WORDS = frozenset(
    """the of and to in is that it for was on are with as be this by from at or an not have he they his but
    der die und den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er
    le la les de des et en un une du que qui dans pour est par sur pas au plus ne se ce il avec
    el los las y que en un una por con del se no para es su al lo como más""".split()
)
LINKS_HIGH = 0.33  # share of a block's characters in links that makes it bad
SHORT, LONG = 70, 200  # characters
STOPS_HIGH = 0.32  # share of stop words

# fixed values: the elements of HTML by what they mean here
BLOCKS = frozenset(
    """address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption
    figure footer form frame h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol optgroup option p pre
    section select summary table tbody td tfoot th thead tr ul""".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr frame".split())
OUTSIDE = frozenset("nav header footer aside form menu dialog button select fieldset head".split())
INSIDE = frozenset(["article", "main"])
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
HINTS = frozenset(
    """ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments cookie cookies
    consent disqus footer header masthead menu nav navbar navigation newsletter notice notices pagination pager popup
    promo promoted related reply replies share sharing sidebar social sponsor sponsored subscribe widget""".split()
)
ROLES = frozenset("navigation banner contentinfo complementary search alert dialog menu menubar form".split())

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(script|style|title|textarea|noscript|template|svg|math|iframe|object|noframes)\b[^>]*?(?:/>|>.*?(?:</\1\s*[^>]*>|\Z))"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>"
    r"|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>"
    r"|<[!?/][^>]*>",
    re.S | re.I,
)
_HINT = re.compile(r"""\b(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
_HIDDEN = re.compile(r"\bhidden\b(?!\s*-)", re.I)
_WORD = re.compile(r"[^\W\d_]+")
# fixed values: elements that hold the text whatever their class says, and words that make a class name tell of a layout
WHOLE = frozenset("html body article main".split())
LAYOUT = frozenset("has have with without no not non hide hides show shows layout".split())


@dataclass
class Block:
    text: str
    linked: int  # characters in links
    where: bool | None  # True inside an article, False inside what is never main text, None elsewhere
    heading: bool


def _hinted(element: str, attributes: str) -> bool:
    """Whether class, id or role name something that is not main text; has-sidebar and the like tell of a layout."""
    if not attributes or attributes.isspace():
        return False
    for name, value in _HINT.findall(attributes) if element not in WHOLE else ():
        for one in value.strip("\"'").lower().split():
            words = re.split(r"[_-]+", one)
            if (HINTS.intersection(words) and not LAYOUT.intersection(words)) or (name.lower() == "role" and ROLES.intersection(words)):
                return True
    return bool(_HIDDEN.search(_HINT.sub("", attributes)))


def blocks_of(page: str) -> list[Block]:
    """The blocks of a page in order; tags that are not closed, or closed twice, do no harm."""
    out: list[Block] = []
    parts: list[str] = []
    linked_parts: list[str] = []
    stack: list[tuple[str, bool | None]] = []  # open elements and what each says of the blocks inside
    in_link, heading = 0, False

    def end_block():
        nonlocal parts, linked_parts
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                linked = len(" ".join(html.unescape("".join(linked_parts)).split()))
                where = next((w for _, w in reversed(stack) if w is not None), None)
                out.append(Block(text, linked, where, heading))
        parts, linked_parts = [], []

    def add(text: str):
        if text:
            parts.append(text)
            if in_link:
                linked_parts.append(text)

    at = 0
    for m in _TOKEN.finditer(page):
        add(page[at : m.start()])
        at = m.end()
        closing, name, attributes = (m[2], m[3], m[4]) if m[3] else (m[5], m[6], m[7])
        if not name:
            if m[1]:  # an element whose content is no text of the page
                add(" ")
            continue
        name = name.lower()
        if name in BLOCKS:
            end_block()
            heading = name in HEADINGS and not closing
            in_link = 0
        elif name == "br":
            add(" ")
        elif name == "a":
            in_link = 0 if closing else 1
        if closing:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    del stack[k:]
                    break
        elif name not in VOID and not attributes.endswith("/"):
            says = False if name in OUTSIDE or _hinted(name, attributes) else True if name in INSIDE else None
            if says is not None or (name in BLOCKS and name not in ("p", "li", "dd", "dt", "option", "td", "th", "tr")):
                if says is None or name in BLOCKS:
                    stack.append((name, says))
    add(page[at:])
    end_block()
    return out


def rich_in_links(block: Block) -> bool:
    return block.linked > (0.5 if block.where else LINKS_HIGH) * len(block.text)


def first_pass(block: Block) -> bool | None:
    """True, False, or None for what its neighbours decide."""
    if block.where is False or rich_in_links(block):
        return False
    if block.where:
        return True
    if "©" in block.text and len(block.text) < LONG:
        return False
    if len(block.text) < SHORT or block.heading:
        return False if block.linked and not block.heading else None
    words = _WORD.findall(block.text.lower())
    stops = sum(w in STOP_WORDS for w in words) / max(1, len(words))
    return True if stops >= STOPS_HIGH and len(block.text) >= LONG else None


def second_pass(labels: list[bool | None]) -> list[bool]:
    """Undecided blocks take the label of the nearest decided one; of two equally near, either being good does."""
    n = len(labels)
    before: list[tuple[int, bool]] = [(n, False)] * n
    after = list(before)
    for side, order in ((before, range(n)), (after, range(n - 1, -1, -1))):
        last = None
        for i in order:
            if labels[i] is not None:
                last = i
            if last is not None:
                side[i] = (abs(i - last), bool(labels[last]))
    out = []
    for b, a in zip(before, after, strict=True):
        out.append(b[1] if b[0] < a[0] else a[1] if a[0] < b[0] else a[1] or b[1])
    return out


def between_good(found: list[Block], labels: list[bool]) -> list[bool]:
    """Labels where a run of blocks rich in links is good if the blocks on both sides are.

    At the first or last block of an article, one good side inside it does.
    """
    out = list(labels)
    rich = [b.where is not False and rich_in_links(b) for b in found]
    i = 0
    while i < len(found):
        end = i + 1
        if rich[i]:
            while end < len(found) and rich[end] and found[end].where == found[i].where:
                end += 1
            inside = bool(found[i].where)
            sides = [labels[k] if 0 <= k < len(found) and (found[k].where or not inside) else None for k in (i - 1, end)]
            good = False not in sides and True in sides if inside else sides == [True, True]
            out[i:end] = [good] * (end - i)
        i = end
    return out


def labels_of(found: list[Block]) -> list[bool]:
    """Whether each block is main text."""
    first = [first_pass(b) for b in found]
    if True not in first:  # a language without stop words here, code or tables: length alone decides
        for least in (LONG, SHORT):
            if True not in first:
                first = [True if label is None and not b.heading and len(b.text) >= least else label for b, label in zip(found, first, strict=True)]
    out = [False] * len(found)
    for inside in (True, False):
        at = [i for i, b in enumerate(found) if bool(b.where) == inside]
        for i, good in zip(at, second_pass([first[i] for i in at]), strict=True):
            out[i] = good
    return between_good(found, out)


def main_text(page: str | None) -> str:
    """The good blocks of a page, a line each."""
    found = blocks_of(page or "")
    return "\n".join(b.text for b, good in zip(found, labels_of(found), strict=True) if good)


def _extractor():
    def rows(page_ids, urls, pages):
        texts = [main_text(p) for p in pages]
        return page_ids, urls, texts, [len(t) for t in texts]

    return rows


def extract(pages: DataFrame, id_col: str = "page_id") -> DataFrame:
    """Per row of pages: page_id, url, text and its length in code points.

    In a block, character references are decoded and runs of white space are one blank. A null or empty page, or
    one without main text, has an empty text. Repeated rows get a row each. Only id_col, url and html are read.
    """
    rows = pages.select(F.col(id_col).cast("bigint").alias("page_id"), "url", "html")
    return in_batches(rows, _extractor, "page_id bigint, url string, text string, n_chars bigint")
