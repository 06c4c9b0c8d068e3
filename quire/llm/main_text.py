"""Main text of web pages (operator 3): two-pass block rules.

A page is cut into blocks at block-level tags. Blocks inside menus, headers, footers,
sidebars, notices, adverts, forms, scripts, styles and reader comments (by element,
role, or whole class and id tokens) are boilerplate. Where that would leave nothing of a
page, its class and id tokens are not counted. The others are classified:

1. *Context-free pass*: by link density, length and stop-word density, a block is
   good, bad, or ambiguous (short, or between the bounds). Inside an ``article`` or
   ``main`` element (or, without one, outside every marked part) running text is
   held to the weaker bounds, and only a block that is all links is bad by its links.
2. *Context pass*: an ambiguous block takes the label that its nearest decided
   neighbours share; where they differ, the nearer one's (headings: the next one's).
   Where nothing is decided, unlinked blocks are good.

Character references are decoded, white space (Unicode) inside a block becomes one
space, and good blocks are joined in page order by one space. Nothing is capped.

Defined results: null or empty html gives an empty text; unclosed and misnested tags
end with their container; repeated rows give equal rows; an empty table an empty
result; other columns are ignored.
"""

from __future__ import annotations

import html
import re
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.session import ship_package

# Common words of four languages.
STOP_WORDS = frozenset("""
a and are as at be but by for from have he in is it not of on or that the this to was were which with you
der die das und ist in den von zu mit sich auf für nicht ein eine als auch es an dem des im wird
le la les de des du et est un une dans que qui pour par sur pas plus avec au ce il elle ne se en
el los las y es una que con por para no su al lo como más del se o
""".split())

TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)
                   |<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']|"[^"]*"|'[^']*')*+)>
                   |<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>""", re.S | re.X)
OPENED = re.compile(r"<(?=[!?/a-zA-Z])")     # of a tag that the page's end cuts off
ATTRIBUTE = re.compile(r"""([a-zA-Z_:][-\w:.]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")

RAW = {"script", "style", "title", "textarea", "noscript", "template", "iframe", "svg", "math", "xmp", "noembed",
       "noframes", "select", "audio", "video", "canvas", "object"}
BLOCK = set("""address article aside blockquote body button center dd details dialog dir div dl dt fieldset figcaption
figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre
search section summary table tbody td tfoot th thead tr ul br caption""".split())
VOID = {"hr", "br", "img", "input", "meta", "link", "wbr", "area", "base", "col", "embed", "source", "track", "param"}
TEXT_ONLY = {"p", "h1", "h2", "h3", "h4", "h5", "h6"}      # end where another block begins
SIBLINGS = {"li": {"ul", "ol", "menu", "dir"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"},
            "th": {"tr", "table"}, "option": {"select"}}
REGION = {"article", "main"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
OUT = {"nav", "footer", "aside", "form", "menu", "button", "dialog", "fieldset", "search", "head"}
OUT_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "alert", "alertdialog", "dialog", "form",
             "menu", "menubar", "toolbar", "status"}
# Words that name boilerplate in class and id tokens, and words that may
# stand beside them in one token (``site-footer``); with any other word beside it
# (``market-share``, ``related-posts-enabled``) a token names something else.
OUT_WORDS = frozenset("""ad ads advert adverts advertisement advertisements advertising adbox adsense sponsor sponsored sponsors
promo promos promotion sidebar sidebars widget widgets menu menus nav navbar navigation breadcrumb breadcrumbs footer masthead
cookie cookies consent gdpr notice notices newsletter subscribe subscription popup modal overlay share sharing social comment
comments commentlist disqus reply replies respond related recommend recommended recommendation recommendations pagination
pager login signup search skiplink toolbar copyright disclaimer outbrain taboola banner alert""".split())
HEADER_WORDS = frozenset("siteheader pageheader topbar header".split())
BESIDE = frozenset("""site page side top bottom left right main global primary secondary bar box list lists post posts article
articles item items block blocks container wrapper wrap area section panel unit slot button buttons link links icon icons form
inner outer header content body text title thread count field input the and of for sign up skip to row col column module zone
region group card js menu""".split())


def _token_words(token: str) -> set[str]:
    """Words of a class or id token: ``siteFooter_2`` has site and footer."""
    parts = re.findall(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])", token)
    return {x.lower() for x in parts} | ({token.lower()} if token.isalpha() else set())


def _names(token: str, kinds: frozenset) -> bool:
    words = _token_words(token)
    if token.isalpha() and token.lower() in kinds:
        return True
    words.discard(token.lower())
    return bool(words & kinds) and words <= OUT_WORDS | HEADER_WORDS | BESIDE


SHORT, LONG = 70, 200           # characters
STOP_LOW, STOP_HIGH = 0.05, 0.15
LINKS = 0.34
ALL_LINKS = 0.9         # inside a region


@dataclass
class Block:
    text: str
    linked: int           # characters inside links
    out: bool             # inside a marked part
    region: bool          # inside article or main
    heading: bool

    def link_density(self) -> float:
        return self.linked / max(1, len(self.text))


def _marks(name: str, attributes: str, in_region: bool, by_words: bool) -> int:
    """0: nothing, 1: boilerplate, 2: a header (whose headings stay inside a region)."""
    if name in OUT:
        return 1
    if name == "header":
        return 2 if in_region else 1
    if not attributes or name in ("html", "body") or name in REGION:
        return 0
    role, words, hidden = "", "", False
    for key, a, b, c in ATTRIBUTE.findall(attributes):
        key, value = key.lower(), a or b or c
        if key == "role":
            role = value.strip().lower()
        elif key in ("class", "id"):
            words += " " + value
        elif key == "hidden" or key == "aria-hidden" and value.lower() == "true":
            hidden = True
        elif key == "style" and re.search(r"(?i)display\s*:\s*none|visibility\s*:\s*hidden", value):
            hidden = True
    if hidden or role in OUT_ROLES:
        return 1
    tokens = words.split() if by_words else []
    if any(_names(t, OUT_WORDS) for t in tokens):
        return 1
    if any(_names(t, HEADER_WORDS) for t in tokens):
        return 2 if in_region else 1
    return 0


def blocks(page: str, by_words: bool = True) -> list[Block]:
    """Blocks of a page in order; white space collapsed, references decoded. Without
    ``by_words`` class and id words mark nothing."""
    low = page.lower() if len(page.lower()) == len(page) else page
    out: list[Block] = []
    parts: list[tuple[str, bool]] = []
    stack: list[tuple[str, int, bool]] = []        # open blocks: name, mark, region
    open_ = dict.fromkeys(BLOCK, 0)
    marks, regions, links, at = [0, 0, 0], 0, 0, 0

    closers: dict[str, int] = {}

    def last_close(name):
        if name not in closers:
            closers[name] = low.rfind("</" + name)
        return closers[name]

    def flush():
        nonlocal parts
        text = " ".join(html.unescape("".join(p for p, _ in parts)).split())
        if text:
            linked = len(" ".join(html.unescape("".join(p for p, link in parts if link)).split()))
            heading = any(open_[h] for h in HEADINGS)
            out.append(Block(text, linked, marks[1] > 0 or marks[2] > 0 and not heading, regions > 0, heading))
        parts = []

    def pop():
        nonlocal regions
        name, mark, region = stack.pop()
        open_[name] -= 1
        marks[mark] -= 1
        regions -= region

    last = page.rfind(">") + 1     # no tag ends beyond; keeps the search linear
    m = TAG.search(page, at, last)
    while m:
        if m.start() > at:
            parts.append((page[at:m.start()], links > 0))
        at = m.end()
        closing, name, attributes = (m.group(1), m.group(2), m.group(3)) if m.group(2) else m.group(4, 5, 6)
        if name:
            name = name.lower()
            if name in RAW and not closing:
                if not attributes.endswith("/"):
                    end = low.find("</" + name, at)
                    end = len(page) if end < 0 else end
                    close = page.find(">", end)
                    at = len(page) if close < 0 else close + 1
                if name in ("select", "video", "audio"):
                    flush()
            elif name == "a":
                links = 0 if closing else 1
            elif name in BLOCK:
                flush()
                if closing:
                    if open_[name]:
                        while stack[-1][0] != name:
                            pop()
                        pop()
                elif name not in VOID:
                    if stack and stack[-1][0] in TEXT_ONLY:
                        pop()
                    if name in SIBLINGS:
                        while stack and stack[-1][0] not in SIBLINGS[name] and open_[name] and \
                                stack[-1][0] in (name, "p", "dt", "dd", "td", "th", "tr"):
                            pop()
                    mark = _marks(name, attributes, regions > 0, by_words)
                    if mark and name not in OUT and name not in SIBLINGS and name not in TEXT_ONLY \
                            and last_close(name) < at:
                        mark = 0    # never closed: it would mark the rest of the page
                    stack.append((name, mark, name in REGION))
                    open_[name] += 1
                    marks[mark] += 1
                    regions += name in REGION
        m = TAG.search(page, at, last)
    parts.append((OPENED.split(page[at:], maxsplit=1)[0], links > 0))
    flush()
    return out


def _stop_density(text: str) -> float:
    words = re.findall(r"[^\W\d_]+", text.lower())
    return sum(w in STOP_WORDS for w in words) / len(words) if words else 0.0


GOOD, BAD, OPEN = 1, -1, 0


def first_pass(b: Block, has_region: bool) -> int:
    """Label of a block by itself."""
    if b.out or has_region and not b.region:
        return BAD
    if b.link_density() > (ALL_LINKS if b.region else LINKS):
        return BAD
    if b.link_density() > LINKS:
        return OPEN                   # linked words of an article: as its neighbours
    if len(b.text) < SHORT or b.heading:
        return OPEN
    density = _stop_density(b.text)
    if density >= (STOP_LOW if b.region or len(b.text) >= LONG else STOP_HIGH):
        return GOOD
    if b.region or density >= STOP_LOW:
        return OPEN
    return BAD if b.linked else OPEN


def labels(page: list[Block]) -> list[bool]:
    """Second pass: whether each block is main text."""
    has_region = any(b.region and not b.out for b in page)
    first = [first_pass(b, has_region) for b in page]
    # inside a region only its own blocks are neighbours
    near = [i for i, b in enumerate(page) if not b.out and (b.region or not has_region)]
    decided = [i for i in near if first[i] != OPEN]
    keep = [x == GOOD for x in first]
    if not any(first[i] == GOOD for i in near):
        inside = set(near)
        return [i in inside and b.link_density() <= (ALL_LINKS if b.region else LINKS) for i, b in enumerate(page)]
    before, k = None, 0
    for i in near:
        if first[i] != OPEN:
            before, k = i, k + 1
            continue
        after = decided[k] if k < len(decided) else None
        sides = [j for j in (before, after) if j is not None]
        if len({first[j] for j in sides}) == 1:
            keep[i] = first[sides[0]] == GOOD
        elif page[i].heading:
            keep[i] = first[after] == GOOD
        else:
            keep[i] = first[min(sides, key=lambda j: abs(j - i))] == GOOD
        if page[i].region and not page[i].linked:
            keep[i] = True          # unlinked text of the article itself
    return keep


def main_text(page: str | None) -> str:
    """The main text of one page."""
    if not page:
        return ""
    for by_words in (True, False):
        found = blocks(page, by_words)
        text = " ".join(b.text for b, good in zip(found, labels(found)) if good)
        if text or not any(b.out for b in found):
            return text
    return text


def _extract(batches):
    for batch in batches:
        texts = [main_text(p) for p in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [*batch.columns[:2], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
            ["page_id", "url", "text", "n_chars"])


def extract_main_text(pages: DataFrame, page_id: str = "page_id", url: str = "url", body: str = "html") -> DataFrame:
    """page_id, url, text, n_chars of every page: one narrow pass."""
    ship_package(pages.sparkSession)
    kinds = dict(pages.dtypes)
    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.col(body).alias("html"))
    return rows.mapInArrow(_extract, f"page_id {kinds[page_id]}, url {kinds[url]}, text string, n_chars long")
