"""HTML extraction: flat text blocks, classified by a decision tree over the word counts and link densities of neighbours.

A page is cut into flat blocks at block-level tags, in time linear in its length. A block's features are its own, its
predecessor's and its successor's word count and link density, then what stands around it: whether a container is
boilerplate by its element or role, how a container is named (class or id), whether it is in an article, whether the page
has an article elsewhere, and whether the block is a heading. The tree is grown (Gini impurity, ties to the text's own
features) from the small labelled table below. Inside articles too it is neighbours that tell lists of links from prose, and
a container's weak name from a part of the article that is called so.

Defined cases: null and empty html give an empty text; unclosed tags, comments and quotes run as far as browsers let them, but
a quote that is never closed quotes nothing; a link ends with the container that it was opened in; repeated rows are extracted
row by row; an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from dataclasses import dataclass
from itertools import product

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_rows, read_table

#: HTML's elements, by what they do to the text.
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre search section summary table tbody td tfoot th thead tr ul".split())
DROPPED = frozenset("script style noscript template textarea select option button title head svg math iframe object audio video canvas datalist".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose start closes an open p.
CLOSES_P = BLOCK - {"body", "html", "caption", "tbody", "thead", "tfoot", "td", "th", "tr", "option", "legend"}
RAW = ("script", "style", "textarea", "title", "noscript", "iframe", "template")
BOILER_TAGS = frozenset("nav footer aside form dialog menu search".split())
BOILER_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar".split())
#: Words that name containers. A name says what its container is only if all its parts are such words or filling.
STRONG = frozenset("ad ads adv advert adverts advertisement advertising sponsor sponsored promo nav navbar navigation menu breadcrumb breadcrumbs sidebar footer masthead topbar comment comments commentlist disqus respond replies cookie cookies consent gdpr popup modal overlay newsletter subscribe signup share sharing social pagination pager".split())
WEAK = frozenset("banner header foot rail aside reply discussion notice notices alert alerts subscription login register related recommended recommendations trending popular widget widgets toolbar skip legal copyright disclaimer form search promotion".split())
FILLING = frozenset("site page global top bottom left right box bar container wrapper wrap inner outer area slot unit block section module list item items link links posts post buttons button thread the my main primary secondary".split())
ARTICLE_WORDS = frozenset("article post entry story content main".split())

TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*\"|'[^']*')*+)>")
BARE_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*)>")
TAG_BODY = re.compile(r"<(?:/?)(?:[a-zA-Z][^\s/>]*)(?:[^>\"']++|\"[^\"]*\"|'[^']*')*+")
MARKUP = re.compile(r"<[!?/a-zA-Z]")
ATTRIBUTE = re.compile(r"""(?:^|\s)(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.IGNORECASE)
HIDDEN_STYLE = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.IGNORECASE)
RAW_END = {t: re.compile(rf"</{t}(?=[\s/>])", re.IGNORECASE) for t in RAW}


@dataclass(slots=True)
class Block:
    text: str
    words: int
    links: float
    named: int
    boiler: bool
    article: bool
    heading: bool


@dataclass(slots=True)
class Open:
    """An open element, with what holds of it and of those around it."""

    tag: str
    named: int
    boiler: bool
    article: bool
    dropped: bool


OUTSIDE = Open("", 0, False, False, False)


def name_strength(token: str) -> int:
    """2 where the name is made of boilerplate words, one of them strong; 1 with weak ones alone; 0 if any part is neither such a word nor filling."""
    parts = [x for x in re.split(r"[^a-z]+", token.lower()) if x]
    if not all(x in STRONG or x in WEAK or x in FILLING for x in parts):
        return 0
    return 2 if any(x in STRONG for x in parts) else int(any(x in WEAK for x in parts))


def _opened(tag: str, attributes: str, around: Open) -> Open:
    """The element that opens here. Inside an article a header is the article's own, and a weak id is an anchor."""
    inside = around.article
    boiler, article, hidden, named = tag in BOILER_TAGS or tag == "header" and not inside, tag in ("article", "main"), False, 0
    for m in ATTRIBUTE.finditer(attributes) if attributes else ():
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and HIDDEN_STYLE.search(value):
            hidden = True
        elif name == "role":
            boiler |= value.lower() in BOILER_ROLES
            article |= value.lower() in ("article", "main")
        elif name in ("class", "id") and tag not in ("article", "main", "body", "html"):
            strength = max(map(name_strength, value.split()), default=0)
            if not (strength == 1 and inside and name == "id"):
                named = max(named, strength)
            article |= not strength and tag in ("div", "section", "td") and bool(ARTICLE_WORDS & set(re.split(r"[^a-z]+", value.lower())))
    return Open(tag, max(around.named, named), around.boiler or boiler, inside or article, around.dropped or hidden or tag in DROPPED)


class Reader:
    """Reads a page into blocks. The stack holds block-level elements and those with attributes; of each name it knows how many are open."""

    def __init__(self) -> None:
        self.out: list[Block] = []
        self.stack: list[Open] = []
        self.open: Counter[str] = Counter()
        self.levels: list[int] = []  # places of block-level elements in the stack
        self.text: list[str] = []
        self.linked: list[str] = []
        self.link: int | None = None  # the stack's height where the open link began
        self.heading = False

    def flush(self) -> None:
        s = " ".join("".join(self.text).split())
        if s:
            n, top = s.count(" ") + 1, self.stack[-1] if self.stack else OUTSIDE
            self.out.append(Block(s, n, min(1.0, len("".join(self.linked).split()) / n), top.named, top.boiler, top.article, self.heading))
        self.text.clear()
        self.linked.clear()
        self.heading = False

    def add(self, s: str) -> None:
        if s and not (self.stack and self.stack[-1].dropped):
            s = entities.unescape(s) if "&" in s else s
            self.text.append(s)
            if self.link is not None:
                self.linked.append(s + " ")

    def push(self, element: Open) -> None:
        if element.tag in BLOCK:
            self.levels.append(len(self.stack))
        self.stack.append(element)
        self.open[element.tag] += 1

    def cut(self, height: int) -> None:
        """Closes what stands at that height and above."""
        while len(self.stack) > height:
            self.open[self.stack.pop().tag] -= 1
        while self.levels and self.levels[-1] >= height:
            self.levels.pop()
        if self.link is not None and height < self.link:
            self.link = None

    def end(self, tag: str) -> None:
        if tag == "a":
            self.link = None
        if tag in BLOCK:
            self.heading |= len(tag) == 2 and tag[0] == "h" and tag[1] in "123456"
            self.flush()
        if self.open[tag]:
            height = len(self.stack) - 1
            while self.stack[height].tag != tag:
                height -= 1
            self.cut(height)

    def start(self, tag: str, attributes: str) -> None:
        if tag == "a":
            self.link = len(self.stack)
        if tag in BLOCK:
            self.flush()
            if tag in CLOSES_P and self.levels and self.stack[self.levels[-1]].tag == "p":
                self.cut(self.levels[-1])
            elif tag in ("td", "th", "tr", "dd", "dt", "li") and self.stack and self.stack[-1].tag == tag:
                self.cut(len(self.stack) - 1)
        if tag in VOID or attributes.endswith("/") and tag not in BLOCK:
            return
        if tag in BLOCK or tag in DROPPED or attributes:
            self.push(_opened(tag, attributes, self.stack[-1] if self.stack else OUTSIDE))


def blocks(page: str) -> list[Block]:
    r = Reader()
    at, size, last, unquoted = 0, len(page), page.rfind(">"), 0
    while at < size:
        here = page.find("<", at)
        if here < 0:
            r.add(page[at:])
            break
        r.add(page[at:here])
        if page.startswith("<!--", here):
            end = page.find("-->", here + 4)
            at = size if end < 0 else end + 3
            continue
        if not MARKUP.match(page, here):
            r.add("<")
            at = here + 1
            continue
        if here > last:  # the page ends inside a tag
            break
        if page.startswith(("<!", "<?"), here):
            at = page.find(">", here) + 1
            continue
        m = TAG.match(page, here) if here >= unquoted else BARE_TAG.match(page, here)
        if m is None and here >= unquoted and (body := TAG_BODY.match(page, here)):
            unquoted = body.end() + 1  # the quote there is never closed, or the page ends: from here to there quotes quote nothing
            m = BARE_TAG.match(page, here)
        if m is None:  # </ and no name: a comment
            at = page.find(">", here) + 1
            continue
        at, tag = m.end(), m[2].lower()
        if m[1]:
            r.end(tag)
        elif tag == "br":
            r.add(" ")
        else:
            if tag in RAW:
                if tag in BLOCK:
                    r.flush()
                close = RAW_END[tag].search(page, at)
                at = page.find(">", close.end()) + 1 or size if close else size
            else:
                r.start(tag, m[3])
    r.flush()
    return r.out


FIELDS = ("words", "links", "words_before", "links_before", "words_after", "links_after", "named", "boiler", "article", "outside", "heading")

#: The labelled table, by what stands around a block: its words and link density, then those of its neighbours before and
#: after (0 where there is none), whether it is a heading, and 1 for main text.
IN_ARTICLE = (
    (9, 0.0, 0, 0.0, 60, 0.0, 1, 1), (60, 0.0, 9, 0.0, 45, 0.0, 0, 1), (3, 0.0, 60, 0.0, 45, 0.0, 0, 1), (45, 0.1, 3, 0.0, 0, 0.0, 0, 1), (1, 0.0, 45, 0.0, 80, 0.0, 0, 1), (4, 1.0, 45, 0.0, 80, 0.0, 0, 1),
    (200, 0.02, 1, 0.0, 10, 0.0, 0, 1), (6, 0.0, 200, 0.0, 3, 0.0, 1, 1), (12, 0.0, 6, 1.0, 12, 0.0, 0, 1), (2, 0.0, 1, 1.0, 2, 0.0, 0, 1), (15, 0.9, 20, 0.0, 30, 0.0, 0, 1), (8, 0.0, 0, 0.0, 0, 0.0, 0, 1),
    (1, 0.0, 30, 0.0, 1, 1.0, 0, 1), (40, 0.0, 9, 0.0, 2, 1.0, 0, 1), (5, 0.5, 4, 0.6, 6, 0.4, 0, 1), (25, 0.0, 5, 1.0, 3, 1.0, 1, 1), (1, 0.0, 0, 0.0, 1, 0.0, 0, 1), (2, 0.0, 2, 0.0, 2, 0.0, 0, 1), (30, 0.4, 12, 1.0, 40, 0.0, 0, 1),
    (6, 0.0, 40, 0.0, 4, 1.0, 0, 1), (10, 0.0, 60, 0.0, 2, 1.0, 0, 1), (3, 0.0, 1, 1.0, 1, 1.0, 0, 1), (5, 0.0, 50, 0.0, 3, 1.0, 1, 1), (4, 0.0, 30, 0.0, 5, 1.0, 0, 1), (9, 0.0, 2, 1.0, 0, 0.0, 0, 1), (12, 0.3, 8, 1.0, 0, 0.0, 0, 1), (2, 0.0, 45, 0.0, 0, 0.0, 0, 1),
    (2, 1.0, 2, 1.0, 2, 1.0, 0, 0), (1, 1.0, 60, 0.0, 1, 1.0, 0, 0), (3, 1.0, 2, 1.0, 45, 0.0, 0, 0), (7, 1.0, 9, 1.0, 8, 1.0, 0, 0), (2, 1.0, 3, 0.0, 2, 1.0, 0, 0), (5, 1.0, 6, 1.0, 0, 0.0, 0, 0),
)
IN_BOILERPLATE = (
    (1, 1.0, 0, 0.0, 1, 1.0, 0, 0), (1, 1.0, 1, 1.0, 12, 0.0, 0, 0), (12, 0.0, 1, 1.0, 9, 0.0, 0, 0), (3, 1.0, 2, 1.0, 30, 0.0, 0, 0), (7, 1.0, 9, 1.0, 8, 1.0, 0, 0), (10, 0.1, 40, 0.0, 12, 0.0, 0, 0),
    (2, 0.0, 45, 0.0, 30, 0.0, 1, 0), (18, 0.2, 60, 0.0, 3, 1.0, 0, 0), (70, 0.0, 2, 0.0, 65, 0.0, 0, 0), (65, 0.0, 70, 0.0, 14, 0.0, 0, 0), (14, 0.0, 45, 0.0, 0, 0.0, 0, 0), (100, 0.0, 80, 0.0, 90, 0.0, 0, 0), (5, 0.0, 0, 0.0, 40, 0.0, 1, 0),
    (60, 0.0, 45, 0.0, 50, 0.0, 0, 0), (40, 0.0, 60, 0.0, 45, 0.0, 0, 0), (35, 0.1, 40, 0.0, 40, 0.0, 0, 0), (45, 0.0, 50, 0.0, 42, 0.0, 0, 0), (30, 0.0, 0, 0.0, 0, 0.0, 0, 0),
)
#: In a container with a weak name, in an article: what is called so is left out but where its text reads on from prose to prose.
WEAKLY_NAMED = (
    (60, 0.0, 45, 0.0, 50, 0.0, 0, 1), (40, 0.0, 60, 0.0, 45, 0.0, 0, 1), (35, 0.1, 40, 0.0, 40, 0.0, 0, 1), (45, 0.0, 50, 0.0, 42, 0.0, 0, 1),
    (12, 0.0, 45, 0.0, 50, 0.0, 0, 0), (18, 0.0, 60, 0.0, 3, 1.0, 0, 0), (3, 1.0, 2, 1.0, 60, 0.0, 0, 0), (6, 0.0, 45, 0.0, 30, 0.0, 1, 0), (20, 0.3, 60, 0.0, 0, 0.0, 0, 0), (2, 0.0, 40, 0.0, 1, 0.0, 0, 0), (9, 0.0, 4, 0.0, 30, 0.0, 0, 0),
)
OUTSIDE_THE_ARTICLE = (
    (12, 0.0, 1, 1.0, 9, 0.0, 0, 0), (35, 0.0, 60, 0.0, 0, 0.0, 0, 0), (20, 0.2, 0, 0.0, 9, 0.0, 0, 0), (5, 1.0, 4, 1.0, 6, 1.0, 0, 0), (80, 0.0, 45, 0.0, 14, 0.0, 1, 0), (30, 0.0, 5, 0.0, 60, 0.0, 0, 0), (50, 0.0, 12, 0.0, 40, 0.0, 0, 0), (1, 0.0, 0, 0.0, 90, 0.0, 0, 0),
)
WITHOUT_ARTICLE = (
    (60, 0.0, 9, 0.0, 45, 0.0, 0, 1), (45, 0.05, 60, 0.0, 50, 0.1, 0, 1), (30, 0.0, 5, 0.0, 0, 0.0, 0, 1), (25, 0.2, 30, 0.0, 40, 0.0, 0, 1), (20, 0.0, 0, 0.0, 0, 0.0, 0, 1), (40, 0.0, 50, 0.0, 5, 1.0, 0, 1), (35, 0.0, 3, 1.0, 4, 0.0, 0, 1), (60, 0.1, 2, 0.0, 12, 0.0, 0, 1),
    (18, 0.0, 30, 0.0, 20, 0.0, 0, 1), (22, 0.0, 4, 0.0, 6, 0.5, 0, 1), (9, 0.0, 3, 1.0, 60, 0.0, 1, 1), (6, 0.0, 60, 0.0, 45, 0.0, 1, 1), (8, 0.0, 45, 0.0, 50, 0.0, 0, 1), (5, 0.0, 60, 0.0, 45, 0.0, 0, 1), (2, 0.0, 0, 0.0, 0, 0.0, 0, 1), (1, 0.0, 0, 0.0, 2, 0.0, 1, 1), (2, 0.0, 1, 0.0, 3, 0.0, 0, 1),
    (3, 0.0, 2, 0.0, 6, 0.0, 0, 1), (6, 0.0, 3, 0.0, 0, 0.0, 0, 1), (4, 0.0, 8, 0.0, 5, 0.0, 0, 1), (4, 1.0, 40, 0.0, 50, 0.0, 0, 1), (30, 0.0, 2, 1.0, 2, 1.0, 0, 1),
    (3, 1.0, 1, 1.0, 50, 0.0, 0, 0), (2, 1.0, 50, 0.0, 2, 1.0, 0, 0), (8, 0.9, 0, 0.0, 40, 0.0, 0, 0), (3, 1.0, 2, 1.0, 4, 1.0, 0, 0), (12, 1.0, 10, 1.0, 11, 1.0, 0, 0), (20, 0.9, 3, 1.0, 4, 1.0, 0, 0), (2, 0.0, 3, 1.0, 3, 1.0, 0, 0), (4, 0.0, 2, 0.0, 3, 1.0, 0, 0), (30, 0.6, 20, 0.9, 12, 1.0, 0, 0),
    (5, 0.5, 60, 0.0, 0, 0.0, 0, 0), (6, 0.0, 4, 0.0, 3, 0.5, 0, 0), (3, 0.0, 2, 1.0, 5, 0.8, 1, 0), (4, 0.0, 3, 1.0, 0, 0.0, 0, 0), (2, 1.0, 0, 0.0, 2, 1.0, 0, 0), (3, 1.0, 60, 0.0, 0, 0.0, 0, 0), (2, 1.0, 0, 0.0, 0, 0.0, 0, 0), (1, 1.0, 0, 0.0, 60, 0.0, 0, 0),
)


def _labelled() -> tuple[tuple, ...]:
    """Rows of FIELDS and the label: each part of the table in the surroundings (named, boiler, article, outside) that it speaks of."""
    boilerplate = [(named, boiler, article, outside) for named, boiler, (article, outside) in product((0, 1, 2), (0, 1), ((1, 0), (0, 1), (0, 0))) if boiler or named == 2 or named and not article]
    parts = ((IN_ARTICLE, [(0, 0, 1, 0)]), (IN_BOILERPLATE, boilerplate), (WEAKLY_NAMED, [(1, 0, 1, 0)]), (OUTSIDE_THE_ARTICLE, [(0, 0, 0, 1)]), (WITHOUT_ARTICLE, [(0, 0, 0, 0)]))
    return tuple((*r[:6], *s, *r[6:]) for rows, surroundings in parts for s in surroundings for r in rows)


LABELLED = _labelled()


def grow(rows: tuple[tuple, ...] = LABELLED, depth: int = 12) -> tuple:
    """A tree of (field, threshold, below, at least) and leaves True or False, by Gini impurity; ties go to the earlier field, then to the lower threshold."""
    yes = sum(r[-1] for r in rows)
    if yes in (0, len(rows)) or not depth:
        return (2 * yes >= len(rows),)
    best = None
    for f in range(len(FIELDS)):
        values = sorted({r[f] for r in rows})
        for a, b in zip(values, values[1:], strict=False):
            cut = (a + b) / 2
            low, high = [r for r in rows if r[f] < cut], [r for r in rows if r[f] >= cut]
            impure = round(sum(2 * (p := sum(r[-1] for r in x)) * (len(x) - p) / len(x) for x in (low, high)), 9)
            if best is None or (impure, f, cut) < best[:3]:
                best = (impure, f, cut, low, high)
    if best is None:
        return (2 * yes >= len(rows),)
    _, f, cut, low, high = best
    return (f, cut, grow(tuple(low), depth - 1), grow(tuple(high), depth - 1))


def decide(tree: tuple, row: tuple) -> bool:
    while len(tree) > 1:
        tree = tree[2] if row[tree[0]] < tree[1] else tree[3]
    return tree[0]


def main_text(page: str | None, tree: tuple) -> str:
    """The main blocks of the page, one a line. Where the surroundings change a block has no neighbour: a menu beside an article says nothing of its text."""
    found = blocks(page or "")
    has_article = any(b.article for b in found)
    sides = [(b.article, b.boiler or b.named == 2) for b in found]
    out = []
    for k, b in enumerate(found):
        before = found[k - 1] if k and sides[k - 1] == sides[k] else None
        after = found[k + 1] if k + 1 < len(found) and sides[k + 1] == sides[k] else None
        row = (b.words, b.links, before.words if before else 0, before.links if before else 0.0, after.words if after else 0, after.links if after else 0.0, b.named, b.boiler, b.article, has_article and not b.article, b.heading)
        if decide(tree, row):
            out.append(b.text)
    return "\n".join(out)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text and n_chars of each row."""

    def make():
        tree = grow()

        def f(ids, urls, pages):
            texts = [main_text(p, tree) for p in pages]
            return [ids, urls, texts, [len(t) for t in texts]]

        return f

    return map_rows(pages.select(F.col(id_col).cast("long"), F.col(url_col), F.col(html_col)), make, "page_id long, url string, text string, n_chars long")


def op10_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(read_table(spark, sf_dir, "pages"))
