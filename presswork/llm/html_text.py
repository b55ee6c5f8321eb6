"""Main text of web pages by minimum cut.

A page becomes a line of text blocks. Every block gets two costs, for calling it
boilerplate and for calling it content, from the elements around it, their class
and id words, its links and its length. The costs are the capacities to the two
terminals; neighbouring blocks, and blocks under the same element, are joined by
smoothness edges that weigh more the closer they are in the tree. A maximum flow
then separates content from boilerplate.
"""

from __future__ import annotations

import html
import re
from collections import defaultdict, deque
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from presswork.session import bound_batches

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s>/]*)((?:[^>"']|"[^"]*"|'[^']*'|["'])*+)>?""", re.S)
_ATTRIBUTE = re.compile(r"""([a-zA-Z-]+)\s*(?:=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")

# Element names and naming habits of web pages.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose contents are raw text for the parser and never text of the page: without an end tag they take the rest of the page.
RAW = frozenset("script style iframe textarea title".split())
#: Elements whose contents are not read, if they have an end tag of their own.
OPAQUE = RAW | frozenset("template svg video audio map select button head annotation annotation-xml".split())
#: What a tag inside an opaque element tells about it: block elements begin or end.
_BLOCK_TAG = re.compile(r"<(/?)(article|aside|body|div|footer|form|h[1-6]|header|main|nav|ol|p|section|table|ul|foreignobject)\b", re.I)
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr ruby rt rp br object canvas math mi mn mo ms mtext mspace mrow mfrac msqrt mroot mstyle mpadded mphantom menclose msub msup msubsup munder mover munderover semantics".split())
BOILERPLATE = frozenset("nav footer aside form menu dialog fieldset".split())
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
BAD_WORDS = frozenset(
    "ad ads advert advertisement advertising adsense banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies copyright disqus"
    " footer login masthead menu modal nav navbar navigation newsletter notification pager pagination paywall popup promo promoted"
    " recommended related replies respond rss sidebar signup skyscraper sponsor sponsored subscribe subscription toolbar adbox adslot adunit adwrap".split()
)
#: Names that say together what their words do not.
BAD_NAMES = frozenset("widget widget-area more-stories more-news more-articles read-more read-next you-may-like also-like most-read most-popular back-to-top".split())
#: Signs of readers' comments: these hold however much text the element has.
COMMENT_WORDS = frozenset("comment comments commentlist disqus replies respond".split())
#: Names of one word that hold too; other names may also be a wrapper's.
FIRM_NAMES = COMMENT_WORDS | frozenset("ad ads adbox adslot adunit adwrap advert advertisement advertising adsense breadcrumb breadcrumbs cookie cookies footer hidden nav navbar navigation newsletter pager pagination promo promoted recommended related rss sidebar signup skyscraper sponsor sponsored".split())
#: A name with one of these tells about a layout ('no-sidebar', 'has-banner', 'content-with-sidebar'); so does one that begins with a layout word, or ends in a state ('menu-closed').
LAYOUT_PARTS = frozenset("no not has have with without is".split())
LAYOUT_STARTS = frozenset("layout grid template columns".split())
STATES = frozenset("open opened closed enabled disabled active inactive collapsed expanded on off shown visible".split())
#: Endings that say nothing about what an element holds.
ENDINGS = frozenset("area bar block body box col column container content group holder inner item items list outer panel row section slot text unit wrap wrapper".split())
#: Elements that are pieces of text: a compound name on one of them is a weak sign only.
PIECES = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd td th blockquote pre figcaption".split())
#: What a notice for browsers without scripts speaks of.
_NOTICE = re.compile(r"java\s?script|browser|cookies", re.I)
#: Words that name boilerplate on some pages and parts of an article on others.
VAGUE_WORDS = frozenset("byline disclaimer footnotes form header hidden legal notice notices notifications reply search share sharing skip social tags toc tracking".split())
#: Certain signs as a whole class name or id only ('overflow-hidden' and 'entry-header' are none).
WHOLE_NAMES = frozenset("header hidden".split())
GOOD_WORDS = frozenset("article articlebody body content entry main maincontent post story text".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())

#: Costs in nats: what a certain sign, a strong sign and a paragraph are worth, and the pull of a close neighbour.
CERTAIN, STRONG, PLAIN, PULL = 12.0, 6.0, 2.0, 0.8


@dataclass
class Element:
    tag: str
    parent: Element | None
    depth: int
    bad: float = 0.0  # cost of calling what is inside content
    good: float = 0.0  # cost of calling it boilerplate
    marked: bool = False  # in an element that is the article by its kind
    named: bool = False  # in an element with one of the GOOD_WORDS
    sign: Sign | None = None  # the nearest class name or form around that speaks for boilerplate
    notice: bool = False  # in a noscript element


@dataclass
class Sign:
    """A class name, id or form that speaks for boilerplate, unless its element holds most of the page's paragraphs or the article."""

    around: Sign | None
    firm: bool  # holds in any case
    mass: int = 0  # characters of long, unlinked blocks inside
    holds: bool = True


@dataclass
class Block:
    element: Element
    text: str
    linked: int  # characters inside links
    content: float = field(default=0.0)
    boilerplate: float = field(default=0.0)


def _names(attributes: str) -> tuple[list[list[str]], dict[str, str]]:
    """The class names and the id, each as its words in order, and all attributes."""
    found = {k.lower(): (v or "").strip("\"'") for k, v in _ATTRIBUTE.findall(attributes)}
    names = f"{found.get('class', '')} {found.get('id', '')}".split()
    return [re.findall(r"[a-z]+", re.sub(r"(?<=[a-z])(?=[A-Z])", "-", n).lower()) for n in names], found


def _kind(parts: list[str], piece: bool) -> str:
    """What a name says: 'comment', 'bad', 'vague' or nothing. Names of layouts and states say nothing."""
    if not parts or LAYOUT_PARTS & set(parts) or parts[0] in LAYOUT_STARTS or parts[-1] in STATES:
        return ""
    if "-".join(parts) in BAD_NAMES:
        return "bad"
    stem = list(parts)
    while len(stem) > 1 and stem[-1] in ENDINGS:
        stem.pop()
    if len(parts) == 1 and parts[0] in WHOLE_NAMES:
        return "bad"
    said = set(parts) & BAD_WORDS
    if said:
        if piece and len(parts) > 1 or not {stem[0], stem[-1]} & BAD_WORDS:
            return "vague"
        return "comment" if said & COMMENT_WORDS else "bad"
    return "vague" if set(parts) & VAGUE_WORDS else ""


def _open(tag: str, attributes: str, parent: Element, signs: list[Sign]) -> Element:
    """A new element; certain signs add to those of the elements around it, good signs of a kind count once."""
    e = Element(tag, parent, parent.depth + 1, parent.bad, parent.good, parent.marked, parent.named, parent.sign, parent.notice or tag == "noscript")
    names, found = _names(attributes) if attributes and "=" in attributes or "hidden" in attributes else ([], {})
    whole = tag in ("form", "fieldset")
    if tag in BOILERPLATE and not whole or found.get("role", "").lower() in ROLES:
        e.bad += CERTAIN
    elif tag == "header" and not parent.good:  # a page's header; an article's own holds its heading
        e.bad += CERTAIN
    outer = tag in ("html", "body", "main") or tag == "article" and not parent.marked
    said = {_kind(n, tag in PIECES) for n in names}
    article = tag in ("article", "main") or found.get("role", "").lower() in ("main", "article") or found.get("itemprop", "").lower() == "articlebody"
    if article and not parent.marked and not (e.sign and e.sign.firm):
        e.sign = None  # the article inside a wrapper, whatever that is called
    if whole or "comment" in said and tag not in ("html", "body", "main") or not outer and "bad" in said:
        e.sign = Sign(e.sign, not outer and ("comment" in said or any(len(n) == 1 and n[0] in FIRM_NAMES for n in names)))
        signs.append(e.sign)
    elif tag not in ("html", "body") and any(set(n) & GOOD_WORDS for n in names):
        e.good += 0.0 if e.named else PLAIN
        e.named = True
    elif not outer and "vague" in said:
        e.bad += PLAIN
    if article:
        e.good += 0.0 if e.marked else STRONG
        e.marked = True
    if "hidden" in found or found.get("aria-hidden", "").lower() == "true" or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", found.get("style", "")):
        e.bad += CERTAIN
    return e


def _weigh(found: list[Block], signs: list[Sign]) -> None:
    """Decide which signs hold: one whose element has more than half of the page's paragraphs is a wrapper's, if it is not firm."""
    total = 0
    for b in found:
        if b.element.bad < CERTAIN and b.text.count(" ") >= 11:
            n = max(0, len(b.text) - 2 * b.linked)
            total += n
            if b.element.sign:
                b.element.sign.mass += n
    for s in reversed(signs):  # what is inside comes after what is around it
        if s.around:
            s.around.mass += s.mass
    for s in signs:
        s.holds = s.firm or 2 * s.mass <= total or (s.around is not None and s.around.holds)


class _Ends:
    """Where opaque elements of one page end; each end tag is searched for once, so that hostile pages take linear time."""

    def __init__(self, page: str) -> None:
        self.page = page
        self.next: dict[str, tuple[int, int]] = {}  # of a tag: its next end tag
        self.foreign: dict[str, int] = {}  # of a tag: an end tag that is known to be another element's

    def _end(self, tag: str, at: int) -> tuple[int, int]:
        """(start, end) of the first end tag from ``at`` on; beyond the page if there is none. ``at`` only grows."""
        found = self.next.get(tag)
        if found is None or found[0] < at:
            m = re.compile(rf"</{re.escape(tag)}\b[^>]*>?" + (r"|(?=<body\b)" if tag == "head" else ""), re.I).search(self.page, at)
            found = self.next[tag] = m.span() if m else (len(self.page) + 1, len(self.page) + 1)
        return found

    def past(self, tag: str, at: int) -> int:
        """Where reading goes on after an opaque element's start tag: after its end tag, or at once if it has none of its own.

        An end tag is another element's if the tag begins again before it, or if a
        block element that was open around the element ends before it (and for svg,
        which a block element closes, if one begins).
        """
        start, end = self._end(tag, at)
        if tag in RAW:
            return min(end, len(self.page))
        if end > len(self.page):
            return at
        if tag == "head":  # its end may be left out
            return end
        if self.foreign.get(tag) == start:  # it was already for an element around this one
            return at
        if tag not in ("svg", "template") and re.compile(rf"<{re.escape(tag)}\b", re.I).search(self.page, at, start):
            return at
        depth = foreign = 0
        for m in _BLOCK_TAG.finditer(self.page, at, start):
            step, kind = -1 if m[1] else 1, m[2].lower()
            if kind == "foreignobject":
                foreign += step
            elif kind != "p":  # its end may be left out
                depth += step
            if depth < 0 or tag == "svg" and not foreign and kind != "foreignobject":
                self.foreign[tag] = start
                return at
        return end


def blocks(page: str) -> list[Block]:
    """The page's text blocks in order; a block ends where a block element begins or ends."""
    signs: list[Sign] = []
    root = Element("", None, 0)
    here, out = root, []
    text: list[str] = []
    linked, in_link, at = 0, False, 0
    ends = _Ends(page)
    opened: dict[str, int] = defaultdict(int)  # open elements by tag

    def flush() -> None:
        nonlocal linked
        joined = " ".join("".join(text).split())
        if joined:
            out.append(Block(here, joined, linked))
        text.clear()
        linked = 0

    def add(raw: str) -> None:
        nonlocal linked
        if raw:
            plain = html.unescape(raw)
            text.append(plain)
            if in_link:
                linked += len(" ".join(plain.split()))

    while m := _TOKEN.search(page, at):
        add(page[at : m.start()])
        at = m.end()
        if m[2] is None:
            if m[0].startswith("<![CDATA["):
                add(html.escape(m[0][9:].removesuffix("]]>")))
            continue
        tag, closing = m[2].lower(), bool(m[1])
        if tag in OPAQUE:
            if not closing and not (tag == "svg" and m[3].rstrip().endswith("/")):  # only foreign elements may end in their start tag
                at = ends.past(tag, at)
            continue
        if tag in INLINE:
            if tag == "a":
                in_link = not closing
            elif tag == "br":
                text.append(" ")
            continue
        flush()
        in_link = False
        if closing:  # a tag that nothing has opened is passed over
            if opened[tag]:
                while here.tag != tag:
                    opened[here.tag] -= 1
                    here = here.parent
                opened[tag] -= 1
                here = here.parent
            continue
        if tag in VOID:
            continue
        while here.parent is not None and (here.tag in CLOSES.get(tag, ()) or (here.tag == "p" and tag not in INLINE)):
            opened[here.tag] -= 1
            here = here.parent
        here = _open(tag, m[3] or "", here, signs)
        opened[tag] += 1
    add(page[at:])
    flush()
    _weigh(out, signs)
    return out


def _costs(b: Block) -> None:
    """Terminal capacities of a block from its surroundings and its own text."""
    n, words = len(b.text), b.text.count(" ") + 1
    share = b.linked / n
    b.boilerplate = b.element.good  # paid when content is called boilerplate
    b.content = b.element.bad  # paid when boilerplate is called content
    if b.element.sign and b.element.sign.holds or b.element.notice and _NOTICE.search(b.text):
        b.content += CERTAIN
    if share > 0.5:
        b.content += PLAIN + (STRONG if not b.element.good else 0.0)
    if words >= 12:
        b.boilerplate += PLAIN * (1 - share)
    elif not b.element.good and not re.fullmatch("h[1-6]", b.element.tag):  # a heading goes with what it stands next to
        b.content += PLAIN / 2
    if b.element.tag in ("p", "pre", "blockquote", "h1"):
        b.boilerplate += PLAIN / 2


def _distance(a: Element, b: Element) -> int:
    """Edges between two elements in the tree."""
    steps = 0
    while a is not b:
        if a.depth >= b.depth and a.parent is not None:
            a = a.parent
        elif b.parent is not None:
            b = b.parent
        steps += 1
    return steps


def cut(source: list[float], sink: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Which nodes a minimum cut leaves with the source; capacities must not be negative.

    Flow that can go straight through a node is taken first; what is left of
    the source's is sent along shortest paths. Nodes from which nothing can be
    sent any more stay on the source's side.
    """
    n = len(source)
    left = [max(0.0, a - b) for a, b in zip(source, sink, strict=True)]
    room = [max(0.0, b - a) for a, b in zip(source, sink, strict=True)]
    near: list[dict[int, float]] = [{} for _ in range(n)]
    for i, j, w in edges:
        near[i][j] = near[i].get(j, 0.0) + w
        near[j][i] = near[j].get(i, 0.0) + w
    done = [False] * n
    for s in range(n):
        while left[s] > 1e-9 and not done[s]:
            came, queue, end = {s: s}, deque([s]), -1
            while queue and end < 0:
                i = queue.popleft()
                if room[i] > 1e-9:
                    end = i
                    break
                for j, c in near[i].items():
                    if c > 1e-9 and j not in came and not done[j]:
                        came[j] = i
                        queue.append(j)
            if end < 0:
                for i in came:
                    done[i] = True
                break
            amount, i = min(left[s], room[end]), end
            while i != s:
                amount, i = min(amount, near[came[i]][i]), came[i]
            left[s] -= amount
            room[end] -= amount
            i = end
            while i != s:
                near[came[i]][i] -= amount
                near[i][came[i]] += amount
                i = came[i]
    return done


def main_text(page: str | None) -> str:
    """The text blocks on the content side of the cut, joined by blank lines; '' for NULL or a page without content."""
    found = blocks(page or "")
    for b in found:
        _costs(b)
    edges = []
    for i in range(len(found) - 1):
        edges.append((i, i + 1, PULL * 2 / (1 + _distance(found[i].element, found[i + 1].element))))
        if i + 2 < len(found) and found[i].element.parent is found[i + 2].element.parent:
            edges.append((i, i + 2, PULL / 2))
    keep = cut([b.boilerplate for b in found], [b.content for b in found], edges)
    return "\n\n".join(b.text for b, k in zip(found, keep, strict=True) if k)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """id, url, ``text`` (main text; '' if there is none) and ``n_chars`` (its code points) of every page.

    Whole pages are read. A NULL page has no text; repeated rows are extracted
    each; NULL ids and urls stay NULL. Only the named columns are read, and an
    empty table gives no rows. Broken markup (open elements, cut tags and
    character references) is read as browsers do for text; time is in proportion
    to the page, however long or broken.
    """
    bound_batches(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for start in range(0, b.num_rows, 256):
                part = b.slice(start, 256)
                texts = [main_text(p) for p in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["id", "url", "text", "n_chars"])

    out = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).alias("html")).mapInArrow(run, "id long, url string, text string, n_chars long")
    return out.toDF(id_col, url_col, "text", "n_chars")
