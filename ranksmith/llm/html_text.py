"""Main text of web pages by tree scoring.

A page becomes a tree of its block elements.  Subtrees that by element are
menus, headers, footers, sidebars, forms or hidden are closed out (unless the
article itself lies in them).  Roles, classes and ids weigh: words of an
article count for a subtree, words of comments, notices, adverts, menus and the
like against it, and all of an element's words are added up.  A subtree whose
names speak against it is closed out for now; if they do so weakly, it is
opened again where its own best container outscores the rest of the page
``DOUBT`` times.

Every paragraph earns points for its length and its commas and passes them on:
all to its parent, half to the grandparent, a shrinking part to the ancestors
above (one pass from the leaves to the root).  An ancestor's points are
discounted by the share of its text that stands in links.  The best container
is kept: the article or main element around it, if there is one, else the
container with those of its siblings that score well or read like paragraphs.
Lists made of links are left out.

Blocks are trimmed, white space inside them becomes one space, character
references are decoded, and the blocks are joined by one space in page order.
Null and empty pages, and pages without text, give the empty string.  Broken
markup is read leniently (missing end tags, stray ones, unclosed quotes), in a
time that grows with the page's length whatever it holds; no length is capped.  Repeated rows give equal results.  Extra columns are
ignored.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

# fixed values: names of HTML elements
BLOCKS = frozenset("""address article aside blockquote body center dd details dialog dir div dl dt fieldset
figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup html li main menu nav ol p pre section
summary table tbody td tfoot th thead tr ul""".split())
RAW = frozenset("""script style title textarea noscript template svg iframe select button object canvas
audio video math noframes noembed xmp datalist map""".split())
OUTSIDE = frozenset("nav footer aside form head menu dialog fieldset".split())
# an open element of the set ends where an element of the key's kind begins
ENDS_BEFORE = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
               "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}),
               "th": ({"td", "th"}, {"tr", "table"}), "tbody": ({"tr", "td", "th", "thead", "tbody"}, {"table"}),
               "tfoot": ({"tr", "td", "th", "thead", "tbody"}, {"table"})}
# words of class names, ids and roles that speak against a subtree
BAD_WORDS = frozenset("""ad ads adv adbox adsense banner banners breadcrumb breadcrumbs navigation nav navbar navi
menu menus menubar toolbar topbar masthead header footer foot sidebar sidebars aside rail complementary contentinfo
notice notices cookie cookies consent gdpr alert popup popover modal overlay dialog lightbox newsletter
subscribe subscription signup signin login register promo promos promotion promoted sponsor sponsored sponsors
outbrain taboola share sharing social comment comments commentlist disqus respond replies reply discussion
feedback related recommended recommendations pagination pager paging search searchbox form widget widgets
tagcloud toc skip hidden invisible copyright legal disclaimer paywall""".split())
BAD_STEMS = ("advert", "sidebar", "comment", "cookie", "newsletter", "sponsor", "breadcrumb", "navbar", "footer")
# those of them that name other parts as well: they speak weakly
WEAK_WORDS = frozenset("""alert discussion feedback form header legal login notice paywall promo promoted register related
rail respond search share sharing signin signup skip social sponsored subscribe toc widget""".split())
# words that speak for it
GOOD_WORDS = frozenset("""article articlebody body content entry main post story text blog hentry prose""".split())
# whose header holds the article's title
TITLE_OF = frozenset(("article", "post", "entry", "story", "hentry"))

DOUBT = 5
_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>", re.S)
_OPEN = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)")
_LONG_REFERENCE = re.compile(r"&#[0-9]{9,};?")
_ATTR = re.compile(r"""\b(class|id|role|hidden|style|aria-hidden|itemprop)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""",
                   re.I)
_ABOUT = frozenset(("has", "with", "no", "without", "hide", "show"))
_NAMES = re.compile(r"[A-Za-z][a-z]*|[0-9]+")
_INVISIBLE = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_COMMAS = re.compile("[,،、，]")


class Node:
    """An element with its text pieces and child elements in page order."""

    __slots__ = ("tag", "up", "items", "out", "doubt", "good", "words", "link", "commas", "points", "links_in", "main",
                 "level", "before", "block", "near", "far", "first")

    def __init__(self, tag: str, up: Node | None, before: int = 0):
        self.tag, self.up, self.items, self.out, self.doubt, self.good = tag, up, [], False, False, 0
        self.words = self.link = self.commas = 0
        self.points, self.links_in, self.main = 0.0, 0, False
        self.level = up.level + 1 if up else 0
        self.before = before  # links open where the element begins
        self.block = self if tag in BLOCKS or up is None else up.block
        self.first = self.near = self.far = 0.0  # points from children, their children, and those below


def _weight(name: str, value: str) -> float:
    """What the words of one class, id or role say: above 0 for an article,
    -1 weakly and -2 strongly against it."""
    names = [w.lower() for w in _NAMES.findall(value)]
    # "has-sidebar" tells of another element
    parts = {w for v, w in zip(["", *names], names) if v not in _ABOUT} | {value.lower()}
    bad = parts & BAD_WORDS
    if bad == {"header"} and names[0] in TITLE_OF:
        bad = set()
    strong = bad - WEAK_WORDS or value.lower().startswith(BAD_STEMS)
    good = parts & GOOD_WORDS
    if strong:
        return -2 + bool(good) * 0.5
    if bad:
        return -2 if name == "role" else -1 + bool(good) * 0.5
    return float(bool(good))


def _judge(node: Node, attrs: str, by_name: bool) -> None:
    """Mark a node by its element, and by its role, class and id."""
    tag = node.tag
    if tag in OUTSIDE:
        node.out = True
    if not by_name or not attrs or "=" not in attrs and "hidden" not in attrs.lower():
        return
    total, least = 0.0, 0.0
    for m in _ATTR.finditer(attrs):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true" \
                or name == "style" and _INVISIBLE.search(value):
            node.out = True
        elif name in ("class", "id", "role"):
            for whole in value.split():
                if name == "role" and whole.lower() in ("main", "article"):
                    node.main = True
                    continue
                weight = _weight(name, whole)
                total, least = total + weight, min(least, weight)
                node.good += weight > 0
        elif name == "itemprop" and value.lower() == "articlebody":
            node.main = True
    if total < 0 and not node.out:
        node.out, node.doubt = True, total > -2


def _tag_ends(page: str) -> tuple[list[int], list[int]]:
    """(places of quotes and ``>``, where a tag that reaches that place ends;
    -1: nowhere), from the page's end to its begin."""
    places = [m.start() for m in re.finditer("[\"'>]", page)]
    ends, later = [0] * len(places), {}
    after = -1  # the end from the next place on
    for i in range(len(places) - 1, -1, -1):
        c = page[places[i]]
        if c == ">":
            ends[i] = places[i]
        else:
            close = later.get(c)
            ends[i] = -1 if close is None or close + 1 >= len(places) else ends[close + 1]
            later[c] = i
    return places, ends


class Tags:
    """Forward scan over a page's tags.  Most end at a plain match; once a tag
    has none (an unclosed quote, no ``>``), the ends of all are worked out in
    one pass, so that no part is read again for every tag."""

    def __init__(self, page: str):
        self.page, self.last, self.table = page, page.rfind(">"), None

    def next(self, at: int) -> tuple[int, int, bool, str | None, str] | None:
        """(begin, end, whether closing, tag or None, attributes or text) of
        the next piece of markup."""
        page = self.page
        while (lo := page.find("<", at)) >= 0:
            c = page[lo + 1:lo + 2]
            if c == "!" or c == "?":
                for head, tail in (("<!--", "-->"), ("<![CDATA[", "]]>"), ("<", ">")):
                    if page.startswith(head, lo):
                        hi = page.find(tail, lo + len(head))
                        end = len(page) if hi < 0 else hi + len(tail)
                        text = page[lo + 9:hi if hi >= 0 else end] if tail == "]]>" else ""
                        return lo, end, False, None, text
            if lo < self.last:
                m = _TAG.match(page, lo) if self.table is None else None
                if m is not None:
                    return lo, m.end(), bool(m[1]), m[2].lower(), m[3]
                m = _OPEN.match(page, lo)
                if m is not None:
                    if self.table is None:
                        self.table = _tag_ends(page)
                    places, ends = self.table
                    k = bisect_left(places, m.end())
                    end = ends[k] if k < len(places) else -1
                    if end < 0:
                        end = page.find(">", m.end())
                    if end >= 0:
                        return lo, end + 1, bool(m[1]), m[2].lower(), page[m.end():end]
            else:  # no tag ends any more
                more = [k for k in (page.find("<!", lo), page.find("<?", lo)) if k >= 0]
                if not more:
                    return None
                at = min(more)
                continue
            at = lo + 1
        return None


def _unescape(text: str) -> str:
    """Character references decoded; numbers beyond any character become the
    replacement character."""
    if "&" not in text:
        return text
    if "&#" in text:
        text = _LONG_REFERENCE.sub("\ufffd", text)
    return html.unescape(text)


def parse(page: str, by_name: bool = True) -> Node:
    """The tree of a page's block elements."""
    top = cur = Node("html", None)
    tags, link, at, size = Tags(page), 0, 0, len(page)
    opened: dict[str, list[Node]] = {}
    endless: set[str] = set()  # raw elements without a further end tag

    def add(text: str) -> None:
        if text:
            cur.items.append(_unescape(text))
            if link:
                cur.link += sum(map(len, text.split()))

    def leave(node: Node) -> tuple[Node, int]:
        """End ``node`` and all that is open in it."""
        n = cur
        while True:
            opened[n.tag].pop()
            if n is node:
                return node.up, node.before
            n = n.up

    while at < size:
        found = tags.next(at)
        if found is None:
            add(page[at:])
            break
        begin, end, closing, tag, attrs = found
        if begin > at:
            add(page[at:begin])
        at = end
        if tag is None:
            add(attrs)
            continue
        if closing:
            if tag == "a":
                link = max(0, link - 1)
                cur.links_in += 1
            elif tag == "p" or tag in BLOCKS or cur.tag == tag:
                if opened.get(tag):
                    cur, link = leave(opened[tag][-1])
                else:
                    cur.items.append(" ")
            continue
        if tag in RAW:
            if attrs.endswith("/") and tag not in ("script", "style", "title", "textarea"):
                continue
            close = None if tag in endless else re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.I).search(page, at)
            if close:
                k = page.find(">", close.start())
                at = k + 1 if k >= 0 else size
            else:
                endless.add(tag)
                if tag in ("script", "style", "textarea", "title"):
                    at = size
            continue
        if tag in ("br", "hr", "wbr", "input", "img"):
            if tag in ("br", "hr"):
                cur.items.append(" ")
            continue
        if tag == "a":
            link += 1
            continue
        block = tag in BLOCKS
        if not block:
            if not attrs:
                continue
            node = Node(tag, cur, link)
            _judge(node, attrs, by_name)
            if not node.out:
                continue
        else:
            if tag == "body":
                cur, opened = top, {}
            else:
                # a block ends an open paragraph
                if cur.block.tag == "p":
                    cur, link = leave(cur.block)
                if tag in ENDS_BEFORE:
                    these, stop = ENDS_BEFORE[tag]
                    level = max((opened[t][-1].level for t in stop if opened.get(t)), default=-1)
                    if level >= 0:
                        # the outermost of the kind inside the nearest list or table
                        ended = [own[k] for t in these if (own := opened.get(t))
                                 and (k := bisect_left(own, level + 1, key=lambda n: n.level)) < len(own)]
                        if ended:
                            cur, link = leave(min(ended, key=lambda n: n.level))
            node = Node(tag, cur, link)
            _judge(node, attrs, by_name)
            node.main = node.main or tag in ("article", "main")
        cur.items.append(node)
        if not attrs.endswith("/") or block:
            opened.setdefault(tag, []).append(node)
            cur = node
    return top


def _order(top: Node) -> list[Node]:
    """All nodes, parents first, in page order."""
    out, todo = [], [top]
    while todo:
        n = todo.pop()
        out.append(n)
        todo.extend(x for x in reversed(n.items) if type(x) is Node)
    return out


def _close(nodes: list[Node]) -> None:
    """Close out subtrees; those around the article stay open."""
    holds = set()
    for n in reversed(nodes):
        if n.main or id(n) in holds:
            if n.up is not None:
                holds.add(id(n.up))
    inside: set[int] = set()
    for n in nodes:
        if n.up is not None and (n.up.main or id(n.up) in inside):
            inside.add(id(n))
        if n.tag == "header" and not (id(n) in inside):
            n.out, n.doubt = True, False
        if n.out and (n.main and n.tag in ("article", "main") or id(n) in holds or n.tag in ("body", "html")):
            n.out = n.doubt = False


def _score(nodes: list[Node]) -> None:
    """Count text and pass the paragraphs' points up: all to the parent, a half
    to the grandparent, a sixth to the next one, and of that seven tenths a
    level above."""
    for n in nodes:
        n.words = n.commas = 0
        n.points = n.first = n.near = n.far = 0.0
    for n in reversed(nodes):
        own = "".join(x if type(x) is str else " " for x in n.items)
        length = sum(map(len, own.split())) if own else 0
        commas = len(_COMMAS.findall(own)) if length else 0
        points = 0.0
        if length and n.tag not in ("h1", "h2", "h3", "h4", "h5", "h6", "body", "html"):
            points = length / 100 if length < 25 else 1 + commas + min(length / 100, 3)
        n.points = n.first + n.near / 2 + n.far
        if n.tag in ("div", "section", "article", "main", "td", "center"):
            n.points += points
        n.words += length
        n.commas += commas
        up = n.up
        if up is not None and not n.out:
            up.first += points
            up.near += n.first
            up.far += n.near / 6 + 0.7 * n.far
            up.words += n.words
            up.link += n.link
            up.links_in += n.links_in


def _worth(n: Node) -> float:
    """A container's points without the part of its links."""
    return n.points * (1 - _density(n)) * (1.25 if n.main else 1.1 if n.good else 1.0)


def _reopen(nodes: list[Node]) -> bool:
    """Open doubtful subtrees whose best container outscores all that is open
    ``DOUBT`` times; what is closed for certain inside them does not count."""
    none = ("html", "p", "li", "tr", "tbody")
    within = {}  # whether all around an element is open, and whether it may be opened
    live = 0.0
    for n in nodes:
        open_, may = within[id(n.up)] if n.up is not None else (True, True)
        open_, may = open_ and not n.out, may and (n.doubt or not n.out)
        within[id(n)] = open_, may
        if open_ and n.tag not in none:
            live = max(live, _worth(n))
    best = dict.fromkeys(within, 0.0)
    again = False
    for n in reversed(nodes):
        if within[id(n)][1]:
            own = best[id(n)] = max(best[id(n)], 0.0 if n.tag in none else _worth(n))
            if n.up is not None:
                best[id(n.up)] = max(best[id(n.up)], own)
            if n.doubt and own > DOUBT * live:
                n.out = n.doubt = False
                again = True
    return again


def _density(n: Node) -> float:
    return min(1.0, n.link / n.words) if n.words else 0.0


def _text(nodes: list[Node]) -> str:
    parts: list[str] = []
    for top in nodes:
        todo: list = [top]
        while todo:
            x = todo.pop()
            if type(x) is str:
                parts.append(x)
                continue
            if x.out or x is not top and x.tag in ("ul", "ol", "dl", "table", "div", "section") \
                    and x.links_in >= 2 and _density(x) > 0.66:
                if x.tag in BLOCKS:
                    parts.append(" ")
                continue
            if x.tag in BLOCKS:
                parts.append(" ")
                todo.append(" ")
            todo.extend(reversed(x.items))
    return " ".join("".join(parts).split())


def main_text(page: str | None) -> str:
    """The main text; names are not trusted where they leave no text at all."""
    return (_main_text(page, True) or _main_text(page, False)) if page else ""


def _main_text(page: str, by_name: bool) -> str:
    nodes = _order(parse(page, by_name))
    _close(nodes)
    links = [(n.link, n.links_in) for n in nodes]
    _score(nodes)
    if any(n.doubt for n in nodes) and _reopen(nodes):
        for n, own in zip(nodes, links):  # as they were before the first pass
            n.link, n.links_in = own
        _score(nodes)
    for n in nodes:
        n.out = n.out or n.up is not None and n.up.out
    live = [n for n in nodes if not n.out]
    best, top = None, 0.0
    for n in live:
        score = _worth(n)
        if n.tag in ("html", "p", "li", "tr", "tbody"):
            continue
        if score > top:
            best, top = n, score
    if best is None:
        return _text([nodes[0]])
    around, n = None, best
    while n is not None:
        if n.main and (around is None or around.tag != "article"):
            around = n
        n = n.up
    if around is not None:
        return _text([around])
    if best.up is None or best.tag == "body":
        return _text([best])
    keep = []
    for x in best.up.items:
        if type(x) is not Node or x.out:
            continue
        share = _density(x)
        same = 0.2 * top if x.tag == best.tag and x.good and best.good else 0.0
        if x is best or x.points * (1 - share) + same >= max(10.0, 0.2 * top) \
                or x.tag in ("p", "h1", "h2", "h3", "blockquote", "pre") and share < 0.25 and x.words >= 60 \
                or x.tag in ("p", "h1", "h2") and not x.link and x.words:
            keep.append(x)
    return _text(keep)


def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches, "html", 4 << 20):
        out = [main_text(h) for h in b.column("html").to_pylist()]
        yield pa.RecordBatch.from_pydict({"page_id": b.column("page_id"), "url": b.column("url"),
                                          "text": pa.array(out, pa.string()),
                                          "n_chars": pa.array(list(map(len, out)), pa.int64())})


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
                        F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(_run, "page_id long, url string, text string, n_chars long")
