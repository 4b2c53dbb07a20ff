"""Main text of web pages by tree scoring.

A page is read into a tree of block elements.  Menus, headers, footers, adverts, forms, notices,
reader comments and invisible parts are left out by element, role and class.  Each block of
text passes points for its length and commas to its ancestors, less with each step; a
container's points are discounted by the share of its text inside links.  The best container is kept, with
siblings that score well, are solid paragraphs, or are headings.  Its blocks, in page order,
joined by one space, are the text.

A null or blank page, or one without text, has an empty text.  Broken markup is read as far as
it goes, in time proportional to the page.  Repeated rows are treated alike.  Columns other than id, url and html are not read.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canvass.llm.words import slices

_NAME = re.compile(r"</?([a-zA-Z][^\t\n\f\r />]*)")
#: The next attribute name of a tag and its equals sign, without the value.
_ATTRIBUTE = re.compile(r"[\t\n\f\r /]*(=?[^\t\n\f\r />=]*)[\t\n\f\r ]*(=?)[\t\n\f\r ]*")
_UNQUOTED = re.compile(r"[^\t\n\f\r >]*")
_MARKS = frozenset("class id role style hidden aria-hidden".split())
_INVISIBLE = re.compile(r"display:none|visibility:hidden")
#: Elements whose content is no markup; the end of each.
_RAW = {t: re.compile(rf"</{t}(?=[\t\n\f\r />])", re.I)
        for t in "script style noscript textarea title iframe noembed noframes xmp".split()}
#: Elements that end foreign content (an image in markup) they stand in, and those in which they do not.
_LEAVES_FOREIGN = frozenset(
    "b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta nobr ol p pre ruby s small span "
    "strike strong sub sup table tt u ul var".split())
_FOREIGN, _HOSTS = ("svg", "math"), ("foreignobject", "desc", "title")
_BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html "
    "li main nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_DROP = frozenset("nav footer aside form button dialog head menu svg math template select object".split())
_CLOSES_P = _BLOCKS - {"html", "body"}
#: An opening element ends an open one of these, up to the given ancestors.
_ENDS = {"li": ({"li"}, {"ul", "ol"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "td": ({"td", "th"}, {"table"}),
         "th": ({"td", "th"}, {"table"}), "tr": ({"tr"}, {"table"})}
#: Parts of a page that are not its article, whatever the other words of the name.
_PARTS = frozenset(
    "ad ads adv advert advertisement advertising adsense breadcrumb breadcrumbs comment comments commentlist consent cookie cookies disqus footer gdpr "
    "masthead menu nav navbar navigation newsletter pager pagination promo promoted recommended related share sharing sidebar sponsor sponsored "
    "subscribe toolbar".split())
#: Names of such parts that are also given to what holds an article; a word of ``_GOOD`` outweighs them.
_BAD = _PARTS | frozenset(
    "banner complementary contentinfo cookies dialog disclaimer hidden login modal notice overlay popup reply respond search signup skip social tags "
    "toc widget alert".split())
_GOOD = frozenset("article body content entry main page post story text".split())
#: The header of one of these is the head of an article, any other that of the site.
_TITLED = frozenset("article entry post story".split())
#: Before the name of a part: the layout of something else.
_ABOUT = frozenset("with without has no".split())
_FRAMES = frozenset("wrap wrapper container layout grid row".split())
#: Ancestors that a block passes points to; the next would get less than a hundredth.
REACH = 64


class _Node:
    __slots__ = ("tag", "up", "good", "points", "chars", "linked", "kids")

    def __init__(self, tag: str, up: _Node | None, good: bool):
        self.tag, self.up, self.good = tag, up, good
        self.points, self.chars, self.linked = 0.0, 0, 0
        self.kids: list = []


@lru_cache(1 << 12)
def _words(name: str) -> list[str]:
    return [w for w in re.split(r"[^a-z0-9]+", re.sub(r"(?<=[a-z])(?=[A-Z])", "-", name).lower()) if w]


def _is_part(words: list[str], inside_article: bool) -> bool:
    """Whether a class or id, cut into words, names a part of a page outside its article."""
    for before, word in zip([""] + words, words):
        if before in _ABOUT:
            continue
        if word == "header" and not inside_article and not _TITLED.intersection(words):
            return True
        # The frame around article and sidebar is no sidebar.
        framed = word == "sidebar" and words[-1] in _FRAMES and _GOOD.intersection(words)
        if word in _PARTS and not framed:
            return True
    return False


def _unwanted(tag: str, marks: dict[str, str], inside_article: bool) -> bool:
    if tag in _DROP or (tag == "header" and not inside_article):
        return True
    if not marks or tag in ("html", "body", "article", "main"):
        return False
    if "hidden" in marks or marks.get("aria-hidden", "").lower() == "true" or _INVISIBLE.search("".join(marks.get("style", "").split()).lower()):
        return True
    names = [_words(n) for n in marks.get("class", "").split() + [marks.get("id", ""), marks.get("role", "")]]
    if any(_is_part(n, inside_article) for n in names):
        return True
    found = {w for n in names for at, w in enumerate(n) if not at or n[at - 1] not in _ABOUT}
    return bool(found & (_BAD - _PARTS)) and not found & _GOOD


def _markup(page: str, i: int) -> tuple[int, bool, str, dict[str, str], bool]:
    """What the ``<`` at ``i`` begins: the place after it, whether it is an end tag, name, marks, whether it closes itself.

    The place is ``i + 1`` for a plain character; comments and the like have no name.  Quotes count only where a value
    begins.  A value whose quote never ends goes to the next ``>``; a tag without ``>`` takes the rest of the page.
    """
    n = len(page)
    if page.startswith("<!--", i):
        if page.startswith(">", i + 4) or page.startswith("->", i + 4):
            return page.index(">", i) + 1, False, "", {}, False
        end = page.find("-->", i + 4)
        return (end + 3 if end >= 0 else n), False, "", {}, False
    m = _NAME.match(page, i)
    if not m:
        if page[i + 1:i + 2] not in ("!", "?", "/") or i + 2 >= n:
            return i + 1, False, "", {}, False
        end = page.find(">", i)
        return (end + 1 if end >= 0 else n), False, "", {}, False
    at, marks, closing, tag = m.end(), {}, page[i + 1] == "/", m[1].lower()
    if page.startswith(">", at):
        return at + 1, closing, tag, marks, False
    while True:
        m = _ATTRIBUTE.match(page, at)
        name, at = m[1].lower(), m.end()
        if at >= n:
            return n, False, "", {}, False
        if m[2]:
            if page[at] in "\"'":
                end = page.find(page[at], at + 1)
                value, at = (page[at + 1:end], end + 1) if end >= 0 else ("", max(page.find(">", at), 0) or n)
            else:
                value = _UNQUOTED.match(page, at)[0]
                at += len(value)
        else:
            value = ""
        if name in _MARKS and name not in marks:
            marks[name] = html.unescape(value)
        if at >= n:
            return n, False, "", {}, False
        if page[at] == ">":
            return at + 1, closing, tag, marks, page[at - 1] == "/" and not (m[2] and value.endswith("/"))


def _tree(page: str) -> tuple[list[_Node], list[tuple[_Node, str, int]]]:
    """All elements, each after its parent, and the blocks ``(element, text, characters in links)`` in page order."""
    root = node = _Node("html", None, False)
    nodes = [root]
    blocks: list[tuple[_Node, str, int]] = []
    held: list[str] = []
    links = linked = articles = at = 0
    # The place of the unwanted element among the open ones, if there is one; within it nothing is read.
    dropped = 0
    opened = [root]
    # Places of the open elements by name, and of those that are blocks or unwanted as such: found without a walk.
    places: dict[str, list[int]] = {}
    solid = [0]

    def flush() -> None:
        nonlocal held, linked
        if held:
            text = " ".join("".join(held).split())
            if text:
                blocks.append((node, text, min(linked, len(text))))
        held, linked = [], 0

    def last(tags) -> int:
        return max((places[t][-1] for t in tags if places.get(t)), default=0)

    def enter(fresh: _Node) -> None:
        nonlocal articles
        places.setdefault(fresh.tag, []).append(len(opened))
        if fresh.tag in _BLOCKS or fresh.tag in _DROP:
            solid.append(len(opened))
        opened.append(fresh)
        articles += fresh.tag in ("article", "main")

    def close(to: int) -> None:
        nonlocal node, articles, dropped
        if not dropped or to < dropped:
            flush()
        for gone in opened[to:]:
            articles -= gone.tag in ("article", "main")
            places[gone.tag].pop()
        del opened[to:]
        while solid[-1] >= to:
            solid.pop()
        if to <= dropped:
            dropped = 0
        if not dropped:
            node = opened[-1]

    def put(raw: str) -> None:
        nonlocal linked
        text = html.unescape(raw)
        held.append(text)
        if links:
            linked += len(text.strip())

    i = page.find("<")
    while i >= 0:
        end, closing, tag, marks, alone = _markup(page, i)
        if end == i + 1:
            i = page.find("<", end)
            continue
        if i > at and not dropped:
            put(page[at:i])
        at = end
        foreign = last(_FOREIGN)
        if foreign and not closing and tag in _LEAVES_FOREIGN and last(_HOSTS) < foreign:
            close(places["svg"][0] if places.get("svg") else places["math"][0])
            foreign = 0
        unwanted = tag == "a" and not closing and not dropped and _unwanted(tag, marks, articles > 0)
        if not tag:
            pass
        elif not foreign and not closing and tag in _RAW:
            raw = _RAW[tag].search(page, at)
            at = raw.start() if raw else len(page)
        elif tag in _RAW and closing and not places.get(tag):
            pass
        elif not dropped and tag == "br":
            held.append(" ")
        elif not dropped and tag == "a" and not unwanted:
            links = 0 if closing else 1
        elif closing:
            # The end of an inline element counts only within an unwanted one, where inline elements are held too.
            if tag in _BLOCKS or dropped:
                place = last((tag,))
                if place and (tag in _BLOCKS or place >= dropped):
                    close(place)
                elif not dropped:
                    flush()
        elif tag in _VOID and tag != "hr":
            pass
        elif alone and (foreign or tag in _FOREIGN):
            pass
        else:
            if tag in _BLOCKS:
                top = solid[-1]
                if (tag in _CLOSES_P and opened[top].tag == "p") or (tag != "html" and opened[top].tag == "head"):
                    close(top)
                ends, stops = _ENDS.get(tag, ((), ()))
                place = last(ends)
                if place > last(stops):
                    close(place)
            elif tag == "a" and dropped and last(("a",)) >= dropped:
                close(last(("a",)))
            unwanted = not dropped and tag != "hr" and _unwanted(tag, marks, articles > 0)
            if not dropped and (tag in _BLOCKS or (unwanted and tag in _DROP)):
                flush()
            if tag in _BLOCKS and not dropped and not unwanted:
                links = 0
            if tag in ("html", "hr"):
                pass
            elif dropped or unwanted:
                dropped = dropped or len(opened)
                enter(_Node(tag, None, False))
            elif tag in _BLOCKS:
                names = (marks.get("class", "") + " " + marks.get("id", "")).lower() if marks else ""
                fresh = _Node(tag, node, any(g in names for g in _GOOD))
                node.kids.append(fresh)
                nodes.append(fresh)
                enter(fresh)
                node = fresh
        i = page.find("<", at)
    if at < len(page) and not dropped:
        put(page[at:])
    flush()
    return nodes, blocks


def main_text(page: str | None) -> str:
    nodes, blocks = _tree(page or "")
    if not blocks:
        return ""
    scored: set[_Node] = set()
    for owner, text, linked in blocks:
        points = 0.0 if owner.tag in _HEADINGS else 1 + text.count(",") + min(len(text) // 100, 3)
        # A block that is no paragraph holds its text itself.
        up = owner.up if owner.tag in ("p", "pre", "td", "th", "li", "dd", "blockquote") and owner.up else owner
        step = 1
        while up is not None and step <= 2 * REACH:
            if up not in scored:
                scored.add(up)
                up.points += 25 * (up.tag in ("article", "main")) + 5 * up.good
            up.points += points / step
            step = 2 if step == 1 else step + 2
            up = up.up
        owner.chars += len(text)
        owner.linked += linked
    for n in reversed(nodes[1:]):
        n.up.chars += n.chars
        n.up.linked += n.linked

    def worth(n: _Node) -> float:
        return n.points * (1 - n.linked / max(n.chars, 1))

    # Among equals the first of the page.
    best = max((n for n in nodes if n in scored and n.tag != "html"), key=worth, default=nodes[0])
    kept = {best}
    if best.up is not None:
        for kid in best.up.kids:
            density = kid.linked / max(kid.chars, 1)
            if kid.chars and (worth(kid) >= max(10.0, 0.2 * worth(best)) or (kid.tag == "p" and kid.chars > 80 and density < 0.25)
                              or (kid.tag in _HEADINGS and density < 0.25)):
                kept.add(kid)
    for n in nodes:
        if n.up in kept:
            kept.add(n)
    return " ".join(text for owner, text, _ in blocks if owner in kept)


def _extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b in slices(batch.column(2)):
            texts = [main_text(p.as_py()) for p in batch.column(2).slice(a, b - a)]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.array(texts, pa.string())],
                                             names=["page_id", "url", "text"])


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``(page_id, url, text, n_chars)`` for each page."""
    kinds = [pages.schema[c].dataType.simpleString() for c in (id_col, url_col)]
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    out = rows.mapInArrow(_extracted, f"page_id {kinds[0]}, url {kinds[1]}, text string")
    return out.withColumn("n_chars", F.char_length("text").cast("long"))
