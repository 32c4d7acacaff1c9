"""HTML extraction by composite text density.

Every node of a page's tree gets the density of its text: characters per tag, lowered as more of the characters and
tags belong to links. The node whose children's densities have the largest sum is the core of the article; the least
density on the path from it to the body is the threshold by which its surroundings join it. Words of class, id and role
are only a weight: the core lies outside blocks that they speak against, unless the sums inside are ten times as large.
Such blocks are taken out of the subtree that was found, but never one that holds the core.

A page is read once from left to right; no input, however broken, takes more than linear time.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

#: A tag: its name and its attributes. A quote counts only after ``=``; one that is never closed is an ordinary character.
_TAG = re.compile(r"""</?([a-zA-Z][^\s/>]*+)((?:=\s*+(?:"[^"]*+"|'[^']*+'|[^\s>]*+)|[^>=])*+)>""")
_COMMENT = re.compile(r"<!--(?:-?>|.*?--!?>)", re.S)
_ATTRIBUTE = re.compile(r"""([^\s"'=/]++)(?:\s*+=\s*+("[^"]*+"|'[^']*+'|[^\s>]++))?+""")
_LONG_NUMBER = re.compile("&#0*+[0-9]{8,}+;?")
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content isn't markup and isn't the article's text.
_RAW = {tag: re.compile(rf"</{tag}(?=[\s/>])", re.I) for tag in "script style textarea title xmp noframes iframe noembed".split()}
#: Elements that never hold the article's text.
_DROP = frozenset("head nav header footer aside noscript template button select object svg canvas dialog menu audio video".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
#: Opening one of these ends an open paragraph; list items, cells and the like end their own kind.
_BLOCK = frozenset("address article aside blockquote center details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
_SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "p": {"p"}}
_SCOPE = frozenset("ul ol dl table tbody thead tfoot div section article body html select blockquote main".split())
_HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
#: A core of this kind is a part of a text and never all of it.
_PART = frozenset("p li dt dd td th tr tbody br pre blockquote".split()) | _HEADING
#: Words of class, id and role that mark what is not the article; a name with one of the second list says that it is absent or elsewhere.
_NOISE = frozenset(
    "ad ads advert advertisement adverts banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer masthead menu modal nav navbar navigation newsletter notice notices overlay pagination popup promo promoted "
    "related respond share sharing sidebar social sponsor sponsored subscribe subscription toolbar complementary contentinfo search widget widgets alert".split()
)
_NOT_NOISE = frozenset("no not has with without hide".split())
#: What a sum of densities inside a block with such words counts.
NOISE_WEIGHT = 0.1


class Node:
    """An element; ``kind`` is 2 for what never holds the article, 1 for what its words speak against, otherwise 0."""

    __slots__ = ("tag", "parent", "stop", "parts", "kind", "inside", "chars", "tags", "link_chars", "link_tags", "density", "total")

    def __init__(self, tag: str, parent: Node | None, kind: int = 0):
        self.tag, self.parent, self.parts, self.kind = tag, parent, [], kind
        self.inside = max(kind, parent.inside) if parent else kind
        self.stop = self if tag in _SCOPE or tag in _SAME or parent is None else parent.stop  # the nearest element that implied end tags may stop at
        self.chars = self.tags = self.link_chars = self.link_tags = 0
        self.density = self.total = 0.0


def _kind(tag: str, attributes: str) -> int:
    if tag in _DROP:
        return 2
    kind = int(tag == "form")
    for name, value in _ATTRIBUTE.findall(attributes) if attributes else ():
        name, value = name.lower(), value.strip("\"'").lower()
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none", value):
            return 2
        if name in ("class", "id", "role") and tag not in ("html", "body", "main"):
            for word in value.split():
                words = set(re.split(r"[^a-z0-9]+", word))
                if words & _NOISE and not words & _NOT_NOISE and (tag != "article" or words & {"comment", "comments"}):
                    kind = 1
    return kind


def _text(piece: str) -> str:
    """Character references decoded; numbers too long to be a character give the replacement character."""
    return html.unescape(_LONG_NUMBER.sub("\ufffd", piece)) if "&" in piece else piece


def parse(page: str) -> Node:
    """The tree of a page. Missing and stray end tags are tolerated; a tag or comment that is cut off ends the page."""
    node = root = Node("html", None)
    is_open: dict[str, int] = {}  # how many elements of a name are open
    at, end = 0, len(page)

    def close(to: Node) -> Node:
        """Ends all elements up to and with ``to``."""
        up = node
        while up is not to:
            is_open[up.tag] -= 1
            up = up.parent
        is_open[to.tag] -= 1
        return to.parent

    begin = 0  # of the text not yet added
    while at < end:
        at = page.find("<", at)
        nxt = page[at + 1 : at + 2] if at >= 0 else ""
        if at < 0:
            break
        if not (nxt.isascii() and nxt.isalpha() or nxt in ("!", "?", "/")) or not nxt:
            at += 1
            continue
        if begin < at:
            node.parts.append(_text(page[begin:at]))
        if nxt in "!?" or nxt == "/" and not ((c := page[at + 2 : at + 3]).isascii() and c.isalpha()):
            if page.startswith("<!--", at):
                m = _COMMENT.match(page, at)
                begin = at = m.end() if m else end
            else:
                stop = page.find(">", at)
                begin = at = stop + 1 if stop >= 0 else end
            continue
        m = _TAG.match(page, at)
        if not m:
            begin = end
            break
        begin = at = m.end()
        tag = m[1].lower()
        if nxt == "/":
            if is_open.get(tag):
                up = node
                while up.tag != tag:
                    up = up.parent
                node = close(up)
            elif tag == "p":
                node.parts.append(Node("p", node))
            continue
        if tag in _RAW:
            stop = _RAW[tag].search(page, at)
            at = page.find(">", stop.end()) + 1 if stop else end
            begin = at = at or end
            continue
        if tag in ("html", "body"):
            continue
        if tag in _BLOCK or tag in _SAME:
            closes, up = _SAME.get(tag, {"p"}), node.stop
            while up.parent is not None and up.tag not in closes and up.tag not in _SCOPE:
                up = up.parent.stop
            if up.tag in closes and up.parent is not None:
                node = close(up)
        child = Node(tag, node, _kind(tag, m[2]))
        node.parts.append(child)
        if tag not in _VOID and not (child.kind == 2 and m[2].endswith("/")):
            is_open[tag] = is_open.get(tag, 0) + 1
            node = child
    if begin < end:
        node.parts.append(_text(page[begin:]))
    return root


def _ordered(root: Node) -> list[Node]:
    out = [root]
    for node in out:
        out += [p for p in node.parts if isinstance(p, Node)]
    return out


def _density(chars: int, tags: int, link_chars: int, link_tags: int, share: float) -> float:
    """Characters per tag, times a factor that falls with the part of characters and tags in links; share: of the page."""
    ratio = max(chars / max(link_chars, 1) * tags / max(link_tags, 1), 1.0)
    scale = math.log(chars / max(chars - link_chars, 1) * link_chars + share * chars + math.e)
    return chars / tags * math.log(ratio) / (1.0 + math.log(scale))


def _weigh(nodes: list[Node], kind: int) -> Node:
    """Fills in counts, densities and sums of densities of what is below ``kind``, leaves first; the node of the largest sum."""
    for node in reversed(nodes):
        node.chars = node.tags = node.link_chars = node.link_tags = 0
        for part in node.parts:
            if isinstance(part, str):
                node.chars += len("".join(part.split()))
            elif part.kind < kind:
                node.chars += part.chars
                node.tags += part.tags + 1
                node.link_chars += part.link_chars
                node.link_tags += part.link_tags + (part.tag == "a")
        if node.tag == "a":
            node.link_chars, node.link_tags = node.chars, node.tags
    share = nodes[0].link_chars / max(nodes[0].chars, 1)
    for node in nodes:
        some = node.chars and node.inside < kind
        node.density = _density(node.chars, max(node.tags, 1), node.link_chars, node.link_tags, share) if some else 0.0
    for node in nodes:
        node.total = sum(p.density for p in node.parts if isinstance(p, Node)) or node.density * 0.5
    return max((n for n in nodes if n.inside < kind and n.tag not in _INLINE or n.parent is None), key=lambda n: n.total)


def _article(root: Node) -> tuple[Node, Node]:
    """The subtree of the article, and its core."""
    nodes = _ordered(root)
    noisy = any(n.kind == 1 for n in nodes)
    other = _weigh(nodes, 2) if noisy else root
    most = other.total
    core = _weigh(nodes, 1)
    if noisy and other.inside and core.total < NOISE_WEIGHT * most:
        core = _weigh(nodes, 2)
    threshold, up = core.density, core
    while up is not None:
        threshold, up = min(threshold, up.density), up.parent

    def joins(part: Node | str) -> bool:
        return isinstance(part, Node) and part is not top and not part.kind and part.chars > 0 and (part.density >= threshold or part.tag in _HEADING)

    top = core
    while top.parent is not None and (top.tag in _PART or any(joins(p) for p in top.parent.parts)):
        top = top.parent
    return top, core


def _collect(top: Node, core: Node) -> str:
    """The text below top without the blocks that aren't the article; those that hold the core stay."""
    held = set()
    while core is not None:
        held.add(id(core))
        core = core.parent
    out: list[str] = []
    stack: list = [top]
    while stack:
        part = stack.pop()
        if isinstance(part, str):
            out.append(part)
        elif part.kind and id(part) not in held:
            out.append(" ")
        elif part.tag in _INLINE:
            stack += reversed(part.parts)
        else:
            stack.append(" ")
            stack += reversed(part.parts)
            out.append(" ")
    return " ".join("".join(out).split())


def main_text(page: str | None) -> str:
    """The article of one page, its white space turned into single spaces; empty if the page has no text."""
    return _collect(*_article(parse(page))) if page else ""


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars): the main text of every page, and its code points.

    Null and empty html give an empty text; every row gives one row, whatever its id and url, repeated or null, so an
    empty table gives none. Other columns are left out.
    """
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x.as_py()) for x in batch["html"]]
            yield pa.RecordBatch.from_arrays([batch["page_id"].cast(pa.int64()), batch["url"].cast(pa.string()), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], schema=schema)

    return pages.select("page_id", "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")
