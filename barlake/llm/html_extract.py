"""Main text of web pages by tree scoring.

Paragraphs give points for their length and commas, less their share of link text, to the element that holds them and,
ever less, to the elements above. The element with most points is the article; siblings of it that score well too are
kept. Within what is kept, only elements that are no part of an article (menus, adverts, forms, comments) are left out.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_MARK = re.compile(r"<(?:(!--)|([!?])|(/?)([a-zA-Z][a-zA-Z0-9:_-]*))")
#: The attributes of a tag up to its >; quotes count after an equals sign only, as in browsers.
_REST = re.compile(r"""((?:[^>=]|=\s*"[^"]*"|=\s*'[^']*'|=)*+)>""")
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
_INVISIBLE = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.IGNORECASE)
#: Open elements kept; deeper ones become siblings, as in browsers. Their text stays.
DEPTH = 512

#: Elements whose content is no text of the page.
RAW = frozenset("script style noscript template iframe svg title textarea select object canvas math".split())
#: Elements that are never part of an article.
FRAME = frozenset("nav footer aside form button dialog menu head".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body br center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hr html li main nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: Names (of class, id and role) of elements that are no part of an article.
FRAME_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies "
    "complementary contentinfo disqus footer form gdpr login masthead menu modal nav navbar navigation newsletter notice notices notification pagination "
    "popup promo promotion related respond reply replies search share sharing sidebar signup skip social sponsor sponsored subscribe toolbar widget".split()
)
#: Words that such a name may be joined with, as in site-footer or comment-list.
_BESIDE = frozenset(
    "area articles bar block blocks bottom box button buttons card cards col column container content form global group header icons inner item items left "
    "link links list main media message page panel posts primary reader readers right row secondary section site slot stories top unit user users wrap wrapper".split()
)
_WORDS = re.compile(r"[a-z]+|[A-Z][a-z]*")
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
_HOLDERS = frozenset("article blockquote body center dd details div fieldset figure li main section td".split())
#: Blocks that belong to the article when they stand beside its container.
_BESIDE_BEST = frozenset("h1 h2 h3 h4 h5 h6 p pre".split())


class Node:
    """An element. out: it and all in it is no part of an article; named: so by its name alone, which may be wrong."""

    __slots__ = ("tag", "parent", "out", "named", "link", "score", "depth")

    def __init__(self, tag: str, parent: Node | None, out: bool = False, named: bool = False, link: bool = False):
        self.tag, self.parent, self.out, self.named, self.link, self.score = tag, parent, out, named, link, 0.0
        self.depth = parent.depth + 1 if parent else 0

    def above(self) -> Iterator[Node]:
        node: Node | None = self
        while node:
            yield node
            node = node.parent


def _names_a_frame(name: str) -> bool:
    """Whether a whole name says so: one of FRAME_NAMES, alone or joined with words that leave its meaning."""
    words = [w.lower() for w in _WORDS.findall(name)]
    return not FRAME_NAMES.isdisjoint(words) and all(w in FRAME_NAMES or w in _BESIDE for w in words)


def _node(tag: str, attributes: str, parent: Node) -> Node:
    out = tag in FRAME and tag != "form" or (tag == "header" and not any(n.tag in ("article", "main") for n in parent.above()))
    named = tag == "form"
    if attributes and tag not in ("html", "body"):
        for m in _ATTRIBUTE.finditer(attributes):
            name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
            if name in ("class", "id", "role"):
                named = named or (tag not in ("article", "main") and any(map(_names_a_frame, value.split())))
            elif name == "hidden" or (name == "style" and _INVISIBLE.search(value)):
                out = True
    return Node(tag, parent, parent.out or out, named, parent.link or tag == "a")


def blocks_of(page: str) -> list[tuple[str, Node, float]]:
    """(text, element, share of link text) of each block in page order. Any markup is read, closed or not.

    The time is in proportion to the page: what was once looked for in vain up to the end is not looked for again.
    """
    at_node = Node("html", None)
    open_: Counter[str] = Counter()
    endless: set[str] = set()  # elements that no end tag follows, and the quotes of tags as "="
    blocks: list[tuple[str, Node, float]] = []
    parts: list[str] = []
    linked = total = 0

    def flush() -> None:
        nonlocal parts, linked, total
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                blocks.append((text, at_node, linked / max(total, 1)))
            parts, linked, total = [], 0, 0

    def add(text: str) -> None:
        nonlocal linked, total
        parts.append(text)
        n = len(text.strip())
        total += n
        linked += n * at_node.link

    def close(until: Node | None) -> None:
        nonlocal at_node
        while at_node is not until and at_node.parent:
            open_[at_node.tag] -= 1
            at_node = at_node.parent

    pos, size = 0, len(page)
    while pos < size:
        m = _MARK.search(page, pos)
        end = m and (page.find("-->", m.start() + 2) if m[1] else page.find(">", m.end()))
        if not m or (end < 0 and m[4]):
            add(page[pos:])
            break
        if m.start() > pos:
            add(page[pos : m.start()])
        if not m[4]:
            pos = size if end < 0 else end + (3 if m[1] else 1)
            continue
        tag, attributes = m[4].lower(), ""
        if end > m.end():
            rest = None if "=" in endless else _REST.match(page, m.end())
            if rest:
                attributes, end = rest[1], rest.end() - 1
            else:
                endless.add("=")
                attributes = page[m.end() : end]
        pos = end + 1
        if m[3]:
            if tag in BLOCK:
                flush()
            node = at_node if open_[tag] else None
            while node and node.parent and node.tag != tag:
                node = None if tag not in BLOCK and node.tag in BLOCK else node.parent  # an inline end tag stays in its block
            if node and node.parent:
                close(node.parent)
            continue
        if tag in RAW:
            if not attributes.endswith("/") and tag not in endless:
                found = re.compile(rf"</{tag}[\s/>]", re.IGNORECASE).search(page, pos)
                if found:
                    end = page.find(">", found.end() - 1)
                    pos = size if end < 0 else end + 1
                elif tag in ("script", "style"):
                    pos = size
                else:
                    endless.add(tag)
            continue
        if tag in BLOCK:
            flush()
        if tag in VOID:
            continue
        if tag in BLOCK:
            node = at_node
            while node.tag not in BLOCK and node.parent:
                node = node.parent
            if node.tag == "p" or (node.tag[:1] == "h" and node.tag[1:].isdigit()):
                close(node.parent)
            closes = _CLOSES.get(tag)
            node = at_node
            while closes and node.parent and node.tag not in ("ul", "ol", "dl", "table"):
                if node.tag in closes:
                    close(node.parent)
                    if tag != "tr" or node.tag == "tr":
                        break
                node = node.parent
        if tag in ("html", "body") and at_node.tag in ("html", "body") and at_node.tag == tag:
            continue
        made = _node(tag, attributes, at_node)
        if at_node.depth >= DEPTH:
            close(at_node.parent)
            made.parent, made.depth = at_node, at_node.depth + 1
        at_node = made
        open_[tag] += 1
    flush()
    return blocks


def _article_blocks(found: list[tuple[str, Node, float]]) -> tuple[list[str], float]:
    """The texts of the best container and of what belongs to it, and its score."""
    scored: list[Node] = []
    for text, node, links in found:
        holder = node if node.tag in _HOLDERS else node.parent
        while holder and holder.parent and holder.tag not in _HOLDERS:
            holder = holder.parent
        points = (1 + text.count(",") + min(len(text) / 100, 3)) * (1 - links)
        share = 1.0
        while holder and share > 0.1:
            if not holder.score:
                scored.append(holder)
            holder.score += points * share
            share *= 0.5
            holder = holder.parent
    if not scored:
        return [], 0.0
    best = max(scored, key=lambda n: n.score * (1.5 if n.tag in ("article", "main") else 1))
    score = best.score
    for node in best.above():
        if node.tag in ("article", "main"):
            best = node
    kept = {id(best)}
    for n in scored:
        if n.parent is best.parent and n is not best and n.score >= max(3.0, 0.2 * best.score):
            kept.add(id(n))
    if best.tag == "article":  # an article in parts
        length: Counter[int] = Counter()
        linked: Counter[int] = Counter()
        for text, node, links in found:
            for n in node.above():
                if n.tag == "article" and n.parent is best.parent:
                    length[id(n)] += len(text)
                    linked[id(n)] += links * len(text)
        kept |= {n for n in length if linked[n] < 0.5 * length[n]}
    lines = []
    for text, node, links in found:
        beside = node.parent is best.parent and node.tag in _BESIDE_BEST and links < 0.5
        if beside or any(id(n) in kept for n in node.above()):
            lines.append(text)
    return lines, score


def extract(page: str | None) -> str:
    """The article's blocks, one a line; empty if there is no text.

    What a name says is not believed of an element that holds the article: where all article and main elements
    (or, on a page without them, all paragraphs of some length) lie within so named ones, names above them do not count.
    """
    blocks = [b for b in blocks_of(page or "") if not b[1].out]
    tops = {id(n): n for _, node, _ in blocks for n in node.above() if n.tag in ("article", "main")}
    if tops and all(any(n.named for n in top.above()) for top in tops.values()):
        for top in tops.values():
            for n in top.above():
                n.named = False
    lines, _ = _article_blocks([b for b in blocks if not any(n.named for n in b[1].above())])
    if not lines:
        lines, score = _article_blocks([b for b in blocks if b[1].tag in ("p", "div", "section", "td", "body")])
        if score <= 4 or not any(len(x) > 80 for x in lines):
            lines = []
    return "\n".join(lines)


def extract_pages(pages: DataFrame, key: str = "page_id", url: str = "url", content: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) for each row of pages, from the whole html.

    A null or empty html, or one without text outside menus and the like, has an empty text of 0 characters. Broken
    markup is read as far as it goes. Repeated rows each give their row; other columns are not read; memory follows
    the longest single page.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [extract(x.as_py()) for x in batch.column(2)]
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], ["page_id", "url", "text", "n_chars"])

    kind = dict(pages.dtypes)[key]
    base = pages.select(F.col(key).alias("page_id"), F.col(url).cast("string").alias("url"), F.col(content).cast("string"))
    return base.mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long")
