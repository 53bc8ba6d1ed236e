"""Main text of web pages by consensus host paths.

A first pass scores the containers of every page by the share of its unlinked text that they hold, and names each by its
generalised path of tags and classes. The pages of a host vote in Spark; a second pass extracts from the container on
the host's winning path, and from the page's own best container where a page does not have that path.

Tags and roles say what is not part of an article. A word of a class or id says so only if enough of the page's text
lies outside the element: a wrapper of everything is not a sidebar, whatever it is called.
"""

from __future__ import annotations

import html as references
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import salt_mask, salt_of, salts_in, saved

# Fixed values of HTML.
RAW = {"script", "style", "textarea", "title", "iframe", "noscript", "template", "svg", "xmp", "math", "object", "canvas"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
INLINE = {
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label",
    "mark", "q", "rb", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var",
}
CONTAINERS = {"article", "main", "section", "div", "td", "body", "center", "dd", "li"}
# Raw elements that may stand inside a paragraph without ending it.
SILENT = {"script", "style", "noscript", "template"}
HEADINGS = {"h1"}
# Elements that an opening tag ends where their own end tag is left out.
ENDS_PARAGRAPH = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "dt"}
SAME_ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
BARRIERS = {"ul", "ol", "dl", "table", "select", "article", "section", "div", "body"}

# Parts of a page that are not its article: by tag, by role, and by a word of their class or id.
ASIDE_TAGS = {"nav", "footer", "aside", "form", "button", "select", "menu", "dialog", "head"}
ASIDE_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "menu", "menubar"}
ASIDE_WORDS = {
    "ad", "ads", "advert", "adverts", "advertisement", "advertising", "banner", "breadcrumb", "breadcrumbs", "comment", "comments", "consent",
    "cookie", "cookies", "discussion", "disqus", "footer", "gdpr", "header", "masthead", "menu", "modal", "nav", "navbar", "navigation", "newsletter",
    "notice", "notices", "pager", "pagination", "popup", "promo", "recommended", "related", "replies", "respond", "share", "sharing", "sidebar", "skip",
    "social", "sponsor", "sponsored", "subscribe", "toolbar", "topbar", "widget",
}
# Of these, words for what readers write; any text outside such an element is enough.
COMMENT_WORDS = {"comment", "comments", "discussion", "disqus", "replies", "respond"}
MAIN_WORDS = {"article", "body", "content", "entry", "main", "post", "story", "text"}
# Words that turn the next or the last one around: has-sidebar, comments-open.
BEFORE, AFTER = {"has", "hide", "no", "not", "with", "without"}, {"closed", "disabled", "enabled", "none", "off", "on", "open"}

# An element is no aside by its words if less than this share of the page's text lies outside of it.
REST = 0.15
# The best container is the innermost one with this share of the page's text.
COVER = 0.85

TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>\"'=]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?/][^>]*>", re.S)
ATTRIBUTE = re.compile(r"([^\s=/\"']+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"']+))", re.S)
WORDS = re.compile(r"[a-z]+|[A-Z][a-z]*")


@dataclass
class Element:
    tag: str
    path: str
    aside: bool
    parent: int
    suspect: int = 0  # by its words: 1; as reader comments: 2
    cells: int = 0  # table cells in it so far


@dataclass
class Block:
    owner: int  # the element that holds it
    text: str
    linked: int  # characters in links


@dataclass
class Page:
    elements: list[Element] = field(default_factory=list)
    blocks: list[Block] = field(default_factory=list)


def _names(attributes: str) -> tuple[list[str], str]:
    """The classes and id of a tag, and its role."""
    names, role = [], ""
    if "=" in attributes:
        for name, *values in ATTRIBUTE.findall(attributes):
            value = references.unescape(values[0] or values[1] or values[2])
            if name.lower() in ("class", "id"):
                names += value.split()
            elif name.lower() == "role":
                role = value.strip().lower()
            elif name.lower() in ("hidden", "aria-hidden") and value.lower() == "true":
                role = "dialog"
    return names, role


def _suspect(names: list[str], in_article: bool) -> int:
    """Whether the words of classes and ids speak of something other than the article: 1, of comments: 2."""
    found: set[str] = set()
    spared = in_article
    for name in names:
        words = [w.lower() for w in WORDS.findall(name)]
        spared |= bool(MAIN_WORDS.intersection(words))
        for i, word in enumerate(words):
            if word in ASIDE_WORDS and not (i and words[i - 1] in BEFORE) and not (i + 1 < len(words) and words[i + 1] in AFTER):
                found.add(word)
    if spared:
        found.discard("header")
    return 2 if found & COMMENT_WORDS else int(bool(found))


def _general(name: str) -> str:
    """A class without its numbers; one that is mostly number or hash says nothing."""
    found = re.sub(r"\d+", "#", name.lower())
    return "" if found.count("#") > 1 or found == "#" else found


def parse(html: str) -> Page:
    """Elements and text blocks in page order. Inline tags are no elements; unclosed and stray tags do no harm."""
    page = Page([Element("html", "", False, -1)])
    stack, buffer, links = [0], [], 0
    linked, at, n = 0, 0, len(html)

    def flush() -> None:
        nonlocal linked
        text = " ".join(references.unescape("".join(buffer)).split())
        if text:
            page.blocks.append(Block(stack[-1], text, linked))
        buffer.clear()
        linked = 0

    def close(names: set[str], barriers: set[str] = frozenset()) -> None:
        for depth in range(len(stack) - 1, 0, -1):
            tag = page.elements[stack[depth]].tag
            if tag in names:
                del stack[depth:]
                return
            if tag in barriers:
                return

    while at < n:
        match = TAG.search(html, at)
        if match is None:
            buffer.append(html[at:])
            break
        if match.start() > at:
            text = html[at : match.start()]
            buffer.append(text)
            linked += len(text) * (links > 0)
        at = match.end()
        if match[2] is None:
            continue
        ends, tag = match[1] == "/", match[2].lower()
        if tag in INLINE:
            if tag == "a":
                links = max(0, links + (-1 if ends else 1))
            continue
        if tag in VOID:
            buffer.append(" ")
            if tag == "hr":
                flush()
            continue
        if tag not in SILENT:
            flush()
            links = 0
        if tag in RAW:
            if not ends:
                end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(html, at)
                at = end.end() if end else n
            continue
        if ends:
            close({tag})
            continue
        if tag == "html":
            continue
        close(ENDS_PARAGRAPH, BARRIERS)
        if tag in SAME_ENDS:
            close(SAME_ENDS[tag], {"ul", "ol", "dl", "table", "select"})
        parent = page.elements[stack[-1]]
        names, role = _names(match[3])
        in_article = "/article" in parent.path or "/main" in parent.path or tag in ("article", "main")
        aside = parent.aside or tag in ASIDE_TAGS or role in ASIDE_ROLES or (tag == "header" and not in_article)
        suspect = 0 if tag in ("body", "main") else _suspect(names, in_article)
        general = sorted({g for g in map(_general, names) if g})
        if tag in ("td", "th"):  # the columns of a layout table are places of their own
            parent.cells += 1
            general.append(str(parent.cells))
        page.elements.append(Element(tag, f"{parent.path}/{'.'.join([tag, *general])}", aside, stack[-1], suspect))
        stack.append(len(page.elements) - 1)
    flush()
    _settle(page)
    return page


def _weights(page: Page) -> list[int]:
    """Characters of unlinked text below each element, without what is aside."""
    held = [0] * len(page.elements)
    for block in page.blocks:
        if not page.elements[block.owner].aside:
            held[block.owner] += max(0, len(block.text) - block.linked)
    for number in range(len(held) - 1, 0, -1):  # children come after their parents
        held[page.elements[number].parent] += held[number]
    return held


def _settle(page: Page) -> None:
    """Let suspect elements be asides where enough of the page's text lies outside of them and of other suspects."""
    held = _weights(page)
    ends = list(range(1, len(held) + 1))  # an element and all below it are neighbours
    for number in range(len(held) - 1, 0, -1):
        parent = page.elements[number].parent
        ends[parent] = max(ends[parent], ends[number])
    suspects = [i for i, e in enumerate(page.elements) if e.suspect and not e.aside]
    for number in suspects:
        if page.elements[number].aside:
            continue
        # Other suspects, but for those that hold this one: what lies before it and after it.
        around = [i for i in suspects if i != number and not (number < i < ends[number]) and not (i < number < ends[i])]
        others, at = 0, 0
        for i in around:
            if i >= at:
                others, at = others + held[i], ends[i]
        rest = held[0] - held[number] - others
        if rest >= REST * held[0] or (rest > 0 and page.elements[number].suspect == 2):
            for below in range(number, ends[number]):
                page.elements[below].aside = True


def container_scores(page: Page) -> dict[str, float]:
    """Path -> score of the page's containers: the innermost ones with most of the text; an article or main around it first."""
    held, scores = _weights(page), {}
    if not held[0]:
        return scores
    depth = [0] * len(held)
    inside = [-1] * len(held)  # the outermost article or main around an element
    for number, element in enumerate(page.elements):
        if number:
            depth[number] = depth[element.parent] + 1
            inside[number] = inside[element.parent] if inside[element.parent] >= 0 else number if element.tag in ("article", "main") else -1
        if element.tag in CONTAINERS and not element.aside and held[number] >= COVER * held[0]:
            chosen = page.elements[inside[number] if inside[number] >= 0 else number].path
            scores[chosen] = max(scores.get(chosen, 0.0), 1.0 + depth[number])
    return scores


def best_path(scores: dict[str, float]) -> str | None:
    return min(scores, key=lambda path: (-scores[path], path), default=None)


def text_on(page: Page, path: str) -> str:
    """All text inside the elements on a path, without what is aside, and the page's main headings if it has none."""
    inside = [element.path == path for element in page.elements]
    for number, element in enumerate(page.elements):  # parents come before their children
        inside[number] |= element.parent >= 0 and inside[element.parent]
    blocks = [b for b in page.blocks if not page.elements[b.owner].aside]
    taken = [inside[b.owner] for b in blocks]
    heading = [page.elements[b.owner].tag in HEADINGS for b in blocks]
    headed = any(t and h for t, h in zip(taken, heading))
    return "\n".join(b.text for b, t, h in zip(blocks, taken, heading) if t or (h and not headed and any(taken)))


def page_text(page: Page, path: str | None) -> str:
    """The text on the host's path; without any, that on the page's own best one, or else all that is not aside."""
    text = text_on(page, path) if path else ""
    own = best_path(container_scores(page)) if not text else None
    return text or (text_on(page, own) if own else "\n".join(b.text for b in page.blocks if not page.elements[b.owner].aside))


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; null or no :// is the empty host."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"^[\s\S]*?://([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def page_votes(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """host, path, weight: each page gives its best container one vote, and shares of one to those around it."""

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hosts, paths, weights = [], [], []
            for host, html in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                scores = container_scores(parse(html or ""))
                top = max(scores.values(), default=0.0)
                for path, score in scores.items():
                    if score > 0:
                        hosts.append(host)
                        paths.append(path)
                        weights.append(int(1000 * score / top))
            yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(paths, pa.string()), pa.array(weights, pa.int64())], ["host", "path", "weight"])

    return pages.select(host_of(F.col(url_col)).alias("host"), F.col(html_col)).mapInArrow(vote, "host string, path string, weight long")


def winning_paths(votes: DataFrame) -> DataFrame:
    """host, path: the path of most votes (whole numbers, so their order doesn't matter); ties: the first path."""
    counted = votes.groupBy("host", "path").agg(F.sum("weight").alias("weight"))
    most = counted.groupBy("host").agg(F.max("weight").alias("weight"))
    return counted.join(most, ["host", "weight"]).groupBy("host").agg(F.min("path").alias("path"))


def main_texts(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row for each page: page_id, url, text, n_chars.

    Null html is empty, and a page without text has an empty one. Pages without a host vote together. Rows that repeat a
    page are extracted each. Other columns are ignored. An empty table gives no rows.
    """
    winners = saved(winning_paths(page_votes(pages, id_col, url_col, html_col)), "paths")
    rows = pages.select(
        F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"), host_of(F.col(url_col)).alias("host"),
        salt_of(F.col(id_col)).alias("salt"),
    )
    salts = rows.groupBy("host", "salt").count().groupBy("host").agg(salt_mask("salt").alias("mask"))
    spread = winners.join(salts, "host").select("host", "path", salts_in("mask").alias("salt"))
    joined = rows.join(spread, ["host", "salt"], "left").select("page_id", "url", "html", "path")

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [page_text(parse(html or ""), path) for html, path in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    kind = pages.schema[id_col].dataType.simpleString()
    return joined.mapInArrow(extract, f"page_id {kind}, url string, text string, n_chars long")
