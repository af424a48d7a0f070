"""Main text of web pages by consensus paths of their host.

Each page scores its containers by the text they hold and names the path of the
best one: tags and classes from the root, digits generalised. Spark counts these
votes per host. Every page is then read again with the winning paths of its host;
the next path, and at last the page's own best container, stand in where a page
lacks them.

Names and tags that mark what isn't the article are evidence. Layout words on a wrapper
(``has-sidebar``, a form around the whole page, a widget that holds most of the text)
don't count against what is inside, ``article`` and ``main`` start afresh below most
marks, and where marks would leave nothing, those of names give way.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from html import unescape
from typing import NamedTuple

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seepage.llm.common import RowBatches
from seepage.llm.url_filter import host_of
from seepage.operators.skew import lookup, top_per_group
from seepage.session import fits_broadcast, materialise

PATHS = 3  # winning paths kept per host
WINNER_ROWS = 200_000  # hosts with winners up to which they are broadcast
LONGEST_PATH = 400  # characters up to which a path is spelled out; beyond, a hash stands for its start
# element names: fixed values
RAW = {"script", "style", "textarea", "template", "iframe", "noscript", "svg", "title", "xmp", "noembed", "noframes"}
VOID = {"area", "base", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr", "br"}
INLINE = set("a abbr b bdi bdo big cite code del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var".split())
LEAVES = set("p h1 h2 h3 h4 h5 h6 li dt dd pre figcaption caption td th tr".split())
OUTSIDE = set("head nav header footer aside form button select option fieldset menu dialog object audio video canvas".split())
ENDS_ITS_LIKE = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
HOLDS = {"ul", "ol", "table", "dl", "body", "div", "article", "section", "main"}
# words in a class or id that mark what isn't the article: fixed values
ASIDE_WORDS = set(
    "ad ads adbox adslot advert adverts advertisement sponsor sponsored promo promotion banner nav navbar navigation menu "
    "breadcrumb breadcrumbs header masthead footer sidebar aside widget related recommended share sharing social comment "
    "comments respond reply replies disqus cookie cookies consent notice alert popup modal overlay newsletter subscribe "
    "signup login form search pagination pager toolbar skip".split()
)

# words that also name parts of a layout around an article, and words that never do: fixed values
LAYOUT_WORDS = set("widget header banner form search promo toolbar navbar signup login social".split())
FINAL_WORDS = set("comment comments respond reply replies disqus related recommended".split())
# a name that begins so tells what a wrapper has or lacks, one that ends so its state: fixed values
HAVING = set("has have no not with without is show hide".split())
STATES = set("open closed on off enabled disabled active visible".split())
# how strongly an element is marked as no article
LAYOUT, NAMED, FINAL, TAGGED = 1, 2, 3, 4

START = re.compile(r"<!--|<(?P<close>/?)(?P<name>[a-zA-Z][a-zA-Z0-9:-]{0,40})|<[!?]")
SPECIAL = re.compile(r"[\"'>]")
MARK = re.compile(r"""(?:^|\s)(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
PIECE = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


class Element(NamedTuple):
    parent: int
    tag: str
    path: str
    mark: int


class Block(NamedTuple):
    element: int
    text: str
    linked: int


def strength(value: str) -> int:
    """How strongly the names in a class, id or role mark an element as no article."""
    mark = 0
    for name in value.split():
        pieces = [w.lower() for w in PIECE.findall(name)]
        if not pieces or (len(pieces) > 1 and (pieces[0] in HAVING or pieces[-1] in STATES)):
            continue
        for piece in pieces:
            if piece in ASIDE_WORDS:
                mark = max(mark, FINAL if piece in FINAL_WORDS else LAYOUT if piece in LAYOUT_WORDS else NAMED)
    return mark


def step_of(tag: str, rest: str) -> tuple[str, int]:
    """The element's step in a path, and how strongly its names mark it as no article."""
    classes, mark = "", 0
    for name, value in MARK.findall(rest):
        value = value.strip("\"'")
        if name.lower() == "class":
            classes = ".".join(sorted(re.sub(r"\d+", "N", value).split()))
        mark = max(mark, strength(value))
    return (f"{tag}.{classes}" if classes else tag), mark


def longer(path: str, step: str) -> str:
    """The path one step further; different paths stay different, however long."""
    path = f"{path}/{step}"
    return path if len(path) <= LONGEST_PATH else f"#{xxhash.xxh3_128_hexdigest(path.encode('utf-8', 'replace'))}"


class Tag(NamedTuple):
    start: int
    end: int
    name: str | None
    closing: bool
    rest: str


class Tags:
    """Tags of a page from any place on, however long they and their quoted values are.

    A ``>`` in quotes ends no tag, unless no other one follows. Quotes from which no
    end was found are remembered, so that all searches together stay linear.
    """

    def __init__(self, html: str) -> None:
        self.html = html
        self.dead: set[int] = set()
        self.last = html.rfind(">")

    def end_of(self, at: int) -> int:
        """The place of the ``>`` that ends a tag whose name ends at ``at``; -1 if there is none."""
        if at > self.last:
            return -1
        seen = []
        place = at
        while (found := SPECIAL.search(self.html, place)) and found[0] != ">":
            quote = found.start()
            if quote in self.dead:
                break
            seen.append(quote)
            place = self.html.find(found[0], quote + 1) + 1
            if not place:
                break
        else:
            if found:
                return found.start()
        self.dead.update(seen)
        return self.html.find(">", at)

    def next(self, at: int) -> Tag | None:
        """The next tag or comment start at or after ``at``."""
        while found := START.search(self.html, at):
            at = found.end()
            if found[0] == "<!--":
                return Tag(found.start(), at, "!--", False, "")
            end = self.end_of(at) if found["name"] else self.html.find(">", at) if at <= self.last else -1
            if end >= 0:
                return Tag(found.start(), end + 1, found["name"], bool(found["close"]), self.html[at:end])
            at = found.start() + 1
        return None


def parse(html: str) -> tuple[list[Element], list[Block]]:
    """Elements that hold blocks, and the blocks of text in page order."""
    elements = [Element(-1, "", "", 0)]
    blocks: list[Block] = []
    stack = [0]
    buffer: list[str] = []
    links = linked = 0

    def flush() -> None:
        nonlocal linked
        text = " ".join(unescape("".join(buffer)).split())
        if text:
            blocks.append(Block(stack[-1], text, linked))
        buffer.clear()
        linked = 0

    def add(text: str) -> None:
        nonlocal linked
        buffer.append(text)
        if links:
            linked += len(text)

    at = 0
    lower = None
    tags = Tags(html)
    while found := tags.next(at):
        add(html[at : found.start])
        at = found.end
        if found.name == "!--":
            end = html.find("-->", at)
            at = len(html) if end < 0 else end + 3
            continue
        if not found.name:
            continue
        tag, closing = found.name.lower(), found.closing
        if tag in RAW and not closing and not (tag == "svg" and found.rest.endswith("/")):
            lower = lower or html.lower()
            end = lower.find(f"</{tag}", at) if len(lower) == len(html) else html.find(f"</{found.name}", at)
            at = len(html) if end < 0 else end
        elif tag in VOID or tag == "svg":
            add(" ")
            if tag == "hr":
                flush()
        elif tag in INLINE:
            if tag == "a":
                links = 0 if closing else 1
        elif closing:
            flush()
            depth = next((d for d in range(len(stack) - 1, 0, -1) if elements[stack[d]].tag == tag), 0)
            if depth:
                del stack[depth:]
        else:
            flush()
            ends = ENDS_ITS_LIKE.get(tag, {"p"} if tag not in LEAVES or tag[0] == "h" else ())
            for d in range(len(stack) - 1, 0, -1):
                name = elements[stack[d]].tag
                if name in ends:
                    del stack[d:]
                elif name in HOLDS:
                    break
            above = elements[stack[-1]]
            step, mark = step_of(tag, found.rest)
            if tag in ("html", "body", "article", "main"):
                mark = mark if tag == "article" and mark == FINAL else 0
            elif tag in OUTSIDE and not (tag == "header" and any(elements[i].tag in ("article", "main") for i in stack)):
                mark = LAYOUT if tag == "form" else TAGGED
            elements.append(Element(stack[-1], tag, longer(above.path, step), mark))
            stack.append(len(elements) - 1)
    add(html[at:])
    flush()
    return elements, blocks


def container(elements: list[Element], i: int) -> int:
    """The nearest element at or above ``i`` that isn't a single block of text."""
    while i > 0 and elements[i].tag in LEAVES:
        i = elements[i].parent
    return i


def _levels(elements: list[Element], frames: set[int]) -> list[int]:
    """The strongest mark at or above each element; article and main lift those that aren't final."""
    out: list[int] = []
    for i, element in enumerate(elements):
        above = out[element.parent] if element.parent >= 0 else 0
        if element.tag in ("article", "main") and above < FINAL:
            above = 0
        out.append(max(above, 0 if i in frames else element.mark))
    return out


def outside(elements: list[Element], blocks: list[Block]) -> list[bool]:
    """Which elements are no part of the article, as far as tags and names tell.

    An element with a layout mark that holds most of the text not marked more
    strongly is a frame of the page, a form only if it has blocks of its own inside.
    """
    if not any(e.mark for e in elements):
        return [False] * len(elements)
    levels = _levels(elements, set())
    held, own = [0] * len(elements), [0] * len(elements)
    for block in blocks:
        if levels[block.element] <= LAYOUT:
            own[block.element] += len(block.text) - block.linked
            held[block.element] += len(block.text) - block.linked
    for i in range(len(elements) - 1, 0, -1):
        held[elements[i].parent] += held[i]
    frames = {
        i
        for i, e in enumerate(elements)
        if e.mark == LAYOUT and 2 * held[i] > held[0] and (e.tag != "form" or 2 * own[i] < held[i])
    }
    levels = _levels(elements, frames) if frames else levels
    used = {levels[b.element] for b in blocks}
    # where nothing else is left, the marks of names give way, weaker ones first
    most = min(used, default=0)
    allowed = most if most < TAGGED else 0
    if allowed and not _reads(elements, [b for b in blocks if levels[b.element] <= allowed]):
        allowed = 0
    return [level > allowed for level in levels]


def _reads(elements: list[Element], blocks: list[Block]) -> bool:
    """Whether blocks look like an article: a heading, or two paragraphs."""
    tags = [elements[b.element].tag for b in blocks]
    return any(t in ("h1", "h2") for t in tags) or tags.count("p") > 1


def best_container(elements: list[Element], blocks: list[Block], out: list[bool]) -> int:
    """Text counts whole for the container it stands in, half one level up; -1 if there is none.

    An article or main element around the winner takes its place.
    """
    score: dict[int, float] = {}
    for block in blocks:
        if out[block.element]:
            continue
        worth = len(block.text) - 2 * block.linked
        near = container(elements, block.element)
        for i, share in ((near, 1.0), (elements[near].parent, 0.5)):
            if i >= 0:
                score[i] = score.get(i, 0.0) + worth * share
    if not score:
        return -1
    best = max(score, key=lambda i: (score[i], -i))
    above = best
    while above > 0:
        if elements[above].tag in ("article", "main"):
            return above
        above = elements[above].parent
    return best


def text_under(elements: list[Element], blocks: list[Block], out: list[bool], roots: set[int]) -> str:
    inside = [False] * len(elements)
    for i, element in enumerate(elements):
        inside[i] = i in roots or (element.parent >= 0 and inside[element.parent])
    return " ".join(b.text for b in blocks if inside[b.element] and not out[b.element])


def main_text(html: str, paths: Sequence[str]) -> str:
    """The text under the first of ``paths`` that the page has, else under its own best container."""
    elements, blocks = parse(html)
    out = outside(elements, blocks)
    for path in paths:
        roots = {i for i, e in enumerate(elements) if e.path == path}
        text = text_under(elements, blocks, out, roots) if roots else ""
        if text:
            return text
    best = best_container(elements, blocks, out)
    return text_under(elements, blocks, out, {best}) if best >= 0 else ""


def _vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in RowBatches(batches, "html"):
        paths = []
        for html in batch.column("html"):
            elements, blocks = parse(html.as_py() or "")
            best = best_container(elements, blocks, outside(elements, blocks))
            paths.append(elements[best].path if best >= 0 else None)
        yield pa.RecordBatch.from_arrays([batch.column("host"), pa.array(paths, pa.string())], ["host", "path"])


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in RowBatches(batches, "html"):
        found = [
            main_text(html.as_py() or "", paths.as_py() or ())
            for html, paths in zip(batch.column("html"), batch.column("paths"), strict=True)
        ]
        yield pa.RecordBatch.from_arrays(
            [batch.column("id"), batch.column("url"), pa.array(found, pa.string())], ["id", "url", "text"]
        )


def winning_paths(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(host, paths, votes): the paths with most votes per host, most first, ties in path order."""
    rows = pages.select(host_of(F.col(url_col)).alias("host"), F.col(html_col).alias("html"))
    votes = rows.mapInArrow(_vote, "host string, path string").filter("path IS NOT NULL").groupBy("host", "path").agg(F.count("*").alias("n"))
    best = top_per_group(votes, ["host"], [F.col("n").desc(), F.col("path")], PATHS, ["path"])
    ranked = F.array_sort(F.collect_list(F.struct("rank", "path")))  # at most PATHS
    return best.groupBy("host").agg(ranked["path"].alias("paths"), F.sum("n").alias("votes"))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, url, text), one row per row of ``pages``.

    Null and empty pages, and pages without text outside menus and the like,
    have an empty text. Pages without a host share the empty host's paths.
    Repeated rows and null ids are kept; other columns are ignored.
    """
    winners = materialise(winning_paths(pages, url_col, html_col), "html-paths")
    rows = pages.select(
        F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"), host_of(F.col(url_col)).alias("host")
    )
    if fits_broadcast(winners, WINNER_ROWS):
        joined = rows.join(F.broadcast(winners), "host", "left")
    else:
        total = winners.agg(F.coalesce(F.sum("votes"), F.lit(0)).alias("n")).first()["n"]
        joined = lookup(rows, winners, "host", "votes", ["paths"], total)
    joined = joined.select("id", "url", "html", "paths")
    out = joined.mapInArrow(_extract, f"id {rows.schema['id'].dataType.simpleString()}, url string, text string")
    return out.withColumnRenamed("id", id_col).withColumnRenamed("url", url_col)
