"""Main text of web pages by the maximum-scoring subsequence.

A page is a row of tokens, words and tags. Words score by how likely their surroundings hold content: the landmarks they
are within, the words in these elements' class, id and role, the nearest weighing most, and what their block is like (its
element, its length, how much of it is links); a heading scores as what it heads, an item of a list as the text it goes
on with. Tags score negatively, less so within one element that is marked as
content. The weights of both are learned from labelled pages. One linear scan finds the contiguous region with the greatest sum. Within it, blocks whose words don't score,
such as an advert in the middle of an article, are left out.
"""

from __future__ import annotations

import math
import random
import re
from collections import Counter
from collections.abc import Callable, Iterator
from functools import lru_cache
from html import unescape
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame

#: Fixed values of HTML: elements whose content isn't text, elements without an end tag, and those that stand in a line.
RAW = {"script", "style", "noscript", "template", "svg", "math", "iframe", "object", "textarea", "title", "head", "select", "canvas", "video", "audio"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q", "ruby", "rb", "rt", "rp", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "img", "input", "button"}
#: Elements that tell of themselves what they hold; others tell by class, id and role alone. Those of an article are told from the page's.
LANDMARKS = {"article", "aside", "dialog", "footer", "form", "header", "main", "menu", "nav"}
#: Headings, and items of lists.
HEADINGS, ITEMS = {"h1", "h2", "h3", "h4", "h5", "h6"}, {"li", "dd", "dt"}
#: An element that its opening closes, where it is the innermost block.
CLOSES = {
    "p": {"address", "article", "aside", "blockquote", "div", "dl", "fieldset", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "nav", "ol", "p", "pre", "section", "table", "ul"},
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "tbody"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "option": {"option"},
}
TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:=\s*\"[^\"]*\"|=\s*'[^']*'|[^>])*)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"(class|id|role|hidden|aria-hidden|style|itemprop)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
NAME = re.compile(r"[a-z]+")
ENDED = re.compile(r"[.!?:;…。][\"'”’»)\]]*$")
#: A class name that begins with such a word tells of a page's state, not of what an element holds.
STATES = {"has", "no", "not", "with", "without", "is", "tag", "category", "js", "type", "format", "status", "col", "row"}
#: Elements whose end is looked for alone; the rest of RAW nests.
FLAT = {"script", "style", "textarea", "title"}
WHITE = re.compile(r"\s+")


class Level:
    """An element that tells what it holds: its name and features."""

    __slots__ = ("name", "features")

    def __init__(self, name: str, features: frozenset[str]):
        self.name, self.features = name, features


class Node:
    """An open element: its name, and the levels around it, the nearest first."""

    __slots__ = ("name", "levels", "raw")

    def __init__(self, name: str, attributes: str, outer: Node | None):
        levels = outer.levels if outer else ()
        inner = name in ("header", "footer") and any(x.name == "article" for x in levels)
        own = {f"inner {name}" if inner else name} if name in LANDMARKS else set()
        raw = False
        if attributes.strip(" /") and name not in ("html", "body"):
            for key, *values in ATTRIBUTE.findall(attributes):
                value = unescape("".join(values))
                if key.lower() in ("hidden", "aria-hidden", "style"):
                    raw |= key.lower() == "hidden" or value.lower() == "true" or "display:none" in value.lower().replace(" ", "")
                else:
                    for one in value.split():
                        words = NAME.findall(re.sub("([a-z])([A-Z])", r"\1 \2", one).lower())
                        if words and words[0] not in STATES:
                            own |= {f".{x}" for x in words}
        self.name, self.raw = name, raw or bool(outer and outer.raw)
        self.levels = (Level(name, frozenset(own)), *levels) if own else levels


class Block(NamedTuple):
    """A block of text: the levels around it, how many tags came since the last block, what it is like, its words and its text. Hidden ones have no levels and no traits."""

    levels: tuple[Level, ...]
    tags: int
    traits: tuple[str, ...]
    words: int
    text: str


def end_of(html: str, name: str, at: int) -> int | None:
    """Where a raw element that was opened before at ends, after its end tag; None if it has none."""
    depth = 1
    for tag in re.compile(rf"<(/?){re.escape(name)}(?=[\s/>])[^>]*>", re.I).finditer(html, at):
        if name in FLAT and not tag[1]:
            continue
        depth += -1 if tag[1] else 0 if tag[0].endswith("/>") else 1
        if not depth:
            return tag.end()
    return None


def blocks(html: str) -> Iterator[Block]:
    """Blocks in page order. An element of RAW without an end tag holds nothing, but for scripts, styles and the like, which reach to the page's end."""
    open_: list[Node] = []
    parts: list[str] = []
    at, tags, size, element, linked = 0, 0, len(html), "", 0

    def close() -> Iterator[Block]:
        nonlocal parts, tags, linked
        text = WHITE.sub(" ", unescape("".join(parts))).strip()
        parts, links, linked = [], linked, 0
        if text:
            inner = open_[-1] if open_ else None
            n = text.count(" ") + 1
            if inner and inner.raw:
                yield Block((), tags, (), n, text)
            else:
                length = "short" if n < 6 else "long" if n > 24 else "medium"
                yield Block(inner.levels if inner else (), tags, (element or "none", length, "ended" if ENDED.search(text) else "open", "links" if 2 * links > n else "prose"), n, text)
            tags = 0

    while at < size:
        tag = TAG.search(html, at)
        run = html[at : tag.start() if tag else size]
        parts.append(run)
        if open_ and any(x.name == "a" for x in open_[-3:]):
            linked += len(run.split())
        if not tag:
            break
        at = tag.end()
        name = (tag[2] or "").lower()
        if not name:
            continue
        if tag[1]:
            tags += 1
            if name in INLINE:
                if open_ and open_[-1].name == name:
                    open_.pop()
                continue
            yield from close()
            for i in range(len(open_) - 1, -1, -1):
                if open_[i].name == name:
                    del open_[i:]
                    break
            element = next((x.name for x in reversed(open_) if x.name not in INLINE), "")
            continue
        if name in RAW and not tag[0].endswith("/>") or name == "head":
            yield from close()
            if name == "head":
                open_.append(Node(name, "", None))
                open_[-1].raw = True
                continue
            end = end_of(html, name, at)
            at = end or (size if name in FLAT else at)
            continue
        tags += 1
        if name in INLINE:
            if name not in VOID:
                open_.append(Node(name, tag[3], open_[-1] if open_ else None))
            continue
        yield from close()
        if name == "body":
            open_ = [x for x in open_ if x.name != "head"]
        # An inline element left open within a block ends with it; a paragraph ends where a block begins.
        while open_ and (open_[-1].name in INLINE or name in CLOSES.get(open_[-1].name, ())):
            open_.pop()
        if name not in VOID:
            open_.append(Node(name, tag[3], open_[-1] if open_ else None))
            element = name
    yield from close()


def odds(yes: Counter, no: Counter) -> dict[str, float]:
    """Log-odds of content by feature, from how many blocks have it."""
    return {f: math.log((yes[f] + 0.5) / (yes[""] + 1) * (no[""] + 1) / (no[f] + 0.5)) for f in {*yes, *no} - {""}}


def mostly_form(page: list[Block]) -> set[Level]:
    """Forms that hold more than half of the page's words: they hold the page, not fields."""
    held: Counter = Counter()
    for block in page:
        held.update({x: block.words for x in block.levels if x.name == "form"})
    return {x for x, n in held.items() if 2 * n > sum(b.words for b in page)}


def goes_on(page: list[Block], i: int) -> bool:
    """Whether a block is an item of a list, and no link, that goes on with the block before."""
    b, before = page[i], page[i - 1]
    return bool(i and b.traits and before.traits) and b.traits[0] in ITEMS and b.levels == before.levels and not {"links"} & {*b.traits, *before.traits}


def heads(page: list[Block], i: int) -> bool:
    """Whether a block is the heading of the next: in the same elements, or right before the element that the next is in, if that has no heading of its own."""
    if i + 1 >= len(page):
        return False
    b, after = page[i], page[i + 1]
    if not b.traits or not after.traits or b.traits[0] not in HEADINGS or "links" in b.traits:
        return False
    return b.levels == after.levels or after.traits[0] not in HEADINGS and b.levels == after.levels[len(after.levels) - len(b.levels) :]


class Scorer:
    """Weights learned from labelled pages: of marks (the features of levels), of traits, and the costs of tags."""

    def __init__(self, pages: list[str], is_content: Callable[[str], bool], costs: tuple[float, ...] = (1.0, 0.5, 0.25, 0.1, 0.05), support: int = 3):
        split = [[b for b in blocks(html) if b.traits] for html in pages]
        marks, held, self.known = (Counter(), Counter()), Counter(), {}
        for page in split:
            for b in page:
                marks[is_content(b.text)].update({"", *(f for x in b.levels for f in x.features)})
            held.update({f for b in page for x in b.levels for f in x.features})
        # A name that few pages have tells nothing of others.
        self.marks = {f: x for f, x in odds(marks[True], marks[False]).items() if held[f] >= support}
        traits = (Counter(), Counter())
        self.traits: dict[str, float] = {}
        for page in split:
            for b, own in zip(page, self.described(page)):
                traits[is_content(b.text)].update({"", *own})
        self.traits = odds(traits[True], traits[False])
        # The tags that lose least content and take in least else, the cheapest of equals.
        wrong = {}
        for self.tag, self.inner_tag in ((-c, -c * share) for c in costs for share in (1.0, 0.1, 0.01)):
            wrong[-self.tag, -self.inner_tag] = sum(b.words * ((b.text in kept) != is_content(b.text)) for page in split for kept in [set(self.content(page))] for b in page)
        self.tag, self.inner_tag = (-c for c in min(wrong, key=lambda c: (wrong[c], c[1], c[0])))

    def marked(self, levels: tuple[frozenset[str], ...]) -> float:
        """Odds of content by the marks around: each level's, the nearest in full and every one beyond at half of the one before."""
        if levels not in self.known:
            self.known[levels] = sum(sum(self.marks.get(f, 0.0) for f in features) / 2**i for i, features in enumerate(levels))
        return self.known[levels]

    def levels(self, page: list[Block]) -> list[float]:
        forms = mostly_form(page)
        return [self.marked(tuple(x.features for x in b.levels if x not in forms)) for b in page]

    def described(self, page: list[Block]) -> list[tuple[str, ...]]:
        """The traits of a page's blocks; one is whether other blocks bear marks of content and this one doesn't."""
        marked = self.levels(page)
        rest = max(marked, default=0.0) > 1
        return [(*b.traits, "beside") if rest and m <= 1 else b.traits for b, m in zip(page, marked)]

    def words(self, page: list[Block]) -> list[float]:
        """Score of a word in each block, from 0, where content is less likely than not, to 1. A heading scores no less than what it heads, an item of a list no less than the text that the list follows."""
        limit = lambda t, x: x if t == "beside" else max(-1.5, min(1.5, x)) / 2
        totals = [m + sum(limit(t, self.traits.get(t, 0.0)) for t in own) for m, own in zip(self.levels(page), self.described(page))]
        out = [max(0.0, math.tanh(x / 2)) if b.traits else 0.0 for b, x in zip(page, totals)]
        for i in range(1, len(page)):  # in page order: an item hands its score on
            if goes_on(page, i):
                out[i] = max(out[i], out[i - 1])
        for i in range(len(page) - 2, -1, -1):
            if heads(page, i):
                out[i] = max(out[i], out[i + 1])
        return out

    def tags(self, page: list[Block]) -> list[float]:
        """Score of a tag before each block: less negative where it lies, as the block before does, within the same element that is marked as content, and between a heading and what it heads or the items of a list."""
        holders = [{x for x in b.levels if self.marked((x.features,)) > 1} for b in page]
        return [self.inner_tag if i and (own & holders[i - 1] or goes_on(page, i) or heads(page, i - 1)) else self.tag for i, own in enumerate(holders)]

    def tokens(self, page: list[Block]) -> list[float]:
        """Scores of a page's tokens, two sums a block: of the tags before it, and of its words."""
        return [x for b, t, s in zip(page, self.tags(page), self.words(page)) for x in (b.tags * t, s * b.words)]

    def content(self, page: list[Block]) -> list[str]:
        """Texts of the blocks of the best region whose words score."""
        scores = self.tokens(page)
        lo, hi = best_region(scores)
        return [b.text for i, b in enumerate(page) if lo <= 2 * i + 1 < hi and scores[2 * i + 1] > 0]


def best_region(scores: list[float]) -> tuple[int, int]:
    """Begin and end of the contiguous run with the greatest sum, the earliest of equals; (0, 0) if no sum is positive."""
    best, found, total, begin = 0.0, (0, 0), 0.0, 0
    for i, s in enumerate(scores):
        if total < 0:
            total, begin = 0.0, i
        total += s
        if total > best:
            best, found = total, (begin, i + 1)
    return found


#: By kind of page part, the marks of labelled pages that hold it. The first list is content.
CONTENT_MARKS = ("article", "main", "div.article body", "div.post content", "div.entry content", "section.story", "div.content", "div#content", "article.post entry", "div.main text", "div.page content")
OTHER_MARKS = (
    "nav", "header", "footer", "aside", "form", "div.menu", "ul.nav", "div.navbar", "div.sidebar", "div.ad", "div.ads", "div.advert", "div.advertisement", "div.banner", "div.promo", "div.sponsored", "div.cookie notice",
    "div.cookie consent", "div.gdpr", "div.notice", "div.alert", "div.popup", "div.modal", "div.newsletter", "div.subscribe", "div.share", "div.social", "div.comments", "section.comments", "div.comment", "ol.comment list",
    "div.disqus", "div.related", "div.recommended", "div.breadcrumb", "nav.breadcrumbs", "div.footer", "div.header", "div.masthead", "div.pagination", "div.widget", "div.login", "div.search", "div.copyright", "div.legal", "div.skip",
    "div.replies", "div.respond", "div.toolbar", "div.tags", "div#comments", "div#sidebar", "div#footer", "div#header", "div#nav", "div#menu", "ul.menu", "div.disclaimer", "div.privacy", "div.dialog", "div.signup", "div.feedback", "div.teaser",
)


#: Class names beside a mark that say nothing of what its element holds.
BESIDE = ("", " has-comments", " no-sidebar", " tag-search category-legal", " with-footer")


def nonsense(rng: random.Random) -> str:
    return "".join(rng.choices("bcdfghjklmnpqrstvwxz", k=6))


def labelled_pages(n: int = 240, seed: int = 4) -> Iterator[str]:
    """Pages with known content, in many layouts: the marks above, or in each third page unknown class names, around filler, content words being yes and all others no. No two blocks of a page are alike."""
    rng = random.Random(seed)

    def text(word: str, least: int, most: int, end: str) -> str:
        size = rng.randint(least, most)
        return f"{word}{rng.randrange(10**9)}" + f" {word}" * (size - 1) + end

    for i in range(n):
        known = i % 3 != 2
        beside = rng.choice(BESIDE)
        content = rng.choice(CONTENT_MARKS) if known else f"div.{nonsense(rng)}"
        others = [rng.choice(OTHER_MARKS) if known else f"div.{nonsense(rng)}" for _ in range(8)]
        yes = lambda least, most, end=".": text("yes", least, most, end)
        title = f"<h1>{yes(3, 10, '')}</h1>"
        inner = f"<header>{title}</header>" if i % 4 == 0 and content == "article" else title
        inner += "".join(f"<{t}>{yes(*size)}</{t}>" for t, size in (("p", (20, 60)), ("p", (1, 40)), ("h2", (2, 6, "")), ("p", (10, 80)), ("blockquote", (5, 30)), ("p", (1, 12))))
        inner += f"<ul>{''.join(f'<li>{yes(2, 12)}</li>' for _ in range(3))}</ul><table><tr><td>{yes(1, 4, '')}</td></tr></table>" if i % 2 else ""
        inner += f"<footer><p>{text('no', 2, 6, '')}</p></footer>" if i % 4 == 1 and content == "article" else ""
        links = lambda: "<ul>" + "".join(f'<li><a href="/{k}">{text("no", 1, 2, "")}</a></li>' for k in range(6)) + "</ul>"
        furniture = lambda: rng.choice((links(), f"<p>{text('no', 2, 12, rng.choice(('.', '')))}</p>", f"<p>{text('no', 1, 5, '')} <a href=x>no no</a></p>"))
        inner += _wrap(others[7], furniture()) if known and i % 2 else ""
        inner += f"<p>{yes(1, 30)}</p>"
        parts = [_wrap(m, links() if k % 2 else furniture()) for k, m in enumerate(others[:7])]
        page = "".join(parts[:3]) + _wrap(content, inner, beside) + "".join(parts[3:])
        page = f'<form action="/">{page}</form>' if i % 7 == 0 else page
        yield f'<html><body class="{beside.strip()} sidebar">{page}</body></html>'


def _wrap(mark: str, inner: str, beside: str = "") -> str:
    name, kind, value = re.match(r"(\w+)([.#]?)(.*)", mark).groups()
    value = value.replace(" ", "-")
    attribute = f' id="{value}"' if kind == "#" else f' class="{(value + beside).strip()}"' if kind or beside else ""
    return f"<{name}{attribute}>{inner}</{name}>"


@lru_cache(maxsize=1)
def trained() -> Scorer:
    """One for each worker process."""
    return Scorer(list(labelled_pages()), lambda text: text.startswith("yes"))


def main_text(html: str | None, scorer: Scorer | None = None) -> str:
    """The best region's blocks of content, joined by line ends."""
    return "\n".join((scorer or trained()).content(list(blocks(html or ""))))


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars (code points) of pages (page_id, url, html).

    Null or empty html, and pages without content, give an empty text. Every row gives one row, repeated ids too; null
    ids and urls stay null. Of regions that score alike the first counts. Other columns are not read. An empty table
    gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                texts = [main_text(h) for h in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select(pages["page_id"].cast("long").alias("page_id"), "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")
