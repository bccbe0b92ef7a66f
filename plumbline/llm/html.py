"""Main text of web pages by tag-path ratios.

A page is a sequence of text blocks, each under a root-to-leaf path of tags. Per path the mean text length and the mean
punctuation of its blocks are taken; both are smoothed along the page, fused, weighed down by the share of link text,
and compared with a threshold. The blocks above it are kept, and so are the shorter ones of the element that holds
them, in page order. Left out are elements that are never main text, by their tag, or by a word of their class (menus,
forms, notices, comments, ...) if what they hold is little or mostly links.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Elements without an end tag, elements whose content is no markup, and elements inside a line of text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea xmp iframe noembed noframes noscript template svg math".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q ruby rp rt s samp small span strike strong sub sup time tt u var wbr".split()
)
# Elements that never hold main text, by tag and by a word of their class, id or role.
SKIP = frozenset(
    "head script style title noscript template iframe svg math nav header footer aside button select option textarea menu dialog noembed noframes object audio video canvas".split()
)
SKIP_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments commentlist complementary contentinfo cookie cookies consent disclaimer discussion dialog disqus footer form "
    "gdpr header masthead menu modal nav navbar navigation newsletter notice notices pager pagination popup promo promoted promotion recommended related replies reply responses search share sharing sidebar signup social "
    "sponsor sponsored sponsors subscribe subscription toolbar widget".split()
)
# Those of them that name sections of articles too, and words before one of them that tell what a wrapper holds.
SECTION_WORDS = frozenset("complementary disclaimer discussion dialog form header notice notices recommended related replies reply responses search".split())
ABOUT = frozenset("has have with no without show hide".split())
# Characters from which on such a section may hold main text, and what its score is multiplied by.
SMALL = 200
LOWERED = 0.5
# Start tags that end an open element of the same kind or of the kinds listed.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPE = frozenset("html body article main section div nav header footer aside table ul ol dl form blockquote".split())

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:=\s*\"[^\"]*\"|=\s*'[^']*'|[^>])*+)(>|\Z)", re.S
)
ATTRIBUTE = re.compile(r"([^\s/>=\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
WORDS = re.compile(r"[a-z]+")
UNSEEN = re.compile(r"display\s*:\s*none", re.I)
PUNCTUATION = re.compile(r"[.,;:!?…。、，！？；：]")
SPREAD = (0.25, 0.5, 0.25)
THRESHOLD = 0.25


def attributes_of(tag: str, text: str) -> dict[str, str]:
    """Attributes by lower-case name, the first of equal names; of ``html`` and ``body`` none counts."""
    out: dict[str, str] = {}
    if text.strip() and tag not in ("html", "body"):
        for name, *value in ATTRIBUTE.findall(text):
            out.setdefault(name.lower(), "".join(value))
    return out


def skipped(tag: str, attributes: dict[str, str]) -> bool:
    if tag in SKIP or "hidden" in attributes:
        return True
    return attributes.get("aria-hidden", "").strip().lower() == "true" or bool(UNSEEN.search(attributes.get("style", "")))


def marked(tag: str, attributes: dict[str, str]) -> str | None:
    """``form``, or ``never`` or ``seldom`` by the words of class, id and role; a word after one of ``ABOUT`` says what is inside."""
    if tag == "form":
        return "form"
    found = None
    for name in ("class", "id", "role"):
        words = WORDS.findall(re.sub(r"([a-z])([A-Z])", r"\1 \2", attributes.get(name, "")).lower())
        for before, word in zip(["", *words], words, strict=False):
            if word in SKIP_WORDS and before not in ABOUT:
                if word not in SECTION_WORDS:
                    return "never"
                found = "seldom"
    return found


class Element:
    __slots__ = ("tag", "path", "skip", "parent", "link", "mark", "low")

    def __init__(self, tag: str, parent: Element | None, skip: bool, mark: str | None = None) -> None:
        self.tag, self.parent, self.mark = tag, parent, mark
        self.path = f"{parent.path} {tag}" if parent else tag
        self.skip = skip or bool(parent and parent.skip)
        self.link = tag == "a" or bool(parent and parent.link)
        self.low = False


def around(e: Element | None) -> Iterator[Element]:
    while e is not None:
        yield e
        e = e.parent


def unmarked(found: list[tuple[str, Element, int]]) -> list[tuple[str, Element, int]]:
    """The blocks without those of marked elements that are mostly links or hold little; others of these are ``low``.

    Little is under ``SMALL`` characters, and for words that don't name a section of an article less than half of the
    page; an element around half of the page with an article in it is never little. A form stays only where it wraps
    the page: it holds half of its text or more, most of that in paragraphs or an article.
    """
    held: dict[Element, list[int]] = {}
    for text, e, linked in found:
        article = paragraph = 0
        for x in around(e):
            article |= x.tag in ("article", "main")
            paragraph |= x.tag in ("article", "main", "p")
            if x.mark:
                t = held.setdefault(x, [0, 0, 0, 0])
                t[0] += len(text)
                t[1] += linked
                t[2] |= article
                t[3] += len(text) * paragraph
    if not held:
        return found
    page = sum(len(text) for text, _, _ in found)
    gone = set()
    for x, (n, linked, article, written) in held.items():
        half = 2 * n >= page
        if x.mark == "form":
            if not half or 2 * written < n or 2 * linked > n:
                gone.add(x)
        elif 2 * linked > n or n < SMALL and not (half and article) or x.mark == "never" and not half:
            gone.add(x)
    out = [b for b in found if gone.isdisjoint(around(b[1]))]
    for _, e, _ in out:
        # An element that holds half of the page is a wrapper.
        if not e.low and any(x.mark and 2 * held[x][0] < page for x in around(e)):
            e.low = True
            e.path += " *"
    return out


def blocks(html: str) -> list[tuple[str, Element, int]]:
    """``text, element, length of link text`` of every block with text, in page order; skipped elements are left out."""
    root = Element("", None, False)
    stack = [root]
    out: list[tuple[str, Element, int]] = []
    parts: list[str] = []
    linked = 0

    def block() -> Element:
        e = stack[-1]
        while e.tag in INLINE and e.parent:
            e = e.parent
        return e

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                out.append((text, block(), linked))
            parts.clear()
        linked = 0

    def say(text: str) -> None:
        nonlocal linked
        if text and not stack[-1].skip:
            text = unescape(text) if "&" in text else text
            parts.append(text)
            if stack[-1].link:
                linked += len(text)

    at = 0
    while m := TOKEN.search(html, at):
        say(html[at : m.start()])
        at = m.end()
        closing, tag, attributes, end = m.groups()
        if tag is None:
            continue
        tag = tag.lower()
        if not end:
            break
        if closing:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    if any(e.tag not in INLINE for e in stack[i:]):
                        flush()
                    del stack[i:]
                    break
                if tag in INLINE and stack[i].tag in SCOPE:
                    break
            else:
                if tag == "p":
                    flush()
            continue
        if tag == "br":
            if not stack[-1].skip:
                parts.append(" ")
            continue
        if tag not in INLINE:
            flush()
            # A block ends an open paragraph, and with it the inline elements left open in it.
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == "p" or stack[i].tag in CLOSES.get(tag, ()):
                    del stack[i:]
                elif stack[i].tag in SCOPE:
                    break
            while stack[-1].tag in INLINE and tag in SCOPE | {"p"} and stack[-1].tag != "a" and not stack[-1].skip:
                stack.pop()
        if tag in VOID:
            continue
        if tag in RAW:
            close = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>?", re.I).search(html, at)
            at = close.end() if close else len(html)
            continue
        if not attributes.rstrip().endswith("/"):
            named = attributes_of(tag, attributes)
            mark = marked(tag, named)
            # Inside a line of text no block could be left out later.
            stack.append(Element(tag, stack[-1], skipped(tag, named) or bool(mark) and tag in INLINE, mark))
    else:
        say(html[at:])
    flush()
    return unmarked(out)


def smooth(values: list[float]) -> list[float]:
    side, middle, _ = SPREAD
    last = len(values) - 1
    return [side * values[max(i - 1, 0)] + middle * v + side * values[min(i + 1, last)] for i, v in enumerate(values)]


def extract(html: str) -> str:
    found = blocks(html)
    if not found:
        return ""
    total: dict[str, list[float]] = {}
    for text, element, linked in found:
        t = total.setdefault(element.path, [0, 0, 0, 0])
        t[0] += len(text)
        t[1] += len(PUNCTUATION.findall(text))
        t[2] += linked
        t[3] += 1
    length = smooth([total[e.path][0] / total[e.path][3] for _, e, _ in found])
    punctuation = smooth([total[e.path][1] / total[e.path][3] for _, e, _ in found])
    score = []
    for (_, e, _), x, y in zip(found, length, punctuation, strict=True):
        t = total[e.path]
        score.append((x * (1 + y)) ** 0.5 * max(0.0, 1 - t[2] / t[0]) * (LOWERED if e.low else 1))
    threshold = THRESHOLD * max(score)
    # How many of the selected blocks each element around them holds; one that holds all of them is around main text.
    chosen = [s >= threshold for s in score]
    holds: dict[Element, int] = {}
    for (_, e, _), s in zip(found, chosen, strict=True):
        if s:
            for x in around(e):
                holds[x] = holds.get(x, 0) + 1
    whole = {x for x, n in holds.items() if n == sum(chosen)}
    # The smallest of them that isn't a single block, with every article that holds selected blocks.
    main = max(whole, key=lambda x: sum(1 for _ in around(x)))
    if main.tag not in SCOPE and main.parent:
        main = main.parent
    articles = {x for x in holds if x.tag in ("article", "main")}
    kept = []
    for (text, e, linked), s in zip(found, chosen, strict=True):
        outer = set(around(e))
        if s or not articles.isdisjoint(outer) and not e.low or main in outer and not e.low and 2 * linked <= len(text):
            kept.append(text)
    return " ".join(kept)


def main_text(pages: DataFrame, columns: list[str], html: str = "html") -> DataFrame:
    """``columns`` of every page, then ``text, n_chars``, which replace columns of these names.

    A null or empty page, and one without text outside the skipped elements, has the empty text. A page cut off inside
    a tag ends before that tag. Every row is returned, repeated ones too; other columns are not read.
    """
    columns = [c for c in columns if c not in ("text", "n_chars")]
    fields = [pages.schema[c] for c in columns]
    out = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 500):
                part = batch.slice(a, 500)
                texts = [extract(x.as_py() or "") for x in part.column(0)]
                arrays = [pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())]
                yield pa.RecordBatch.from_arrays([*part.columns[1:], *arrays], names=[*columns, "text", "n_chars"])

    return pages.select(F.col(html).alias("_html"), *columns).mapInArrow(run, out + ", text string, n_chars long")
