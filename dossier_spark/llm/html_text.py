"""Main text of web pages from flat text blocks.

A page becomes a flat list of blocks (text between block-level tags). Each block is described by its own and
its neighbours' word count and link density, and by what encloses it: an article or main element, a boilerplate
element (nav, footer, aside, form, ...) or class, a class that only might name boilerplate, a list item; and by the
page: whether it has an article element, and which share of its words lies in boilerplate. A decision tree grown from
the labelled table below says which blocks are text. No mark decides alone: a form around a whole page, or a class
like side-effects, leaves the decision to lengths and link densities.

Defined results: a null or empty html, and one without content blocks, gives '' and 0. Unclosed tags end with
the block-level element that follows or encloses them; an unclosed script, style or comment runs to the end.
Pages of any length are read whole; repeated rows give equal rows. Other columns of the input are returned
unchanged, but those named like an output are replaced.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from . import common as C

BLOCK = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead title tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea svg iframe object head canvas audio video select button".split())
BOILER = frozenset("nav footer aside form menu dialog fieldset".split())
ARTICLE = frozenset("article main".split())
# Class or id words of boilerplate: some wherever they are a part of a name, some only as a whole name; as a part they hint.
MARKS = frozenset("ad ads advert adverts advertisement advertising banner sponsor sponsored promo promos promotion sidebar cookie cookies consent gdpr popup modal comment comments replies reply respond disqus menu nav navbar navigation breadcrumb breadcrumbs footer masthead topbar toolbar newsletter subscribe signup login widget pagination pager copyright disclaimer".split())
HINTS = frozenset("side notice notices alert overlay foot header head share sharing social related recommend recommended recommendations search tag tags skip legal hidden".split())
NAME_PARTS = re.compile(r"[_-]+")
OTHER_ARTICLE = re.compile(r"(?i)comment|repl(?:y|ies)|advert|promo|related|teaser|sponsor")
OF_ARTICLE = frozenset("header head foot side tag tags skip hidden".split())
OPEN_COMMENT, TAG = "<!--", re.compile(r"<(?:!--|[!?][^>]*>|(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)>|(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^<>]*)>?)")
ATTRIBUTE = re.compile(r"(?i)\b(class|id|role|aria-label|hidden|style)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
HIDDEN_STYLE = re.compile(r"(?i)display\s*:\s*none|visibility\s*:\s*hidden")
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
UNQUOTED_SLASH = re.compile(r"=\s*[^\s\"'=<>`]*/$")
# Words that name a container and say nothing of what it holds.
CONTAINERS = frozenset("area bar block body bottom box card cell center col column container content group holder inner item items left list main module outer page panel region right row section site slot space top unit wrap wrapper zone".split())
SPACE = re.compile(r"\s+")
WORD = re.compile(r"\S+")
CLOSES_P = BLOCK - {"html", "body"}
UNPARSED = {tag: re.compile(rf"</{tag}\s*>", re.I) for tag in ("script", "style", "textarea", "title", "noscript")}


@dataclass
class Block:
    text: str
    words: int
    linked: int
    heading: bool
    article: bool
    boiler: bool
    item: bool
    hint: bool

    @property
    def density(self) -> float:
        return self.linked / self.words if self.words else 0.0


@dataclass
class Node:
    tag: str
    article: bool
    boiler: bool
    skip: bool = False
    link: bool = False
    heading: bool = False
    item: bool = False
    hint: bool = False


@dataclass
class Blocks:
    """Collects the text of one page into blocks."""

    out: list[Block] = field(default_factory=list)
    pieces: list[tuple[str, bool]] = field(default_factory=list)

    def flush(self, at: Node) -> None:
        if not self.pieces:
            return
        text = SPACE.sub(" ", entities.unescape("".join(t for t, _ in self.pieces))).strip()
        if text:
            linked = sum(len(WORD.findall(t)) for t, a in self.pieces if a)
            n = len(WORD.findall(text))
            self.out.append(Block(text, n, min(linked, n), at.heading, at.article, at.boiler, at.item, at.hint))
        self.pieces = []


def names_boilerplate(value: str, tag: str, parent: Node) -> tuple[bool, bool]:
    """Whether a class or id names boilerplate, and whether a part of it might. An article may be a comment or a teaser, but
    not its own header. Within an article a name counts if it is made of such words and of containers' alone; another name that
    only has one as a part (ad-hoc, no-comments-yet) may be the author's, so it hints and the tree decides."""
    if tag in ARTICLE:
        return OTHER_ARTICLE.search(value) is not None, False
    named = hinted = False
    for name in value.lower().split():
        parts = NAME_PARTS.split(name)
        marked = any(x in MARKS for x in parts)
        plain = not parent.article or all(x in MARKS or x in HINTS or x in CONTAINERS or x.isdigit() for x in parts)
        named = named or (marked and plain) or (name in HINTS and not (parent.article and name in OF_ARTICLE))
        hinted = hinted or marked or any(x in HINTS and not (parent.article and x in OF_ARTICLE) for x in parts)
    return named, hinted


def closes_itself(attributes: str) -> bool:
    """Whether a tag ends in a slash of its own, not that of an unquoted value."""
    return attributes.endswith("/") and UNQUOTED_SLASH.search(attributes) is None


def node_of(tag: str, attributes: str, parent: Node) -> Node:
    boiler = parent.boiler or tag in BOILER or (tag == "header" and not parent.article)
    skip, hint = parent.skip or tag in RAW, parent.hint
    if attributes and tag not in ("html", "body"):
        for m in ATTRIBUTE.finditer(attributes):
            name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
            if name in ("class", "id"):
                named, hinted = names_boilerplate(value, tag, parent)
                boiler, hint = boiler or named, hint or hinted
            elif name == "role":
                boiler = boiler or value.lower() in ROLES
            elif name == "hidden" or (name == "style" and HIDDEN_STYLE.search(value)):
                skip = True
    return Node(tag, parent.article or tag in ARTICLE, boiler, skip, parent.link or tag == "a", parent.heading or tag in ("h1", "h2", "h3", "h4", "h5", "h6"), parent.item or tag in ("li", "option"), hint)


class Open:
    """The open elements. Inline ones and p are counted since the last block, so that no end tag searches in vain."""

    def __init__(self):
        self.stack, self.frames, self.total = [Node("", False, False)], [(0, {})], {}

    @staticmethod
    def bounds(tag: str) -> bool:
        return tag in BLOCK and tag != "p"

    def push(self, node: Node) -> None:
        if self.bounds(node.tag):
            self.frames.append((len(self.stack), {}))
        else:
            inner = self.frames[-1][1]
            inner[node.tag] = inner.get(node.tag, 0) + 1
        self.total[node.tag] = self.total.get(node.tag, 0) + 1
        self.stack.append(node)

    def cut(self, i: int) -> None:
        """Close the element at i and all within it."""
        while self.frames[-1][0] >= i:
            self.frames.pop()
        at, inner = self.frames[-1]
        for node in self.stack[i:]:
            self.total[node.tag] -= 1
            if not self.bounds(node.tag) and inner.get(node.tag):
                inner[node.tag] -= 1
        del self.stack[i:]

    def last(self, tag: str, first: int) -> int:
        return next(i for i in range(len(self.stack) - 1, first, -1) if self.stack[i].tag == tag)

    def end(self, tag: str) -> None:
        """An end tag: inline ones and p end the last such element since the last block, blocks the last open one."""
        at, inner = self.frames[-1]
        if not self.total.get(tag):
            return
        if not self.bounds(tag):
            if inner.get(tag):
                self.cut(self.last(tag, at))
            elif tag == "p":
                found = next((f for f in range(len(self.frames) - 2, -1, -1) if self.frames[f][1].get("p")), None)
                if found is not None:
                    self.cut(next(i for i in range(self.frames[found + 1][0] - 1, self.frames[found][0], -1) if self.stack[i].tag == "p"))
            return
        for i, _ in reversed(self.frames[1:]):
            if self.stack[i].tag == tag:
                return self.cut(i)

    def make_room(self, tag: str) -> None:
        """A new block ends an open p, and an open element of its own kind where such do not nest."""
        at, inner = self.frames[-1]
        if inner.get("p"):
            self.cut(self.last("p", at))
        elif at and self.stack[at].tag == tag and tag in ("li", "dd", "dt", "tr", "td", "th", "option"):
            self.cut(at)


def blocks(page: str) -> list[Block]:
    """The flat text blocks of a page, in order."""
    got, opened, at, n = Blocks(), Open(), 0, len(page)
    while at < n:
        here = opened.stack[-1]
        m = TAG.search(page, at)
        text = page[at : m.start() if m else n]
        if text and not here.skip:
            got.pieces.append((text, here.link))
        if not m:
            break
        at = m.end()
        if m[0] == OPEN_COMMENT:
            end = page.find("-->", at)
            at = n if end < 0 else end + 3
            continue
        tag = m[2] or m[5]
        if tag is None:
            continue
        tag, closing, attributes = tag.lower(), bool(m[1] or m[4]), m[3] if m[2] else m[6]
        if tag in BLOCK and not here.skip:
            got.flush(here)
        elif tag == "br" and not here.skip:
            got.pieces.append((" ", False))
        if closing:
            opened.end(tag)
            continue
        if tag in UNPARSED:
            end = UNPARSED[tag].search(page, at)
            at = end.end() if end else n
            continue
        if tag in CLOSES_P:
            opened.make_room(tag)
        if tag not in VOID and not closes_itself(attributes or ""):
            opened.push(node_of(tag, attributes or "", opened.stack[-1]))
    got.flush(opened.stack[-1])
    return got.out


# ---------------------------------------------------------------- features and tree

FEATURES = ("words", "density", "words_before", "density_before", "words_after", "density_after", "heading", "article", "boiler", "item", "page_article", "hint", "boiler_share")

# Blocks labelled by hand: own words and link density, the same of the block before and after (0 where there
# is none), heading, in an article element, in boilerplate, list item, page has an article element; 1 is text.
ORDINARY = (
    # menus, link lists
    (1, 1.0, 0, 0.0, 1, 1.0, 0, 0, 1, 1, 1, 0), (1, 1.0, 1, 1.0, 1, 1.0, 0, 0, 1, 1, 1, 0), (2, 1.0, 1, 1.0, 12, 0.0, 0, 0, 1, 1, 1, 0),
    (1, 1.0, 1, 1.0, 9, 0.0, 0, 0, 1, 1, 0, 0), (2, 1.0, 3, 1.0, 2, 1.0, 0, 0, 0, 1, 0, 0), (3, 1.0, 2, 1.0, 2, 1.0, 0, 0, 0, 1, 0, 0),
    (4, 1.0, 4, 1.0, 5, 1.0, 0, 0, 0, 1, 0, 0), (8, 0.9, 7, 1.0, 9, 0.9, 0, 0, 0, 1, 0, 0), (6, 1.0, 0, 0.0, 7, 1.0, 0, 0, 0, 0, 0, 0),
    (5, 0.8, 30, 0.0, 6, 1.0, 0, 0, 0, 0, 0, 0), (10, 0.7, 40, 0.0, 12, 0.8, 0, 1, 1, 1, 1, 0), (7, 1.0, 50, 0.0, 7, 1.0, 0, 1, 1, 1, 1, 0),
    # adverts, notices, side columns, comments, forms: enclosed by boilerplate
    (12, 0.0, 1, 1.0, 10, 0.0, 0, 0, 1, 0, 1, 0), (25, 0.0, 1, 1.0, 9, 0.0, 0, 0, 1, 0, 1, 0), (60, 0.0, 2, 1.0, 14, 0.0, 0, 0, 1, 0, 1, 0),
    (120, 0.0, 90, 0.0, 40, 0.0, 0, 1, 1, 0, 1, 0), (45, 0.1, 80, 0.0, 30, 0.0, 0, 1, 1, 0, 1, 0), (33, 0.0, 100, 0.0, 20, 0.0, 0, 0, 1, 0, 0, 0),
    (80, 0.0, 60, 0.0, 70, 0.0, 0, 0, 1, 0, 0, 0), (5, 0.0, 3, 0.0, 2, 0.0, 0, 0, 1, 0, 0, 0), (2, 0.0, 100, 0.0, 18, 0.0, 1, 0, 1, 0, 1, 0),
    (3, 0.0, 60, 0.0, 40, 0.0, 1, 1, 1, 0, 1, 0), (18, 0.3, 2, 0.0, 20, 0.3, 0, 0, 1, 1, 1, 0), (14, 0.0, 70, 0.0, 0, 0.0, 0, 0, 1, 0, 1, 0),
    (9, 0.0, 70, 0.0, 0, 0.0, 0, 0, 1, 0, 0, 0), (30, 0.2, 5, 1.0, 0, 0.0, 0, 0, 1, 0, 0, 0), (2, 0.0, 1, 0.0, 1, 0.0, 0, 1, 1, 0, 1, 0),
    # outside the article of a page that has one
    (20, 0.0, 2, 1.0, 11, 0.0, 0, 0, 0, 0, 1, 0), (11, 0.0, 80, 0.0, 0, 0.0, 0, 0, 0, 0, 1, 0), (4, 0.0, 0, 0.0, 1, 1.0, 1, 0, 0, 0, 1, 0),
    (55, 0.0, 6, 0.0, 12, 0.0, 0, 0, 0, 0, 1, 0), (3, 0.3, 90, 0.0, 4, 1.0, 0, 0, 0, 0, 1, 0), (16, 0.1, 0, 0.0, 2, 1.0, 0, 0, 0, 0, 1, 0),
    # the article: titles, long and short paragraphs, items, paragraphs with links
    (9, 0.0, 12, 0.0, 70, 0.0, 1, 1, 0, 0, 1, 1), (1, 0.0, 20, 0.0, 1, 0.0, 1, 1, 0, 0, 1, 1), (12, 0.0, 1, 1.0, 3, 0.0, 1, 1, 0, 0, 1, 1),
    (70, 0.0, 9, 0.0, 90, 0.0, 0, 1, 0, 0, 1, 1), (1, 0.0, 60, 0.0, 80, 0.0, 0, 1, 0, 0, 1, 1), (2, 0.0, 1, 0.0, 12, 0.0, 0, 1, 0, 0, 1, 1),
    (400, 0.0, 8, 0.0, 11, 0.0, 0, 1, 0, 0, 1, 1), (35, 0.1, 44, 0.0, 20, 0.0, 0, 1, 0, 0, 1, 1), (22, 0.3, 50, 0.0, 60, 0.0, 0, 1, 0, 0, 1, 1),
    (6, 0.0, 20, 0.0, 7, 0.0, 0, 1, 0, 1, 1, 1), (15, 0.0, 6, 0.0, 12, 0.0, 0, 1, 0, 1, 1, 1), (4, 0.0, 90, 0.0, 0, 0.0, 0, 1, 0, 0, 1, 1),
    (3, 0.0, 1, 1.0, 1, 0.0, 0, 1, 0, 0, 1, 1), (18, 0.4, 30, 0.0, 9, 0.0, 0, 1, 0, 0, 1, 1), (5, 0.2, 30, 0.0, 40, 0.0, 1, 1, 0, 0, 1, 1),
    (3, 1.0, 40, 0.0, 30, 0.0, 1, 1, 0, 0, 1, 1), (2, 1.0, 80, 0.0, 60, 0.0, 0, 1, 0, 0, 1, 1), (4, 1.0, 25, 0.1, 30, 0.0, 0, 1, 0, 1, 1, 1),
    # link rows within an article
    (3, 1.0, 4, 1.0, 3, 1.0, 0, 1, 0, 1, 1, 0), (2, 1.0, 2, 1.0, 2, 1.0, 0, 1, 0, 0, 1, 0), (5, 1.0, 4, 1.0, 6, 1.0, 0, 1, 0, 1, 1, 0),
    # pages without an article element
    (60, 0.0, 8, 0.0, 80, 0.0, 0, 0, 0, 0, 0, 1), (25, 0.0, 60, 0.0, 40, 0.0, 0, 0, 0, 0, 0, 1), (14, 0.0, 40, 0.0, 30, 0.0, 0, 0, 0, 0, 0, 1),
    (100, 0.1, 2, 1.0, 90, 0.0, 0, 0, 0, 0, 0, 1), (7, 0.0, 4, 1.0, 60, 0.0, 1, 0, 0, 0, 0, 1), (4, 0.0, 50, 0.0, 70, 0.0, 1, 0, 0, 0, 0, 1),
    (6, 0.0, 60, 0.0, 50, 0.0, 0, 0, 0, 0, 0, 1), (12, 0.1, 30, 0.0, 25, 0.0, 0, 0, 0, 1, 0, 1), (30, 0.3, 50, 0.0, 45, 0.0, 0, 0, 0, 0, 0, 1),
    (11, 0.0, 12, 0.0, 18, 0.0, 0, 0, 0, 0, 0, 1), (40, 0.0, 0, 0.0, 0, 0.0, 0, 0, 0, 0, 0, 1), (3, 0.0, 0, 0.0, 0, 0.0, 0, 0, 0, 0, 0, 1),
    (5, 0.0, 0, 0.0, 40, 0.0, 1, 0, 0, 0, 0, 1), (9, 0.0, 45, 0.0, 0, 0.0, 0, 0, 0, 0, 0, 1), (20, 0.9, 5, 1.0, 6, 1.0, 0, 0, 0, 0, 0, 0),
    (3, 0.5, 2, 1.0, 2, 1.0, 0, 0, 0, 0, 0, 0), (5, 0.6, 60, 0.0, 1, 1.0, 0, 0, 0, 0, 0, 0), (2, 0.5, 1, 1.0, 1, 1.0, 0, 0, 0, 1, 0, 0),
    # text next to links, other blocks next to text
    (3, 0.0, 13, 0.0, 12, 0.2, 1, 1, 0, 0, 1, 1), (8, 0.0, 4, 1.0, 10, 0.4, 1, 1, 0, 0, 1, 1), (30, 0.0, 20, 0.2, 3, 1.0, 0, 1, 0, 0, 1, 1),
    (12, 0.0, 20, 0.0, 5, 1.0, 0, 1, 0, 0, 1, 1), (1, 0.0, 9, 0.0, 2, 1.0, 0, 1, 0, 0, 1, 1), (50, 0.1, 3, 1.0, 4, 0.8, 0, 1, 0, 0, 1, 1),
    (6, 0.0, 6, 1.0, 1, 1.0, 0, 1, 0, 1, 1, 1), (2, 0.0, 100, 0.0, 8, 0.5, 0, 1, 0, 0, 1, 1), (90, 0.2, 50, 0.1, 40, 0.3, 0, 1, 0, 0, 1, 1),
    (25, 0.0, 3, 1.0, 60, 0.0, 0, 0, 0, 0, 1, 0), (8, 0.0, 2, 1.0, 200, 0.0, 0, 0, 0, 0, 1, 0), (15, 0.0, 1, 1.0, 30, 0.3, 0, 0, 0, 0, 1, 0),
    (40, 0.0, 70, 0.0, 0, 0.0, 0, 0, 0, 0, 1, 0), (6, 0.0, 30, 0.0, 25, 0.0, 0, 0, 0, 1, 1, 0), (3, 0.0, 0, 0.0, 90, 0.0, 1, 0, 0, 0, 1, 0),
    (2, 1.0, 0, 0.0, 60, 0.0, 0, 0, 0, 1, 1, 0), (70, 0.1, 6, 0.0, 70, 0.2, 0, 0, 0, 0, 1, 0), (20, 0.0, 30, 0.0, 3, 1.0, 0, 0, 1, 0, 1, 0),
    (10, 0.0, 3, 1.0, 80, 0.0, 0, 0, 1, 0, 1, 0), (16, 0.0, 60, 0.0, 90, 0.0, 0, 1, 1, 0, 1, 0), (1, 0.0, 60, 0.0, 90, 0.0, 0, 1, 1, 0, 1, 0),
    (2, 1.0, 40, 0.0, 60, 0.0, 0, 0, 1, 1, 0, 0), (7, 0.0, 1, 1.0, 100, 0.0, 1, 0, 1, 0, 0, 0), (30, 0.0, 1, 1.0, 100, 0.0, 0, 0, 1, 0, 0, 0),
    (60, 0.0, 40, 0.0, 3, 1.0, 0, 0, 0, 0, 0, 1), (35, 0.1, 3, 1.0, 2, 1.0, 0, 0, 0, 0, 0, 1), (25, 0.0, 60, 0.0, 8, 0.4, 0, 0, 0, 0, 0, 1),
    (5, 0.0, 3, 1.0, 30, 0.2, 1, 0, 0, 0, 0, 1), (80, 0.2, 40, 0.2, 60, 0.3, 0, 0, 0, 0, 0, 1), (2, 1.0, 1, 1.0, 80, 0.0, 0, 0, 0, 1, 0, 0),
    (20, 0.0, 40, 0.0, 3, 1.0, 0, 0, 0, 0, 0, 1), (12, 0.0, 30, 0.0, 2, 1.0, 0, 0, 0, 0, 0, 1), (15, 0.0, 8, 0.0, 4, 1.0, 0, 0, 0, 0, 0, 1), (6, 0.0, 60, 0.0, 2, 1.0, 0, 0, 0, 0, 0, 1), (18, 0.1, 5, 0.0, 1, 1.0, 0, 0, 0, 0, 0, 1),
    (2, 0.0, 60, 0.0, 40, 0.0, 0, 0, 0, 0, 0, 1), (1, 0.0, 50, 0.0, 80, 0.0, 0, 0, 0, 0, 0, 1), (2, 0.0, 0, 0.0, 50, 0.0, 1, 0, 0, 0, 0, 1), (2, 0.0, 6, 0.0, 30, 0.0, 0, 0, 0, 0, 0, 1), (1, 0.0, 12, 0.0, 9, 0.0, 0, 0, 0, 1, 0, 1),
    (12, 0.0, 2, 0.0, 3, 1.0, 0, 1, 0, 0, 1, 1), (30, 0.0, 3, 0.0, 2, 1.0, 0, 1, 0, 0, 1, 1), (5, 0.0, 4, 0.0, 2, 1.0, 0, 1, 0, 0, 1, 1), (1, 0.0, 3, 0.0, 3, 1.0, 0, 1, 0, 0, 1, 1), (8, 0.0, 3, 1.0, 2, 1.0, 0, 1, 0, 0, 1, 1), (4, 0.0, 1, 0.0, 5, 1.0, 0, 1, 0, 1, 1, 1),
    (3, 1.0, 80, 0.0, 2, 1.0, 0, 0, 0, 0, 0, 0), (1, 1.0, 0, 0.0, 8, 0.0, 0, 0, 0, 0, 0, 0), (4, 1.0, 70, 0.0, 0, 0.0, 0, 0, 0, 0, 0, 0),
)

# As above, then hint and the page's share of words in boilerplate: cases in which those matter.
UNUSUAL = (
    # text in a class that only hints, on a page without an article element
    (40, 0.0, 35, 0.0, 30, 0.0, 0, 0, 0, 0, 0, 1, 0.1, 1), (25, 0.0, 0, 0.0, 40, 0.0, 0, 0, 0, 0, 0, 1, 0.1, 1), (60, 0.1, 5, 0.0, 50, 0.0, 0, 0, 0, 0, 0, 1, 0.2, 1), (8, 0.0, 3, 1.0, 45, 0.0, 1, 0, 0, 0, 0, 1, 0.1, 1),
    (30, 0.0, 40, 0.0, 0, 0.0, 0, 0, 0, 0, 0, 1, 0.0, 1), (12, 0.0, 60, 0.0, 30, 0.0, 0, 0, 0, 0, 0, 1, 0.1, 1), (18, 0.0, 0, 0.0, 0, 0.0, 0, 0, 0, 0, 0, 1, 0.0, 1), (22, 0.0, 9, 0.0, 25, 0.1, 0, 0, 0, 1, 0, 1, 0.1, 1),
    (40, 0.0, 30, 0.0, 3, 1.0, 0, 0, 0, 0, 0, 1, 0.1, 1), (30, 0.0, 0, 0.0, 2, 1.0, 0, 0, 0, 0, 0, 1, 0.1, 1), (55, 0.1, 20, 0.0, 4, 0.9, 0, 0, 0, 0, 0, 1, 0.1, 1),
    # links and short notes in such a class
    (3, 1.0, 2, 1.0, 4, 1.0, 0, 0, 0, 1, 0, 1, 0.1, 0), (2, 0.0, 3, 1.0, 4, 1.0, 0, 0, 0, 0, 0, 1, 0.1, 0), (5, 0.8, 6, 1.0, 5, 1.0, 0, 0, 0, 0, 0, 1, 0.2, 0), (4, 0.0, 40, 0.0, 3, 1.0, 0, 0, 0, 0, 0, 1, 0.1, 0),
    (12, 0.5, 3, 1.0, 10, 0.6, 0, 0, 0, 0, 0, 1, 0.2, 0), (9, 0.0, 3, 1.0, 2, 1.0, 0, 0, 0, 0, 0, 1, 0.1, 0), (2, 0.0, 50, 0.0, 5, 1.0, 1, 0, 0, 0, 0, 1, 0.1, 0), (14, 0.0, 4, 1.0, 3, 1.0, 0, 0, 0, 0, 0, 1, 0.1, 0),
    # such a class within the article, and beside it
    (40, 0.0, 60, 0.0, 50, 0.0, 0, 1, 0, 0, 1, 1, 0.1, 1), (25, 0.1, 8, 0.0, 60, 0.0, 0, 1, 0, 0, 1, 1, 0.1, 1), (7, 0.0, 30, 0.0, 45, 0.0, 1, 1, 0, 0, 1, 1, 0.1, 1), (9, 0.0, 40, 0.0, 38, 0.0, 0, 1, 0, 0, 1, 1, 0.1, 1),
    (4, 1.0, 3, 1.0, 5, 1.0, 0, 1, 0, 1, 1, 1, 0.1, 0), (3, 0.0, 4, 1.0, 4, 1.0, 0, 1, 0, 0, 1, 1, 0.1, 0), (2, 1.0, 50, 0.0, 3, 1.0, 0, 1, 0, 1, 1, 1, 0.1, 0), (30, 0.0, 10, 0.0, 20, 0.0, 0, 0, 0, 0, 1, 1, 0.1, 0),
    # a page that lies in boilerplate as a whole
    (50, 0.0, 60, 0.0, 40, 0.0, 0, 0, 1, 0, 0, 0, 1.0, 1), (20, 0.0, 30, 0.0, 45, 0.0, 0, 0, 1, 0, 0, 0, 1.0, 1), (9, 0.0, 2, 1.0, 70, 0.0, 1, 0, 1, 0, 0, 0, 1.0, 1), (100, 0.1, 40, 0.0, 80, 0.0, 0, 0, 1, 0, 0, 0, 0.98, 1),
    (35, 0.0, 50, 0.0, 0, 0.0, 0, 0, 1, 0, 0, 0, 1.0, 1), (12, 0.0, 30, 0.0, 25, 0.0, 0, 0, 1, 0, 0, 0, 1.0, 1), (40, 0.0, 3, 1.0, 45, 0.0, 0, 0, 1, 0, 0, 0, 0.99, 1), (15, 0.1, 20, 0.0, 18, 0.0, 0, 0, 1, 1, 0, 0, 1.0, 1),
    (2, 1.0, 1, 1.0, 2, 1.0, 0, 0, 1, 1, 0, 0, 1.0, 0), (3, 1.0, 2, 1.0, 40, 0.0, 0, 0, 1, 0, 0, 0, 1.0, 0), (5, 0.6, 2, 1.0, 3, 1.0, 0, 0, 1, 0, 0, 0, 1.0, 0), (2, 0.0, 1, 1.0, 2, 1.0, 0, 0, 1, 0, 0, 0, 1.0, 0), (4, 0.0, 60, 0.0, 3, 1.0, 0, 0, 1, 0, 0, 0, 1.0, 0),
    (50, 0.0, 40, 0.0, 60, 0.0, 0, 1, 1, 0, 1, 0, 0.97, 1), (20, 0.0, 8, 0.0, 45, 0.0, 0, 1, 1, 0, 1, 0, 1.0, 1), (2, 1.0, 3, 1.0, 3, 1.0, 0, 1, 1, 1, 1, 0, 1.0, 0), (20, 0.0, 3, 1.0, 6, 0.0, 0, 0, 1, 0, 1, 0, 0.97, 0),
    # what comes before decides: captions of menus after links, headings and items after text
    (12, 0.0, 3, 1.0, 2, 1.0, 0, 0, 0, 0, 0, 0, 0.2, 0), (8, 0.0, 2, 1.0, 2, 1.0, 0, 0, 0, 0, 0, 0, 0.2, 0), (7, 0.0, 4, 1.0, 2, 1.0, 1, 0, 0, 0, 0, 0, 0.2, 0), (10, 0.0, 3, 1.0, 3, 1.0, 0, 0, 0, 1, 0, 0, 0.2, 0),
    (12, 0.0, 40, 0.0, 3, 1.0, 0, 0, 0, 0, 0, 0, 0.2, 1), (8, 0.0, 30, 0.0, 2, 1.0, 0, 0, 0, 0, 0, 0, 0.2, 1), (10, 0.0, 25, 0.0, 3, 1.0, 0, 0, 0, 1, 0, 0, 0.2, 1),
    # long boilerplate: comments, notices
    (80, 0.0, 60, 0.0, 70, 0.0, 0, 0, 1, 0, 0, 0, 0.6, 0), (45, 0.0, 40, 0.0, 50, 0.0, 0, 1, 1, 0, 1, 0, 0.5, 0), (120, 0.0, 100, 0.0, 90, 0.0, 0, 0, 1, 0, 1, 0, 0.7, 0), (60, 0.0, 80, 0.0, 55, 0.0, 0, 0, 1, 0, 0, 0, 0.8, 0), (35, 0.0, 30, 0.0, 60, 0.0, 0, 0, 1, 0, 1, 0, 0.85, 0),
)
# Ordinary blocks have no hint and stand on pages with little boilerplate.
LABELLED = tuple((*row[:-1], 0, 0.2, row[-1]) for row in ORDINARY) + UNUSUAL


def grow(x: np.ndarray, y: np.ndarray, least: int = 1, depth: int = 8) -> tuple:
    """A decision tree by Gini impurity: (feature, threshold, below, above) or a leaf (share of text)."""
    share = float(y.mean())
    if depth == 0 or share in (0.0, 1.0):
        return (share,)
    best = None
    for f in range(x.shape[1]):
        values = np.unique(x[:, f])
        for t in (values[1:] + values[:-1]) / 2:
            low = x[:, f] <= t
            a, b = y[low], y[~low]
            if min(len(a), len(b)) < least:
                continue
            gini = sum(len(s) * 2 * s.mean() * (1 - s.mean()) for s in (a, b)) / len(y)
            if best is None or gini < best[0] - 1e-12:
                best = (gini, f, float(t), low)
    if best is None or best[0] >= 2 * share * (1 - share) - 1e-12:
        return (share,)
    _, f, t, low = best
    return (f, t, grow(x[low], y[low], least, depth - 1), grow(x[~low], y[~low], least, depth - 1))


def tree(labelled=LABELLED) -> tuple:
    table = np.array(labelled, float)
    return grow(table[:, :-1], table[:, -1])


def decide(t: tuple, row: tuple) -> float:
    while len(t) > 1:
        t = t[2] if row[t[0]] <= t[1] else t[3]
    return t[0]


def described(found: list[Block]) -> list[tuple]:
    has, total = any(b.article for b in found), sum(b.words for b in found)
    share = sum(b.words for b in found if b.boiler) / total if total else 0.0
    out = []
    for i, b in enumerate(found):
        before, after = found[i - 1] if i else None, found[i + 1] if i + 1 < len(found) else None
        out.append((b.words, b.density, before.words if before else 0, before.density if before else 0.0, after.words if after else 0, after.density if after else 0.0, b.heading, b.article, b.boiler, b.item, has, b.hint, share))
    return out


def main_text(page: str | None, t: tuple) -> str:
    found = blocks(page or "")
    return "\n\n".join(b.text for b, row in zip(found, described(found), strict=True) if decide(t, row) >= 0.5)


def _extract(keep: tuple[str, ...], t: tuple) -> Callable:
    def run(batches):
        for batch in batches:
            texts = [main_text(h.as_py(), t) for h in batch.column(len(keep))]
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in keep), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], [*keep, "text", "n_chars"])

    return run


def extract(pages: DataFrame, html_col: str = "html", labelled=LABELLED) -> DataFrame:
    """pages without the html, with text and n_chars (code points)."""
    keep = tuple(c for c in pages.columns if c not in (html_col, "text", "n_chars"))
    schema = T.StructType([*(pages.schema[c] for c in keep), T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])
    return pages.select(*keep, pages[html_col].cast("string").alias(C.unused(keep))).mapInArrow(_extract(keep, tree(labelled)), schema)


def op1_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(C.table(spark, sf_dir, "pages").select("page_id", "url", "html"))
