"""Main text of HTML pages from flat text blocks.

A page is cut into flat text blocks at block-level tags.  Elements that never hold main text
(:data:`APART`, headers outside an article, articles within an article that has text of its own, the form
that HTML gives to comments) are left out.  Every other block has its word
count and link density, those of two neighbours on each side, marks of the elements around it,
and the share of the page's plain words that its article holds.  A decision tree, grown here on the
small labelled table ``LABELLED``, says which blocks are main text; their texts, in page
order, joined by one blank, are the page's text.  The table is read from pages that are made for it, with
menus, teasers, notices and comments of all lengths in and around their text.

Class names are one feature (``named``), whatever the length of what they name, and count only if every part of a name
says so and no other name of the element says the opposite, so "ad-slot" counts while "ad-free article" and
"social-history" do not.  Left-out end tags close where HTML closes them; an article or main element also ends a menu, form
or head left open before it, and main any name around it.

Character references are decoded, white space inside a block becomes one blank, script,
style, template and noscript content and comments are markup; a tag that the page's end cuts off is
dropped with what follows.  Reading is one pass: time grows with the page, whatever its tags are like.
Null or empty pages give an empty text.  Other columns are not looked at; repeated rows give repeated results.
"""

from __future__ import annotations

import html
import random
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, sub_batches

BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hr html "
    "legend li main menu nav ol option optgroup p pre section select summary table tbody td tfoot th thead title tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = ("script", "style", "template", "noscript", "textarea", "iframe", "svg", "math", "object", "xmp", "title")
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements that hold no main text wherever they stand.
APART = frozenset("nav footer aside form button select dialog menu label fieldset head".split())
#: Those that hold no article, so that one ends them; and what may stand in a head, which anything else ends.
ENDED_BY_ARTICLE = APART - {"aside", "footer"} | {"header"}
IN_HEAD = frozenset("base link meta noscript script style template title".split())
#: Words that say so in a class, id or role, and words that may stand beside them in one name.
APART_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promotion nav navbar navigation navigations menu menus breadcrumb breadcrumbs "
    "sidebar sidebars footer foot comment comments respond disqus replies reply cookie cookies consent notice notices gdpr popup modal overlay newsletter subscribe signup login "
    "share sharing social related recommended widget toolbar search pagination pager complementary contentinfo alert skip header topbar masthead".split()
)
BESIDE_WORDS = frozenset(
    "area bar block box btn button buttons bottom card cards column container form group head icons inline inner item items left link links list message more outer page panel "
    "post posts primary right row section side site slot small thread top unit wide wrap wrapper".split()
)
CENTRE_WORDS = frozenset("article body content main post entry story text".split())
_NAMED = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_RAW_END = {t: re.compile(rf"</{t}\s*>", re.I) for t in RAW}
_ATTRIBUTES = re.compile(r"(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+")
_NAME = re.compile(r"[a-zA-Z][^\s/>]*+")
_REFERENCE = re.compile(r"&#(?:[xX]0*+([0-9a-fA-F]{7,}+)|0*+([0-9]{8,}+));?|&#([xX]?)0{6,}+(?=[0-9a-fA-F])")
_SPLIT = re.compile(r"[^a-z0-9]+")
_CLOSED_BY = {"p": BLOCK, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option", "optgroup"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "tr": {"tr"}}

FEATURES = (
    "words", "link_density", "words_before", "density_before", "words_after", "density_after", "words_before_2", "density_before_2", "words_after_2", "density_after_2",
    "named", "named_beside", "article", "article_share", "heading", "list_item", "rights",
)
_RIGHTS = re.compile(r"©|\(c\)\s*\d{4}|\ball rights reserved\b|^copyright\b", re.I)


@lru_cache(8192)
def _names(attributes: str) -> tuple[int, int]:
    """Whether an element's names say that it stands apart; whether one of them is a word for the page's centre."""
    apart = centre = 0
    for m in _NAMED.finditer(attributes):
        for name in (m[1] or m[2] or m[3] or "").lower().split():
            parts = [w for w in _SPLIT.split(name) if w]
            centre |= len(parts) == 1 and parts[0] in CENTRE_WORDS
            apart |= any(w in APART_WORDS for w in parts) and all(w in APART_WORDS or w in BESIDE_WORDS for w in parts)
    return int(apart and not centre), int(centre and not apart)


def _decoded(text: str) -> str:
    """Character references decoded; numbers beyond Unicode, however long, are U+FFFD."""
    if "&" not in text:
        return text
    return html.unescape(_REFERENCE.sub(lambda m: "\ufffd" if m[1] or m[2] else "&#" + (m[3] or ""), text))


class Block:
    __slots__ = ("parts", "linked", "named", "centre", "heading", "item", "within")

    def __init__(self, named: int, centre: int, heading: int, item: int, within: tuple[int, ...]):
        self.parts: list[str] = []
        self.linked: list[str] = []
        self.named, self.centre, self.heading, self.item, self.within = named, centre, heading, item, within


def _tags(page: str) -> Iterator[tuple[str, str, str]]:
    """("", "", text), ("open", name, attributes) and ("close", name, "") in page order, in one pass."""
    at, start, end, quotes = 0, 0, len(page), True
    while True:
        at = page.find("<", at)
        if at < 0 or at + 1 >= end:
            break
        c = page[at + 1]
        if c == "!" or c == "?":
            stop = (page.find("-->", at + 4), 3) if page.startswith("<!--", at) else (page.find("]]>", at + 9), 3) if page.startswith("<![CDATA[", at) else (page.find(">", at), 1)
            to = stop[0] + stop[1] if stop[0] >= 0 else end
            kind = ("", "", "")
        else:
            closing = c == "/"
            m = _NAME.match(page, at + 1 + closing)
            if not m:
                at += 1
                continue
            to = _ATTRIBUTES.match(page, m.end()).end() if quotes else end
            if to >= end:  # no end outside quotes: they are not in pairs from here on
                quotes = False
                to = page.find(">", m.end())
            kind = ("close" if closing else "open", m[0].lower(), page[m.end() : to] if to >= 0 else "")
            to = to + 1 if to >= 0 else end
            if to >= end and page[-1] != ">":
                kind = ("", "", "")
        if at > start:
            yield "", "", page[start:at]
        if kind[0]:
            yield kind
        if kind[0] == "open" and kind[1] in RAW:
            close = _RAW_END[kind[1]].search(page, to)
            to = close.end() if close else end
        at = start = to
    if start < end:
        yield "", "", page[start:]


def flat_blocks(page: str) -> list[tuple[str, list[float]]]:
    """Text and features of every text block of a page that may be main text, in order."""
    stack: list[tuple[str, int, int, int]] = []  # open elements: name, whether apart, named, how surely the centre (3 article, 2 main, 1 by names)
    open_: Counter[str] = Counter()
    blocks: list[Block] = []
    block: Block | None = None
    links = 0
    articles: list[int] = []  # numbers of the open articles, outermost first
    n_articles = 0

    def drop(to: int) -> None:
        while len(stack) > to:
            name = stack.pop()[0]
            open_[name] -= 1
            if name == "article":
                articles.pop()

    for kind, tag, text in _tags(page):
        if not kind:
            _, apart, named, centre = stack[-1] if stack else ("", 0, 0, 0)
            if apart:
                block = None
                continue
            if block is None:
                tags = [s[0] for s in stack[-4:]]
                block = Block(named, centre, int(any(t in HEADINGS for t in tags)), int("li" in tags), tuple(articles[:2]))
                blocks.append(block)
            block.parts.append(text)
            if links:
                block.linked.append(text)
            continue
        if tag == "br":
            if block:
                block.parts.append(" ")
            continue
        if kind == "close":
            if tag == "a":
                links = max(0, links - 1)
            if open_[tag] and not (tag == "p" and stack[-1][0] != "p" and "p" not in [s[0] for s in stack[-6:]]):
                while stack[-1][0] != tag:
                    drop(len(stack) - 1)
                drop(len(stack) - 1)
            if tag in BLOCK:
                block = None
            continue
        if open_["head"] and tag not in IN_HEAD and tag != "head":
            while open_["head"]:
                drop(len(stack) - 1)
        if tag in ("article", "main"):  # neither stands in what is apart, so that was left open
            cut = next((i for i, x in enumerate(stack) if x[0] in (ENDED_BY_ARTICLE if tag == "article" else APART)), None)
            if cut is not None:
                drop(cut)
        if tag in BLOCK:
            block = None
            for i in range(len(stack) - 1, max(-1, len(stack) - 7), -1):
                inner = stack[i][0]
                if tag in _CLOSED_BY.get(inner, ()):
                    drop(i)
                    break
                if inner in BLOCK:
                    break
        if tag in RAW or tag in VOID or text.endswith("/"):
            continue
        away, middle = _names(text) if "=" in text and tag not in ("body", "html") else (0, 0)
        apart, named, centre = stack[-1][1:] if stack else (0, 0, 0)
        apart |= tag in APART or (tag == "header" and not centre)  # an article's own header holds its title
        named = 0 if tag == "main" else named | (away and tag != "article")
        centre = max(centre, 3 if tag == "article" else 2 if tag == "main" else middle)
        links += tag == "a"
        stack.append((tag, int(apart), int(named), centre))
        open_[tag] += 1
        if tag == "article":
            n_articles += 1
            articles.append(n_articles)

    own = {b.within[0] for b in blocks if len(b.within) == 1 and not b.named and not b.heading and "".join(b.parts).strip()}
    blocks = [b for b in blocks if len(b.within) < 2 or b.within[0] not in own]
    rows = []
    centre = max((b.centre for b in blocks if not b.named), default=0)  # the surest kind that the page has
    for b in blocks:
        text = " ".join(_decoded("".join(b.parts)).split())
        if text:
            n = text.count(" ") + 1
            linked = len(_decoded(" ".join(b.linked)).split()) / n if b.linked else 0.0
            inside = 0 < centre <= b.centre
            rows.append((text, (n, min(1.0, linked), b.named, int(inside), b.heading, b.item, int(not inside and bool(_RIGHTS.search(text))))))
    return list(zip([r[0] for r in rows], described([r[1] for r in rows])))


def described(blocks: list[tuple[float, float, int, int, int, int, int]]) -> list[list[float]]:
    """The features of a page's blocks, each given as words, link density, named, article, heading, list item and rights."""
    none = (0, 0.0, 0, 0, 0, 0, 0)
    plain = [b[0] * (1 - b[1]) * (not b[2]) for b in blocks]
    share = sum(p for p, b in zip(plain, blocks) if b[3]) / max(sum(plain), 1e-9)
    at = lambda i: blocks[i] if 0 <= i < len(blocks) else none
    return [[*map(float, (*b[:2], *at(i - 1)[:2], *at(i + 1)[:2], *at(i - 2)[:2], *at(i + 2)[:2], b[2], at(i - 1)[2] + at(i + 1)[2], b[3], share, b[4], b[5], b[6]))] for i, b in enumerate(blocks)]


MAIN = "\ue000"  # what a main block of a labelled page starts with
_LABEL_WORDS = "the of and a in to is on by it for not but had first her line among these new way could people than been call who now find long down day did get come made may part".split()


class LabelledPages:
    """Pages with known main text: each block that is main text starts with MAIN."""

    def __init__(self, seed: int):
        self.rng = random.Random(seed)

    def words(self, low: int, high: int) -> str:
        """As many words as lie between, short runs as likely as long ones."""
        n = round(low * (high / low) ** self.rng.random())
        return " ".join(self.rng.choice(_LABEL_WORDS) for _ in range(n))

    def menu(self) -> str:
        items = [f"<a href=/{i}>{self.words(1, 4)}</a>" for i in range(self.rng.randrange(3, 9))]
        return self.rng.choice([f"<ul>{''.join(f'<li>{x}</li>' for x in items)}</ul>", f"<div>{' | '.join(items)}</div>", "".join(f"<div>{x}</div>" for x in items), f"<p>{' '.join(items)}</p>"])

    def teasers(self) -> str:
        one = self.rng.choice(["<div><h3><a href=/x>{}</a></h3><p>{}</p></div>", "<div><a href=/x>{}</a></div><div>{} <a href=/y>more of this</a></div>", "<li><a href=/x>{}</a></li>"])
        return "".join(one.format(self.words(3, 12), self.words(4, 16)) for _ in range(self.rng.randrange(3, 7)))

    def aside(self) -> str:
        """A named block of any length."""
        name = self.rng.choice(["ad", "advert", "comment", "comments", "cookie-notice", "sidebar", "related-links", "newsletter-form", "share-bar", "promo", "notice", "footer-inner"])
        inner = "".join(f"<p>{self.words(2, 500)}</p>" for _ in range(self.rng.randrange(1, 5)))
        return f"<{(tag := self.rng.choice(['div', 'section']))} class='{name}'>{inner}</{tag}>"

    def text(self, inside: bool) -> str:
        parts = []
        for _ in range(self.rng.randrange(1, 9)):
            kind = self.rng.random()
            if inside and self.rng.random() < 0.1:  # a licence within the article is its text
                parts.append(f"<p>{MAIN}{self.words(1, 90)} {self.rng.choice(['All rights reserved.', '© 2019 ' + self.words(1, 3)])}</p>")
            if kind < 0.55:
                link = f" <a href=/r>{self.words(1, 5)}</a> {self.words(8, 30)}" if self.rng.random() < 0.3 else ""
                parts.append(f"<p>{MAIN}{self.words(3 if inside else 8, 260)}{link}</p>")
            elif kind < 0.7:
                parts.append(f"<h2>{MAIN}{self.words(1, 8)}</h2><p>{MAIN}{self.words(12, 200)}</p>")
            elif kind < 0.8:
                parts.append(f"<p>{MAIN}{self.words(30, 120)}</p><ul>" + "".join(f"<li>{MAIN}{self.words(2, 30)}</li>" for _ in range(self.rng.randrange(2, 6))) + f"</ul><p>{MAIN}{self.words(20, 90)}</p>")
            elif kind < 0.9 and inside:
                parts.append("<ul>" + "".join(f"<li><a href=/z>{MAIN}{self.words(1, 6)}</a></li>" for _ in range(self.rng.randrange(1, 5))) + "</ul>")
            else:
                parts.append(self.aside() if self.rng.random() < 0.5 else f"<blockquote>{MAIN}{self.words(10, 60)}</blockquote>")
        return f"<h1>{MAIN}{self.words(1, 12)}</h1>" * (self.rng.random() < 0.65) + "".join(parts) + (f"<p>{MAIN}{self.words(3 if inside else 8, 90)}</p>" if self.rng.random() < 0.8 else "")

    def page(self) -> str:
        some = lambda p, made: made() if self.rng.random() < p else ""
        inside = self.rng.random() < 0.5
        bare = self.rng.random() < 0.2  # a page of nothing but its text
        middle = self.text(inside)
        if inside:
            tag = self.rng.choice(["article", "article", "main"])
            middle = f"<{tag}>{middle}</{tag}>"
        site = lambda: f"<div>{self.words(1, 4)}</div>"
        rights = lambda: f"<div>{self.rng.choice(['© 2021', 'Copyright 2019', '(c) 2020'])} {self.words(1, 5)}{self.rng.choice(['', '. All rights reserved.'])}</div>"
        before = some(0.3, site) + some(0.55, self.menu) + some(0.3, self.aside) + (some(0.25, lambda: f"<p>{self.words(5, 90)}</p>") if inside else "")
        after = some(0.3, self.aside) + (some(0.25, lambda: f"<p>{self.words(5, 90)}</p>") if inside else "") + some(0.45, self.teasers) + some(0.5, self.menu) + some(0.4, rights)
        return f"<body>{middle}</body>" if bare else f"<body>{before}{middle}{after}</body>"


def labelled_rows(pages: list[str]) -> list[list[float]]:
    """One row for each block of labelled pages: its features, then 1 for main text."""
    return [[*x, float(text.startswith(MAIN))] for page in pages for text, x in flat_blocks(page)]


@lru_cache(2)
def labelled_table(pages: int = 600, seed: int = 7) -> tuple:
    """The labelled table that the tree is grown on."""
    made = LabelledPages(seed)
    return tuple(map(tuple, labelled_rows([made.page() for _ in range(pages)])))


LABELLED = labelled_table()


def grow_tree(rows: np.ndarray, depth: int = 9, least: int = 6):
    """A CART by Gini impurity: (feature, threshold, low branch, high branch) or a share of main text."""
    y = rows[:, -1]
    if depth == 0 or y.min() == y.max() or len(rows) < 2 * least:
        return float(y.mean())
    best = None
    for f in range(rows.shape[1] - 1):
        values = np.unique(rows[:, f])
        values = values[np.unique(np.linspace(0, len(values) - 1, 64).astype(int))]
        for t in (values[1:] + values[:-1]) / 2:
            low = rows[:, f] <= t
            n, m = int(low.sum()), int((~low).sum())
            if min(n, m) >= least:
                p, q = y[low].mean(), y[~low].mean()
                cost = n * p * (1 - p) + m * q * (1 - q)
                if best is None or cost < best[0] - 1e-12:
                    best = (cost, f, float(t))
    if best is None or best[0] >= len(y) * y.mean() * (1 - y.mean()) - 1e-12:
        return float(y.mean())
    low = rows[:, best[1]] <= best[2]
    return best[1], best[2], grow_tree(rows[low], depth - 1, least), grow_tree(rows[~low], depth - 1, least)


@lru_cache(4)
def grown(labelled: tuple):
    return grow_tree(np.array(labelled, float))


def decide(tree, x: list[float]) -> float:
    while not isinstance(tree, float):
        tree = tree[2] if x[tree[0]] <= tree[1] else tree[3]
    return tree


def main_text(page: str, tree) -> str:
    return " ".join(text for text, x in flat_blocks(page) if decide(tree, x) >= 0.5)


def extract(pages: DataFrame, *, page_id: str = "page_id", url: str = "url", source: str = "html", labelled: tuple | list = LABELLED) -> DataFrame:
    """``page_id, url, text, n_chars`` (code points) of every row."""
    tree = grown(tuple(map(tuple, labelled)))
    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.coalesce(F.col(source), F.lit("")).alias("html"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in sub_batches(batch, "html"):
                texts = [main_text(p, tree) for p in part.column("html").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                    ["page_id", "url", "text", "n_chars"],
                )

    schema = rows.select("page_id", "url").schema.add("text", "string").add("n_chars", "long")
    return map_arrow(rows, work, schema)
