"""Main text of web pages: flat text blocks, classified by a decision tree.

A page is read once from front to back, without a tree of its elements: tags that end a block cut
its text into flat blocks, and a stack of open elements tells where each block stands. A block's
features are its words and link density, those of the blocks before and after it, and one mark of
its place: inside an article, nowhere special, inside an element whose name hints at boilerplate, or
inside one that is boilerplate by its kind. A hint holds for an element, unless an article stands in
between or the element has most of the page's unlinked words. A decision tree (CART by Gini impurity) is trained on
the labelled table ``EXAMPLES`` and says which blocks are main text.

Defined cases: null and empty pages give the empty text; unclosed and stray tags are tolerated, and
so are quotes that do not close; of what has no end tag only a script or style hides the rest of the
page; white space in a block becomes one space, blocks join by one space, none is dropped by size;
repeated rows each get their text; an empty table gives no rows; columns beside the key, url and
html are not read.
"""

from __future__ import annotations

import html as _html
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>=]|=\s*+(?:\"[^\"]*\"|'[^']*')?+)*+)(?:>|\Z)", re.S)
#: Elements without text of the page; those that hide the rest of the page when they do not end.
RAW = {"script", "style", "noscript", "template", "textarea", "title", "svg", "math", "iframe", "object", "xmp", "noembed", "noframes"}
ENDLESS = {"script", "style"}
CLOSE = {tag: re.compile(rf"</{tag}\s*>", re.I) for tag in RAW}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q ruby rt rp s samp small span strike strong sub sup time tt u var wbr img".split())
#: Elements whose start closes an open one of the same group.
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
AUTO_P = set("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol pre section table ul".split())
#: Elements, roles and words of class or id that are boilerplate by their kind; that hint at it; that mark an article.
BOILER_TAGS = {"nav", "footer", "aside", "button", "select", "menu", "dialog", "head"}
BOILER_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "alertdialog", "menu", "menubar"}
BOILER_WORDS = set(
    "ad ads adv advert adverts advertisement advertising sponsored nav navbar navigation menu menubar breadcrumb breadcrumbs footer foot sidebar "
    "cookie cookies consent gdpr popup modal newsletter comment comments respond disqus replies pagination skip".split()
)
HINT_WORDS = set(
    "banner sponsor promo promotion header masthead side rail widget notice notices notification alert overlay subscribe signup "
    "login share sharing social reply discussion related recommended recirculation pager toolbar search copyright legal form".split()
)
ARTICLE_TAGS = {"article", "main"}
ARTICLE_WORDS = {"article", "content", "post", "entry", "story", "main", "body", "text"}
#: Words of boilerplate that stay so beside a word of an article ("post-comments", "article-footer").
ALWAYS = {"comment", "comments", "respond", "disqus", "replies", "footer", "cookie", "cookies", "ad", "ads", "nav", "menu"}
HIDDEN = re.compile(r"""\shidden(?:[\s=/]|$)|aria-hidden\s*=\s*["']?true|display\s*:\s*none""", re.I)
ATTRIBUTE = re.compile(r"""(?:^|\s)(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)


@dataclass
class Block:
    text: str
    words: int
    linked: int
    boiler: int
    article: int
    hints: tuple[int, ...]

    @property
    def density(self) -> float:
        return self.linked / self.words if self.words else 0.0


def _place(tag: str, attributes: str, in_article: int) -> tuple[int, int, int]:
    """(boilerplate, article, hint) marks that an element adds."""
    if tag in ("body", "html"):
        return 0, 0, 0
    boiler = tag in BOILER_TAGS or tag == "header" and not in_article
    article, hint = tag in ARTICLE_TAGS, tag == "form"
    if attributes:
        boiler |= bool(HIDDEN.search(attributes))
        for name, value in ATTRIBUTE.findall(attributes):
            value = value.strip("\"'")
            if name.lower() == "role":
                boiler |= value.lower() in BOILER_ROLES
                article |= value.lower() in ("main", "article")
                hint |= value.lower() == "form"
                continue
            words = set(re.split(r"[^a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", value).lower()))
            own = bool(words & ARTICLE_WORDS)
            if words & (ALWAYS if own or tag == "article" else BOILER_WORDS):
                # an article beside a sidebar is named for it, a comment that is an article is none
                boiler = True
            elif words & (BOILER_WORDS | HINT_WORDS) and not own and tag != "article":
                hint = True
            article |= own
    return int(boiler), int(article and not boiler), int(hint and not boiler)


def blocks(page: str) -> Iterator[Block]:
    """The flat text blocks of a page, in order."""
    stack: list[tuple[str, int, int, tuple[int, ...]]] = []
    boiler = article = links = at = 0
    hints: tuple[int, ...] = ()
    parts: list[tuple[str, bool]] = []

    def take() -> Block | None:
        nonlocal parts
        text = " ".join("".join(t for t, _ in parts).split())
        linked = sum(len(t.split()) for t, on in parts if on)
        parts = []
        return Block(text, len(text.split()), linked, boiler, article, hints) if text else None

    def pop(to: int) -> None:
        nonlocal boiler, article, links, hints
        while len(stack) > to:
            tag, b, a, hints = stack.pop()
            boiler, article, links = boiler - b, article - a, links - (tag == "a")

    while at < len(page):
        m = TOKEN.search(page, at)
        if (text := page[at : m.start() if m else len(page)]):
            parts.append((_html.unescape(text), links > 0))
        if not m:
            break
        at = m.end()
        if m.group(2) is None:
            continue
        tag, ends, closed = m.group(2).lower(), bool(m.group(1)), m.group(3).rstrip().endswith("/")
        if tag not in INLINE and (block := take()):
            yield block
        if ends:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    pop(k)
                    break
                if tag in INLINE and stack[k][0] not in INLINE:
                    break
            continue
        if tag in RAW:
            if not (closed and tag in ("svg", "math")):
                close = CLOSE[tag].search(page, at)
                at = close.end() if close else len(page) if tag in ENDLESS else at
            continue
        closes = CLOSES.get(tag) or ({"p"} if tag in AUTO_P else None)
        if closes:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] in closes:
                    pop(k)
                    break
                if stack[k][0] not in INLINE:
                    break
        if tag in VOID or closed and tag not in INLINE | {"p", "div"}:
            continue
        if tag == "a":
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == "a":
                    stack[k] = ("span", *stack[k][1:])
                    links -= 1
                    break
        b, a, hint = _place(tag, m.group(3), article)
        stack.append((tag, b, a, hints))
        boiler, article, links = boiler + b, article + a, links + (tag == "a")
        hints = () if a and tag in ARTICLE_TAGS else (*hints, m.start()) if hint else hints
    if block := take():
        yield block


#: Columns of EXAMPLES and of a block's features; the mark is -1 in an article, 1 under a hint, 2 in boilerplate.
NAMES = ("words", "density", "words_before", "density_before", "words_after", "density_after", "mark")
#: The labelled table: blocks as they stand on common pages; the last column says main text.
EXAMPLES = (
    # menus, lists of links, adverts, notices, footers and comments, marked by their kind, short or long
    (1, 1.0, 0, 0.0, 1, 1.0, 2, 0), (2, 1.0, 1, 1.0, 8, 0.0, 2, 0), (1, 1.0, 1, 1.0, 12, 0.0, 2, 0), (7, 0.0, 1, 1.0, 9, 0.0, 2, 0), (12, 0.0, 1, 1.0, 10, 0.0, 2, 0),
    (5, 0.0, 80, 0.0, 0, 0.0, 2, 0), (14, 0.07, 60, 0.0, 0, 0.0, 2, 0), (40, 0.0, 1, 1.0, 60, 0.0, 2, 0), (120, 0.0, 50, 0.0, 30, 0.0, 2, 0), (25, 0.0, 30, 0.0, 40, 0.0, 2, 0),
    (60, 0.0, 90, 0.0, 70, 0.0, 2, 0), (3, 0.0, 2, 0.0, 2, 0.0, 2, 0), (200, 0.01, 10, 0.0, 0, 0.0, 2, 0), (1, 0.0, 1, 0.0, 1, 0.0, 2, 0), (8, 0.25, 100, 0.0, 0, 0.0, 2, 0),
    # under a hint: notices, promotions, forms, teasers
    (2, 0.0, 1, 1.0, 1, 1.0, 1, 0), (9, 0.0, 0, 0.0, 300, 0.0, 1, 0), (18, 0.11, 4, 1.0, 6, 0.33, 1, 0), (1, 1.0, 90, 0.0, 1, 1.0, 1, 0), (4, 0.0, 3, 0.0, 3, 0.0, 1, 0),
    (30, 0.0, 60, 0.0, 20, 0.1, 1, 0), (40, 0.0, 2, 1.0, 8, 0.0, 1, 0), (12, 0.5, 70, 0.0, 12, 0.5, 1, 0), (25, 0.9, 30, 0.8, 25, 0.9, 1, 0), (15, 0.0, 80, 0.0, 0, 0.0, 1, 0),
    # links and lists of links on pages without marks, also long ones
    (1, 1.0, 0, 0.0, 1, 1.0, 0, 0), (1, 1.0, 1, 1.0, 1, 1.0, 0, 0), (3, 1.0, 2, 1.0, 2, 1.0, 0, 0), (2, 1.0, 1, 1.0, 30, 0.0, 0, 0), (4, 1.0, 60, 0.0, 5, 1.0, 0, 0),
    (6, 0.83, 5, 1.0, 4, 1.0, 0, 0), (9, 0.78, 8, 0.88, 7, 1.0, 0, 0), (5, 0.8, 40, 0.05, 3, 0.67, 0, 0), (22, 0.9, 20, 0.9, 25, 0.95, 0, 0), (40, 0.85, 35, 0.0, 30, 0.9, 0, 0),
    (30, 0.7, 60, 0.0, 45, 0.0, 0, 0), (8, 1.0, 70, 0.0, 60, 0.0, 0, 0), (60, 0.75, 2, 1.0, 50, 0.8, 0, 0), (12, 0.6, 9, 0.9, 11, 0.7, 0, 0), (3, 1.0, 80, 0.0, 50, 0.0, 0, 0),
    # short blocks between links, and lone ones at the edges of pages without marks
    (2, 0.0, 1, 1.0, 1, 1.0, 0, 0), (3, 0.0, 2, 1.0, 2, 1.0, 0, 0), (4, 0.0, 3, 1.0, 1, 1.0, 0, 0), (6, 0.0, 2, 1.0, 0, 0.0, 0, 0), (5, 0.2, 1, 1.0, 0, 0.0, 0, 0),
    (3, 0.0, 1, 1.0, 0, 0.0, 0, 0), (7, 0.43, 2, 1.0, 3, 1.0, 0, 0), (4, 0.5, 0, 0.0, 2, 1.0, 0, 0),
    # headings, paragraphs, list items and table cells of marked articles, short or long, linked or not
    (8, 0.0, 7, 0.0, 60, 0.0, -1, 1), (1, 0.0, 5, 0.0, 1, 0.0, -1, 1), (1, 0.0, 1, 1.0, 30, 0.0, -1, 1), (2, 0.0, 80, 0.0, 40, 0.0, -1, 1), (150, 0.02, 10, 0.0, 90, 0.0, -1, 1),
    (1, 1.0, 40, 0.0, 1, 1.0, -1, 1), (3, 1.0, 50, 0.0, 60, 0.0, -1, 1), (5, 0.6, 20, 0.1, 30, 0.0, -1, 1), (2, 0.0, 1, 1.0, 0, 0.0, -1, 1), (1, 1.0, 1, 1.0, 1, 1.0, -1, 1),
    (30, 0.1, 25, 0.0, 1, 1.0, -1, 1), (1, 0.0, 0, 0.0, 0, 0.0, -1, 1), (6, 0.17, 2, 1.0, 1, 1.0, -1, 1), (3, 0.0, 2, 1.0, 2, 1.0, -1, 1), (2, 1.0, 1, 1.0, 9, 0.0, -1, 1), (20, 1.0, 30, 0.0, 20, 0.9, -1, 1),
    # text of pages without marks
    (60, 0.0, 8, 0.0, 70, 0.0, 0, 1), (35, 0.03, 60, 0.0, 20, 0.0, 0, 1), (120, 0.05, 1, 1.0, 90, 0.0, 0, 1), (20, 0.0, 40, 0.0, 5, 0.2, 0, 1), (9, 0.0, 1, 1.0, 60, 0.0, 0, 1),
    (7, 0.0, 60, 0.0, 80, 0.0, 0, 1), (4, 0.0, 50, 0.0, 60, 0.0, 0, 1), (12, 0.0, 20, 0.0, 30, 0.0, 0, 1), (5, 0.0, 0, 0.0, 40, 0.0, 0, 1), (15, 0.1, 12, 0.0, 18, 0.0, 0, 1),
    (25, 0.2, 30, 0.1, 25, 0.1, 0, 1), (11, 0.0, 0, 0.0, 0, 0.0, 0, 1), (3, 0.0, 30, 0.0, 0, 0.0, 0, 1), (2, 0.0, 25, 0.0, 12, 0.0, 0, 1), (18, 0.0, 9, 0.0, 2, 1.0, 0, 1), (30, 0.27, 45, 0.0, 50, 0.0, 0, 1),
    (40, 0.3, 35, 0.2, 30, 0.9, 0, 1), (6, 0.33, 40, 0.0, 50, 0.1, 0, 1), (2, 0.0, 3, 0.0, 40, 0.0, 0, 1), (1, 0.0, 0, 0.0, 0, 0.0, 0, 1),
    (2, 0.0, 1, 1.0, 45, 0.0, 0, 1), (3, 0.0, 2, 1.0, 80, 0.0, 0, 1), (6, 0.0, 3, 1.0, 30, 0.0, 0, 1), (42, 0.0, 5, 1.0, 0, 0.0, 0, 1), (25, 0.0, 4, 1.0, 3, 1.0, 0, 1), (14, 0.0, 3, 1.0, 9, 0.0, 0, 1),
)


def grow(rows: list[tuple[tuple[float, ...], int]], depth: int = 8):
    """A tree of (feature, threshold, low, high), its leaves the majority (0 or 1)."""
    ones = sum(y for _, y in rows)
    if not depth or ones in (0, len(rows)):
        return int(2 * ones > len(rows))
    best = None
    for f in range(len(rows[0][0])):
        values = sorted({x[f] for x, _ in rows})
        for lo, hi in zip(values, values[1:], strict=False):
            cut = (lo + hi) / 2
            left = [y for x, y in rows if x[f] <= cut]
            impurity = 2 * sum(left) * (len(left) - sum(left)) / len(left)
            n, k = len(rows) - len(left), ones - sum(left)
            impurity += 2 * k * (n - k) / n
            if best is None or impurity < best[0] - 1e-12:
                best = impurity, f, cut
    if best is None:
        return int(2 * ones > len(rows))
    _, f, cut = best
    return f, cut, grow([r for r in rows if r[0][f] <= cut], depth - 1), grow([r for r in rows if r[0][f] > cut], depth - 1)


def classify(tree, x: tuple[float, ...]) -> int:
    while not isinstance(tree, int):
        tree = tree[2] if x[tree[0]] <= tree[1] else tree[3]
    return tree


def trained():
    return grow([(tuple(map(float, r[:-1])), r[-1]) for r in EXAMPLES])


def void_hints(found: list[Block]) -> set[int]:
    """The elements with a hint that hold most of a page's unlinked words outside of boilerplate: its frame."""
    held: dict[int, int] = {}
    every = 0
    for b in found:
        if not b.boiler:
            every += b.words - b.linked
            for h in b.hints:
                held[h] = held.get(h, 0) + b.words - b.linked
    return {h for h, n in held.items() if 2 * n > every}


def features(b: Block, before: Block | None, after: Block | None, void: set[int]) -> tuple[float, ...]:
    mark = 2 if b.boiler else 1 if any(h not in void for h in b.hints) else -1 if b.article else 0
    return (
        float(b.words), b.density, float(before.words if before else 0), before.density if before else 0.0,
        float(after.words if after else 0), after.density if after else 0.0, float(mark),
    )


def main_text(page: str | None, tree) -> str:
    found = list(blocks(page)) if page else []
    void = void_hints(found)
    around = [None, *found, None]
    return " ".join(b.text for before, b, after in zip(around, found, around[2:], strict=False) if classify(tree, features(b, before, after, void)))


def extract(df: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row a row of ``df``: id, url, text, n_chars."""
    kinds = [df.schema[c].dataType.simpleString() for c in (id_col, url_col)]
    tree = trained()

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            texts = [main_text(h if isinstance(h, str) else None, tree) for h in frame["html"]]
            yield pd.DataFrame({"id": frame["id"], "url": frame["url"], "text": texts, "n_chars": [len(t) for t in texts]})

    out = df.select(F.col(id_col).cast("string").alias("id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).alias("html"))
    out = out.mapInPandas(read, "id string, url string, text string, n_chars long")
    return out.select(F.col("id").cast(kinds[0]).alias(id_col), F.col("url").cast(kinds[1]).alias(url_col), "text", "n_chars")
