"""HTML extraction: flat text blocks classified by a decision tree.

A page is read as a flat list of text blocks, cut at block-level tags.  Each
block has its word count and link density, those of its neighbours on both
sides, and marks of where it stands, which are weaker evidence: a split by a
mark must gain half as much again as one by words or links.  A decision tree
(Gini, numpy) is trained on a small labelled table of blocks that a seeded rule
lays out as pages, with and without marks.

Defined results: null or empty html, and pages without main text, give the
empty text; unclosed and stray tags are tolerated; a page may end anywhere;
repeated rows give the same result; pages of any length are read whole.
"""

from __future__ import annotations

import html
import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.llm.runtime import add_columns

#: One piece of markup: comment, raw-text element with its content, tag, declaration.
_MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<raw>script|style|noscript|template|svg|math|iframe|object|select|textarea|title|head(?=[\s>]))\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*>"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)>"
    r"|<[!?][^>]*(?:>|\Z)",
    re.S | re.I,
)
#: One attribute: its whole name, and its whole value if it has one.
_ATTR = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")

#: Elements that break the text into blocks.
BLOCK_TAGS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: Elements without an end tag.
VOID_TAGS = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: Elements that an opening tag of the same kind closes.
SELF_CLOSING = frozenset("p li dt dd tr td th option".split())
#: Elements whose blocks are seldom main text.
FRAME_TAGS = frozenset("nav footer aside form menu button dialog fieldset label".split())
#: Words in class, id and role of parts that are no main text whatever they hold.
FRAME_WORDS = re.compile(
    r"(?:^|[\s_-])(?:ads?|adverts?|advert\w*|banner|sponsor\w*|comments?|disqus|replies|respond|cookies?|consent|gdpr|notice|alert|popup|modal|overlay|newsletter|"
    r"subscribe|signup|login|sidebar|nav\w*|menu|breadcrumbs?|pagination|pager|footer|masthead|topbar|toolbar|complementary|contentinfo|navigation)(?:$|[\s_-])",
    re.I,
)
#: Words of parts that may be either; their words and links decide.
DOUBTFUL_WORDS = re.compile(
    r"(?:^|[\s_-])(?:promo\w*|side|widget|related|recommend\w*|share|sharing|social|copyright|legal|disclaimer|search|skip|toc|tags|meta|byline)(?:$|[\s_-])", re.I
)
#: Elements that are text themselves; their class and id say how it looks, not what it is.
TEXT_TAGS = frozenset("p h1 h2 h3 h4 h5 h6 pre blockquote article main body html".split())


def attributes(raw: str) -> dict[str, str]:
    """A tag's attributes; of a repeated name the first counts."""
    out: dict[str, str] = {}
    for name, value in _ATTR.findall(raw):
        out.setdefault(name.lower(), value.strip("\"'"))
    return out


@dataclass
class Block:
    text: str
    words: int
    density: float
    article: bool
    frame: bool
    doubtful: bool
    heading: bool


@dataclass
class _Open:
    tag: str
    frame: bool
    doubtful: bool
    article: bool
    hidden: bool


def blocks(page: str) -> list[Block]:
    """The page's text blocks, in order."""
    out: list[Block] = []
    stack: list[_Open] = []
    parts: list[str] = []
    linked: list[str] = []
    heading = False
    in_link = 0
    at = 0

    def flush() -> None:
        text = " ".join(html.unescape("".join(parts)).split())
        parts.clear()
        n_link = len(html.unescape(" ".join(linked)).split())
        linked.clear()
        if text and not any(o.hidden for o in stack):
            n = len(text.split(" "))
            article = any(o.article for o in stack)
            out.append(Block(text, n, min(1.0, n_link / n), article, any(o.frame for o in stack), any(o.doubtful for o in stack), heading))

    def say(text: str) -> None:
        if text:
            parts.append(text)
            if in_link:
                linked.append(text)

    while True:
        m = _MARKUP.search(page, at)
        if m is None:
            say(page[at:])
            break
        say(page[at : m.start()])
        at = m.end()
        if m["raw"]:
            # The content of these elements is no text; it ends at their end tag.
            name = m["raw"].lower()
            if m[0].endswith("/>") and name in ("svg", "math", "object", "iframe"):
                continue
            close = re.compile(rf"</{name}\s*>", re.I).search(page, at) if name != "head" else re.compile(r"</head\s*>|<body\b", re.I).search(page, at)
            at = len(page) if close is None else close.start() if name == "head" and close[0][1] != "/" else close.end()
            if name == "title":
                continue
            if name in ("select", "textarea"):
                parts.append(" ")
            continue
        if not m["tag"]:
            continue
        tag, end = m["tag"].lower(), bool(m["end"])
        if tag == "br":
            parts.append(" ")
        elif tag == "a":
            in_link = max(0, in_link + (-1 if end else 1))
        if tag not in BLOCK_TAGS and tag not in ("label",):
            continue
        flush()
        in_link = 0 if tag != "label" else in_link
        if tag in VOID_TAGS:
            continue
        if end:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i].tag == tag:
                    del stack[i:]
                    break
        else:
            if tag in SELF_CLOSING:
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i].tag == tag:
                        del stack[i:]
                        break
                    if stack[i].tag not in ("p",):
                        break
            elif stack and stack[-1].tag == "p":
                stack.pop()
            attrs = attributes(m["attrs"]) if m["attrs"] else {}
            named = "" if tag in TEXT_TAGS else " ".join(attrs.get(k, "") for k in ("class", "id", "role"))
            article = tag in ("article", "main") or attrs.get("role", "").lower() in ("main", "article") or attrs.get("itemprop", "").lower() == "articlebody"
            inside = any(o.article for o in stack)
            frame = tag in FRAME_TAGS or (tag == "header" and not inside) or bool(named and FRAME_WORDS.search(named))
            doubtful = bool(named and DOUBTFUL_WORDS.search(named))
            hidden = "hidden" in attrs or attrs.get("aria-hidden", "").lower() == "true" or "display:none" in attrs.get("style", "").replace(" ", "").lower()
            stack.append(_Open(tag, frame, doubtful, article, hidden))
        heading = any(o.tag in ("h1", "h2", "h3", "h4", "h5", "h6") for o in stack[-2:])
    flush()
    return out


#: Names of the features of a block: those of words and links, then the marks.
FEATURES = ("words", "density", "words_before", "density_before", "words_after", "density_after", "words_near", "density_near", "article", "frame", "doubtful", "heading", "any_article")
_MARKS = 8
_REACH = 3


def features(found: list[Block]) -> np.ndarray:
    """A row for each block. ``_near`` is over the blocks up to three before and after, without the block."""
    n = len(found)
    X = np.zeros((n, len(FEATURES)))
    if n:
        words = np.array([b.words for b in found], float)
        dens = np.array([b.density for b in found], float)
        X[:, 0], X[:, 1] = words, dens
        X[1:, 2], X[1:, 3] = words[:-1], dens[:-1]
        X[:-1, 4], X[:-1, 5] = words[1:], dens[1:]
        sums, linked = np.concatenate(([0], np.cumsum(words))), np.concatenate(([0], np.cumsum(words * dens)))
        low, high = np.maximum(np.arange(n) - _REACH, 0), np.minimum(np.arange(n) + _REACH + 1, n)
        X[:, 6] = sums[high] - sums[low] - words
        X[:, 7] = (linked[high] - linked[low] - words * dens) / np.maximum(X[:, 6], 1)
        for i, name in enumerate(FEATURES[_MARKS:-1], _MARKS):
            X[:, i] = [getattr(b, name) for b in found]
        X[:, -1] = any(b.article for b in found)
    return X


def labelled(pages: int = 240, seed: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """The labelled table: features of blocks, and which are main text. Pages are laid out by rule."""
    rng = np.random.default_rng(seed)
    rows, labels = [], []
    chance = rng.random

    def size(low: int, high: int) -> int:
        return int(np.exp(rng.uniform(np.log(low), np.log(high + 1))))

    for _ in range(pages):
        marked = chance() < 0.7  # the page says which part is its article
        classed = marked or chance() < 0.5  # and what its frames are
        out: list[tuple[Block, bool]] = []

        def add(kind: str, words: int, density: float, main: bool, inside: bool = False) -> None:
            frame = kind == "frame" and classed
            out.append((Block("", words, density, inside and marked, frame, kind == "doubtful" and classed, kind == "heading"), main))

        def links(kind: str, low: int, high: int, inside: bool = False) -> None:
            for _ in range(rng.integers(low, high + 1)):
                add(kind, size(1, 6), 1.0 if chance() < 0.8 else rng.uniform(0.6, 1), False, inside)

        if chance() < 0.3:
            add("frame", size(1, 8), 0, False)
        if chance() < 0.9:
            links("frame", 3, 9)
        if chance() < 0.5:
            add("frame", size(5, 40) if marked else size(4, 14), 0 if chance() < 0.7 else rng.uniform(0.1, 0.6), False)
        if marked and chance() < 0.3:
            add("stray", size(3, 60), 0, False)
        if chance() < 0.8:
            add("heading", size(1, 20), 0, True, True)
        for i in range(rng.integers(1, 9)):
            add("text", size(1, 160) if marked else size(15, 160), 0 if chance() < 0.6 else rng.uniform(0, 0.35), True, True)
            if chance() < 0.08:
                add("heading", size(1, 8), 0, True, True)
            if chance() < 0.08 and i:  # a list of a few items, with few links
                for _ in range(rng.integers(2, 5)):
                    add("text", size(2, 30), 0 if chance() < 0.8 else rng.uniform(0, 0.4), True, True)
            if chance() < 0.08:
                add("doubtful", size(25, 120), 0 if chance() < 0.8 else rng.uniform(0, 0.2), True, True)
            if chance() < 0.06 and i:  # an advert or a form within the article
                add("frame", size(2, 40) if marked else size(2, 8), 0 if chance() < 0.5 else rng.uniform(0.5, 1), False, True)
        if chance() < 0.4:  # more to read, within the article or after it
            kind = "doubtful" if chance() < 0.5 else "text"
            links(kind, 3, 7, True)
        if chance() < 0.2:
            add("doubtful", size(1, 8), rng.uniform(0.5, 1), False, True)
        if chance() < 0.3 and classed:
            for _ in range(rng.integers(1, 4)):
                add("frame", size(5, 80), 0, False, chance() < 0.5)
        if marked and chance() < 0.3:
            add("stray", size(3, 60), 0, False)
        if chance() < 0.3:
            links("frame", 2, 7)
        if chance() < 0.9:
            add("frame", size(3, 25) if classed else size(2, 8), 0 if chance() < 0.5 else rng.uniform(0.2, 0.8), False)
        rows.append(features([b for b, _ in out]))
        labels.append([main for _, main in out])
    return np.concatenate(rows), np.concatenate(labels).astype(float)


@dataclass
class Tree:
    """A binary decision tree as flat arrays; a leaf has feature -1."""

    feature: list[int] = field(default_factory=list)
    limit: list[float] = field(default_factory=list)
    left: list[int] = field(default_factory=list)
    right: list[int] = field(default_factory=list)
    value: list[float] = field(default_factory=list)

    def _node(self, X: np.ndarray, y: np.ndarray, depth: int) -> int:
        me = len(self.feature)
        for column, x in ((self.feature, -1), (self.limit, 0.0), (self.left, -1), (self.right, -1), (self.value, float(y.mean()))):
            column.append(x)
        if depth and 0 < y.sum() < len(y):
            impurity = lambda n, ones: 2 * ones * (n - ones) / np.maximum(n, 1)
            whole, best = impurity(len(y), y.sum()), (1e-9, -1, 0.0)
            for f in range(X.shape[1]):
                by = np.argsort(X[:, f], kind="stable")
                x, ones = X[by, f], np.cumsum(y[by])[:-1]
                n = np.arange(1, len(y))
                gain = whole - impurity(n, ones) - impurity(len(y) - n, ones[-1] + y[by[-1]] - ones) if len(y) > 1 else np.zeros(0)
                gain = np.where(x[1:] > x[:-1], gain, 0) * (1.0 if f < _MARKS else 2 / 3)
                if len(gain) and gain.max() > best[0] + 1e-9:
                    at = int(gain.argmax())
                    best = (float(gain[at]), f, float(x[at] + x[at + 1]) / 2)
            if best[1] >= 0:
                low = X[:, best[1]] <= best[2]
                self.feature[me], self.limit[me] = best[1], best[2]
                self.left[me] = self._node(X[low], y[low], depth - 1)
                self.right[me] = self._node(X[~low], y[~low], depth - 1)
        return me

    @classmethod
    def train(cls, table: tuple[np.ndarray, np.ndarray] | None = None, depth: int = 14) -> "Tree":
        tree = cls()
        tree._node(*(labelled() if table is None else table), depth)
        return tree

    def predict(self, X: np.ndarray) -> np.ndarray:
        at = np.zeros(len(X), int)
        feature, limit = np.array(self.feature), np.array(self.limit)
        left, right = np.array(self.left), np.array(self.right)
        while (feature[at] >= 0).any():
            f = feature[at]
            inner = f >= 0
            low = X[np.arange(len(X)), np.maximum(f, 0)] <= limit[at]
            at = np.where(inner, np.where(low, left[at], right[at]), at)
        return np.array(self.value)[at] >= 0.5


def main_text(page: str, tree: Tree) -> str:
    """The main text: kept blocks, one to a line."""
    found = blocks(page)
    if not found:
        return ""
    keep = tree.predict(features(found))
    return "\n".join(b.text for b, k in zip(found, keep) if k)


def extract(pages: DataFrame, html_col: str = "html", keep: list[str] | None = None, tree: Tree | None = None) -> DataFrame:
    """Pages with ``text`` and ``n_chars`` added."""
    tree = tree or Tree.train()

    def compute(col: pa.Array) -> list[pa.Array]:
        texts = [main_text(x, tree) if x else "" for x in col.to_pylist()]
        return [pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]

    return add_columns(pages, html_col, [T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())], compute, keep)


def run(pages: DataFrame) -> DataFrame:
    """One row per page: page_id, url, text, n_chars."""
    return extract(pages.select("page_id", "url", F.col("html")), keep=["page_id", "url"])
