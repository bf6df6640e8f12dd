"""Main text of web pages as the maximum-scoring subsequence of words and tags.

Two scores are learned by regularised logistic regression from labelled pages: whether a text is part of the article, and
whether a place lies between the article's first and last word. Features are the elements around (tags, words of class, id and
role, each weighing less the more words its name has), the share of links, and the length and punctuation of the block. Words
score the second log-odds, which are positive in likely article, with diminishing weight within a block; tags score negative,
as learned by tag, the less the surer their place is inside. One linear scan over all words and tags of the page finds the
contiguous region with the greatest sum. In it, text with a negative first score (an advert or a form within the article) is
left out.

Edge cases: a null or empty page, and one without a word of positive score, gives the empty text; of equal regions the first
wins; unclosed and stray tags, comments and raw text elements are tolerated at any depth; each input row gives one output row.
"""

from __future__ import annotations

import html as html_lib
import math
import re
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import labelled_pages
from .common import batched

#: Elements whose content is never text of the page.
RAW = "script style noscript template svg iframe object textarea select title math canvas audio video".split()
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "html body head address article aside blockquote br center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption option button".split()
)
#: A new one of these ends an open one of the same group.
CLOSES = {"p": "p", "li": "li", "dt": "dt dd", "dd": "dt dd", "tr": "tr td th", "td": "td th", "th": "td th", "option": "option"}
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(" + "|".join(RAW) + r")\b(?:\"[^\"]*\"|'[^']*'|[^'\"<>])*+>.*?(?:</\1\s*>|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/<>]*)((?:\"[^\"]*\"|'[^']*'|[^'\"<>])*+)>",
    re.S | re.I,
)
ATTR = re.compile(r"\b(class|id|role|itemprop|hidden)\b(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?", re.I)
NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
SCOPE = frozenset("ul ol dl table div section article aside main select body".split())
#: Log-odds are held within this bound, so that no single block decides.
CLIP = 4.0
#: Labelled pages that must have a feature for it to be learned.
LEAST_PAGES = 6


class Context:
    """The elements around a place: the features of the path with their values, and the two log-odds they add up to."""

    __slots__ = ("values", "text", "place", "children")

    def __init__(self, values: dict[str, float], text: float, place: float):
        self.values, self.text, self.place, self.children = values, text, place, {}


@lru_cache(maxsize=50_000)
def features(tag: str, attrs: str) -> tuple[tuple[str, float], ...]:
    """(feature, value) of an element: its tag, and the words of its names."""
    out = {f"t:{tag}": 1.0}
    for name, value in ATTR.findall(attrs):
        if name.lower() == "hidden":
            out["hidden"] = 1.0
        for token in value.strip("\"'").split():
            words = [w.lower().removesuffix("s") or w.lower() for w in NAME.findall(token)]
            for w in words:
                out[f"c:{w}"] = max(out.get(f"c:{w}", 0.0), len(words) ** -1.5)
            if words:
                out[f"h:{words[-1]}"] = 1.0
    return tuple(out.items())


class Block:
    """What a block of text adds to the features of its path: length, link share, punctuation."""

    NAMES = ("b:length", "b:links", "b:heavy", "b:stop")
    __slots__ = ("words", "linked", "stops")

    def __init__(self):
        self.words = self.linked = self.stops = 0

    def add(self, text: str, linked: bool) -> None:
        n = len(text.split())
        self.words += n
        self.linked += n * linked
        self.stops += text.count(".") + text.count(",") + text.count("?") + text.count("!")

    def values(self) -> tuple[float, ...]:
        n = max(1, self.words)
        return (min(1.0, math.log1p(self.words) / 3), self.linked / n, float(2 * self.linked > n), float(self.stops > 0))


def scan(page: str, enter, root):
    """Tokens in page order: (tag, None, context, position, None) or (None, text, context, position, block).

    enter(context around, features) gives the context of an element; contexts are opaque here.
    """
    stack: list[tuple[str, object]] = []
    opened: dict[str, int] = {}
    at = 0
    block = Block()

    def pop_to(i: int) -> None:
        for name, _ in stack[i:]:
            opened[name] -= 1
        del stack[i:]

    for m in TOKEN.finditer(page):
        here = stack[-1][1] if stack else root
        if m.start() > at:
            text = page[at : m.start()]
            block.add(text, opened.get("a", 0) > 0)
            yield None, text, here, at, block
        at = m.end()
        tag = m[3]
        if tag is None:
            continue
        tag = tag.lower()
        if tag in BLOCK and tag != "br":
            block = Block()
        if m[2]:
            if opened.get(tag):
                i = len(stack) - 1
                while stack[i][0] != tag:
                    i -= 1
                here = stack[i][1]
                pop_to(i)
        elif tag not in VOID and not m[4].endswith("/"):
            group = CLOSES.get(tag, "").split()
            if any(opened.get(x) for x in group):
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] in group:
                        pop_to(i)
                        break
                    if stack[i][0] in SCOPE:
                        break
            here = enter(stack[-1][1] if stack else root, features(tag, m[4]))
            stack.append((tag, here))
            opened[tag] = opened.get(tag, 0) + 1
        if tag in BLOCK:
            yield tag, None, here, m.start(), None
    if at < len(page):
        block.add(page[at:], opened.get("a", 0) > 0)
        yield None, page[at:], stack[-1][1] if stack else root, at, block


def _fit(x: np.ndarray, y: np.ndarray, n: np.ndarray, ridge: float = 0.2) -> np.ndarray:
    """Weights of a logistic regression by Newton steps; the last column of x is the bias."""
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (n * p * (1 - p) + 1e-9)[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (n * (y - p)) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-3:
            break
    return w


@lru_cache(maxsize=1)
def weights() -> tuple[dict[str, tuple[float, float]], tuple[float, float], dict[str, float]]:
    """(weights of each feature, biases, cost of each tag) learned from the labelled pages; pairs are for text and place."""
    rows, tags, seen = [], {}, Counter()
    for page, spans in labelled_pages.pages():
        first, last = spans[0][0], spans[-1][1]
        own: set[str] = set()
        for tag, text, context, at, block in scan(page, lambda up, own: up | {f: max(v, up.get(f, 0.0)) for f, v in own}, {}):
            if tag is not None:
                tags.setdefault(tag, [1.0, 1.0])[first <= at < last] += 1
            elif text.strip():
                own.update(context)
                rows.append((context, block, any(a <= at < z for a, z in spans), first <= at < last))
        seen.update(own)
    names = sorted(f for f, n in seen.items() if n >= LEAST_PAGES)
    index = {f: i for i, f in enumerate(names)}
    x = np.zeros((len(rows), len(names) + len(Block.NAMES) + 1))
    x[:, -1] = 1
    for i, (context, block, *_) in enumerate(rows):
        for f, v in context.items():
            if f in index:
                x[i, index[f]] = v
        x[i, len(names) : -1] = block.values()
    n = np.sqrt([max(1, r[1].words) for r in rows])
    text, place = (_fit(x, np.array([r[k] for r in rows], float), n / n.mean()) for k in (2, 3))
    every = [*names, *Block.NAMES]
    by_tag = {t: min(-0.05, float(np.log(v[1] / v[0])) / 2 - 0.3) for t, v in tags.items()}
    return {f: (float(a), float(b)) for f, a, b in zip(every, text, place)}, (float(text[-1]), float(place[-1])), by_tag


class Scorer:
    """Scores by the learned weights; contexts are shared between pages."""

    def __init__(self, learned=None):
        self.by_feature, self.bias, self.by_tag = learned or weights()
        self.block = np.array([self.by_feature[f] for f in Block.NAMES]).T.tolist()
        self.root = Context({}, *self.bias)
        self.size = 0

    def enter(self, up: Context, own) -> Context:
        if (found := up.children.get(own)) is not None:
            return found
        new = {f: v for f, v in own if f in self.by_feature and v > up.values.get(f, 0.0)}
        if new:
            gains = [sum(self.by_feature[f][k] * (v - up.values.get(f, 0.0)) for f, v in new.items()) for k in (0, 1)]
            found = Context(up.values | new, up.text + gains[0], up.place + gains[1])
        else:
            found = up
        up.children[own] = found
        self.size += 1
        return found

    def scores(self, context: Context, block: Block) -> tuple[float, float]:
        """Log-odds of a block's text being part of the article, and of its place lying within."""
        values = block.values()
        text, place = (base + sum(w * v for w, v in zip(part, values)) for base, part in zip((context.text, context.place), self.block))
        return text, max(-CLIP, min(CLIP, place))

    def cost(self, tag: str, context: Context) -> float:
        """What a tag scores: negative, the less the surer its place is inside."""
        return self.by_tag.get(tag, -0.3) / (1 + math.exp(min(30.0, context.place)))


def best_region(scores) -> tuple[int, int]:
    """(start, end) of the contiguous region with the greatest positive sum, the first of equals; (0, 0) if there is none."""
    best, at, run, start = 0.0, (0, 0), 0.0, 0
    for i, x in enumerate(scores):
        run += x
        if run <= 0:
            run, start = 0.0, i + 1
        elif run > best:
            best, at = run, (start, i + 1)
    return at


_scorer: list[Scorer] = []


def main_text(page: str | None, learned=None) -> str:
    """The text of a page's article."""
    if not page:
        return ""
    if not _scorer or _scorer[0].size > 200_000:
        _scorer[:] = [Scorer(learned)]
    s = _scorer[0]
    tokens = list(scan(page, s.enter, s.root))
    sums, kept = [], []
    for tag, text, context, _, block in tokens:
        if tag is not None:
            sums.append(s.cost(tag, context))
            kept.append(False)
            continue
        own, place = s.scores(context, block)
        n = len(text.split())
        sums.append(place * math.log1p(n))
        kept.append(own > 0)
    start, end = best_region(sums)
    blocks, open_block = [], []
    for (tag, text, *_), keep in zip(tokens[start:end], kept[start:end]):
        if tag is not None:
            blocks.append("".join(open_block))
            open_block = []
        elif keep:
            open_block.append(html_lib.unescape(text) if "&" in text else text)
    blocks.append("".join(open_block))
    return " ".join(x for x in (" ".join(b.split()) for b in blocks) if x)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: id_col, url_col, text, n_chars (code points)."""
    batched(pages.sparkSession)
    learned = pages.sparkSession.sparkContext.broadcast(weights())
    src = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))

    def run(batches):
        for b in batches:
            texts = [main_text(x, learned.value) for x in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["id", "url", "text", "n_chars"])

    out = src.mapInArrow(run, "id long, url string, text string, n_chars long")
    return out.withColumnsRenamed({"id": id_col, "url": url_col})
