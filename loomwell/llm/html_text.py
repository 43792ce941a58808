"""Main text of web pages by maximum-scoring subsequence.

A page is a sequence of tags and words. Each has a weight by where it stands (the innermost element and the nearest block
around it): words mostly positive ones, tags negative ones. The weights are log odds learned from labelled
pages: pages whose author marked the content with a single <article> element give the labels; what was not seen there weighs as
its surroundings do, or as the prior says. A linear scan finds the contiguous
region with the greatest sum (Kadane's algorithm); among equal ones the first and shortest.

Some elements inside that region are no article text and are left out: scripts, forms, menus and the like by their name, and others by the
words of their class, id or role. Such a word weighs for or against content by a prior (an advert, a comment; a post, an entry), or else by
learned log odds between -1 and 1; an element is left out if the sum is below -1. <article>, <main> and <body> never
are, and of an article's own <header> the headings stay. Block elements part the text.

Learning uses about ``sample`` pages, those with the smallest hash of page_id, which are counted where they are stored; without
any labelled page the prior weights below hold. Nothing of a page is cut off when it is read.

Tags follow HTML's rules: unquoted attribute values may hold quotes and slashes, and a slash at the end closes no element but an
svg or math one. Edge cases: null or empty html gives the empty text; a page whose best region has no words gives the empty text;
unclosed and stray tags are tolerated; <br> counts as white space; repeated rows are kept; extra columns are ignored, whatever their
names; a null page_id is passed through like all others, unchanged. Very long pages are read whole, in time that grows with their
length however ill-formed they are.
"""

from __future__ import annotations

import html as html_lib
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwell.llm.scratch import small_batches

_NAME, _VALUE = r"[^\s/>=][^\s/>=]*+", r"\"[^\"]*\"|'[^']*'|[^\s>]*+"
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>|</(?:[^a-zA-Z>][^>]*)?>|"
    rf"<(/?)([a-zA-Z][^\s/>]*+)((?:[\s/=]|{_NAME}(?:\s*+=\s*+(?:{_VALUE}))?+)*+)(?:>|\Z)",
    re.DOTALL,
)
ATTR = re.compile(rf"({_NAME})(?:\s*+=\s*+({_VALUE}))?+")
WORD = re.compile(r"\S+")
#: Elements whose content is raw text, never words of the page.
RAW = {"script", "style", "noscript", "template", "textarea", "title", "svg", "math", "iframe", "object", "canvas", "select"}
#: Of these, those that hold nothing but text up to their end tag, or the page's end.
TEXT_ONLY = {"script", "style", "textarea", "title"}
FOREIGN = {"svg", "math"}
#: Elements that hold no article text wherever they stand, but for an article's own header.
NEVER = RAW | {"nav", "header", "footer", "aside", "form", "button", "menu", "dialog", "head", "label", "fieldset"}
VOID = {"br", "img", "hr", "input", "meta", "link", "source", "track", "wbr", "area", "base", "col", "embed", "param"}
BLOCK = {
    "address", "article", "blockquote", "body", "caption", "center", "dd", "details", "div", "dl", "dt", "figcaption", "figure", "h1", "h2", "h3",
    "h4", "h5", "h6", "hr", "html", "li", "main", "ol", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul",
} | NEVER
#: What an open element of the key closes when another of the set begins.
CLOSED_BY = {"p": BLOCK, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "tr": {"tr"}, "option": {"option"}}
#: Parts of class words that speak against and for content.
AGAINST = re.compile(
    r"ads?|advert\w*|sponsor\w*|promo\w*|banner|cookie\w*|consent|notice|popup|modal|newsletter|subscribe|comments?|commentlist|disqus|replies|"
    r"sidebar|side|widget|related|recommend\w*|share|sharing|social|menu|nav\w*|breadcrumbs?|footer|header|masthead|pagination|pager|login|signup|search\w*|hidden",
    re.IGNORECASE,
)
FOR = re.compile(r"articles?|posts?|content|main|entry|story|body|articlebody|text", re.IGNORECASE)
MARK = 3.0
LEFT_OUT = -1.0
KEPT = {"article", "main", "body", "html"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
PRIOR_WORD, PRIOR_TAG, PRIOR_INSIDE = 1.0, -2.0, -0.1  # of words, block tags, and tags of an <article> or <main>


def mark_words(attributes: str) -> tuple[list[str], bool]:
    """The words of an element's class, id, role and itemprop, and whether it is hidden."""
    words, hidden = [], False
    for name, value in ATTR.findall(attributes):
        name, value = name.lower(), value.strip("\"'")
        if name in ("class", "id", "role", "itemprop"):
            words += value.lower().split()
        elif name == "hidden" or (name == "aria-hidden" and value.lower() == "true"):
            hidden = True
        elif name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.IGNORECASE):
            hidden = True
    return words, hidden


def mark_prior(word: str) -> float:
    parts = re.split(r"[-_]+", word)
    return -MARK if any(map(AGAINST.fullmatch, parts)) else MARK if any(map(FOR.fullmatch, parts)) else 0.0


class Weights:
    """Log odds of words and tags by place, and of class words."""

    def __init__(self, words: dict[str, float] | None = None, tags: dict[str, float] | None = None, marks: dict[str, float] | None = None):
        self.words, self.tags, self.marks = words or {}, tags or {}, marks or {}

    def word(self, feature: str) -> float:
        known = self.words.get(feature)
        return known if known is not None else self.words.get(feature.split(">")[0] + ">*", PRIOR_WORD)

    def tag(self, name: str, context: str) -> float:
        known = self.tags.get(f"{context}>{name}")
        prior = PRIOR_INSIDE if context in ("article", "main") else PRIOR_TAG if name.lstrip("/") in BLOCK else PRIOR_TAG / 4
        return known if known is not None else self.tags.get(context + ">*", prior)

    def left_out(self, words: list[str]) -> bool:
        return bool(words) and sum(mark_prior(w) or self.marks.get(w, 0.0) for w in words) < LEFT_OUT


class Page:
    """The page as events: kind, feature, text, skip. Kinds: 0 tag (name, and the context as its text), 1 text; ``skip`` marks
    what is never content."""

    def __init__(self, source: str, weights: Weights):
        self.weights = weights
        self.events: list[tuple[int, str, str, bool]] = []
        self.article: list[tuple[int, int]] = []  # ranges of events inside <article> elements
        self.marked: list[tuple[str, int, int]] = []  # class words and the events that they are around
        self._stack: list[tuple[str, str, bool, list[str], int]] = []  # name, context, skip, class words, first event
        self._open: list[int] = []
        self._count: Counter = Counter()  # of names on the stack
        self._endless: set[str] = set()
        self._parse(source)

    def _gone(self, elements: list[tuple[str, str, bool, list[str], int]]) -> None:
        for name, _, _, words, begin in reversed(elements):
            if name == "article" and self._open:
                self.article.append((self._open.pop(), len(self.events)))
            self.marked += [(w, begin, len(self.events)) for w in words]

    def _close(self, name: str) -> None:
        if not self._count[name]:  # a stray end tag
            return
        while True:  # each element is left once, so all calls together take linear time
            top = self._stack.pop()
            self._count[top[0]] -= 1
            self._gone([top])
            if top[0] == name:
                return

    def _text(self, text: str) -> None:
        if text:
            name, context, skip, *_ = self._stack[-1] if self._stack else ("", "", False)
            self.events.append((1, f"{context}>{name}", text, skip))

    def _parse(self, source: str) -> None:
        at, n = 0, len(source)
        while at < n:
            m = TOKEN.search(source, at)
            if not m:
                self._text(source[at:])
                break
            self._text(source[at : m.start()])
            at = m.end()
            if m[2] is None:
                continue
            name, closing = m[2].lower(), bool(m[1])
            if closing:
                _, context, skip, *_ = self._stack[-1] if self._stack else ("", "", False)
                self.events.append((0, "/" + name, context, skip))
                self._close(name)
                continue
            while self._stack and self._stack[-1][0] in CLOSED_BY and name in CLOSED_BY[self._stack[-1][0]]:
                self._close(self._stack[-1][0])
            over, context, skip, *_ = self._stack[-1] if self._stack else ("", "", False)
            own_header = name == "header" and context in ("article", "main") and not skip
            never = name in NEVER and not own_header
            if name in VOID or (name in FOREIGN and m[3].endswith("/")):
                self.events.append((0, name, context, skip or never))
                continue
            if name in RAW:
                # once a name's end tag was not found, none follows
                end = None if name in self._endless else re.compile(rf"</{re.escape(name)}\s*>", re.IGNORECASE).search(source, at)
                if not end:
                    self._endless.add(name)
                self.events.append((0, name, context, True))
                at = end.end() if end else n if name in TEXT_ONLY else at
                continue
            words, hidden = mark_words(m[3]) if m[3] else ([], False)
            side = never or hidden or (name not in KEPT and not own_header and self.weights.left_out(words))
            if own_header or (over == "header" and name in HEADINGS and context == "article>header"):
                context, skip = ("article>header", True) if own_header else ("article", side)
            elif never:
                context = name
            elif side:
                context = "side"
            elif name in BLOCK and name not in ("p", "li", "ul", "ol") and not skip and context not in ("article", "main"):
                context = name
            skip = skip or side
            self.events.append((0, name, context, skip))
            self._stack.append((name, context, skip, words, len(self.events)))
            self._count[name] += 1
            if name == "article":
                self._open.append(len(self.events))
        self._gone(self._stack)


def count_page(source: str) -> Counter:
    """Numbers of a page with exactly one <article>, by (kind, feature, whether inside): words and tags by place, and words
    around which a class word stands."""
    counts: Counter = Counter()
    page = Page(source, Weights())
    if len(page.article) != 1:
        return counts
    lo, hi = page.article[0]
    size = np.zeros(len(page.events) + 1, np.int64)
    for i, (kind, feature, text, _) in enumerate(page.events):
        inside = lo <= i < hi
        if kind:
            size[i + 1] = len(WORD.findall(text))
            for f in (feature, feature.split(">")[0] + ">*"):
                counts["word", f, inside] += int(size[i + 1])
        elif feature not in ("article", "/article"):
            for f in (f"{text}>{feature}", f"{text}>*"):
                counts["tag", f, inside] += 1
    total = np.cumsum(size)
    for word, a, b in page.marked:
        if not mark_prior(word):
            inner = max(0, int(total[min(b, hi)] - total[max(a, lo)])) if min(b, hi) > max(a, lo) else 0
            counts["mark", word, True] += inner
            counts["mark", word, False] += int(total[b] - total[a]) - inner
    return counts


def learn(counts: dict[tuple[str, str, bool], int]) -> Weights:
    """Weights from the sums of ``count_page``: inside <article> is content, outside is not."""
    totals = {(kind, inside): sum(n for (k, f, i), n in counts.items() if k == kind and i == inside and f.endswith(">*")) for kind in ("word", "tag") for inside in (True, False)}
    if not totals["word", True] or not totals["word", False]:
        return Weights()

    def odds(kind: str, f: str, of: str) -> float:
        part = [(counts.get((kind, f, i), 0) + 0.5) / (totals[of, i] + 1) for i in (True, False)]
        return float(np.log(part[0]) - np.log(part[1]))

    features = {kind: {f for k, f, _ in counts if k == kind} for kind in ("word", "tag", "mark")}
    words = {f: min(max(odds("word", f, "word"), -4.0), 2.0) for f in features["word"]}
    # words of content are worth their log odds; tags cost: those outside most, those of running text little
    tags = {f: min(-0.1, max(odds("tag", f, "tag") - 2.0, -3.0)) for f in features["tag"]}
    marks = {f: min(max(odds("mark", f, "word"), -1.0), 1.0) for f in features["mark"]}
    return Weights(words, tags, marks)


def best_region(scores: list[float]) -> tuple[int, int]:
    """First, shortest contiguous range [lo, hi) with the greatest positive sum; (0, 0) if there is none."""
    best, run, start, lo, hi = 0.0, 0.0, 0, 0, 0
    for i, s in enumerate(scores):
        if run <= 0:
            run, start = 0.0, i
        run += s
        if run > best + 1e-9:
            best, lo, hi = run, start, i + 1
    return lo, hi


def extract(source: str | None, weights: Weights) -> str:
    if not source:
        return ""
    page = Page(source, weights)
    scores = []
    for kind, feature, text, skip in page.events:
        scores.append(0.0 if skip else weights.word(feature) * len(WORD.findall(text)) if kind else weights.tag(feature, text))
    lo, hi = best_region(scores)
    blocks: list[list[str]] = [[]]
    for kind, feature, text, skip in page.events[lo:hi]:
        if kind:
            if not skip:
                blocks[-1].append(text)
        elif feature.lstrip("/") in BLOCK:
            blocks.append([])
        elif feature == "br":
            blocks[-1].append(" ")
    lines = (" ".join(html_lib.unescape("".join(b)).split()) for b in blocks)
    return "\n".join(x for x in lines if x)


def train(pages: DataFrame, sample: int = 2000, least: int = 20) -> Weights:
    """Weights from about ``sample`` pages(page_id, html); class words that are around fewer than ``least`` words are not learned."""
    some = pages.select("page_id", F.col("html").cast("string").alias("html")).filter(F.col("html").contains("<article") & F.col("page_id").isNotNull())
    n = some.count()
    some = some.filter(F.pmod(F.xxhash64("page_id"), F.lit(1_000_000)) < int(1_000_000 * min(1.0, sample / max(1, n))) + 1)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts: Counter = Counter()
        for pdf in batches:
            for h in pdf["html"]:
                counts.update(count_page(h))
        yield pd.DataFrame([(*k, n) for k, n in counts.items()], columns=["kind", "feature", "inside", "n"]).astype({"n": "int64", "inside": bool})

    found = some.select("html").mapInPandas(run, "kind string, feature string, inside boolean, n long").groupBy("kind", "feature", "inside").agg(F.sum("n").alias("n"))
    rows = found.filter((F.col("kind") != "mark") | (F.col("n") >= least)).collect()  # names of elements, and common class words
    return learn({(r["kind"], r["feature"], r["inside"]): r["n"] for r in rows})


def extract_pages(pages: DataFrame, sample: int = 2000) -> DataFrame:
    """page_id, url, text, n_chars of every row of pages(page_id, url, html)."""
    spark = pages.sparkSession
    small_batches(spark, 500)
    shared = spark.sparkContext.broadcast(train(pages, sample))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = shared.value
        for batch in batches:
            text = [extract(h.as_py(), weights) for h in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())], ["page_id", "url", "text", "n_chars"])

    columns = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    return columns.mapInArrow(run, "page_id long, url string, text string, n_chars long")
