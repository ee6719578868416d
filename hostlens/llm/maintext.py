"""Main text of web pages: blocks labelled by a minimum cut."""

from __future__ import annotations

import html as entities
import math
import re
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hostlens.llm.common import arrow_batches, text_or_empty

SAMPLE = 2000  # pages the block classifier is fitted on, about

# What HTML elements and usual class names mean.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template svg math iframe object canvas textarea select button head".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption "
    "figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table "
    "tbody td tfoot th thead tr ul".split()
)
CLOSES_P = BLOCK - {"html", "body", "caption", "td", "th", "tr", "tbody", "thead", "tfoot"}
SAME_CLOSES = frozenset("li dt dd tr td th option".split())
CONTENT_TAGS = frozenset(("article", "main"))
SIDE_TAGS = frozenset("nav footer aside form menu dialog".split())
SIDE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner cookie "
    "cookies consent gdpr popup modal overlay sidebar menu nav navbar navigation breadcrumb breadcrumbs pagination "
    "pager footer topbar comment comments disqus replies reply respond share sharing social related recommended "
    "recommendations trending popular subscribe subscription newsletter signup login search widget toolbar skip "
    "legal copyright disclaimer taboola outbrain".split()
)
HEAD_WORDS = frozenset("header masthead notice alert".split())  # side matter outside an article only
CONTENT_WORDS = frozenset("article content entry post story main".split())
NEGATING = frozenset("with without no not non has have hide show is".split())  # with-sidebar names no sidebar
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_ATTRIBUTES = re.compile(r"""(?:^|[\s"'])(?:class|id|role|aria-label)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)


@dataclass
class TextBlock:
    text: str
    path: tuple[int, ...]  # numbers of the open block elements, outermost first
    tag: str
    linked: int  # characters inside links
    inside: bool  # of an article or main element
    named: bool  # in an element with a content word in its name
    side: bool  # in a side element


@dataclass
class _Open:
    tag: str
    number: int
    inside: bool
    named: bool
    side: bool  # side evidence other than a form's
    form: bool  # in a form, counted from the innermost article or main
    within: bool  # side evidence since the innermost article or main was opened, or in a side tag
    article: bool


def _spared(out: list[TextBlock], marks: list[_Open]) -> list[TextBlock]:
    """Side marks of the blocks without those of wrappers: a form around most of the page's text, and
    a named element around articles that hold more text than all that is free of side evidence, if no
    article stands outside of such elements."""
    size = sum(len(b.text) for b in out)
    forms = 2 * sum(len(b.text) for b, m in zip(out, marks) if m.form) <= size
    for b, m in zip(out, marks):
        b.side = m.side or (forms and m.form)
    clean = sum(len(b.text) for b in out if not b.side)
    lost = [b for b, m in zip(out, marks) if b.side and b.inside and not m.within and not (forms and m.form)]
    if sum(len(b.text) for b in lost) > clean and not any(m.article and not b.side for b, m in zip(out, marks)):
        for b in lost:
            b.side = False
    return out


def _tag_end(page: str, at: int) -> int:
    """Index of the > that ends the tag at `at`, not one inside a quoted value; -1 if there is none."""
    end = page.find(">", at)
    while end >= 0:
        part = page[at:end]
        if not part.count('"') % 2 and (part.count("'") % 2 == 0 or '"' in part):
            return end
        if end - at > 20_000:
            return page.find(">", at)
        end = page.find(">", end + 1)
    return page.find(">", at)


def blocks(page: str) -> list[TextBlock]:
    """Text blocks of a page in order: runs of text between block elements, white space collapsed."""
    out: list[TextBlock] = []
    stack = [_Open("", 0, False, False, False, False, False, False)]
    marks: list[_Open] = []
    text: list[str] = []
    linked = links = count = 0
    low = page.lower() if len(page.lower()) == len(page) else page

    def flush() -> None:
        nonlocal text, linked
        words = " ".join("".join(text).split()) if text else ""
        if words:
            top = stack[-1]
            path = tuple(o.number for o in stack if o.tag in BLOCK)
            tag = next((o.tag for o in reversed(stack) if o.tag in BLOCK), "")
            out.append(TextBlock(words, path, tag, min(linked, len(words)), top.inside, top.named, top.side))
            marks.append(top)
        text, linked = [], 0

    def close(k: int) -> None:
        nonlocal links
        links -= sum(o.tag == "a" for o in stack[k:])
        del stack[k:]

    at, n = 0, len(page)
    while at < n:
        begin = page.find("<", at)
        if begin < 0:
            begin = n
        if begin > at:
            run = entities.unescape(page[at:begin])
            text.append(run)
            if links:
                linked += len(run.strip())
        if begin == n:
            break
        at = begin + 1
        nxt = page[at : at + 1]
        if page.startswith("!--", at):
            end = page.find("-->", at + 3)
            at = n if end < 0 else end + 3
            continue
        if nxt in ("!", "?"):
            end = page.find(">", at)
            at = n if end < 0 else end + 1
            continue
        ending = nxt == "/"
        name_at = at + ending
        end = _tag_end(page, name_at) if page[name_at : name_at + 1].isalpha() else -1
        if end < 0:
            text.append("<")
            continue
        inner = page[name_at:end]
        tag = re.match(r"[A-Za-z][A-Za-z0-9:-]*", inner)[0].lower()
        at = end + 1
        if ending:
            if tag in BLOCK:
                flush()
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    close(k)
                    break
                if tag not in BLOCK and stack[k].tag in BLOCK:
                    break  # an inline end tag closes nothing outside its block
            continue
        if tag == "br":
            text.append("\n")
            continue
        if tag in BLOCK:
            flush()
            if tag in CLOSES_P:
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k].tag == "p":
                        close(k)
                        break
                    if stack[k].tag in BLOCK:
                        break
            if tag in SAME_CLOSES:
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k].tag == tag:
                        close(k)
                        break
                    if stack[k].tag in ("ul", "ol", "dl", "table", "select"):
                        break
        if tag in RAW and not inner.endswith("/"):
            end = low.find(f"</{tag}", at)
            if end < 0 and tag == "head":
                continue
            if end >= 0:
                at = end
                stop = page.find(">", end)
                at = n if stop < 0 else stop + 1
            elif tag in ("script", "style"):
                at = n
            continue
        if tag in VOID or inner.endswith("/"):
            continue
        top = stack[-1]
        names: set[str] = set()
        if "=" in inner:
            for value in _ATTRIBUTES.findall(inner[len(tag):]):
                for token in value.split():
                    words = [w.lower() for w in _WORDS.findall(token)]
                    if words and words[0] not in NEGATING:
                        names.update(words)
        opens = tag in CONTENT_TAGS
        inside = top.inside or opens
        side_tag = tag in SIDE_TAGS and tag != "form"
        own = side_tag or (tag not in ("html", "body") and bool(names & SIDE_WORDS)) or (
            not top.inside and (tag == "header" or (tag not in ("html", "body", "article", "main") and bool(names & HEAD_WORDS)))
        )
        in_side_tag = any(o.tag in SIDE_TAGS and o.tag != "form" for o in stack) if opens else False
        within = own or (in_side_tag if opens else top.within)
        form = not opens and (top.form or tag == "form")
        count += 1
        stack.append(_Open(
            tag, count, inside, top.named or bool(names & CONTENT_WORDS), top.side or own, form, within,
            top.article or tag == "article",
        ))
        links += tag == "a"
    flush()
    return _spared(out, marks)


def features(b: TextBlock) -> list[float]:
    """What the text of a block looks like, apart from where it stands."""
    words = b.text.count(" ") + 1
    marks = sum(map(b.text.count, ".,;:!?"))
    return [
        1.0, math.log1p(words), b.linked / len(b.text), min(marks / words, 1.0), float(b.text[-1] in ".!?…\"”"),
        float(b.tag == "p"), float(b.tag[:1] == "h" and b.tag[1:].isdigit()), float(b.tag in ("li", "td", "th")),
        float("©" in b.text or "All rights reserved" in b.text),
    ]


# What the fit starts from, and keeps where no sampled page shows both classes.
START = [-1.0, 0.6, -4.0, 0.5, 0.8, 1.0, 0.3, -0.8, -3.0]
INSIDE, NAMED, SIDE, OUTSIDE = 4.0, 1.5, -12.0, -4.0  # evidence of place, in log odds


def log_odds(found: list[TextBlock], weights: list[float]) -> list[float]:
    """Of each block being content: its looks by the classifier, and its place."""
    any_inside = any(b.inside and not b.side for b in found)
    out = []
    for b in found:
        z = max(-3.0, min(3.0, sum(w * x for w, x in zip(weights, features(b)))))
        z += SIDE if b.side else 0.0
        z += INSIDE if b.inside else OUTSIDE if any_inside else NAMED * b.named
        out.append(z)
    return out


@dataclass
class FlowNetwork:
    """Residual capacities between nodes; Dinic's algorithm."""

    n: int
    edges: list[list[int]] = field(init=False)
    to: list[int] = field(default_factory=list)
    left: list[float] = field(default_factory=list)

    def __post_init__(self):
        self.edges = [[] for _ in range(self.n)]

    def add(self, a: int, b: int, forth: float, back: float) -> None:
        self.edges[a].append(len(self.to))
        self.edges[b].append(len(self.to) + 1)
        self.to += [b, a]
        self.left += [forth, back]

    def levels(self, source: int) -> list[int]:
        level = [-1] * self.n
        level[source] = 0
        queue = deque([source])
        while queue:
            u = queue.popleft()
            for e in self.edges[u]:
                if self.left[e] > 1e-9 and level[self.to[e]] < 0:
                    level[self.to[e]] = level[u] + 1
                    queue.append(self.to[e])
        return level

    def source_side(self, source: int, sink: int) -> list[bool]:
        """Saturate all paths; nodes the source still reaches are on its side of a minimum cut."""
        while (level := self.levels(source))[sink] >= 0:
            nxt = [0] * self.n
            path: list[int] = []
            u = source
            while True:
                if u == sink:
                    flow = min(self.left[e] for e in path)
                    for e in path:
                        self.left[e] -= flow
                        self.left[e ^ 1] += flow
                    cut = next(k for k, e in enumerate(path) if self.left[e] <= 1e-9)
                    u = self.to[path[cut] ^ 1]
                    del path[cut:]
                    continue
                while nxt[u] < len(self.edges[u]):
                    e = self.edges[u][nxt[u]]
                    if self.left[e] > 1e-9 and level[self.to[e]] == level[u] + 1:
                        break
                    nxt[u] += 1
                if nxt[u] < len(self.edges[u]):
                    path.append(e)
                    u = self.to[e]
                elif path:
                    u = self.to[path.pop() ^ 1]
                    nxt[u] += 1
                else:
                    break
        return [x >= 0 for x in level]


ADJACENT, SIBLING = 3.0, 2.0


def closeness(a: TextBlock, b: TextBlock) -> float:
    """Smoothness between neighbours: less with every element that only one of them is in, and next to
    none across the border of a side element or an article."""
    shared = 0
    for x, y in zip(a.path, b.path):
        if x != y:
            break
        shared += 1
    apart = len(a.path) + len(b.path) - 2 * shared
    same_place = a.side == b.side and a.inside == b.inside
    return ADJACENT / (1 + 0.5 * max(apart - 2, 0)) * (1.0 if same_place else 0.1)


def labels(found: list[TextBlock], weights: list[float]) -> list[bool]:
    """Content or not, for each block: the labelling of least cost, by a minimum cut."""
    odds = log_odds(found, weights)
    n = len(found)
    net = FlowNetwork(n + 2)
    last: dict[tuple[int, ...], int] = {}
    for i, (b, z) in enumerate(zip(found, odds)):
        if z > 0:
            net.add(n, i, z, 0.0)
        elif z < 0:
            net.add(i, n + 1, -z, 0.0)
        if i:
            net.add(i - 1, i, w := closeness(found[i - 1], b), w)
        parent = b.path[:-1]
        if parent in last and last[parent] < i - 1:
            net.add(last[parent], i, SIBLING, SIBLING)
        last[parent] = i
    return net.source_side(n, n + 1)[:n]


def main_text(page: str, weights: list[float]) -> str:
    found = blocks(page)
    if not found:
        return ""
    return "\n".join(b.text for b, keep in zip(found, labels(found, weights)) if keep)


def fit(pages: DataFrame, html: str = "html", sample: int = SAMPLE, steps: int = 400) -> list[float]:
    """Weights of the block classifier from about `sample` pages (those with the smallest hashes).

    Blocks within an article or main element and no side element are content, blocks in side elements
    are not; only the looks of a block are learnt, its place is added by `log_odds`. Without both
    classes the starting weights stay.
    """
    arrow_batches(pages.sparkSession)
    rows = pages.select(text_or_empty(html).alias("html"))
    share = min(1.0, sample / max(rows.count(), 1))
    some = rows.where(F.abs(F.xxhash64("html")) <= F.lit(share * 2.0**63))

    @F.pandas_udf("array<array<double>>")
    def examples(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [
            [float(not b.side), *features(b)] for b in blocks(t) if b.side or b.inside
        ])

    got = [x for r in some.select(examples("html").alias("x")).toLocalIterator() for x in r["x"]]
    data = np.array(sorted(got)) if got else np.zeros((0, len(START) + 1))
    y, x = data[:, 0], data[:, 1:]
    if not 0 < y.sum() < len(y):
        return START
    w, start = np.array(START), np.array(START)
    weight = np.where(y > 0, 0.5 / max(y.sum(), 1), 0.5 / max(len(y) - y.sum(), 1))
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w -= 0.5 * (x.T @ (weight * (p - y)) + 0.01 * (w - start))
    return w.tolist()


def extract(pages: DataFrame, weights: list[float], page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) per row. NULL and empty html, and pages without content, give an
    empty text; pages are read whole."""
    arrow_batches(pages.sparkSession)
    rows = pages.select(F.col(f"`{page_id}`").alias("page_id"), F.col(f"`{url}`").alias("url"), text_or_empty(html).alias("html"))
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            text = [main_text(t.as_py(), weights) for t in part.column("html")]
            yield pa.RecordBatch.from_arrays(
                [part.column("page_id"), part.column("url"), pa.array(text, pa.string()), pa.array(list(map(len, text)), pa.int64())],
                ["page_id", "url", "text", "n_chars"],
            )

    return rows.mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")
