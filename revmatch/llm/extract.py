"""Main text of web pages by a minimum cut.

A page is read into text blocks in page order. A classifier gives each block the log odds of being content, from what
its enclosing elements say of themselves and from the text; the odds are the block's capacity to the content or to
the boilerplate terminal. Neighbours in the page, and neighbours under the same element, are joined by smoothness edges;
the minimum cut between the terminals (maximum flow) labels all blocks of the page jointly.

The weights of the text features are trained: blocks of a bounded sample of pages that lie in elements of plain meaning
(article, main against nav, footer and the like) are the examples. What the words of a class say is weaker than a tag, and an article
inside a layout that is named after its sidebar or comments takes that back. Pages are worked on where they lie; nothing is shuffled.

Cases: null and empty html gives empty text; broken markup (unclosed tags, quotes, comments) is read as far as it goes;
text outside all elements counts; a page without content blocks has empty text; equal pages give equal rows; an empty table an
empty result; other columns are ignored.
"""

from __future__ import annotations

import html
import re
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Names of the HTML standard and usual names of page parts.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style noscript template iframe object svg select option textarea button canvas audio video head title annotation annotation-xml".split())
INLINE = set("""a abbr acronym b bdi bdo big br cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img input
math mi mn mo ms mtext mspace mrow mfrac msqrt mroot mstyle merror mpadded mphantom msub msup msubsup munder mover munderover mmultiscripts mtable mtr mtd semantics""".split())
OUTSIDE_TAGS = set("nav header footer aside form menu dialog".split())
INSIDE_TAGS = set("article main".split())
OUTSIDE_WORDS = set("""
nav navbar navigation menu menus header masthead footer foot sidebar side aside notice notices cookie cookies consent gdpr banner alert
ad ads adv advert adverts advertisement advertising promo promotion promoted sponsor sponsored comment comments commentlist reply replies
respond discussion disqus share sharing social related recommended recommendations more breadcrumb breadcrumbs pagination pager widget
widgets popup modal overlay subscribe subscription newsletter signup login register search form toolbar topbar copyright legal tags
""".split())
INSIDE_WORDS = set("article content post entry story main body text prose".split())

ADJACENT, SIBLING = 1.0, 0.6
#: Outside by its tag, outside by the words of its class, silent, inside. Words are less than the text and the neighbours can say together.
TAG, WORDS, HEADING = -2, -1, -3
HINT = {TAG: -7.0, WORDS: -4.5, 0: 0.0, 1: 7.0}
SAMPLE = 400
#: Weights of the text features where no example is found.
PLAIN = np.array([-0.5, 0.5, -2.0, 0.3, 0.3])
_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_QUOTED = re.compile(r"""[^"'>]*(?:(?:"[^"]*"|'[^']*')[^"'>]*)*>""")
_HINTS = re.compile(r"""(?:^|\s)(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
#: Class names that say what a page around has, not what the element is.
_LAYOUT = re.compile(r"(?:has|with|no|without|hide|show)[-_]", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


def _hint(tag: str, attributes: str) -> int:
    """``TAG`` or ``WORDS`` outside the article, 1 inside, 0 silent; ``HEADING`` for a class that says header and no more."""
    if tag in OUTSIDE_TAGS:
        return TAG
    says: set[int] = set()
    for m in _HINTS.finditer(attributes) if "=" in attributes else ():
        for name in (m[1] or m[2] or m[3] or "").split():
            words = {w.lower() for w in _WORD.findall(name)} if not _LAYOUT.match(name) else set()
            outside = words & OUTSIDE_WORDS
            if outside:
                says.add(HEADING if outside == {"header"} else WORDS)
            elif words & INSIDE_WORDS:
                says.add(1)
    if tag in ("body", "html"):
        return int(1 in says)
    if WORDS in says:
        return WORDS if 1 not in says else int(tag in INSIDE_TAGS)
    if HEADING in says:
        return HEADING
    return int(tag in INSIDE_TAGS or 1 in says)


_TEXT, _OPEN, _CLOSE, _EMPTY, _RAW = range(5)
_TAGS: dict[str, tuple] = {}
_UNSEEN = (None, "", 0, False)


def _tag(raw: str) -> tuple:
    """``(kind, name, hint, breaks a block)`` of a tag as written; kept for short tags, which repeat."""
    name = _NAME.match(raw, 2 if raw.startswith("</") else 1)
    if not name:
        return _TEXT, "", 0, False
    tag = name[0].lower()
    breaks = tag not in INLINE
    if raw.startswith("</"):
        found = _CLOSE, tag, 0, breaks
    elif raw.endswith("/>") or tag in VOID:
        found = _EMPTY, tag, 0, breaks
    elif tag in RAW and tag != "head":
        found = _RAW, tag, 0, breaks and tag != "button"
    else:
        found = _OPEN, tag, _hint(tag, raw[name.end():-1]), breaks
    if len(raw) < 48 and len(_TAGS) < 20_000:
        _TAGS[raw] = found
    return found


def read_blocks(page: str) -> list[tuple[str, int, int, int]]:
    """``(text, characters in links, hint, parent)`` of every block in page order; texts are decoded and trimmed."""
    blocks: list[tuple[str, int, int, int]] = []
    parts: list[str] = []
    stack: list[tuple[str, int, int, int]] = [("", 0, 0, 0)]  # tag, hint, number, number of the block element around
    opened: dict[str, int] = {}
    endless: set[str] = set()
    links = made = at = linked = hint = 0
    inside = False  # whether an article has begun
    quotes, size, find = True, len(page), page.find

    def close() -> None:
        nonlocal linked
        text = "".join(parts)
        if "&" in text:
            text = html.unescape(text)
        text = " ".join(text.split())
        if text:
            blocks.append((text, min(linked, len(text)), hint, stack[-1][3]))
        parts.clear()
        linked = 0

    while at < size:
        lt = find("<", at)
        if lt != at:
            piece = page[at:lt] if lt > 0 else page[at:]
            if not parts:
                hint = stack[-1][1]
            parts.append(piece)
            if links:
                linked += len(piece)
            if lt < 0:
                break
        gt = find(">", lt) + 1 or size
        raw = page[lt:gt]
        kind, tag, own, breaks = _TAGS.get(raw, _UNSEEN)
        if kind is None:
            if raw.startswith("<!--"):
                at = find("-->", lt + 4) + 3
                at = size if at < 3 else at
                continue
            if raw.startswith(("<!", "<?")):
                at = gt
                continue
            if quotes and (raw.count('"') & 1 or raw.count("'") & 1):
                whole = _QUOTED.match(page, lt + 1)
                quotes = whole is not None  # a quote that never ends: from here on the next > ends a tag
                raw = page[lt:gt] if whole is None else page[lt:whole.end()]
            kind, tag, own, breaks = _tag(raw)
        at = lt + len(raw)
        if kind == _TEXT:
            if not parts:
                hint = stack[-1][1]
            parts.append("<")
            at = lt + 1
            continue
        if breaks and parts:
            close()
        if kind == _OPEN:
            if tag == "a":
                links += 1
            made += 1
            before = stack[-1][1]
            if own == HEADING:
                own = 0 if before > 0 else WORDS
            if tag == "header" and before > 0:
                own = 0  # an article's own heading
            if before == WORDS and own > 0 and not inside:  # the words were those of a layout around the article
                if tag in INSIDE_TAGS:
                    stack = [(t, 0 if h == WORDS else h, n, e) for t, h, n, e in stack]
                    now = own
                else:
                    now = 0
            else:
                now = min(before, own) if before < 0 or own < 0 else max(before, own)
            inside = inside or now > 0
            stack.append((tag, now, made, made if breaks else stack[-1][3]))
            opened[tag] = opened.get(tag, 0) + 1
        elif kind == _CLOSE:
            if tag == "a" and links:
                links -= 1
            if opened.get(tag):
                while True:
                    last = stack.pop()[0]
                    opened[last] -= 1
                    if last == tag:
                        break
        elif kind == _RAW:
            end = None if tag in endless else re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
            if end is None:
                endless.add(tag)
            at = end.end() if end else (size if tag in ("script", "style", "textarea", "title") else at)
        elif tag == "br" and parts:
            parts.append(" ")
    if parts:
        close()
    return blocks


def text_features(text: str, linked: int) -> tuple[float, ...]:
    n = len(text)
    words = text.count(" ") + 1
    marks = text.count(".") + text.count(",") + text.count("!") + text.count("?")
    return 1.0, min(float(np.log1p(words)), 5.0), linked / n, min(marks / words, 1.0), float(text[-1] in ".!?…\"'”»")


def train(pages: DataFrame, sample: int = SAMPLE) -> np.ndarray:
    """Logistic weights of the text features, from blocks with plain hints of at most ``sample`` pages."""
    few = pages.select(F.col("html").cast("string").alias("html"), F.xxhash64("html").alias("h")).filter("html is not null")
    few = few.orderBy("h").limit(sample).select("html")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(*text_features(t, linked), hint) for page in b.column(0).to_pylist() for t, linked, hint, _ in read_blocks(page) if hint]
            if rows:
                sums: dict[tuple, int] = {}
                for r in rows:
                    key = tuple(round(v, 2) for v in r)
                    sums[key] = sums.get(key, 0) + 1
                yield pa.record_batch([*(pa.array(c, pa.float64()) for c in zip(*sums)), pa.array(list(sums.values()), pa.float64())],
                                      names=["f0", "f1", "f2", "f3", "f4", "hint", "n"])

    schema = ", ".join(f"{c} double" for c in ("f0", "f1", "f2", "f3", "f4", "hint", "n"))
    got = few.mapInArrow(run, schema).groupBy("f0", "f1", "f2", "f3", "f4", "hint").agg(F.sum("n").alias("n")).orderBy("f0", "f1", "f2", "f3", "f4", "hint").toPandas()
    x, y, n = got[["f0", "f1", "f2", "f3", "f4"]].to_numpy(), (got["hint"] > 0).to_numpy(float), got["n"].to_numpy()
    if len(set(y)) < 2:
        return PLAIN
    for c in (0, 1):  # both kinds weigh alike
        n[y == c] /= n[y == c].sum()
    w = np.zeros(5)
    for _ in range(25):
        p = 1 / (1 + np.exp(-x @ w))
        w += np.linalg.solve((x * (n * p * (1 - p))[:, None]).T @ x + 0.02 * np.eye(5), x.T @ (n * (y - p)) - 0.02 * w)
    return w


def min_cut(odds: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Label of each node by a minimum cut (Dinic): positive odds are capacity from the source, negative to the sink."""
    n = len(odds)
    if all(v > 0 for v in odds) or all(v <= 0 for v in odds):
        return [v > 0 for v in odds]
    excess, room = [max(v, 0.0) for v in odds], [max(-v, 0.0) for v in odds]
    to: list[int] = []
    cap: list[float] = []
    out: list[list[int]] = [[] for _ in range(n)]
    for i, j, c in edges:
        for a, b in ((i, j), (j, i)):
            out[a].append(len(to))
            to.append(b)
            cap.append(c)
    tiny = 1e-12
    while True:
        level = [-1] * n
        queue = deque(i for i in range(n) if excess[i] > tiny)
        for i in queue:
            level[i] = 0
        reached = False
        while queue:
            i = queue.popleft()
            if room[i] > tiny:
                reached = True
            for e in out[i]:
                if cap[e] > tiny and level[to[e]] < 0:
                    level[to[e]] = level[i] + 1
                    queue.append(to[e])
        if not reached:
            return [v >= 0 for v in level]
        place = [0] * n
        for start in range(n):
            while excess[start] > tiny and level[start] == 0:
                path, i = [], start
                while True:
                    if room[i] > tiny:
                        flow = min([excess[start], room[i], *(cap[e] for e in path)])
                        excess[start] -= flow
                        room[i] -= flow
                        for e in path:
                            cap[e] -= flow
                            cap[e ^ 1] += flow
                        break
                    while place[i] < len(out[i]):
                        e = out[i][place[i]]
                        if cap[e] > tiny and level[to[e]] == level[i] + 1:
                            break
                        place[i] += 1
                    if place[i] < len(out[i]):
                        path.append(out[i][place[i]])
                        i = to[path[-1]]
                    elif path:
                        e = path.pop()
                        i = to[e ^ 1]
                        place[i] += 1
                    else:
                        level[start] = -2
                        break


def main_text(page: str | None, weights: np.ndarray) -> str:
    blocks = read_blocks(page or "")
    if not blocks:
        return ""
    w = weights.tolist()
    odds = []
    for text, linked, hint, _ in blocks:
        f = text_features(text, linked)
        by_text = w[0] + w[1] * f[1] + w[2] * f[2] + w[3] * f[3] + w[4] * f[4]
        odds.append(HINT[hint] + max(-3.0, min(3.0, by_text)))
    edges = [(k, k + 1, ADJACENT) for k in range(len(blocks) - 1)]
    last: dict[int, int] = {}
    for k, b in enumerate(blocks):
        if b[3] in last:
            edges.append((last[b[3]], k, SIBLING))
        last[b[3]] = k
    return "\n".join(b[0] for b, content in zip(blocks, min_cut(odds, edges)) if content)


def extract(pages: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """``page_id``, ``url``, ``text`` and ``n_chars`` of every page."""
    weights = train(pages, sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [main_text(p, weights) for p in b.column(2).to_pylist()]
            yield pa.record_batch([b.column(0), b.column(1), pa.array(found, pa.string()), pa.array(list(map(len, found)), pa.int64())],
                                  names=["page_id", "url", "text", "n_chars"])

    few = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return few.mapInArrow(run, "page_id long, url string, text string, n_chars long")
