"""Main text of web pages from flat text blocks and a decision tree.

A page becomes a flat list of text blocks: runs of text between block-level
tags.  A block is described by its word count and link density, those of the
blocks before and after it, and what its open tags and their class, id and
role words say (inside an article, inside a menu, advert, comments ...).  A
small decision tree, trained on the labelled table below, keeps or drops
each block.

Names are read with care.  Those on html, body, article and main say how the
page is laid out, not what it holds.  A name that begins with a state (has-sidebar, with-header)
says nothing.  An element named like a frame that holds an article, a main part
or the title and more than half of the page's words is a wrapper.  A
header inside an article is the article's own.

White space inside a block becomes one space; kept blocks are
joined in page order by a newline.

Markup, comments, scripts, styles, the head and form controls are never
text.  Null or empty html gives an empty text.  Unclosed and stray tags are
read as browsers do it: block tags end an open paragraph, an end tag closes
up to its nearest open partner, the end of the page closes everything.
"""

from __future__ import annotations

import html
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ticklake.llm.common import bounded_batches, process_cache

TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<![^>]*>|<\?[^>]*>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>"']|"[^"]*"|'[^']*')*)>""", re.S)
ATTRIBUTE = re.compile(r"""([a-zA-Z-]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
#: Elements whose content is never page text; the text up to their end tag is passed over.
RAW = {"script", "style", "noscript", "template", "svg", "textarea", "title", "iframe", "object", "math", "canvas"}
SKIP = {"head", "form", "select", "button", "option", "label", "input", "fieldset", "dialog"}
INLINE = {"a", "abbr", "b", "bdi", "bdo", "big", "br", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "mark",
          "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "meta",
          "link", "input"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
FRAME_TAGS = {"nav", "footer", "aside", "menu", "header"}
#: Words in class, id or role that mark what is not the article.
FRAME_WORDS = {"ad", "ads", "advert", "adverts", "advertisement", "banner", "sponsor", "sponsored", "promo", "nav", "navbar", "navigation",
               "menu", "breadcrumb", "breadcrumbs", "footer", "header", "masthead", "sidebar", "cookie", "cookies", "consent", "notice",
               "popup", "modal", "newsletter", "subscribe", "related", "share", "sharing", "social", "widget", "login", "contentinfo",
               "complementary", "search", "toolbar", "pagination", "pager", "skip", "legal", "copyright", "alert"}
TALK_WORDS = {"comment", "comments", "disqus", "reply", "replies", "respond", "discussion"}
BODY_TAGS = {"article", "main"}
BODY_WORDS = {"article", "content", "main", "post", "entry", "story", "body", "text"}
#: First parts of names that state a layout.
STATE_WORDS = {"has", "have", "with", "without", "no", "not", "is", "show", "hide", "hidden", "supports", "using"}
#: Elements whose names describe the page; what they hold is no frame for it.
LAYOUT_TAGS = {"html", "body", "article", "main"}
#: Elements that only the main text's surroundings hold.
CORE_TAGS = {"article", "main", "h1"}

FEATURES = ("words", "links", "before_words", "before_links", "after_words", "after_links", "in_body", "in_frame", "in_talk")
#: The labelled table, read off pages by hand.  Where a block's place decides, it does so in any
#: surroundings: (in_body, in_frame, in_talk, keep).  Elsewhere its own text and its neighbours decide.
PLACES = [(1, 0, 0, 1), (0, 1, 0, 0), (1, 1, 0, 0), (0, 0, 1, 0), (1, 0, 1, 0), (0, 1, 1, 0)]
SURROUNDINGS = [
    # words, links, before_words, before_links, after_words, after_links
    (1, 0.0, 0, 0.0, 1, 1.0), (1, 1.0, 1, 1.0, 1, 1.0), (2, 0.5, 1, 1.0, 9, 0.0), (3, 0.0, 60, 0.0, 20, 0.0), (5, 1.0, 40, 0.0, 40, 0.0),
    (8, 0.0, 9, 0.0, 8, 0.0), (12, 0.2, 80, 0.0, 0, 0.0), (15, 0.0, 70, 0.0, 20, 0.0), (20, 0.4, 5, 0.0, 60, 0.0), (30, 0.0, 90, 0.0, 5, 0.0),
    (45, 0.0, 8, 0.0, 80, 0.0), (60, 0.1, 30, 0.0, 15, 0.0), (120, 0.0, 45, 0.0, 25, 0.0), (300, 0.1, 120, 0.0, 7, 0.0),
]
LOOSE = [
    (70, 0.0, 8, 0.0, 90, 0.0, 1), (55, 0.05, 70, 0.0, 40, 0.0, 1), (25, 0.0, 60, 0.0, 70, 0.0, 1), (8, 0.0, 4, 1.0, 70, 0.0, 1),
    (14, 0.1, 40, 0.0, 55, 0.0, 1), (18, 0.0, 50, 0.0, 3, 1.0, 1), (90, 0.0, 0, 0.0, 0, 0.0, 1), (40, 0.1, 2, 1.0, 30, 0.0, 1),
    (2, 1.0, 2, 1.0, 2, 1.0, 0), (12, 0.9, 3, 1.0, 4, 1.0, 0), (4, 0.0, 2, 1.0, 3, 1.0, 0), (6, 0.0, 3, 0.0, 2, 1.0, 0),
    (9, 0.6, 30, 0.0, 3, 1.0, 0), (3, 0.0, 60, 0.0, 1, 1.0, 0), (40, 0.8, 5, 1.0, 6, 1.0, 0), (1, 1.0, 1, 1.0, 60, 0.0, 0),
]
LABELLED = [(*around, *place) for place in PLACES for around in SURROUNDINGS + [r[:6] for r in LOOSE]] + [(*r[:6], 0, 0, 0, r[6]) for r in LOOSE]


def grow(rows: np.ndarray, keep: np.ndarray, depth: int = 6):
    """A decision tree by Gini impurity: (feature, threshold, low branch, high branch), or the share kept at a leaf."""
    p = keep.mean()
    if depth == 0 or p in (0.0, 1.0):
        return float(p)
    best = None
    for f in range(rows.shape[1]):
        values = np.unique(rows[:, f])
        for t in (values[1:] + values[:-1]) / 2:
            low = rows[:, f] <= t
            cost = sum(s.sum() * (m := keep[s].mean()) * (1 - m) for s in (low, ~low))
            if best is None or cost < best[0] - 1e-12:
                best = (cost, f, float(t), low)
    if best is None:
        return float(p)
    _, f, t, low = best
    return f, t, grow(rows[low], keep[low], depth - 1), grow(rows[~low], keep[~low], depth - 1)


def tree():
    def build():
        table = np.array(LABELLED, np.float64)
        return grow(table[:, :-1], table[:, -1])

    return process_cache("block-tree", build)


def decide(node, row) -> bool:
    while not isinstance(node, float):
        f, t, low, high = node
        node = low if row[f] <= t else high
    return node >= 0.5


def blocks(page: str) -> list[tuple[str, float, int, int, int]]:
    """``(text, link density, in body, in frame, in talk)`` of the page's text blocks, in order.

    The open tags are kept as a stack of (tag, body, frame, talk, skip)
    totals, so a block reads its place off the top, and the numbers of the
    open elements that are frames by name only.  Which of those are wrappers
    is known at the end of the page.
    """
    out: list[tuple] = []
    stack: list[tuple] = [("", 0, 0, 0, 0, ())]
    named = 0  # frames by name seen so far
    core: set[int] = set()  # those that hold an article, a main part or the title
    text: list[str] = []
    links = 0  # words inside links
    anchors = 0
    place = stack[0]

    def flush():
        nonlocal links
        if text:
            joined = " ".join(html.unescape("".join(text)).split())
            if joined and not place[4]:
                words = joined.count(" ") + 1
                out.append((joined, min(1.0, links / words), *(1 if v else 0 for v in place[1:4]), place[5], words))
            text.clear()
        links = 0

    at, end = 0, len(page)
    while at < end:
        m = TAG.search(page, at)
        piece = page[at:m.start()] if m else page[at:]
        if piece:
            if not text:
                place = stack[-1]
            text.append(piece)
            if anchors:
                links += len(piece.split())
        if m is None:
            break
        at = m.end()
        name = m[2]
        if name is None:
            continue
        name = name.lower()
        if name in INLINE:
            if name == "a":
                anchors = 0 if m[1] else 1
            elif name == "br":
                text.append(" ")
            continue
        flush()
        anchors = 0
        if m[1]:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] == name:
                    del stack[i:]
                    break
            continue
        if name in RAW:
            close = re.compile(rf"</{name}\s*>", re.I).search(page, at)
            at = close.end() if close else end
            continue
        if name in VOID:
            continue
        if stack[-1][0] == "p" or (name == "li" and stack[-1][0] == "li"):
            stack.pop()
        if name == "body":
            stack = [s for s in stack if s[0] != "head"]
            _recount(stack)
        _, body, frame, talk, skip, wraps = stack[-1]
        inside = any(t[0] in BODY_TAGS for t in stack)
        in_body, in_frame, in_talk = _named(m[3]) if "=" in m[3] else (False, False, False)
        if name in CORE_TAGS:
            core.update(wraps)
        if in_frame and name not in LAYOUT_TAGS:
            named += 1
            wraps = (*wraps, named)
        body += name in BODY_TAGS or (in_body and name not in ("html", "body"))
        frame += name in FRAME_TAGS and not (name == "header" and inside)
        talk += in_talk and name not in LAYOUT_TAGS
        skip += name in SKIP
        stack.append((name, body, frame, talk, skip, wraps))
    flush()
    held: dict[int, int] = {}
    for b in out:
        for w in b[5]:
            held[w] = held.get(w, 0) + b[6]
    half = sum(b[6] for b in out) / 2
    wrappers = {w for w in core if held.get(w, 0) > half}
    return [(text, share, body, int(frame or any(w not in wrappers for w in wraps)), talk) for text, share, body, frame, talk, wraps, _ in out]


def _named(attributes: str) -> tuple[bool, bool, bool]:
    """Whether class, id and role name (main text, frame, reader comments)."""
    words: set[str] = set()
    for attr in ATTRIBUTE.finditer(attributes):
        if attr[1].lower() in ("class", "id", "role"):
            for name in (attr[2] or attr[3] or attr[4] or "").lower().split():
                parts = [w for w in re.split(r"[^a-z]+", name) if w]
                if parts and parts[0] not in STATE_WORDS:
                    words.update(parts)
    return bool(words & BODY_WORDS), bool(words & FRAME_WORDS), bool(words & TALK_WORDS)


def _recount(stack: list) -> None:
    """After the head is closed nothing open skips text."""
    stack[:] = [(n, b, f, t, 0, w) for n, b, f, t, _, w in stack]


def main_text(page: str) -> str:
    found = blocks(page)
    node = tree()
    size = [(b[0].count(" ") + 1, b[1]) for b in found]
    around = [(0, 0.0), *size, (0, 0.0)]
    kept = []
    for i, b in enumerate(found):
        row = (*size[i], *around[i], *around[i + 2], b[2], b[3], b[4])
        if decide(node, row):
            kept.append(b[0])
    return "\n".join(kept)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``page_id, url, text, n_chars`` of every row; other columns are ignored, repeated rows each give a row."""

    def run(batches):
        for b in batches:
            text = [main_text(p) if p else "" for p in b.column("html").to_pylist()]
            yield pa.record_batch(
                [b.column("page_id"), b.column("url"), pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())],
                names=["page_id", "url", "text", "n_chars"])

    src = pages.select(pages[id_col].cast("long").alias("page_id"), pages[url_col].cast("string").alias("url"), pages[html_col].cast("string").alias("html"))
    return bounded_batches(src).mapInArrow(run, "page_id long, url string, text string, n_chars long")
