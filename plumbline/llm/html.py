"""Main text of web pages from flat text blocks.

A page is read once into flat blocks. Each block is described by its number of words and its link density, the same of its
neighbours, and what kind of section it stands in; a small decision tree says whether it belongs to the main text. The
tree is trained on LABELLED, a small table of labelled blocks.

Defined cases. Null or empty html gives an empty text. Broken markup never fails: an end tag without its start is ignored,
an open element ends with its parent, and what cannot be a tag is text. A script, style, title or textarea without an end tag takes
the rest of the page, as in browsers; another unread element (button, svg) without one, or closed in its tag, takes nothing. Repeated rows give equal results. Only page_id, url
and html are read.
"""

from __future__ import annotations

import re
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.support import map_steps

# Element names by their part in the layout. An element of plain text runs to its end tag or to the end of the page.
PLAIN_TEXT = "script|style|title|textarea"
UNREAD = frozenset("noscript template svg math iframe object canvas audio video select button xmp noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th "
    "thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CLOSED_BY_BLOCK = frozenset(["p"])
SIBLINGS = {"li": "li", "dt": "dt dd", "dd": "dt dd", "tr": "tr td th", "td": "td th", "th": "td th", "option": "option"}
ASIDE = frozenset("nav aside footer form menu dialog fieldset head".split())
HEADER = frozenset(["header", "hgroup"])
CONTENT = frozenset(["article", "main"])
# Class names, ids and roles that mark something other than the main text.
MARKS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner breadcrumb breadcrumbs comment comments commentlist "
    "complementary consent contentinfo cookie cookies copyright disqus footer gdpr menu menubar modal nav navbar navigation "
    "newsletter notice notification overlay pager pagination paywall popup promo promoted promotion recommended related "
    "replies reply respond search share sharing sidebar signup skip social sponsor sponsored subscribe subscription tags "
    "toolbar widget widgets alert dialog hidden".split())
# What may stand beside such a name in a compound one, as in site-footer or comment-list.
BESIDE_MARKS = frozenset(
    "area article articles bar block body bottom box button buttons container content entry form global group header heading "
    "holder icons inner item items left link links list main message page panel policy post posts primary right row secondary "
    "section site slot text title top unit wrap wrapper".split())
ALONE = frozenset("alert dialog hidden notification overlay skip tags".split())
CONTENT_MARKS = frozenset("article content entry post story".split())
KEEPS_MARKED = frozenset(["html", "body", "main"])

_TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<({PLAIN_TEXT})\b[^>]*>(?:.*?</\1\s*>|.*)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|</?[a-zA-Z][^<>]*>|<[!?][^>]*>|[^<]++|<", re.S | re.I)
_ATTRIBUTE = re.compile(r"([a-zA-Z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))|\b(hidden)\b")
_PARTS = re.compile(r"[A-Z]?[a-z0-9]+|[A-Z]+(?![a-z])")
_ARTICLE = re.compile(r"<article\b", re.I)
_TAG_OF = {name: re.compile(rf"<(/?){name}\b[^>]*>", re.I) for name in UNREAD}

FEATURES = ("words", "density", "words_before", "density_before", "words_after", "density_after", "in_content", "set_aside", "listed")
# Labelled blocks, as FEATURES and then 1 for main text.
LABELLED = """
    1 1.0 0 0.0 1 1.0 0 1 1 0
    2 1.0 1 1.0 3 1.0 0 1 1 0
    3 1.0 2 1.0 9 0.0 0 1 1 0
    9 0.0 3 1.0 6 0.0 0 1 0 0
    14 0.0 2 1.0 40 0.0 0 1 0 0
    8 0.0 70 0.0 0 0.0 0 1 0 0
    12 0.1 33 0.0 0 0.0 0 1 0 0
    60 0.0 4 0.0 80 0.0 0 1 0 0
    35 0.0 25 0.0 30 0.0 1 1 0 0
    6 0.5 90 0.0 5 0.6 1 1 0 0
    3 1.0 55 0.0 4 1.0 1 1 1 0
    48 0.0 20 0.0 0 0.0 1 1 0 0
    7 0.0 10 0.0 45 0.0 1 0 0 1
    1 0.0 8 0.0 25 0.0 1 0 0 1
    2 0.0 60 0.0 7 0.0 1 0 0 1
    80 0.0 7 0.0 30 0.0 1 0 0 1
    30 0.3 50 0.0 22 0.0 1 0 0 1
    5 1.0 40 0.0 60 0.0 1 0 0 1
    12 0.9 33 0.1 47 0.0 1 0 0 1
    4 0.0 30 0.0 5 0.0 1 0 1 1
    9 0.2 4 0.0 8 0.0 1 0 1 1
    3 0.0 0 0.0 2 0.0 1 0 0 1
    4 1.0 50 0.0 5 1.0 1 0 1 0
    5 1.0 4 1.0 6 1.0 1 0 1 0
    6 1.0 5 1.0 9 0.0 1 0 1 0
    60 0.0 9 0.0 70 0.0 0 0 0 1
    25 0.1 40 0.0 55 0.0 0 0 0 1
    18 0.0 60 0.0 35 0.0 0 0 0 1
    16 0.2 30 0.0 20 0.0 0 0 0 1
    6 0.0 50 0.0 45 0.0 0 0 0 1
    4 0.0 12 0.0 60 0.0 0 0 0 1
    3 0.0 22 0.0 18 0.0 0 0 0 1
    2 0.0 3 0.8 2 1.0 0 0 0 0
    7 0.0 2 1.0 1 1.0 0 0 0 0
    4 0.0 3 1.0 2 1.0 0 0 0 0
    5 1.0 2 1.0 60 0.0 0 0 0 0
    12 0.8 5 1.0 6 0.9 0 0 0 0
    20 0.7 9 0.8 12 0.9 0 0 0 0
    3 0.0 0 0.0 1 1.0 0 0 0 0
    8 0.9 40 0.0 30 0.1 0 0 0 0
    2 1.0 1 1.0 2 1.0 0 0 1 0
    6 1.0 6 1.0 7 1.0 0 0 1 0
    14 0.0 40 0.0 16 0.0 0 0 1 1
    9 0.0 12 0.0 11 0.0 0 0 1 1
    30 0.0 3 1.0 4 1.0 1 0 0 1
    2 0.0 1 1.0 2 1.0 1 0 0 1
    11 0.0 60 0.0 3 1.0 1 0 0 1
    1 0.0 0 0.0 6 1.0 1 0 0 1
    6 1.0 2 1.0 8 1.0 1 0 0 1
    70 0.4 5 0.9 9 1.0 1 0 0 1
    9 0.0 3 1.0 4 1.0 1 0 1 1
    16 0.2 5 1.0 14 0.0 1 0 1 1
    50 0.0 2 1.0 3 1.0 0 0 0 1
    33 0.1 4 1.0 6 0.9 0 0 0 1
    45 0.2 40 0.0 2 1.0 0 0 0 1
    22 0.0 3 1.0 31 0.0 0 0 0 1
    25 0.0 38 0.0 2 1.0 0 0 0 1
    3 0.0 2 1.0 44 0.0 0 0 0 1
    40 0.0 8 0.0 35 0.0 1 1 0 0
    10 0.0 0 0.0 6 0.0 0 1 0 0
    26 0.0 12 0.0 18 0.1 0 1 0 0
    5 0.0 44 0.0 52 0.0 1 1 0 0
    90 0.1 70 0.0 66 0.0 0 1 0 0
    13 0.0 9 0.0 41 0.0 1 1 1 0
    20 0.0 30 0.0 0 0.0 1 0 0 1
    6 0.0 12 0.0 1 1.0 1 0 0 1
    15 0.0 60 0.0 1 1.0 1 0 0 1
    12 0.0 90 0.0 14 0.0 1 0 0 1
    10 0.0 120 0.0 0 0.0 1 0 0 1
    40 0.0 80 0.0 2 1.0 1 0 0 1
    1 0.0 1 1.0 1 0.0 1 0 0 1
    2 0.0 150 0.0 0 0.0 1 0 1 1
    4 1.0 70 0.0 1 1.0 1 0 0 1
    30 0.0 80 0.0 40 0.0 0 0 0 1
    28 0.0 40 0.0 0 0.0 0 0 0 1
    11 0.0 90 0.0 70 0.0 0 0 0 1
    65 0.0 0 0.0 0 0.0 0 0 0 1
    21 0.1 2 1.0 0 0.0 0 0 0 1
    2 1.0 70 0.0 60 0.0 0 0 0 0
"""


def labelled() -> list[tuple[list[float], int]]:
    rows = [[float(x) for x in line.split()] for line in LABELLED.strip().splitlines()]
    return [(r[:-1], int(r[-1])) for r in rows]


def grow(rows: list[tuple[list[float], int]], depth: int = 8):
    """A binary decision tree by Gini impurity: a label, or (feature, cut, tree up to the cut, tree above it)."""
    ones = sum(y for _, y in rows)
    if depth == 0 or ones in (0, len(rows)):
        return int(2 * ones > len(rows))

    def impurity(part):
        p = sum(y for _, y in part) / len(part)
        return len(part) * p * (1 - p)

    best = None
    for f in range(len(rows[0][0])):
        values = sorted({x[f] for x, _ in rows})
        for low, high in zip(values, values[1:]):
            cut = (low + high) / 2
            left, right = [r for r in rows if r[0][f] <= cut], [r for r in rows if r[0][f] > cut]
            score = impurity(left) + impurity(right)
            if best is None or score < best[0] - 1e-12:
                best = (score, f, cut, left, right)
    if best is None:
        return int(2 * ones > len(rows))
    return best[1], best[2], grow(best[3], depth - 1), grow(best[4], depth - 1)


def decide(tree, x: list[float]) -> int:
    while not isinstance(tree, int):
        tree = tree[2] if x[tree[0]] <= tree[1] else tree[3]
    return tree


def _content(attributes: str) -> bool:
    """Whether an element's class or id names the main text."""
    return any(p.lower() in CONTENT_MARKS for key, a, b, c, _ in _ATTRIBUTE.findall(attributes)
               if key.lower() in ("class", "id", "itemprop") for p in _PARTS.findall(a or b or c))


def _names_mark(name: str, numbered: bool) -> bool:
    """Whether a class name, id or role is a mark, alone or in a compound of marks and plain layout words.

    So ``site-footer`` is one, ``no-sidebar`` and ``overflow-hidden`` are not. An id may end in a number (``comment-12``).
    """
    parts = [p.lower() for p in _PARTS.findall(name)]
    if numbered:
        parts = [p for p in parts if not p.isdigit()]
    if len(parts) == 1:
        return parts[0] in MARKS
    return (all(p in MARKS or p in BESIDE_MARKS for p in parts) and any(p in MARKS for p in parts)
            and not any(p in ALONE for p in parts))


def _marked(attributes: str) -> bool:
    """Whether an element's class, id or role sets it aside, or it is not shown."""
    for key, a, b, c, bare in _ATTRIBUTE.findall(attributes):
        key, value = key.lower(), a or b or c
        if bare or (key == "aria-hidden" and value.lower() == "true"):
            return True
        if key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return True
        if key in ("class", "id", "role") and any(_names_mark(x, key == "id") for x in value.split()):
            return True
    return False


class _Unread:
    """Where elements that are not read end. One without an end tag, or opened again before it, is passed over alone."""

    def __init__(self, html: str):
        self.html, self.found = html, {}

    def end(self, name: str, after: int) -> int:
        tag = self.found.get(name, after)
        if tag is not None and (isinstance(tag, int) or tag.start() < after):
            tag = self.found[name] = _TAG_OF[name].search(self.html, after)
        return tag.end() if tag is not None and tag.group(1) else after


def blocks(html: str) -> list[tuple[str, list[float]]]:
    """The flat text blocks of a page, each with its own five facts: words, link density, in_content, set_aside, listed."""
    out: list[tuple[str, list[float]]] = []
    stack: list[tuple[str, bool, bool]] = []  # name, in content, set aside
    links = 0
    unread, skipped = _Unread(html), 0
    only_article = len(_ARTICLE.findall(html)) == 1
    text: list[str] = []
    linked: list[str] = []

    def close() -> None:
        words = "".join(text).split()
        if words:
            inside, aside = (stack[-1][1], stack[-1][2]) if stack else (False, False)
            listed = any(s[0] in ("li", "dd", "dt", "td", "th") for s in stack)
            n_linked = len("".join(linked).split())
            out.append((" ".join(words), [len(words), min(1.0, n_linked / len(words)), float(inside), float(aside), float(listed)]))
        text.clear()
        linked.clear()

    def pop(names) -> None:
        while stack:
            name = stack.pop()[0]
            if name in names:
                return

    for token in _TOKEN.finditer(html):
        if token.start() < skipped:
            continue
        raw, end, name, attributes = token.group(0), token.group(2), token.group(3), token.group(4)
        if name is None:
            if raw[0] != "<" or raw == "<":
                plain = unescape(raw) if "&" in raw else raw
                text.append(plain)
                if links:
                    linked.append(plain)
            elif token.group(1) is not None:
                text.append(" ")
            continue
        name = name.lower()
        if name in UNREAD:
            text.append(" ")
            if not end and not raw.endswith("/>"):
                skipped = unread.end(name, token.end())
            continue
        if name == "a":
            links = 0 if end else 1
            linked.append(" ")
            continue
        if name == "br":
            text.append(" ")
            continue
        marked = False if end or name in VOID else bool(attributes) and name not in KEEPS_MARKED and _marked(attributes)
        if name not in BLOCK:
            if marked:
                # An inline element that is set aside becomes a block, so that its words stand alone.
                close()
                stack.append((name, stack[-1][1] if stack else False, True))
            elif end and any(s[0] == name for s in stack):
                close()
                pop((name,))
            continue
        close()
        links = 0
        if end:
            if any(s[0] == name for s in stack):
                pop((name,))
            continue
        if name in VOID:
            continue
        if stack and stack[-1][0] in CLOSED_BY_BLOCK:
            stack.pop()
        for sibling in SIBLINGS.get(name, "").split():
            if stack and stack[-1][0] == sibling:
                stack.pop()
        if name == "body":
            stack.clear()
        inside, aside = (stack[-1][1], stack[-1][2]) if stack else (False, False)
        if name == "main" or (name == "article" and only_article):
            # No mark of its own or of a wrapper sets a page's content aside; a menu, form or footer still does.
            aside = any(s[0] in ASIDE for s in stack)
        else:
            aside = aside or name in ASIDE or marked or (name in HEADER and not inside)
        inside = inside or name in CONTENT or (bool(attributes) and name not in KEEPS_MARKED and _content(attributes))
        stack.append((name, inside, aside))
    close()
    return out


def main_text(html: str, tree) -> str:
    found = blocks(html)
    edge = (0.0, 0.0)
    kept = []
    for i, (text, own) in enumerate(found):
        before = found[i - 1][1][:2] if i else edge
        after = found[i + 1][1][:2] if i + 1 < len(found) else edge
        if decide(tree, [*own[:2], *before, *after, *own[2:]]):
            kept.append(text)
    return "\n".join(kept)


def extract(pages: DataFrame) -> DataFrame:
    """The main text of every page."""
    tree = grow(labelled())
    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"),
                        F.col("html").cast("string").alias("html"))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [main_text(h, tree) if h else "" for h in batch.column("html").to_pylist()]
        return pa.RecordBatch.from_arrays(
            [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
            names=["page_id", "url", "text", "n_chars"])

    return map_steps(rows, run, "page_id bigint, url string, text string, n_chars bigint", "html")
