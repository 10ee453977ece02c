"""HTML extraction: flat text blocks, judged by a decision tree.

A page is read once from left to right into flat blocks of text. A block is described by its word count
and link density, those of the blocks before and after it, and by the elements it lies in. A
decision tree, grown on the small labelled table ``EXAMPLES``, says which blocks are main text.
"""

from __future__ import annotations

import html as entities
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FEATURES = ("words", "links", "words_before", "links_before", "words_after", "links_after", "aside", "main", "heading")

#: The labelled table: FEATURES as listed above (aside: in a menu, header, footer, advert, form, comment or
#: the like; main: in an article or main element), then 1 for main text. Link densities are shares of words.
EXAMPLES = [
    # articles in their own element, between menus and footers
    (8, 0.0, 1, 1.0, 60, 0.0, 0, 1, 1, 1), (60, 0.0, 8, 0.0, 45, 0.0, 0, 1, 0, 1), (1, 0.0, 50, 0.0, 40, 0.0, 0, 1, 0, 1),
    (2, 0.0, 1, 0.0, 3, 0.0, 0, 1, 0, 1), (30, 0.1, 45, 0.0, 1, 0.0, 0, 1, 0, 1), (45, 0.0, 30, 0.1, 12, 0.1, 0, 1, 0, 1),
    (3, 1.0, 40, 0.0, 35, 0.0, 0, 1, 0, 1), (4, 0.0, 2, 1.0, 1, 0.0, 0, 1, 1, 1), (1, 0.0, 1, 0.0, 9, 0.0, 0, 1, 0, 1),
    (90, 0.3, 20, 0.0, 20, 0.0, 0, 1, 0, 1), (6, 0.5, 30, 0.0, 8, 0.0, 0, 1, 0, 1), (5, 0.0, 6, 0.0, 4, 1.0, 0, 1, 0, 1),
    # what surrounds them, whatever its length
    (1, 1.0, 0, 0.0, 1, 1.0, 1, 0, 0, 0), (1, 1.0, 1, 1.0, 8, 0.0, 1, 0, 0, 0), (12, 0.1, 40, 0.0, 0, 0.0, 1, 0, 0, 0),
    (7, 0.0, 1, 1.0, 8, 0.0, 1, 0, 0, 0), (35, 0.0, 60, 0.0, 20, 0.0, 1, 0, 0, 0), (80, 0.0, 35, 0.0, 50, 0.0, 1, 0, 0, 0),
    (4, 0.0, 12, 0.0, 2, 0.0, 1, 0, 1, 0), (20, 0.0, 4, 0.0, 15, 0.0, 1, 0, 0, 0), (6, 0.0, 30, 0.0, 5, 0.0, 1, 1, 0, 0),
    (40, 0.0, 30, 0.0, 25, 0.0, 1, 1, 0, 0), (2, 1.0, 50, 0.0, 60, 0.0, 1, 1, 0, 0), (3, 0.0, 20, 0.0, 20, 0.0, 1, 1, 1, 0),
    # pages without such elements: long blocks of few links, and short ones between them
    (40, 0.0, 3, 0.0, 50, 0.0, 0, 0, 0, 1), (25, 0.05, 40, 0.0, 30, 0.0, 0, 0, 0, 1), (18, 0.0, 25, 0.1, 40, 0.0, 0, 0, 0, 1),
    (70, 0.2, 1, 1.0, 9, 0.0, 0, 0, 0, 1), (22, 0.0, 30, 0.0, 2, 1.0, 0, 0, 0, 1), (5, 0.0, 40, 0.0, 30, 0.0, 0, 0, 0, 1),
    (3, 0.0, 20, 0.1, 25, 0.0, 0, 0, 0, 1), (6, 0.0, 2, 1.0, 45, 0.0, 0, 0, 1, 1), (9, 0.0, 0, 0.0, 30, 0.0, 0, 0, 1, 1),
    (1, 1.0, 1, 1.0, 1, 1.0, 0, 0, 0, 0), (1, 1.0, 1, 1.0, 25, 0.0, 0, 0, 0, 0), (2, 1.0, 30, 0.0, 30, 0.0, 0, 0, 0, 0),
    (3, 1.0, 60, 0.0, 50, 0.0, 0, 0, 0, 0), (9, 1.0, 90, 0.0, 5, 0.5, 0, 0, 0, 0), (4, 1.0, 5, 0.9, 3, 1.0, 0, 0, 0, 0), (12, 0.8, 3, 1.0, 40, 0.0, 0, 0, 0, 0),
    (25, 0.7, 30, 0.0, 4, 0.9, 0, 0, 0, 0), (6, 0.0, 2, 1.0, 1, 1.0, 0, 0, 0, 0), (9, 0.0, 4, 0.8, 5, 0.0, 0, 0, 0, 0),
    (3, 0.0, 4, 0.0, 2, 0.0, 0, 0, 0, 0), (8, 0.4, 20, 0.0, 2, 1.0, 0, 0, 0, 0), (5, 0.0, 9, 0.3, 0, 0.0, 0, 0, 0, 0),
]

BLOCK = frozenset("""address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset
figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary
table tbody td tfoot th thead tr ul""".split())
#: Elements that are tracked from start to end tag; the others only cut or decorate text.
HOLDERS = frozenset("""article aside blockquote body center details dialog div dl fieldset figure footer form header
li main menu nav ol section table td ul""".split())
#: Elements whose start tag ends an open one of the same name inside the same list or table.
RESTART = {"li": ("ul", "ol", "menu"), "td": ("table",)}
RAW = frozenset("script style noscript template textarea title head svg iframe select button object math".split())
ASIDE = frozenset("nav header footer aside menu dialog".split())
SHUT = frozenset(["form", "fieldset"])
#: Words in class, id or role that mark what is beside the text, and what is never main text inside.
ASIDE_WORD = re.compile(r"""(?:^|[\s_-])(?:ads?|advert\w*|banner|breadcrumbs?|cookies?|consent|contentinfo|footer|
    header|masthead|menu|modal|nav\w*|newsletter|notices?|alert|paywall|popup|promo\w*|recommend\w*|related|search|
    share|sharing|sidebar|social|sponsor\w*|subscri\w*|tags?|toc|toolbar|widget|complementary)(?=$|[\s_-])""", re.I | re.X)
SHUT_WORD = re.compile(r"(?:^|[\s_-])(?:comments?|commentlist|replies|reply|respond|discussion|disqus\w*|hidden)(?=$|[\s_-])", re.I)
NAMED = re.compile(r"""(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
HIDDEN = re.compile(r"""\shidden(?=[\s=>/]|$)|display\s*:\s*none|aria-hidden\s*=\s*["']?true""", re.I)
HEADING = re.compile(r"h[1-6]$")


def grow(rows: np.ndarray, labels: np.ndarray, depth: int = 6):
    """A decision tree by Gini impurity: (feature, cut, below, above), or the share of label 1 as a leaf."""
    share = float(labels.mean())
    if depth == 0 or share in (0.0, 1.0):
        return share
    best = None
    for f in range(rows.shape[1]):
        values = np.unique(rows[:, f])
        for cut in (values[1:] + values[:-1]) / 2:
            low = rows[:, f] < cut
            n, p, q = low.sum(), labels[low].mean(), labels[~low].mean()
            gini = n * p * (1 - p) + (len(low) - n) * q * (1 - q)
            if best is None or gini < best[0] - 1e-12:
                best = (gini, f, float(cut), low)
    if best is None:
        return share
    _, f, cut, low = best
    return f, cut, grow(rows[low], labels[low], depth - 1), grow(rows[~low], labels[~low], depth - 1)


def train(examples: list[tuple] = EXAMPLES):
    table = np.array(examples, dtype=np.float64)
    return grow(table[:, :-1], table[:, -1])


def judge(tree, row: tuple) -> bool:
    while isinstance(tree, tuple):
        tree = tree[2] if row[tree[0]] < tree[1] else tree[3]
    return tree >= 0.5


class _Quotes:
    """Ends of tags in one pass: a quote that never closes is looked for only once."""

    def __init__(self, page: str):
        self.page, self.open = page, set()

    def end(self, at: int) -> int:
        """Index of the ``>`` that ends the tag starting at ``at``, or -1."""
        page, first = self.page, self.page.find(">", at)
        if first < 0:
            return -1
        i = at
        while True:
            stop = page.find(">", i)
            if stop < 0:
                return first
            marks = [(p, q) for q in "\"'" if q not in self.open and (p := page.find(q, i, stop)) >= 0]
            if not marks:
                return stop
            p, q = min(marks)
            close = page.find(q, p + 1)
            if close < 0:
                self.open.add(q)
                return first
            i = close + 1


class _Open:
    """The open elements, however deep: what they make of the text inside, and the places of each name."""

    def __init__(self):
        self.names: list[str] = []
        self.places: dict[str, list[int]] = {}
        self.states = [(False, False, False, False)]  # aside, main, shut, inside any main; the first is the page's

    def state(self):
        return self.states[-1]

    def push(self, name: str, kind: str) -> None:
        aside, main, shut, any_main = self.states[-1]
        if not shut:
            if kind == "main":
                aside, main = False, True
            elif kind:
                aside, shut = True, kind == "shut"
        self.places.setdefault(name, []).append(len(self.names))
        self.names.append(name)
        self.states.append((aside, main, shut, any_main or kind == "main"))

    def last(self, *names: str) -> int:
        """Place of the innermost element of these names, or -1."""
        return max((self.places[n][-1] for n in names if self.places.get(n)), default=-1)

    def close(self, at: int) -> None:
        """Close the element at this place and all inside it; each is closed once."""
        while len(self.names) > at:
            self.places[self.names.pop()].pop()
            self.states.pop()


def blocks(page: str):
    """Flat blocks of a page: (text, words, words in links, aside, main, heading)."""
    out, parts, stack = [], [], _Open()
    low = page.lower()
    if len(low) != len(page):  # a letter whose lower case is longer
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in page)
    quotes = _Quotes(page)
    state = {"links": 0, "heading": False, "own": False}

    def close_block():
        words = linked = 0
        texts = []
        # A reference never spans tags, so each piece is decoded on its own; pieces join without a gap.
        for text, link in parts:
            texts.append(text)
            if link:
                linked += len(text.split())
        parts.clear()
        tidy = " ".join("".join(texts).split())
        if not tidy:
            return
        words = len(tidy.split(" "))
        aside, main, _, _ = stack.state()
        out.append((tidy, words, min(linked, words), aside or state["own"], main, state["heading"]))

    def text(a: int, b: int):
        if b > a:
            parts.append((entities.unescape(page[a:b]), state["links"] > 0))

    at, n = 0, len(page)
    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            text(at, n)
            break
        text(at, lt)
        if page.startswith("<!--", lt):
            end = page.find("-->", lt + 2)
            at = n if end < 0 else end + 3
            continue
        nxt = page[lt + 1:lt + 2]
        if nxt in ("!", "?"):
            end = page.find(">", lt)
            at = n if end < 0 else end + 1
            continue
        name_at = lt + 2 if nxt == "/" else lt + 1
        if not page[name_at:name_at + 1].isalpha():
            text(lt, lt + 1)
            at = lt + 1
            continue
        end = quotes.end(name_at)
        if end < 0:  # a tag that the page cuts off
            break
        stop = name_at
        while stop < end and not (page[stop].isspace() or page[stop] == "/"):
            stop += 1
        name, ends = low[name_at:stop], nxt == "/"
        at = end + 1
        if name in RAW and not ends:
            if page[end - 1] == "/" and name in ("svg", "object", "math"):
                continue
            close = low.find(f"</{name}", at)
            if name == "head":
                body = low.find("<body", at)
                close = min((x for x in (close, body) if x >= 0), default=-1)
                at = close if close >= 0 else at
                continue
            if close < 0:
                at = n if name in ("script", "style", "title", "textarea") else at
                continue
            shut = page.find(">", close)
            at = n if shut < 0 else shut + 1
            if name in ("button", "select", "textarea", "iframe", "object"):
                parts.append((" ", False))
            continue
        if name == "a":
            state["links"] = 0 if ends else 1
        if name not in BLOCK:
            continue
        close_block()
        if HEADING.match(name):
            state["heading"] = not ends
        else:
            state["heading"] = False
        state["own"] = False
        if name not in HOLDERS and ends:
            continue
        if ends:
            if (at_open := stack.last(name)) >= 0:
                stack.close(at_open)
            continue
        tag = page[stop:end]
        called = " ".join("".join(m) for m in NAMED.findall(tag))
        kind = ""
        if name in SHUT or SHUT_WORD.search(called) or HIDDEN.search(tag):
            kind = "shut"
        elif name in ASIDE:
            # The header or footer of an article is beside its text, but not its headline.
            kind = "" if name == "header" and stack.state()[3] else "aside"
        elif name in ("article", "main") or re.search(r"(?:^|\s)main(?=$|\s)", called, re.I):
            kind = "main"
        elif ASIDE_WORD.search(called) and name != "body":
            kind = "aside"
        if name not in HOLDERS:  # holds only its own text, up to the next block
            state["own"] = kind in ("shut", "aside")
            continue
        if name in RESTART:
            i = stack.last(name, *RESTART[name])
            if i >= 0 and stack.names[i] == name:
                stack.close(i)
        stack.push(name, kind)
    close_block()
    return out


def main_text(page: str | None, tree) -> str:
    found = blocks(page or "")
    density = [linked / words for _, words, linked, *_ in found]
    kept = []
    for i, (tidy, words, _, aside, main, heading) in enumerate(found):
        before = (found[i - 1][1], density[i - 1]) if i else (0, 0.0)
        after = (found[i + 1][1], density[i + 1]) if i + 1 < len(found) else (0, 0.0)
        if judge(tree, (words, density[i], *before, *after, aside, main, heading)):
            kept.append(tidy)
    return " ".join(kept)


def extract(pages: DataFrame, examples: list[tuple] = EXAMPLES) -> DataFrame:
    """Return page_id, url, text, n_chars for every row, extracted where it is read.

    Null html counts as empty: its text is the empty string. Plain text without tags is one
    block; unclosed elements end with the page, an unclosed comment hides the rest, a tag cut off by the
    end is dropped. Repeated rows and null ids or urls are passed through; an empty table gives an empty result.
    White space is what Unicode says, no-break spaces too. Other columns of ``pages`` are not read.
    """
    tree = train(examples)

    def run(batches):
        for batch in batches:
            texts = [main_text(h.as_py(), tree) for h in batch.column(2)]
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(texts, pa.string()),
                                   pa.array([len(t) for t in texts], pa.int64())],
                                  names=["page_id", "url", "text", "n_chars"])

    kind = pages.schema["page_id"].dataType.simpleString()
    return pages.select("page_id", F.col("url").cast("string"), "html").mapInArrow(
        run, f"page_id {kind}, url string, text string, n_chars long")
