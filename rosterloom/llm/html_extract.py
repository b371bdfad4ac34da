"""Main text of web pages by minimum-cut labelling of their blocks.

A page is read once into blocks: runs of text between block-level boundaries.  A classifier turns a
block's tags, class names, link share and length into the cost of calling it content and the cost of
calling it boilerplate; these are the capacities to the two terminals.  What an element's tag, name or role says against it
holds for everything inside, unless the element turns out to wrap the page: it holds half of the running text together with
a headline, an article or a main element, or, where it is a form or a layout name, nearly all of it.  Neighbours in page order and
blocks of the same container are tied by smoothness edges, weaker the more container borders lie
between them.  The minimum cut, found by maximum flow, labels all blocks of a page at once.
Scripts, styles, form controls and what is not shown are no blocks.

Blocks whose own costs outweigh all their ties keep their label in every minimum cut; they are settled
first, and only what is left needs augmenting paths.

Defined cases: a null or empty page, or one without content blocks, gives an empty text; white space
inside a block (line breaks by tag too) becomes one space, blocks are joined by a newline; a tag that is cut off at the end of
the page is no text; each row is judged by itself, so repeated rows get equal texts; an empty table
gives no rows; other columns are kept, and one of the name of the new column is replaced.
"""

from __future__ import annotations

import re
from collections import deque
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Tags without text of their own page: what is inside is neither content nor boilerplate.
SILENT = frozenset(
    "script style noscript template head title svg math canvas iframe object embed audio video map select option datalist "
    "textarea button progress meter dialog".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details div dl dt fieldset figcaption figure footer form frameset "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
# A start tag closes open elements of these kinds, up to the next element of the second kind.
CLOSES = {
    "li": ("li", "ul ol menu"),
    "dt": ("dt dd", "dl"),
    "dd": ("dt dd", "dl"),
    "tr": ("tr td th", "table"),
    "td": ("td th", "tr table"),
    "th": ("td th", "tr table"),
    "tbody": ("tbody thead tfoot tr td th", "table"),
    "thead": ("tbody thead tfoot tr td th", "table"),
    "tfoot": ("tbody thead tfoot tr td th", "table"),
}
CLOSES = {tag: (frozenset(a.split()), frozenset(b.split())) for tag, (a, b) in CLOSES.items()}

# Weights of the classifier in favour of content.
TAG_WEIGHT = {
    "article": 3.0, "main": 3.0, "nav": -9.0, "footer": -9.0, "aside": -9.0, "form": -9.0, "menu": -9.0, "fieldset": -4.0,
    "label": -4.0, "header": -3.0, "address": -2.0, "figcaption": -0.5, "li": -0.4,
}
BOILER_NAMES = frozenset(
    "nav navbar navigation menu menubar submenu topbar toolbar sidebar aside footer foot header masthead breadcrumb breadcrumbs "
    "ad ads adv advert adverts advertisement advertising adsense adslot banner sponsor sponsored promo promoted promotion "
    "cookie cookies consent gdpr privacy notice notices notification alert popup modal overlay paywall newsletter subscribe "
    "subscription signup signin login register search share sharing social follow comment comments commentlist respond reply replies "
    "disqus discussion related recommended recommendations popular trending pagination pager paging widget widgets "
    "tags taglist tagcloud form forms copyright legal disclaimer skip skiplink hidden".split()
)
CONTENT_NAMES = frozenset("article articlebody content entry post story body maincontent main text prose".split())
ROLE_WEIGHT = {
    "navigation": -9.0, "banner": -9.0, "contentinfo": -9.0, "complementary": -9.0, "search": -9.0, "dialog": -9.0,
    "alertdialog": -9.0, "alert": -9.0, "menu": -9.0, "menubar": -9.0, "form": -9.0, "toolbar": -9.0, "main": 3.0, "article": 3.0,
}
NAME_BOILER, NAME_CONTENT = -7.0, 1.5
# A header of an entry is its title; names of layouts tell what stands beside the content.
TITLE_NAMES = frozenset("header head".split())
BESIDE_NAMES, FRAME_NAMES = frozenset("has with no".split()), frozenset("wrap wrapper container layout grid inner outer".split())
READER_NAMES = frozenset("comment comments commentlist disqus respond reply replies discussion".split())
MARKED = -3.0  # weights from here on count as said against an element as a whole
MOST_TEXT, NEARLY_ALL = 0.5, 0.9
START = -0.5
HEADING, PARAGRAPH = 0.8, 1.0
PER_WORD, MOST_WORDS = 0.06, 40
LINKED = -4.0
SENTENCE, NOTICE = 0.5, -2.5
NEXT_TIE, FAR_TIE, SIBLING_TIE = 0.25, 1.0, 0.4

_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")
_SPACE = re.compile(r"\s+")
_CUT_OFF = re.compile(r"<(?:[a-zA-Z/!?][^<>]*)?\Z")
_NOTICE = re.compile(r"(?i:\A\W*(?:©|\(c\)|copyright\b|all rights reserved|we use cookies|this site uses cookies|advertisement\b|sponsored\b))")
_HIDDEN = re.compile(r"(?i:display\s*:\s*none|visibility\s*:\s*hidden)")


class Block:
    __slots__ = ("text", "linked", "weight", "container", "path", "marks")

    def __init__(self, text: str, linked: int, weight: float, container: int, path: tuple[int, ...], marks: tuple[int, ...] = ()):
        self.text, self.linked, self.weight, self.container, self.path, self.marks = text, linked, weight, container, path, marks


class Mark:
    """What is said against an element, and what it holds."""

    __slots__ = ("weight", "readers", "running", "heads")

    def __init__(self, weight: float, readers: bool):
        self.weight, self.readers, self.running, self.heads = weight, readers, 0, False


class PageReader(HTMLParser):
    """Blocks of a page in order.  Open elements are a stack; broken nesting never fails."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.blocks: list[Block] = []
        # (tag, weight inside, silent, linked, container number, path of containers, marks of it and the elements around)
        self.stack: list[tuple] = [("", 0.0, False, False, 0, (0,), ())]
        self.marks: list[Mark] = []
        self.running = 0
        self.containers = 0
        self.parts: list[str] = []
        self.linked = 0

    def flush(self) -> None:
        if self.parts:
            text = _SPACE.sub(" ", "".join(self.parts)).strip()
            if text:
                top = self.stack[-1]
                self.blocks.append(Block(text, self.linked, top[1] + self.own_weight(), top[4], top[5], top[6]))
                plain = max(0, len(text) - self.linked)
                self.running += plain
                for m in top[6]:
                    self.marks[m].running += plain
            self.parts, self.linked = [], 0

    def own_weight(self) -> float:
        """Weight of the nearest block element: headings and paragraphs."""
        for entry in reversed(self.stack):
            if entry[0] in BLOCKS:
                return HEADING if entry[0] in HEADINGS else PARAGRAPH if entry[0] in ("p", "pre", "blockquote") else 0.0
        return 0.0

    def close_to(self, depth: int) -> None:
        if any(entry[0] in BLOCKS for entry in self.stack[depth:]):
            self.flush()
        del self.stack[depth:]

    def implied_ends(self, tag: str) -> None:
        if tag in BLOCKS:
            for i in range(len(self.stack) - 1, 0, -1):
                if self.stack[i][0] == "p":
                    self.close_to(i)
                    break
                if self.stack[i][0] in BLOCKS:
                    break
        if tag in CLOSES:
            closed, border = CLOSES[tag]
            for i in range(len(self.stack) - 1, 0, -1):
                if self.stack[i][0] in closed:
                    self.close_to(i)
                elif self.stack[i][0] in border:
                    break
        if tag in HEADINGS and self.stack[-1][0] in HEADINGS:
            self.close_to(len(self.stack) - 1)

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag == "br":
            self.parts.append(" ")
            return
        if tag == "body":
            for i in range(len(self.stack) - 1, 0, -1):
                if self.stack[i][0] == "head":
                    self.close_to(i)
        if tag in VOID:
            if tag in BLOCKS:
                self.flush()
            return
        self.implied_ends(tag)
        if tag in BLOCKS:
            self.flush()
        _, weight, silent, linked, container, path, marks = self.stack[-1]
        own = TAG_WEIGHT.get(tag, 0.0) if tag != "header" or weight <= 0 else 0.0
        hidden, readers = False, False
        for name, value in attrs:
            if name == "hidden":
                hidden = True
            elif value and name in ("class", "id"):
                names = {w.lower() for w in _NAME.findall(value)}
                against = names & BOILER_NAMES
                entitled = against <= TITLE_NAMES or names & FRAME_NAMES
                if against and tag not in ("body", "html", "article", "main") and not names & BESIDE_NAMES and not (names & CONTENT_NAMES and entitled):
                    own += NAME_BOILER
                    readers = readers or bool(names & READER_NAMES)
                elif names & CONTENT_NAMES and not against:
                    own += NAME_CONTENT
            elif value and name == "role":
                own += ROLE_WEIGHT.get(value.strip().lower(), 0.0)
            elif value and name == "aria-hidden":
                hidden = hidden or value.strip().lower() == "true"
            elif value and name == "style":
                hidden = hidden or bool(_HIDDEN.search(value))
        if own <= MARKED:
            self.marks.append(Mark(own, readers))
            marks = (*marks, len(self.marks) - 1)
        else:
            weight += own
            if tag in ("h1", "article", "main"):
                for m in marks:
                    self.marks[m].heads = True
        if tag in BLOCKS and tag != "p" and tag not in HEADINGS:
            self.containers += 1
            container, path = self.containers, (*path[-7:], self.containers)
        self.stack.append((tag, weight, silent or hidden or tag in SILENT, linked or tag == "a", container, path, marks))

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        # The slash means nothing on elements that can hold text.
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        if tag == "br":
            self.parts.append(" ")
            return
        for i in range(len(self.stack) - 1, 0, -1):
            if self.stack[i][0] == tag:
                self.close_to(i)
                return
            # An inline end tag does not close the block around it.
            if tag not in BLOCKS and self.stack[i][0] in BLOCKS and tag not in SILENT:
                return

    def handle_data(self, data: str) -> None:
        if not self.stack[-1][2]:
            self.parts.append(data)
            if self.stack[-1][3]:
                self.linked += len(data)


def read_blocks(html: str) -> list[Block]:
    reader = PageReader()
    reader.feed(_CUT_OFF.sub("", html))
    reader.close()
    reader.flush()
    holds = [wraps_the_page(m, reader.running) for m in reader.marks]
    for block in reader.blocks:
        block.weight += sum(reader.marks[m].weight for m in block.marks if not holds[m])
    return reader.blocks


def wraps_the_page(mark: Mark, running: int) -> bool:
    """Whether an element holds so much of the page's running text that what is said against it says nothing."""
    most = mark.running > MOST_TEXT * running
    return most and (mark.heads or not mark.readers and mark.running > NEARLY_ALL * running)


def content_score(block: Block) -> float:
    """Cost of calling the block boilerplate less the cost of calling it content."""
    words = block.text.count(" ") + 1
    score = START + block.weight + PER_WORD * min(words, MOST_WORDS)
    score += LINKED * min(1.0, block.linked / len(block.text))
    if block.text[-1] in ".!?:;\"'”’…。！？":
        score += SENTENCE
    if _NOTICE.match(block.text):
        score += NOTICE
    return score


def ties(blocks: list[Block]) -> list[tuple[int, int, float]]:
    """Smoothness edges: neighbours in page order, and neighbours among the blocks of a container."""
    out, last = [], {}
    for i, block in enumerate(blocks):
        if i:
            a, b = blocks[i - 1].path, block.path
            shared = len(set(a) & set(b))
            out.append((i - 1, i, NEXT_TIE + FAR_TIE / (1 + len(a) + len(b) - 2 * shared)))
        if last.get(block.container, i - 1) != i - 1:
            out.append((last[block.container], i, SIBLING_TIE))
        last[block.container] = i
    return out


def minimum_cut(scores: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Labels (true: content) of least cost: |score| for each label against its score, and w for each edge cut.

    Ties go to boilerplate.
    """
    near: list[dict[int, float]] = [{} for _ in scores]
    for a, b, w in edges:
        near[a][b] = near[a].get(b, 0.0) + w
        near[b][a] = near[b].get(a, 0.0) + w
    net, label = list(scores), [None] * len(scores)
    bound = [sum(n.values()) for n in near]
    ready = deque(i for i in range(len(scores)) if abs(net[i]) > bound[i] or not near[i])
    while ready:
        i = ready.popleft()
        if label[i] is not None:
            continue
        label[i] = net[i] > 0
        for j, w in near[i].items():
            del near[j][i]
            if label[j] is None:
                net[j] += w if label[i] else -w
                bound[j] -= w
                if abs(net[j]) > bound[j] + 1e-12 or not near[j]:
                    ready.append(j)
        near[i] = {}
    left = [i for i in range(len(scores)) if label[i] is None]
    if left:
        for i in _source_side(left, net, near):
            label[i] = True
    return [bool(x) for x in label]


def _source_side(nodes: list[int], net: list[float], near: list[dict[int, float]]) -> list[int]:
    """Nodes that the source still reaches after a maximum flow along shortest augmenting paths."""
    source, sink, least = -1, -2, 1e-12
    rest: dict[int, dict[int, float]] = {i: dict(near[i]) for i in nodes}
    rest[source] = {i: net[i] for i in nodes if net[i] > 0}
    rest[sink] = {}
    for i in nodes:
        if net[i] < 0:
            rest[i][sink] = -net[i]
    while True:
        came, queue = {source: source}, deque([source])
        while queue and sink not in came:
            i = queue.popleft()
            for j, room in rest[i].items():
                if room > least and j not in came:
                    came[j] = i
                    queue.append(j)
        if sink not in came:
            return [i for i in came if i >= 0]
        path, j = [], sink
        while j != source:
            path.append((came[j], j))
            j = came[j]
        flow = min(rest[a][b] for a, b in path)
        for a, b in path:
            rest[a][b] -= flow
            rest[b][a] = rest[b].get(a, 0.0) + flow


def main_text(html: str | None) -> str:
    """The content blocks of a page, joined by newlines."""
    if not html:
        return ""
    blocks = read_blocks(html)
    labels = minimum_cut([content_score(b) for b in blocks], ties(blocks))
    return "\n".join(b.text for b, content in zip(blocks, labels) if content)


def extract(pages: DataFrame, into: str = "text") -> DataFrame:
    """Add the main text of ``html``."""

    @F.pandas_udf("string")
    def texts(pages: pd.Series) -> pd.Series:
        return pages.map(lambda html: main_text(html) if isinstance(html, str) else "")

    return pages.withColumn(into, texts(F.col("html").cast("string")))
