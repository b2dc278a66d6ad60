"""Main text of web pages by a minimum cut between content and boilerplate.

A page is split into blocks of text at block-level tags. A logistic classifier on what is known of a
block (its length, links and punctuation, and what kinds of elements it is in) gives the costs of
calling it content or boilerplate, which are the capacities of its edges to the two terminals.
Smoothness edges join blocks that follow each other, and blocks that are next to each other under one
element, weighted by their distance in the element tree. The maximum flow separates the two sides;
blocks whose own evidence outweighs all their edges are settled first, which does not change the cut,
and the flow is computed over each group of blocks that is left.

The classifier's coefficients are fixed values: no labels of pages exist to fit them on. Pages are
independent, so nothing is shuffled.

Elements that a browser does not show (the attribute hidden, aria-hidden, a style of display:none or
visibility:hidden, the class hidden) are left out with all that is in them.

Defined results: a null or empty page has an empty text of length 0; markup that is not closed ends
with the page; unknown character references stay as they are; repeated rows give repeated results;
extra columns are ignored.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter, deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

#: Names of elements by their meaning in a page.
RAW = frozenset("script style noscript template iframe textarea title svg math object select head".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
BOILERPLATE = frozenset("nav footer aside form menu dialog button fieldset".split())
CONTENT = frozenset("article main".split())
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 pre blockquote figcaption dd dt td".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: Words of class, id, role and label attributes that speak against or for content.
AGAINST = frozenset(
    "nav navbar navigation menu menus breadcrumb breadcrumbs sidebar side rail footer masthead topbar banner ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion "
    "cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login register comment comments commentlist disqus discussion replies reply respond "
    "share sharing social pagination pager toolbar search searchform copyright contentinfo dialog".split()
)
#: Words that are as often on parts of an article; they lower its odds and do not settle them.
DOUBTFUL = frozenset("related recommended recommendations widget widgets complementary form skip tags byline".split())
FOR = frozenset("article articlebody content post entry story main body text maintext".split())

TOKEN = re.compile(r"""<!--.*?(?:--!?>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)""", re.S)
ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
#: Attributes whose words tell what an element is for.
TELLING = ("class", "id", "role", "aria-label", "itemprop")
UNSEEN = re.compile(r"(?:^|;)\s*(?:display\s*:\s*none|visibility\s*:\s*hidden)\b", re.I)
CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])|[^A-Za-z]+")
SENTENCE = re.compile(r"[.!?…:;\"'”’»)\]]\s*$")
MARKS = re.compile(r"©|\(c\)|all rights reserved|https?://", re.I)

#: Fixed coefficients of the classifier (log-odds of content). Length, links and punctuation tell most blocks; short ones are left to their neighbours.
WEIGHTS = {"bias": -1.9, "log_words": 0.8, "links": -4.5, "sentence": 0.5, "marks": -1.0, "prose": 0.8, "content": 1.0, "class_for": 0.5, "against": -5.0, "doubtful": -2.0, "header": -3.5}
#: Strength of the smoothness edges, and how it falls with distance in the tree and with contrast; beyond FAR edges there is none.
FOLLOWING, SIBLING, DECAY, FAR, CONTRAST = 2.0, 2.6, 0.5, 24, 0.3


def attributes_of(text: str) -> dict[str, str]:
    """The attributes of a start tag by name, the first of each name; those without a value have an empty one."""
    found: dict[str, str] = {}
    for m in ATTRIBUTE.finditer(text):
        found.setdefault(m[1].lower(), html.unescape(m[2] or m[3] or m[4] or ""))
    return found


def unseen(attributes: dict[str, str]) -> bool:
    """Whether a browser does not show an element: by its own attribute, by style, or by a class that says just that."""
    by_attribute = "hidden" in attributes or attributes.get("aria-hidden", "").strip().lower() == "true"
    return by_attribute or bool(UNSEEN.search(attributes.get("style", ""))) or "hidden" in attributes.get("class", "").lower().split()


class Element:
    __slots__ = ("tag", "up", "depth", "against", "doubtful", "content", "header", "likely", "unseen")

    def __init__(self, tag: str, up: Element | None, attributes: str) -> None:
        self.tag, self.up, self.depth = tag, up, up.depth + 1 if up else 0
        given = attributes_of(attributes) if attributes else {}
        said = {w for k in TELLING for w in CAMEL.sub(" ", given.get(k, "")).lower().split()} if given else set()
        self.unseen = bool(up and up.unseen) or bool(given and unseen(given))
        self.doubtful = bool(up and up.doubtful) or bool(said & DOUBTFUL)
        self.content = tag in CONTENT or "main" in said or bool(up and up.content)
        self.header = bool(up and up.header) or ((tag == "header" or "header" in said) and not (up and up.content))
        body = tag in ("html", "body", "article", "main")
        told = not body and (tag in BOILERPLATE or bool(said & AGAINST))
        self.against = bool(up and up.against) or told
        self.likely = bool(said & FOR) or bool(up and up.likely)


class Block:
    __slots__ = ("text", "links", "element")

    def __init__(self, text: str, links: int, element: Element) -> None:
        self.text, self.links, self.element = text, links, element


def blocks_of(page: str) -> list[Block]:
    """The blocks of a page in order, with their text (references decoded, white space as one space) and element."""
    top = Element("html", None, "")
    stack, blocks, held, anchors, linked, at = [top], [], [], 0, 0, 0
    open_tags, without_end = Counter(), set()
    #: The inline element that is not shown: its name, how many of that name are open in it, and the depth at which it began.
    veil: list = []

    def pop() -> None:
        open_tags[stack.pop().tag] -= 1

    def end_of(name: str, pattern: str) -> int | None:
        """Where the next end tag of a name ends; one that was not found once is not looked for again."""
        found = None if name in without_end else re.compile(pattern, re.I).search(page, at)
        if not found:
            without_end.add(name)
        return found.end() if found else None

    def close() -> None:
        nonlocal linked
        text = " ".join(html.unescape("".join(held)).split())
        if text and not stack[-1].unseen:
            blocks.append(Block(text, linked, stack[-1]))
        held.clear()
        linked = 0

    while True:
        m = TOKEN.search(page, at)
        run = page[at : m.start() if m else len(page)]
        if run and not veil:
            held.append(run)
            if anchors:
                linked += len(run.strip())
        if not m:
            break
        at = m.end()
        name = (m[2] or "").lower()
        if not name:
            continue
        if veil and name == veil[0] and not m[3].endswith("/"):
            veil[1] += -1 if m[1] else 1
            if not veil[1]:
                veil.clear()
                if name != "a":
                    continue
        if m[1]:
            if name == "a":
                anchors = max(0, anchors - 1)
            if name not in INLINE:
                close()
                if open_tags[name]:
                    while stack[-1].tag != name:
                        pop()
                    pop()
                    anchors = 0
                    if veil and len(stack) < veil[2]:
                        veil.clear()
            continue
        if name in RAW and name != "head":
            if not m[3].endswith("/"):
                at = end_of(name, rf"</{re.escape(name)}\b[^>]*(?:>|\Z)") or len(page)
            held.append(" ")
            continue
        if name in INLINE:
            if name == "a":
                anchors += 1
            elif name == "br":
                held.append(" ")
            if not veil and m[3] and name not in VOID and not m[3].endswith("/") and unseen(attributes_of(m[3])):
                veil[:] = [name, 1, len(stack)]
            continue
        close()
        if name in VOID or name == "head":
            continue
        closes = CLOSED_BY.get(name)
        if closes and any(e.tag in closes for e in stack[-3:]):
            while stack[-1].tag not in closes:
                pop()
            pop()
        elif stack[-1].tag == "p" or stack[-1].tag in HEADINGS:
            pop()
        anchors = 0
        if name not in ("html", "body") or m[3].strip():
            if not m[3].endswith("/"):
                stack.append(Element(name, stack[-1], m[3]))
                open_tags[name] += 1
    close()
    return blocks


def log_odds(b: Block) -> float:
    e, n = b.element, len(b.text.split())
    heading = e.tag in HEADINGS and e.content
    w = WEIGHTS
    score = w["bias"] + w["log_words"] * math.log1p(n) + w["links"] * min(1.0, b.links / max(1, len(b.text)))
    score += w["content"] * e.content + w["against"] * e.against + w["doubtful"] * e.doubtful + w["prose"] * (e.tag in PROSE or e.up is None) + w["sentence"] * bool(SENTENCE.search(b.text)) + w["marks"] * bool(MARKS.search(b.text)) * (n < 30)
    return score + w["header"] * (e.header and not heading) + w["class_for"] * e.likely


def apart(a: Element, b: Element) -> int:
    """Edges between two elements in the tree, FAR at most."""
    steps = 0
    while a is not b and steps < FAR:
        if a.depth >= b.depth:
            a = a.up
        else:
            b = b.up
        steps += 1
    return steps


def neighbours(blocks: list[Block], odds: list[float]) -> list[dict[int, float]]:
    """Smoothness edges: of each block its neighbours and capacities. They are weaker between blocks that the classifier tells well apart."""
    near: list[dict[int, float]] = [{} for _ in blocks]
    last: dict[int, int] = {}

    def join(i: int, j: int, strength: float) -> None:
        steps = apart(blocks[i].element, blocks[j].element)
        if steps >= FAR:
            return
        strength *= math.exp(-DECAY * steps - CONTRAST * abs(odds[i] - odds[j]))
        near[i][j] = near[i].get(j, 0.0) + strength
        near[j][i] = near[j].get(i, 0.0) + strength

    for j, b in enumerate(blocks):
        if j:
            join(j - 1, j, FOLLOWING)
        parent = id(b.element.up or b.element)
        if parent in last:
            join(last[parent], j, SIBLING)
        last[parent] = j
    return near


def minimum_cut(gain: list[float], near: list[dict[int, float]]) -> list[bool]:
    """Which nodes are on the source side. gain: capacity from the source less that to the sink; near: symmetric capacities."""
    gain, label = list(gain), [None] * len(gain)
    weight = [sum(x.values()) for x in near]
    ready = deque(i for i in range(len(gain)) if abs(gain[i]) >= weight[i])
    while ready:
        i = ready.popleft()
        if label[i] is not None:
            continue
        label[i] = gain[i] > 0
        for j, c in near[i].items():
            if label[j] is None:
                gain[j] += c if label[i] else -c
                weight[j] -= c
                if abs(gain[j]) >= weight[j] - 1e-12:
                    ready.append(j)
    for i in range(len(gain)):
        if label[i] is None:
            group, wait = [i], [i]
            label[i] = False
            while wait:
                for j in near[wait.pop()]:
                    if label[j] is None:
                        label[j] = False
                        group.append(j)
                        wait.append(j)
            for j in source_side(group, gain, near):
                label[j] = True
    return label


def source_side(group: list[int], gain: list[float], near: list[dict[int, float]]) -> set[int]:
    """The source side of a maximum flow over the nodes of a group (shortest augmenting paths)."""
    inside = set(group)
    flow = {i: {j: c for j, c in near[i].items() if j in inside} for i in group}
    supply = {i: max(0.0, gain[i]) for i in group}
    demand = {i: max(0.0, -gain[i]) for i in group}
    while True:
        came: dict[int, int | None] = {i: None for i in group if supply[i] > 1e-12}
        wait, goal = deque(came), None
        while wait:
            i = wait.popleft()
            if demand[i] > 1e-12:
                goal = i
                break
            for j, c in flow[i].items():
                if c > 1e-12 and j not in came:
                    came[j] = i
                    wait.append(j)
        if goal is None:
            return set(came)
        path = [goal]
        while (previous := came[path[-1]]) is not None:
            path.append(previous)
        path.reverse()
        most = min([supply[path[0]], demand[goal], *(flow[a][b] for a, b in zip(path, path[1:], strict=False))])
        supply[path[0]] -= most
        demand[goal] -= most
        for a, b in zip(path, path[1:], strict=False):
            flow[a][b] -= most
            flow[b][a] += most


def main_text(page: str | None) -> str:
    """The main text of a page: its content blocks, joined by a line feed."""
    blocks = blocks_of(page) if page else []
    odds = [log_odds(b) for b in blocks]
    kept = minimum_cut(odds, neighbours(blocks, odds))
    return "\n".join(b.text for b, keep in zip(blocks, kept, strict=True) if keep)


def extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [main_text(x.as_py()) for x in batch.column("html")]
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every row of pages."""
    rows = pages.select(pages["page_id"].cast("long").alias("page_id"), pages["url"], pages["html"])
    return rows.mapInArrow(extracted, "page_id long, url string, text string, n_chars long")
