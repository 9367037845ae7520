"""Main text of web pages by minimum-cut labelling of their blocks."""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass
from html import unescape

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Pages that the block classifier is fitted on, at most: those with the smallest md5 of their page_id; and the bytes
#: of their html, in that order, at most. Both bounds hold for the fit alone.
SAMPLE_PAGES, SAMPLE_BYTES = 600, 16 << 20
#: Cost of a boundary between an element and what is directly in it, between neighbouring blocks of one element, and
#: the largest cost of a block's label by its text: a boundary costs more, so that text decides where elements say
#: nothing, and then for all that is in one of them.
PULL, CHAIN, TEXT = 2.0, 0.5, 1.0
#: An element with more than this share of a page's text is a frame around the page.
FRAME = 0.9

# Elements of HTML by what they do here.
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
LIKE = {"li": "li", "dt": "dt dd", "dd": "dt dd", "tr": "tr td th", "td": "td th", "th": "td th", "option": "option"}
BOILERPLATE = frozenset("nav footer aside menu dialog".split())
CONTROLS = frozenset("form button select noscript template svg object label fieldset option".split())
CONTENT = frozenset("article main".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
# Words in class, id and role that name a part of a page, and words that say what it has or lacks.
BOILERPLATE_WORDS = frozenset("ad ads adv advert advertisement advertising banner breadcrumb breadcrumbs byline comment comments consent contentinfo cookie cookies copyright dialog disqus footer gdpr header login menu menubar modal nav navbar navigation newsletter notice notices overlay pager pagination popup promo promoted promotion recommended related reply replies search share sharing sidebar signup social sponsor sponsored subscribe tags toolbar widget widgets".split())
CONTENT_WORDS = frozenset("article articlebody content entry main post story".split())
HAVING_WORDS = frozenset("has have hide is no not open show with without".split())

NAME = re.compile(r"[a-zA-Z][^\s/>]*")
NEXT = re.compile(r"[>=]")
VALUE = re.compile(r"\s*([\"']?)")
ATTRIBUTE = re.compile(r"""(?<![^\s"'/])(class|id|role|style|hidden|aria-hidden)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
WORDS = re.compile(r"[a-z]+")
ENDS = {name: re.compile(rf"</{name}(?=[\s/>]|\Z)", re.I) for name in RAW}


@dataclass
class Element:
    name: str
    parent: int
    depth: int
    said: tuple[float, ...]  # what its own name and attributes say, see EVIDENCE


@dataclass
class Block:
    text: str
    linked: int  # characters inside links
    element: int  # the innermost block element around it
    shared: int  # depth of the innermost element that holds this block and the one before
    after: int  # the last element that began before its end


#: What an element can say: content by name, by class; boilerplate by name, by class; a form or control. And the
#: weight of that for each block inside; the last is for what is outside of all content of a page that has some.
NOTHING = (0.0,) * 5
SAYS, OUTSIDE = (3.0, 2.5, -4.0, -5.0, -4.0), -3.0


def says(name: str, attributes: str) -> tuple[float, ...]:
    """What an element says of its texts by its own name and attributes."""
    content, named, boiler, worded, control = float(name in CONTENT), 0.0, float(name in BOILERPLATE or name == "header"), 0.0, float(name in CONTROLS)
    if attributes and name not in ("html", "body"):
        for key, value in ATTRIBUTE.findall(attributes):
            key, value = key.lower(), value.strip("\"'").lower()
            if key == "hidden" or (key == "aria-hidden" and value == "true") or (key == "style" and HIDDEN.search(value)):
                worded = 2.0
            if key in ("class", "id", "role"):
                for token in value.split():
                    words = WORDS.findall(token)
                    if not words or words[0] in HAVING_WORDS:
                        continue
                    if not BOILERPLATE_WORDS.isdisjoint(words):
                        worded = max(worded, float(name not in HEADINGS))
                    elif not CONTENT_WORDS.isdisjoint(words):
                        named = 1.0
    if worded:
        named = 0.0
    return (content, named, boiler, worded, control) if content or named or boiler or worded or control else NOTHING


def tokens(html: str):
    """(text, closing, name, attributes) of a page from left to right: a stretch of text, or a tag with its name in
    lower case. Comments, declarations, scripts and the like are passed over; a tag cut off at the end is dropped.
    Each character is read once: a quote opens a value only after "=", and only if it is closed later."""
    at, n, closed = 0, len(html), {"'": True, '"': True}
    while at < n:
        opened = html.find("<", at)
        if opened < 0:
            yield html[at:], False, None, ""
            return
        after = html[opened + 1 : opened + 2]
        if after == "/":
            name = NAME.match(html, opened + 2)
        else:
            name = NAME.match(html, opened + 1)
        if name is None and after not in ("!", "?", "/"):
            yield html[at : opened + 1], False, None, ""
            at = opened + 1
            continue
        if opened > at:
            yield html[at:opened], False, None, ""
        if name is None:
            comment = html.startswith("<!--", opened)
            end = html.find("-->" if comment else ">", opened + 2)
            if end < 0:
                return
            at = end + (3 if comment else 1)
            continue
        end = name.end()
        while (m := NEXT.search(html, end)) is not None and m[0] == "=":
            value = VALUE.match(html, m.end())
            end = value.end()
            if (quote := value[1]) and closed[quote]:
                if (stop := html.find(quote, end)) < 0:
                    closed[quote] = False
                else:
                    end = stop + 1
        if m is None:
            return
        at, tag = m.end(), name[0].lower()
        yield "", after == "/", tag, html[name.end() : m.start()]
        if after != "/" and tag in RAW:
            found = ENDS[tag].search(html, at)
            if found is None:
                return
            at = found.start()


def blocks_of(html: str) -> tuple[list[Block], list[Element]]:
    """The page's texts in page order, one for each stretch between the borders of block elements, with character
    references decoded and white space made single; and the elements, outer before inner, the first one the page."""
    elements, out = [Element("", -1, 0, NOTHING)], []
    stack, opened = [0], Counter()
    parts: list[str] = []
    linked, in_link, low = 0, False, 0

    def close() -> None:
        nonlocal linked, low
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                out.append(Block(text, min(linked, len(text)), stack[-1], min(low, len(stack) - 1), len(elements) - 1))
                low = len(stack) - 1
            parts.clear()
        linked = 0

    def enter(name: str, said: tuple[float, ...]) -> None:
        elements.append(Element(name, stack[-1], len(stack), said))
        stack.append(len(elements) - 1)
        opened[name] += 1

    def leave() -> None:
        nonlocal low
        opened[elements[stack.pop()].name] -= 1
        low = min(low, len(stack) - 1)

    for raw, closing, name, attributes in tokens(html):
        if name is None:
            text = unescape(raw) if "&" in raw else raw
            parts.append(text)
            if in_link:
                linked += len(text.strip())
        elif not closing:
            if name in RAW:
                continue
            if name in ("br", "hr"):
                parts.append(" ")
            if name in VOID:
                if name == "hr":
                    close()
                continue
            if name == "a":
                in_link = True
            if name in BLOCKS or name in CONTROLS:
                close()
                if name in BLOCKS:
                    while elements[stack[-1]].name == "p":
                        leave()
                like = LIKE.get(name, "").split()
                while elements[stack[-1]].name in like and (name != "tr" or opened["tr"]):
                    done = elements[stack[-1]].name == name
                    leave()
                    if done:
                        break
                enter(name, says(name, attributes))
            elif attributes and (said := says(name, attributes))[3]:  # an inline element apart from the text around it
                close()
                enter(name, said)
        else:
            if name == "a":
                in_link = False
            block = name in BLOCKS or name in CONTROLS
            if block:
                close()
            if opened[name]:
                k = len(stack) - 1
                while elements[stack[k]].name != name and (block or elements[stack[k]].name not in BLOCKS):
                    k -= 1
                if elements[stack[k]].name == name:
                    close()
                    while len(stack) > k:
                        leave()
    close()
    return out, elements


def element_costs(blocks: list[Block], elements: list[Element]) -> tuple[list[float], list[int], list[bool]]:
    """What each element says of itself (above 0: content) for all blocks inside, the number of those, and whether it
    is a content element or in one.

    A frame, an element with a content element or nearly all the page's text inside, says nothing by its class. A
    header inside of content isn't the page's. Where a page has content elements, the largest elements outside of them
    that aren't frames are evidence against themselves."""
    size, count, holds = [0] * len(elements), [0] * len(elements), [False] * len(elements)
    for b in blocks:
        size[b.element] += len(b.text)
        count[b.element] += 1
    for k in range(len(elements) - 1, 0, -1):
        up = elements[k].parent
        size[up] += size[k]
        count[up] += count[k]
        if holds[k] or (elements[k].said[0] and not elements[k].said[3] and size[k]):
            holds[up] = True
    costs, inside, outside = [0.0] * len(elements), [False] * len(elements), [False] * len(elements)
    for k, e in enumerate(elements[1:], 1):
        inside[k], outside[k] = inside[e.parent], outside[e.parent]
        if e.said is not NOTHING:
            content, named, boiler, worded, control = e.said
            if worded < 2 and (holds[k] or size[k] > FRAME * size[0]):
                worded = 0.0
            if (e.name == "header" and inside[k]) or size[k] > FRAME * size[0]:
                boiler = control = 0.0
            inside[k] |= bool((content or named) and not worded)
            costs[k] = sum(x * w for x, w in zip((content, named, boiler, worded, control), SAYS)) * count[k]
        if holds[0] and not (inside[k] or outside[k] or holds[k]):
            outside[k] = True
            costs[k] += OUTSIDE * count[k]
    return costs, count, inside


def features(blocks: list[Block]) -> np.ndarray:
    """What a block's text is like, whatever its elements are called."""
    rows = []
    for b in blocks:
        words = b.text.count(" ") + 1
        stops = sum(b.text.count(x) for x in ".,;!?")
        rows.append((1.0, min(np.log1p(words), 4.0), min(1.0, b.linked / len(b.text)), min(1.0, stops / words), b.text[-1] in ".!?", words < 6))
    return np.array(rows, np.float64).reshape(len(blocks), 6)


#: Weights of the features to begin with.
PLAIN_WEIGHTS = np.array([-1.6, 0.8, -4.0, 1.0, 1.0, -0.5])


@dataclass
class Network:
    """A tree of elements and, as its leaves, blocks: the nodes in page order, an element before what is in it."""

    parents: list[int]  # of the first, the page, -1
    costs: list[float]  # terminal capacities: what the label False costs if above 0, the label True if below
    pulls: list[float]  # of the edge to the parent
    chain: list[float]  # of a leaf's edge to the leaf before it; -1 for elements
    leaves: list[int]


def network(blocks: list[Block], elements: list[Element], said: list[float]) -> Network:
    """Terminal capacities are what the elements and the blocks' texts say. Smoothness edges join each element and each
    block to the element it is in, but not to a frame of differing parts, and each block to the next one, the weaker
    the farther apart in the tree they are. Inside of content an element holds to its parent with all its blocks. An
    element of one block that says nothing is one node with it."""
    costs, count, inside = element_costs(blocks, elements)
    mixed = [False] * len(elements)  # elements with a content element or one outside of all content in them
    for k in range(len(elements) - 1, 0, -1):
        if costs[k] and count[k]:
            up = elements[k].parent
            mixed[up] = mixed[up] or not costs[up]
        if mixed[k] and not costs[k]:
            mixed[elements[k].parent] = True
    net, node, at = Network([-1], [0.0], [0.0], [-1.0], []), {0: 0}, 0

    def add(parent: int, cost: float, pull: float, chain: float) -> None:
        net.parents.append(parent)
        net.costs.append(cost)
        net.pulls.append(pull)
        net.chain.append(chain)

    for k, e in enumerate(elements):
        if k and count[k]:
            up, pull = node[e.parent], 0.0 if mixed[e.parent] and not costs[e.parent] else PULL * (count[k] if inside[e.parent] else 1)
            if count[k] > 1 or costs[k]:
                add(up, costs[k], pull, -1.0)
                node[k] = len(net.parents) - 1
            else:
                node[k] = up
        while at < len(blocks) and blocks[at].after == k:
            b = blocks[at]
            far = max(elements[b.element].depth, elements[blocks[at - 1].element].depth) - b.shared if at else 0
            pull = 0.0 if node[b.element] == 0 or (mixed[b.element] and not costs[b.element]) else PULL
            add(node[b.element], min(max(said[at], -TEXT), TEXT), pull, CHAIN / (1.0 + far) if at else 0.0)
            net.leaves.append(len(net.parents) - 1)
            at += 1
    return net


def minimum_cut(net: Network) -> list[bool]:
    """The labels of all nodes with the smallest sum of costs: terminal capacities on the wrong side, and edges whose
    ends differ. That is a minimum cut between two terminals, as large as a maximum flow.

    Found in linear time, as the edges are a tree and a path along its leaves: a part of the tree touches the rest in
    its top, its first and its last leaf only, so it is reduced to what it costs for each of their eight labellings.
    Nodes are taken from the last to the first and put before the parts that their parents have already."""
    pairs = ((0, 0), (0, 1), (1, 0), (1, 1))
    pays = [(max(c, 0.0), max(-c, 0.0)) for c in net.costs]
    parts: list = [None] * len(pays)  # cost by 4 * own label + 2 * first leaf's + last leaf's, and the first leaf
    steps: list = [None] * len(pays)
    for k in range(len(pays) - 1, 0, -1):
        p, q = pays[k]
        w, up, rest = net.pulls[k], net.parents[k], parts[net.parents[k]]
        if net.chain[k] >= 0:  # a leaf: first and last at once
            mine, own, first = [p, np.inf, np.inf, q + w, p + w, np.inf, np.inf, q], None, k
        else:
            part, first = parts[k]
            parts[k] = None
            mine, own = [], []
            for x in (0, 1):
                for f, m in pairs:
                    a, b = part[2 * f + m] + p + (w if x else 0.0), part[4 + 2 * f + m] + q + (0.0 if x else w)
                    own.append(b < a)
                    mine.append(b if b < a else a)
        if rest is None:
            parts[up], steps[k] = (mine, first), (own, None, None)
            continue
        after, chained = rest[0], net.chain[rest[1]]
        onward, firsts = [], []
        for x in (0, 4):
            for m, last in pairs:
                a, b = after[x + last] + (chained if m else 0.0), after[x + 2 + last] + (0.0 if m else chained)
                firsts.append(b < a)
                onward.append(b if b < a else a)
        joined, lasts = [], []
        for x in (0, 4):
            for f, last in pairs:
                a, b = mine[x + 2 * f] + onward[x + last], mine[x + 2 * f + 1] + onward[x + 2 + last]
                lasts.append(b < a)
                joined.append(b if b < a else a)
        parts[up], steps[k] = (joined, first), (own, lasts, firsts)
    if parts[0] is None:
        return [pays[0][1] < pays[0][0]]
    total = [c + pays[0][j // 4] for j, c in enumerate(parts[0][0])]
    best = min(range(8), key=total.__getitem__)
    labels, left = [False] * len(pays), [None] * len(pays)  # left: labels of the first and last leaf still to come
    labels[0], left[0] = best >= 4, (best >> 1 & 1, best & 1)
    for k in range(1, len(pays)):
        own, lasts, firsts = steps[k]
        up = net.parents[k]
        x, (f, last) = 4 * labels[up], left[up]
        m = last
        if lasts is not None:
            m = int(lasts[x + 2 * f + last])
            left[up] = (int(firsts[x + 2 * m + last]), last)
        labels[k] = bool(f) if own is None else bool(own[x + 2 * f + m])
        left[k] = (f, m)
    return labels


def label(blocks: list[Block], elements: list[Element], weights: np.ndarray, x: np.ndarray | None = None) -> tuple[list[bool], list[float]]:
    """Which blocks are content, and what each one's text says by itself: above 0 for content."""
    said = ((features(blocks) if x is None else x) @ weights).tolist()
    net = network(blocks, elements, said)
    labels = minimum_cut(net)
    return [labels[k] for k in net.leaves], said


def fit(pages: DataFrame, rows: int = SAMPLE_PAGES, size: int = SAMPLE_BYTES) -> np.ndarray:
    """Weights of a logistic classifier of blocks by their texts, learned from a bounded sample of pages: twice, from
    the labels that the cut gives with the weights so far."""
    drawn = pages.where("page_id is not null and html is not null").select("page_id").distinct()
    drawn = drawn.withColumn("place", F.md5(F.col("page_id").cast("string"))).orderBy("place", "page_id").limit(rows)
    one = pages.where("html is not null").select("page_id", "html").join(F.broadcast(drawn), "page_id").groupBy("page_id", "place").agg(F.min("html").alias("html"))
    total = F.sum(F.octet_length("html").cast("bigint")).over(Window.orderBy("place", "page_id").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    found = [blocks_of(r.html) for r in sorted(one.withColumn("total", total).where(F.col("total") <= size).select("page_id", "html").collect())]
    found = [(b, e, features(b)) for b, e in found if b]
    weights = PLAIN_WEIGHTS.copy()
    for _ in range(2 if found else 0):
        x = np.concatenate([f for _, _, f in found])
        y = np.concatenate([label(b, e, weights, f)[0] for b, e, f in found]).astype(np.float64)
        if y.min() == y.max():
            break
        w = PLAIN_WEIGHTS.copy()
        for _ in range(15):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.eye(len(w)), x.T @ (y - p) - (w - PLAIN_WEIGHTS))
            w = w + np.clip(step, -1, 1)
        weights = w
    return weights


def main_text(html: str | None, weights: np.ndarray = PLAIN_WEIGHTS) -> str:
    blocks, elements = blocks_of(html or "")
    if not blocks:
        return ""
    return " ".join(b.text for b, k in zip(blocks, label(blocks, elements, weights)[0]) if k)


def extract(pages: DataFrame, weights: np.ndarray) -> DataFrame:
    """pages with `text`, the main text of the whole html, and `n_chars`, its code points; columns of these names
    are replaced, all others and all rows stay, repeated ones too. A null or empty html, and one without main text,
    gives an empty text; an empty table stays empty. Unclosed elements end where HTML's rules or the page end them; a
    tag cut off at the end is dropped. Pages of any length are read once, in time that grows with their length."""
    shared = pages.sparkSession.sparkContext.broadcast(weights)

    @F.pandas_udf("string")
    def of(htmls: pd.Series) -> pd.Series:
        return pd.Series([main_text(h, shared.value) for h in htmls], dtype="object")

    return pages.drop("text", "n_chars").withColumn("text", of("html")).withColumn("n_chars", F.length("text").cast("bigint"))
