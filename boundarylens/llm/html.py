"""Main text of web pages by wrapper induction.

Pages of one host and layout (its landmark elements with their names) form a group with one reference
page, the one with the smallest hash. All pages of the group are aligned with it by simple tree matching:
the largest common top-down tree that keeps the order of siblings. The aligned pages vote on each node
of the reference: how often it has the same text, and how much text that varies and is no link stands
below it. From these sums a wrapper is read off:

* the content slot: from the root downward to the child that holds most of the varying text, until no
  child does, an article is reached or an element with a heading of its own;
* the template: nodes in the slot with the same text on most pages.

A page's text is what stands in the node that meets the slot, without the template. Tags and names are
a prior: elements that say themselves what they are (navigation, footer, form, script, advert, comments
...) are left out, an article needs a smaller share to be taken as slot, and pages without a wrapper (few
pages of their kind) are bounded by their article or main element alone. Pages that have most of their
text in common with the reference are copies of it and do not vote on what is constant.

The votes are summed in the tasks before they are shuffled, so a host with a third of all pages costs no
more than any other. References travel to the pages by broadcast while their measured size allows it;
beyond that only those of the largest groups do, and the rest by a shuffled join.
"""

from __future__ import annotations

import json
import math
import re
from collections import Counter
from collections.abc import Callable, Iterator
from functools import lru_cache
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boundarylens.llm.common import blobs, durable, python_ready

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
LEFT_OUT = frozenset(
    "head title script style noscript template nav footer aside form button select option textarea input iframe object "
    "embed svg canvas audio video map menu dialog datalist fieldset legend".split()
)
#: Elements among them, and headers, that some pages wrap around their content; the others never hold any.
WRAPPERS = frozenset("nav footer aside form header menu fieldset dialog".split())
#: Names of elements that are no content: a whole class, id or role made of these words, perhaps after one of SITE.
NOISE = frozenset(
    "nav navbar navigation menu menubar header masthead topbar footer bottombar sidebar aside complementary ad ads advert adverts advertisement "
    "sponsor sponsored promo promotion banner cookie cookies consent gdpr notice alert toast popup modal overlay newsletter subscribe "
    "subscription signup login share sharing social related recommended comment comments reply replies respond disqus breadcrumb "
    "breadcrumbs pagination pager search form contentinfo widget toolbar skip".split()
)
SITE = frozenset(("site", "global"))
NAMED, TAGGED, HARD = 1, 2, 3
_PLAIN_START = re.compile(r'<([a-zA-Z][a-zA-Z0-9]*)((?:\s+[a-zA-Z][a-zA-Z-]*="[^"<>&]*")*)>')
_PLAIN_ATTRIBUTE, _PLAIN_END = re.compile(r'([a-zA-Z][a-zA-Z-]*)="([^"]*)"'), re.compile("</([a-zA-Z][a-zA-Z0-9]*)>")
CLOSED_BY = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
SCOPE = frozenset("html body div article section main aside nav header footer table ul ol dl td th li blockquote form fieldset figure".split())
HEADINGS = frozenset(("h1", "h2", "h3"))
BROADCAST_BYTES = 48 * 2**20
#: Landmarks of a layout, as they stand in the html, and what of them does not count: numbers and other attributes.
LANDMARK = r"(?i)<(?:main|article|aside|nav|header|footer|form|section|div)(?=[\s>])[^<>]*>"
NOT_OF_LAYOUT = r"""(?i)[0-9]+|\s(?!class|id|role)[a-z-]+\s*=\s*(?:"[^"]*"|'[^']*'|[^\s>]+)"""


class Node:
    __slots__ = ("tag", "noise", "children", "parts", "spared", "up")

    def __init__(self, tag: str, noise: int = 0, up: Node | None = None):
        self.tag, self.noise, self.children, self.parts, self.spared, self.up = tag, noise, [], [], False, up


@lru_cache(maxsize=2**16)
def _is_noise(name: str) -> bool:
    words = [w for w in re.split(r"[^a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", name).lower()) if w]
    if len(words) > 1 and words[0] in SITE:
        del words[0]
    # Modifiers such as has-sidebar or no-banner, and parts such as entry-header, have other words, too.
    return bool(words) and NOISE.issuperset(words)


class TreeBuilder(HTMLParser):
    """A forgiving tree: paragraphs and list items close themselves, stray end tags are passed over."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("#")
        self.stack = [self.root]
        self.open: Counter[str] = Counter()
        self.forms = False

    def updatepos(self, i: int, j: int) -> int:
        """Line numbers are not asked for."""
        return j

    def parse_starttag(self, i: int) -> int:
        """Plain tags, nearly all of a page, by one pattern; all others as they were."""
        m = _PLAIN_START.match(self.rawdata, i)
        if m is None:
            return super().parse_starttag(i)
        self.lasttag = tag = m[1].lower()
        self.handle_starttag(tag, [(k.lower(), v) for k, v in _PLAIN_ATTRIBUTE.findall(m[2])] if m[2] else [])
        if tag in self.CDATA_CONTENT_ELEMENTS:
            self.set_cdata_mode(tag)
        return m.end()

    def parse_endtag(self, i: int) -> int:
        m = _PLAIN_END.match(self.rawdata, i) if self.cdata_elem is None else None
        if m is None:
            return super().parse_endtag(i)
        self.handle_endtag(m[1].lower())
        return m.end()

    def _noise(self, tag: str, attrs: list) -> int:
        if tag in LEFT_OUT and tag not in WRAPPERS:
            return HARD
        named = tag == "form"
        self.forms = self.forms or named
        for k, v in attrs:
            if k in ("hidden",) or k == "aria-hidden" and v == "true" or k == "style" and v and re.search(r"display\s*:\s*none", v):
                return HARD
            # A name on a piece of running text tells what the piece is, not that it is none.
            if k in ("class", "id", "role") and v and tag not in INLINE and tag not in ("html", "body", "article", "main"):
                named = named or any(map(_is_noise, v.split()))
        if tag in LEFT_OUT and tag != "form" or tag == "header" and not self.open["article"]:
            return TAGGED
        return NAMED if named else 0

    def _cut(self, size: int) -> None:
        """Close all but so many of the open elements."""
        while len(self.stack) > size:
            self.open[self.stack.pop().tag] -= 1

    def _close(self, tags: tuple[str, ...]) -> None:
        if not any(self.open[t] for t in tags):
            return
        for i in range(len(self.stack) - 1, 0, -1):
            if self.stack[i].tag in tags:
                self._cut(i)
                return
            if self.stack[i].tag in SCOPE and self.stack[i].tag not in tags:
                return

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in CLOSED_BY:
            self._close(CLOSED_BY[tag])
        elif tag not in INLINE and tag not in VOID:
            self._close(("p",))
        top = self.stack[-1]
        node = Node(tag, self._noise(tag, attrs), top)
        top.children.append(node)
        top.parts.append(node)
        if tag not in VOID:
            self.stack.append(node)
            self.open[tag] += 1

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID and self.stack[-1].tag == tag:
            self._cut(len(self.stack) - 1)

    def handle_endtag(self, tag: str) -> None:
        if self.open[tag]:
            for i in range(len(self.stack) - 1, 0, -1):
                if self.stack[i].tag == tag:
                    self._cut(i)
                    return

    def handle_data(self, data: str) -> None:
        self.stack[-1].parts.append(data)


def parse(html: str) -> Node:
    builder = TreeBuilder()
    builder.feed(html)
    builder.close()
    _spare(builder.root, builder.forms)
    return builder.root


def _outermost(root: Node, wanted: tuple[str, ...], through: int = 0) -> list[Node]:
    """Outermost elements of these tags, looking into noise of at most that kind."""
    found, todo = [], [root]
    while todo:
        n = todo.pop()
        if n.noise > through:
            continue
        if n.tag in wanted:
            found.append(n)
        else:
            todo += reversed(n.children)
    return found


def _size(nodes: list[Node], through: int = 0) -> int:
    """Characters of text other than space, looking into noise of at most that kind below the nodes."""
    total, todo = 0, [p for n in nodes for p in n.parts]
    while todo:
        p = todo.pop()
        if isinstance(p, str):
            total += len("".join(p.split()))
        elif p.noise <= through:
            todo += p.parts
    return total


def _spare(root: Node, forms: bool) -> None:
    """An element that holds the only articles of a page, or most of its text, is no noise, whatever it is called; nor is a form with most of an article's text."""
    articles = _outermost(root, ("article", "main"))
    if articles:
        for article in articles if forms else ():
            _keep_most(article, lambda n: n.tag == "form")
        return
    inside = _outermost(root, ("article", "main"), TAGGED)
    if inside:
        for node in inside:
            node.spared = True
            above = node.up
            while above is not None:
                above.noise = 0
                above = above.up
        return
    _keep_most(root, lambda n: True)


def _keep_most(root: Node, of: Callable[[Node], bool]) -> None:
    """Named elements of a kind with far more text than all that is no noise below root are none."""
    left, todo = None, [root]
    while todo:
        n = todo.pop()
        if n.noise == NAMED and of(n):
            left = _size([root]) if left is None else left
            if _size([n], NAMED) > 4 * left:
                n.noise, left = 0, None
        if not n.noise:
            todo += n.children


class Tree:
    """The block elements of a page in document order; text counts for the block it stands in, that of left-out elements for none."""

    def __init__(self, root: Node):
        self.tags, self.kids, self.nodes, self.up, self.noisy = [root.tag], [[]], [root], [-1], [root.noise > 0]
        own: list[list[str]] = [[]]
        self.links = [0]
        todo: list = [(p, 0, False) for p in reversed(root.parts)]
        while todo:
            part, block, link = todo.pop()
            if isinstance(part, str):
                own[block].append(part)
                if link:
                    self.links[block] += len("".join(part.split()))
            elif part.noise == HARD or part.tag in VOID:
                own[block].append(" ")
            elif part.tag in INLINE:
                todo += [(p, block, link or part.tag == "a") for p in reversed(part.parts)]
            else:
                own[block].append(" ")
                k = len(self.tags)
                self.kids[block].append(k)
                self.tags.append(part.tag)
                self.kids.append([])
                self.nodes.append(part)
                self.up.append(block)
                self.noisy.append(part.noise > 0 or self.noisy[block])
                own.append([])
                self.links.append(0)
                todo += [(p, k, link) for p in reversed(part.parts)]
        texts = [" ".join("".join(x).split()) for x in own]
        self.sizes = [len(t.replace(" ", "")) for t in texts]
        self.hashes = [xxhash.xxh32_intdigest(t) for t in texts]

    def dump(self) -> str:
        """Tag, hash of own text and number of children of every block, flat."""
        return json.dumps([self.tags, self.hashes, [len(k) for k in self.kids]], separators=(",", ":"))


class Reference:
    """A tree read back from its dump."""

    def __init__(self, dump: str):
        self.tags, self.hashes, counts = json.loads(dump)
        self.kids: list[list[int]] = [[] for _ in self.tags]
        open_: list[list[int]] = []  # [block, children still to come]
        for i, n in enumerate(counts):
            while open_ and not open_[-1][1]:
                open_.pop()
            if open_:
                self.kids[open_[-1][0]].append(i)
                open_[-1][1] -= 1
            open_.append([i, n])


class Aligner:
    """Simple tree matching; exact for trees of any depth and any number of siblings.

    Siblings are paired so that they have most nodes in common, and equal text counts as one node more: a
    paragraph put in between must not shift all that follow it.
    Trees of equal shape share a number, and the size of a largest common tree of two shapes is kept. The
    recurrence over siblings runs row by row; of long ones only every so many rows are kept, and those
    between are made again on the way back.
    """

    def __init__(self):
        self.numbers: dict[tuple, int] = {}
        self.shapes: list[tuple[str, tuple[int, ...], int]] = []
        self.common: dict[tuple[int, int], int] = {}

    def number(self, tree: Tree | Reference) -> list[int]:
        out = [0] * len(tree.tags)
        for i in range(len(out) - 1, -1, -1):
            key = (tree.tags[i], tuple([out[k] for k in tree.kids[i]]))
            n = self.numbers.get(key)
            if n is None:
                n = self.numbers[key] = len(self.shapes)
                self.shapes.append((*key, 1 + sum(self.shapes[k][2] for k in key[1])))
            out[i] = n
        return out

    def size(self, a: int, b: int) -> int:
        """Nodes of a largest common tree of two shapes; 0 if their roots differ."""
        todo, known = [(a, b)], self.common
        while todo:
            a, b = pair = todo[-1]
            if pair in known:
                todo.pop()
                continue
            (tag, kids, n), (tag2, kids2, _) = self.shapes[a], self.shapes[b]
            if tag != tag2 or a == b or not kids or not kids2:
                known[pair] = 0 if tag != tag2 else n if a == b else 1
                continue
            need = [(x, y) for x in set(kids) for y in set(kids2) if (x, y) not in known]
            if need:
                todo += need
                continue
            known[pair] = 1 + int(self._rows(self._weights(kids, kids2, None, None), len(kids), len(kids2), False)[-1][-1])
        return known[a, b]

    def _weights(self, a: tuple | list, b: tuple | list, texts_a: list[int] | None, texts_b: list[int] | None):
        """Row i: what pairing a[i] with each of b is worth: the nodes in common, and one more for equal text where texts count."""
        if len(a) * len(b) <= 256:
            if texts_a is None:
                return lambda i: [self.common[a[i], y] for y in b]
            return lambda i: [w + (t == texts_a[i]) if (w := self.common[a[i], y]) else 0 for y, t in zip(b, texts_b, strict=True)]
        kinds_b, at_b = np.unique(np.array(b), return_inverse=True)
        table = {x: np.array([self.common[x, y] for y in kinds_b.tolist()], np.int64)[at_b] for x in set(a)}
        if texts_a is None:
            return lambda i: table[a[i]]
        hashes = np.array(texts_b, np.int64)
        return lambda i: table[a[i]] + ((table[a[i]] > 0) & (hashes == texts_a[i]))

    @staticmethod
    def _next(above, weights):
        if isinstance(weights, list):
            row = [0]
            for j, w in enumerate(weights):
                best = max(row[j], above[j + 1])
                row.append(max(best, above[j] + w) if w else best)
            return row
        above = np.asarray(above)
        row = np.zeros(len(above), np.int64)
        np.maximum.accumulate(np.maximum(above[1:], np.where(weights > 0, above[:-1] + weights, 0)), out=row[1:])
        return row

    def _rows(self, weights, n: int, m: int, all_: bool) -> list:
        """The last row, or all of them."""
        rows = [[0] * (m + 1)]
        for i in range(n):
            row = self._next(rows[-1], weights(i))
            if all_:
                rows.append(row)
            else:
                rows[0] = row
        return rows

    def _paired(self, a: list[int], b: list[int], texts_a: list[int], texts_b: list[int]) -> list[tuple[int, int]]:
        """Places of siblings that a best matching pairs."""
        out, n, m, first = [], len(a), len(b), 0
        # Equal trees with equal text at either end are worth as much as any partner can be.
        while first < min(n, m) and a[first] == b[first] and texts_a[first] == texts_b[first]:
            out.append((first, first))
            first += 1
        while min(n, m) > first and a[n - 1] == b[m - 1] and texts_a[n - 1] == texts_b[m - 1]:
            n, m = n - 1, m - 1
            out.append((n, m))
        a, b, texts_a, texts_b = a[first:n], b[first:m], texts_a[first:n], texts_b[first:m]
        n, m = len(a), len(b)
        if not n or not m:
            return out
        for x in set(a):
            for y in set(b):
                self.size(x, y)
        weights = self._weights(a, b, texts_a, texts_b)
        step = n if n * m <= 2**22 else math.isqrt(n) + 1
        kept, row = [], [0] * (m + 1)
        for i in range(n):
            if i % step == 0:
                kept.append(row)
            if step < n:
                row = self._next(row, weights(i))
        i, j = n, m
        while kept and j:
            at = (len(kept) - 1) * step
            rows = [kept.pop()]
            for k in range(at, i):
                rows.append(self._next(rows[-1], weights(k)))
            while i > at and j:
                here = rows[i - at]
                if here[j] == rows[i - at - 1][j]:
                    i -= 1
                elif here[j] == here[j - 1]:
                    j -= 1
                else:
                    i, j = i - 1, j - 1
                    out.append((first + i, first + j))
        return out

    def pairs(self, reference: Reference, page: Tree) -> list[tuple[int, int]]:
        """Blocks of the reference and the page that the best matching pairs, parents before children."""
        if reference.tags[0] != page.tags[0]:
            return []
        shapes_a, shapes_b = self.number(reference), self.number(page)
        out, todo = [], [(0, 0)]
        while todo:
            i, j = todo.pop()
            out.append((i, j))
            x, y = reference.kids[i], page.kids[j]
            if x and y:
                found = self._paired([shapes_a[k] for k in x], [shapes_b[k] for k in y], [reference.hashes[k] for k in x], [page.hashes[k] for k in y])
                todo += [(x[p], y[q]) for p, q in found]
        return out


def votes_of(reference: Reference, page: Tree, pairs: list[tuple[int, int]]) -> list[tuple[int, int, int, int]]:
    """(block of the reference, votes, equal, varying text below) of one page.

    A page with more than three quarters of its text in common with the reference is a copy and has no vote.
    """
    same = {j for i, j in pairs if page.sizes[j] and reference.hashes[i] == page.hashes[j]}
    told = [0 if page.noisy[j] else page.sizes[j] for j in range(len(page.tags))]
    voting = 4 * sum(told[j] for j in same) <= 3 * sum(told)
    below = [0 if j in same or page.noisy[j] else page.sizes[j] - page.links[j] for j in range(len(page.tags))]
    for j in range(len(below) - 1, 0, -1):
        below[page.up[j]] += below[j]
    return [(i, int(voting and page.sizes[j] > 0), int(voting and j in same), below[j]) for i, j in pairs]


class Wrapper:
    """What the votes on a reference tell: the block that is the content slot (None: no wrapper), and the constant blocks."""

    def __init__(self, dump: str, votes: list[dict], least: int, share: float):
        self.reference = Reference(dump)
        below = {v["node"]: v["below"] for v in votes}
        pages = max((v["aligned"] for v in votes), default=0)
        self.constant = {v["node"] for v in votes if v["votes"] >= least and v["equal"] >= share * v["votes"]}
        self.slot: int | None = None
        if pages >= least and below.get(0):
            tags, kids, at = self.reference.tags, self.reference.kids, 0
            while tags[at] != "article" and not (tags[at] not in ("#", "html", "body") and any(tags[k] in HEADINGS for k in kids[at])):
                holders = [k for k in kids[at] if kids[k] or tags[k] in ("article", "main")]
                best = max(holders, key=lambda k: below.get(k, 0), default=None)
                if best is None or below.get(best, 0) < (0.5 if tags[best] in ("article", "main") else 0.8) * below[at]:
                    break
                at = best
            self.slot = at


def _blocks(node: Node, gone: set[int], out: list[str]) -> None:
    """The text in page order: inline elements run on, block elements and line breaks part words. Of blocks in `gone` only the blocks within count."""
    todo: list = [(node, False)]
    while todo:
        n, mute = todo.pop()
        if isinstance(n, str):
            if not mute:
                out.append(n)
        elif not n.noise:
            if n.tag in INLINE:
                todo += [(p, mute) for p in reversed(n.parts)]
            else:
                out.append(" ")
                todo.append((" ", False))
                mute = id(n) in gone
                todo += [(p, mute) for p in reversed(n.parts)]


def _roots(root: Node) -> list[Node]:
    """Outermost article elements, else main elements, else the whole page.

    Those that only stand in spared elements may be teasers: they must have half of the page's text.
    """
    for wanted in ("article", "main"):
        found = _outermost(root, (wanted,))
        if found and not (all(n.spared for n in found) and 2 * _size(found) < _size([root])):
            return found
    return [root]


def main_text(html: str, wrapper: Wrapper | None = None, aligner: Aligner | None = None) -> str:
    root = parse(html)
    roots, gone = _roots(root), set()
    if wrapper is not None and wrapper.slot is not None:
        tree = Tree(root)
        met = dict((aligner or Aligner()).pairs(wrapper.reference, tree))
        if wrapper.slot in met:
            slot = [tree.nodes[met[wrapper.slot]]]
            inner = _outermost(slot[0], ("article", "main"))
            if inner and 2 * _size(inner) >= _size(slot):
                slot = inner
            # On a page of another kind the prior may hold far more than what meets the slot.
            if roots == [root] or 2 * _size(slot) >= _size(roots):
                roots = slot
        gone = {id(tree.nodes[j]) for i, j in met.items() if i in wrapper.constant and tree.sizes[j] and wrapper.reference.hashes[i] == tree.hashes[j]}
    out: list[str] = []
    for r in roots:
        _blocks(r, gone, out)
    text = " ".join("".join(out).split())
    if not text and wrapper is not None:
        return main_text(html)
    return text


def _hosted(pages: DataFrame, page_id: str, url: str, html: str) -> DataFrame:
    host = F.lower(F.regexp_extract(F.coalesce(F.col(url).cast("string"), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]+)", 1))
    marks = F.transform(F.regexp_extract_all(F.col("html"), F.lit(LANDMARK), F.lit(0)), lambda x: F.lower(F.regexp_replace(x, NOT_OF_LAYOUT, "")))
    named = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), F.col(html).cast("string").alias("html"), host.alias("host"))
    return named.withColumn("layout", F.coalesce(F.xxhash64(F.array_sort(F.array_distinct(marks))), F.lit(0)))


GROUP = ["host", "layout"]


def _references(pages: DataFrame) -> DataFrame:
    """host, layout, n (pages), skeleton of the page with the smallest hash; each task brings one candidate per group."""

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[tuple, tuple[int, bytes]] = {}
        count: Counter = Counter()
        for batch in batches:
            for host, layout, key, html in zip(*(batch.column(i).to_pylist() for i in range(3)), blobs(batch.column(3)), strict=True):
                group = (host, layout)
                count[group] += 1
                if group not in best or (key, html) < best[group]:
                    best[group] = (key, html)
        if best:
            rows = [(*g, count[g], k, Tree(parse(t.decode())).dump()) for g, (k, t) in best.items()]
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=[*GROUP, "n", "key", "skeleton"])

    python_ready(pages.sparkSession)
    some = pages.where("html IS NOT NULL AND host <> ''").select(*GROUP, F.xxhash64("page_id", "url"), "html")
    picked = some.mapInArrow(pick, "host string, layout long, n long, key long, skeleton string")
    return picked.groupBy(*GROUP).agg(F.sum("n").alias("n"), F.min_by("skeleton", F.struct("key", "skeleton")).alias("skeleton"))


def _with_reference(pages: DataFrame, references: DataFrame, nbytes: Column) -> DataFrame:
    """Pages with what is known of their group. Beyond the broadcast's bound the largest groups, a thousand at most, still travel that way."""
    size, n = references.agg(F.sum(nbytes), F.sum("n")).first()
    if (size or 0) <= BROADCAST_BYTES:
        return pages.join(F.broadcast(references), GROUP, "left")
    large = F.col("n") * 1000 >= n
    size = references.where(large).agg(F.sum(nbytes)).first()[0] or 0
    if size > BROADCAST_BYTES:
        return pages.join(references, GROUP, "left")
    few = F.broadcast(references.where(large))
    hot = pages.join(few, GROUP)
    return hot.unionByName(pages.join(few, GROUP, "left_anti").join(references.where(~large), GROUP, "left"))


def _votes(pages: DataFrame, references: DataFrame) -> DataFrame:
    """host, layout, node, aligned, votes, equal, below: sums over the pages of the group."""

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[tuple, Reference] = {}
        sums: dict[tuple, list[int]] = {}
        aligner = Aligner()
        for batch in batches:
            for host, layout, skeleton, html in zip(*(batch.column(i).to_pylist() for i in range(3)), blobs(batch.column(3)), strict=True):
                if skeleton is None:
                    continue
                group = (host, layout)
                if group not in known:
                    known[group] = Reference(skeleton)
                page = Tree(parse(html.decode()))
                for i, voted, equal, below in votes_of(known[group], page, aligner.pairs(known[group], page)):
                    x = sums.setdefault((*group, i), [0, 0, 0, 0])
                    x[0] += 1
                    x[1] += voted
                    x[2] += equal
                    x[3] += below
                if len(aligner.common) > MOST_KEPT:
                    aligner = Aligner()
        if sums:
            rows = [(*k, *x) for k, x in sums.items()]
            kinds = (pa.string(), pa.int64(), pa.int32(), *[pa.int64()] * 4)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=[*GROUP, "node", "aligned", "votes", "equal", "below"])

    python_ready(pages.sparkSession)
    told = _with_reference(pages.where("html IS NOT NULL AND host <> ''"), references, F.length("skeleton") + 200).select(*GROUP, "skeleton", "html")
    voted = told.mapInArrow(vote, "host string, layout long, node int, aligned long, votes long, equal long, below long")
    return voted.groupBy(*GROUP, "node").agg(*[F.sum(c).alias(c) for c in ("aligned", "votes", "equal", "below")])


#: Shapes compared that a task keeps; they are only kept to save time.
MOST_KEPT = 500_000


def extract_main_text(
    pages: DataFrame, *, page_id: str = "page_id", url: str = "url", html: str = "html", least_pages: int = 6, constant: float = 0.8,
) -> DataFrame:
    """page_id, url, text, n_chars: one row per row of pages.

    A group of pages of one host and layout has a wrapper if at least `least_pages` of them were aligned. A block
    of the wrapper counts as template if so many voted on it and at least the share `constant` of them had
    the same text. A null or empty html gives an empty text. Pages without a host are read without a
    wrapper. Repeated rows are read each; an empty table gives an empty result. Elements may be nested to
    any depth, and pages may have any length. Other columns are not read.
    """
    hosted = _hosted(pages, page_id, url, html)
    references = durable(_references(hosted), "html-references")
    votes = _votes(hosted, references).groupBy(*GROUP).agg(F.collect_list(F.struct("node", "aligned", "votes", "equal", "below")).alias("voted"))
    wrappers = durable(references.join(votes, GROUP, "left"), "html-wrappers")

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[tuple, Wrapper | None] = {}
        aligner = Aligner()
        for batch in batches:
            texts = []
            for i, body in enumerate(blobs(batch.column(4))):
                group = (batch.column(2)[i].as_py(), batch.column(3)[i].as_py())
                if group not in known:
                    skeleton, voted = batch.column(5)[i].as_py(), batch.column(6)[i].as_py()
                    known[group] = None if skeleton is None else Wrapper(skeleton, voted or [], least_pages, constant)
                texts.append(main_text(body.decode(), known[group], aligner) if body else "")
                if len(aligner.common) > MOST_KEPT:
                    aligner = Aligner()
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    python_ready(pages.sparkSession)
    joined = _with_reference(hosted, wrappers, F.length("skeleton") + 200 + 40 * F.coalesce(F.size("voted"), F.lit(0))).select("page_id", "url", *GROUP, "html", "skeleton", "voted")
    return joined.mapInArrow(extract, "page_id long, url string, text string, n_chars long")
