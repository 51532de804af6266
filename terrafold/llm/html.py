"""Main text of web pages by wrapper induction.

Pages of one host are aligned with the host's exemplar (its shortest page) by simple tree matching: the largest
number of nodes that can be paired so that tags agree and order and ancestry are kept. All distinct main texts of the
host then vote. For each text node of the exemplar they vote with the text that they have in its place: where at least
nine tenths agree, the node is template. And each adds the words that it has outside links to the nodes where they are;
the article's slot is the narrowest container that still has most of the host's words. A page's text is what stands in
its counterpart of that slot, without the template's text and without elements there that say what they are (adverts,
comments, forms, ...). What the slot and the elements around it call themselves doesn't matter.

Text that nine tenths of a host's articles have in one place inside the slot, a heading that all share, is template
too. An element says what it is by its tag, by the attribute hidden or display:none, or by a class, id or role whose
words are all of that kind: a section with the id market-share is none of them. In the slot only names of readers'
comments and adverts count: whatever else differs from page to page there is content, and what doesn't is template.

A host has no template if it leaves most pages less than a quarter of their words: such pages are near copies, and what
they share is the article. A host of too few distinct pages has no slot, nor has a page that doesn't match it: their
text is in the elements that call themselves article or main, or else in all that don't say that they are something else.

One exemplar goes to all pages of its host, so its copies are salted and a host with a third of all pages is spread
over many tasks. Votes are counts, combined before they are shuffled; the template has at most as many nodes as
the exemplar. No group of pages is ever collected.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter, defaultdict
from functools import cache, lru_cache
from html import unescape
from math import isqrt

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrafold.llm.common import CACHES, cut, slices

#: Copies of a model; pages and share of them that make a template; words of its own that a page has at least, as a share.
SALT, VOTES, AGREE, OWN = 32, 3, 0.9, 0.25
#: Share of a container's words that makes a container in it the article's slot.
MOST = 0.6
#: Cells of a table of two sequences that is held whole.
CELLS = 1 << 20
#: Letters of a tag in which its end is looked for before quotes are searched.
NEAR = 300
#: Fixed values of HTML: elements without end, elements of raw text, elements that are blocks.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe xmp noembed noframes".split())
BLOCKS = frozenset("address article aside blockquote body dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main nav ol p pre section summary table tbody td tfoot th thead title tr ul".split())
#: Elements and names in class, id or role that aren't the article.
NOT_TEXT = frozenset("script style textarea title noscript template iframe xmp noembed noframes head nav footer aside form button select svg canvas object audio video map menu dialog".split())
NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising promo promotion sponsor sponsored banner nav navbar navigation menu menubar breadcrumb breadcrumbs sidebar aside comment comments commentlist reply replies disqus respond responses"
    " discussion footer cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup signin login share sharing social related recommended recommendations search searchbox widget toolbar pagination pager"
    " copyright masthead skip legal disclaimer complementary contentinfo topbar bottombar".split()
)
CONTAINERS = frozenset("html body main article section div center table tbody tr td dd".split())
#: Elements that are never the article's slot, whatever they hold: names of readers' comments; elements without text of their own.
READERS = frozenset("comment comments commentlist reply replies disqus respond responses discussion".split())
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/<>]*)|[^<]+|<", re.S)
_ATTRIBUTE = re.compile(r"([^\s\"'/>=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_TELLING = re.compile(r"class|id|role|hidden|style", re.I)
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}


class Node:
    """An element; children are nodes and strings. named, of a root: whether an element below isn't the article by its name alone."""

    __slots__ = ("tag", "other", "children", "readers", "named")

    def __init__(self, tag: str, other: int = 0, readers: bool = False):
        self.tag, self.other, self.children, self.readers = tag, other, [], readers


#: Names that make an article one of readers' or advertisers'; words beside which a name tells of a page's layout.
NOT_ARTICLE = frozenset("ad ads advert comment comments promo related reply sponsored teaser".split())
LAYOUT = frozenset("container has layout no with without wrap wrapper".split())
#: Words that leave a name what it is: a "comment-list" is comments, but a "market-share" isn't for sharing.
PLAIN = frozenset("all area author bar block body bottom box btn button col column content footer form group header holder inner item items left link links list main latest message my new outer page panel post posts public reader readers right section site slot text thread threads title top unit user users visitor visitors".split())
#: Elements whose id is mostly the anchor of a heading; only these names count there.
ANCHORED = frozenset("article section h1 h2 h3 h4 h5 h6 p span".split())
ANCHORS = READERS | frozenset("ad ads advert adverts advertisement cookie cookies consent newsletter sidebar related recommended".split())
#: The scopes of list items and cells: an item doesn't end another one outside of its scope.
SCOPES = frozenset(("ul", "ol", "dl", "table", "select"))


def attributes_of(text: str) -> dict[str, str]:
    """Names (small letters) and values of a tag's attributes, character references decoded; the first of a name counts."""
    out: dict[str, str] = {}
    for m in _ATTRIBUTE.finditer(text):
        out.setdefault(m[1].lower(), unescape(m[2] or m[3] or m[4] or ""))
    return out


def _says(name: str, kinds: frozenset) -> set[str]:
    """The kinds that a class, id or role says: all its parts are such kinds or plain words, and one at least is a kind."""
    parts = [p.lower() for p in _PART.findall(name)]
    found = {p for p in parts if p in kinds}
    return found if all(p in kinds or p in PLAIN or p.isdigit() for p in parts) else set()


@lru_cache(4096)
def _other(tag: str, attributes: str) -> tuple[int, bool]:
    """Whether an element isn't the article, and whether it is the readers'.

    0 for none of it, 1 if it isn't, 2 if it isn't outside of one (page headers), 3 if it isn't by its name alone, which
    doesn't count in a slot that pages have voted for.
    """
    if tag in NOT_TEXT:
        return 1, tag not in ("form", "aside", "dialog")
    if tag in ("html", "body", "main") or not _TELLING.search(attributes):
        return 2 if tag == "header" else 0, False
    known = attributes_of(attributes)
    if "hidden" in known or re.search(r"display\s*:\s*none", known.get("style", ""), re.I):
        return 1, True
    kinds, names = NOT_ARTICLE if tag == "article" else NAMES, set()
    for place in ("class", "id", "role"):
        of = kinds & ANCHORS if place == "id" and tag in ANCHORED else kinds
        for name in known.get(place, "").split():
            names |= _says(name, of | {"header"})
    if names & (NOT_ARTICLE | READERS):
        return 1, bool(names & READERS)
    if names & kinds:
        return 3, False
    return (2 if tag == "header" or "header" in names else 0), False


@cache
def _plain(tag: str) -> tuple[int, bool]:
    return _other(tag, "")


def _ends(html: str):
    """A function that gives the place of the > that ends a tag whose attributes begin at a place, or -1; > in quotes doesn't count.

    A near > behind whole pairs of " needs no search; the places of all quotes are found when a first tag needs them.
    """
    at, close = [], []

    def search(start: int) -> int:
        if not close:
            at[:] = [m.start() for m in re.finditer("[>\"']", html)]
            close[:] = [-1] * (len(at) + 1)  # from outside of quotes
            single = double = -1  # from inside
            for k in range(len(at) - 1, -1, -1):
                c, after = html[at[k]], close[k + 1]
                close[k] = at[k] if c == ">" else double if c == '"' else single
                single, double = (after, double) if c == "'" else (single, after) if c == '"' else (single, double)
        return close[bisect_left(at, start)]

    def end(start: int) -> int:
        near = html.find(">", start, start + NEAR)
        if near < 0 or "'" in (between := html[start:near]) or between.count('"') % 2:
            return search(start)
        return near

    return end


def parse(html: str) -> Node:
    """A tree of any text; end tags may be missing or too many. The time is in proportion to the text.

    Where the open items and scopes of lists and tables stand on the stack is kept, so no tag searches it.
    """
    root = Node("#")
    root.named = False
    stack, at = [root], 0
    n, end_of, open_ = len(html), _ends(html), defaultdict(int)
    items: dict[str, list[int]] = {t: [] for t in CLOSES}
    scopes = [0]

    def leave(k: int) -> None:
        while len(stack) > k:
            t = stack.pop().tag
            open_[t] -= 1
            if t in items:
                items[t].pop()
            elif t in SCOPES:
                scopes.pop()

    while at < n:
        m = _TOKEN.match(html, at)
        tag = m[2]
        end = end_of(m.end()) if tag else 0
        if end < 0:  # a tag that never ends is text
            stack[-1].children.append("<")
            at += 1
            continue
        if tag is None:
            at = m.end()
            s = m[0]
            if s[0] != "<" or len(s) == 1:
                stack[-1].children.append(s)
            continue
        attributes, at = html[m.end() : end], end + 1
        tag = tag.lower()
        if m[1]:
            if stack[-1].tag == tag:
                leave(len(stack) - 1)
            elif open_[tag]:
                leave(next(k for k in range(len(stack) - 1, 0, -1) if stack[k].tag == tag))
            continue
        if tag in BLOCKS and open_["p"]:  # ends an open paragraph
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == "p":
                    leave(k)
                    break
                if stack[k].tag in BLOCKS:
                    break
        if tag in CLOSES:
            last = max(items[t][-1] if items[t] else 0 for t in CLOSES[tag])
            if last > scopes[-1]:
                leave(last)
        node = Node(tag, *(_other(tag, attributes) if attributes else _plain(tag)))
        root.named |= node.other == 3
        stack[-1].children.append(node)
        if tag in RAW:
            found = re.compile(rf"</{re.escape(tag)}\b[^<>]*>", re.I).search(html, at)
            at = found.end() if found else n
        elif tag not in VOID and not attributes.endswith("/"):
            if tag in items:
                items[tag].append(len(stack))
            elif tag in SCOPES:
                scopes.append(len(stack))
            stack.append(node)
            open_[tag] += 1
    return root


class Block:
    """A block of text, its node, and how many of its words are outside of links and of what is never an article."""

    __slots__ = ("text", "node", "article", "other", "words")

    def __init__(self, text: str, node: Node, article: bool, other: bool, words: int):
        self.text, self.node, self.article, self.other, self.words = text, node, article, other, words


def blocks(root: Node, slot: Node | None = None, names: bool = True) -> list[Block]:
    """Blocks in page order, white space as one space, character references decoded; none is empty.

    slot counts as an article; without names what elements call themselves doesn't, but for readers and adverts.
    """
    out: list[Block] = []
    open_: list[str] = []
    words = [0]
    state = [root, False, False]

    def close() -> None:
        if not open_:
            return
        joined = "".join(open_)
        text = " ".join((unescape(joined) if "&" in joined else joined).split())
        open_.clear()
        if text:
            out.append(Block(text, *state, words[0]))
        words[0] = 0

    todo: list = [(root, False, False, root, False, False)]
    while todo:
        x, article, other, owner, aside, leaving = todo.pop()
        if x.__class__ is str:
            if not open_ or state[0] is not owner or state[2] != other:
                close()
                state[:] = [owner, article, other]
            open_.append(x)
            words[0] += 0 if aside else len(x.split())
            continue
        if leaving:
            close()
            continue
        if x.tag in ("br", "hr"):
            open_.append(" ")
        block = x.tag in BLOCKS
        other = other or x.other == 1 or (x.other == 2 and not article) or (x.other == 3 and names)
        article = article or x.tag in ("article", "main") or x is slot
        aside = aside or x.tag == "a" or x.readers
        inner = x if block else owner
        if block:
            close()
            todo.append((x, article, other, inner, aside, True))
        todo += [(c, article, other, inner, aside, False) for c in reversed(x.children)]
    close()
    return out


def _elements(x: Node) -> list[Node]:
    return [c for c in x.children if c.__class__ is Node]


def _shapes(root: Node, known: dict, sizes: list[int]) -> dict[int, int]:
    """A number for each node, by identity: nodes have one number if tags and elements below are equal."""
    out, order = {}, [root]
    for x in order:  # grows meanwhile; backwards, children come before their parents
        order += _elements(x)
    for x in reversed(order):
        key = (x.tag, *[out[id(c)] for c in x.children if c.__class__ is Node])
        k = known.get(key)
        if k is None:
            k = known[key] = len(sizes)
            sizes.append(1 + sum([sizes[c] for c in key[1:]]))
        out[id(x)] = k
    return out


def _row(last: np.ndarray, w: np.ndarray) -> np.ndarray:
    """The next row of the table of largest matchings of two sequences."""
    new = np.empty_like(last)
    new[0] = 0
    np.maximum(last[1:], last[:-1] + w, out=new[1:])
    return np.maximum.accumulate(new)


def _steps(n: int, width: int, weights) -> list[tuple[int, int]]:
    """The pairs of a largest matching of two sequences, from the last; of a large table a few rows are kept."""
    step = n if n * width <= CELLS else isqrt(n) + 1
    starts = [np.zeros(width + 1, np.int32)]
    last = starts[0]
    for i in range((n - 1) // step * step):
        last = _row(last, weights(i))
        if (i + 1) % step == 0:
            starts.append(last)
    out, j = [], width
    for k in reversed(range(len(starts))):
        rows = [starts[k]]
        for i in range(k * step, min(n, (k + 1) * step)):
            rows.append(_row(rows[-1], weights(i)))
        i = len(rows) - 1
        while i and j:
            if rows[i][j] == rows[i - 1][j]:
                i -= 1
            elif rows[i][j] == rows[i][j - 1]:
                j -= 1
            else:
                out.append((k * step + i - 1, j - 1))
                i, j = i - 1, j - 1
    return out


def tree_match(a: Node, b: Node, of_a: tuple | None = None) -> list[tuple[Node, Node]]:
    """Simple tree matching: the pairs of a largest matching of two trees whose roots have one tag.

    Sizes depend on shapes only, so each pair of shapes is matched once; equal shapes match node by node. Nothing
    recurses, and no table is held whole beyond CELLS. of_a: shapes of a that were made before.
    """
    if of_a is None:
        known, sizes = {}, []
        of_a = known, sizes, _shapes(a, known, sizes)
    known, sizes = of_a[0].copy(), of_a[1].copy()
    shape = of_a[2] | _shapes(b, known, sizes)
    keys = list(known)
    memo: dict[tuple[int, int], int] = {}

    def weight(s: int, t: int) -> int:
        if keys[s][0] != keys[t][0]:
            return 0
        if s == t:
            return sizes[s]
        return memo[s, t] if len(keys[s]) > 1 and len(keys[t]) > 1 else 1

    def weigher(p: tuple, q: tuple):
        others = {t: k for k, t in enumerate(dict.fromkeys(q))}
        at, rows = np.array([others[t] for t in q]), {}

        def weights(i: int) -> np.ndarray:
            if p[i] not in rows:
                if len(rows) * len(q) > CELLS:
                    rows.clear()
                rows[p[i]] = np.array([weight(p[i], t) for t in others], np.int32)[at]
            return rows[p[i]]

        return weights

    def measure(x: int, y: int) -> None:
        """Fills memo for two shapes and what lies below."""
        todo = [(x, y)]
        while todo:
            s, t = todo[-1]
            if (s, t) in memo:
                todo.pop()
                continue
            p, q = keys[s][1:], keys[t][1:]
            open_ = [(c, d) for c in set(p) for d in set(q) if c != d and keys[c][0] == keys[d][0] and len(keys[c]) > 1 and len(keys[d]) > 1 and (c, d) not in memo]
            if open_:
                todo += open_
                continue
            weights, last = weigher(p, q), np.zeros(len(q) + 1, np.int32)
            for i in range(len(p)):
                last = _row(last, weights(i))
            memo[s, t] = 1 + int(last[-1])
            todo.pop()

    out, todo = [], [(a, b)]
    while todo:
        x, y = todo.pop()
        out.append((x, y))
        s, t, p, q = shape[id(x)], shape[id(y)], _elements(x), _elements(y)
        if s == t:
            todo += zip(p, q)
        elif p and q:
            measure(s, t)
            todo += [(p[i], q[j]) for i, j in _steps(len(p), len(q), weigher(keys[s][1:], keys[t][1:]))]
    return out


def _numbered(root: Node) -> dict[int, int]:
    """Places of the nodes in page order, by identity."""
    out, todo = {}, [root]
    while todo:
        x = todo.pop()
        out[id(x)] = len(out)
        todo += reversed(_elements(x))
    return out


@lru_cache(8)
def _exemplar(html: str) -> tuple[Node, dict[int, int], tuple]:
    """The tree, its nodes' places, and its shapes (see tree_match). Rows come by host, so a few exemplars are kept."""
    root, known, sizes = parse(html), {}, []
    return root, _numbered(root), (known, sizes, _shapes(root, known, sizes))


def _above(root: Node) -> dict[int, Node]:
    """Each node's parent, by identity."""
    out, todo = {}, [root]
    while todo:
        x = todo.pop()
        for c in _elements(x):
            out[id(c)] = x
            todo.append(c)
    return out


class Aligned:
    """A page: its tree, its blocks, and of its nodes (by identity) the exemplar's that they are matched with."""

    def __init__(self, html: str, exemplar: str):
        self.root = parse(html)
        self.blocks = blocks(self.root)
        self.of: dict[int, int] = {}
        self.node: dict[int, Node] = {}
        if self.blocks and exemplar:
            model, numbers, shapes = _exemplar(exemplar)
            for x, y in tree_match(model, self.root, shapes):
                self.of[id(y)], self.node[numbers[id(x)]] = numbers[id(x)], y
        self.above = _above(self.root)

    def matched(self, x: Node | None) -> int:
        """The exemplar's node of the nearest node at or above x that is matched."""
        while x is not None and id(x) not in self.of:
            x = self.above.get(id(x))
        return 0 if x is None else self.of[id(x)]

    def words(self) -> Counter:
        """Words outside of links by the exemplar's node."""
        out: Counter = Counter()
        for b in self.blocks:
            if b.words:
                out[self.matched(b.node)] += b.words
        return out


def _slot(root: Node, own: dict[int, int]) -> Node:
    """The article's slot in a tree, from the words by node (identity): the narrowest container with most of what its parent has.

    A container with a heading before the slot belongs to it.
    """
    total, order = {}, [root]
    for x in order:  # grows meanwhile
        order += _elements(x)
    for x in reversed(order):
        total[id(x)] = own.get(id(x), 0) + sum(total[id(c)] for c in _elements(x))
    path = [root]
    while below := [c for c in _elements(path[-1]) if c.tag in CONTAINERS and total[id(c)] > MOST * total[id(path[-1])]]:
        path.append(below[0])
    while len(path) > 1 and any(c.tag in ("h1", "h2") for c in _elements(path[-2])[: _elements(path[-2]).index(path[-1])]):
        path.pop()
    return path[-1]


@lru_cache(8)
def slot_of(exemplar: str, words: tuple[tuple[int, int], ...]) -> int:
    """The article's slot in the exemplar, from the host's words by node."""
    root, numbers, _ = _exemplar(exemplar)
    own = dict(words)
    return numbers[id(_slot(root, {k: own.get(n, 0) for k, n in numbers.items()}))]


class _Kept:
    """What workers keep of exemplars, emptied after each task like the caches of words."""

    def clear(self) -> None:
        _exemplar.cache_clear()
        slot_of.cache_clear()


CACHES.append(_Kept())


def _digest(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text.encode()) - (1 << 63)


def main_text(page: Aligned, template: dict[int, int], slot: int | None) -> str:
    """Blocks in the page's counterpart of the slot that aren't another element's nor the template's text.

    Without a slot: inside the article if the page has one; if it has none and names leave little of it, in the slot by
    the page's own words.
    """
    at, kept = page.node.get(slot), []
    if at is None:
        inside = any(b.article and not b.other for b in page.blocks)
        kept = [b for b in page.blocks if not b.other and (b.article or not inside)]
        own: Counter = Counter()
        for b in page.blocks:
            own[id(b.node)] += b.words
        few = not inside and sum(b.words for b in kept) < (1 - MOST) * own.total()
        at = _slot(page.root, own) if few else None
    if at is not None:
        within, todo = set(), [at]
        while todo:
            x = todo.pop()
            within.add(id(x))
            todo += _elements(x)
        x, named = at, at.tag not in ("article", "main")
        while x is not None:  # what the slot and all around it are called doesn't matter
            named |= x.other > 0
            x.other = 0
            x = page.above.get(id(x))
        voted = slot in page.node
        named |= voted and page.root.named
        kept = [b for b in (blocks(page.root, at, not voted) if named else page.blocks) if id(b.node) in within and not b.other]
    return "\n\n".join(b.text for b in kept if template.get(page.of.get(id(b.node), -1)) != _digest(b.text))


def extract_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for every row of pages.

    Null html is empty and has no text; null urls share the host "". Repeated rows get equal texts, an empty table
    gives an empty one; extra columns are ignored.
    """
    host = F.lower(F.coalesce(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1), F.lit("")))
    rows = pages.select(F.col("page_id"), F.col("url"), host.alias("host"), F.coalesce("html", F.lit("")).alias("text"))
    # Fewer pages than VOTES make no template, so they aren't aligned; distinct ones are counted exactly below.
    least = F.min_by("text", F.struct(F.length("text"), F.xxhash64("text")))
    models = rows.filter("text != ''").groupBy("host").agg(least.alias("model"), F.count(F.lit(1)).alias("n")).filter(F.col("n") >= VOTES).drop("n")
    models = cut(models.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1)))))
    # Both passes take the same columns and are in one plan, which nothing cuts, so that Spark deals the pages once and
    # uses that exchange twice: the pages' shuffle is most of what the job writes.
    dealt = rows.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALT)).cast("int"))
    columns = ["host", "salt", "page_id", "url", "text", "model"]
    salted = dealt.join(models, ["host", "salt"], "left").select(*columns)

    def vote(batches):
        for b in slices(batches):
            out = []
            for h, t, m in zip(b.column("host").to_pylist(), b.column("text").to_pylist(), b.column("model").to_pylist()):
                if not t or not m:
                    continue
                a = Aligned(t, m)
                own = [(x.text, a.of.get(id(x.node), -1)) for x in a.blocks if x.words or not x.other]
                page = _digest("\n".join(x for x, _ in own))
                out += {(h, -1, 0, page, sum(len(x.split()) for x, _ in own))} | {(h, k, _digest(x), page, len(x.split())) for x, k in own if k >= 0}
                out += [(h, -2 - k, 0, page, n) for k, n in a.words().items()]
            cols = list(zip(*out)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))], ["host", "node", "digest", "page", "words"])

    # A page is the digest of its main text, so copies with other links or tokens are one vote. Node -1 is the whole page,
    # nodes below hold the words in the exemplar's nodes.
    # Votes are used several times in that plan: no filter and no column may differ, so that Spark makes them once. No
    # host is null; Spark would put that filter into some of the uses.
    votes = salted.mapInArrow(vote, "host string, node int, digest long, page long, words long").filter("host is not null").distinct()
    counted = votes.groupBy("host", "node", "digest").agg(F.count(F.lit(1)).alias("n"), F.sum("words").alias("words"))
    agreed = counted.groupBy("host", "node").agg(F.max(F.struct("n", "digest")).alias("top"), F.sum("words").alias("words"))
    spread = F.collect_list(F.when(F.col("node") < -1, F.struct((-2 - F.col("node")).alias("node"), "words")))  # a row for each node of the exemplar at most
    agreed = agreed.groupBy("host").agg(F.max(F.when(F.col("node") == -1, F.col("top.n"))).alias("pages"), F.collect_list(F.when(F.col("node") >= 0, F.struct("node", "top"))).alias("all"), F.array_sort(spread).alias("spread"))
    slots = agreed.filter(F.col("pages") >= VOTES).select("host", "spread")
    template = agreed.filter(F.col("pages") >= VOTES).select("host", F.explode(F.filter("all", lambda x: x["top"]["n"] >= AGREE * F.col("pages"))).alias("x")).select("host", "x.node", "x.top")
    # What near copies of one article share is the article: most pages must have a text of their own besides the template.
    shared = template.select("host", "node", F.col("top.digest").alias("digest"), F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))).alias("salt"), F.lit(True).alias("gone"))
    each = votes.withColumn("salt", F.pmod("page", F.lit(SALT)).cast("int")).join(shared, ["host", "node", "digest", "salt"], "left")
    each = each.groupBy("host", "page").agg(F.sum(F.when(F.col("node") == -1, F.col("words"))).alias("words"), F.sum(F.when(F.col("gone"), F.col("words")).otherwise(0)).alias("gone")).filter("words > 0")
    varied = each.groupBy("host").agg(F.avg((F.col("words") - F.col("gone") >= OWN * F.col("words")).cast("int")).alias("share")).filter("share >= 0.5")
    template = template.join(varied, "host", "left_semi")
    template = template.groupBy("host").agg(F.collect_list("node").alias("nodes"), F.collect_list("top.digest").alias("digests"))
    wrapped = models.join(template, "host", "left").join(slots, "host", "left")

    def extract(batches):
        for b in slices(batches):
            texts = []
            for t, m, nodes, digests, spread in zip(*(b.column(c).to_pylist() for c in ("text", "model", "nodes", "digests", "spread"))):
                slot = slot_of(m, tuple((x["node"], x["words"]) for x in spread)) if m and spread else None
                texts.append(main_text(Aligned(t, m if spread else ""), dict(zip(nodes or (), digests or ())), slot))
            text = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), text, pa.compute.utf8_length(text).cast(pa.int64())], ["page_id", "url", "text", "n_chars"])

    full = dealt.join(wrapped, ["host", "salt"], "left").select(*columns, "nodes", "digests", "spread")
    kind = pages.schema["page_id"].dataType.simpleString()
    return full.mapInArrow(extract, f"page_id {kind}, url string, text string, n_chars long")
