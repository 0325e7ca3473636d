"""Main text of web pages by wrapper induction.

Pages of a host are dealt into blocks by a hash of the id, of about BLOCK pages and BLOCK_BYTES at most, so that a host
with a third of all pages is many blocks. In a block one template grows: each page's DOM tree is aligned with it by simple
tree matching (of two lists of children, the order-preserving assignment of the greatest weight), and what the template
lacks is added, so that no page is the measure of the others. Every node of a page then stands in a slot of the template.

The wrapper is learned from the slots, over all pages of the block:
* a slot whose text is the same on most pages is template; the others vary;
* elements, roles and class names of menus, forms, adverts and so on mark slots, and so does a list of little but links;
  a class name marks none that holds most of the varying text;
* content is the part of the template that holds the varying text: its article and main elements if these hold at least
  half of it, else the innermost container that holds CONTAINER_SHARE of it.
A page's text is what stands in content slots that vary and are not marked, in page order.
"""

from __future__ import annotations

import html as entities
import math
import re
import sys
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from erlink.llm.common import materialize, small

#: Pages and bytes of a block, in expectation.
BLOCK, BLOCK_BYTES = 64, 4 << 20
#: Of n pages k have a slot with the same text: it is template if (k - 1) / (n - 1 + prior) reaches share; (share, prior)
#: outside articles and in them. So it takes three pages that agree outside, and six in articles.
TEMPLATE, IN_ARTICLE = (0.6, 0.9), (0.85, 0.8)
#: A container is content rather than its parent if it holds this share of the parent's varying text.
CONTAINER_SHARE = 0.75
#: Lists and boxes with this share of link text are menus, outside articles.
LINK_SHARE = 0.6
#: Lists of children whose product of lengths exceeds TABLE are aligned with rows of numpy; CELLS bounds the rows held.
TABLE, CELLS = 4096, 1 << 20

#: Element classes of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr ruby rt rp".split())
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"thead", "tbody", "tr", "td", "th"}}
BARRIERS = frozenset("table ul ol dl select body html".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())

#: Own choice: elements and roles that are never main text, and containers of it.
DROP_TAGS = frozenset("script style nav footer aside noscript iframe svg canvas template button select input textarea head title dialog menu object audio video".split())
DROP_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert menu menubar form".split())
CONTAINERS = frozenset("html body div section main article center form table tbody tr td".split())
LISTS = frozenset("ul ol dl div section table tbody tr td center".split())
#: Own choice: a class or id marks its element if one part of the whole name is in DROP_WORDS and the others in either list.
DROP_WORDS = frozenset("ad ads advert adverts advertisement advertising sponsor sponsored promo promotion promotions banner nav navbar navigation menu sidebar footer masthead breadcrumb breadcrumbs pagination pager cookie cookies consent gdpr notice notices notification notifications alert popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended recommendations comment comments disqus reply replies respond widget widgets toolbar skip".split())
PLAIN_WORDS = frozenset("site page post posts entry article main top bottom left right primary secondary global area bar box block body container inner outer wrap wrapper list item items link links button buttons form section row col column group panel slot unit text title head heading icon icons media policy and to".split())
HEADER_NAMES = frozenset("header site-header page-header global-header top-header topbar top-bar".split())

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']+|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>", re.S)
_ATTRIBUTE = re.compile(r"(?<![^\s\"'])(class|id|role|hidden|aria-hidden)(?![^\s=/])(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
_PARTS = re.compile(r"[a-z]+|[^a-z0-9_\-]+")


def marks(name: str) -> bool:
    """Whether a whole class or id, in lower case, names a menu, advert and the like: has-sidebar does not, site-footer does."""
    parts = _PARTS.findall(name)
    return not DROP_WORDS.isdisjoint(parts) and all(p in DROP_WORDS or p in PLAIN_WORDS for p in parts)


class Node:
    """An element. After measure(): nodes (its children that are or hold blocks), size (characters of words), linked (those in links), key (of the text)."""

    __slots__ = ("tag", "label", "marked", "header", "role", "hidden", "children", "nodes", "size", "linked", "key")

    def __init__(self, tag: str, attributes: str = ""):
        self.tag, self.label, self.children, self.nodes = tag, tag, [], []
        self.role, self.hidden, self.marked, self.header = "", False, tag == "form", tag == "header"
        self.size = self.linked = self.key = 0
        if attributes:
            for m in _ATTRIBUTE.finditer(attributes):
                name, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
                if name == "role":
                    self.role = value.strip()
                elif name in ("hidden", "aria-hidden"):
                    self.hidden |= name == "hidden" or value == "true"
                else:
                    names = value.split()
                    self.marked |= any(map(marks, names))
                    self.header |= not HEADER_NAMES.isdisjoint(names)
                    if name == "class":  # numbers in a class are the page's own
                        self.label = f"{tag}.{re.sub('[0-9]+', '#', value)}"
        if tag in ("html", "body", "main"):
            self.marked = self.header = False

    @property
    def main(self) -> bool:
        return self.tag in ("article", "main") or self.role == "main"

    def never(self) -> bool:
        return self.tag in DROP_TAGS or self.role in DROP_ROLES or self.hidden


def parse(source: str) -> Node:
    """A DOM tree; forgiving: unclosed, stray and misnested tags end where browsers would roughly end them."""
    root = Node("#root")
    made, stack, at, opened = [root], [root], 0, Counter()

    def close(k: int) -> None:
        opened.subtract(x.tag for x in stack[k:])
        del stack[k:]

    while True:
        m = _TOKEN.search(source, at)
        if m is None:
            break
        if m.start() > at:
            stack[-1].children.append(entities.unescape(source[at : m.start()]))
        at = m.end()
        name = m[2] or m[5]
        if not name:
            continue
        tag = name.lower()
        if m[1] or m[4]:
            for k in range(len(stack) - 1, 0, -1) if opened[tag] > 0 else ():
                if stack[k].tag == tag:
                    close(k)
                    break
                if tag in INLINE and stack[k].tag not in INLINE or tag in ("p", "li") and stack[k].tag in BARRIERS:
                    break
            continue
        if tag in CLOSES_P:
            for k in range(len(stack) - 1, 0, -1) if opened["p"] > 0 else ():
                if stack[k].tag == "p":
                    close(k)
                    break
                if stack[k].tag not in INLINE:
                    break
        elif tag in SIBLINGS:
            for k in range(len(stack) - 1, 0, -1) if any(opened[t] > 0 for t in SIBLINGS[tag]) else ():
                if stack[k].tag in BARRIERS:
                    break
                if stack[k].tag in SIBLINGS[tag]:
                    close(k)
                    break
        attributes = m[3] or m[6] or ""
        node = Node(tag, attributes)
        made.append(node)
        stack[-1].children.append(node)
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\b[^>]*>?", re.I).search(source, at)
            at = end.end() if end else len(source)
        elif tag not in VOID and not attributes.endswith("/"):
            stack.append(node)
            opened[tag] += 1
    if at < len(source):
        stack[-1].children.append(entities.unescape(source[at:]))
    for node in reversed(made):  # children before parents
        measure(node)
    return root


def measure(node: Node) -> None:
    parts, node.nodes = [], []
    for c in node.children:
        if isinstance(c, str):
            if words := c.split():
                parts.append(" ".join(words))
                node.size += sum(map(len, words))
        else:
            if c.tag not in INLINE or c.nodes:
                node.nodes.append(c)
            if c.size:
                parts.append(c.key)
                node.size += c.size
                node.linked += c.linked
    if node.tag == "a":
        node.linked = node.size
    # Markup around the same text makes no difference.
    node.key = parts[0] if len(parts) == 1 and not isinstance(parts[0], str) else hash(tuple(parts)) if parts else 0


class Slot:
    """A node of the template: what the nodes that stand in it have in common. key is the most frequent one."""

    __slots__ = ("tag", "label", "main", "nodes", "key", "keys", "size", "linked", "never", "marked", "seen")

    def __init__(self, node: Node):
        self.tag, self.label, self.main, self.key = node.tag, node.label, node.main, node.key
        self.nodes, self.keys = [], Counter()
        self.size = self.linked = self.never = self.marked = self.seen = 0

    def learn(self, node: Node) -> None:
        self.keys[node.key] += 1
        if self.keys[node.key] > self.keys[self.key]:
            self.key = node.key
        self.size += node.size
        self.linked += node.linked
        self.seen += 1
        self.never += node.never()
        self.marked += node.marked

    def template(self, pages: int, within: bool) -> bool:
        share, prior = IN_ARTICLE if within else TEMPLATE
        return bool(self.key) and self.tag not in INLINE and self.keys[self.key] - 1 >= share * (pages - 1 + prior)


Pairs = list[tuple[Slot, Node]]


def match_trees(a: Slot, b: Node, pairs: Pairs) -> int:
    """Simple tree matching of two trees whose roots match: its weight; the pairs of the matching are added to pairs.

    A pair weighs 2, and 3 if the texts are equal. Nodes match if their labels are equal and their parents match.
    """
    pairs.append((a, b))
    return 2 + (a.key == b.key) + match_lists(a.nodes, b.nodes, pairs)


def match_lists(x: list[Slot], y: list[Node], pairs: Pairs) -> int:
    """The greatest weight of an order-preserving assignment of nodes of x to nodes of y, and its pairs."""
    if not x or not y:
        return 0
    if len(x) * len(y) > TABLE:
        return match_long_lists(x, y, pairs)
    weight: dict[tuple[int, int], int] = {}
    inner: dict[tuple[int, int], Pairs] = {}
    table = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
    right = [(j, q.label, q.key, bool(q.nodes), q) for j, q in enumerate(y)]
    for i, p in enumerate(x):
        row, above, best = table[i + 1], table[i], 0
        label, key, deep = p.label, p.key, bool(p.nodes)
        for j, q_label, q_key, q_deep, q in right:
            best = max(best, above[j + 1])
            if label == q_label:
                if deep and q_deep:
                    own: Pairs = []
                    w = match_trees(p, q, own)
                    inner[i, j] = own
                else:
                    w = 2 + (key == q_key)
                weight[i, j] = w
                best = max(best, above[j] + w)
            row[j + 1] = best
    i, j = len(x), len(y)
    while i and j:
        at = (i - 1, j - 1)
        if at in weight and table[i][j] == table[i - 1][j - 1] + weight[at]:
            pairs.extend(inner.get(at) or [(x[i - 1], y[j - 1])])
            i, j = i - 1, j - 1
        elif table[i][j] == table[i - 1][j]:
            i -= 1
        else:
            j -= 1
    return table[-1][-1]


def match_long_lists(x: list[Slot], y: list[Node], pairs: Pairs) -> int:
    """As match_lists, row by row: of the table only every step-th row is kept, and those between are made anew to walk back."""
    names: dict[str, int] = {}
    number = lambda nodes: np.array([names.setdefault(q.label, len(names)) for q in nodes], np.int64)
    y_labels, x_labels, y_keys, deep = number(y), number(x), np.array([q.key for q in y]), np.array([bool(q.nodes) for q in y])
    known: dict[tuple[int, int], int] = {}

    def after(above: np.ndarray, i: int) -> np.ndarray:
        fits = y_labels == x_labels[i]
        w = np.where(fits, 2 + (y_keys == x[i].key), 0)
        if x[i].nodes:
            for j in map(int, np.flatnonzero(fits & deep)):
                if (i, j) not in known:
                    known[i, j] = match_trees(x[i], y[j], [])
                w[j] = known[i, j]
        row = np.zeros_like(above)
        np.maximum.accumulate(np.maximum(above[1:], above[:-1] + w), out=row[1:])
        return row

    step = max(math.isqrt(len(x)) + 1, CELLS // len(y))
    row, kept = np.zeros(len(y) + 1, np.int64), []
    for i in range(len(x)):
        if i % step == 0:
            kept.append(row)
        row = after(row, i)
    total, j = int(row[-1]), len(y)
    for lo in reversed(range(0, len(x), step)):
        rows = [kept.pop()]
        for i in range(lo, min(lo + step, len(x))):
            rows.append(after(rows[-1], i))
        for i in reversed(range(len(rows) - 1)):
            while j and rows[i + 1][j] == rows[i + 1][j - 1]:
                j -= 1
            if j and rows[i + 1][j] != rows[i][j]:
                j -= 1
                if x[lo + i].nodes and deep[j]:
                    match_trees(x[lo + i], y[j], pairs)
                else:
                    pairs.append((x[lo + i], y[j]))
    return total


def grow(pairs: Pairs) -> None:
    """Adds the nodes of a page that match no slot to the template, in place, and to pairs."""
    of = {id(q): p for p, q in pairs}
    todo = list(pairs)
    while todo:
        p, q = todo.pop()
        old, at, merged = p.nodes, 0, []
        for c in q.nodes:
            slot = of.get(id(c))
            if slot is None:
                slot = Slot(c)
                pairs.append((slot, c))
                todo.append((slot, c))
            else:
                while old[at] is not slot:
                    merged.append(old[at])
                    at += 1
                at += 1
            merged.append(slot)
        p.nodes = [*merged, *old[at:]]


class Wrapper:
    """What a block's template says: which slots are content, and which of them are to be left out."""

    def __init__(self, template: Slot, pages: int):
        self.pages, self.out, self.varying, within = pages, set(), {}, {}
        order: list[Slot] = []
        stack = [(template, False)]
        while stack:
            p, inside = stack.pop()
            order.append(p)
            within[id(p)] = inside = inside or p.main
            stack.extend((c, inside) for c in reversed(p.nodes))
        self.never = {id(p) for p in order if 2 * p.never > p.seen}
        self.constant = {id(p) for p in order if p is not template and p.template(pages, within[id(p)])}
        self.marked = {id(p) for p in order if 2 * p.marked > p.seen}
        self._weigh(order)
        mains = self._mains(template)
        if mains and 2 * sum(self.varying[id(p)] for p in mains) >= self.varying[id(template)]:
            self.articles, self.content = True, {id(p) for p in mains}
            return
        # No class name marks what holds most of the text.
        self.articles = False
        spared = {id(p) for p in order if id(p) in self.marked and 2 * self._inner(p) > self.varying[id(template)] + self._inner(p)}
        self.marked -= spared
        self.out = {id(p) for p in order if p.tag in LISTS and len(p.nodes) > 1 and p.linked >= LINK_SHARE * p.size > 0}
        self._weigh(order)
        self.content = self._container(template)

    def _gone(self, p: Slot) -> bool:
        return any(id(p) in s for s in (self.never, self.constant, self.marked, self.out))

    def _inner(self, p: Slot) -> float:
        return p.size - sum(c.size for c in p.nodes) + sum(self.varying[id(c)] for c in p.nodes)

    def _weigh(self, order: list[Slot]) -> None:
        """varying: the characters of a slot and those below it that are neither template nor marked, over all pages."""
        for p in reversed(order):
            self.varying[id(p)] = 0 if self._gone(p) else self._inner(p)

    def _mains(self, template: Slot) -> list[Slot]:
        """The outermost article and main slots that nothing marks."""
        found, stack = [], [template]
        while stack:
            p = stack.pop()
            if id(p) in self.never or id(p) in self.marked:
                continue
            if p.main:
                found.append(p)
            else:
                stack.extend(reversed(p.nodes))
        return found

    def _container(self, p: Slot) -> set[int]:
        """The innermost container that holds the varying text, with the headings that stand before it on the way."""
        content = set()
        while True:
            most = max((c for c in p.nodes if c.tag in CONTAINERS), key=lambda c: self.varying[id(c)], default=None)
            if most is None or not self.varying[id(most)] or self.varying[id(most)] < CONTAINER_SHARE * self.varying[id(p)]:
                return content | {id(p)}
            for c in p.nodes:
                if c is most:
                    break
                if c.tag == "h1":
                    content.add(id(c))
            p = most

    def same(self, p: Slot, q: Node) -> bool:
        return id(p) in self.constant and q.key == p.key

    def text(self, pairs: Pairs, known: set[int]) -> str | None:
        """Main text of a page whose nodes stand in the slots of pairs; None if it has none of the content slots."""
        gone, chosen = set(known), set()
        for p, q in pairs:
            if self.same(p, q) or q.never() or id(p) in self.marked and q.marked or id(p) in self.out:
                gone.add(id(q))
            if id(p) in self.content:
                chosen.add(id(q))
        if not chosen:
            return None
        out, stack = [], [pairs[0][1]]
        while stack:  # in page order
            q = stack.pop()
            if id(q) in gone:
                continue
            if id(q) in chosen:
                if t := blocks(q, gone, self.articles):
                    out.append(t)
            else:
                stack.extend(reversed(q.nodes))
        return " ".join(out)


def blocks(node: Node, gone: set[int], articles: bool) -> str:
    """Text of node without the nodes in gone, its blocks joined by one space. Of a header in an article, the headings."""
    out: list[str] = []
    stack: list[Node | str] = [node]
    while stack:
        x = stack.pop()
        if isinstance(x, str):
            out.append(x)
        elif id(x) in gone or x.never():
            out.append(" ")
        elif x.header and x is not node:
            out.append(" ")
            for h in headings(x, gone) if articles else ():
                out += [blocks(h, gone, articles), " "]
        elif x.tag in INLINE and not x.nodes:
            stack.extend(reversed(x.children))
        else:
            stack.append(" ")
            stack.extend(reversed(x.children))
            out.append(" ")
    return " ".join("".join(out).split())


def headings(node: Node, gone: set[int]) -> list[Node]:
    found, stack = [], [node]
    while stack:
        x = stack.pop()
        if id(x) in gone or x.never():
            continue
        if x.tag in HEADINGS:
            found.append(x)
        else:
            stack.extend(reversed(x.nodes))
    return found


def extract_block(sources: list[str], align: bool = True) -> list[str]:
    """Main texts of pages of one host. Without align each page is a block of its own: for comparison only."""
    if not align and len(sources) > 1:
        return [extract_block([s])[0] for s in sources]
    sys.setrecursionlimit(max(sys.getrecursionlimit(), 4 * max((s.count("<") for s in sources), default=0) + 1000))  # frames of nested elements lie on the heap
    return align_pages([parse(s) for s in sources], set())


def align_pages(roots: list[Node], known: set[int]) -> list[str]:
    """Main texts of parsed pages. known: nodes that a larger block has found to be template.

    Pages that have none of the content slots are of another layout; they are aligned with each other once more.
    """
    template, aligned, contents = Slot(roots[0]), [], set()
    for root in roots:
        pairs: Pairs = []
        match_trees(template, root, pairs)
        grow(pairs)
        aligned.append(pairs)
        own = tuple(q.key for _, q in pairs if q.main) or root.key
        if own not in contents:  # copies of a page say nothing about the template
            contents.add(own)
            for p, q in pairs:
                p.learn(q)
    wrapper = Wrapper(template, len(contents))
    texts = [wrapper.text(pairs, known) for pairs in aligned]
    others = [i for i, text in enumerate(texts) if text is None]
    if others and len(others) < len(roots):
        found = {id(q) for i in others for p, q in aligned[i] if wrapper.same(p, q)}
        for i, text in zip(others, align_pages([roots[i] for i in others], known | found), strict=True):
            texts[i] = text
    return [text or "" for text in texts]


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars for every row of pages.

    A null or empty html gives an empty text. Urls without a host form one more host, in blocks like others. Repeated
    rows each give a row; an empty table gives none; other columns are not read, so they may have any name. Very long
    pages are read whole, at any depth of nesting. One shuffle, of the pages to blocks.
    """
    rows = pages.select(F.col(id_col).cast("bigint").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html"))
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[^:/?#]*://([^/?#]*)", 1))
    sizes = rows.select(host.alias("host"), F.octet_length("html").cast("bigint").alias("size")).groupBy("host")
    sizes = materialize(sizes.agg(F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK), F.ceil(F.sum("size") / BLOCK_BYTES), F.lit(1)).alias("n_blocks")), "html-hosts")
    rows = rows.withColumn("host", host).join(small(sizes, sizes.count(), 128), "host")
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("page_id", "url"), "n_blocks")).drop("n_blocks").repartition("host", "block").sortWithinPartitions("host", "block", "page_id", "url", "html")

    def run(batches):
        key, held = None, []

        def done():
            texts = extract_block([h for _, _, h in held])
            return pa.RecordBatch.from_arrays([pa.array([i for i, _, _ in held], pa.int64()), pa.array([u for _, u, _ in held], pa.string()), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])

        for batch in batches:
            for k, *row in zip(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True), *(c.to_pylist() for c in batch.columns[2:]), strict=True):
                if k != key:
                    if held:
                        yield done()
                    key, held = k, []
                held.append(row)
        if held:
            yield done()

    return dealt.select("host", "block", "page_id", "url", "html").mapInArrow(run, "page_id bigint, url string, text string, n_chars bigint")
