"""HTML extraction by wrapper induction.

A page becomes a tree of its block elements, in which neighbours of one shape (label and shapes
below) are folded. Of each host the shape that most different pages have is the seed; all other pages
are aligned with it by simple tree matching, the order-keeping pairing of the most nodes with equal
labels. A seed's node is a slot; nodes without a partner have their label path as slot.

* A text that one slot shows on at least CONSTANT of a host's different pages is constant, hence
  template; the other texts of the slot vary and are content.
* A slot whose text lies in links nearly to the whole, on nearly all pages, is a menu, whatever it says,
  unless it holds most of the page's words.
* What a page marks as menu, header, footer, sidebar, notice, advert, form, script, style or
  comment is template in any case, so hosts with few pages are extracted too. Elements and roles count
  as they are, names of classes and ids only if all their words say so (`footer-links`, not
  `social-history`); a name that can mean content too (`legal`, `share`) counts only for half
  of the page's words at most, and where nothing else is left names don't count at all. Readers' remarks go
  whatever they hold, and a form that a whole page is wrapped in stays.
* Of a page with a main that is the text, of one with articles these, with the headlines and paragraphs right before
  them, if they hold a third of the words that nothing marks (ABOUT); else, and of other pages, all that isn't template.

Pages are different if their texts outside links and outside what the pages mark differ. So copies of a
page, or of an article beside other menus and marked adverts, count once and neither make nor break
a template. Nothing counts before MIN_PAGES different pages of a host. All pages are read
and counted exactly, by 64-bit hashes in partial aggregates, so neither the length of pages nor the
order of rows bears on the outcome. Wrappers are sent to the pages if they are small in all; else
each meets its host's pages in a merge, for which large hosts are dealt into parts.

Text: character references are decoded, white space inside a block becomes one space, blocks are
joined by one line end in page order. Null or empty html, and pages without content, give the
empty string. A page with a null url belongs to the host with the empty name. Repeated rows are pages
like others; an empty table gives an empty one; other columns, whatever their names, are left out.
"""

from __future__ import annotations

import functools
import html as html_lib
import pickle
import re
from hashlib import blake2b

import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, join_hot, materialize

MIN_PAGES = 8
CONSTANT = 0.8
#: Share of the pages that have a menu's slot, and of the slot's words that lie in links.
MENU_PAGES = 0.9
MENU_LINKS = 0.8
#: Two trees with more pairs of nodes, and what lies deeper, are paired by labels alone.
MOST_PAIRS = 250_000
DEEPEST = 60
#: Bytes of seeds or wrappers that are sent to the pages at most.
SENT_BYTES = 32 << 20
#: Parts into which a host with more than its share of the pages is dealt.
PARTS = 64

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe xmp".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody tfoot thead tr ul".split())
#: Elements that are template wherever they stand; the first of them never hold text of the page at all.
SILENT = frozenset("script style noscript template iframe svg button select input textarea option object canvas audio video head title".split())
DROPPED = SILENT | frozenset("nav footer aside form dialog menu fieldset".split())
ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog form menu menubar".split())
#: Words of class and id names that mark template; those that can also name content; and words that say nothing beside them.
MARKS = frozenset(
    "nav navbar navigation menu menus menubar topbar footer footnav sidebar sidebars aside ad ads advert adverts advertisement advertising adsense promo promotion cookie cookies consent gdpr popup modal overlay newsletter subscribe subscription signup login comment comments commentlist disqus respond replies reply breadcrumb breadcrumbs pagination pager toolbar".split()
)
WEAK = frozenset("masthead header banner sponsor sponsored notice notices notification notifications share sharing social related recommended recommendations widget widgets copyright disclaimer legal skip search form".split())
NEUTRAL = frozenset("area articles bar block body bottom box button buttons col column container content desktop feed fixed global group icon icons inner item items left link links list main message mobile outer page panel policy posts primary right row secondary section site slot space sticky stories text thread top unit wrap wrapper zone".split())
#: Marks of readers' remarks, which go whatever they hold, short of a main.
REMARKS = frozenset("comment comments commentlist disqus respond replies reply".split())
#: What makes a form that holds most of a page the page's frame, and what belongs to an article right after it.
FRAMED = frozenset("article main p h1".split())
LEAD = frozenset("h1 h2 h3 p hgroup".split())
#: Share of a page's unmarked words that its articles must hold to be what the page is about; a main always is.
ABOUT = 1 / 3
#: A header of the article itself holds its title.
TITLE_MARKS = frozenset("article post entry story content page main".split())
#: Elements that end an open paragraph, and elements that end an open one of their own kind.
ENDS_P = BLOCK - {"body", "html", "caption", "tbody", "thead", "tfoot", "tr"}
P_WALLS = {"td", "th", "li", "div", "article", "section", "body", "blockquote", "main", "aside"}
SIBLINGS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table", "tbody", "thead", "tfoot"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}

# A quote that no white space, slash or end of the tag follows ends no value; a stray one is a character like others.
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"(?=[\s/>]|\Z)|'[^']*'(?=[\s/>]|\Z)|[\"'])*+)(?:>|\Z)", re.S)
_ATTR = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_JOIN = re.compile(r"[\W_\d]+")
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+")


def name_marks(names: str) -> frozenset[str]:
    """The marks among class and id names: a name counts if each of its words is one or says nothing, or if it is one when run together."""
    out = set()
    for name in names.split():
        words = [w.lower() for w in _WORDS.findall(name) if not w.isdigit()]
        joined = _JOIN.sub("", name.lower())
        if joined in MARKS or joined in WEAK:
            out.add(joined)
        found = [w for w in words if w in MARKS or w in WEAK]
        if found and all(w in MARKS or w in WEAK or w in NEUTRAL for w in words):
            if not (set(found) == {"header"} and TITLE_MARKS & set(words)):
                out.update(found)
    return frozenset(out)


NO_MARKS: frozenset[str] = frozenset()
#: What attributes that name an element must contain.
_NAMING = re.compile("class|id|role", re.I)


@functools.lru_cache(maxsize=1 << 12)
def _named(tag: str, attrs: str) -> tuple[frozenset[str], str]:
    """The marks and the label of an element."""
    marks, role, names = NO_MARKS, "", ""
    for m in _ATTR.finditer(attrs):
        k = m[1].lower()
        if k in ("class", "id"):
            names += " " + (m[2] or m[3] or m[4] or "")
        elif k == "role":
            role = (m[2] or m[3] or m[4] or "").strip().lower()
    if names:
        marks = name_marks(names)
    if role:
        marks |= {"role=" + role}
    # Digits are left out: they number instances.
    return marks, f"{tag}{re.sub(r'[0-9]+', '', names)}" if names else tag


class Node:
    __slots__ = ("tag", "marks", "label", "kids", "parts", "holds")

    def __init__(self, tag: str, attrs: str = ""):
        self.tag, self.kids, self.parts = tag, [], []
        #: Whether an article or main lies below.
        self.holds = False
        self.marks, self.label = _named(tag, attrs) if attrs and _NAMING.search(attrs) else (NO_MARKS, tag)

    def add(self, node: Node) -> None:
        self.kids.append(node)
        self.parts.append(node)


class Stack:
    """The open elements, the root first, and each tag's places among them, so no search walks a deep stack in vain."""

    def __init__(self, root: Node):
        self.nodes, self.places = [root], {}

    def push(self, node: Node) -> None:
        self.places.setdefault(node.tag, []).append(len(self.nodes))
        self.nodes.append(node)

    def cut(self, at: int) -> None:
        nodes, places = self.nodes, self.places
        while len(nodes) > at:
            places[nodes.pop().tag].pop()

    def last(self, tags: set[str]) -> int:
        """The place of the innermost open element with such a tag, or 0."""
        at, get = 0, self.places.get
        for t in tags:
            held = get(t)
            if held and held[-1] > at:
                at = held[-1]
        return at

    def close(self, tag: str) -> None:
        held = self.places.get(tag)
        if held:
            self.cut(held[-1])

    def end_open(self, tags: set[str], walls: set[str]) -> None:
        at = self.last(tags)
        if at and self.last(walls) < at:
            self.cut(at)


def parse(text: str) -> Node:
    """A tolerant tree builder of any depth; never fails, whatever the text."""
    root = Node("#root")
    stack, at, n = Stack(root), 0, len(text)
    while at < n:
        m = _TOKEN.search(text, at)
        if m is None:
            stack.nodes[-1].parts.append(text[at:])
            break
        if m.start() > at:
            stack.nodes[-1].parts.append(text[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            stack.close(tag)
            continue
        if tag in ENDS_P:
            stack.end_open({"p"}, P_WALLS)
        if tag in SIBLINGS:
            stack.end_open(*SIBLINGS[tag])
        node = Node(tag, m[3])
        stack.nodes[-1].add(node)
        if tag in ("article", "main"):
            for above in reversed(stack.nodes):
                if above.holds:
                    break
                above.holds = True
        if tag in RAW:
            end = re.compile(rf"</{tag}\s*>", re.I).search(text, at)
            node.parts.append(text[at : end.start() if end else n])
            at = end.end() if end else n
        elif tag not in VOID and not m[3].endswith("/"):
            stack.push(node)
    return root


def below(node: Node, tags: frozenset[str]) -> bool:
    """Whether an element of one of the tags lies below a node."""
    todo = list(node.kids)
    while todo:
        k = todo.pop()
        if k.tag in tags:
            return True
        todo.extend(k.kids)
    return False


def plain(node: Node) -> str:
    """All text below node, white space made single."""
    out: list[str] = []
    todo = [node]
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            out.append(x)
        elif x.tag not in DROPPED or x is node:
            todo.extend(reversed(x.parts))
            out.append(" ")
    return " ".join(html_lib.unescape("".join(out)).split())


# --- trees ----------------------------------------------------------------------------------------


def _hash(data: bytes) -> int:
    return int.from_bytes(blake2b(data, digest_size=8).digest(), "little")


@functools.lru_cache(maxsize=1 << 14)
def _shape(label: str, dense: bool, kids: tuple[int, ...]) -> int:
    return _hash(f"{label}\0{int(dense)}\0{','.join(map(str, kids))}".encode("utf-8", "replace"))


@functools.lru_cache(maxsize=1 << 14)
def _path(above: int, label: str) -> int:
    return _hash(above.to_bytes(8, "little") + label.encode("utf-8", "replace"))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _own(node: Node) -> tuple[str, int, list[Node]]:
    """The text of a block without the blocks below it, how many of its words lie in links, and those blocks."""
    if len(node.parts) == 1 and isinstance(node.parts[0], str):
        own = node.parts[0]
        return " ".join(html_lib.unescape(own).split()), len(own.split()) if node.tag == "a" else 0, []
    out, links, below = [], 0, []
    todo = [(p, node.tag == "a") for p in reversed(node.parts)]
    while todo:
        p, linked = todo.pop()
        if isinstance(p, str):
            out.append(p)
            if linked:
                links += len(p.split())
        elif p.tag in BLOCK:
            below.append(p)
        elif p.tag not in SILENT:
            out.append(" ")
            todo.extend((q, linked or p.tag == "a") for q in reversed(p.parts))
            out.append(" ")
    return " ".join(html_lib.unescape("".join(out)).split()), links, below


class Block:
    """A node of a page's folded tree."""

    __slots__ = ("label", "kids", "shape", "size", "index", "texts", "words", "links", "nodes", "quiet")

    def __init__(self, label: str):
        self.label, self.kids, self.shape, self.size, self.index = label, [], 0, 1, 0
        #: Hashes of the texts of the nodes that are folded here; words in all and words in links, also of what lies below.
        self.texts, self.words, self.links, self.nodes, self.quiet = [], 0, 0, [], False


def fold(root: Node) -> tuple[Block, set[int]]:
    """The tree of a page's blocks, neighbours of one shape folded into one; and the hashes of its texts outside links and marked nodes."""
    top = Block("#root")
    order, todo, said = [], [(root, top)], set()
    while todo:
        node, block = todo.pop()
        text, links, below = _own(node)
        block.nodes.append(node)
        block.words, block.links = len(text.split()), links
        if text:
            h = _hash(text.encode("utf-8", "replace"))
            block.texts.append((h, node))
            if not block.quiet and 2 * links < block.words:
                said.add(h)
        order.append(block)
        for k in below:
            b = Block(k.label)
            b.quiet = block.quiet or k.tag in DROPPED or k.tag == "header" or bool(k.marks)
            block.kids.append(b)
        todo.extend(zip(reversed(below), reversed(block.kids), strict=True))
    for b in reversed(order):
        if b.kids:
            kids: list[Block] = []
            for k in b.kids:
                if kids and kids[-1].shape == k.shape:
                    _merge(kids[-1], k)
                else:
                    kids.append(k)
            b.kids = kids
            for k in kids:
                b.size += k.size
                b.words += k.words
                b.links += k.links
        dense = b.words > 0 and b.links >= MENU_LINKS * b.words
        b.shape = _shape(b.label, dense, tuple([k.shape for k in b.kids]))
    return top, said


def _merge(a: Block, b: Block) -> None:
    """Fold b, of the same shape, into a."""
    todo = [(a, b)]
    while todo:
        x, y = todo.pop()
        x.texts += y.texts
        x.nodes += y.nodes
        x.words += y.words
        x.links += y.links
        todo.extend(zip(x.kids, y.kids, strict=True))


def number(top: Block) -> list[Block]:
    """All blocks in document order; each gets its index."""
    out, todo = [], [top]
    while todo:
        b = todo.pop()
        b.index = len(out)
        out.append(b)
        todo.extend(reversed(b.kids))
    return out


def skeleton(blocks: list[Block]) -> bytes:
    """Labels, shapes and sizes in document order: all that aligning needs."""
    return pickle.dumps([(b.label, b.shape, len(b.kids)) for b in blocks], protocol=5)


def rebuilt(data: bytes) -> Block:
    rows = pickle.loads(data)
    blocks = []
    for label, shape, _ in rows:
        b = Block(label)
        b.shape = shape
        blocks.append(b)
    waiting: list[list] = []
    for b, (_, _, n) in zip(blocks, rows, strict=True):
        if waiting:
            waiting[-1][0].kids.append(b)
            waiting[-1][1] -= 1
            while waiting and not waiting[-1][1]:
                waiting.pop()
        if n:
            waiting.append([b, n])
    for b in reversed(blocks):
        b.size = 1 + sum(k.size for k in b.kids)
    number(blocks[0])
    return blocks[0]


def match(a, b, label, kids, same=None, deep: int = DEEPEST, memo: dict | None = None) -> tuple[int, list[tuple[int, int]]]:
    """Simple tree matching of two forests: (matched nodes, index pairs of the children).

    a and b are child lists; label and kids read a node of either side. same: the size of two nodes'
    trees if they are equal, else 0. Below `deep` levels nodes count by themselves.
    """
    memo = {} if memo is None else memo
    m, n = len(a), len(b)
    if not m or not n:
        return 0, []
    la, lb = [label(x) for x in a], [label(x) for x in b]
    weight = []
    for i in range(m):
        row: list = []
        for j in range(n):
            if la[i] != lb[j]:
                row.append(None)
                continue
            key = (id(a[i]), id(b[j]))
            if key not in memo:
                w = same(a[i], b[j]) if same else 0
                ka, kb = kids(a[i]), kids(b[j])
                memo[key] = w or (1 + match(ka, kb, label, kids, same, deep - 1, memo)[0] if deep > 0 and ka and kb else 1)
            row.append(memo[key])
        weight.append(row)
    best = [[0] * (n + 1) for _ in range(m + 1)]
    for i in range(m):
        row, above, own = best[i + 1], best[i], weight[i]
        for j in range(n):
            x = above[j + 1] if above[j + 1] >= row[j] else row[j]
            w = own[j]
            if w is not None and above[j] + w > x:
                x = above[j] + w
            row[j + 1] = x
    pairs, i, j = [], m, n
    while i and j:
        w = weight[i - 1][j - 1]
        if w is not None and best[i][j] == best[i - 1][j - 1] + w:
            pairs.append((i - 1, j - 1))
            i, j = i - 1, j - 1
        elif best[i][j] == best[i - 1][j]:
            i -= 1
        else:
            j -= 1
    return best[m][n], pairs[::-1]


def _label(x) -> str:
    return x[0] if isinstance(x, tuple) else x.label


def _kids(x) -> list:
    return x[2] if isinstance(x, tuple) else x.kids


def align(a: Block, b: Block) -> dict[int, int]:
    """The index in tree b of the partner of each node of tree a that has one."""
    out, memo = {}, {}
    same = lambda x, y: x.size if x.shape == y.shape else 0
    ordered = a.size * b.size <= MOST_PAIRS
    todo = [(a, b, 0)]
    while todo:
        x, y, depth = todo.pop()
        if x.shape == y.shape:  # both are numbered in document order
            out.update((x.index + i, y.index + i) for i in range(x.size))
            continue
        out[x.index] = y.index
        if ordered and depth < DEEPEST:
            pairs = match(x.kids, y.kids, _label, _kids, same, DEEPEST - depth, memo)[1]
        else:
            held: dict[str, list[int]] = {}
            for j, k in enumerate(y.kids):
                held.setdefault(k.label, []).append(j)
            for js in held.values():
                js.reverse()
            pairs = [(i, held[k.label].pop() if len(held[k.label]) > 1 else held[k.label][0]) for i, k in enumerate(x.kids) if k.label in held]
        todo += [(x.kids[i], y.kids[j], depth + 1) for i, j in pairs]
    return out


def slots(top: Block, seed: Block | None) -> list[tuple[Block, int, bool]]:
    """Each block with its slot, and whether that is a node of the seed."""
    partner = align(top, seed) if seed is not None else {}
    out = []
    todo = [(top, 0)]
    while todo:
        b, path = todo.pop()
        path = _path(path, b.label)
        at = partner.get(b.index)
        out.append((b, path if at is None else at, at is not None))
        todo.extend((k, path) for k in b.kids)
    return out


def unit(slot: int, text: int) -> int:
    """One number for a text in a slot, or with text 0 for a slot as a menu."""
    x = (slot * 0x9E3779B97F4A7C15 + text * 0xC2B2AE3D27D4EB4F + 1) & (1 << 64) - 1
    x = ((x ^ x >> 29) * 0xBF58476D1CE4E5B9) & (1 << 64) - 1
    return _signed(x ^ x >> 32)


def is_menu(b: Block, words: int) -> bool:
    """Whether a block of a page of so many words is made of links and isn't most of the page."""
    return b.words > 0 and b.links >= MENU_LINKS * b.words and 2 * b.words < words


class Wrapper:
    """What a host's pages share: the seed, and the units that are template."""

    def __init__(self, seed: bytes, units):
        self.seed, self.units = rebuilt(seed), frozenset(units)

    def template(self, root: Node) -> tuple[set[int], set[int]]:
        """id() of the page's nodes whose own texts are template, and of those that are menus as a whole."""
        top, _ = fold(root)
        number(top)
        texts, menus = set(), set()
        for b, slot, matched in slots(top, self.seed):
            texts.update(id(node) for h, node in b.texts if unit(slot, h) in self.units)
            if matched and is_menu(b, top.words) and unit(slot, 0) in self.units:
                menus.update(map(id, b.nodes))
        return texts, menus


# --- extraction -----------------------------------------------------------------------------------


class Page:
    """Decides what the page itself marks as template."""

    def __init__(self, root: Node, names: bool = True):
        self.root, self.names, self.total = root, names, -1
        self.frames: dict[int, bool] = {}
        self.above: dict[int, Node] = {}

    def marked(self, node: Node, inside: bool) -> bool:
        """inside: in an article or main."""
        if node.tag == "form":
            return not self.is_frame(node)
        if node.tag in DROPPED:
            return True
        if node.tag in ("article", "main", "body", "html"):
            return bool(node.tag == "article" and node.marks & (REMARKS | {"ad", "advert", "related", "promo"}))
        if node.tag == "header":
            return not inside
        if self.names and node.marks & REMARKS and not (node.holds and below(node, frozenset(["main"]))):
            return True
        if not node.marks or node.holds:
            return False
        if any(m.startswith("role=") and m[5:] in ROLES for m in node.marks):
            return True
        if not self.names or inside and node.marks <= {"header"}:
            return False
        if node.marks & MARKS:
            return True
        return bool(node.marks & WEAK) and 2 * len(plain(node).split()) <= self.words()

    def is_frame(self, form: Node) -> bool:
        """Whether a form is what a whole page is wrapped in: more words lie in it than outside, and paragraphs, a headline or an article."""
        if id(form) not in self.frames:
            self.frames[id(form)] = len(plain(form).split()) > self.words() and below(form, FRAMED)
        return self.frames[id(form)]

    def lead(self, region: Node) -> list[Node]:
        """Headlines and paragraphs right before a region."""
        above = self.above[id(region)].kids
        found: list[Node] = []
        for k in reversed(above[: next(i for i, x in enumerate(above) if x is region)]):
            if k.tag not in LEAD or self.marked(k, False):
                break
            found.insert(0, k)
        return found

    def words(self) -> int:
        if self.total < 0:
            self.total = len(plain(self.root).split())
        return self.total

    def regions(self, node: Node) -> list[Node]:
        """The outermost articles and mains below a node."""
        found, todo = [], [(k, node) for k in node.kids[::-1]]
        while todo:
            k, above = todo.pop()
            if self.marked(k, False):
                continue
            if k.tag in ("article", "main") or "role=main" in k.marks:
                found.append(k)
                self.above[id(k)] = above
            else:
                todo.extend((x, k) for x in reversed(k.kids))
        return found

    def content(self, texts: set[int], menus: set[int]) -> str:
        regions = self.regions(self.root)
        about = any(r.tag != "article" for r in regions)
        for i, r in enumerate(regions):  # an article within main is what main is about
            inner = self.regions(r)
            if r.tag != "article" and inner:
                regions[i : i + 1] = inner
        if not regions:
            return "\n".join(self.blocks([self.root], False, texts, menus))
        said = self.blocks([*self.lead(regions[0]), *regions], True, texts, menus)
        if about:
            return "\n".join(said)
        # Articles beside a longer story, such as a teaser, aren't what the page is about.
        whole = self.blocks([self.root], False, texts, menus)
        size = lambda blocks: sum(len(b.split()) for b in blocks)
        return "\n".join(said if size(said) >= ABOUT * size(whole) else whole)

    def blocks(self, regions: list[Node], inside: bool, texts: set[int], menus: set[int]) -> list[str]:
        """The texts of regions, block by block, without what is template."""
        blocks: list[str] = []
        buffer: list[str] = []

        def flush() -> None:
            if buffer:
                text = " ".join(html_lib.unescape("".join(buffer)).split())
                if text:
                    blocks.append(text)
                buffer.clear()

        def walk(region: Node, inside: bool) -> None:
            todo: list[tuple] = []

            def enter(node: Node, skip: bool) -> None:
                # Inline elements are a part of their block's text.
                skip = id(node) in texts if node.tag in BLOCK or node is region else skip
                todo.extend([(p, skip) for p in reversed(node.parts)])

            enter(region, False)
            while todo:
                p, skip = todo.pop()
                if p is None:  # a block ends
                    flush()
                elif isinstance(p, str):
                    if not skip:
                        buffer.append(p)
                elif id(p) in menus or self.marked(p, inside):
                    if p.tag in BLOCK:
                        flush()
                    else:
                        buffer.append(" ")
                elif p.tag in BLOCK:
                    flush()
                    todo.append((None, False))
                    enter(p, False)
                else:
                    if p.tag in ("br", "td", "th"):
                        buffer.append(" ")
                    if p.tag in ("td", "th"):
                        todo.append((" ", False))
                    enter(p, skip)

        for r in regions:
            walk(r, inside)
            flush()
        return blocks


def extract_page(html: str | None, wrapper: Wrapper | None = None) -> str:
    """The text of a page, by the wrapper of its host if there is one."""
    if not html:
        return ""
    root = parse(html)
    texts, menus = wrapper.template(root) if wrapper else (set(), set())
    return Page(root).content(texts, menus) or Page(root, names=False).content(texts, menus)


# --- tables ---------------------------------------------------------------------------------------


def _host(url: str) -> Column:
    host = F.when(F.instr(url, "://") > 0, F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).otherwise("")
    return F.coalesce(host, F.lit(""))


TREES = "host bigint, name string, page bigint, shape bigint, nodes int, skeleton binary, facts binary"


def page_trees(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """Of each page that isn't empty its host, what tells it from other pages, its shape and skeleton, and its texts."""

    def read(batches):
        for batch in batches:
            rows: list[list] = [[], [], [], [], []]
            for h in batch.column(2).to_pylist():
                top, said = fold(parse(h))
                blocks = number(top)
                facts = ([[x for x, _ in b.texts] for b in blocks], [is_menu(b, top.words) for b in blocks])
                page = _signed(_hash(b"".join(x.to_bytes(8, "little") for x in sorted(said))))
                for c, v in zip(rows, (page, _signed(top.shape), len(blocks), skeleton(blocks), pickle.dumps(facts, protocol=5)), strict=True):
                    c.append(v)
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary())
            yield pa.record_batch([batch.column(0), batch.column(1), *[pa.array(c, t) for c, t in zip(rows, kinds, strict=True)]], names=[x.split(" ")[0] for x in TREES.split(", ")])

    host = _host(url)
    return pages.where(F.col(html) != "").select(F.xxhash64(host).alias("host"), host.alias("name"), html).mapInArrow(read, TREES)


def page_facts(skeleton: bytes, facts: bytes, seed: Block) -> list[tuple[int, bool]]:
    """(unit, whether it is a menu) of a page, by its host's seed."""
    texts, menus = pickle.loads(facts)
    out = set()
    for b, slot, matched in slots(rebuilt(skeleton), seed):
        out.update((unit(slot, h), False) for h in texts[b.index])
        if matched and menus[b.index]:
            out.add((unit(slot, 0), True))
    return sorted(out)


class _Sent:
    """Wrappers by host from a broadcast table; the last ones used are kept ready."""

    def __init__(self, rows: dict[int, tuple[bytes, list[int]]]):
        self.rows, self.ready = rows, {}

    def __call__(self, host: int) -> Wrapper | None:
        if host not in self.rows:
            return None
        if host not in self.ready:
            if len(self.ready) > 256:
                self.ready.clear()
            self.ready[host] = Wrapper(*self.rows[host])
        return self.ready[host]


def with_wrapper(rows: DataFrame, wrappers: DataFrame, hosts: DataFrame, work, schema: str) -> DataFrame:
    """What work(batch, the wrapper or None of each of its rows) makes of rows, whose first column is host.

    wrappers: host, seed and units, one row for each host; sent if they are small in all, else merged
    with the rows host by host, where hosts with more than a thousandth of all pages are dealt into parts.
    """
    spark = rows.sparkSession
    size = wrappers.agg(F.coalesce(F.sum(F.length("seed") + 8 * F.size("units") + 64), F.lit(0))).first()[0]
    if size <= SENT_BYTES:
        sent = spark.sparkContext.broadcast({r["host"]: (bytes(r["seed"]), list(r["units"])) for r in wrappers.select("host", "seed", "units").toLocalIterator()})

        def look_up(batches):
            get = _Sent(sent.value)
            for batch in batches:
                yield work(batch, [get(h) for h in batch.column(0).to_pylist()])

        return rows.mapInArrow(look_up, schema)

    total = hosts.agg(F.sum("pages")).first()[0] or 0
    hot = [r["host"] for r in hosts.where(F.col("pages") > total / 1000).select("host").collect()]
    is_hot = F.col("host").isin(hot) if hot else F.lit(False)
    given = [c for c in rows.columns if c != "host"]
    part = F.when(is_hot, F.pmod(F.xxhash64(*given), F.lit(PARTS).cast("bigint"))).otherwise(F.lit(0).cast("bigint"))
    mine = rows.select("host", *given, part.alias("_part"), F.lit(1).alias("_kind"), F.lit(None).cast("binary").alias("_seed"), F.lit(None).cast("array<bigint>").alias("_units"))
    dealt = F.explode(F.when(is_hot, F.sequence(F.lit(0).cast("bigint"), F.lit(PARTS - 1).cast("bigint"))).otherwise(F.array(F.lit(0).cast("bigint"))))
    theirs = wrappers.select("host", *[F.lit(None).cast(dict(rows.dtypes)[c]).alias(c) for c in given], dealt.alias("_part"), F.lit(0).alias("_kind"), F.col("seed").alias("_seed"), F.col("units").alias("_units"))
    both = mine.unionByName(theirs).repartition("host", "_part").sortWithinPartitions("host", "_part", "_kind")

    def merge(batches):
        held, now = (None, None), None
        for batch in batches:
            n = len(given) + 1
            ready = []
            for host, part, kind, seed, units in zip(*(batch.column(c).to_pylist() for c in (0, n, n + 1, n + 2, n + 3)), strict=True):
                if held != (host, part):
                    held, now = (host, part), None
                if kind == 0:
                    now = Wrapper(seed, units)
                else:
                    ready.append(now)
            yield work(batch.filter(pa.compute.equal(batch.column(n + 1), 1)).select(list(range(n))), ready)

    return both.mapInArrow(merge, schema)


def induce(pages: DataFrame, url: str = "url", html: str = "html") -> tuple[DataFrame, DataFrame]:
    """(wrappers: host, name, seed and units of each host that has a template; hosts: host, name and pages), both written."""
    trees = materialize(page_trees(pages, url, html), "trees")
    hosts = materialize(trees.groupBy("host").agg(F.min("name").alias("name"), F.countDistinct("page").alias("pages")).where(F.col("pages") >= MIN_PAGES), "hosts")
    # Trees of one shape have one skeleton, so any is the first.
    shapes = trees.groupBy("host", "shape").agg(F.countDistinct("page").alias("n"), F.first("nodes").alias("nodes"), F.first("skeleton").alias("skeleton"))
    seeds = shapes.groupBy("host").agg(F.max_by("skeleton", F.struct("n", "nodes", "shape")).alias("seed")).join(hosts, "host")
    seeds = materialize(seeds.select("host", "name", "seed", F.array().cast("array<bigint>").alias("units")), "seeds")

    def facts(batch, ready):
        at, rows = [], []
        for k, (w, s, f) in enumerate(zip(ready, batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)):
            if w is not None:
                found = page_facts(s, f, w.seed)
                at += [k] * len(found)
                rows += found
        cols = list(zip(*rows, strict=True)) or [()] * 2
        at = pa.array(at, pa.int64())
        return pa.record_batch([batch.column(0).take(at), batch.column(3).take(at), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.bool_())], names=["host", "page", "unit", "menu"])

    seen = with_wrapper(trees.select("host", "skeleton", "facts", "page"), seeds, hosts, facts, "host bigint, page bigint, unit bigint, menu boolean").distinct()
    seen = materialize(seen.groupBy("host", "unit", "menu").agg(F.count("*").alias("seen")).where(F.col("seen") >= MIN_PAGES), "seen")
    counted = join_hot(seen, hosts.select("host", "pages", F.col("pages").alias("_n")), "host", "_n", seen.count())
    units = counted.where(F.col("seen") >= F.when(F.col("menu"), MENU_PAGES).otherwise(CONSTANT) * F.col("pages")).groupBy("host").agg(F.collect_list("unit").alias("units"))
    wrappers = materialize(seeds.drop("units").join(units, "host"), "wrappers")
    discard(trees, seeds, seen)
    return wrappers, hosts


def wrappers(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """host, name, seed (a tree) and units (its constant texts and menus) of each host that has a template."""
    return induce(pages, url, html)[0]


def extract(pages: DataFrame, url: str = "url", html: str = "html", key: str = "page_id") -> DataFrame:
    """key, url and text of each row of pages, by the wrappers induced from all of them."""
    found, hosts = induce(pages, url, html)
    rows = pages.select(F.xxhash64(_host(url)).alias("host"), F.col(key).alias("_key"), F.col(url).alias("_url"), F.col(html).alias("_html"))

    def text(batch, ready):
        out = [extract_page(h, w) for h, w in zip(batch.column(3).to_pylist(), ready, strict=True)]
        return pa.record_batch([batch.column(1), batch.column(2), pa.array(out, pa.string())], names=["key", "url", "text"])

    kind = dict(pages.dtypes)[key]
    return with_wrapper(rows, found, hosts, text, f"key {kind}, url string, text string").withColumnRenamed("key", key).withColumnRenamed("url", url)
