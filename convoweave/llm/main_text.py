"""Main text of web pages by wrapper induction.

Pages of one host and layout (the frame tags that a page uses) share a template. The smallest of them is the reference:
its DOM tree, in which alike siblings in a row are one repeated node. Every page is aligned with its reference by simple
tree matching, the largest order-keeping match of two trees with the same root. A text stands at the reference node its
element is matched with, or at the path below the nearest matched one. Over all different pages of the group, texts that
stand at the same place on CONSTANT of the pages are template; all others are what varies. The wrapper is the reference
with its template texts, and with the region that holds what varies: from the root down, while one frame holds SHARE of
the varying text that is no link, the frame that does; varying headings before it belong to it. A page's content is what
varies in its nodes that the region is matched with, without repeated nodes that vary in links alone.

Tags and marks (class, id, role) serve where varying slots alone cannot tell. Inside the region elements that hold no text
(scripts, styles) go, forms, menus, asides and footers by their tags, and boxes whose class, id or role is a mark, like
`comments`, or has one of a few plain words at its begin or end, like `ad-slot`; headings, paragraphs and boxes with other compound names
stay, as do formulas and drawings' texts. `<article>` or `<main>` is the region where no frame holds SHARE of the varying
text, or no wrapper is known; without these the whole page is, and every word of a compound mark counts.

What each case yields: a host with two or more different pages of a layout has a wrapper of its own. Of fewer than FEW pages
it holds only if more of their text varies than not, since else they are rather copies of one text than pages of one template.
Hosts with one page of a layout tell no template; those of a layout are taken together, and give one by the same rule.
Without a wrapper tags and marks decide. Only digests and lengths of texts are shuffled, and aggregated first. Equal
pages count once. Wrappers are small; they are broadcast if their measured size allows, else joined by salted keys.

Matching takes time by the product of the different subtrees of page and reference with the same key (equal subtrees match as
they are, rows of children with few partners are chained pair by pair, others aligned by numpy), so long lists are cheap, also
with ids of their own, and only pages of many unlike parts with the same tag and marks are dear.

Defined results: null and empty html give an empty text; broken, unclosed or nested markup is read as far as it
goes, at any depth; near copies count as different pages; repeated rows give repeated results; extra columns are ignored.
"""

from __future__ import annotations

import json
import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache
from hashlib import blake2b
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from convoweave.llm.rows import salted_join, slices, small_or_shuffled
from convoweave.llm.url_filter import host_of
from convoweave.session import cut, table

FEW, CONSTANT, SHARE, LINKS = 4, 0.8, 0.6, 0.8
CELLS = 1 << 22  # of a matrix that is held whole; larger ones are halved
SPARSE = 8  # pairs a node, up to which rows are matched pair by pair

#: HTML elements by how they are read.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = "script|style|textarea|title|noscript|iframe|template|xmp"
BLOCKS = set("""address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form
h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul""".split())
SILENT = set("""head title script style noscript template iframe object canvas audio video button select textarea input label dialog
datalist form""".split())
ASIDE = set("nav menu aside footer".split())
FRAMES = set("html body div section article main header footer aside nav center table tbody tr td".split())
HEADINGS = set("h1 h2 h3 h4 h5 h6".split())
BOXES = set("div section article aside header footer nav menu ul ol dl table center details figure fieldset ins".split())
#: Words in class, id or role that mark what is not main text.
MARKS = set("""ad ads adv advert adverts advertisement advertising adsense banner banners sponsor sponsored promo promotion cookie cookies consent gdpr
notice notices alert popup modal overlay newsletter subscribe subscription signup login sidebar aside widget menu nav navbar navigation
breadcrumb breadcrumbs header masthead topbar toolbar footer bottombar share sharing social related recommended comment comments commentlist
disqus reply replies search form pagination pager skip complementary contentinfo dialog""".split())
#: Words of compound marks (ad-slot, reader_comments) that say what a box is, and what stands with them in ids.
STRONG = set("ad ads advert adverts advertisement adsense sponsored cookie cookies newsletter comment comments disqus share sharing social sidebar breadcrumb breadcrumbs".split())
PARTS = set("area banner bar block box buttons container form links list section slot thread unit widget wrapper".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: A token never reaches over the next `<` outside quotes, and never goes back, so broken markup costs no more than sound.
INSIDE = r"""((?:[^<>"']|"[^"]*+"|'[^']*+')*+)"""
TOKEN = re.compile(rf"<!--.*?(?:-->|\Z)|<({RAW})(?=[\s/>]){INSIDE}>(?:.*?</\1\s*>|.*\Z)|<(/?)([a-zA-Z][^\s/<>]*+){INSIDE}>|<[!?][^<>]*+>|[^<]+|<", re.S | re.I)
ATTRIBUTE = re.compile(r"""(?:\A|\s)(class|id|role|hidden)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?(?=\s|/|\Z)""", re.I)
MARKED = re.compile(r"(class|id|role)=(.*?)(?=\s(?:class|id|role|hidden)=|\Z)", re.S)
LAYOUT = "<(div|section|article|main|header|nav|aside|footer)[\\s/>]"


class Node:
    """An element: its tag, its marks (class, id and role), and its children, elements and texts in page order.

    `shape` tells apart subtrees of different keys, and `runs` are the children, alike ones in a row being one run.
    """

    __slots__ = ("children", "height", "key", "marks", "runs", "shape", "size", "tag")

    def __init__(self, tag: str, marks: str = ""):
        self.tag, self.marks, self.children = tag, marks, []

    @property
    def elements(self) -> list[Node]:
        return [c for c in self.children if not isinstance(c, str) and c.tag not in SILENT]

    def own_text(self) -> str:
        return squeeze(" ".join(c for c in self.children if isinstance(c, str)))


def squeeze(text: str) -> str:
    return " ".join(text.split())


def parse(html: str | None) -> Node:
    """The DOM tree of a page, as a browser would roughly build it."""
    root = Node("#page")
    stack = [root]
    blocks: list[int] = []  # places in the stack of blocks
    opened: dict[str, list[int]] = {}  # and of each tag

    def close(k: int) -> None:
        while len(stack) > k:
            tag = stack.pop().tag
            opened[tag].pop()
            if tag in BLOCKS:
                blocks.pop()

    for m in TOKEN.finditer(html or ""):
        raw, _, closing, tag, rest = m.groups()
        if tag:
            tag = tag.lower()
            if closing:
                if opened.get(tag):
                    close(opened[tag][-1])
                continue
            marks = " ".join(f"{n.lower()}={a or b or c}" for n, a, b, c in ATTRIBUTE.findall(rest)) if rest.strip(" /") else ""
            if tag in BLOCKS and blocks:  # a block ends an open paragraph, and some blocks end their like
                nearest = stack[blocks[-1]].tag
                if nearest == "p" or nearest in CLOSES.get(tag, ()):
                    close(blocks[-1])
            node = Node(tag, marks)
            stack[-1].children.append(node)
            if tag not in VOID and not rest.endswith("/"):
                opened.setdefault(tag, []).append(len(stack))
                if tag in BLOCKS:
                    blocks.append(len(stack))
                stack.append(node)
        elif raw:
            stack[-1].children.append(Node(raw.lower()))
        elif not m[0].startswith("<") or m[0] == "<":
            stack[-1].children.append(unescape(m[0]))
    return root


def below(node: Node) -> Iterator[Node]:
    """A node and the elements in it, in page order."""
    todo = [node]
    while todo:
        node = todo.pop()
        yield node
        todo += reversed(node.elements)


def shaped(tree: Node) -> Node:
    """The tree, with key, shape, runs, size and height of every element."""
    for node in reversed(list(below(tree))):
        node.runs = []
        for c in node.elements:
            if node.runs and node.runs[-1][0].shape == c.shape:
                node.runs[-1].append(c)
            else:
                node.runs.append([c])
        node.key = node.tag, node.marks and re.sub(r"\d+", "0", node.marks)
        node.shape = hash((node.key, *(r[0].shape for r in node.runs)))
        node.size = 1 + sum(r[0].size for r in node.runs)
        node.height = 1 + max((r[0].height for r in node.runs), default=0)
    return tree


def aligned(weights: np.ndarray, a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """The order-keeping pairs of places of a and b of the largest total weight; weights[x, y] is that of a kind x with a kind y."""
    pairs, todo = [], [(0, len(a), 0, len(b))]
    while todo:
        i, k, j, m = todo.pop()
        if i == k or j == m:
            continue
        left, right = weights[a[i:k]], b[j:m]
        if k - i > 1 and (k - i) * (m - j) > CELLS:  # halve the rows where both halves together weigh most
            half = (k - i) // 2
            up, down = totals(left[:half], right), totals(left[: half - 1 : -1], right[::-1])[::-1]
            at = int((up + down).argmax())
            todo += [(i, i + half, j, j + at), (i + half, k, j + at, m)]
            continue
        best = np.zeros((k - i + 1, m - j + 1), np.int64)
        for r, row in enumerate(left):
            best[r + 1, 1:] = np.maximum.accumulate(np.maximum(best[r, 1:], best[r, :-1] + row[right]))
        r, c = k - i, m - j
        while r and c:
            w = left[r - 1, right[c - 1]]
            if w and best[r, c] == best[r - 1, c - 1] + w:
                pairs.append((i + r - 1, j + c - 1))
                r, c = r - 1, c - 1
            elif best[r, c] == best[r - 1, c]:
                r -= 1
            else:
                c -= 1
    return sorted(pairs)


def in_order(left: list[Node], right: list[Node], known: dict[tuple[int, int], tuple[int, list]]) -> list[tuple[int, int]]:
    """The order-keeping pairs of places of two rows of nodes of the largest total weight, those of pairs of shapes in `known`.

    Nodes without a partner of their key leave first. Where few pairs are left (as where siblings have ids of their own) they
    are chained one by one, else the rows are aligned by a matrix of their kinds.
    """
    places_of: dict = {}
    for m, q in enumerate(right):
        places_of.setdefault(q.key, []).append(m)
    keys = {p.key for p in left}
    a = [k for k, p in enumerate(left) if p.key in places_of]
    b = [m for m, q in enumerate(right) if q.key in keys]
    if sum(len(places_of[left[k].key]) for k in a) <= SPARSE * (len(a) + len(b)):
        return chained((k, m, known[left[k].shape, right[m].shape][0]) for k in a for m in reversed(places_of[left[k].key]))
    rows, columns = ({s: k for k, s in enumerate(dict.fromkeys(n[k].shape for k in at))} for n, at in ((left, a), (right, b)))
    weights = np.zeros((len(rows), len(columns)), np.int32)
    partners: dict = {}
    for q in {right[m].shape: right[m] for m in b}.values():
        partners.setdefault(q.key, []).append(q.shape)
    for p in {left[k].shape: left[k] for k in a}.values():
        weights[rows[p.shape], [columns[q] for q in partners[p.key]]] = [known[p.shape, q][0] for q in partners[p.key]]
    found = aligned(weights, np.array([rows[left[k].shape] for k in a]), np.array([columns[right[m].shape] for m in b]))
    return [(a[k], b[m]) for k, m in found]


def chained(points: Iterator[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """Of points (row, column, weight), by row and falling column, the chain of rising rows and columns of the largest weight.

    A chain's end is kept while no chain that ends earlier weighs as much, so that the best one before a column is found by bisection.
    """
    columns: list[int] = []
    weights: list[int] = []
    ends: list[tuple] = []  # linked lists of points
    for row, column, weight in points:
        at = bisect_left(columns, column)
        total, chain = weight + (weights[at - 1] if at else 0), (row, column, ends[at - 1] if at else None)
        if at < len(columns) and columns[at] == column and weights[at] >= total:
            continue
        last = at
        while last < len(columns) and weights[last] <= total:
            last += 1
        columns[at:last], weights[at:last], ends[at:last] = [column], [total], [chain]
    chain, found = ends[-1] if ends else None, []
    while chain:
        found.append(chain[:2])
        chain = chain[2]
    return found[::-1]


def totals(rows: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The largest total weight of all rows with each beginning of `right`."""
    best = np.zeros(len(right) + 1, np.int64)
    for row in rows:
        best[1:] = np.maximum.accumulate(np.maximum(best[1:], best[:-1] + row[right]))
    return best


def matched(a: Node, b: Node) -> dict[tuple[int, int], tuple[int, list[tuple[int, int]]]]:
    """Simple tree matching of two shaped trees with the same key: of each pair of shapes that it needs, the size of the
    largest match and the pairs of runs in it."""
    need, todo = {(a.shape, b.shape): (a, b)}, [(a, b)]
    while todo:
        x, y = todo.pop()
        if x.shape == y.shape:
            continue
        kinds: dict = {}
        for r in y.runs:
            kinds.setdefault(r[0].key, {})[r[0].shape] = r[0]
        for p in {r[0].shape: r[0] for r in x.runs}.values():
            for q in kinds.get(p.key, {}).values():
                if (p.shape, q.shape) not in need:
                    need[p.shape, q.shape] = p, q
                    todo.append((p, q))
    known: dict[tuple[int, int], tuple[int, list[tuple[int, int]]]] = {}
    for (s, t), (x, y) in sorted(need.items(), key=lambda item: item[1][0].height):
        if s == t:
            known[s, t] = x.size, []  # as they are
            continue
        left, right = ([r[0].shape for r in n.runs] for n in (x, y))
        start = end = 0
        while start < min(len(left), len(right)) and left[start] == right[start]:
            start += 1
        while end < min(len(left), len(right)) - start and left[-1 - end] == right[-1 - end]:
            end += 1
        pairs = [(k, k) for k in range(start)]
        inner, other = ([r[0] for r in n.runs[start : len(n.runs) - end]] for n in (x, y))
        pairs += [(start + k, start + m) for k, m in in_order(inner, other, known)] if inner and other else []
        pairs += [(len(left) - end + k, len(right) - end + k) for k in range(end)]
        known[s, t] = 1 + sum(known[left[k], right[m]][0] for k, m in pairs), pairs
    return known


def places(page: Node, reference: Node, order: dict[int, int]) -> dict[int, int]:
    """By id of each element of a page that is matched: the place of its reference node."""
    if shaped(page).key != reference.key:
        return {}
    known, found, todo = matched(page, reference), {}, [(page, reference)]
    while todo:
        x, y = todo.pop()
        found[id(x)] = order[id(y)]
        pairs = known[x.shape, y.shape][1] if x.shape != y.shape else [(k, k) for k in range(len(x.runs))]
        todo += [(c, y.runs[m][0]) for k, m in pairs for c in x.runs[k]]
    return found


def number(data: bytes) -> int:
    return int.from_bytes(blake2b(data, digest_size=8).digest(), "little", signed=True)


def standing(page: Node, found: dict[int, int]) -> Iterator[tuple[Node, int, bool, int | None]]:
    """Elements in page order: each with the place of the nearest matched one, whether it stands in a link, and a digest
    of where it stands and its own text (null if it has none)."""
    todo = [(page, 0, b"", False)]
    while todo:
        node, place, path, link = todo.pop()
        here = found.get(id(node))
        place, path = (place, path + b"/" + node.tag.encode("utf-8", "surrogatepass")) if here is None else (here, b"")
        if len(path) > 64:
            path = blake2b(path, digest_size=8).digest()
        link = link or node.tag == "a"
        text = node.own_text()
        yield node, place, link, number(b"%d%b\n%b" % (place, path, text.encode("utf-8", "surrogatepass"))) if text else None
        todo += [(c, place, path, link) for c in reversed(node.elements)]


def unwanted(node: Node) -> bool:
    """Whether an element says that it is a menu, an advert or the like: the rule where no region is known."""
    if node.tag in SILENT or node.tag in ASIDE:
        return True
    if not node.marks or node.tag in ("html", "body", "article", "main"):
        return False
    return not MARKS.isdisjoint(re.split(r"[^a-z0-9]+", node.marks.lower())) or "hidden=" in node.marks


def unwanted_inside(node: Node) -> bool:
    """The same inside a region: boxes alone, by a whole class, id or role that is a mark, or by a compound one.

    A compound class of up to three words counts if it begins or ends with a STRONG word; a compound id, which may be a heading's words,
    only if a STRONG word and PARTS or digits are all it has.
    """
    if node.tag in SILENT or node.tag in ASIDE or "hidden=" in node.marks:
        return True
    if not node.marks or node.tag not in BOXES:
        return False
    for kind, value in MARKED.findall(node.marks.lower()):
        for name in value.split():
            words = [w for w in re.split(r"[^a-z0-9]+", name) if w]
            if len(words) == 1 and words[0] in MARKS:
                return True
            if kind == "class" and 1 < len(words) < 4 and (words[0] in STRONG or words[-1] in STRONG):
                return True
            if kind == "id" and len(words) > 1 and words[0] in STRONG and all(w in PARTS or w.isdigit() for w in words[1:]):
                return True
    return False


def packed(html: str | None) -> str:
    """A page as reference, as JSON: the tag, marks and parent of each node in page order, of a run the first alone."""
    nodes, todo = [], [(shaped(parse(html)), -1)]
    while todo:
        node, parent = todo.pop()
        todo += [(r[0], len(nodes)) for r in reversed(node.runs)]
        nodes.append([node.tag, node.marks, parent])
    return json.dumps(nodes, ensure_ascii=False)


@lru_cache(maxsize=512)
def unpacked(reference: str) -> tuple[list[Node], dict[int, int], list[int]]:
    """The nodes of a reference in page order, their places by id, and their parents."""
    nodes, parents = [], []
    for tag, marks, parent in json.loads(reference):
        nodes.append(Node(tag, marks))
        parents.append(parent)
        if parent >= 0:
            nodes[parent].children.append(nodes[-1])
    shaped(nodes[0])
    return nodes, {id(n): k for k, n in enumerate(nodes)}, parents


def told(html: str | None, reference: str) -> tuple[bytes, list[tuple[int, int, int, int]]]:
    """A digest of all texts of a page, and of each different one that stands somewhere: its digest, the place, its length outside
    and inside links."""
    page = parse(html)
    nodes, order, _ = unpacked(reference)
    texts = {}
    for node, place, link, digest in standing(page, places(page, nodes[0], order)):
        if digest is not None:
            n = len(node.own_text())
            texts[digest] = (digest, place, 0, n) if link else (digest, place, n, 0)
    return blake2b(b"".join(d.to_bytes(8, "little", signed=True) for d in sorted(texts)), digest_size=16).digest(), list(texts.values())


def wrapper(reference: str, constants: list[int], varying: dict[int, tuple[int, int]]) -> str:
    """The wrapper, as JSON: the reference, digests of the template's texts, the places of the region and of slots that vary in links alone.

    varying: by place the lengths of varying texts outside and inside links, summed over pages.
    """
    nodes, _, parents = unpacked(reference)
    plain, link = ([varying.get(k, (0, 0))[j] for k in range(len(nodes))] for j in range(2))
    mute = [unwanted(n) for n in nodes]
    children: list[list[int]] = [[] for _ in nodes]
    for k in range(1, len(nodes)):
        mute[k] = mute[k] or mute[parents[k]]
        children[parents[k]].append(k)
    for k in range(len(nodes) - 1, 0, -1):
        if mute[k]:
            plain[k] = 0
        plain[parents[k]] += plain[k]
        link[parents[k]] += link[k]
    region, heads = 0, []
    while True:
        frames = [k for k in children[region] if nodes[k].tag in FRAMES]
        best = max(frames, key=plain.__getitem__, default=None)
        if best is None or not plain[best] or plain[best] < SHARE * plain[region]:
            break
        heads += [k for k in children[region] if k < best and nodes[k].tag in HEADINGS and plain[k]]
        region = best
    top = [] if nodes[region].tag in ("#page", "html", "body") and any(n.tag in ("article", "main") for n in nodes) else [*heads, region]
    menus = [k for k in range(1, len(nodes)) if nodes[k].tag in BLOCKS and link[k] and link[k] >= LINKS * (link[k] + plain[k]) and children[k] and k not in top]
    return json.dumps([reference, sorted(constants), top if plain[0] else [], menus], ensure_ascii=False)


@lru_cache(maxsize=512)
def known_wrapper(text: str) -> tuple[str, frozenset[int], frozenset[int], frozenset[int]]:
    reference, *sets = json.loads(text)
    return reference, *map(frozenset, sets)


def main_text(html: str | None, rule: str = "") -> str:
    """The content blocks of a page, joined by two line ends. rule: the wrapper of its group, if one is known."""
    page = parse(html)
    region, template, menus, drop = [], set(), set(), unwanted_inside
    if rule:
        reference, constants, top, links = known_wrapper(rule)
        nodes, order, _ = unpacked(reference)
        found = places(page, nodes[0], order)
        template = {id(node) for node, _, _, digest in standing(page, found) if digest in constants}
        menus = {k for k, place in found.items() if place in links}
        region = outermost(page, lambda c: found.get(id(c)) in top, lambda c: False)
    if not region:
        articles = outermost(page, lambda c: c.tag in ("article", "main") or "role=main" in c.marks, unwanted)
        inner = [a for x in articles if x.tag == "main" for a in outermost(x, lambda c: c.tag == "article", unwanted)]  # an article says more than main
        region = inner or articles
    if not region:
        region, drop = [page], unwanted
    blocks, line = [], []

    def end() -> None:
        text = squeeze("".join(line))
        line.clear()
        if text:
            blocks.append(text)

    for top in region:
        todo: list[Node | str | None] = [top]  # None: a block ends
        while todo:
            c = todo.pop()
            if c is None:
                end()
            elif isinstance(c, str):
                line.append(c)
            elif c.tag == "br" and c is not top:
                line.append(" ")
            elif c is top or not drop(c) and id(c) not in menus and (top is not page or c.tag != "header"):
                if c.tag in BLOCKS:
                    end()
                    todo.append(None)
                todo += [k for k in reversed(c.children) if not (isinstance(k, str) and id(c) in template)]
        end()
    return "\n\n".join(blocks)


def outermost(top: Node, wanted, closed) -> list[Node]:
    """The outermost wanted elements in an element, in page order, without those in closed ones."""
    found, todo = [], top.elements[::-1]
    while todo:
        c = todo.pop()
        if wanted(c):
            found.append(c)
        elif not closed(c):
            todo += reversed(c.elements)
    return found


def layout_of(html: Column) -> Column:
    """The frame tags that a page uses."""
    return F.array_join(F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(html, F.lit("(?i)" + LAYOUT), 1), F.lower))), " ")


def grouped(pages: DataFrame) -> DataFrame:
    """page_id, url and html of `pages` with `own` and `shared`: its group by host and layout, and by layout alone."""
    rows = pages.select("page_id", "url", "html", host_of(F.col("url")).alias("host"), layout_of(F.coalesce("html", F.lit(""))).alias("layout"))
    own = F.when((F.col("host") != "") & (F.col("html") != ""), F.xxhash64("host", "layout"))
    return rows.select("page_id", "url", "html", own.alias("own"), F.xxhash64("layout", F.lit(1)).alias("shared"))


def with_rules(rows: DataFrame, rules: DataFrame) -> DataFrame:
    """`rows` of `grouped` with gid and rule of their own group, or else of the shared one."""
    n, size = rules.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("rule")), F.lit(0))).first()
    for name in ("own", "shared"):
        side = rules.select(F.col("gid").alias(f"_{name}"), F.col("rule").alias(f"_rule_{name}"))
        rows = salted_join(rows, side, F.col(name) == F.col(f"_{name}"), F.xxhash64("page_id", "html"), n, size // max(1, n) + 64)
    known = F.col("own").isNotNull()
    return rows.select("page_id", "url", "html", F.when(known, F.coalesce("_own", "_shared")).alias("gid"), F.when(known, F.coalesce("_rule_own", "_rule_shared")).alias("rule"))


def references(rows: DataFrame) -> DataFrame:
    """gid and rule (the reference) of every group of `rows` (of `grouped`)."""
    smallest = F.min(F.when(F.col("page_id").isNotNull(), F.struct("size", "digest", "page_id"))).alias("x")
    digested = rows.where("own IS NOT NULL").select("page_id", "own", "shared", F.length("html").alias("size"), F.xxhash64("html").alias("digest"))
    different = cut(digested.groupBy("own", "shared", "digest").agg(smallest))
    hosts = cut(different.groupBy("own", "shared").agg(F.count("*").alias("n"), F.min("x").alias("x")))
    single = hosts.where("n = 1").groupBy(F.col("shared").alias("gid")).agg(F.min("x").alias("x"), F.count("*").alias("n"))
    groups = hosts.select(F.col("own").alias("gid"), "x", "n").union(single).where("n > 1").select("gid", "x")
    groups = cut(groups.where("x IS NOT NULL").select("gid", "x.page_id", "x.digest"))
    n = groups.count()
    chosen = groups.select(F.col("page_id").alias("_id"), F.col("digest").alias("_digest")).distinct()
    examples = rows.where("own IS NOT NULL").select("page_id", "html").withColumn("digest", F.xxhash64("html"))
    examples = examples.join(small_or_shuffled(chosen, n, 96), (F.col("page_id") == F.col("_id")) & (F.col("digest") == F.col("_digest")), "left_semi")
    examples = examples.groupBy("page_id", "digest").agg(F.first("html").alias("html"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            yield pa.RecordBatch.from_arrays([b.column("gid"), pa.array([packed(h) for h in b.column("html").to_pylist()], pa.string())], ["gid", "rule"])

    return cut(groups.join(examples, ["page_id", "digest"]).select("gid", "html").mapInArrow(pack, "gid long, rule string"))


def wrappers(rows: DataFrame) -> DataFrame:
    """gid and rule (the wrapper) of every group of `rows` (of `grouped`)."""
    chosen = references(rows)
    joined = with_rules(rows, chosen).where("rule IS NOT NULL").select("gid", "html", "rule")
    kind = pa.list_(pa.struct([("digest", pa.int64()), ("place", pa.int32()), ("plain", pa.int64()), ("link", pa.int64())]))

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            found = [told(h, r) for h, r in zip(b.column("html").to_pylist(), b.column("rule").to_pylist(), strict=True)]
            texts = [[dict(zip(("digest", "place", "plain", "link"), t, strict=True)) for t in f[1]] for f in found]
            yield pa.RecordBatch.from_arrays([b.column("gid"), pa.array([f[0] for f in found], pa.binary()), pa.array(texts, kind)], ["gid", "whole", "texts"])

    listed = joined.mapInArrow(tell, "gid long, whole binary, texts array<struct<digest:long,place:int,plain:long,link:long>>")
    different = cut(listed.groupBy("gid", "whole").agg(F.first("texts").alias("texts")))
    pages = different.groupBy("gid").agg(F.count("*").alias("n"))
    one = different.select("gid", F.explode("texts").alias("t")).select("gid", "t.*")
    counts = one.groupBy("gid", "digest").agg(F.count("*").alias("c"), F.first("place").alias("place"), F.first("plain").alias("plain"), F.first("link").alias("link"))
    counts = counts.join(small_or_shuffled(pages.withColumnRenamed("gid", "_gid"), chosen.count()), F.col("gid") == F.col("_gid")).drop("_gid")
    constant = F.col("c") >= F.col("n") * CONSTANT
    # Constants are at most 1 / CONSTANT of a page's texts, and places those of one page.
    slots = counts.groupBy("gid", F.when(~constant, F.col("place")).alias("place")).agg(
        F.first("n").alias("n"), F.sum(F.col("c") * F.col("plain")).alias("plain"), F.sum(F.col("c") * F.col("link")).alias("link"), F.collect_list(F.when(constant, F.col("digest"))).alias("constants")
    )
    told_apart = F.sum(F.when(F.col("place").isNotNull(), F.col("plain")).otherwise(-F.col("plain")))  # what varies, less the template
    by_group = slots.groupBy("gid").agg(F.max("n").alias("n"), told_apart.alias("gain"), F.flatten(F.collect_list("constants")).alias("constants"), F.collect_list(F.when(F.col("place").isNotNull(), F.struct("place", "plain", "link"))).alias("slots"))
    by_group = by_group.where((F.col("n") >= FEW) | (F.col("gain") > 0)).drop("n", "gain")

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            made = [wrapper(r["rule"], r["constants"], {s["place"]: (s["plain"], s["link"]) for s in r["slots"]}) for r in b.to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("gid"), pa.array(made, pa.string())], ["gid", "rule"])

    return cut(chosen.join(by_group, "gid").mapInArrow(make, "gid long, rule string"))


def main_texts(pages: DataFrame) -> DataFrame:
    """page_id, url and text of every row of `pages`."""
    rows = grouped(pages)
    joined = with_rules(rows, wrappers(rows)).select("page_id", "url", "html", "rule")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            texts = [main_text(h, r or "") for h, r in zip(b.column("html").to_pylist(), b.column("rule").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    return joined.mapInArrow(run, joined.select("page_id", "url").schema.add("text", "string"))


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page of `pages`."""
    return main_texts(table(spark, sf_dir, "pages")).withColumn("n_chars", F.char_length("text").cast("long"))


QUERIES = {"op4_html_extraction": op4_html_extraction}
ORACLE_SQL: dict[str, str] = {}
