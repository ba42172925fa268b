"""HTML extraction by wrapper induction.

Method. Each page becomes a tree of block elements with their own text. Siblings of one kind fold into one slot, so a
tree is as large as the template, not as the content. The ``SAMPLE`` pages of a host with the smallest digests are
merged, in that order, into the host's wrapper: at each level slots are paired by simple tree matching, so that the most
nodes pair up in order, and what stands in one tree only is kept. The texts that most of these pages have in a slot are
candidates for template. Then every page of the host is aligned with the wrapper, and for each candidate the pages that
have it in its slot are counted. A candidate that at least ``SHARE`` of the host's pages have, and at least ``ENOUGH``
of them, is template; all other text varies and is content.

A page's main text is what varies inside its content element: ``article`` or ``main`` if there is one, else the child
of ``body`` whose varying blocks hold the most text outside links. Elements whose names, classes or ids say what they
are (menus, headers, footers, sidebars, notices, adverts, forms, comments, scripts, styles) never are content. The
wrapper decides within ``article`` and ``main`` too.

Copies. Pages of a host with equal html are one page: a copy found c times counts 1/c in each place.

Plan. Digests are grouped by (host, digest); the sample's pages alone meet by host, ``SAMPLE`` at most, whatever the
host's size. Counts are summed in each task, then by (host, candidate) with partial aggregation, so a host of a third of
all pages is one small row for each task and candidate. What a page gives depends on the page and the wrapper alone:
results are the same for any partitioning. Wrappers join their pages by broadcast when measured small, else by a join
that AQE may split.

Defined cases: a null html is an empty page, whose text is empty; a null or odd url is of host ''; rows that repeat an
id each give a row; a host of fewer than ``ENOUGH`` different pages has no template, so only elements' roles decide
there; broken markup is read as far as it goes: a tag that never closes ends with its parent; extra columns are ignored.
"""

from __future__ import annotations

import html as html_lib
import json
import re
import sys
import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .util import BROADCAST_BYTES, arrow_map, cut, ship

#: Pages that must have a text for it to be template, and the share of the host's pages; pages merged into a wrapper.
ENOUGH, SHARE, SAMPLE = 4, 0.9, 16
#: Hosts in a task's memory; salts of the sample's choice.
HOSTS_KEPT, SALTS = 2000, 16

#: Elements by role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe svg math object canvas textarea select".split())
BLOCK = frozenset("html body article main section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th blockquote pre figure figcaption nav header footer aside form fieldset address details summary hr center".split())
NEVER = frozenset("nav footer aside form fieldset button head title menu dialog label".split())
NOT_CONTENT = re.compile(r"(?:^|[\s_-])(?:ads?|advert\w*|banner|sponsor\w*|promo\w*|nav|navbar|navigation|menu|breadcrumbs?|header|masthead|footer|sidebar|side|aside|widget|comments?|disqus|respond|replies|reply|notice|alert|cookies?|consent|gdpr|popup|modal|newsletter|subscribe|signup|social|share|sharing|related|recommend\w*|login|search|form|skip|copyright|legal|pagination|pager|toolbar)(?:$|[\s_-])", re.I)
NOT_AN_ARTICLE = re.compile(r"(?:^|[\s_-])(?:ads?|advert\w*|promo\w*|sponsor\w*|teaser|comments?|replies|reply|related|recommend\w*)(?:$|[\s_-])", re.I)
#: Class names that speak of what an element has or lacks, not of what it is.
_about = re.compile(r"(?:^|\s)(?:has|with|no|js|is|without)-\S*")
CLOSES_P = BLOCK - {"html", "body"}
SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "p": {"p"}}

_tag = re.compile(r"<(?:!--.*?(?:-->|\Z)|[!?][^>]*>?|(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>?)", re.S)
_attr = re.compile(r"\b(class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", re.I)
_number = re.compile(r"\d+")
_host = r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)"


class Node:
    """A block element: key (name and classes, numbers left out), parts in order: text or child nodes."""

    __slots__ = ("key", "name", "parts", "never", "linked", "text_size", "constant")

    def __init__(self, key: str, name: str, never: bool):
        self.key, self.name, self.never, self.parts = key, name, never, []
        self.linked = self.text_size = 0
        self.constant: frozenset[int] = frozenset()  # digests of own texts that are template here


def parse(page: str) -> Node:
    root = Node("", "", False)
    stack: list[tuple[str, Node]] = [("", root)]  # open elements, inline ones with the block they stand in
    at, n = 0, len(page)
    links = 0
    while at < n:
        m = _tag.search(page, at)
        text = page[at : m.start()] if m else page[at:]
        if text:
            top = stack[-1][1]
            top.parts.append(text)
            top.text_size += len(text)
            if links:
                top.linked += len(text)
        if not m:
            break
        at = m.end()
        name = m[2]
        if name is None:
            continue
        name = name.lower()
        if m[1]:
            if name in VOID:
                if name == "br":
                    stack[-1][1].parts.append(" ")
                continue
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] == name:
                    del stack[k:]
                    break
            links = sum(1 for x, _ in stack if x == "a") if name == "a" or links else 0
            continue
        if name in RAW:
            if not m[0].endswith("/>"):
                end = re.compile(rf"</{name}\b[^>]*>?", re.I).search(page, at)
                at = end.end() if end else n
            continue
        if name in VOID:
            if name == "br":
                stack[-1][1].parts.append(" ")
            continue
        if name in BLOCK or name in NEVER:
            for k in range(len(stack) - 1, 0, -1):
                x = stack[k][0]
                if x in SAME.get(name, ()) or (x == "p" and name in CLOSES_P):
                    del stack[k:]
                    break
                if x in ("table", "ul", "ol", "dl", "body", "article", "main", "section", "div", "blockquote") or (x in ("td", "li", "dd") and name not in SAME):
                    break
            key, never = name, name in NEVER
            role = ""
            if m[3]:
                named = {a.lower(): v.strip("\"'") for a, v in _attr.findall(m[3])}
                role = named.get("role", "").lower()
                said = f"{named.get('class', '')} {named.get('id', '')}".strip()
                key = f"{name}.{_number.sub('', named['class'])}" if named.get("class") else name
                if said and name not in ("html", "body", "main"):
                    never = never or bool((NOT_AN_ARTICLE if name == "article" else NOT_CONTENT).search(_about.sub(" ", said)))
                never = never or role in ("navigation", "banner", "contentinfo", "complementary", "search", "form", "alert", "dialog")
            node = Node(key, name, never)
            # A page's header isn't content; a header within an article is the article's own head.
            if name == "header" and not any(x in ("article", "main") for x, _ in stack):
                node.never = True
            stack[-1][1].parts.append(node)
            stack.append((name, node))
        else:
            stack.append((name, stack[-1][1]))
            links += name == "a"
    return root


def squeeze(text: str) -> str:
    return " ".join(html_lib.unescape(text).split()) if "&" in text else " ".join(text.split())


def own_text(node: Node) -> str:
    return squeeze("".join(p if isinstance(p, str) else " " for p in node.parts))


def digest(text: str) -> int:
    return zlib.crc32(text.encode("utf-8", "surrogatepass"))


class Slot:
    """Siblings of one key: ``members`` are a page's nodes, ``texts`` a wrapper's counts of pages by text digest."""

    __slots__ = ("key", "kids", "members", "texts")

    def __init__(self, key: str, kids: dict[str, Slot] | None = None, members: list[Node] | None = None):
        self.key, self.kids, self.members, self.texts = key, kids or {}, members or [], {}


def fold(root: Node) -> Slot:
    """A page's tree with siblings of one key folded, in order of their first, without a limit on depth."""
    top = Slot(root.key, members=[root])
    todo = [top]
    while todo:
        slot = todo.pop()
        for node in slot.members:
            for p in node.parts:
                if isinstance(p, Node):
                    slot.kids.setdefault(p.key, Slot(p.key)).members.append(p)
        todo.extend(slot.kids.values())
    return top


def matching(a: Slot, b: Slot, memo: dict | None = None) -> list[str]:
    """Keys of the children that simple tree matching pairs: the heaviest common subsequence, a pair weighing as many
    nodes as its subtrees share. A key stands once at a level, so this is an increasing run of places."""
    place = {k: i for i, k in enumerate(b.kids)}
    common = [k for k in a.kids if k in place]
    if all(place[x] < place[y] for x, y in zip(common, common[1:])):
        return common
    memo = {} if memo is None else memo
    best: list[tuple[int, int]] = []  # total weight of a run that ends here, and the place before
    for i, k in enumerate(common):
        total, before = 0, -1
        for j in range(i):
            if place[common[j]] < place[k] and best[j][0] > total:
                total, before = best[j][0], j
        best.append((total + weight(a.kids[k], b.kids[k], memo), before))
    at = best.index(max(best, key=lambda x: x[0]))
    out = []
    while at >= 0:
        out.append(common[at])
        at = best[at][1]
    return out[::-1]


def weight(a: Slot, b: Slot, memo: dict) -> int:
    """How many nodes two trees with equal roots share in order."""
    known = memo.get((id(a), id(b)))
    if known is None:
        known = 1
        for k in matching(a, b, memo):
            known += weight(a.kids[k], b.kids[k], memo)
        memo[id(a), id(b)] = known
    return known


def pairs(wrapper: Slot, page: Slot) -> Iterator[tuple[Slot, Slot]]:
    """All slots of a page that the wrapper knows, with the wrapper's own."""
    todo = [(wrapper, page)]
    while todo:
        w, p = todo.pop()
        yield w, p
        todo.extend((w.kids[k], p.kids[k]) for k in matching(w, p))


def merge(wrapper: Slot, page: Slot) -> None:
    """Adds a page to a wrapper; a text counts once for each page and slot."""
    for d in {digest(t) for n in page.members if (t := own_text(n))}:
        wrapper.texts[d] = wrapper.texts.get(d, 0) + 1
    both = matching(wrapper, page)
    for k in both:
        merge(wrapper.kids[k], page.kids[k])
    alone = [k for k in page.kids if k not in wrapper.kids]
    if alone:
        after: dict[str | None, list[Slot]] = {}
        last = None
        for k in page.kids:
            if k in both:
                last = k
            elif k not in wrapper.kids:
                new = Slot(k)
                merge(new, page.kids[k])
                after.setdefault(last, []).append(new)
        order = [*after.get(None, ())]
        for k, kid in wrapper.kids.items():
            order += [kid, *after.get(k, ())]
        wrapper.kids = {x.key: x for x in order}


def induced(pages: list[str]) -> Slot | None:
    """The wrapper of different pages, with the texts that most of them have as candidates."""
    deep()
    out = None
    for page in pages:
        tree = fold(parse(page))
        out = out or Slot(tree.key)
        merge(out, tree)
    todo = [out] if out else []
    while todo:
        slot = todo.pop()
        slot.texts = {d: n for d, n in slot.texts.items() if 2 * n > len(pages)}
        todo.extend(slot.kids.values())
    return out


def dump(w: Slot) -> bytes:
    """In preorder, with depths: [depth, key, candidates]."""
    rows, todo = [], [(0, w)]
    while todo:
        depth, slot = todo.pop()
        rows.append([depth, slot.key, sorted(slot.texts)])
        todo.extend((depth + 1, k) for k in reversed(slot.kids.values()))
    return zlib.compress(json.dumps(rows, separators=(",", ":")).encode(), 1)


def load(data: bytes) -> tuple[Slot, int]:
    """The wrapper, whose candidates are numbered in order, and how many there are."""
    open_: list[Slot] = []
    n = 0
    for depth, key, texts in json.loads(zlib.decompress(data)):
        slot = Slot(key)
        slot.texts = {d: n + i for i, d in enumerate(texts)}
        n += len(texts)
        del open_[depth:]
        if open_:
            open_[-1].kids[key] = slot
        open_.append(slot)
    return open_[0], n


def seen(wrapper: Slot, page: Slot) -> Iterator[int]:
    """Numbers of the candidates that a page has in their slots."""
    for w, p in pairs(wrapper, page):
        if w.texts:
            yield from {w.texts[d] for n in p.members if (d := digest(own_text(n))) in w.texts}


def mark(wrapper: Slot, page: Slot, template: frozenset[int]) -> None:
    """Puts at each node of a page which texts are template there."""
    for w, p in pairs(wrapper, page):
        constant = frozenset(d for d, i in w.texts.items() if i in template)
        if constant:
            for n in p.members:
                n.constant = constant


def blocks(node: Node, out: list[str]) -> None:
    """Texts of content blocks in page order; text between block elements is a block of its own."""
    held: list[str] = []
    varies = not node.constant or digest(own_text(node)) not in node.constant

    def flush() -> None:
        if held:
            text = squeeze("".join(held)) if varies else ""
            if text:
                out.append(text)
            held.clear()

    for p in node.parts:
        if isinstance(p, str):
            held.append(p)
        else:
            flush()
            if not p.never:
                blocks(p, out)
    flush()


def _weight(node: Node) -> int:
    """Letters outside links count, those within count against it."""
    total, todo = 0, [node]
    while todo:
        x = todo.pop()
        if not x.never:
            total += x.text_size - 2 * x.linked
            todo.extend(p for p in x.parts if isinstance(p, Node))
    return total


def _find(node: Node, names: tuple[str, ...], found: list[Node]) -> None:
    for p in node.parts:
        if isinstance(p, Node) and not p.never:
            if p.name in names:
                found.append(p)
            else:
                _find(p, names, found)


def deep() -> None:
    """Trees are gone through by plain recursion, whose frames are on the heap: as deep as a page nests."""
    sys.setrecursionlimit(max(sys.getrecursionlimit(), 1_000_000))


def extract(page: str, wrapper: Slot | None = None, template: frozenset[int] = frozenset()) -> str:
    deep()
    root = parse(page)
    if template:
        mark(wrapper, fold(root), template)
    out: list[str] = []
    for names in (("article",), ("main",)):
        found: list[Node] = []
        _find(root, names, found)
        if found:
            for node in found:
                blocks(node, out)
            return "\n".join(out)
    found = []
    _find(root, ("body",), found)
    node = found[0] if found else root
    while True:  # down to the element that holds most of the text
        kids = [p for p in node.parts if isinstance(p, Node) and not p.never]
        total = _weight(node)
        best = max(kids, key=_weight, default=None)
        if best is None or best.name not in ("div", "section", "center", "td", "table", "tbody", "tr") or _weight(best) < 0.6 * total:
            break
        node = best
    blocks(node, out)
    return "\n".join(out)


def _side(df: DataFrame, bytes_: int) -> DataFrame:
    return F.broadcast(df) if bytes_ <= BROADCAST_BYTES else df.hint("merge")


def _with_host(pages: DataFrame, *columns: str) -> DataFrame:
    host = F.lower(F.regexp_extract(F.coalesce(F.col("url").cast("string"), F.lit("")), _host, 1))
    return pages.select(*columns, host.alias("host"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))


def induce(pages: DataFrame) -> DataFrame:
    """host, wrapper (packed), pages (different ones), template (numbers of candidates) of each host."""
    d = _with_host(pages).withColumn("d", F.sha2(F.col("html").cast("binary"), 256))
    different = cut(d.groupBy("host", "d").agg(F.count("*").alias("c")))
    sizes = different.groupBy("host").agg(F.count("*").alias("pages"))
    enough = cut(sizes.where(F.col("pages") >= ENOUGH))
    # The smallest digests, salted first: each step's group is of a size that neither pages nor tasks add to.
    smallest = lambda x, *by: x.withColumn("k", F.row_number().over(Window.partitionBy(*by).orderBy("d"))).where(F.col("k") <= SAMPLE)
    first = smallest(different.withColumn("salt", F.pmod(F.xxhash64("d"), F.lit(SALTS))), "host", "salt")
    first = smallest(first, "host")
    first = cut(first.join(_side(enough, enough.count() * 64), "host").select("host", "d"))
    sample = d.join(_side(first, first.count() * 128), ["host", "d"], "left_semi").dropDuplicates(["host", "d"])

    def joined(pdf):
        import pandas as pd

        pdf = pdf.sort_values("d")
        data = dump(induced(list(pdf["html"])))
        return pd.DataFrame({"host": [pdf["host"].iloc[0]], "wrapper": [data], "candidates": [load(data)[1]]})

    ship(pages.sparkSession)
    wrappers = cut(sample.groupBy("host").applyInPandas(joined, "host string, wrapper binary, candidates long").where("candidates > 0").join(enough, "host"))
    # How often each candidate stands in its slot, over all pages; of copies each counts its share.
    copies = different.where(F.col("c") > 1)
    width = wrappers.agg(F.sum(F.octet_length("wrapper") + 64)).first()[0] or 0
    counted = d.join(_side(wrappers.select("host", "wrapper"), width), "host").join(_side(copies, copies.count() * 128), ["host", "d"], "left")

    def count(it: Iterator[tuple]) -> Iterator[tuple]:
        held: dict[str, tuple[Slot, list[float]]] = {}

        def give() -> Iterator[tuple]:
            for h, (_, sums) in held.items():
                yield from ((h, i, x) for i, x in enumerate(sums) if x)
            held.clear()

        for h, page, packed, c in it:
            if h not in held:
                if len(held) >= HOSTS_KEPT:
                    yield from give()
                w, n = load(packed)
                held[h] = w, [0.0] * n
            w, sums = held[h]
            for i in seen(w, fold(parse(page))):
                sums[i] += 1 / (c or 1)
        yield from give()

    sums = arrow_map(counted.select("host", "html", "wrapper", "c"), count, "host string, i int, n double", 256).groupBy("host", "i").agg(F.sum("n").alias("n"))
    always = sums.join(wrappers.select("host", "pages"), "host").where((F.col("n") > F.lit(ENOUGH - 1e-6)) & (F.col("n") > SHARE * F.col("pages") - 1e-6))
    found = always.groupBy("host").agg(F.sort_array(F.collect_list("i")).alias("template"))
    return wrappers.join(found, "host")


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text of each page."""
    wrappers = cut(induce(pages).select("host", "wrapper", "template"))
    width = wrappers.agg(F.sum(F.octet_length("wrapper") + 4 * F.size("template") + 64)).first()[0] or 0
    d = _with_host(pages, "page_id", "url").join(_side(wrappers, width), "host", "left")

    def rows(it: Iterator[tuple]) -> Iterator[tuple]:
        known: dict[str, tuple] = {}
        for page_id, url, page, h, packed, template in it:
            if h not in known:
                if len(known) > HOSTS_KEPT:
                    known.clear()
                known[h] = (load(packed)[0], frozenset(template)) if template else (None, frozenset())
            yield page_id, url, extract(page, *known[h])

    kind = pages.schema["page_id"].dataType.simpleString()
    return arrow_map(d.select("page_id", "url", "html", "host", "wrapper", "template"), rows, f"page_id {kind}, url string, text string")


def page_digests(pages: DataFrame) -> DataFrame:
    return extract_pages(pages).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
