"""Main text of web pages by wrapper induction over the pages of a host.

1. Pages are parsed to trees of block elements; inline markup is transparent, scripts,
   styles and elements that say they are menus, forms, adverts, comments and the like
   (by tag, role, id or class) carry no content. Names count only where the whole id or
   class consists of such words ("cookie-notice", not "social-science"), within articles
   only those of adverts, comments, menus, sidebars and notices.
2. One page of each host (the least by hash) is its reference tree. Every page is aligned
   with it by simple tree matching: nodes match if their labels do, and children are
   aligned in order so that most nodes match, equal texts first among equals. A text node's slot is its reference node, or
   its path of labels where it has no partner. This is the one pass that parses; it writes
   each page's text nodes with their slots.
3. Over all different pages of a host, a slot that has the same text on ``SHARE`` of them
   is template; slots that vary are content. Counts combine before their shuffle, so a host
   with a third of all pages is no hot task.
4. A page's text is its content slots within the article (or main) element; on pages
   without one, those that aren't in a menu, which is a group of two links or more and
   nothing else. Articles within a main element that has more text of its own are parts of
   its text. Within an article template goes at its start and end only: between parts that
   vary it is of the article's own (headings that many articles have). A page of which
   ``COPY`` of the text nodes and more are template is itself repeated (copies and near copies
   on one host) and stays whole.

What a host adds to a page is its reference and its template; they are broadcast if all
hosts' together are at most ``BROADCAST_BYTES``, else joined by host.

Edge cases: null or empty html gives an empty text; broken markup is read as browsers
would close it; very long and deeply nested pages are aligned as exactly as others (an
alignment's memory grows with the longer list of children times the root of the other);
null URLs share one host; repeated pages keep their rows and count once for their host; of
pages that could be the reference alike one is taken; an empty table gives no rows. Extra
columns are ignored, whatever their names.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ._common import let, map_arrow_stream, written
from .urls import host_of

#: Pages of a host and their share that make a text template; how alike near copies are.
LEAST_PAGES, SHARE, COPY = 4, 0.6, 0.8
BROADCAST_BYTES = 32 << 20

#: Elements by what HTML says of them.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark nobr output q rp rt ruby s samp small span strike strong sub sup time tt u var wbr meter progress picture source".split())
SKIPPED = frozenset("nav footer aside form button select option input textarea script style noscript template iframe svg canvas object embed head title dialog menu audio video map fieldset datalist".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar tablist".split())
NAMES = frozenset("ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner nav navbar navigation menu menubar breadcrumb breadcrumbs sidebar aside footer cookie cookies consent gdpr notice notices notification newsletter subscribe subscription popup modal overlay comment comments commentlist reply replies respond disqus share sharing social related recommended widget login signin signup register pagination pager masthead toolbar topbar skip toc paywall disclaimer copyright legal".split())
#: Those of them that count within articles too.
INSIDE = frozenset("ad ads adv advert adverts advertisement advertising adsense sponsor sponsored newsletter subscribe signin signup login register form footer nav navbar navigation menu menubar breadcrumb breadcrumbs sidebar cookie cookies gdpr notice notices comment comments commentlist reply replies respond disqus".split())
#: Those that say it whatever stands beside them, but for the words after these.
ALONE = frozenset("comments commentlist disqus advert adverts advertisement advertisements advertising adsense sponsored newsletter login signin".split())
DENIED = frozenset("no not has with without free".split())
#: Words that may stand beside the others in a name.
BESIDE = frozenset("site main page top bottom left right bar box list item items link links area section wrapper container inner outer block global primary secondary header head to text message".split())
HEADS = frozenset("header topbar masthead".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
#: Opening one of these closes an open one of those, up to the given ancestors.
IMPLIED = {"li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "tr": (("tr", "td", "th"), ("table",)), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")), "thead": (("thead", "tbody", "tfoot", "tr", "td", "th"), ("table",)), "tbody": (("thead", "tbody", "tfoot", "tr", "td", "th"), ("table",)), "tfoot": (("thead", "tbody", "tfoot", "tr", "td", "th"), ("table",)), "option": (("option",), ("select",)), "body": (("head",), ("html",))}

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|<[!?/][^>]*>""", re.S)
_ATTRIBUTE = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_PARTS = re.compile(r"[^a-z0-9]+")


class Node:
    __slots__ = ("label", "tag", "kids", "text", "linked", "skip", "main", "sign", "number", "size", "up", "path", "leaves", "chars", "links", "full")

    def __init__(self, label: str, tag: str, up: "Node | None", skip: bool, main: int) -> None:
        self.label, self.tag, self.up, self.skip, self.main = label, tag, up, skip, main
        self.kids: list[Node] = []
        self.text, self.linked = "", 0


def _named(names: str, words: frozenset[str]) -> bool:
    """Whether one of the ids and classes consists of such words, numbers and ``BESIDE``, or has
    one of ``ALONE``."""
    for name in names.split():
        parts = [p for p in _PARTS.split(name) if p and not p.isdigit()]
        if not ALONE.isdisjoint(parts) and DENIED.isdisjoint(parts):
            return True
        if not words.isdisjoint(parts) and all(p in words or p in BESIDE for p in parts):
            return True
    return False


def _judged(tag: str, attributes: str, within: bool) -> tuple[str, bool, int]:
    """(label, is boilerplate, 2 for article and 1 for main) of an element."""
    skip, names, role = tag in SKIPPED or (tag == "header" and not within), "", ""
    if attributes:
        for m in _ATTRIBUTE.finditer(attributes):
            name, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
            if name in ("id", "class"):
                names += " " + value
            elif name == "role":
                role = value
            elif name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and "display:none" in value.replace(" ", "")):
                skip = True
    main = 2 if tag == "article" else 1 if tag == "main" or role == "main" else 0
    if tag not in ("html", "body", "article", "main"):
        skip = skip or (_named(names, INSIDE) if within else _named(names, NAMES) or _named(names, HEADS))
    elif tag == "article":
        skip = skip or _named(names, frozenset(("comment", "comments", "reply")))
    return tag + ".".join(["", *names.split()]), skip or role in ROLES, main


def parse(page: str) -> Node:
    """The page's tree of block elements and text nodes (label ``#``)."""
    root = top = Node("#root", "#root", None, False, 0)
    run: list[str] = []
    link, linked = False, 0
    mute, depth = "", 0  # an inline element without content, and how many of its kind are open

    def flush() -> None:
        nonlocal linked
        if run:
            text = " ".join(entities.unescape("".join(run)).split())
            run.clear()
            if text:
                leaf = Node("#", "#", top, top.skip, top.main)
                leaf.text, leaf.linked = text, linked
                top.kids.append(leaf)
        linked = 0

    at, end = 0, len(page)
    while at < end:
        m = _TAG.search(page, at)
        piece = page[at : m.start() if m else end]
        if piece and not mute:
            run.append(piece)
            linked += len(piece) if link else 0
        if not m:
            break
        at = m.end()
        tag, closing, attributes = m[2] or m[5], m[1] or m[4], m[3] or m[6] or ""
        if tag is None:
            continue
        tag = tag.lower()
        if mute and tag in INLINE:
            depth += (tag == mute) * (-1 if closing else 1)
            mute = mute if depth else ""
            continue
        if attributes and not closing and tag in INLINE and tag not in VOID and _judged(tag, attributes, top.main > 0)[1]:
            mute, depth = tag, 1
            continue
        if tag == "a":
            link = not closing
            continue
        if tag == "br":
            run.append(" ")
            continue
        if tag in INLINE:
            continue
        if not closing and tag in RAW:
            stop = re.compile(rf"</{tag}\b[^>]*>", re.I).search(page, at)
            at = stop.end() if stop else end
            continue
        flush()
        link, mute, depth = False, "", 0
        if closing:
            node = top
            while node is not root and node.tag != tag:
                node = node.up
            if node is not root:
                top = node.up
            continue
        if tag in CLOSES_P:
            node = top
            while node is not root and node.tag not in ("p", "button", "td", "th", "table", "article", "div", "section", "li"):
                node = node.up
            if node.tag == "p":
                top = node.up
        if tag in IMPLIED:
            those, until = IMPLIED[tag]
            node, found = top, None
            while node is not root and node.tag not in until:
                if node.tag in those:
                    found = node
                node = node.up
            if found is not None:
                top = found.up
        label, skip, main = _judged(tag, attributes, top.main > 0)
        node = Node(label, tag, top, top.skip or skip, max(top.main, main))
        top.kids.append(node)
        if tag not in VOID and not attributes.endswith("/"):
            top = node
    flush()
    return root


def _finish(root: Node) -> list[Node]:
    """Nodes in page order; sets number, size, path, the signs of structure alone and with
    texts, and how much text is within (iterative: any depth)."""
    order, stack = [], [root]
    while stack:
        node = stack.pop()
        node.number = len(order)
        node.path = xxhash.xxh64_intdigest(node.label, node.up.path if node.up is not None else 0)
        order.append(node)
        stack.extend(reversed(node.kids))
    for node in reversed(order):
        size, count, chars, links = 1, 0, 0, 0
        if node.text and not node.skip:
            count, chars, links = 1, len(node.text), node.linked
        for k in node.kids:
            size, count, chars, links = size + k.size, count + k.leaves, chars + k.chars, links + k.links
        node.size, node.leaves, node.chars, node.links = size, count, chars, links
        node.sign = hash((node.label, *[k.sign for k in node.kids]))
        node.full = hash((node.label, node.text, *[k.full for k in node.kids]))
    return order


class _Aligned:
    """Alignments of lists of children: what matches, and how many nodes that are."""

    def __init__(self) -> None:
        self.sizes: dict[tuple[int, int], int] = {}

    def _weight(self, x: Node, y: Node) -> int:
        return 0 if x.label != y.label else x.size if x.sign == y.sign else self.sizes[x.sign, y.sign]

    def _missing(self, x: Node, y: Node) -> list[tuple[Node, Node]]:
        """Pairs of children whose sizes must be known first, by their signs."""
        xs = {k.sign: k for k in x.kids}
        ys: dict[str, dict[int, Node]] = {}
        for k in y.kids:
            ys.setdefault(k.label, {})[k.sign] = k
        return [(a, b) for a in xs.values() for b in ys.get(a.label, {}).values() if a.sign != b.sign and (a.sign, b.sign) not in self.sizes]

    @staticmethod
    def _ends(xs: list[int], ys: list[int]) -> tuple[int, int]:
        """How many are equal one by one from the start, and from the end."""
        n, lead, tail = min(len(xs), len(ys)), 0, 0
        while lead < n and xs[lead] == ys[lead]:
            lead += 1
        while tail < n - lead and xs[-1 - tail] == ys[-1 - tail]:
            tail += 1
        return lead, tail

    def solve(self, x: Node, y: Node) -> None:
        """Sizes of all pairs below x and y, deepest first."""
        stack = [(x, y)]
        while stack:
            a, b = stack[-1]
            missing = self._missing(a, b)
            if missing:
                stack += missing
                continue
            stack.pop()
            if (a.sign, b.sign) not in self.sizes:
                self.sizes[a.sign, b.sign] = 1 + self.align(a.kids, b.kids, False)[0]

    def align(self, xs: list[Node], ys: list[Node], pairs: bool) -> tuple[int, list[tuple[int, int]]]:
        """The most nodes that children in order can match; with ``pairs`` also which children
        do, in a choice that has the most children of equal texts."""
        full, signs = ([x.full for x in xs], [y.full for y in ys]), ([x.sign for x in xs], [y.sign for y in ys])
        texts = pairs and full[0] != full[1] and not set(full[0]).isdisjoint(full[1])
        lead, tail = self._ends(*(full if texts else signs))  # without equal texts the first that fit will do
        found = [(i, i) for i in range(lead)] + [(len(xs) - 1 - i, len(ys) - 1 - i) for i in range(tail)]
        total = sum(xs[i].size for i, _ in found)
        rows, columns = len(xs) - lead - tail, len(ys) - lead - tail
        if not rows or not columns:
            return total, found
        kinds: dict[int, np.ndarray] = {}
        y_text = np.array(full[1][lead : lead + columns], np.int64)

        def weights(i: int) -> np.ndarray:
            x = xs[lead + i]
            if x.sign not in kinds:
                of_sign = {y.sign: self._weight(x, y) for y in ys[lead : lead + columns]}
                kinds[x.sign] = np.array([of_sign[y.sign] for y in ys[lead : lead + columns]], np.int64)
            return (kinds[x.sign] << 20) + (y_text == full[0][lead + i]) if texts else kinds[x.sign]

        def following(row: np.ndarray, i: int) -> np.ndarray:
            new = row.copy()
            np.maximum(new[1:], row[:-1] + weights(i), out=new[1:])
            return np.maximum.accumulate(new)

        # Every so many rows one is kept; going back, those between are made again.
        step = max(1, math.isqrt(rows))
        row, kept = np.zeros(columns + 1, np.int64), []
        for i in range(rows):
            if i % step == 0:
                kept.append(row)
            row = following(row, i)
        total += int(row[-1] >> 20 if texts else row[-1])
        if pairs:
            j = columns
            for block in reversed(range(len(kept))):
                table = [kept[block]]
                for i in range(block * step, min(rows, (block + 1) * step)):
                    table.append(following(table[-1], i))
                for k in reversed(range(1, len(table))):
                    while j and table[k][j] == table[k][j - 1]:
                        j -= 1
                    if j and table[k][j] != table[k - 1][j]:
                        j -= 1
                        found.append((lead + block * step + k - 1, lead + j))
        return total, found


def match(a: Node, b: Node) -> dict[int, int]:
    """Simple tree matching: numbers of a's nodes to those of b's they align with."""
    out: dict[int, int] = {}
    aligned = _Aligned()
    if a.label == b.label:
        aligned.solve(a, b)
    stack = [(a, b)] if a.label == b.label else []
    while stack:
        x, y = stack.pop()
        out[x.number] = y.number
        if len(x.kids) == 1 and len(y.kids) == 1:
            if x.kids[0].label == y.kids[0].label:
                stack.append((x.kids[0], y.kids[0]))
        elif x.kids and y.kids:
            stack += [(x.kids[i], y.kids[j]) for i, j in aligned.align(x.kids, y.kids, True)[1]]
    return out


class Leaf(NamedTuple):
    """A text node outside of boilerplate: its slot, a hash of slot and text, whether it is
    in an article (2) or main element (1), and whether in a menu."""

    slot: int
    sign: int
    text: str
    main: int
    menu: bool


def _in_menu(node: Node) -> bool:
    """Links alone, as is the least group of two texts or more that it belongs to."""
    if node.linked * 5 < len(node.text) * 4:
        return False
    up = node.up
    while up.up is not None and up.leaves < 2:
        up = up.up
    return up.leaves < 2 or up.links * 5 >= up.chars * 4


def leaves(page: str, reference: Node | None) -> list[Leaf]:
    """The page's text nodes outside of boilerplate, with their slots."""
    root = parse(page)
    order = _finish(root)
    partner = match(root, reference) if reference is not None else {}
    out = []
    for node in order:
        if node.text and not node.skip:
            slot = partner.get(node.number, -(node.up.path >> 1) - 1)
            out.append(Leaf(slot, xxhash.xxh64_intdigest(node.text, slot & (2**64 - 1)) >> 1, node.text, node.main, _in_menu(node)))
    return out


def main_text(nodes: str = "leaves", template: str = "template") -> Column:
    """The content among a page's text nodes (native)."""
    known = F.coalesce(F.col(template), F.array().cast("array<long>"))

    def varies(x: Column) -> Column:
        return ~F.array_contains(known, x["sign"])

    def of_kept(kept: Column) -> Column:
        content = F.filter(kept, varies)
        marks = F.transform(kept, varies)
        first, last = F.array_position(marks, True), F.size(kept) - F.array_position(F.reverse(marks), True) + 1
        flow = F.slice(kept, F.greatest(first, F.lit(1)).cast("int"), F.greatest(last - first + 1, F.lit(0)).cast("int"))
        own = F.when(F.exists(kept, lambda x: x["main"] == 2), flow).otherwise(content)
        copied = F.size(kept) - F.size(content) >= COPY * F.size(kept)
        return F.array_join(F.transform(F.when(copied, kept).otherwise(own), lambda x: x["text"]), "\n")

    def length(main: int) -> Column:
        return F.aggregate(F.filter(nodes, lambda x: (x["main"] == main) & ~x["menu"]), F.lit(0), lambda n, x: n + F.length(x["text"]))

    def of_best(best: Column) -> Column:
        return let(F.filter(nodes, lambda x: F.when(best == -1, (x["main"] > 0) & ~x["menu"]).otherwise((x["main"] == best) & ((best > 0) | ~x["menu"]))), of_kept)

    most = F.coalesce(F.array_max(F.transform(nodes, lambda x: x["main"])), F.lit(0))
    return let(F.when((most == 2) & (length(1) > length(2)), -1).otherwise(most), of_best)


class References:
    """Parsed reference trees, remembered by their page."""

    def __init__(self) -> None:
        self.seen: dict[str, Node] = {}

    def __call__(self, page: str | None) -> Node | None:
        if page is None:
            return None
        if page not in self.seen:
            if len(self.seen) > 500:
                self.seen.clear()
            root = self.seen[page] = parse(page)
            _finish(root)
        return self.seen[page]


def _with_host(df: DataFrame, table: DataFrame, size: int) -> DataFrame:
    return df.join(F.broadcast(table) if size <= BROADCAST_BYTES else table, "host", "left")


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, url, text, n_chars), one row per page."""
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.coalesce(host_of(F.col(url_col)), F.lit("")).alias("host"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    least = written(rows.select("host", F.xxhash64("html").alias("h"), "id").groupBy("host").agg(F.min(F.struct("h", "id")).alias("least")), "html-least")
    least = least.select(F.col("host").alias("l_host"), "least")
    # A host and 16 bytes each: joined by host only where they are too many to broadcast.
    least = F.broadcast(least) if (least.agg(F.sum(16 + F.octet_length("l_host"))).first()[0] or 0) <= BROADCAST_BYTES else least
    chosen = rows.join(least, (F.col("host") == F.col("l_host")) & (F.xxhash64("html") == F.col("least.h")) & F.col("id").eqNullSafe(F.col("least.id")))
    references = written(chosen.groupBy("host").agg(F.min("html").alias("reference")), "html-references")
    size = references.agg(F.sum(F.octet_length("reference"))).first()[0] or 0

    leaf = T.StructType([T.StructField("slot", T.LongType()), T.StructField("sign", T.LongType()), T.StructField("text", T.StringType()), T.StructField("main", T.IntegerType()), T.StructField("menu", T.BooleanType())])
    schema = T.StructType([T.StructField("id", rows.schema["id"].dataType), T.StructField("url", T.StringType()), T.StructField("host", T.StringType()), T.StructField("page", T.LongType()), T.StructField("leaves", T.ArrayType(leaf))])
    kind = to_arrow_type(schema["leaves"].dataType)

    def parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reference = References()
        for batch in batches:
            found = [leaves(page, reference(ref)) for page, ref in zip(batch.column(4).to_pylist(), batch.column(5).to_pylist(), strict=True)]
            flat = [x for page in found for x in page]
            offsets = np.concatenate(([0], np.cumsum([len(page) for page in found]))).astype(np.int32)
            columns = [pa.array([x[i] for x in flat], f.type) for i, f in enumerate(kind.value_type)]
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays(columns, fields=list(kind.value_type)))
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(4)), lists], names=schema.names)

    marked = rows.select("id", "url", "host", F.xxhash64("html").alias("page"), "html")
    found = written(map_arrow_stream(_with_host(marked, references, size).select("id", "url", "host", "page", "html", "reference"), parsed, schema, 500), "html-leaves")

    # Equal pages of a host count once: copies of one page make no template.
    distinct = found.select("host", "page", F.array_distinct(F.transform("leaves", lambda x: x["sign"])).alias("signs")).groupBy("host", "page").agg(F.first("signs").alias("signs"))
    distinct = written(distinct, "html-pages")
    of_host = distinct.groupBy("host").agg(F.count("*").alias("pages")).where(f"pages >= {LEAST_PAGES}")
    sums = distinct.select("host", F.explode("signs").alias("sign")).groupBy("host", "sign").agg(F.count("*").alias("n")).where(f"n >= {LEAST_PAGES}")
    constant = sums.join(of_host, "host").where(F.col("n") >= SHARE * F.col("pages"))
    template = written(constant.groupBy("host").agg(F.array_sort(F.collect_set("sign")).alias("template")), "html-templates")  # at most a page's slots, over SHARE
    size = template.agg(F.sum(8 * F.size("template") + F.octet_length("host"))).first()[0] or 0
    return _with_host(found, template, size).select("id", "url", main_text().alias("text")).withColumn("n_chars", F.length("text").cast("long"))
