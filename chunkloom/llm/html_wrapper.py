"""Operator 2: HTML extraction by wrapper induction.

Pages of a host are aligned with the host's longest page by simple tree matching: the largest
mapping of two DOM trees that keeps labels, order and parents. Text nodes matched to one node
of the longest page fill one slot. Template is decided by slot and value: a value belongs to the
template where it fills its slot on at least ``SHARE`` of the host's distinct pages and on ``PAGES``
of them at least, so the figure is one of the site and not of how many of its pages are given, and
a value of a single page is always content. Pages are distinct where their texts differ.

A text that the longest page has no node for (a longer menu, a second layout) takes the slot of its
path, the labels from the root down to it. Paths are counted over all pages and all their texts,
aligned or not, so every node that recurs has a slot and its pages are not split between two.

Two passes over the pages, both without a shuffle of HTML while the longest pages of all hosts
fit ``SMALL`` bytes, which is checked; beyond it pages and their host's longest page are brought
together by a shuffle on (host, salt). A host has a salt for each ``PART`` bytes of its pages, so most have one,
and the longest page is copied once for each; the hosts with several are broadcast, of which there are at
most as many as the corpus has parts. Only hashes of slots, values and pages are grouped in between; the
template counts for the bytes that must fit.

Trees are read and matched without recursion, so their depth is not limited; two subtrees are the same
where a hash of their labels is, which needs no table that grows with the pages.

Defined results: of equally long pages the one with the greater hash is the host's longest; very long pages are
read whole; repeated rows are each extracted; a null or empty page has an empty content; a page without a host (null or
relative URL) stands alone; the only page of a host has no template, so all its text is
content; copies of a page count as one page, so a host of nothing but copies is all
content; script, style and comments are dropped and broken markup is repaired as browsers do
for p, li, table rows and options; an empty table gives an empty result; further columns are
ignored; a null page_id stays null.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

SHARE, PAGES, SMALL, PART = 0.01, 2, 64 << 20, 256 << 20
DEEP = 500  # characters of a path from which it is hashed, so deep pages take no square time
_OUT = "page_id bigint, host string, title string, content string, n_template int, n_content int"
_COUNTS = "host string, key bigint, page bigint"
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template)\b.*?(?:</\1\s*>|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S | re.I
)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
_SIBLING = {"li": ({"li"}, {"ul", "ol"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}


class Node:
    __slots__ = ("label", "children", "text", "number", "shape", "size")

    def __init__(self, label: str, text: str = "") -> None:
        self.label, self.children, self.text, self.number, self.shape, self.size = label, [], text, -1, -1, 1


def parse(page: str | None) -> Node:
    """DOM of a page; text nodes are leaves labelled #text, white space collapsed."""
    root = Node("#root")
    open_, at = [root], 0
    depth: Counter[str] = Counter()  # open elements by label, so a stray end tag needs no search

    def close(upto: int) -> None:
        depth.subtract(n.label for n in open_[upto:])
        del open_[upto:]

    def text(s: str) -> None:
        if s and not s.isspace():
            s = " ".join(entities.unescape(s).split())
            if s:
                open_[-1].children.append(Node("#text", s))

    page = page or ""
    for m in _TOKEN.finditer(page):
        text(page[at : m.start()])
        at = m.end()
        name = m[3]
        if not name:
            continue
        name = name.lower()
        if m[2]:
            for k in () if not depth[name] else range(len(open_) - 1, 0, -1):
                if open_[k].label == name:
                    close(k)
                    break
            continue
        if name in _BLOCK:
            for k in () if not depth["p"] else range(len(open_) - 1, 0, -1):
                if open_[k].label == "p":
                    close(k)
                    break
                if open_[k].label in _BLOCK:
                    break
        elif name in _SIBLING:
            same, stop = _SIBLING[name]
            for k in () if not any(depth[x] for x in same) else range(len(open_) - 1, 0, -1):
                if open_[k].label in stop:
                    break
                if open_[k].label in same:
                    close(k)
        node = Node(name)
        open_[-1].children.append(node)
        if name not in _VOID and not m[0].endswith("/>"):
            open_.append(node)
            depth[name] += 1
    text(page[at:])
    _number(root)
    return root


def _number(root: Node) -> None:
    """Preorder numbers, sizes, and shapes: two nodes have one shape if their subtrees agree in labels."""
    todo, order = [root], []
    while todo:
        n = todo.pop()
        n.number = len(order)
        order.append(n)
        todo.extend(reversed(n.children))
    for n in reversed(order):
        n.size = 1 + sum(c.size for c in n.children)
        n.shape = xxhash.xxh64_intdigest(b"".join([n.label.encode(), *(c.shape.to_bytes(8, "little") for c in n.children)]))


_scores: dict[tuple[int, int], int] = {}


def _trim(a: list[Node], b: list[Node]) -> tuple[int, int]:
    """How many children agree at the begin and at the end; matching these is always best."""
    n = min(len(a), len(b))
    i = 0
    while i < n and a[i].shape == b[i].shape:
        i += 1
    j = 0
    while j < n - i and a[-1 - j].shape == b[-1 - j].shape:
        j += 1
    return i, j


def _known(x: Node, y: Node) -> int:
    return x.size if x.shape == y.shape else _scores[x.shape, y.shape]


def _table(a: list[Node], b: list[Node]) -> list[list[int]]:
    """Scores of the first children of two nodes, those of all their pairs being known."""
    rows = [[0] * (len(b) + 1)]
    for x in a:
        last, row = rows[-1], [0]
        for j, y in enumerate(b):
            best = last[j + 1] if last[j + 1] >= row[j] else row[j]
            if x.label == y.label and (s := last[j] + _known(x, y)) > best:
                best = s
            row.append(best)
        rows.append(row)
    return rows


def score(a: Node, b: Node) -> int:
    """Nodes in the largest mapping of the two trees."""
    if a.label != b.label:
        return 0
    if a.shape == b.shape:
        return a.size
    if len(_scores) > 1_000_000:
        _scores.clear()
    todo = [(a, b)]
    while todo:
        p, q = todo[-1]
        key = (p.shape, q.shape)
        if key not in _scores:
            i, j = _trim(p.children, q.children)
            x, y = p.children[i : len(p.children) - j], q.children[i : len(q.children) - j]
            if need := [(c, d) for c in x for d in y if c.label == d.label and c.shape != d.shape and (c.shape, d.shape) not in _scores]:
                todo += need
                continue
            same = sum(c.size for c in p.children[:i]) + sum(c.size for c in p.children[len(p.children) - j :])
            _scores[key] = 1 + same + (_table(x, y)[-1][-1] if x and y else 0)
        todo.pop()
    return _scores[a.shape, b.shape]


def align(a: Node, b: Node) -> list[tuple[Node, Node]]:
    """Pairs of nodes in the largest mapping of two trees with one root label."""
    score(a, b)  # now those of all pairs below are known
    out, todo = [], [(a, b)]
    while todo:
        x, y = todo.pop()
        out.append((x, y))
        if x.shape == y.shape:
            todo += zip(x.children, y.children)
            continue
        i, j = _trim(x.children, y.children)
        p, q = x.children, y.children
        todo += zip(p[:i], q[:i])
        if j:
            todo += zip(p[-j:], q[-j:])
        p, q = p[i : len(p) - j], q[i : len(q) - j]
        if not p or not q:
            continue
        t = _table(p, q)
        k, m = len(p), len(q)
        while k and m:
            if t[k][m] == t[k - 1][m]:
                k -= 1
            elif t[k][m] == t[k][m - 1]:
                m -= 1
            else:
                k, m = k - 1, m - 1
                todo.append((p[k], q[m]))
    return out


def slots(ref: Node, page: Node) -> dict[int, int]:
    """Number of a text node of ``page`` -> number of its slot."""
    return {y.number: x.number for x, y in align(ref, page) if x.label == "#text"}


def texts(page: Node) -> Iterator[tuple[Node, bool, str]]:
    """Text nodes in order, whether each lies in the title or head, and the labels above it."""
    todo = [(page, False, "")]
    while todo:
        n, head, path = todo.pop()
        if n.label == "#text":
            yield n, head, path
        elif n.children:
            head = head or n.label in ("head", "title")
            path = f"{path}/{n.label}" if len(path) < DEEP else f"{value_of(path)}/{n.label}"
            todo.extend((c, head, path) for c in reversed(n.children))


def value_of(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass")) - (1 << 63)


def key_of(slot: int | str, n: Node) -> int:
    """Hash of a slot (a node's number in the longest page, or a path) and a text node's value."""
    return value_of(f"{slot}\0{n.text}")


def extract(page: Node, slot_of: dict[int, int], template: frozenset[int]) -> tuple[str, str, int, int]:
    title, content, constant = [], [], 0
    for n, head, path in texts(page):
        if head:
            title.append(n.text)
        elif template and key_of(slot_of.get(n.number, path), n) in template:
            constant += 1
        else:
            content.append(n.text)
    return " ".join(title), "\n".join(content), constant, len(content)


# --- Spark


class _Refs:
    """The longest pages of hosts, parsed when first needed, and the keys of their template."""

    def __init__(self, pages: dict[str, str], template: dict[str, list[int]]) -> None:
        self.pages, self.template, self.trees = pages, {h: frozenset(s) for h, s in template.items()}, {}

    def tree(self, host: str | None) -> Node | None:
        if host not in self.pages:
            return None
        if host not in self.trees:
            if len(self.trees) > 256:
                self.trees.clear()
            self.trees[host] = parse(self.pages[host])
        return self.trees[host]


def _rows(batches: Iterator[pa.RecordBatch], shared) -> Iterator[tuple[list[tuple[int, str, str]], _Refs]]:
    """(page_id, host, html) rows of each batch. Rows with ``ref`` carry a host's longest page and come before its pages."""
    refs = _Refs(*shared.value) if shared is not None else _Refs({}, {})
    for b in C.slices(batches, "html"):
        rows = []
        for i, h, x, ref, template in zip(*(b.column(c).to_pylist() for c in ("page_id", "host", "html", "ref", "template"))):
            if ref:
                if rows:
                    yield rows, refs
                    rows = []
                refs = _Refs({h: x}, {h: template or []})
            else:
                rows.append((i, h, x))
        yield rows, refs


def _count(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: set[tuple[str, int | None, int]] = set()

        def flush() -> pa.RecordBatch:
            out = [pa.array([k[i] for k in found], t) for i, t in enumerate((pa.string(), pa.int64(), pa.int64()))]
            found.clear()
            return pa.RecordBatch.from_arrays(out, ["host", "key", "page"])

        for rows, refs in _rows(batches, shared):
            for _, host, page in rows:
                if page and (ref := refs.tree(host)) is not None:
                    tree = parse(page)
                    slot_of = slots(ref, tree)
                    nodes = list(texts(tree))
                    mark = value_of("\0".join(node.text for node, _, _ in nodes))
                    found.add((host, None, mark))
                    for node, head, path in nodes:
                        if not head:
                            found.add((host, key_of(path, node), mark))
                            if node.number in slot_of:
                                found.add((host, key_of(slot_of[node.number], node), mark))
            if len(found) > 100_000:
                yield flush()
        yield flush()

    return run


def _extract(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, refs in _rows(batches, shared):
            out = []
            for page_id, host, page in rows:
                tree, ref = parse(page), refs.tree(host)
                out.append((page_id, host, *extract(tree, slots(ref, tree) if ref is not None and page else {}, refs.template.get(host, frozenset()))))
            kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.int32()]
            names = ["page_id", "host", "title", "content", "n_template", "n_content"]
            yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], t) for k, t in enumerate(kinds)], names)

    return run


def host_of(url: str):
    """Host of a URL column; null where there is none."""
    h = F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    return F.when(h != "", h)


def extracted(pages: DataFrame, small: int = SMALL, part: int = PART) -> DataFrame:
    """(page_id, host, title, content, n_template, n_content): a row for each page."""
    spark = pages.sparkSession
    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), host_of("url").alias("host"), F.col("html").cast("string").alias("html"), F.lit(False).alias("ref"), F.lit(None).cast("array<bigint>").alias("template"))
    # the longest page is kept in each task before anything is exchanged, so a hot host sends one page for each task
    longest = (
        rows.where("host is not null and html is not null")
        .groupBy("host")
        .agg(F.max_by("html", F.struct(F.octet_length("html"), F.xxhash64("html"))).alias("html"), F.count("*").alias("pages"), F.sum(F.octet_length("html")).alias("bytes"))
        .where("pages > 1")
    )
    refs = C.written(longest.select(F.lit(None).cast("bigint").alias("page_id"), "host", "html", F.lit(False).alias("ref"), F.lit(None).cast("array<bigint>").alias("template"), F.ceil(F.col("bytes") / part).alias("salts")), "longest")
    bytes_ = refs.agg(F.sum(F.octet_length("html"))).first()[0] or 0

    def run(function, schema: str, template: DataFrame | None) -> DataFrame:
        if bytes_ + (8 * (template.agg(F.sum(F.size("keys"))).first()[0] or 0) if template is not None else 0) <= small:
            chosen = {r.host: r["keys"] for r in template.collect()} if template is not None else {}
            shared = spark.sparkContext.broadcast(({r.host: r.html for r in refs.collect()}, chosen))
            return rows.mapInArrow(function(shared), schema)
        with_ = refs.drop("template").join(template, "host", "left").withColumnRenamed("keys", "template") if template is not None else refs
        salted = with_.select("page_id", "host", "html", F.lit(True).alias("ref"), "template", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("salts") - 1)).alias("salt"))
        large = F.broadcast(refs.where("salts > 1").select(F.col("host").alias("large"), "salts"))
        # a page without a host meets no other, so these are spread, too
        spread = F.when(F.col("host").isNull(), F.xxhash64("html", "page_id")).otherwise(F.pmod(F.xxhash64("html", "page_id"), F.coalesce("salts", F.lit(1))))
        both = rows.join(large, F.col("host") == F.col("large"), "left").withColumn("salt", spread).drop("large", "salts").unionByName(salted)
        together = both.repartition("host", "salt").sortWithinPartitions("host", "salt", F.col("ref").desc())
        return together.drop("salt").mapInArrow(function(None), schema)

    counts = C.written(run(_count, _COUNTS, None).groupBy("host", "key").agg(F.count_distinct("page").alias("n")), "counts")
    total = counts.where("key is null").select("host", F.col("n").alias("pages"))
    constant = counts.where((F.col("n") >= PAGES) & F.col("key").isNotNull()).join(total, "host").where(F.col("n") >= SHARE * F.col("pages"))
    template = C.written(constant.groupBy("host").agg(F.collect_list("key").alias("keys")), "template")
    return run(_extract, _OUT, template)


def op2_wrapper_induction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extracted(C.table(spark, sf_dir, "pages"))
