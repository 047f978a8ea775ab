"""Main text of web pages by wrapper induction.

Each page becomes a tree in which siblings with the same label (tag and classes) fold into one node, so a list or a
run of paragraphs is one node however long.  The trees of a host's pages are aligned by simple tree matching, first
within tasks, then partial templates with each other over a fixed fan-in, into one template per host.  Its nodes carry
how many pages have them, how much text and link text, and whether the text is the same on different pages: constant
nodes are template, the others are slots.  Every page is then aligned with its host's template, and the blocks of the
slots in the content region are its text.

Slots are told apart by what marks them: navigation, headers, footers, asides, forms, adverts, notices and comments are
no content even where they vary.  The content region is the article or main element, or else the deepest node that has
most of the remaining text.
"""

from __future__ import annotations

import html
import json
import re
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.plans.staging import staged


# fixed values: HTML's own element classes
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp template".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span"
    " strike strong sub sup time tt u var wbr".split()
)
#: A start tag of the key ends an open element of the value's tags.
ENDS = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
    "th": {"td", "th"}, "option": {"option"}, "thead": {"tr", "td", "th"}, "tbody": {"tr", "td", "th", "thead"},
    "body": {"head"},
}
#: Elements in which an open element outside is not looked for.
SCOPES = frozenset("table ul ol dl select article section div main body html".split())
#: Elements and marks of what is not content.
NOISE_TAGS = frozenset("head nav footer aside form button select option dialog menu svg canvas object audio video".split())
NOISE_WORDS = re.compile(
    r"(?:^|(?<!has)(?<!with)(?<!no)[-_])(?:ads?|advert\w*|banner|sponsor\w*|promo\w*|side-?bar|menu|nav\w*|breadcrumbs?|footer|header|masthead|"
    r"cookies?|consent|notice|gdpr|popup|modal|overlay|comments?|respond|replies|disqus|share|social|related|recommended|"
    r"newsletter|subscribe|signup|login|pagination|pager|toolbar|widget|skip)(?:$|[-_#])"
)
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert form menu".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+'|[\"'])*+)>", re.S
)
_CLASS = re.compile(r"""\b(class|id|role|itemprop|hidden)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""", re.I)

_START = re.compile(r"<(?=[!?/a-zA-Z])")

#: Levels of a tree.  Of deeper elements only the first that marks content and the first that marks noise count, as
#: children of the deepest level; their text stays, so pages of any depth are read without deep recursion.
DEEPEST = 128
#: After so many tags that never end, what follows them on a page is text; each costs a look at the rest of the page.
UNENDED = 64
#: Partial templates that one task aligns.
FAN_IN = 64
#: A constant node is template if so many pages have it.
LEAST_PAGES = 3


class Node:
    """A labelled node of a folded tree with the figures of the pages that have it."""

    __slots__ = ("label", "children", "pages", "chars", "links", "value", "page")

    def __init__(self, label: str):
        self.label, self.children = label, {}
        self.pages = self.chars = self.links = 0
        self.value = self.page = None  # digests; 0 where several differ

    def size(self) -> int:
        return 1 + sum(c.size() for c in self.children.values())

    def dump(self) -> list:
        return [self.label, self.pages, self.chars, self.links, self.value, self.page,
                [c.dump() for c in self.children.values()]]

    @staticmethod
    def load(data: list) -> Node:
        node = Node(data[0])
        node.pages, node.chars, node.links, node.value, node.page = data[1:6]
        node.children = {c[0]: Node.load(c) for c in data[6]}
        return node


def matching(a: Node, b: Node, known: dict) -> tuple[int, list[tuple[str, str]]]:
    """Simple tree matching: the most nodes that map onto each other in order, and the pairs of children that do."""
    key = (id(a), id(b))
    if key not in known:
        if a.label != b.label:
            known[key] = (0, [])
        else:
            left, right = list(a.children.values()), list(b.children.values())
            best = np.zeros((len(left) + 1, len(right) + 1), np.int64)
            gain = np.zeros_like(best)
            for i, x in enumerate(left, 1):
                for j, y in enumerate(right, 1):
                    gain[i, j] = matching(x, y, known)[0] if x.label == y.label else 0
                    best[i, j] = max(best[i - 1, j], best[i, j - 1], best[i - 1, j - 1] + gain[i, j])
            pairs, i, j = [], len(left), len(right)
            while i and j:
                if gain[i, j] and best[i, j] == best[i - 1, j - 1] + gain[i, j]:
                    pairs.append((left[i - 1].label, right[j - 1].label))
                    i, j = i - 1, j - 1
                elif best[i, j] == best[i - 1, j]:
                    i -= 1
                else:
                    j -= 1
            known[key] = (1 + int(best[-1, -1]), pairs[::-1])
    return known[key]


def _one(a, b):
    return b if a is None else a if b is None or a == b else 0


def align(template: Node, other: Node, known: dict | None = None) -> None:
    """Merge ``other`` into ``template``: matched nodes add up, the rest is inserted where it stood.

    A node that order keeps from being matched joins the template's node of its label.
    """
    known = {} if known is None else known
    pairs = dict((y, x) for x, y in matching(template, other, known)[1])
    template.pages += other.pages
    template.chars += other.chars
    template.links += other.links
    template.value, template.page = _one(template.value, other.value), _one(template.page, other.page)
    order, after = list(template.children), None
    for label, child in other.children.items():
        own = template.children.get(pairs.get(label, label))
        if own is None:
            template.children[label] = child
            order.insert(order.index(after) + 1 if after in order else 0, label)
            after = label
        else:
            align(own, child, known)
            after = own.label if label in pairs else after
    template.children = {label: template.children[label] for label in order}


# ---- pages


def label_of(tag: str, attributes: str) -> str:
    """Tag, classes, id, role and hidden mark; digits in names do not tell nodes apart."""
    if not attributes:
        return tag
    marks = []
    for name, a, b, c in _CLASS.findall(attributes):
        value = (a or b or c).lower()
        name = name.lower()
        if name in ("class", "id"):
            marks += [("." if name == "class" else "#") + re.sub(r"\d+", "0", w) for w in sorted(value.split())]
        else:
            marks.append("@" + (value if name != "hidden" else "hidden"))
    return " ".join([tag, *marks])


def shallow(path: list[str]) -> tuple[str, ...]:
    """A path of at most ``DEEPEST`` levels and two more."""
    kept = path[:DEEPEST]
    deeper = path[DEEPEST:]
    if deeper:
        content = next((k for k, label in enumerate(deeper) if is_content(label)), len(deeper))
        inside = any(map(is_content, kept))
        noise = next((k for k, label in enumerate(deeper) if is_noise(label, inside or k > content)), len(deeper))
        kept = kept + [deeper[k] for k in sorted({content, noise} - {len(deeper)})]
    return tuple(kept)


def blocks_of(page: str) -> Iterator[tuple[tuple[str, ...], str, int]]:
    """Text blocks in page order: the labels from the root down, the text, and how much of it stands in links."""
    path: list[str] = []  # labels of the open block elements
    tags: list[str] = []  # tags of all open elements
    text: list[str] = []
    linked = links = 0

    def block():
        nonlocal links
        found = " ".join(html.unescape("".join(text)).split())
        text.clear()
        n, links = links, 0
        return (shallow(path), found, min(n, len(found))) if found else None

    def close(n: int):
        nonlocal linked
        for tag in tags[n:]:
            if tag not in INLINE:
                path.pop()
            linked -= tag == "a"
        del tags[n:]

    at, size, unended = 0, len(page), 0

    def token(begin: int):
        """The next tag or comment from ``begin`` on."""
        nonlocal unended
        while unended < UNENDED and (start := _START.search(page, begin)):
            if m := _TOKEN.match(page, start.start()):
                return m
            unended += start.end() < size and page[start.end()] != "/"  # "</" before no letter costs nothing
            begin = start.end()
        return None

    while at < size:
        m = token(at)
        piece = page[at : m.start() if m else size]
        if piece:
            text.append(piece)
            links += len(piece) if linked else 0
        if not m:
            break
        at = m.end()
        tag = m[2]
        if tag is None:
            continue
        tag = tag.lower()
        if m[1]:
            if tag in tags:
                n = len(tags) - 1 - tags[::-1].index(tag)
                if tag in INLINE:  # an inline end tag does not end blocks
                    if all(t in INLINE for t in tags[n:]):
                        linked -= tag == "a"
                        del tags[n]
                else:
                    if found := block():
                        yield found
                    close(n)
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
            at = end.end() if end else size
            continue
        if tag in INLINE or tag == "br":
            if tag == "br":
                text.append(" ")
            elif tag not in VOID:
                tags.append(tag)
                linked += tag == "a"
            continue
        if found := block():
            yield found
        if "p" in tags:
            n = len(tags) - 1 - tags[::-1].index("p")
            if not SCOPES & set(tags[n + 1 :]):
                close(n)
        if tag in ENDS:
            for n in range(len(tags) - 1, -1, -1):
                if tags[n] in ENDS[tag]:
                    close(n)
                elif tags[n] in SCOPES:
                    break
        if tag not in VOID:
            tags.append(tag)
            path.append(label_of(tag, m[3]))
    if found := block():
        yield found


def tree_of(blocks: list[tuple[tuple[str, ...], str, int]]) -> Node:
    """The folded tree of a page."""
    root = Node("")
    whole = crc32("\n".join(b[1] for b in blocks).encode("utf-8", "replace")) + 1
    texts: dict[int, tuple[Node, list]] = {}
    root.pages, root.page = 1, whole
    for path, text, links in blocks:
        node = root
        for label in path:
            if label not in node.children:
                node.children[label] = Node(label)
            node = node.children[label]
            node.pages, node.page = 1, whole
        node.chars += len(text)
        node.links += links
        texts.setdefault(id(node), (node, []))[1].append(text)
    for node, own in texts.values():
        node.value = crc32("\n".join(own).encode("utf-8", "replace")) + 1
    return root


def is_noise(label: str, inside_content: bool) -> bool:
    tag, *marks = label.split(" ")
    if tag in NOISE_TAGS or tag == "header" and not inside_content:
        return True
    for mark in marks:
        if mark[0] == "@":
            if mark[1:] in NOISE_ROLES or mark == "@hidden":
                return True
        elif NOISE_WORDS.search(mark[1:]) and not is_content(label) and tag not in ("html", "body"):
            return True
    return False


def is_content(label: str) -> bool:
    tag, *marks = label.split(" ")
    return tag in ("article", "main") or "@main" in marks or "@articlebody" in marks


def content_paths(template: Node) -> tuple[set[tuple[str, ...]], tuple[str, ...]]:
    """The template's paths of constant nodes, and the path of its content region."""
    constant: set[tuple[str, ...]] = set()
    sums: dict[tuple[str, ...], int] = {}
    marked: list[tuple[str, ...]] = []

    def visit(node: Node, path: tuple[str, ...], inside: bool) -> int:
        if path and is_noise(node.label, inside):
            return 0
        content = is_content(node.label)
        if content and not inside:
            marked.append(path)
        same = node.value and not node.page and node.pages >= LEAST_PAGES and node.value != 0
        if same and node.label.split(" ")[0] not in HEADINGS:
            constant.add(path)
        own = 0 if same else node.chars - 2 * node.links
        own += sum(visit(c, (*path, c.label), inside or content) for c in node.children.values())
        sums[path] = own
        return own

    total = visit(template, (), False)
    if marked:
        top = max(marked, key=lambda p: (sums[p], -len(p), p))
        if sums[top] > 0:
            return constant, top
    path, node = (), template
    while node.children:
        best = max(node.children.values(), key=lambda c: (sums.get((*path, c.label), 0), c.label))
        if 2 * sums.get((*path, best.label), 0) <= total or best.label.split(" ")[0] in ("p", *HEADINGS):
            break
        path, node = (*path, best.label), best
    return constant, path


def main_text(blocks: list, constant: set, region: tuple[str, ...]) -> str:
    out = []
    for path, text, _ in blocks:
        if path[: len(region)] != region or path in constant:
            continue
        if any(is_noise(label, True) for label in path[len(region) :]) or (
            any("header" == label.split(" ")[0] for label in path) and path[-1].split(" ")[0] not in HEADINGS
        ):
            continue
        out.append(text)
    return "\n".join(out)


# ---- jobs


def host(url: str = "url") -> Column:
    """The host of an address, in lower case; empty if there is none."""
    found = F.regexp_extract(F.lower(F.col(url)), r"^[a-z][a-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)
    return F.coalesce(found, F.lit(""))


def _induce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A partial template for each host among a partition's pages."""
    templates: dict[str, Node] = {}
    part = TaskContext.get().partitionId()

    def flush():
        names = list(templates)
        out = [json.dumps(templates[h].dump()) for h in names]
        templates.clear()
        return pa.RecordBatch.from_arrays(
            [pa.array(names, pa.string()), pa.array([part] * len(names), pa.int64()), pa.array(out, pa.string())],
            ["host", "slot", "template"],
        )

    for batch in batches:
        for name, page in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist(), strict=True):
            blocks = list(blocks_of(page or ""))
            if not blocks:
                continue
            tree = tree_of(blocks)
            if name in templates:
                align(templates[name], tree)
            else:
                templates[name] = tree
        if len(templates) > 2000:
            yield flush()
    yield flush()


def _combine(table: pa.Table) -> pa.Table:
    """Align the partial templates of one host and slot group."""
    dumped = sorted(table.column("template").to_pylist())
    whole = Node.load(json.loads(dumped[0]))
    for other in dumped[1:]:
        align(whole, Node.load(json.loads(other)))
    out = json.dumps(whole.dump())
    return pa.table([table.column("host").slice(0, 1), table.column("slot").slice(0, 1), pa.array([out])], ["host", "slot", "template"])


def templates(pages: DataFrame) -> DataFrame:
    """One template per host, learned from all its pages: ``host``, ``template`` (JSON).

    Hosts with many pages have a partial template per partition; ``FAN_IN`` of them at a time are aligned, in as many
    rounds as it takes, so no task gets a large host whole.
    """
    rows = pages.select(host().alias("host"), "html")
    slots = rows.rdd.getNumPartitions()
    schema = "host string, slot long, template string"
    out = rows.mapInArrow(_induce, schema)
    while True:
        slots = -(-slots // FAN_IN)
        out = out.withColumn("slot", F.floor(F.col("slot") / FAN_IN)).groupBy("host", "slot").applyInArrow(_combine, schema)
        if slots <= 1:
            return out.select("host", "template")


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    wrappers: dict[str, tuple] = {}
    for batch in batches:
        texts = []
        for page, template in zip(batch.column("html").to_pylist(), batch.column("template").to_pylist(), strict=True):
            blocks = list(blocks_of(page or ""))
            if template is None:
                texts.append("")
                continue
            if template not in wrappers:
                if len(wrappers) > 500:
                    wrappers.clear()
                wrappers[template] = content_paths(Node.load(json.loads(template)))
            constant, region = wrappers[template]
            if not any(path[: len(region)] == region for path, _, _ in blocks):  # the page lacks the region: its own
                constant, region = content_paths(tree_of(blocks))
            texts.append(main_text(blocks, constant, region))
        yield pa.RecordBatch.from_arrays(
            [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
            ["page_id", "url", "text", "n_chars"],
        )


def main_texts(pages: DataFrame) -> DataFrame:
    """Main text of every row of ``pages`` (``page_id``, ``url``, ``html``): these ids, ``text`` and ``n_chars``.

    Character references are decoded, white space inside a block becomes one space, blocks are joined in page order by
    one line feed.  A null or empty page gives an empty text, a null address belongs to the empty host.  Repeated pages
    count as one page when constant text is looked for.  Other columns are ignored; an empty table gives no rows.
    """
    rows = pages.select(F.col("page_id").cast("long"), "url", "html", host().alias("host"))
    learned = staged(templates(pages))
    return (
        rows.join(learned, "host", "left")
        .select("page_id", "url", "html", "template")
        .mapInArrow(_extract, "page_id long, url string, text string, n_chars long")
    )
