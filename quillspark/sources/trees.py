"""Trees of elements flattened in pre-order, by table functions.

A table function reads one document and emits a row for each element: its flat
index, its parent's, its number among its siblings, its depth, and references to
other elements by flat index.  Ids are hashes of the document's key and the flat
index, so parents and references become ids without a join.
"""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Elements of HTML without content, and headings.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HEADINGS = {f"h{k}": k for k in range(1, 7)}

NODE = "idx int, parent int, sibling int, depth int"
PAGE_NODE = f"{NODE}, tag string, text string, refs array<struct<to:int,type:string>>"


class _Elements(HTMLParser):
    """The elements of a page in the order they open."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.rows: list[list] = []  # idx, parent, sibling, depth, tag
        self.pieces: list[list[str]] = []
        self.open: list[int] = []
        self.children: dict[int, int] = {}
        self.by_id: dict[str, int] = {}
        self.wanted: list[tuple[int, str]] = []  # an element, the id it refers to
        self.headings: list[int] = []  # that are above what follows
        self.refs: dict[int, list[tuple[int, str]]] = {}

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        k, up = len(self.rows), self.open[-1] if self.open else -1
        n = self.children.get(up, 0)
        self.children[up] = n + 1
        self.rows.append([k, up if up >= 0 else None, n, len(self.open), tag])
        self.pieces.append([])
        found = dict(attrs)
        if found.get("id"):
            self.by_id.setdefault(found["id"], k)
        target = found.get("href") or ""
        if tag == "a" and target.startswith("#") and len(target) > 1:
            self.wanted.append((k, target[1:]))
        if tag == "label" and found.get("for"):
            self.wanted.append((k, found["for"]))
        if tag in HEADINGS:
            while self.headings and HEADINGS[self.rows[self.headings[-1]][4]] >= HEADINGS[tag]:
                self.headings.pop()
        if self.headings and tag in ("p", "a", "table", "figure", *HEADINGS):
            self.refs.setdefault(k, []).append((self.headings[-1], "section"))
        if tag in HEADINGS:
            self.headings.append(k)
        if tag not in VOID:
            self.open.append(k)

    def handle_endtag(self, tag: str) -> None:
        for depth in range(len(self.open) - 1, -1, -1):
            if self.rows[self.open[depth]][4] == tag:
                del self.open[depth:]
                return

    def handle_data(self, data: str) -> None:
        if self.open:
            self.pieces[self.open[-1]].append(data)


def page_nodes(html: str | None) -> Iterator[tuple]:
    """The rows of one page: (idx, parent, sibling, depth, tag, text, refs).

    An end tag ends the nearest open element of its name with all in it, one
    that finds none is passed over; what is open at the end of the page ends
    there.  ``text`` is what stands directly in the element, white space as one
    space.  A link or label refers to the first element of the id it names
    (``link``), and a paragraph, link, table, figure or heading to the heading it
    stands under (``section``).  References to ids that the page lacks are left out.
    """
    if not html:
        return
    page = _Elements()
    page.feed(html)
    page.close()
    for k, name in page.wanted:
        if name in page.by_id:
            page.refs.setdefault(k, []).append((page.by_id[name], "link"))
    for row, pieces in zip(page.rows, page.pieces, strict=True):
        yield (*row, " ".join("".join(pieces).split()), sorted(page.refs.get(row[0], [])))


class _PageTree:
    def eval(self, html: str):
        yield from page_nodes(html)


class _LevelTree:
    """Elements given by their levels; one without a level is a leaf of the
    element with a level that precedes it."""

    def eval(self, levels: list):
        above: list[tuple[int, int]] = []  # index and level of what is open
        children: dict[int, int] = {}
        for k, level in enumerate(levels if levels is not None else []):
            while level is not None and above and above[-1][1] >= level:
                above.pop()
            up = above[-1][0] if above else -1
            n = children.get(up, 0)
            children[up] = n + 1
            yield k, up if up >= 0 else None, n, len(above)
            if level is not None:
                above.append((k, int(level)))


def element_id(key: Column, idx: Column) -> Column:
    """The id of the element ``idx`` of a document; null where either is."""
    return F.when(key.isNotNull() & idx.isNotNull(), F.substring(F.sha2(F.concat_ws("/", key.cast("string"), idx.cast("string")), 256), 1, 32))


def page_elements(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """(key, idx, id, parent, parent_id, sibling, depth, tag, text, refs) of all pages."""
    tree = F.udtf(_PageTree, returnType=PAGE_NODE)
    out = pages.select(F.col(key).alias("_key"), F.col(html).cast("string").alias("_html")).lateralJoin(tree(F.col("_html").outer()))
    return out.select(F.col("_key").alias(key), "idx", element_id(F.col("_key"), F.col("idx")).alias("id"), "parent", element_id(F.col("_key"), F.col("parent")).alias("parent_id"), "sibling", "depth", "tag", "text", "refs")


def references(elements: DataFrame, key: str = "page_id") -> DataFrame:
    """(key, from_id, to_id, type) of elements (key, id, refs)."""
    each = elements.select(F.col(key).alias("_key"), "id", F.explode("refs").alias("r"))
    return each.select(F.col("_key").alias(key), F.col("id").alias("from_id"), element_id(F.col("_key"), F.col("r.to")).alias("to_id"), F.col("r.type").alias("type"))


def level_tree(docs: DataFrame, levels: Column, *keep: str) -> DataFrame:
    """(keep, idx, parent, sibling, depth) of documents whose elements have these
    levels (an array in their order)."""
    tree = F.udtf(_LevelTree, returnType=NODE)
    return docs.select(*keep, levels.alias("_levels")).lateralJoin(tree(F.col("_levels").outer())).drop("_levels")
