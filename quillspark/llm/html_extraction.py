"""Main text of web pages by tree scoring.

A page is read once into a tree of its elements.  Every block of text passes
points for its length and its commas to its ancestors, fewer with distance and
fewer the more of it is link text.  The best container is kept, with those of
its siblings that score enough, and without what is never article text (menus,
forms, notices, comments and the like, by element, role, class or id) and
without boxes in it of three links or more that are little but links (lists of
sources stay, by class, id or role); lists of links that stand in the article
itself, headings and single links stay.

A name only casts doubt.  What is doubted (by a word of its class or id, or as a
form) is left out, unless the page has next to nothing outside: a wrapper that
holds nearly all plain text, or the ``main`` element, or the article with most of
the text, is a box like others, whatever it is called, and so are the boxes
around it.

The work is local to a page, so it is one map over Arrow batches with no
shuffle; memory is that of a page and its blocks.

Rows: null and empty pages, and pages without text, give an empty text;
unclosed elements end where HTML says or at the end of the page; of containers
of equal score the first counts; repeated rows give equal rows; further columns
are returned as they are, but for those named as the results.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Element and attribute names of HTML, and words that name parts of pages.
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript".split())
#: Elements whose content is never text of the page, and those of other languages, which end where a tag of HTML begins.
OFF = frozenset("template svg math canvas object audio video select".split())
FOREIGN = frozenset("svg math".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul caption".split()
)
PARAGRAPH = frozenset("p pre h1 h2 h3 h4 h5 h6 li dd dt td th blockquote figcaption caption summary".split())
NEVER = frozenset("head nav footer aside button dialog menu search fieldset".split())
#: Plain characters outside what is doubted, above which it is left out: where its
#: names say nothing else, and where they do.
OUTSIDE = 80, 300
LISTS = frozenset("ul ol dl".split())
#: Blocks beside the best container that need no score of their own to stay.
BESIDE = frozenset("p pre blockquote h2 h3 h4 h5 h6 ul ol dl figcaption".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
WHOLE = frozenset("html body article main".split())
NEVER_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar form".split())
NEVER_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising adsense adsbygoogle sponsor sponsored promo promos promotion banner "
    "nav navbar navigation menu menus breadcrumb breadcrumbs pagination pager footer masthead topbar toolbar skip "
    "sidebar aside rail related recommended recommendations teaser teasers trending promoted advertorial adbox adslot adunit submenu dropdown "
    "comment comments commentlist disqus respond responses reply replies guestbook "
    "cookie cookies consent gdpr notice notices alert popup modal overlay lightbox paywall newsletter subscribe subscription signup signin login "
    "share sharing social socials copyright disclaimer".split()
)
#: These name what is left out only where no name of content stands beside them.
WEAK_NAMES = frozenset("header widget widgets side popular tags follow legal feedback discussion".split())
CONTENT_NAMES = frozenset("article content entry post story text body main title".split())
#: These name what is left out alone or beside names of such and of mere parts ("share-buttons", not "share-price").
DOUBTFUL_NAMES = frozenset("share sharing notice notices alert banner rail skip related trending response responses respond reply replies teaser teasers promo copyright subscription".split())
PART_NAMES = frozenset(
    "bar bars box boxes block button buttons icon icons link links list lists item items area wrap wrapper container section group panel row column col inner outer top bottom left right "
    "posts post articles article stories content here widget widgets site page small large this on via count form count toggle message messages text tools".split()
)
#: A name that says what a page has or lacks ("has-sidebar", "no-print") names no part.
ABOUT_NAMES = frozenset("has with without no".split())
#: Lists of links that belong to the article.
SOURCE_NAMES = frozenset("references reference reflist bibliography footnotes endnotes citations sources".split())
HIDDEN_CLASSES = frozenset("hidden d-none sr-only visually-hidden".split())
CLOSED_BY_SAME = {"li": {"ul", "ol", "menu"}, "dd": {"dl"}, "dt": {"dl"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"}, "option": {"select"}}
INLINE = frozenset("b big br code em embed hr i img nobr ruby s small span strong strike sub sup tt u var".split())
#: HTML may stand in these parts of SVG and MathML.
ISLANDS = frozenset("foreignobject desc title annotation-xml mi mo mn ms mtext".split())
CLOSES_P = BLOCK - {"li", "dd", "dt", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "option", "optgroup", "legend", "summary", "html", "body"} | {"li", "dd", "dt"}

TAG = re.compile(r"<!--(?:>|->)?|<[!?]|</?([a-zA-Z][^\s/>]*)((?>[^\"'>]+|\"[^\"]*\"|'[^']*'|[\"'])*)>")
ATTRIBUTE = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
SELF_CLOSED = re.compile(r"(?<!=)(?:^|[\s\"'])/$|(?:^|\s)[^\s\"'=]+/$")
_raw_end: dict[str, re.Pattern] = {}


def _unwanted(tag: str, attributes: str, inside_article: bool) -> int:
    """2 for what is left out in any case; for what is doubted 1 and, as a negative
    number, -1 where all its names speak against it; else 0."""
    if tag in NEVER or tag == "header" and not inside_article:
        return 2
    if not attributes:
        return int(tag == "form")
    a = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(attributes)}
    if "hidden" in a or a.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", a.get("style", "")):
        return 2
    if tag in WHOLE and tag != "article":
        return 0
    role = a.get("role", "").lower()
    if role in NEVER_ROLES or not HIDDEN_CLASSES.isdisjoint(a.get("class", "").split()):
        return 1 if role == "form" and tag == "form" else 2
    names: set[str] = set()
    pure = True
    for name in f"{a.get('class', '')} {a.get('id', '')}".split():
        words = [x.lower() for x in NAME.findall(name)]
        if words and words[0] not in ABOUT_NAMES:
            plain = {x for x in words if x not in DOUBTFUL_NAMES}
            named = plain <= NEVER_NAMES | WEAK_NAMES | PART_NAMES
            names |= set(words) if named else plain
            pure = pure and named and not CONTENT_NAMES & set(words)
    if not NEVER_NAMES.isdisjoint(names) or not inside_article and CONTENT_NAMES.isdisjoint(names) and not WEAK_NAMES.isdisjoint(names):
        return -1 if pure else 1
    return int(tag == "form")


def _sources(attributes: str) -> bool:
    a = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(attributes)}
    return not SOURCE_NAMES.isdisjoint(x.lower() for x in NAME.findall(f"{a.get('class', '')} {a.get('id', '')} {a.get('role', '')}"))


class _Page:
    """Elements and blocks of a page, in page order; ``doubt`` is the nearest
    element around each one, itself included, that is doubted, or 0."""

    def __init__(self, html: str):
        self.tag, self.parent, self.off, self.source, self.doubt, self.pure = ["#"], [0], [False], [False], [0], [False]
        self.blocks: list[tuple[int, str, float, int]] = []  # element, text, share of link text, links
        self.stack = [0]
        self.at: dict[str, list[int]] = {}  # depths at which elements of a name are open
        self.block_depths = [0]
        self.open_blocks = [0]  # blocks of the stack that are not left out
        self.articles = 0  # how many articles are open
        self.pieces: list[str] = []
        self.linked = 0
        self.links = 0
        self.begun = 0  # links of the block
        self.foreign = 0
        self.parse(html)

    def flush(self) -> None:
        if self.pieces:
            text = " ".join("".join(self.pieces).split())
            if text:
                self.blocks.append((self.open_blocks[-1], text, min(1.0, self.linked / len(text)), self.begun + (self.links > 0)))
            self.pieces, self.linked, self.begun = [], 0, 0

    def add(self, text: str) -> None:
        if text and not self.off[self.stack[-1]]:
            text = unescape(text) if "&" in text else text
            self.pieces.append(text)
            if self.links:
                self.linked += len(text.strip())

    def close(self, depth: int) -> None:
        """Elements from ``depth`` of the stack on end here."""
        ended = self.stack[depth:]
        for k in reversed(ended):
            tag = self.tag[k]
            self.at[tag].pop()
            if tag == "a":
                self.links -= 1
                self.begun += not self.off[k]
            elif tag in FOREIGN:
                self.foreign -= 1
            self.articles -= tag in ("article", "main")
        if any(self.tag[k] in BLOCK and not self.off[k] for k in ended):
            self.flush()
        for k in reversed(ended):
            if self.tag[k] in BLOCK:
                self.block_depths.pop()
                if not self.off[k]:
                    self.open_blocks.pop()
        del self.stack[depth:]

    def depth_of(self, tag: str, until: frozenset[str] | set[str] = frozenset(), block: bool = False) -> int:
        """Depth of the open element ``tag``, if no name of ``until`` (no block,
        if so asked) was opened after it; else 0."""
        if not self.at.get(tag):
            return 0
        d = self.at[tag][-1]
        if block and self.block_depths[-1] > d:
            return 0
        return 0 if any(self.at[x][-1] > d for x in until if self.at.get(x)) else d

    def open(self, tag: str, attributes: str) -> None:
        if self.foreign and (tag in BLOCK or tag in INLINE) and (d := self.depth_of("svg", ISLANDS) or self.depth_of("math", ISLANDS)):
            self.close(d)
        if tag in CLOSES_P and (d := self.depth_of("p", {"td", "th", "table", "caption", "button", "article", "div", "section"} | OFF)):
            self.close(d)
        if tag in CLOSED_BY_SAME and (d := self.depth_of(tag, CLOSED_BY_SAME[tag] | OFF)):
            self.close(d)
        if tag in ("dd", "dt") and (d := self.depth_of("dt" if tag == "dd" else "dd", {"dl"} | OFF)):
            self.close(d)
        if tag == "a" and (d := self.depth_of("a", OFF, True)):
            self.close(d)
        up = self.stack[-1]
        if tag in BLOCK and not self.off[up]:
            self.flush()
        self.tag.append(tag)
        self.parent.append(up)
        judged = 0 if self.off[up] else _unwanted(tag, attributes, self.articles > 0)
        self.off.append(self.off[up] or tag in OFF or judged == 2)
        self.doubt.append(len(self.tag) - 1 if judged in (1, -1) else self.doubt[up])
        self.pure.append(judged < 0)
        self.source.append(self.source[up] or bool(attributes) and tag not in WHOLE and _sources(attributes))
        self.at.setdefault(tag, []).append(len(self.stack))
        if tag in BLOCK:
            self.block_depths.append(len(self.stack))
            if not self.off[-1]:
                self.open_blocks.append(len(self.tag) - 1)
        self.stack.append(len(self.tag) - 1)
        self.articles += tag in ("article", "main")
        self.foreign += tag in FOREIGN
        self.links += tag == "a"

    def parse(self, html: str) -> None:
        at, n = 0, len(html)
        while m := TAG.search(html, at):
            self.add(html[at : m.start()])
            at = m.end()
            if not m[1]:
                end = html.find("-->", at) if m[0].startswith("<!--") else html.find(">", at)
                if m[0] in ("<!-->", "<!--->"):
                    continue
                at = n if end < 0 else end + (3 if m[0].startswith("<!--") else 1)
                continue
            tag = m[1].lower()
            if m[0][1] == "/":
                if tag == "br":
                    self.add(" ")
                elif d := self.depth_of(tag, block=tag not in BLOCK and tag not in OFF):
                    self.close(d)
                continue
            if (self.foreign or tag in FOREIGN) and SELF_CLOSED.search(m[2]) and tag not in BLOCK:
                continue
            if tag in RAW and not (self.foreign and tag == "title"):
                end = _raw_end.setdefault(tag, re.compile(rf"</{tag}[\s/>]", re.I)).search(html, at)
                at = n if not end else end.start()
                continue
            if tag in VOID:
                if tag == "br":
                    self.add(" ")
                elif tag == "hr" and not self.off[self.stack[-1]]:
                    self.flush()
                continue
            if tag == "body" and (d := self.depth_of("head")):
                self.close(d)
            self.open(tag, m[2])
        self.add(html[at:])
        self.close(1)
        self.flush()


def _left_out(page: _Page) -> list[bool]:
    """Which elements are left out: those that are in any case, and the doubted
    ones that are no wrapper of the text."""
    n, doubt, parent = len(page.tag), page.doubt, page.parent
    plain = [0.0] * n  # of the doubted element nearest to a block; 0 is outside
    for k, text, share, _ in page.blocks:
        plain[doubt[k]] += (1 - share) * len(text)
    cleared = [False] * n
    cleared[0] = True
    total = sum(plain)

    def clear(k: int) -> None:
        while k:
            if not cleared[k]:
                cleared[k] = True
                plain[0] += plain[k]
            k = doubt[parent[k]]

    text_of, chars = [0.0] * n, [0] * n
    for k, text, share, _ in page.blocks:
        text_of[k] += (1 - share) * len(text)
        chars[k] += len(text)
    for k in range(n - 1, 0, -1):
        text_of[parent[k]] += text_of[k]
        chars[parent[k]] += chars[k]
    told = any(chars[k] and not doubt[k] and page.tag[k] in ("article", "main") for k in range(1, n))  # the page says where its text is
    for k in range(1, n):
        around = doubt[parent[k]] if doubt[k] == k else doubt[k]
        if around and not page.off[k] and (page.tag[k] == "main" or page.tag[k] == "article" and doubt[k] != k and not page.pure[around] and 2 * text_of[k] > total):
            clear(around)
    for k in sorted((k for k in range(1, n) if doubt[k] == k and plain[k]), key=lambda k: (-plain[k], k)):
        if not told and not cleared[k] and plain[k] > 4 * plain[0] and plain[0] < OUTSIDE[not page.pure[k]]:
            clear(k)
    out = page.off[:]
    for k in range(1, n):
        out[k] = out[k] or out[parent[k]] or doubt[k] == k and not cleared[k]
    return out


def main_text(html: str | None) -> str:
    """The article of a page, its blocks joined by two line ends."""
    if not html:
        return ""
    page = _Page(html)
    page.off = _left_out(page)
    page.blocks = [x for x in page.blocks if not page.off[x[0]]]
    tag, parent = page.tag, page.parent
    n = len(tag)
    score, chars, linked, held = [0.0] * n, [0] * n, [0.0] * n, [0] * n
    for k, text, share, _ in page.blocks:
        chars[k] += len(text)
        held[k] += 1
        linked[k] += share * len(text)
        points = (1 + text.count(",") + text.count("，") + min(3.0, len(text) / 100)) * (1 - share)
        up = parent[k] if tag[k] in PARAGRAPH else k
        for level in range(1, 6):
            score[up] += points / level if level < 3 else points / (3 * level - 6)
            if not up:
                break
            up = parent[up]
    for k in range(n - 1, 0, -1):
        chars[parent[k]] += chars[k]
        linked[parent[k]] += linked[k]
        held[parent[k]] += held[k]
    bonus = {"article": 25, "main": 15, "div": 5, "section": 5, "blockquote": 3, "td": 3, "address": -3}
    final = [(score[k] + bonus.get(tag[k], 0)) * (1 - linked[k] / max(1, chars[k])) if score[k] and tag[k] not in PARAGRAPH and tag[k] not in LISTS else 0.0 for k in range(n)]
    best = max(range(n), key=lambda k: (final[k], -k))
    if not final[best]:
        best = 0
    k = best
    while k and tag[k] not in ("article", "main"):
        k = parent[k]
    best = k or best
    chosen = [False] * n
    chosen[best] = True
    if tag[best] not in ("article", "main", "body", "html", "#"):
        enough = max(10.0, 0.2 * final[best])
        for k in range(1, best):  # a headline in a box beside it
            chosen[k] = tag[k] == "h1" and not page.off[k] and parent[parent[k]] == parent[best]
        for k in range(1, n):
            if parent[k] == parent[best] and not page.off[k]:
                share = linked[k] / max(1, chars[k])
                chosen[k] = chosen[k] or final[k] >= enough or tag[k] == "h1" or tag[k] in BESIDE and share < 0.25 and (chars[k] > 80 or not share and chars[k] > 0)
    # a box of links in the container goes as a whole; lists, headings and single links stay
    dropped = [False] * n
    for k in range(1, n):
        inside = chosen[parent[k]]
        chosen[k] = chosen[k] or inside
        box = tag[k] in BLOCK and tag[k] not in LISTS and tag[k] not in PARAGRAPH and not page.source[k]
        dropped[k] = inside and (dropped[parent[k]] or box and held[k] > 2 and linked[k] >= 0.7 * chars[k])
    gone = lambda k, share, links: dropped[k] or share >= 0.7 and links > 2 and tag[k] not in PARAGRAPH and not page.source[k]
    return "\n\n".join(text for k, text, share, links in page.blocks if chosen[k] and not gone(k, share, links))


def extract(pages: DataFrame, html: str = "html", text: str = "text") -> DataFrame:
    """``pages`` without ``html``, with ``text`` and its code points ``n_chars``."""
    kept = [x for x in pages.columns if x not in (html, text, "n_chars")]
    rest = F.struct(F.lit(0), *[F.col(f"`{x}`").alias(f"r{k}") for k, x in enumerate(kept)])  # names may be any
    src = pages.select(rest.alias("rest"), F.col(html).cast("string").alias("html"))
    kind = T.StructType([src.schema["rest"], T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(x) for x in b.column("html").to_pylist()]
            yield pa.record_batch([b.column("rest"), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], names=["rest", "text", "n_chars"])

    return src.mapInArrow(run, kind).select(*[F.col(f"rest.r{k}").alias(x) for k, x in enumerate(kept)], F.col("text").alias(text), "n_chars")
