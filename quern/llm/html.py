"""Main text of web pages by wrapper induction per host."""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Iterator
from hashlib import blake2b
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import Stages, read_table

#: A slot is template if so many of the different pages of its host, and one more, have the pivot's text in it.
CONSTANT = 2 / 3
#: A varying slot outside an article is a menu if this share of its characters is link text.
LINKED = 0.7
#: Models (about 1 KB a host) are broadcast up to this size in bytes; beyond it they are joined by a shuffle.
BROADCAST_BYTES = 64 << 20
#: Hosts whose picked pages (a name and a number) may be broadcast.
BROADCAST_ROWS = 1_000_000

# HTML element names and words in class, id and role that mark parts beside the article.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer"
    " form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section select"
    " summary table tbody td tfoot th thead tr ul".split()
)
NOISE_TAGS = frozenset(
    "head script style noscript template nav footer aside form button select textarea input iframe noembed noframes svg"
    " canvas object audio video dialog menu search title xmp".split()
)
#: Words that mark a part beside the article wherever they stand in a class or id.
NOISE_WORDS = frozenset(
    "ads advert adverts advertisement advertising adsense adsbygoogle sponsored navbar navigation breadcrumb breadcrumbs sidebar"
    " footer masthead comment comments disqus cookie cookies gdpr newsletter pagination".split()
)
#: Words that do so as a whole class or id, or together with other such words and PLACE_WORDS ("ad", "top-menu", "share-bar").
#: In other compounds ("search-results", "social-science") they mark a part only if most of its text is links.
WEAK_WORDS = frozenset(
    "ad sponsor promo promoted promotion banner menu nav rail widget widgets respond replies reply consent notice notices alert"
    " popup modal overlay subscribe subscription signup login share sharing social related recommended recommendations pager"
    " toolbar skip search".split()
)
PLACE_WORDS = frozenset(
    "area bar block bottom box buttons container form header icons inner item items left link links list main mobile outer panel primary"
    " region right secondary section site slot top unit wrap wrapper".split()
)
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar".split())
HEADER_WORDS = frozenset(["header", "topbar"])
MAIN_TAGS = frozenset(["article", "main"])
#: Parts of a class that tell how an element looks and not what it is ("with-sidebar", "comments-open").
STATE_FIRST = frozenset("with has no is without".split())
STATE_LAST = frozenset("open closed enabled disabled on off".split())

#: An open element of the key is closed by the start of any element named.
_ITEMS = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option", "optgroup"}, "tr": {"tr", "tbody", "tfoot"},
    "td": {"td", "th", "tr", "tbody", "tfoot"}, "th": {"td", "th", "tr", "tbody", "tfoot"},
}
_CLOSES = {name: {x for x, ends in _ITEMS.items() if name in ends} for ends in _ITEMS.values() for name in ends}
_SCOPES = {"li": {"ul", "ol", "menu", "dir"}, "dt": {"dl"}, "dd": {"dl"}, "option": {"select"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}}

_NAME = re.compile(r"/?[a-zA-Z][^\s/>]*")
_UNQUOTED = re.compile(r"[^\"'>]*")
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[0-9]+")


def tags(html: str) -> Iterator[tuple[int, int, str, str]]:
    """(start, end, name, attributes) of each tag, comment or declaration (name empty), each character being read once or twice.

    A ``<`` that no ``>`` ends, or no name follows, is text. Where quotes hide every ``>`` up to the end of the page,
    tags end at the next one from there on.
    """
    at, size, strict = 0, len(html), True
    last = html.rfind(">")
    last_quote = {q: html.rfind(q) for q in "\"'"}
    while True:
        start = html.find("<", at)
        if start < 0:
            return
        if html.startswith("<!--", start):
            end = html.find("-->", start + 4)
            at = end + 3 if end >= 0 else size
            yield start, at, "", ""
            continue
        if start > last:
            return
        if html[start + 1 : start + 2] in ("!", "?"):
            at = html.find(">", start) + 1
            yield start, at, "", ""
            continue
        name = _NAME.match(html, start + 1)
        if not name:
            at = start + 1
            continue
        end = name.end()
        while strict:
            end = _UNQUOTED.match(html, end).end()
            if end >= size:
                strict = False
            elif html[end] == ">":
                break
            elif last_quote[html[end]] > end:
                end = html.index(html[end], end + 1) + 1
            else:
                end += 1
        if not strict:
            end = html.find(">", name.end())
        yield start, end + 1, name[0].lower(), html[name.end() : end]
        at = end + 1


class Node:
    """A slot: an element, or neighbouring elements of the same name and class."""

    __slots__ = ("sign", "children", "blocks", "noise", "main", "suspect")

    def __init__(self, sign: str, noise: bool, main: bool, suspect: int = 0):
        """``suspect``: the number of the outermost element around it whose name may mark a part beside the article."""
        self.sign, self.noise, self.main, self.suspect = sign, noise, main, suspect
        self.children: list[Node] = []
        self.blocks: list[int] = []


class Page:
    """The tree of slots of a page and its blocks in page order: [slot, text, characters in links]."""

    def __init__(self, html: str):
        self.root = Node("#", False, False)
        self.blocks: list[list] = []
        self._buffer: list[str] = []
        self._linked = 0
        self._parse(html)
        links: dict[int, list[int]] = {}
        for slot, text, linked in self.blocks:
            if slot.suspect:
                n = links.setdefault(slot.suspect, [0, 0])
                n[0] += linked
                n[1] += len(text)
        #: Suspects whose text is mostly links.
        self.menus = {x for x, (linked, chars) in links.items() if linked >= LINKED * chars}

    def _flush(self, slot: Node) -> None:
        if self._buffer:
            text = " ".join(unescape("".join(self._buffer)).split())
            if text:
                slot.blocks.append(len(self.blocks))
                self.blocks.append([slot, text, self._linked])
            self._buffer, self._linked = [], 0

    def _parse(self, html: str) -> None:
        # an open element: (name, slot that takes its text, is it a block)
        stack: list[tuple[str, Node, bool]] = [("#", self.root, True)]
        opened: Counter[str] = Counter()
        links, at, skip, end = 0, 0, 0, len(html)

        def close(depth: int) -> None:
            nonlocal links
            while len(stack) > depth:
                name, slot, block = stack.pop()
                opened[name] -= 1
                if block:
                    self._flush(slot)
                links -= name == "a"

        def text(piece: str) -> None:
            if piece:
                self._buffer.append(piece)
                if links:
                    self._linked += len(piece.strip())

        for start, stop, name, inside in tags(html):
            if start < skip:  # within a raw element
                continue
            text(html[at:start])
            at = stop
            if not name:
                continue
            if name[0] == "/":
                name = name[1:]
                for depth in range(len(stack) - 1, 0, -1) if opened[name] else ():
                    if stack[depth][0] == name:
                        close(depth)
                        break
                    if stack[depth][2] and name not in BLOCKS:
                        break
                else:
                    if name in BLOCKS:
                        self._flush(stack[-1][1])
                continue
            if name == "br":
                text(" ")
                continue
            block = name in BLOCKS or name in NOISE_TAGS
            if block and name not in NOISE_TAGS - BLOCKS:
                for depth in range(len(stack) - 1, 0, -1) if opened["p"] else ():  # a paragraph ends where a block begins
                    if stack[depth][0] == "p":
                        close(depth)
                        break
                    if stack[depth][2]:
                        break
            if name in _CLOSES and any(opened[x] for x in _CLOSES[name]):
                for depth in range(len(stack) - 1, 0, -1):
                    other = stack[depth][0]
                    if other in _ITEMS and name in _ITEMS[other]:
                        close(depth)
                        break
                    if other in _SCOPES.get(name, {"table", "select"}):
                        break
            parent = stack[-1][1]
            attributes = {a.lower(): b or c or d or "" for a, b, c, d in _ATTRIBUTE.findall(inside)} if inside else {}
            named = parent.noise or self._noise(name, attributes, parent.main)
            noise, suspect = bool(named), parent.suspect or (start + 1 if named is None else 0)
            if block or noise != parent.noise:
                self._flush(parent)
                sign = f"{name}.{re.sub('[0-9]+', '#', attributes.get('class', ''))}"
                last = parent.children[-1] if parent.children else None
                if last is None or last.sign != sign or last.noise != noise or bool(last.suspect) != bool(suspect):
                    last = Node(sign, noise, parent.main or name in MAIN_TAGS or attributes.get("role") == "main", suspect)
                    parent.children.append(last)
                slot, block = last, True
            else:
                slot = parent
            if name in RAW:
                ending = re.compile(f"</{re.escape(name)}", re.I).search(html, at)
                if not slot.noise:
                    text(html[at : ending.start() if ending else end])
                    self._flush(slot)
                at = ending.start() if ending else end
                if ending:
                    at = html.find(">", at) + 1 or end
                skip = at
            elif name not in VOID and not (inside.endswith("/") and name not in BLOCKS):
                stack.append((name, slot, block))
                opened[name] += 1
                links += name == "a"
            elif block:
                self._flush(slot)
        text(html[at:])
        close(1)
        self._flush(self.root)

    @staticmethod
    def _noise(name: str, attributes: dict[str, str], in_main: bool) -> bool | None:
        """Whether the element is a part beside the article; None if its links decide."""
        if name in NOISE_TAGS or (name == "header" and not in_main):
            return True
        if name in ("html", "body", "article", "main") and not attributes.get("class"):
            return False
        if not attributes:
            return False
        if "hidden" in attributes or attributes.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", attributes.get("style", "")):
            return True
        if attributes.get("role", "").lower() in NOISE_ROLES:
            return True
        if name in ("html", "body") or (name in MAIN_TAGS and not in_main):
            return False
        suspect = False
        for token in f"{attributes.get('class', '')} {attributes.get('id', '')}".split():
            parts = [w.lower() for w in _WORD.findall(token)]
            if not parts or (len(parts) > 1 and (parts[0] in STATE_FIRST or parts[-1] in STATE_LAST)):
                continue
            words = {w for w in parts if not w.isdigit()}
            if words & NOISE_WORDS or (not in_main and words & HEADER_WORDS):
                return True
            if words & WEAK_WORDS:
                if words <= WEAK_WORDS | PLACE_WORDS:
                    return True
                suspect = True
        return None if suspect else False


def digest(text: str) -> str:
    return blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).hexdigest()


def preorder(root: Node) -> tuple[list[Node], list[int]]:
    """The slots of a tree, parents first and in page order, and the places of their parents (-1 for the root)."""
    nodes, parents, stack = [], [], [(root, -1)]
    while stack:
        node, parent = stack.pop()
        at = len(nodes)
        nodes.append(node)
        parents.append(parent)
        stack.extend((c, at) for c in reversed(node.children))
    return nodes, parents


Shape = tuple[tuple[str, int], ...]


def shape(page: Page) -> Shape:
    """(sign, place of the parent) of every slot."""
    nodes, parents = preorder(page.root)
    return tuple((n.sign, p) for n, p in zip(nodes, parents))


def skeleton(page: Page) -> list:
    """[sign, place of the parent, digests of all, first and last block] of every slot."""
    out = []
    for node, parent in zip(*preorder(page.root)):
        t = [page.blocks[i][1] for i in node.blocks]
        out.append([node.sign, parent, [digest("\n".join(t)), digest(t[0]), digest(t[-1])] if t else None])
    return out


def children(tree: Shape) -> list[list[int]]:
    out: list[list[int]] = [[] for _ in tree]
    for i, (_, parent) in enumerate(tree):
        if parent >= 0:
            out[parent].append(i)
    return out


def match(a: Shape, b: Shape) -> tuple[int, dict[int, int]]:
    """Simple tree matching of shapes: (matched slots, pairs of places) of a largest top-down matching that keeps the
    order of children. Pairs of slots wait on a stack, so depth has no limit."""
    kids_a, kids_b = children(a), children(b)
    worth: dict[tuple[int, int], int] = {}

    def ends(x: int, y: int) -> tuple[list[int], list[int], list[tuple[int, int]]]:
        """The children of both but for equal leaves at the ends, which a largest matching may always pair."""
        p, q, paired = kids_a[x], kids_b[y], []
        same = lambda i, j: a[i][0] == b[j][0] and not kids_a[i] and not kids_b[j]
        low, high = 0, 0
        while low < min(len(p), len(q)) and same(p[low], q[low]):
            paired.append((p[low], q[low]))
            low += 1
        while high < min(len(p), len(q)) - low and same(p[-1 - high], q[-1 - high]):
            paired.append((p[-1 - high], q[-1 - high]))
            high += 1
        return p[low : len(p) - high], q[low : len(q) - high], paired

    def table(p: list[int], q: list[int]) -> list[list[int]]:
        best = [[0] * (len(q) + 1)]
        for i in p:
            row, above = [0], best[-1]
            for k, j in enumerate(q):
                n = max(above[k + 1], row[k])
                if a[i][0] == b[j][0]:
                    n = max(n, above[k] + worth[i, j])
                row.append(n)
            best.append(row)
        return best

    if not a or not b or a[0][0] != b[0][0]:
        return 0, {}
    stack = [(0, 0, False)]
    while stack:
        x, y, ready = stack.pop()
        p, q, paired = ends(x, y)
        if ready or not p or not q:
            worth[x, y] = 1 + len(paired) + (table(p, q)[-1][-1] if p and q else 0)
        else:
            stack.append((x, y, True))
            stack.extend((i, j, False) for i in p for j in q if a[i][0] == b[j][0])
    pairs, todo = {}, [(0, 0)]
    while todo:
        x, y = todo.pop()
        pairs[x] = y
        p, q, paired = ends(x, y)
        pairs.update(paired)
        best, i, k = table(p, q) if p and q else [[0]], len(p), len(q)
        while p and q and i and k:
            if best[i][k] == best[i - 1][k]:
                i -= 1
            elif best[i][k] == best[i][k - 1]:
                k -= 1
            else:
                i, k = i - 1, k - 1
                todo.append((p[i], q[k]))
    return worth[0, 0], pairs


class Aligner:
    """Aligns pages with the pivots of their hosts; equal pairs of shapes are aligned once."""

    def __init__(self):
        self.pivots: dict[str, tuple[Shape, list]] = {}
        self.known: dict[tuple[Shape, Shape], dict[int, int]] = {}

    def pivot(self, text: str) -> tuple[Shape, list]:
        if text not in self.pivots:
            if len(self.pivots) > 5000:
                self.pivots.clear()
            slots = json.loads(text)
            self.pivots[text] = tuple((sign, parent) for sign, parent, _ in slots), [d for _, _, d in slots]
        return self.pivots[text]

    def __call__(self, page: Page, text: str) -> list[tuple[Node, int | None, list | None]]:
        """(slot, place of the pivot's slot, its digests) for every slot of the page."""
        theirs, digests = self.pivot(text)
        key = (shape(page), theirs)
        if key not in self.known:
            if len(self.known) > 5000:
                self.known.clear()
            self.known[key] = match(*key)[1]
        pairs = self.known[key]
        return [
            (node, pairs.get(i), digests[pairs[i]] if i in pairs else None) for i, node in enumerate(preorder(page.root)[0])
        ]


PARTS = ("all", "first", "last")


def slot_parts(page: Page, node: Node) -> list[tuple[int, str]]:
    t = [page.blocks[i][1] for i in node.blocks]
    return [(0, digest("\n".join(t))), *([(1, digest(t[0])), (2, digest(t[-1]))] if len(t) > 1 else [])] if t else []


def main_text(page: Page, aligned: list[tuple], flags: frozenset) -> str:
    """Blocks that are neither marked as noise nor template nor menus; those of articles if the page has any."""
    gone: set[int] = set()
    for node, place, theirs in aligned:
        if theirs is None or not node.blocks:
            continue
        if (place, 3) in flags and not node.main:
            gone.update(node.blocks)
        for part, d in slot_parts(page, node):
            if (place, part) in flags and d == theirs[part]:
                gone.update(node.blocks if part == 0 else node.blocks[:1] if part == 1 else node.blocks[-1:])
    kept = [b for i, b in enumerate(page.blocks) if i not in gone and not b[0].noise and b[0].suspect not in page.menus]
    if any(b[0].main for b in kept):
        kept = [b for b in kept if b[0].main]
    return "\n".join(b[1] for b in kept)


MODEL = "host string, skeleton string, flags array<string>"


def induce_wrappers(stages: Stages, pages: DataFrame) -> DataFrame:
    """One MODEL row per host of ``pages(host, key, html)``.

    A host's pivot is one page, picked by hash. Every page is aligned with it by simple tree matching; per slot the
    pages that repeat the pivot's text and the share of link text are counted, summed in the task and then per host.
    Copies of the pivot as a whole do not count. No group of pages is gathered anywhere.
    """
    some = pages.where("html is not null and html <> ''")
    # the pages are picked by their keys alone; html is read again for the picked ones and never dealt out
    pick = stages.table(some.groupBy("host").agg(F.min(F.xxhash64("key")).alias("pick")))
    picked = some.join(F.broadcast(pick) if pick.count() <= BROADCAST_ROWS else pick, (some["host"] == pick["host"]) & (F.xxhash64("key") == F.col("pick")))
    chosen = picked.select(some["host"], "html").dropDuplicates(["host"])

    def outline(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [json.dumps(skeleton(Page(h))) for h in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], ["host", "skeleton"])

    pivots = stages.table(chosen.mapInArrow(outline, "host string, skeleton string"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        align = Aligner()
        seen: dict[tuple, list[int]] = {}

        def rows():
            keys = list(seen)
            yield pa.RecordBatch.from_arrays(
                [pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.int32()), pa.array([k[2] for k in keys], pa.int32())]
                + [pa.array([seen[k][i] for k in keys], pa.int64()) for i in range(4)],
                ["host", "place", "part", "pages", "same", "chars", "linked"],
            )

        for b in batches:
            for host, html, text in zip(b.column(0).to_pylist(), b.column(1), b.column(2)):
                page = Page(html.as_py())
                aligned = align(page, text.as_py())
                found = [(place, part, d == theirs[part], node) for node, place, theirs in aligned if theirs for part, d in slot_parts(page, node)]
                if all(x[2] for x in found):
                    continue
                for place, part, same, node in found:
                    n = seen.setdefault((host, place, part), [0, 0, 0, 0])
                    n[0] += 1
                    n[1] += same
                    if part == 0:
                        n[2] += sum(len(page.blocks[i][1]) for i in node.blocks)
                        n[3] += sum(page.blocks[i][2] for i in node.blocks)
            if len(seen) > 200_000:
                yield from rows()
                seen.clear()
        yield from rows()

    counts = (
        with_model(some.select("host", "html"), pivots).mapInArrow(count, "host string, place int, part int, pages long, same long, chars long, linked long")
        .groupBy("host", "place", "part").agg(*[F.sum(c).alias(c) for c in ("pages", "same", "chars", "linked")])
    )
    flag = lambda part: F.concat_ws(":", "place", part)
    flags = counts.select(
        "host",
        F.explode(F.array(
            F.when(F.col("same") >= CONSTANT * (F.col("pages") + 1), flag(F.col("part").cast("string"))),
            F.when((F.col("part") == 0) & (F.col("linked") >= LINKED * F.col("chars")), flag(F.lit("3"))),
        )).alias("flag"),
    ).where("flag is not null").groupBy("host").agg(F.collect_set("flag").alias("flags"))
    return stages.table(pivots.join(flags, "host", "left").select("host", "skeleton", F.coalesce("flags", F.array().cast("array<string>")).alias("flags")))


def with_model(pages: DataFrame, models: DataFrame) -> DataFrame:
    """Joins pages with the rows of their hosts; the models' size is measured before they are broadcast."""
    size = models.agg(F.sum(F.length("skeleton") + 200)).first()[0] or 0
    return pages.join(F.broadcast(models) if size <= BROADCAST_BYTES else models, "host", "left")


def extract_text(pages: DataFrame) -> DataFrame:
    """(page_id, url, text) for every row of ``pages(page_id, url, html)``.

    Pages of a host share a wrapper (induce_wrappers): slots with constant text are template, varying slots are
    content unless they are mostly links, or their element, class, id or role marks them as menu, header, footer,
    sidebar, notice, advert, form or reader comments: what changes from page to page cannot be told from the article by
    alignment, and hosts of one or two pages have no template. On pages with an article or main element the content is what they
    hold. Blocks are trimmed, their white space is one space, character references are decoded; a br is white space.

    Null or empty html, and pages without content: empty text. Null url: pages without host share a wrapper. Unclosed
    and crossing elements end with the block they began in; depth and length have no limit. Repeated rows give repeated results; an empty table gives
    none; other columns are not read.
    """
    stages = Stages(pages.sparkSession, "html")
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#]*)", 1))
    rows = pages.select(F.col("page_id").cast("long"), "url", "html", host.alias("host"))
    models = induce_wrappers(stages, rows.select("host", F.struct("page_id", "url").alias("key"), "html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        align = Aligner()
        known: dict[tuple, frozenset] = {}
        for b in batches:
            out = []
            for html, text, flags in zip(b.column(2), b.column(3), b.column(4).to_pylist()):
                html, text = html.as_py(), text.as_py()
                if not html:
                    out.append("")
                    continue
                page = Page(html)
                key = tuple(flags or ())
                if key not in known:
                    known[key] = frozenset(tuple(map(int, f.split(":"))) for f in key)
                out.append(main_text(page, align(page, text) if text and key else [], known[key]))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.string())], ["page_id", "url", "text"])

    joined = with_model(rows, models).select("page_id", "url", "html", "skeleton", "flags")
    return joined.mapInArrow(run, "page_id long, url string, text string")


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(read_table(spark, sf_dir, "pages")).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
