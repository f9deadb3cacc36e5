"""HTML extraction by wrapper induction (operator 4).

A page is parsed into a tree of block elements; siblings of the same label (tag and
class) fold into one node, so lists of any length share a shape.  For each host, the
page of the smallest id is the reference: every other page's tree is aligned to
it by simple tree matching, which gives its nodes the numbers of the reference's
slots.  Over all pages of a host, a text that stands in the same slot of most pages
of different content is constant, part of the template; what varies is a slot's
content.  Of the varying slots, those whose element or attributes say menu, header,
footer, sidebar, notice, advert, form or comment are not the article; if a page marks
its article (article, main), only slots inside count, else link-heavy blocks that are no
headings or paragraphs go.
Words that speak of layout (has-sidebar, content-sidebar-wrap) and ids of headings,
paragraphs and parts of an article mark nothing; within an <article>, only words for
adverts, comments, forms, menus, sidebars, footers and hidden parts do, and of its own header
headings and paragraphs stay (not those that name its author or date); an article within a marked element
counts if it is longer than what stands outside, and where marks by words
(but for adverts, notices of consent and comments) would leave nothing, they are void.

Pages whose content is equal count once for constancy, so copies of an article are no
template.  Constant is what ``MOST`` of a host's different contents have, or all where there are fewer
than ``LEAST_PAGES``; there, pages of which three quarters are constant are near copies and keep it.
Headings that recur in the same slot (Ingredients, Method) are constant like any other text.  A tree of any depth is walked without recursion, and siblings are aligned in
``n log n`` steps.
Counts are per host, slot and text and pre-aggregated; a host of any size is spread
over all tasks.

Edges: null html is empty and gives an empty text; pages without a host, and those of a
host with one content alone, have no template and are judged
by their own elements, so unmarked template text stays there; unclosed tags close where HTML says
so; a tag without an end is text, and markup of any length and depth takes time in proportion; repeated rows get equal results; further columns are left out; an empty table gives
no rows.
"""

from __future__ import annotations

import html as entities
import json
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docmill.llm.common import broadcast_if_small, map_arrow, materialize, table

MOST, LEAST_PAGES, LEAST_MATCH = 0.6, 5, 0.3

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)[^>]*+>|<[!?][^>]*+>", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))|([^\s=/\"'>]+)")
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template title textarea iframe xmp noframes noembed".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var".split())
#: Elements that are never part of an article.
OUTSIDE = frozenset("nav footer aside form button select menu dialog svg canvas object audio video map fieldset datalist head".split())
#: Elements whose text stays however much of it is linked.
PROSE = frozenset("p blockquote pre dd figcaption".split())
#: Words of class, id, role or label attributes that mark what is not the article.
OUTSIDE_WORDS = frozenset(
    "nav navbar navigation menu menubar sidebar rail footer header masthead banner topbar ad ads adv advert adverts advertisement sponsor sponsored promo promotion cookie cookies consent gdpr notice alert "
    "popup modal overlay newsletter subscribe subscription signup login search share sharing social comment comments reply replies disqus respond related recommended recommendations breadcrumb breadcrumbs pagination pager "
    "toolbar widget skip hidden complementary contentinfo dialog outbrain taboola tags".split()
)
#: Those that no article is inside of, whatever else the page has.
FIRM_WORDS = frozenset("ad ads adv advert adverts advertisement sponsor sponsored promo promotion cookie cookies consent gdpr popup overlay comment comments reply replies disqus respond hidden skip".split())
#: The words that mark parts of an article.
WITHIN_WORDS = FIRM_WORDS | frozenset("nav navbar menu menubar sidebar footer header newsletter subscribe signup login search".split())
#: Paragraphs of an article's header that are none of its text.
BYLINE_WORDS = frozenset("byline author authors by meta date dateline time posted published updated category categories tags credit".split())
COMMENT_WORDS = frozenset("comment comments reply replies disqus respond".split())
#: Class words that speak of the layout, not of the element: has-sidebar, content-sidebar-wrap.
_STATES, _WRAPS, _CONTENTS = frozenset("has no with without is".split()), frozenset("wrap wrapper container layout inner outer".split()), frozenset("content main page primary article body".split())
_CLOSES = {"li": ("li", {"ul", "ol", "menu"}), "dt": ("dt dd", {"dl"}), "dd": ("dt dd", {"dl"}), "tr": ("tr td th", {"table"}), "td": ("td th", {"tr", "table"}), "th": ("td th", {"tr", "table"}), "option": ("option", {"select"})}


def attributes(raw: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for m in _ATTRIBUTE.finditer(raw):
        out.setdefault((m[1] or m[5]).lower(), next((g for g in m.groups()[1:4] if g is not None), ""))
    return out


def marks_of(tag: str, own: dict[str, str], within: bool) -> set[str]:
    """Words of the attributes that mark an element as no article; ``within``: it stands in an <article>.

    Ids of headings and paragraphs are link targets; so are those of other elements in an article,
    unless they say nothing but comments."""
    marks: set[str] = set()
    for k in ("class", "id", "role", "aria-label", "itemprop"):
        for value in own.get(k, "").split() if k == "class" else [own.get(k, "")]:
            words = [w.lower() for w in _WORD.findall(value)]
            if k == "class" and words and (words[0] in _STATES or words[-1] in _WRAPS and not _CONTENTS.isdisjoint(words)):
                continue
            if k == "id" and (tag in ("p", "h1", "h2", "h3", "h4", "h5", "h6") or within and not COMMENT_WORDS.issuperset(words)):
                continue
            marks |= (WITHIN_WORDS if within else OUTSIDE_WORDS).intersection(words)
    return marks


def is_byline(own: dict[str, str]) -> bool:
    return any(w.lower() in BYLINE_WORDS for k in ("class", "id", "itemprop", "rel") for w in _WORD.findall(own.get(k, "")))


class Node:
    """A folded element: all siblings of its label."""

    __slots__ = ("children", "label", "number")

    def __init__(self, label: str):
        self.label, self.children, self.number = label, {}, ""

    def child(self, label: str) -> Node:
        return self.children.setdefault(label, Node(label))

    def walk(self) -> Iterator[tuple[int, Node]]:
        """(depth, node) of the whole tree, parents first, in page order."""
        stack = [(0, self)]
        while stack:
            depth, node = stack.pop()
            yield depth, node
            stack += [(depth + 1, c) for c in reversed(node.children.values())]

    def size(self) -> int:
        return sum(1 for _ in self.walk())

    def packed(self) -> list:
        return [[depth, node.label] for depth, node in self.walk()]

    @staticmethod
    def unpacked(rows: list) -> Node:
        above: list[Node] = []
        for depth, label in rows:
            node = above[depth - 1].child(label) if depth else Node(label)
            above[depth:] = [node]
        return above[0]


class Block:
    """``outside``: 1 by words of attributes alone, 2 for certain; ``wrapped``: in an article (or main) within an element so marked."""

    __slots__ = ("article", "heading", "linked", "node", "outside", "text", "wrapped")

    def __init__(self, node: Node, text: str, linked: int, outside: int, article: int, heading: bool, wrapped: bool):
        self.node, self.text, self.linked, self.outside, self.article, self.heading, self.wrapped = node, text, linked, outside, article, heading, wrapped


def parse(source: str) -> tuple[Node, list[Block]]:
    """Folded tree and text blocks, in page order."""
    root, blocks = Node("#"), []
    # (tag, folded node, outside the article, inside article 2 or main 1, inside a link, heading, in a header of an article, in an article within a marked element)
    stack = [("#", root, 0, 0, False, False, False, False)]
    solid = [0]  # places in the stack of elements that are not inline
    opened: Counter[str] = Counter()
    text: list[str] = []
    linked = 0

    def flush() -> None:
        nonlocal linked
        if text:
            joined = " ".join("".join(text).split())
            if joined:
                _, node, outside, article, _, heading, in_header, wrapped = stack[solid[-1]]
                blocks.append(Block(node, joined, linked, 2 if in_header and not heading else outside, article, heading, wrapped))
            text.clear()
            linked = 0

    def add(piece: str) -> None:
        nonlocal linked
        if piece:
            piece = entities.unescape(piece) if "&" in piece else piece
            text.append(piece)
            if stack[-1][4]:
                linked += len(piece)

    def pop(to: int) -> None:
        if solid[-1] >= to:
            flush()
        while solid[-1] >= to:
            solid.pop()
        opened.subtract(e[0] for e in stack[to:])
        del stack[to:]

    at, n, last = 0, len(source), source.rfind(">")
    while at < n:
        if source.find("<", at, last + 1) < 0:  # no tag ends from here on; an open comment still goes
            comment = source.find("<!--", at)
            add(source[at : n if comment < 0 else comment])
            break
        m = _TOKEN.search(source, at)
        if m is None:
            add(source[at:])
            break
        add(source[at : m.start()])
        at = m.end()
        name = m[2] or m[5]
        if not name:
            continue
        tag, end = name.lower(), m[1] or m[4]
        if end:
            if not opened[tag]:
                continue
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] == tag:
                    pop(i)
                    break
                if tag in INLINE and stack[i][0] not in INLINE:
                    break
            continue
        if tag in VOID:
            if tag == "br":
                add(" ")
            elif tag == "hr":
                flush()
            continue
        if tag in RAW:
            close = re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.I).search(source, at)
            at = close.end() if close else n
            continue
        if tag not in INLINE:
            # What the new element closes: an open paragraph, or an item of the same list, row or table.
            if (above := stack[solid[-1]][0]) == "p" or above == tag == "h1":
                pop(solid[-1])
            if tag in _CLOSES:
                closed, within = _CLOSES[tag]
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i][0] in within:
                        break
                    if stack[i][0] in closed.split():
                        pop(i)
                        break
            flush()
        raw = m[3] or ""
        own = attributes(raw) if raw.strip(" /") else {}
        _, node, outside, article, link, heading, in_header, wrapped = stack[-1]
        main = 2 if tag == "article" or "articleBody" in own.get("itemprop", "") else 1 if tag == "main" or own.get("role") == "main" else 0
        inside = tag not in ("body", "html", "article", "main")
        marks = marks_of(tag, own, article == 2) if own else set()
        heads = article > 0 and (tag == "header" or marks == {"header"})  # of an article, only the headings stay
        marks = set() if heads else marks
        stands = tag == "p" and not is_byline(own)  # a paragraph of the header that is no byline
        firm = tag in OUTSIDE or tag == "header" and not article or inside and not FIRM_WORDS.isdisjoint(marks) or "comment" in marks or "comments" in marks
        firm = firm or "hidden" in own or own.get("aria-hidden") == "true" or "display:none" in own.get("style", "").replace(" ", "")
        if main and outside == 1 and not article:
            outside, wrapped = 0, True
        outside = max(outside, 2 if firm else int(inside and bool(marks)))
        if tag not in INLINE:
            node = node.child(f"{tag}.{' '.join(sorted(own['class'].split()))}" if own.get("class") else tag)
        if raw.endswith("/") and tag not in INLINE:
            continue
        if tag not in INLINE:
            solid.append(len(stack))
        opened[tag] += 1
        stack.append((tag, node, outside, max(article, 0 if outside else main), link or tag == "a", heading or tag in ("h1", "h2", "h3", "h4", "h5", "h6"), (in_header or heads) and not stands, wrapped))
    flush()
    return root, blocks


def matching(a: Node, b: Node) -> int:
    """Simple tree matching: the size of the largest order-keeping alignment of two trees."""
    return _match(a, b)[0]


def _match(a: Node, b: Node) -> tuple[int, list[tuple[Node, Node]]]:
    """The size of the alignment, and its pairs of nodes, parents first.

    Labels differ among siblings, so a child has one partner at most, and the best order-keeping
    choice of a node's children is the heaviest rising sequence of their partners' places."""
    if a.label != b.label:
        return 0, []
    pairs = [(a, b)]
    for x, y in pairs:  # grows as it is read
        pairs += [(c, y.children[c.label]) for c in x.children.values() if c.label in y.children]
    size: dict[Node, int] = {}
    chosen: dict[Node, list[tuple[Node, Node]]] = {}
    for x, y in reversed(pairs):
        place = {label: j for j, label in enumerate(y.children)}
        own = [(c, y.children[c.label], place[c.label]) for c in x.children.values() if c.label in place]
        total, picked = _heaviest([(j, size[c]) for c, _, j in own], len(place))
        size[x], chosen[x] = 1 + total, [own[i][:2] for i in picked]
    kept = [(a, b)]
    for x, _ in kept:
        kept += chosen[x]
    return size[a], kept


def _heaviest(items: list[tuple[int, int]], n: int) -> tuple[int, list[int]]:
    """Of (place below n, weight) items in order, the largest weight of a choice with rising places, and that choice."""
    best, last, before = [0] * (n + 1), [-1] * (n + 1), []  # by prefixes of places, as a binary indexed tree
    most, end = 0, -1
    for i, (place, weight) in enumerate(items):
        at, total, link = place, 0, -1
        while at > 0:
            if best[at] > total:
                total, link = best[at], last[at]
            at -= at & -at
        total += weight
        before.append(link)
        at = place + 1
        while at <= n:
            if total > best[at]:
                best[at], last[at] = total, i
            at += at & -at
        if total > most:
            most, end = total, i
    out = []
    while end >= 0:
        out.append(end)
        end = before[end]
    return most, out[::-1]


def align(page: Node, reference: Node) -> None:
    """Numbers the page's nodes by the reference's slots; unmatched nodes go by a hash of their own path."""
    import xxhash

    above: list[str] = []
    for depth, node in page.walk():
        node.number = "~" + xxhash.xxh3_128_hexdigest(f"{above[depth - 1] if depth else ''}/{node.label}".encode("utf-8", "surrogatepass"))
        above[depth:] = [node.number]
    for i, (_, node) in enumerate(reference.walk()):
        node.number = str(i)
    matched, pairs = _match(page, reference)
    if matched and 2 * matched >= LEAST_MATCH * (page.size() + reference.size()):
        for x, y in pairs:
            x.number = y.number


def article_blocks(blocks: list[Block]) -> list[bool]:
    """Which blocks may be article text by the page's own elements.

    <article> goes before <main> if it holds most of the text of both, with main's headings before it.
    An article within a marked element counts if it is longer than what stands outside such
    elements; where marks by words would leave nothing, what they mark stays."""
    size = lambda bs: sum(len(b.text) for b in bs)
    prose = lambda b: b.heading or 2 * b.linked <= len(b.text) or b.node.label.partition(".")[0] in PROSE
    free = [b for b in blocks if not b.outside and not b.wrapped]
    held = [b for b in blocks if not b.outside and b.wrapped]
    whole = size(held) > size([b for b in free if b.article] or free)
    marked = [b for b in (held if whole else free) if b.article]
    deep = [b for b in marked if b.article == 2]
    inner = 0 if not marked else 2 if 2 * size(deep) > size(marked) else 1
    titles = {id(b) for b in marked[: marked.index(deep[0])] if b.heading} if inner == 2 else set()
    own = [not b.outside and b.wrapped == whole and (b.article >= inner or id(b) in titles if inner else prose(b)) for b in blocks]
    return own if any(own) else [b.outside < 2 and prose(b) for b in blocks]


_SLOTS = "array<struct<slot:string,text:string,own:boolean>>"


def _hosts(pages: DataFrame) -> DataFrame:
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"://([^/?#]*)", 1))
    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("html"), host.alias("host"))


def _aligned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(page_id, url, host, html, reference) -> blocks with the slots of the reference."""
    import xxhash

    kind = pa.list_(pa.struct([("slot", pa.string()), ("text", pa.string()), ("own", pa.bool_())]))
    references: dict[str, Node] = {}
    for batch in batches:
        rows, contents = [], []
        for source, reference in zip(batch.column(3), batch.column(4).to_pylist(), strict=True):
            tree, blocks = parse(source.as_py())
            if reference is not None:
                if reference not in references:
                    if len(references) > 2000:
                        references.clear()
                    references[reference] = Node.unpacked(json.loads(reference))
                align(tree, references[reference])
            own = article_blocks(blocks)
            rows.append([{"slot": b.node.number, "text": b.text, "own": o} for b, o in zip(blocks, own, strict=True)])
            contents.append(xxhash.xxh3_64_intdigest("\n".join(b.text for b, o in zip(blocks, own, strict=True) if o).encode("utf-8", "surrogatepass")) - (1 << 63))
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(contents, pa.int64()), pa.array(rows, kind)], names=["page_id", "url", "host", "content", "blocks"])


def _shapes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([json.dumps(parse(h.as_py())[0].packed()) for h in batch.column(1)], pa.string())], names=["host", "reference"])


def extract(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """``pages`` (page_id, url, html) -> page_id, url, text, n_chars."""
    pages = _hosts(pages)
    named = pages.where("host <> ''")
    chosen = materialize(spark, named.groupBy("host").agg(F.min("page_id").alias("page_id")), "chosen")
    shapes = named.join(broadcast_if_small(chosen), ["host", "page_id"]).select("host", "html")
    references = materialize(spark, map_arrow(shapes, _shapes, "host string, reference string").groupBy("host").agg(F.min("reference").alias("reference")), "references")
    rows = pages.join(broadcast_if_small(references), "host", "left").select("page_id", "url", "host", "html", "reference")
    aligned = materialize(spark, map_arrow(rows, _aligned, f"page_id long, url string, host string, content long, blocks {_SLOTS}"), "aligned")

    # Texts that most pages of different content have in the same slot.
    hosts = aligned.where("host <> ''").select("host", "content").distinct().groupBy("host").agg(F.count(F.lit(1)).alias("pages")).where("pages > 1")
    texts = aligned.where("host <> ''").select("host", "content", F.explode("blocks").alias("b")).where("b.own").select("host", "content", "b.slot", F.xxhash64("b.text").alias("text"))
    counts = texts.distinct().groupBy("host", "slot", "text").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    few = F.col("pages") < LEAST_PAGES
    constant = counts.join(hosts, "host").where(F.when(few, F.col("n") == F.col("pages")).otherwise(F.col("n") >= MOST * F.col("pages")))
    constant = materialize(spark, constant.groupBy("host").agg(F.collect_set(F.struct("slot", "text")).alias("constant"), F.max(few).alias("few")), "constant")

    out = aligned.join(broadcast_if_small(constant), "host", "left")
    own = F.filter("blocks", lambda b: b["own"])
    fixed = lambda b: F.exists("constant", lambda c: (c["slot"] == b["slot"]) & (c["text"] == F.xxhash64(b["text"])))
    join = lambda bs: F.array_join(F.transform(bs, lambda b: b["text"]), " ")
    out = out.withColumns({"whole": join(own), "varying": F.when(F.col("constant").isNotNull(), join(F.filter(own, lambda b: ~fixed(b))))})
    near_copy = F.col("few") & (4 * F.length("varying") < F.length("whole"))
    text = F.when(F.col("constant").isNull() | near_copy, F.col("whole")).otherwise(F.col("varying"))
    return out.select("page_id", "url", text.alias("text")).withColumn("n_chars", F.length("text").cast("long"))


def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(spark, table(spark, sf_dir, "pages"))
