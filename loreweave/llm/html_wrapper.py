"""Main text of web pages by wrapper induction: pages of a host are aligned, what stays the same is template.

1. A page becomes a tree of its block elements; inline markup melts into the text of its block, and character
   references are decoded.
2. Per host, the page with the smallest id is the pivot. Every page of the host is aligned with it by simple
   tree matching: two nodes match if their labels (tag and classes) agree, children match in order so that the
   matched weight is largest, and consecutive siblings of one label count as one repeated node.
3. Per host, aligned node and text, the distinct pages with that text are counted in all pages. A text that
   half of the host's pages (three at least) show at a node is constant: it belongs to the template. Other
   texts are slots.
4. The content of a page is the slots of its main region: its article and main elements in page order, without
   teasers (mostly links, or a linked heading where the longest has none) or, where it has none, the smallest
   block that holds all of the slots' unlinked text, without link lists beside its densest part. Regions of another role are left out
   wherever they are: menus, headers and footers of the page, sidebars, notices, adverts, forms, comments of
   readers, scripts and styles. A class or id that names such a part is a weak sign: it does not count for
   headings and inline elements nor where it says has- or no-, a compound of a doubtful word counts only for
   blocks of links, a header counts outside of article and main only, and a block that holds most of the page's
   own text stays unless it is named for comments or adverts. If that leaves nothing, names are not gone by. If constants made up most of the main region's text, the page repeats a whole
   article of its host, and they are kept.

Defined results: a null or empty html has an empty text; a null url is a host of its own name (empty); a null id
is kept but never a pivot; repeated rows are returned as often as they occur; of equal ids the page with the
smaller text is the pivot; an empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import html as html_entities
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loreweave.llm import shared

#: Bytes of pivot pages and templates that are broadcast at most; beyond, pages are joined with them by host.
BROADCAST_BYTES = 48 << 20
#: What a host's name, page id and digest take, at most: names have no more than 253 characters.
_HOST_BYTES = 320
_DEPTH = 150
_CELLS = 20_000

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*+>|<(/?)([a-zA-Z][^\s/>]*+)((?:[^'\">]++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")

_RAW = frozenset("script style textarea title template iframe xmp noembed noframes svg select".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset("a abbr acronym audio b bdi bdo big canvas cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var video wbr img noscript object math mi mn mo ms mrow mtext msup msub msubsup mfrac msqrt mroot mstyle semantics annotation".split())
_CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section summary table ul".split())
_SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"tr", "td", "th", "tbody", "thead", "tfoot"}}
_SCOPES = frozenset("table ul ol dl article section main body html aside nav footer header form td th".split())
_OTHER_TAGS = frozenset("head nav footer aside form dialog menu button fieldset input".split())
_OTHER_ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog form menu menubar toolbar".split())
_OTHER_NAMES = frozenset(
    "nav navbar navigation menu submenu header masthead topbar footer sidebar aside rail ad ads adv advert adverts advertisement advertising banner "
    "promo promotion sponsor sponsored cookie cookies consent gdpr notice notices notification alert newsletter subscribe subscription signup popup "
    "modal overlay share sharing social related recommended recommendations breadcrumb breadcrumbs pagination pager comment comments disqus respond "
    "reply replies login search widget toolbar copyright skip".split()
)
_SURE_NAMES = frozenset("ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion cookie cookies consent gdpr newsletter comment comments disqus respond reply replies".split())
_DOUBTFUL_NAMES = frozenset("nav navigation menu submenu related recommended recommendations widget notice notices notification alert overlay modal share sharing social login search skip copyright toolbar banner subscription".split())
_HEADER_NAMES = frozenset("header masthead".split())
_OWN_NAMES = frozenset("article post entry story section content".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_PREFIXES = frozenset("has no not with without".split())
_UNNAMED_TAGS = _INLINE | frozenset("html body article main h1 h2 h3 h4 h5 h6 hgroup pre code".split())
#: How far a name speaks against an element.
_LINKS, _HEADER, _PART, _SURE = 1, 2, 3, 4


@dataclass
class Node:
    """A block element: its children, and runs of text between them as strings."""

    label: str
    tag: str
    other: bool = False
    named: int = 0
    items: list = field(default_factory=list)
    linked: int = 0  # characters of its own text that are links


def _attributes(raw: str) -> dict[str, str]:
    return {k.lower(): (v or "").strip("\"'") for k, v in _ATTRIBUTE.findall(raw)} if raw else {}


def _other(tag: str, attributes: dict[str, str]) -> bool:
    """Whether an element has a role besides the article."""
    if tag in _OTHER_TAGS or "hidden" in attributes or attributes.get("aria-hidden") == "true":
        return True
    if not attributes or tag in ("html", "body", "article", "main") and not {"comment", "ad", "sponsored"} & _names(attributes):
        return False
    return tag in ("html", "body", "article", "main") or attributes.get("role", "") in _OTHER_ROLES or "display:none" in attributes.get("style", "").replace(" ", "")


def _named(tag: str, attributes: dict[str, str]) -> int:
    """How far the classes and the id of an element name it as another part than the article."""
    level = 0
    if tag in _UNNAMED_TAGS:
        return level
    for key in ("class", "id"):
        for token in attributes.get(key, "").split():
            words = [w.lower() for w in _WORD.findall(token)]
            found = _OTHER_NAMES.intersection(words)
            if not found or words[0] in _PREFIXES:
                continue
            if found <= _HEADER_NAMES:
                level = max(level, 0 if _OWN_NAMES.intersection(words) else _HEADER)
            elif len(words) > 1 and (found <= _DOUBTFUL_NAMES or tag == "section" and key == "id"):
                level = max(level, _LINKS)
            else:
                level = max(level, _PART if found.isdisjoint(_SURE_NAMES) else _SURE)
    return level


def _names(attributes: dict[str, str]) -> set[str]:
    return {w.lower() for k in ("class", "id") if k in attributes for w in _WORD.findall(attributes[k])}


def parse(text: str) -> Node:
    """The block tree of a page, mended as browsers do for unclosed and misplaced tags."""
    root = Node("#", "#")
    stack: list[tuple[str, Node, bool]] = [("#", root, False)]  # open elements: tag, the block they add to, block or inline
    links, at, size, run = 0, 0, len(text), []

    def flush() -> None:
        if run:
            stack[-1][1].items.append("".join(run))
            run.clear()

    def close(to: int) -> None:
        nonlocal links
        if any(block for _, _, block in stack[to:]):
            flush()
        links -= sum(tag == "a" for tag, _, _ in stack[to:])
        del stack[to:]

    while at < size:
        match = _TOKEN.search(text, at)
        begin = match.start() if match else size
        if begin > at:
            piece = text[at:begin]
            if "&" in piece:
                piece = html_entities.unescape(piece)
            run.append(piece)
            if links > 0:
                stack[-1][1].linked += len(piece.strip())
        if not match:
            break
        at = match.end()
        tag = match[2] or match[5]
        if tag is None:
            continue
        tag, closing = tag.lower(), match[1] or match[4]
        if closing:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] == tag:
                    melted = not stack[i][2] and tag not in _INLINE
                    close(i)
                    if melted:
                        run.append(" ")
                    break
                if stack[i][0] in _SCOPES and (tag in _INLINE or tag in ("p", "li")):
                    break
            continue
        if tag == "br":
            run.append(" ")
            continue
        raw = match[3] if match[2] else match[6]
        if tag in _RAW and not (raw or "").endswith("/"):
            end = re.compile(rf"</{re.escape(tag)}\s*[^>]*>", re.I).search(text, at)
            at = end.end() if end else (size if tag in ("script", "style", "textarea", "title") else at)
            continue
        if tag in _VOID:
            if tag == "hr":
                flush()
            continue
        for i in range(len(stack) - 1, 0, -1):  # what this element ends
            name = stack[i][0]
            if name in _SIBLINGS.get(tag, ()) or name == "p" and tag in _CLOSES_P:
                close(i)
                break
            if name in _SCOPES:
                break
        attributes = _attributes(raw)
        other, named = _other(tag, attributes), _named(tag, attributes) if attributes else 0
        if (tag in _INLINE or len(stack) > _DEPTH) and not other and not named:
            links += tag == "a"
            if tag not in _INLINE:  # a block too deep for a node of its own still parts its text from what is around it
                run.append(" ")
            stack.append((tag, stack[-1][1], False))
            continue
        flush()
        classes = " ".join(sorted(attributes.get("class", "").split()))
        node = Node(f"{tag}.{classes}" if classes else tag, tag, other, named)
        stack[-1][1].items.append(node)
        stack.append((tag, node, True))
    flush()
    return root


def _groups(node: Node) -> list[tuple[str, list[Node]]]:
    """The children, consecutive ones of one label together."""
    out: list[tuple[str, list[Node]]] = []
    for child in node.items:
        if isinstance(child, Node):
            if out and out[-1][0] == child.label:
                out[-1][1].append(child)
            else:
                out.append((child.label, [child]))
    return out


def _weight(a: list[Node], b: list[Node], known: dict) -> int:
    """The largest matching of two repeated nodes by the first of either."""
    key = (id(a[0]), id(b[0]))
    if key not in known:
        known[key] = 1 + sum(w for _, _, w in _matching(_groups(a[0]), _groups(b[0]), known))
    return known[key]


def _matching(a: list[tuple[str, list[Node]]], b: list[tuple[str, list[Node]]], known: dict) -> list[tuple[int, int, int]]:
    """Simple tree matching of two child lists: pairs (i, j, weight) in order with the largest sum."""
    if [x[0] for x in a] == [x[0] for x in b]:
        return [(i, i, _weight(x[1], y[1], known)) for i, (x, y) in enumerate(zip(a, b, strict=True))]
    if len(a) * len(b) > _CELLS:  # match from both ends and leave out what differs between
        pairs, i = [], 0
        while i < min(len(a), len(b)) and a[i][0] == b[i][0]:
            pairs.append((i, i, 1))
            i += 1
        j = 1
        while j <= min(len(a), len(b)) - i and a[-j][0] == b[-j][0]:
            pairs.append((len(a) - j, len(b) - j, 1))
            j += 1
        return sorted(pairs)
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, (label, x) in enumerate(a):
        for j, (other, y) in enumerate(b):
            both = best[i][j] + _weight(x, y, known) if label == other else 0
            best[i + 1][j + 1] = max(best[i][j + 1], best[i + 1][j], both)
    pairs, i, j = [], len(a), len(b)
    while i and j:
        if best[i][j] == best[i - 1][j]:
            i -= 1
        elif best[i][j] == best[i][j - 1]:
            j -= 1
        else:
            i, j = i - 1, j - 1
            pairs.append((i, j, best[i + 1][j + 1] - best[i][j]))
    return pairs[::-1]


def places(page: Node, pivot: Node) -> dict[int, str]:
    """For each block of the page, the node of the pivot it is aligned with, or its own path where there is none."""
    found: dict[int, str] = {}

    def walk(nodes: list[Node], partner: list[Node], name: str) -> None:
        for node in nodes:
            found[id(node)] = name
        own = [g for n in nodes for g in _groups(n)] if len(nodes) > 1 else _groups(nodes[0])
        if len(nodes) > 1:  # members of a repeated node share the places of their children
            for label, group in own:
                walk(group, [], f"{name}*{label}")
            return
        other = _groups(partner[0]) if partner else []
        paired = {i: j for i, j, _ in _matching(own, other, {})} if partner else {}
        for i, (label, group) in enumerate(own):
            if i in paired:
                walk(group, other[paired[i]][1], f"{name}/{paired[i]}{label}")
            else:
                walk(group, [], f"{name}/{label}")

    walk([page], [pivot], "")
    return found


def _measured(node: Node, sizes: dict[int, tuple[int, int, int]], inside: bool = False) -> tuple[int, int, int]:
    """Characters, those in links, and the unlinked ones within article and main, by block; other roles, comments and adverts do not count."""
    inside = inside or node.tag in ("article", "main")
    text = sum(len(" ".join(x.split())) for x in node.items if isinstance(x, str))
    linked = min(node.linked, text)
    main = text - linked if inside else 0
    for item in node.items:
        if isinstance(item, Node) and not item.other:
            own = _measured(item, sizes, inside)
            if item.named < _SURE:
                text, linked, main = text + own[0], linked + own[1], main + own[2]
    sizes[id(node)] = text, linked, main
    return text, linked, main


def _runs(page: Node) -> list[tuple[str, Node, tuple[Node, ...]]]:
    """Texts in page order, white space joined, with their block and its ancestors; other roles are left out."""
    sizes: dict[int, tuple[int, int, int]] = {}
    text, linked, main = _measured(page, sizes)
    by_main = 3 * main > text - linked

    def left_out(node: Node, inside: bool) -> bool:
        text_here, linked_here, main_here = sizes[id(node)]
        if node.named == _SURE:
            return True
        if 2 * main_here > main if by_main else 2 * (text_here - linked_here) > text - linked:  # most of the page's own text
            return False
        return node.named == _PART or node.named == _HEADER and not inside or node.named == _LINKS and 2 * linked_here > text_here

    def walk(node: Node, path: tuple[Node, ...], inside: bool, by_name: bool) -> Iterator[tuple[str, Node, tuple[Node, ...]]]:
        path, inside = (*path, node), inside or node.tag in ("article", "main")
        for item in node.items:
            if isinstance(item, str):
                own = " ".join(item.split())
                if own:
                    yield own, node, path
            elif not item.other and not (item.tag == "header" and not inside) and not (by_name and item.named and left_out(item, inside)):
                yield from walk(item, path, inside, by_name)

    return list(walk(page, (), False, True)) or list(walk(page, (), False, False))


def _hash(text: str) -> int:
    h = xxhash.xxh3_64_intdigest(text)
    return h - (1 << 64) if h >> 63 else h


def content(page: Node, constant: set[tuple[str, int]], pivot: Node | None) -> str:
    """The text of the slots in the main region of a page."""
    runs = _runs(page)
    where = places(page, pivot) if constant and pivot is not None else {}
    fixed = [bool(where) and (where[id(node)], _hash(text)) in constant for text, node, _ in runs]
    regions: dict[int, list[int]] = {}
    for i, (_, _, path) in enumerate(runs):
        region = next((n for n in reversed(path) if n.tag == "article"), None) or next((n for n in reversed(path) if n.tag == "main"), None)
        if region is not None:
            regions.setdefault(id(region), []).append(i)
    inside = _without_teasers(runs, list(regions.values())) if regions else _cover(runs, fixed)
    total, same = sum(len(runs[i][0]) for i in inside), sum(len(runs[i][0]) for i in inside if fixed[i])
    kept = inside if 2 * same > total else [i for i in inside if not fixed[i]]
    return " ".join(runs[i][0] for i in kept)


def _is_linked(runs: list, members: list[int]) -> bool:
    """Whether over half of the text of some runs is links; a block's links count once."""
    blocks = {id(runs[i][1]): runs[i][1].linked for i in members}
    return 2 * sum(blocks.values()) > sum(len(runs[i][0]) for i in members)


def _without_teasers(runs: list, regions: list[list[int]]) -> list[int]:
    """The runs of all regions but teasers, in page order; of all regions where none is more."""

    def headed(members: list[int]) -> bool:
        """Whether the first heading is a link."""
        first = next((i for i in members if runs[i][1].tag in _HEADINGS), None)
        return first is not None and 2 * runs[first][1].linked > len(runs[first][0])

    longest = max(regions, key=lambda members: sum(len(runs[i][0]) for i in members))
    own = [r for r in regions if r is longest or not _is_linked(runs, r) and (headed(longest) or not headed(r))]
    return sorted(i for members in own for i in members)


def _cover(runs: list, fixed: list[bool]) -> list[int]:
    """The runs of the smallest block that holds all unlinked slot text and headings. Of its parts beside the
    innermost block with over two thirds of that text, those that are mostly links are left out."""
    weights: dict[int, int] = {}
    order: dict[int, int] = {}
    total, shared_path = 0, None
    for (text, node, path), constant in zip(runs, fixed, strict=True):
        own = 0 if constant or 2 * node.linked > len(text) else len(text)
        total += own
        for depth, n in enumerate(path):
            weights[id(n)] = weights.get(id(n), 0) + own
            order[id(n)] = depth
        if own or node.tag in _HEADINGS and not constant:
            same = path if shared_path is None else shared_path
            shared_path = same[: next((d for d, (a, b) in enumerate(zip(same, path, strict=False)) if a is not b), min(len(same), len(path)))]
    if not total or shared_path is None:
        return []
    dense = max((k for k, w in weights.items() if 3 * w > 2 * total), key=lambda k: order[k])
    depth = len(shared_path)
    inside = [i for i, (_, _, path) in enumerate(runs) if len(path) >= depth and path[depth - 1] is shared_path[-1]]
    parts: dict[int, list[int]] = {}
    for i in inside:
        path = runs[i][2]
        parts.setdefault(id(path[depth]) if len(path) > depth else id(path[depth - 1]), []).append(i)
    kept = [m for m in parts.values() if any(id(n) == dense for i in m for n in runs[i][2][depth - 1 :]) or not _is_linked(runs, m)]
    return sorted(i for members in kept for i in members)


@lru_cache(maxsize=64)
def _pivot(text: str) -> Node:
    return parse(text)


def _host() -> Column:
    return F.lower(F.coalesce(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/@?#]*@)?([^/:?#]*)", 1), F.lit("")))


def _with_hosts(pages: DataFrame, hosts: DataFrame, size: int) -> DataFrame:
    """Pages with their host's row; it is broadcast where all rows together are small, and joined by host otherwise."""
    return pages.join(F.broadcast(hosts) if size <= BROADCAST_BYTES else hosts, "host", "left")


def main_text(pages: DataFrame) -> DataFrame:
    """``page_id``, ``url``, ``text`` and ``n_chars`` of every page."""
    shared.small_batches(pages.sparkSession)
    rows = pages.select("page_id", "url", "html", _host().alias("host"), F.xxhash64("html").alias("digest"))
    first = rows.where(F.col("page_id").isNotNull() & F.col("html").isNotNull()).groupBy("host").agg(F.min(F.struct("page_id", "digest")).alias("first"))
    first = shared.written(first.select("host", "first.*"), "first-pages")
    narrow = first.count() * _HOST_BYTES <= BROADCAST_BYTES  # then no page is shuffled to find the pivots
    pivots = rows.join(F.broadcast(first) if narrow else first, ["host", "page_id", "digest"]).groupBy("host").agg(F.min("html").alias("pivot"))
    pivots = shared.written(pivots, "pivots")
    size = pivots.agg(F.coalesce(F.sum(F.length("pivot")), F.lit(0)).alias("n")).first()["n"]

    @F.arrow_udf("array<struct<node: string, text_hash: bigint>>")
    def aligned(page: pa.Array, pivot: pa.Array) -> pa.Array:
        out = []
        for own, other in zip(page.to_pylist(), pivot.to_pylist(), strict=True):
            if not own or other is None:
                out.append([])
                continue
            tree = parse(own)
            where = places(tree, _pivot(other))
            found = {(where[id(node)], _hash(text)) for text, node, _ in _runs(tree)}
            out.append([{"node": node, "text_hash": h} for node, h in found])
        return pa.array(out, pa.list_(pa.struct([("node", pa.string()), ("text_hash", pa.int64())])))

    texts = _with_hosts(rows, pivots, size).select("host", "digest", F.explode(aligned(F.col("html"), F.col("pivot"))).alias("run"))
    texts = texts.select("host", F.xxhash64("run.node").alias("node_hash"), "run.text_hash", "digest").distinct()
    counts = texts.groupBy("host", "node_hash", "text_hash").agg(F.count("*").alias("n")).where("n >= 3")
    sizes = rows.where(F.col("html").isNotNull()).groupBy("host", "digest").count().groupBy("host").agg(F.count("*").alias("pages"))
    constants = counts.join(sizes, "host").where("2 * n >= pages")
    template = constants.groupBy("host").agg(F.collect_list(F.struct("node_hash", "text_hash")).alias("template"))  # at most twice the texts of an average page
    hosts = shared.written(pivots.join(template, "host", "left"), "wrappers")
    size = hosts.agg(F.coalesce(F.sum(F.length("pivot") + 16 * F.greatest(F.size("template"), F.lit(0))), F.lit(0)).alias("n")).first()["n"]

    @F.arrow_udf("string")
    def extracted(page: pa.Array, pivot: pa.Array, template: pa.Array) -> pa.Array:
        out = []
        for own, other, constant in zip(page.to_pylist(), pivot.to_pylist(), template.to_pylist(), strict=True):
            known = _Template((c["node_hash"], c["text_hash"]) for c in constant or ())
            out.append(content(parse(own), known, _pivot(other) if other else None) if own else "")
        return pa.array(out, pa.string())

    out = _with_hosts(rows, hosts, size).select("page_id", "url", extracted(F.col("html"), F.col("pivot"), F.col("template")).alias("text"))
    return out.withColumn("n_chars", F.length("text").cast("long"))


class _Template(set):
    """Constant texts by the hash of their node's place, as Spark's xxhash64 has it."""

    def __contains__(self, item: object) -> bool:
        node, text = item
        h = xxhash.xxh64_intdigest(node, 42)
        return super().__contains__((h - (1 << 64) if h >> 63 else h, text))
