"""Main text of web pages by site style trees.

The DOMs of a host's pages are merged: elements with the same chain of names and classes from the root are one node of the site's tree.
A node has presentation styles (the sequences of its children) and contents (the blocks of text below it), each with the number of
pages that show it. From these counts come entropies:

* a content shown by k of a site's M pages has importance 1 - log_M k: 1 if it is on one page, 0 if on all;
* a presentation node has that of its styles, the entropy of their shares over its largest value;
* a branch has ``ATTENUATION`` times the mean importance of the contents below it, those in links counting nothing, and the rest of its
  presentation. This is the composite importance of a style tree with contents weighted by pages, so it is a sum over
  the tree and needs no recursion.

Branches and contents below ``THRESHOLD`` are cut from every page. Entropy alone keeps a menu or an advert that each page words
anew, so a node's importance is multiplied by a prior from its name: 0 for menus, headers, footers, sidebars, notices, adverts, forms, comments
and what is not shown, and for all outside the article where a page has one (``article``, else ``main``); 1 for all else.

Pages of equal or nearly equal text would make their own article common. Pages are therefore counted by their longest block: pages that
share it count once. Sites of fewer than ``LEAST`` such pages, and pages whose url names no host, are judged by names only.

A content is cut only if it is on more than M ** (1 - THRESHOLD) pages, so a site has few of them whatever its size. The
tree is made by aggregations that combine before the shuffle, so a host may hold any share of all pages. Pages are parsed once and
never gathered by host.

Every row counts, also rows that repeat an id or have none. Null, empty and text-free pages have an empty text, a null url stays null. An empty table gives no rows.
Further columns are not looked at. Unclosed, crossing and cut-off tags are read as browsers do, as far as blocks depend on them.
"""

from __future__ import annotations

import html
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brisa.llm.common import stored
from brisa.llm.tokens import kept_by_worker

#: Importance below which a branch or content is cut.
THRESHOLD = 0.1
#: Share of contents in the importance of a branch.
ATTENUATION = 0.9
#: Distinct pages that a site needs for its entropies to mean anything.
LEAST = 5
#: Elements nested deeper than this do not change the node that their text belongs to.
DEPTH = 512
#: Bytes of noise lists that are broadcast.
BROADCAST = 1 << 24
#: Parts of a host's rows where its noise list is joined by shuffle.
PARTS = 32

#: Fixed values of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template svg iframe xmp noembed noframes canvas object audio video math select".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
#: Which open elements a start tag ends, and where the search for them stops.
ENDED_BY = (
    {"li": (("li",), ("ul", "ol", "menu")), "tr": (("tr", "td", "th"), ("table",)), "option": (("option",), ("select",))}
    | dict.fromkeys(("dd", "dt"), (("dd", "dt"), ("dl",)))
    | dict.fromkeys(("td", "th"), (("td", "th"), ("tr", "table")))
    | dict.fromkeys(("thead", "tbody", "tfoot"), (("thead", "tbody", "tfoot", "tr", "td", "th"), ("table",)))
)
CELLS = frozenset(("td", "th", "caption"))
TABLE = CELLS | {"table", "tr", "thead", "tbody", "tfoot"}

#: Names of elements, and words of classes, ids and roles, whose prior importance is 0.
NOISE_ELEMENTS = frozenset(("nav", "aside", "footer", "form", "button", "label", "dialog", "menu", "search"))
NOISE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion menu navbar navigation nav breadcrumb breadcrumbs "
    "sidebar complementary footer contentinfo comment comments disqus respond replies cookie cookies consent gdpr notice alert popup modal "
    "overlay newsletter subscribe subscription signup login share sharing social related recommended widget widgets pagination pager copyright".split()
)
#: The same, but only outside an article: inside they are the article's own.
HEADER_ELEMENTS = frozenset(("header",))
HEADER_WORDS = frozenset(("header", "masthead", "banner", "topbar", "toolbar"))

TAG = re.compile(
    r"<!--.*?(?:--!?>|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+|[^>]*+)(?:>|\Z)", re.S
)
ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
TELLING = re.compile(r"class|id|role|hidden|style", re.I)
DIGITS = re.compile(r"\d+")
NOT_SHOWN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


def described(name: str, attributes: str) -> tuple[str, int]:
    """Name of a node in the style tree, and its prior: 1 noise, 2 noise outside an article, 0 none."""
    noise = 1 if name in NOISE_ELEMENTS else 2 if name in HEADER_ELEMENTS else 0
    if not attributes or not TELLING.search(attributes):
        return name, noise
    classes, words = "", []
    for key, *values in ATTRIBUTE.findall(attributes):
        key, value = key.lower(), html.unescape("".join(values)).lower()
        if key in ("class", "id", "role"):
            if key == "class":
                classes = " ".join(sorted(DIGITS.sub("0", value).split()))
            for word in value.split():
                parts = re.split(r"[^a-z]+", word)
                if parts[0] not in ("has", "no", "with", "without"):
                    words += parts
        elif key == "hidden" or (key == "aria-hidden" and value == "true") or (key == "style" and NOT_SHOWN.search(value)):
            return name, 1
    if name not in ("html", "body"):
        if not NOISE_WORDS.isdisjoint(words):
            noise = 1
        elif not HEADER_WORDS.isdisjoint(words):
            noise = noise or 2
    return f"{name}.{classes}" if classes else name, noise


class Node:
    __slots__ = ("name", "block", "path", "up", "noise", "children", "article", "main", "holds")

    def __init__(self, name, block, path, up, noise, article, main):
        self.name, self.block, self.path, self.up, self.noise = name, block, path, up, noise
        #: Whether it lies in an article or main, and what of these it holds.
        self.article, self.main, self.holds = article, main, 0
        self.children: list[str] = []


def _hash(value: str) -> int:
    from xxhash import xxh64_intdigest

    return xxh64_intdigest(value.encode("utf-8", "replace")) - (1 << 63)


def _path(above: int, name: str) -> int:
    known = kept_by_worker("style paths", dict)
    if len(known) > 100_000:
        known.clear()
    key = (above, name)
    if key not in known:
        known[key] = _hash(f"{above}/{name}")
    return known[key]


def _end_of(text: str, name: str, at: int) -> int:
    """Where the end tag of an element that holds no markup begins."""
    found = re.compile(rf"</{name}(?=[\s/>]|\Z)", re.I).search(text, at)
    return found.start() if found else len(text)


def blocks_of(page: str) -> tuple[list[tuple[str, Node, int]], list[Node]]:
    """Blocks (text, node, characters in links) in page order, and all nodes with text below them or not."""
    root = Node("", True, 0, None, 0, False, False)
    stack, nodes, blocks = [root], [root], []
    held: list[tuple[str, bool]] = []
    links = 0

    def flush():
        nonlocal held
        if held:
            text = " ".join(html.unescape("".join(t for t, _ in held)).split())
            if text:
                linked = sum(len(t) for t, x in held if x)
                whole = sum(len(t) for t, _ in held)
                node = stack[-1]
                blocks.append((text, node, linked * len(text) // max(whole, 1)))
            held = []

    def pop_to(index):
        nonlocal links
        if any(n.block or n.noise for n in stack[index:]):
            flush()
        links -= sum(n.name == "a" for n in stack[index:])
        del stack[index:]

    def end(names, stops):
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].name in names:
                # The outermost of them that is not beyond a stop.
                while i > 1 and stack[i - 1].name in names:
                    i -= 1
                pop_to(i)
                return
            if stack[i].name in stops:
                return

    at, size = 0, len(page)
    while at < size:
        found = TAG.search(page, at)
        if found is None:
            held.append((page[at:], links > 0))
            break
        if found.start() > at:
            held.append((page[at : found.start()], links > 0))
        at = found.end()
        closing, name, attributes = found.groups()
        if name is None:
            continue
        name = name.lower()
        if closing:
            if name in BLOCK:
                flush()
            if name in ("html", "body"):
                continue
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].name == name:
                    pop_to(i)
                    break
                if stack[i].name in CELLS and name not in TABLE:
                    break
                if name not in BLOCK and stack[i].block and stack[i].name != name:
                    break
            continue
        if name in RAW:
            at = _end_of(page, name, at)
            continue
        if name in BLOCK:
            flush()
            if name != "head":
                end(("head",), ())
            if name not in ("td", "th", "tr", "caption", "tbody", "thead", "tfoot"):
                end(("p",), CELLS)
            if name in HEADINGS and stack[-1].name in HEADINGS:
                pop_to(len(stack) - 1)
        if name in ENDED_BY:
            end(*ENDED_BY[name])
        if name in VOID:
            if name in ("br", "img"):
                held.append((" ", links > 0))
            continue
        if len(stack) >= DEPTH or (name in ("html", "body") and any(n.name == name for n in stack)):
            continue
        label, noise = described(name, attributes)
        above = stack[-1]
        block = name in BLOCK
        if block or noise:
            flush()
            path = _path(above.path, label)
            owner = above
            while not owner.block:
                owner = owner.up
            owner.children.append(label)
        else:
            path = above.path
        node = Node(name, block, path, above, noise, above.article or name == "article", above.main or name == "main")
        # An article in an article, such as a reader's comment, is not the page's.
        if name in ("article", "main") and not noise and not above.article:
            up, mark = node, 1 if name == "main" else 2
            while up is not None and up.holds & mark == 0:
                up.holds |= mark
                up = up.up
        links += name == "a"
        stack.append(node)
        nodes.append(node)
    flush()
    return blocks, nodes


def _kept_by_name(node: Node, wanted: int) -> bool:
    """Whether no element around a block has a prior of 0; ``wanted`` says what article elements the page has."""
    if (wanted == 2 and not node.article) or (wanted == 1 and not node.main):
        return False
    while node is not None:
        if node.noise == 1 and not node.holds & wanted:
            return False
        if node.noise == 2 and not node.article and not node.holds & wanted:
            return False
        node = node.up
    return True


def parsed(page: str) -> tuple[int, list[dict], list[dict]]:
    """The page's longest block, its blocks (text, path of nodes, item, share in links) and its nodes' styles.

    What names make unimportant is left out.
    """
    blocks, _ = blocks_of(page)
    root = blocks[0][1] if blocks else None
    while root is not None and root.up is not None:
        root = root.up
    wanted = 0 if root is None else 2 if root.holds & 2 else root.holds
    out, styles, longest = [], {}, ""
    for text, node, linked in blocks:
        if not _kept_by_name(node, wanted):
            continue
        path, up = [], node
        while up.up is not None:
            if up.block and up.path not in path:
                path.append(up.path)
                styles[up.path] = up.children
            up = up.up
        longest = text if len(text) > len(longest) else longest
        item = _hash(f"{path[0] if path else 0} {DIGITS.sub('0', text)}")
        out.append({"text": text, "path": path, "item": item, "links": linked / len(text)})
    return _hash(longest), out, [{"node": p, "style": _hash(" ".join(c))} for p, c in styles.items()]


PARSED = (
    "page_id bigint, url string, host string, longest bigint, "
    "blocks array<struct<text string, path array<bigint>, item bigint, links double>>, nodes array<struct<node bigint, style bigint>>"
)
_BLOCKS = pa.list_(pa.struct([("text", pa.string()), ("path", pa.list_(pa.int64())), ("item", pa.int64()), ("links", pa.float64())]))
_NODES = pa.list_(pa.struct([("node", pa.int64()), ("style", pa.int64())]))

#: Fixed value: the host of a url, without user and port.
HOST = r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)"


def parse(pages: DataFrame) -> DataFrame:
    def run(batches):
        for batch in batches:
            rows = [parsed(p.as_py()) for p in batch.column(3)]
            columns = [pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), _BLOCKS, _NODES))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *columns], ["page_id", "url", "host", "longest", "blocks", "nodes"])

    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), HOST, 1)).alias("host")
    plain = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), host, F.coalesce("html", F.lit("")).alias("html"))
    return plain.mapInArrow(run, PARSED)


def _sums(counted: DataFrame, times: Column) -> DataFrame:
    """Sums from which a node's entropies follow: of k and of k ln k."""
    k = F.col("k")
    return counted.groupBy("host", "node").agg(
        F.sum(k).alias("pages"), F.sum(k * times).alias("weight"), F.sum(k * times * F.log(k)).alias("spread")
    )


def importance(site: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of parsed pages: contents (host, item, importance) that several pages show, and branches (host, node, importance)."""
    some = site.where(F.col("host") != "")
    sites = some.where(F.size("blocks") > 0).groupBy("host").agg(F.count_distinct("longest").alias("m")).where(F.col("m") >= LEAST)
    shown = some.select("host", "longest", F.explode("blocks").alias("b")).select("host", "longest", "b.item", "b.path", "b.links")
    items = shown.groupBy("host", "item").agg(F.count_distinct("longest").alias("k"), F.first("path").alias("path"), F.avg("links").alias("links"))
    items = stored(items, "contents")
    scale = F.log(F.col("m").cast("double"))
    contents = items.where(F.col("k") > 1).join(sites, "host").select("host", "item", (1 - F.log("k") / scale).alias("importance"))
    below = items.select("host", F.explode("path").alias("node"), "k", "links")
    below = _sums(below, 1 - F.col("links"))
    styles = some.select("host", "longest", F.explode("nodes").alias("n")).groupBy("host", "n.node", "n.style").agg(F.count_distinct("longest").alias("k"))
    styles = _sums(styles, F.lit(1.0)).select("host", "node", F.col("pages").alias("shown"), F.col("spread").alias("styled"))
    both = below.join(styles, ["host", "node"]).join(sites, "host")
    content = (F.col("weight") - F.col("spread") / scale) / F.col("pages")
    presentation = F.when(F.col("shown") > 1, 1 - F.col("styled") / F.col("shown") / F.log("shown")).otherwise(1.0)
    composite = ATTENUATION * content + (1 - ATTENUATION) * presentation
    return contents, both.select("host", "node", composite.alias("importance"))


def noise(site: DataFrame) -> DataFrame:
    """(host, cut): the contents and branches of each site whose importance is too low."""
    contents, branches = importance(site)
    low = F.col("importance") < THRESHOLD
    cut = contents.where(low).select("host", F.col("item").alias("id")).unionByName(branches.where(low).select("host", F.col("node").alias("id")))
    return stored(cut.groupBy("host").agg(F.collect_set("id").alias("cut")), "noise")


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars): the main text of every page, blocks joined by two line feeds."""
    site = stored(parse(pages), "parsed-pages")
    cut = noise(site)
    size = cut.agg(F.coalesce(F.sum(F.size("cut") * 8 + F.octet_length("host") + 64), F.lit(0))).first()[0]
    if size <= BROADCAST:
        joined = site.join(F.broadcast(cut), "host", "left")
    else:
        # A hot host's pages are dealt over several tasks, each with a copy of its list.
        part = F.pmod(F.xxhash64("page_id", "longest"), F.lit(PARTS)).cast("int")
        copies = cut.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
        joined = site.withColumn("part", part).join(copies, ["host", "part"], "left")
    none = F.array().cast("array<bigint>")
    cut_ids = F.coalesce("cut", none)
    left = F.filter("blocks", lambda b: ~F.array_contains(cut_ids, b["item"]) & ~F.arrays_overlap(b["path"], cut_ids))
    text = F.array_join(F.transform(left, lambda b: b["text"]), "\n\n").alias("text")
    return joined.select("page_id", "url", text).withColumn("n_chars", F.length("text").cast("long"))
