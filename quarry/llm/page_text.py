"""Main-text extraction with a site style tree (operator 9).

Pages of one host are merged into a style tree: a node is an element's path of tags and
class names, counted over the host's pages. A node whose pages all show the same content,
in the same presentation, carries little information: its importance, from the entropies
of its content over pages and of its presentations, is near 0. Such branches are removed
from every page, and so are elements that name what they are (navigation, footers, forms,
adverts, comments). If a page marks its article, only what is inside counts; there fewer
names are taken as noise, and the style tree removes a branch only where many pages agree.

The tree is built by grouped counts of hashes, so a hot host arrives as partial counts.
Its removed nodes meet its pages in one sorted stream per host, nodes first, so a task holds
one host's nodes and a batch of pages; hosts of over a ``HOT``-th of all pages, fewer than
``HOT`` by that, are spread over ``GRAINS`` streams.

Defined cases: null html gives empty text; a url that is null or has no host has no style
tree; repeated rows are extracted each by itself; an empty table gives an empty result;
unclosed or stray tags never fail: a script or style that isn't closed lasts to the page's
end, other raw elements that aren't closed are their tag alone; elements nested deeper than
``DEEPEST`` stand at that depth, as in browsers; very long pages are read whole; other
columns are ignored.
"""

from __future__ import annotations

import hashlib
import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .storage import materialize, small_batches
from .textops import slices

# Element and class names of HTML pages.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
STRUCTURE = frozenset(
    "html head body article main section div nav header footer aside form ul ol dl li dt dd table thead tbody tfoot tr td th caption p pre blockquote "
    "h1 h2 h3 h4 h5 h6 figure figcaption fieldset details summary address menu dialog center hgroup search button".split()
)
RAW = frozenset("script style noscript template iframe textarea title svg object canvas select noembed noframes xmp".split())
TO_THE_END = frozenset(("script", "style"))
NOISE_TAGS = frozenset("nav footer aside form menu dialog search fieldset header head button".split())
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar note".split())
# Names of readers' and other articles, which are noise wherever they stand and whatever they hold.
OTHERS = frozenset("comment comments commentlist disqus reply replies respond discussion related recommended recommendations teaser teasers".split())
# Names that are noise inside an article too.
INSIDE = OTHERS | frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner promo promotion sponsor sponsored cookie cookies consent gdpr notice notices notification alert "
    "popup modal newsletter subscribe subscription sidebar menu menus nav navbar navigation breadcrumb breadcrumbs share sharing social".split()
)
NOISE_NAMES = INSIDE | frozenset(
    "overlay side aside widget widgets footer foot header masthead topbar login signup signin register searchbox toolbar pagination pager copyright legal skip tags tagcloud form".split()
)
UNLESS = frozenset("has with without no".split())  # "has-sidebar" isn't a sidebar
MAIN_TAGS = frozenset(("article", "main"))
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
PLAIN = frozenset(("p", *HEADINGS, *MAIN_TAGS))

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>]*+)(?:>|\Z)|<[/!?][^>]*+>?|[^<]++|<",
    re.S,
)
NAMES = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
DIGITS = re.compile(r"\d+")
GAMMA, IMPORTANCE, LEAST_PAGES = 0.9, 0.25, 4
HOT, GRAINS, DEEPEST = 1024, 64, 512
IN_MAIN, IS_PLAIN, IS_ROOT = 1, 2, 4


class Node:
    """An element of a page. ``id`` is its path's hash: alike for all elements that merge in the style tree."""

    __slots__ = ("children", "cut", "id", "inside", "linked", "name", "named", "others", "parent", "tag")

    def __init__(self, parent: Node | None, tag: str, name: int):
        self.parent, self.tag, self.name, self.children = parent, tag, name, []
        self.id = hash((parent.id, name)) if parent else 0  # of whole numbers: alike in every process
        self.inside = self.named = self.others = self.cut = self.linked = False
        if parent:
            self.inside, self.named, self.others, self.cut = parent.inside, parent.named, parent.others, parent.cut

    def line(self) -> Iterator[Node]:
        """The element and those around it, inside out, the page itself left out."""
        at = self
        while at.parent:
            yield at
            at = at.parent

    def mark(self) -> int:
        plain = self.tag in PLAIN and self.name == _name(self.tag)
        return IN_MAIN * self.inside | IS_PLAIN * plain | IS_ROOT * (self.tag in ("html", "body"))


def _hash(x: str) -> int:
    return int.from_bytes(hashlib.blake2b(x.encode("utf-8", "replace"), digest_size=8).digest(), "little", signed=True)


_names: dict[str, int] = {}


def _name(x: str) -> int:
    if len(_names) > 100_000:
        _names.clear()
    return _names[x] if x in _names else _names.setdefault(x, _hash(x))


def _open(above: Node, tag: str, attributes: str, removed: frozenset[int]) -> Node:
    words, role = [], ""
    if "=" in attributes:
        for kind, *value in NAMES.findall(attributes):
            value = next((v for v in value if v), "").lower()
            if kind.lower() == "role":
                role = value
            else:
                words += value.split()
    node = Node(above, tag, _name(" ".join([tag, *(DIGITS.sub("0", w) for w in words)])))
    parts = [x for w in words if not UNLESS & (x := frozenset(re.split(r"[-_]", w)))] if tag not in ("html", "body") else []
    node.others |= any(OTHERS & x for x in parts)
    main = tag in MAIN_TAGS or role == "main"
    if main:
        # What a wrapper's class names say doesn't hold for the article in it; its tag, and whose comments it holds, do.
        node.named = node.others or any(a.tag in NOISE_TAGS for a in above.line())
        node.inside |= not node.named
    else:
        # A header inside an article holds its heading.
        noise = tag in NOISE_TAGS and not (tag == "header" and above.inside) or role in NOISE_ROLES
        node.named |= node.others or noise or any((INSIDE if above.inside else NOISE_NAMES) & x for x in parts)
    node.cut |= node.id in removed
    return node


def _implied_end(open_: str, tag: str) -> bool:
    """Does a new element of ``tag`` end the open one?"""
    return open_ in ("p", "head") or tag == "li" == open_ or tag in HEADINGS and open_ in HEADINGS or tag in ("dt", "dd") and open_ in ("dt", "dd")


def blocks(page: str, removed: frozenset[int] = frozenset()) -> list[tuple[Node, str]]:
    """The page's text blocks in order, each with the element that it stands in."""
    out: list[tuple[Node, str]] = []
    stack = [Node(None, "", 0)]
    paragraphs = at = 0  # open ones
    text: list[str] = []
    unclosed: set[str] = set()

    def close() -> None:
        if text:
            whole = " ".join(html.unescape("".join(text)).split())
            text.clear()
            if whole:
                out.append((stack[-1], whole))

    def leave(to: int) -> None:
        nonlocal paragraphs
        paragraphs -= sum(n.tag == "p" for n in stack[to:])
        del stack[to:]

    while at < len(page):
        m = TOKEN.match(page, at)
        at = m.end()
        end, tag, attributes = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if tag is None:
            token = m[0]
            if token[0] != "<" or token == "<":
                text.append(token)
            continue
        if page[at - 1] != ">":
            break  # cut off inside a tag
        tag = tag.lower()
        if tag in RAW:
            if not end and tag not in unclosed and not (tag == "svg" and attributes.endswith("/")):
                closing = re.compile(rf"</{tag}(?=[\s/>])[^>]*+>?", re.I).search(page, at)
                if closing:
                    at = closing.end()
                elif tag in TO_THE_END:
                    break
                else:
                    unclosed.add(tag)
            continue
        if tag in VOID:
            if tag in ("br", "hr"):
                text.append(" ")
            continue
        if tag not in STRUCTURE or tag == "button" and paragraphs:
            continue
        close()
        if end:
            i = next((i for i in range(len(stack) - 1, 0, -1) if stack[i].tag == tag), None)
            if i:
                leave(i)
        else:
            while len(stack) > 1 and _implied_end(stack[-1].tag, tag):
                leave(len(stack) - 1)
            leave(min(len(stack), DEEPEST))
            stack.append(_open(stack[-1], tag, attributes, removed))
            paragraphs += tag == "p"
    close()
    return out


def main_text(page: str | None, removed: frozenset[int] = frozenset()) -> str:
    """The article's text without branches that name themselves noise or that the style tree removed."""
    if not page:
        return ""
    found = blocks(page, removed)
    if any(n.inside for n, _ in found):
        found = [(n, t) for n, t in found if n.inside]
    kept = [(n, t) for n, t in found if not n.named]
    return " ".join(t for _, t in [(n, t) for n, t in kept if not n.cut] or kept)


def observations(page: str) -> Iterator[tuple[int, int, int, int, list[int] | None]]:
    """(node, mark, kind, value, line): a page's distinct contents (kind 0, with the nodes around) and presentation (1) at each node."""
    seen, linked = set(), []
    for node, text in blocks(page):
        if node.named or not node.parent:
            continue
        value = _hash(text)
        if (node.id, value) not in seen:
            seen.add((node.id, value))
            yield node.id, node.mark(), 0, value, [a.id for a in node.line()]
        node.children.append(0)
        for a in node.line():
            if a.linked:
                break
            a.linked = True
            a.parent.children.append(a.name)
            linked.append(a)
    shape: dict[int, tuple[Node, list]] = {}
    for a in linked:
        shape.setdefault(a.id, (a, []))[1].append(a.children)
    for key, (a, children) in shape.items():
        yield key, a.mark(), 1, _hash(str(children)), None


SEEN = "host string, node long, mark int, kind int, value long, line array<long>"


def _observe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64())
    for batch in slices(batches, "html"):
        rows = [(host, *x) for host, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) if host and page for x in observations(page)]
        columns = list(zip(*rows, strict=True)) or [[]] * len(kinds)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=[x.split()[0] for x in SEEN.split(", ")])


def host_of(url):
    return F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def style_tree(pages: DataFrame) -> DataFrame:
    """(host, node, mark, pages, importance, news) of every node of every host's merged tree."""
    seen = pages.select(host_of(F.col("url")).alias("host"), "html").mapInArrow(_observe, SEEN)
    counted = materialize(seen.groupBy("host", "node", "kind", "value").agg(F.count("*").alias("n"), F.max("mark").alias("mark"), F.max("line").alias("line")), "style-tree")
    key = ["host", "node"]
    size = counted.where("kind = 1").groupBy(*key).agg(F.sum("n").alias("m"), F.sum(F.col("n") * F.log("n")).alias("s"), F.count("*").alias("l"), F.max("mark").alias("mark"))
    node = size.select(*key, "mark", "m", "l", F.when(F.col("m") > 1, (F.log("m") - F.col("s") / F.col("m")) / F.log("m")).otherwise(1.0).alias("presentation"))
    # A content's entropy over its n pages is log n to the base of the node's m pages.
    leaf = counted.where("kind = 0").groupBy(*key).agg(F.sum("n").alias("seen"), F.sum(F.col("n") * F.log("n")).alias("spread"), F.max("line").alias("line"))
    leaf = leaf.join(node.select(*key, "m"), key)
    new = leaf.select("host", "line", "seen", F.when(F.col("m") > 1, F.greatest(F.lit(0.0), 1 - F.col("spread") / F.col("seen") / F.log("m"))).otherwise(1.0).alias("news"))
    content = new.select("host", F.explode("line").alias("node"), "seen", "news").groupBy(*key).agg((F.sum(F.col("seen") * F.col("news")) / F.sum("seen")).alias("news"))
    weight = F.pow(F.lit(GAMMA), F.col("l"))
    return node.join(content, key).select(*key, "mark", F.col("m").alias("pages"), ((1 - weight) * F.col("presentation") + weight * F.col("news")).alias("importance"), "news")


def removed_nodes(tree: DataFrame) -> DataFrame:
    """(host, node): branches of low importance, inside articles only where many pages' contents hardly vary at all."""
    has = lambda bit: F.col("mark").bitwiseAND(bit) != 0
    low = (F.col("pages") >= LEAST_PAGES) & (F.col("importance") < IMPORTANCE) & (F.col("news") < IMPORTANCE)
    within = (F.col("pages") >= 5 * LEAST_PAGES) & (F.col("news") < 0.05) & ~has(IS_PLAIN)
    return tree.where(low & ~has(IS_ROOT) & (~has(IN_MAIN) | within)).select("host", "node")


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From streams of a host's removed nodes and then its pages: the pages' texts."""
    now, nodes = None, set()
    for batch in slices(batches, "html"):
        places, text = [], []
        for i, (host, grain, node, page, is_page) in enumerate(zip(*[batch.column(c).to_pylist() for c in ("_host", "_grain", "node", "html", "_page")], strict=True)):
            if (host, grain) != now:
                now, nodes = (host, grain), set()
            if is_page:
                places.append(i)
                text.append(main_text(page, nodes))
            else:
                nodes.add(node)
        found = batch.take(pa.array(places, pa.int64()))
        yield pa.RecordBatch.from_arrays([found.column("page_id"), found.column("url"), pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())], names=["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame) -> DataFrame:
    """Per page: page_id, url, text, n_chars."""
    small_batches(pages.sparkSession)
    pages = pages.select("page_id", F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    hosted = pages.withColumn("_host", F.coalesce(host_of(F.col("url")), F.lit("")))
    counted = hosted.groupBy("_host").count()
    most = pages.count() / HOT
    hot = F.broadcast(counted.where(F.col("count") > most).select("_host", F.lit(True).alias("_hot")))  # fewer than HOT hosts
    spread = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(GRAINS)).cast("int")
    rows = hosted.withColumn("_grain", spread).join(hot, "_host", "left").withColumn("_grain", F.when(F.col("_hot"), F.col("_grain")).otherwise(0))
    nodes = removed_nodes(style_tree(pages)).withColumnRenamed("host", "_host").join(hot, "_host", "left")
    nodes = nodes.withColumn("_grain", F.explode(F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(GRAINS - 1))).otherwise(F.array(F.lit(0)))))
    none = [F.lit(None).cast(pages.schema[c].dataType).alias(c) for c in ("page_id", "url", "html")]
    both = nodes.select("_host", "_grain", F.lit(False).alias("_page"), "node", *none)
    both = both.unionByName(rows.select("_host", "_grain", F.lit(True).alias("_page"), F.lit(None).cast("long").alias("node"), "page_id", "url", "html"))
    streams = both.repartition("_host", "_grain").sortWithinPartitions("_host", "_grain", "_page")
    schema = T.StructType([T.StructField("page_id", pages.schema["page_id"].dataType), T.StructField("url", T.StringType()), T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])
    return streams.mapInArrow(_texts, schema)
