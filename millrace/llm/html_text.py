"""Main text of web pages, by a site style tree.

All pages of a host are merged into one tree: a node is a path of tags with their classes.
For every node two distributions are gathered over the host's pages: of its contents and of
its presentation, the sequence of its children. A node's importance is the mean of the two
entropies, each as a share of the largest possible. What a template repeats has a low
importance, and a page loses its branches of low importance whose content is repeated; content
that one page has never goes. A node that a host has too seldom is judged by its domain's
nodes, and one that the domain has too seldom by those of all pages. Counts are aggregated
inside tasks and then by node and value, so a host with a third of all pages is dealt over many.

Elements whose tag, role or class says that they are no article (menus, headers, footers,
sidebars, notices, adverts, forms, scripts, comments) go whatever their importance, since
their words may differ on every page; a class counts in whole words, and never on the
document, its body, or an element that holds the article. If a page has an article or main
element, its text is what stands there; inside it only branches that a class sets apart are
judged by importance, so that articles which a host repeats stay whole. A branch that holds
more than half of the text is the page's matter and stays, however often it is repeated.

Defined results: null or empty html gives an empty text; unclosed and crossed tags, unfinished
tags and references at the end are tolerated, elements are nested to any depth; a null url
belongs to the host with no name; rows are judged alone but for their tree, repeated rows and
ids are all returned; an empty table gives no rows; only the id, the url and the html are read.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from html import unescape
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.durable import materialise, spread
from .batches import sliced
from .url_filter import host_and_path

_TOKEN = re.compile(r"""<(?:!--.*?(?:-->|\Z)|(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*"|'[^']*')*+)(?:>|\Z)|(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)|[!?/][^>]*(?:>|\Z))""", re.S)
_NAMED = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)

# Elements by their part in a page.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
DROPPED = frozenset("head script style noscript template nav header footer aside form iframe object svg canvas button select textarea dialog menu title xmp noembed noframes".split())
CLOSED_BY = {
    "p": frozenset("address article aside blockquote center details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split()),
    "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]),
    "tr": frozenset(["tr", "tbody", "tfoot"]), "td": frozenset(["td", "th", "tr"]),
    "th": frozenset(["td", "th", "tr"]), "option": frozenset(["option"])
}
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())
UNWANTED = frozenset("ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer header masthead menu modal nav navbar navigation newsletter notice notices popup promo promos promotion related share sharing sidebar social sponsor sponsored subscribe widget widgets".split())
#: Parts of a name that say that the element is about one of the above, or that it has none.
PLACES = frozenset("area bar block body bottom box btn button buttons column container content form group holder inner items left links list message middle outer overlay panel posts right row section slot thread top unit widget wrap wrapper".split())
NONE_OF = frozenset("has hide hides hidden no non not with without".split())
ARTICLE = frozenset(["article", "main"])

#: A host's node seen less often is judged by the nodes of its domain, or else by those of all pages, if they are seen as often.
LEAST_SEEN = 20
#: Branches below this importance go, where their content is this share of the node's contents at least, and two of them.
LOW, REPEATED_SHARE = 0.1, 0.01
#: An element that a class marks stays when it holds more than this share of a page without an article.
NEARLY_ALL = 0.9


@lru_cache(1 << 16)
def _step(above: int, name: str) -> int:
    """The number of a path: that of the node above and the node's own name."""
    return _hash(f"{above} {name}") >> 1


def _hash(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")


@lru_cache(1 << 16)
def unwanted(words: str) -> bool:
    """Whether the words of a class or an id say that an element is no part of an article.

    A word counts as a whole: ``sidebar``, ``site-footer`` and ``comments-area`` do, ``no-sidebar`` and
    ``header-image-post`` do not.
    """
    for word in words.lower().split():
        parts = [x for x in re.split(r"[-_]+", word) if x]
        if not parts or not NONE_OF.isdisjoint(parts):
            continue
        if parts[-1] in UNWANTED or (parts[0] in UNWANTED and all(x in PLACES or x in UNWANTED or x.isdigit() for x in parts[1:])):
            return True
    return False


class _Node:
    """An element that is no inline one; its text is the page's ``blocks[first:end]``."""

    __slots__ = ("tag", "path", "above", "shut", "unwanted", "marked", "first", "end", "children")

    def __init__(self, tag, path, above, shut, is_unwanted, marked, first):
        self.tag, self.path, self.above, self.shut, self.unwanted, self.marked, self.first, self.end, self.children = tag, path, above, shut, is_unwanted, marked, first, first, []


class Page:
    """A page's nodes in document order and its blocks of text, without what tags and roles leave out."""

    def __init__(self, html: str):
        self.nodes: list[_Node] = []
        self.blocks: list[str] = []
        self._read(html)
        sizes = [0, *accumulate(map(len, self.blocks))]
        self._size = lambda node: sizes[node.end] - sizes[node.first]
        self._total = sizes[-1]
        self._choose()

    def _read(self, html: str) -> None:
        buffer: list[str] = []
        blocks, nodes = self.blocks, self.nodes
        stack, opened, at, end = [_Node("", 0, None, False, False, False, 0)], Counter(), 0, len(html)

        def flush() -> None:
            if buffer:
                text = " ".join("".join(buffer).split())
                buffer.clear()
                if text:
                    blocks.append(text)

        def close() -> None:
            node = stack.pop()
            opened[node.tag] -= 1
            node.end = len(blocks)

        while at < end:
            match = _TOKEN.search(html, at)
            if match is None:
                begin, following = end, end
            else:
                begin, following = match.span()
            if begin > at and not stack[-1].shut:
                text = html[at:begin]
                buffer.append(unescape(text) if "&" in text else text)
            at = following
            if match is None:
                break
            slash, tag, attributes = match.group(1, 2, 3) if match.group(2) else match.group(4, 5, 6)
            if not tag:
                continue
            tag = tag.lower()
            inline = tag in INLINE
            if slash:
                if opened[tag]:
                    flush()
                    while stack[-1].tag != tag:
                        close()
                    close()
                elif tag in ("p", "br"):
                    flush()
                continue
            named = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _NAMED.finditer(attributes)} if "=" in attributes else {}
            words = f"{named.get('class', '')} {named.get('id', '')}".strip()
            by_class = bool(words) and tag not in ("html", "body") and unwanted(words)
            by_tag = tag in DROPPED or named.get("role", "").lower() in ROLES or (inline and by_class)
            if inline and not by_tag and not stack[-1].shut:
                continue
            if not inline:
                flush()
            if tag in VOID:
                continue
            while not inline:
                # The nearest element that is not inline may end where this one begins.
                depth = next(i for i in range(len(stack) - 1, -1, -1) if stack[i].tag not in INLINE)
                if tag not in CLOSED_BY.get(stack[depth].tag, ()):
                    break
                while len(stack) > depth:
                    close()
            above = stack[-1]
            above.children.append(tag)
            marked = bool(words) and tag not in ARTICLE and tag not in ("html", "body")
            node = _Node(tag, _step(above.path, f"{tag}.{words}"), above, above.shut or by_tag, by_class, marked, len(blocks))
            if not node.shut:
                nodes.append(node)
            stack.append(node)
            opened[tag] += 1
            if tag in RAW:
                stop = re.compile(f"</{re.escape(tag)}", re.I).search(html, at)
                at = stop.start() if stop else end
        flush()
        while len(stack) > 1:
            close()

    def _without(self, nodes: list[_Node]) -> list[bool]:
        """Which blocks stand in none of the nodes."""
        out = [True] * len(self.blocks)
        for node in nodes:
            out[node.first : node.end] = [False] * (node.end - node.first)
        return out

    def _choose(self) -> None:
        """Which blocks tags and classes leave, and whether they stand in an article."""
        marked = [x for x in self.nodes if x.unwanted]
        left = self._without(marked)
        articles = [x for x in self.nodes if x.tag in ARTICLE and x.end > x.first]
        if marked and not any(any(left[x.first : x.end]) for x in articles):
            outside = sum(len(b) for b, stays in zip(self.blocks, left) if stays)
            if articles:
                # All articles stand in elements that a class marks: the longest is the page's, if what is outside is shorter.
                best = max(articles, key=self._size)
                spared = {id(x) for x in _upwards(best)} if self._size(best) > outside else set()
            else:
                spared = {id(x) for x in marked if self._size(x) > NEARLY_ALL * self._total}
            if spared:
                marked = [x for x in marked if id(x) not in spared]
                left = self._without(marked)
        inside = [False] * len(self.blocks)
        for x in articles:
            inside[x.first : x.end] = [True] * (x.end - x.first)
        self.in_article = [a and b for a, b in zip(inside, left)]
        if not any(self.in_article):
            self.in_article = [False] * len(self.blocks)
        self.left = left
        self.article = any(self.in_article)

    def judged(self) -> list[tuple[_Node, int, int]]:
        """The nodes that importance decides on, each with its content and the length of its text."""
        sums = [0, *accumulate(_hash(b) if stays else 0 for b, stays in zip(self.blocks, self.left))]
        sizes = [0, *accumulate(len(b) if stays else 0 for b, stays in zip(self.blocks, self.left))]
        within = [0, *accumulate(self.in_article)]
        out = []
        for x in self.nodes:
            size = sizes[x.end] - sizes[x.first]
            if not size or x.path in ROOTS:
                continue
            # Of the article only what a class sets apart; nothing that holds the article.
            if within[x.end] > within[x.first] and (not x.marked or not any(y.tag in ARTICLE for y in _upwards(x))):
                continue
            out.append((x, (sums[x.end] - sums[x.first]) & 0x7FFFFFFFFFFFFFFF, size))
        return out

    def count(self, seen: Counter) -> None:
        """Add the nodes' contents and presentations to ``seen``."""
        for x, content, _ in self.judged():
            seen[0, x.path, content] += 1
            seen[1, x.path, _hash(" ".join(x.children)) >> 1] += 1

    def text(self, low: dict[int, frozenset[int]] | None = None) -> str:
        """The page's text, without branches whose content is one of those that ``low`` has for their path."""
        kept = self.in_article if self.article else self.left
        if low:
            judged = [(x, size) for x, content, size in self.judged() if content in low.get(x.path, ())]
            matter = sum(len(b) for b, stays in zip(self.blocks, kept) if stays)
            others = self._without([x for x, size in judged if 2 * size <= matter])
            kept = [a and b for a, b in zip(kept, others)]
        return " ".join(b for b, stays in zip(self.blocks, kept) if stays)


def _upwards(node: _Node) -> Iterator[_Node]:
    while node is not None:
        yield node
        node = node.above


#: Paths that are no branches.
ROOTS = frozenset([_step(0, "html."), _step(_step(0, "html."), "body."), _step(0, "body.")])


def walk(html: str) -> str:
    """The text of one page by itself."""
    return Page(html).text()


class _Scope:
    """The style trees of all values of ``keys``: hosts, domains, or one of all pages."""

    def __init__(self, values: DataFrame, keys: list[str], least_seen: int, low: float):
        self.at = [*keys, "path"]
        counts = values.groupBy(*self.at, "kind", "value").agg(F.sum("n").alias("n"))
        total = F.sum("n")
        share = F.when(total > 1, (F.ln(total) - F.sum(F.col("n") * F.ln("n")) / total) / F.ln(total)).otherwise(1.0)
        shares = counts.groupBy(*self.at, "kind").agg(total.alias("seen"), share.alias("share"))
        nodes = shares.groupBy(*self.at).agg(F.max("seen").alias("seen"), F.avg("share").alias("importance"))
        self.nodes = materialise(nodes.withColumn("enough", F.col("seen") >= least_seen))
        unimportant = self.nodes.where(F.col("enough") & (F.col("importance") < low)).select(*self.at, "seen")
        repeated = counts.where("kind = 0 and n > 1").join(unimportant, self.at).where(F.col("n") >= REPEATED_SHARE * F.col("seen"))
        #: At most ``1 / REPEATED_SHARE`` contents of each node.
        self.low = repeated.groupBy(*self.at).agg(F.collect_list("value").alias("contents"))


def _low_nodes(own: DataFrame, least_seen: int, low: float) -> DataFrame:
    """``host, low``: the nodes of low importance of each host that has any, each with the contents that are repeated."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "html"):
            counts: dict[str, Counter] = {}
            for host, html in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist()):
                if html:
                    Page(html).count(counts.setdefault(host, Counter()))
            rows = [(host, *key, n) for host, seen in counts.items() for key, n in seen.items()]
            if rows:
                kinds = (pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=["host", "kind", "path", "value", "n"])

    found = own.select("host", "html").mapInArrow(run, "host string, kind int, path long, value long, n long")
    found = found.groupBy("host", "path", "kind", "value").agg(F.sum("n").alias("n"))
    values = materialise(found.withColumn("domain", F.substring_index("host", ".", -2)))
    host, domain, pages = (_Scope(values, keys, least_seen, low) for keys in (["host"], ["domain"], []))
    seldom = host.nodes.where(~F.col("enough")).select("host", F.substring_index("host", ".", -2).alias("domain"), "path")
    by_domain = seldom.join(domain.low, domain.at).select("host", "path", "contents")
    by_pages = seldom.join(domain.nodes.where("enough"), domain.at, "left_anti").join(pages.low, pages.at).select("host", "path", "contents")
    every = host.low.select("host", "path", "contents").unionByName(by_domain).unionByName(by_pages)
    return every.groupBy("host").agg(F.collect_list(F.struct("path", "contents")).alias("low"))


#: A table of low nodes up to this size is broadcast; beyond it hosts are salted.
MOST_BROADCAST_BYTES = 16 << 20
SALTS = 32


def extract(
    pages: DataFrame, id_column: str = "page_id", url_column: str = "url", html_column: str = "html",
    least_seen: int = LEAST_SEEN, low: float = LOW,
) -> DataFrame:
    """``id, url, text, n_chars`` of every row of ``pages``."""
    host = host_and_path(F.coalesce(F.col(url_column).cast("string"), F.lit("")))[0]
    own = spread(pages.select(
        F.col(id_column).alias("id"), F.col(url_column).alias("url"), host.alias("host"),
        F.col(html_column).cast("string").alias("html")
    ))
    nodes = materialise(_low_nodes(own, least_seen, low))
    bytes_of = F.aggregate("low", F.lit(64), lambda a, x: a + 8 * F.size(x["contents"]) + 48)
    size = nodes.agg(F.sum(F.length("host") + bytes_of)).first()[0] or 0
    if size <= MOST_BROADCAST_BYTES:
        joined = own.join(F.broadcast(nodes), "host", "left")
    else:
        salted = nodes.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = own.withColumn("salt", F.pmod(F.xxhash64("html"), F.lit(SALTS)).cast("int")).join(salted, ["host", "salt"], "left")
    schema = T.StructType([
        pages.schema[id_column], pages.schema[url_column], T.StructField("text", T.StringType()),
        T.StructField("n_chars", T.LongType())
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "html"):
            # A host's pages of one batch share its table.
            hosts: dict[str, dict[int, frozenset[int]]] = {}
            texts = []
            for i, (host, html) in enumerate(zip(batch.column("host").to_pylist(), batch.column("html").to_pylist())):
                if host not in hosts:
                    hosts[host] = {x["path"]: frozenset(x["contents"]) for x in batch.column("low")[i].as_py() or ()}
                texts.append(Page(html).text(hosts[host]) if html else "")
            columns = [batch.column("id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return joined.select("id", "url", "host", "html", "low").mapInArrow(run, schema)
