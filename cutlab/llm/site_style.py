"""Main text of web pages by a site style tree.

The pages of a host share templates. Merging their element trees gives, for
every path of elements, the presentations it takes (orders of its children) and
the contents it carries on the pages of the host. A branch that looks and reads
alike on page after page carries little information and is removed. The same
tree, merged over all hosts, judges branches that a host has too few pages for:
a menu or an advert that is drawn from the same stock everywhere is dull there.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from html.parser import HTMLParser
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cutlab.llm import contents
from cutlab.llm.common import drop_stored, few_rows, stored

#: Branches whose importance, times the weight of their markup, is below this go.
IMPORTANCE = 0.75
#: Weight of a node's own presentation against its contents.
PRESENTATION_WEIGHT = 0.1
#: What a node is worth before any page is seen counts like so many pages of full importance.
PRIOR_PAGES = 8
#: What markup says: in the article, nothing, something else by a name, or something else by an element or by standing beside the article.
IN_ARTICLE, NEUTRAL, NAMED, ASIDE = 1.2, 1.0, 0.7, 0.5
#: Names that would take a larger share of what is important on a page are not believed.
MOST_NAMED = 0.9
#: Up to so many dull nodes (16 bytes each) are sent to all tasks; more are joined to the pages.
MOST_SHARED = 1_000_000

_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i img input ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
#: Elements without text of their own.
_SILENT = set("head script style noscript template button select textarea option svg canvas iframe object title audio video map".split())
#: Elements and words of class, id and role that name something else than the article.
_ASIDE = {"nav", "aside", "dialog", "menu", "footer"}
_NAMES = set(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo banner nav navbar navigation menu breadcrumb breadcrumbs sidebar footer header masthead cookie cookies cookie-notice consent gdpr notice notices "
    "alert popup modal newsletter subscribe subscription signup login share sharing social related recommended recommendations comment comments disqus respond reply replies widget pagination pager search form "
    "contentinfo complementary dialog toolbar teaser".split()
)
_P: set[str] = {"p"}
_NONE: set[str] = set()
_CLOSES = {"li": {"p", "li"}, "dt": {"p", "dt", "dd"}, "dd": {"p", "dt", "dd"}, "tr": {"p", "tr", "td", "th"}, "td": {"p", "td", "th"}, "th": {"p", "td", "th"}, "option": {"p", "option"}}
_SCOPES = {"body", "article", "main", "section", "div", "td", "th", "li", "table", "ul", "ol", "blockquote", "aside", "nav", "header", "footer", "form"}
_COMMENT_END = re.compile(r"--!?>|\Z")
_DIGITS = re.compile(r"\d+")


@lru_cache(maxsize=1 << 16)
def _hash(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text.encode("utf-8", "replace"))


def _mixed(a: int, b: int) -> int:
    x = (a * 0x9E3779B97F4A7C15 + b) & 0xFFFFFFFFFFFFFFFF
    x = ((x ^ (x >> 31)) * 0xBF58476D1CE4E5B9) & 0xFFFFFFFFFFFFFFFF
    return x ^ (x >> 29)


class _Node:
    """An open element: its path as a hash, and what its markup says."""

    __slots__ = ("tag", "path", "silent", "named", "outer", "says", "article", "holder", "form", "wraps", "parent")

    def __init__(self, tag: str, path: int, parent: _Node | None) -> None:
        self.tag, self.path, self.parent, self.form, self.wraps, self.holder = tag, path, parent, 0, False, self
        self.outer, self.says = None, NEUTRAL
        self.silent, self.named, self.article = (parent.silent, parent.named, parent.article) if parent else (False, None, None)


class _Page(HTMLParser):
    """The blocks of a page in order, each with the innermost element that is not inline."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = _Node("", 0, None)
        self.stack: list[_Node] = [self.root]
        self.open: Counter = Counter()
        self.articles: list[tuple[_Node, bool]] = []
        self.names: list[_Node] = []
        self.blocks: list[tuple[_Node, str]] = []
        self.parts: list[str] = []
        self.owner = self.root

    # What browsers take for a comment is one, whatever stands in it.
    def parse_comment(self, i: int, report: int = 1) -> int:
        if self.rawdata.startswith((">", "->"), i + 4):
            return self.rawdata.index(">", i) + 1
        return _COMMENT_END.search(self.rawdata, i + 4).end()

    def parse_marked_section(self, i: int, report: int = 1) -> int:
        end = self.rawdata.find(">", i)
        return len(self.rawdata) if end < 0 else end + 1

    def updatepos(self, i: int, j: int) -> int:
        return j  # line numbers are of no use here

    def flush(self) -> None:
        if not self.parts:
            return
        text = " ".join("".join(self.parts).split())
        if text:
            self.blocks.append((self.owner, text))
        self.parts = []

    def _name(self, node: _Node, says: float) -> None:
        node.named, node.outer, node.says = node, node.named, says
        self.names.append(node)

    def _cut(self, k: int) -> None:
        for node in self.stack[k:]:
            self.open[node.tag] -= 1
        del self.stack[k:]

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag not in _INLINE:
            self.flush()
            closes = _CLOSES.get(tag, _P)
            if any(self.open[c] > 0 for c in closes):
                for k in range(len(self.stack) - 1, 0, -1):
                    if self.stack[k].tag in closes:
                        self._cut(k)
                        break
                    if self.stack[k].tag in _SCOPES:
                        break
        if tag in _VOID:
            return
        a = dict(attrs)
        parent = self.stack[-1]
        names = _NONE
        if "class" in a or "id" in a or "role" in a:
            ident = _DIGITS.sub("0", a.get("id") or "")  # ids are often numbered page by page
            names = set(" ".join((a.get("class") or "", ident, a.get("role") or "")).lower().split())
        label = _hash(".".join([tag, *sorted(names)]) if names else tag)
        parent.holder.form = _mixed(parent.holder.form, label)
        node = _Node(tag, _mixed(parent.path, label), parent)
        hidden = bool(a) and ("hidden" in a or a.get("aria-hidden") == "true" or "display:none" in (a.get("style") or "").replace(" ", "").lower())
        node.silent = parent.silent or hidden or tag in _SILENT
        if tag in ("article", "main") or names & {"main", "article"} & {a.get("role")}:
            if node.article is None and not node.silent:
                node.article, node.named = node, None
                self.articles.append((node, bool(names & _NAMES)))
                while parent is not self.root and not parent.wraps:  # what wraps the article is not named by its class
                    parent.wraps = True
                    parent = parent.parent
            elif names & _NAMES:
                self._name(node, NAMED)
        elif tag in _ASIDE or (tag == "header" and node.article is None):
            self._name(node, ASIDE)
        elif tag not in ("html", "body") and (tag == "form" or names & _NAMES):
            if node.named is None or tag not in _INLINE:
                self._name(node, NAMED)
        if tag in _INLINE and node.named is not node:
            node.holder, node.path = self.stack[-1].holder, self.stack[-1].path
        self.stack.append(node)
        self.open[tag] += 1

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in _VOID:
            self._cut(len(self.stack) - 1)

    def handle_endtag(self, tag: str) -> None:
        if tag not in _INLINE:
            self.flush()
        if self.open[tag] > 0:
            for k in range(len(self.stack) - 1, 0, -1):
                if self.stack[k].tag == tag:
                    self._cut(k)
                    return
                if tag in _INLINE and self.stack[k].tag in _SCOPES:
                    return

    def handle_data(self, data: str) -> None:
        node = self.stack[-1]
        if node.silent:
            return
        if self.parts and node.holder is not self.owner and data.strip():
            if any(p.strip() for p in self.parts) and (node.named or self.owner.named):
                self.flush()  # an advert inside a line is a block of its own
            else:
                self.owner = node.holder
        if not self.parts:
            self.owner = node.holder
        self.parts.append(data)


def parse_page(html: str) -> list[tuple[_Node, float, str]]:
    """(node, weight of its markup, text) of each block of a page, in order."""
    at = html.rfind("<")
    if at > html.rfind(">") and html[at + 1 : at + 2].isalpha() or html[at + 1 : at + 2] == "/" and at > html.rfind(">"):
        html = html[:at]  # a tag that never ends
    page = _Page()
    page.feed(html)
    page.close()
    page.flush()
    length: Counter = Counter()
    held: Counter = Counter()
    for node, text in page.blocks:
        length[id(node.article)] += len(text)
        held[id(node.named)] += len(text)
    for n in reversed(page.names):
        held[id(n.outer)] += held[id(n)]
    # A name is not believed of what holds most of a page without an article; what is named inside of it still is.
    most = MOST_NAMED * sum(length.values()) if not page.articles else float("inf")
    says = {id(None): NEUTRAL}
    for n in page.names:
        own = NEUTRAL if n.wraps or (n.says == NAMED and held[id(n)] >= most) else n.says
        says[id(n)] = min(own, says[id(n.outer)])
    # Of several articles those whose class names something else are not it; where all do, the longest is.
    longest = max((n for n, _ in page.articles), key=lambda n: length[id(n)], default=None)
    proper = any(not named for _, named in page.articles)
    aside = {id(n) for n, named in page.articles if named and (proper or n is not longest)}

    def weight(node: _Node) -> float:
        named = says[id(node.named)]
        if node.article is not None:
            return ASIDE if id(node.article) in aside else IN_ARTICLE if named == NEUTRAL else named
        return ASIDE if page.articles else named

    return [(node, weight(node), text) for node, text in page.blocks]


def _host(url: str | None) -> str:
    try:
        return (urlsplit(url or "").hostname or "").lower()
    except ValueError:
        return ""


_SIGN = 1 << 63
_TREE = "page_id {id}, url string, blocks array<struct<node:bigint,weight:double,text:string>>, digest bigint, seen array<struct<node:bigint,path:bigint,form:bigint>>"


def _structs(offsets: list[int], **columns: pa.Array) -> pa.Array:
    """A list of structs a page, from the fields of all of them."""
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays(list(columns.values()), list(columns)))


def _long(values: list[int]) -> pa.Array:
    return pa.array(np.array(values, np.uint64).view(np.int64), pa.int64())


def parsed(pages: DataFrame, id_col: str, url_col: str, html_col: str) -> DataFrame:
    """(page_id, url, blocks, digest, seen, uid) for every page.

    A node is the hash of host and path. ``seen`` holds each node of the page
    once, with its presentation; ``digest`` stands for the page's host, paths
    and texts.
    """
    kind = pages.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            block, weights, texts, block_ends = [], [], [], [0]
            nodes, paths, forms, node_ends, digests = [], [], [], [0], []
            for url, html in zip(batch.column("url"), batch.column("html")):
                host, leaves = _hash(_host(url.as_py())), {}
                digest = xxhash.xxh3_64(host.to_bytes(8, "little"))
                for node, weight, text in parse_page(html.as_py()):
                    own = leaves.get(node.path)
                    if own is None:
                        own = leaves[node.path] = (_mixed(host, node.path), set())
                    own[1].add(node.form)
                    block.append(own[0])
                    weights.append(weight)
                    texts.append(text)
                    digest.update(f"{node.path}{text}".encode("utf-8", "replace"))
                for path, (node, own_forms) in leaves.items():
                    nodes.append(node)
                    paths.append(path)
                    forms.append(xxhash.xxh3_64_intdigest(repr(sorted(own_forms))))
                block_ends.append(len(block))
                node_ends.append(len(nodes))
                digests.append(digest.intdigest())
            columns = {
                "page_id": batch.column("page_id"), "url": batch.column("url"), "blocks": _structs(block_ends, node=_long(block), weight=pa.array(weights, pa.float64()), text=pa.array(texts, pa.string())),
                "digest": _long(digests), "seen": _structs(node_ends, node=_long(nodes), path=_long(paths), form=_long(forms)),
            }
            yield pa.RecordBatch.from_pydict(columns)

    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html"))
    return rows.mapInArrow(run, _TREE.format(id=kind)).withColumn("uid", F.monotonically_increasing_id())


def _distinct(tree: DataFrame) -> DataFrame:
    """The pages of which a tree is made: the first one of those that are copies."""
    copies = few_rows(tree.groupBy("digest").agg(F.min("uid").alias("first"), F.count("*").alias("n")).filter("n > 1").select("digest", "first"))
    return tree.join(copies, "digest", "left").filter(F.col("first").isNull() | (F.col("first") == F.col("uid")))


def _importance(sums: DataFrame, by: str) -> DataFrame:
    """(by, importance) of the nodes of a merged tree, from rows (by, kind, n, n_log): sums of c and c log c over features that c pages, or hosts, carry.

    Presentation counts by the entropy of its forms over the pages; a content
    feature found on c of m pages has the normalised entropy log c / log m, and
    contents count by one less the mean over what the pages carry, so that a
    line of constant words around a date or a name is dull. With m pages, what
    they say counts m of m + PRIOR_PAGES times.
    """
    of = lambda kind, column: F.sum(F.when(F.col("kind") == kind, F.col(column)))
    node = sums.groupBy(by).agg(of(contents.FORM, "n").alias("pages"), of(contents.FORM, "n_log").alias("form"), (of(contents.CONTENT, "n_log") / of(contents.CONTENT, "n")).alias("said")).filter("pages > 1")
    log_m = F.log("pages")
    own = PRESENTATION_WEIGHT * (log_m - F.col("form") / F.col("pages")) / log_m + (1 - PRESENTATION_WEIGHT) * (1 - F.least(F.col("said") / log_m, F.lit(1.0)))
    return node.select(by, ((own * F.col("pages") + PRIOR_PAGES) / (F.col("pages") + PRIOR_PAGES)).alias("importance"))


def _judged(sums: DataFrame) -> DataFrame:
    """(node, importance): the lesser one of the host's tree and of all hosts' together, from rows (path, node, kind, n, n_log); the latter's come without node."""
    sums = stored(sums.groupBy("path", "node", "kind").agg(F.sum("n").alias("n"), F.sum("n_log").alias("n_log")))
    host = sums.filter("node IS NOT NULL")
    web = stored(_importance(sums.filter("node IS NULL"), "path").withColumnRenamed("importance", "web"))
    nodes = host.select("node", "path").distinct().join(web, "path", "left")
    out = nodes.join(_importance(host, "node"), "node", "left")
    return out.select("node", F.least(F.coalesce("importance", F.lit(1.0)), F.coalesce("web", F.lit(1.0))).alias("importance"))


def node_importance(seen: DataFrame) -> DataFrame:
    """(node, importance) from rows (node, path, kind, feature), each once per distinct page; in the tree of all hosts, a host counts like a page."""
    host = stored(seen.groupBy("node", "path", "kind", "feature").agg(F.count("*").alias("c")))
    web = host.groupBy("path", "kind", "feature").agg(F.lit(None).cast("bigint").alias("node"), F.count("*").alias("c"))
    return _judged(host.unionByName(web.select(*host.columns)).select("path", "node", "kind", F.col("c").cast("double").alias("n"), (F.col("c") * F.log("c")).alias("n_log")))


def _cleaned(tree: DataFrame, dull: DataFrame | None, shared: dict[int, float], threshold: float) -> DataFrame:
    """(page_id, url, text, n_removed, n_by_tree) from pages with their blocks; dull nodes come as a column ``dull`` or as a shared map."""
    nodes = tree.sparkSession.sparkContext.broadcast(shared)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, removed, by_tree = [], [], []
            for blocks, own in zip(batch.column("blocks").to_pylist(), batch.column("dull").to_pylist()):
                known = nodes.value if own is None else {d["node"]: d["importance"] for d in own}
                rated = [(b["weight"], known.get(b["node"], 1.0), b["text"]) for b in blocks]
                stays = [weight * importance >= threshold for weight, importance, _ in rated]
                doubted = [weight == NAMED and importance >= threshold for weight, importance, _ in rated]
                size = lambda chosen: sum(len(r[2]) for r, c in zip(rated, chosen) if c)  # noqa: E731, B023
                if size(stays) < (1 - MOST_NAMED) * (size(stays) + size(doubted)):  # a name does not overrule the tree on all that a page has
                    stays = [a or b for a, b in zip(stays, doubted)]
                if not any(stays):  # where all that markup allows reads alike, that is all the page has
                    stays = [weight >= NEUTRAL for weight, _, _ in rated]
                kept = [r[2] for r, stay in zip(rated, stays) if stay]
                texts.append(" ".join(kept))
                removed.append(len(rated) - len(kept))
                by_tree.append(sum(i < threshold for _, i, _ in rated) if len(kept) < len(rated) else 0)
            yield pa.RecordBatch.from_pydict({"page_id": batch.column("page_id"), "url": batch.column("url"), "text": pa.array(texts, pa.string()), "n_removed": pa.array(removed, pa.int64()), "n_by_tree": pa.array(by_tree, pa.int64())})

    if dull is None:
        tree = tree.withColumn("dull", F.lit(None).cast("array<struct<node:bigint,importance:double>>"))
    else:
        on_page = tree.select("uid", F.explode("blocks.node").alias("node")).distinct().join(dull, "node")
        on_page = on_page.groupBy("uid").agg(F.collect_list(F.struct("node", "importance")).alias("dull"))
        tree = tree.join(on_page, "uid", "left").withColumn("dull", F.coalesce("dull", F.array().cast("array<struct<node:bigint,importance:double>>")))
    kind = tree.schema["page_id"].dataType.simpleString()
    return tree.select("page_id", "url", "blocks", "dull").mapInArrow(run, f"page_id {kind}, url string, text string, n_removed long, n_by_tree long")


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", threshold: float = IMPORTANCE, most_shared: int = MOST_SHARED) -> DataFrame:
    """One row per page: id, url, text, n_chars, n_removed (blocks that went), n_by_tree (those that the tree alone would remove).

    A block goes where the importance of its node, times the weight of its
    markup, is below ``threshold``. Names of classes, ids and forms never
    overrule the tree on all that a page has: where they alone would take
    MOST_NAMED of the important text, it stays, and a page that would still lose
    every block keeps those that markup does not name. A host with few pages is
    judged mostly by the tree of all hosts, and markup settles what neither tree
    has seen often. At equal importance blocks share their fate; a text of any
    length is one row's work.
    Pages that are copies count once in a host's tree.

    A null or empty html, and a page without text, give an empty text; a null or
    broken url counts as a host without name. Broken markup never fails: what a
    browser takes for a comment or an unfinished tag is dropped. Rows that
    repeat an id are pages each, ids may be null, other columns do not matter,
    and an empty table gives no rows.
    """
    tree = stored(parsed(pages, id_col, url_col, html_col), compression="zstd")
    dull = stored(_judged(contents.sums(_distinct(tree))).filter(F.col("importance") < threshold))
    if dull.limit(most_shared + 1).count() <= most_shared:
        found = dull.toPandas()
        out = _cleaned(tree, None, dict(zip(found["node"].tolist(), found["importance"].tolist())), threshold)
        drop_stored(dull)
    else:
        out = _cleaned(tree, dull, {}, threshold)
    return out.select(F.col("page_id").alias(id_col), F.col("url").alias(url_col), "text", F.length("text").cast("long").alias("n_chars"), "n_removed", "n_by_tree")
