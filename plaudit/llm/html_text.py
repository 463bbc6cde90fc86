"""Main text of web pages by site style trees.

The pages of a host are merged into one style tree: a node is the path of tags and classes from the
root, and beside it stand the contents and the child layouts that pages have there. A block of one
wording is a node of its own below its path, inside articles too. The importance
of a node is the entropy of what its pages show, against the largest that so many pages could show:
menus and footers that repeat from page to page score near 0, articles near 1. Branches of low
importance are cut from each page, as are branches whose tag or class says that they are no article.
Inside an article only branches with a class are cut, and blocks of one wording at its rim or with a class; headings
stay, however many articles share them. A node that few pages have is trusted, so a host with one page falls
back to tags and classes.

Every page is parsed once, in time linear in its length, into a written table of its nodes and of the
blocks of its article. The tree is a table of counts made from that by aggregation; a node's key holds
its host, so the pages of a host never come together in a task.
"""

from __future__ import annotations

import hashlib
import itertools
import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from plaudit.llm import arrays as A
from plaudit.plans.session import durable, ship_package

# A branch is noise when at least so many pages have it and its importance is lower than this.
MIN_PAGES = 8
IMPORTANCE = 0.2

# Fixed values of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe object svg math canvas textarea select".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup html legend li main nav ol p pre section summary table tbody td tfoot th thead "
    "title tr ul hr".split()
)
# Tags that close an open paragraph when they begin.
CLOSES_P = BLOCKS - {"body", "html", "caption", "td", "th", "tr", "tbody", "tfoot", "thead", "title", "legend"}
# Branches that hold no article text, by tag.
NOISE_TAGS = frozenset("head nav footer aside form button dialog menu label input".split()) | RAW
HARD_TAGS = NOISE_TAGS - {"header", "form"}
# Words of a class, id or role that say the same.
NOISE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu "
    "breadcrumb breadcrumbs footer header masthead sidebar side aside widget related recommended share sharing social "
    "cookie cookies consent notice gdpr popup modal overlay newsletter subscribe signup login comment comments "
    "reply replies discussion disqus respond form search pagination pager toolbar skip".split()
)
# Words of a class or id that name the article; a class with such a word alone is never noise.
ARTICLE_WORDS = frozenset("article articlebody content post entry story main prose body text".split())
# Whole class names, ids and roles that mark the article, on a container.
ARTICLE_NAMES = ARTICLE_WORDS - {"text", "body"} | frozenset(
    "article-body article-content article-text entry-content post-content post-body story-body main-content".split()
)
CONTAINERS = frozenset("div section td".split())
# A class that begins so says what a branch has or lacks, not what it is.
MODIFIERS = ("has-", "with-", "no-", "without-", "has_", "with_", "no_", "without_")
# Inside an article these hold its title, not the site's.
TITLE_WORDS = frozenset({"header", "masthead"})
_SPACE = re.compile(r"\s+")
_WORD = re.compile(r"[a-z0-9]+")
ARTICLE = frozenset({"article", "main"})
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
# Low nodes that are broadcast at most, 8 bytes each; with more of them they are joined to the pages' nodes.
BROADCAST_NODES = 2_000_000
# Parts of a large host's nodes that meet the low nodes in tasks of their own, when they are joined.
SALTS = 16
# What a style tree may do with a node: cut it, keep it, keep it and all above it.
CUT, KEEP, ARTICLE_TOP = 0, 1, 2
_MASK = (1 << 64) - 1


def _digest(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode(errors="surrogatepass"), digest_size=8).digest(), "little")


def _joined(digest: int, more: int) -> int:
    """A digest of a sequence, from that of its beginning and its next item."""
    digest = (digest * 0x9E3779B97F4A7C15 + more + 1) & _MASK
    return digest ^ (digest >> 29)


def _signed(digest: int) -> int:
    return digest - (1 << 64) if digest >> 63 else digest


def node_id(host: str, path: tuple[str, ...]) -> int:
    """The key of a node: the labels from the root, on a host."""
    node = _digest(host)
    for label in path:
        node = _joined(node, _digest(label))
    return _signed(node)


class _Open:
    """An open element, with what holds for everything in it."""

    __slots__ = ("tag", "node", "inside", "named", "noise", "digest", "shown", "block")

    def __init__(self, tag: str, node: int, inside: int, named: bool, noise: int, block: bool):
        self.tag, self.node, self.inside, self.named, self.noise, self.block = tag, node, inside, named, noise, block
        self.digest, self.shown = 0, False


class Page(HTMLParser):
    """The blocks and nodes of a page.

    ``blocks`` are (node, noise, in an article, text, heading, with a class), in page order: noise is 1 where only
    a form or a class around the article says so, 2 else; in an article is 1 where a class name marks it,
    2 where a tag does; with a class, if an element inside the article has one. ``nodes`` are (key, parent, kind,
    digest of what the page shows there), parents first. Time is linear in the page: what holds for
    open elements is handed down when one opens, digests are handed up when it closes.
    """

    def __init__(self, host: str = ""):
        super().__init__(convert_charrefs=True)
        self.root = _digest(host)
        self.stack = [_Open("", -1, 0, False, 0, True)]
        self.open_blocks = [0]  # places in the stack
        self.open_tags: Counter[str] = Counter()
        self.blocks: list[tuple[int, int, int, str, bool, bool]] = []
        self.places: dict[tuple[int, str], int] = {}
        self.nodes: list[list[int]] = []  # key, parent, kind, digest, depth, with a class inside an article
        self.parts: list[str] = []
        self.skip = 0

    def _node(self, parent: int, label: str, inside: int, article: int) -> int:
        key = f"{label}!" if article else label
        place = self.places.get((parent, key))
        if place is None:
            place = self.places[parent, key] = len(self.nodes)
            above = self.nodes[parent] if parent >= 0 else [self.root, -1, KEEP, 0, 0, 0]
            depth, classed = above[4] + 1, "." in label
            kind = ARTICLE_TOP if article else CUT if depth >= 3 and (classed or not inside) else KEEP
            self.nodes.append([_joined(above[0], _digest(key)), parent, kind, 0, depth, int(bool(inside) and not article and (classed or above[5]))])
        return place

    def _flush(self) -> None:
        text = _SPACE.sub(" ", "".join(self.parts)).strip()
        self.parts.clear()
        if text:
            top, block = self.stack[-1], self.stack[self.open_blocks[-1]]
            block.digest, block.shown = _joined(block.digest, _digest(text)), True
            heading = block.tag in HEADINGS
            classed = block.node >= 0 and bool(self.nodes[block.node][5])
            self.blocks.append((block.node, top.noise if top.inside else 2 * top.named, top.inside, text, heading, classed))

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in CLOSES_P and self.stack[self.open_blocks[-1]].tag == "p":
            self._pop_to(self.open_blocks[-1])
        if tag in BLOCKS:
            self._flush()
        elif tag == "br":
            self.parts.append(" ")
        if tag in VOID:
            return
        if tag in ("li", "td", "th", "tr", "dd", "dt") and self.open_tags[tag]:
            self._close_sibling(tag)
        above = self.stack[-1]
        inside = above.inside
        noise, label = 0, tag
        hard = tag in HARD_TAGS or (tag == "header" and not inside)
        article = 0
        if attrs or tag in ARTICLE:
            given = dict(attrs)
            names = [c for k in ("class", "id", "role") for c in str(given.get(k) or "").lower().split()]
            classes = [set(_WORD.findall(c)) for c in names]
            words = set().union(*classes)
            hard |= "hidden" in given or "display:none" in str(given.get("style") or "").replace(" ", "").lower()
            named, spared = False, False
            for name, each in zip(names, classes, strict=True):
                if name.startswith(MODIFIERS):
                    continue
                away = NOISE_WORDS - TITLE_WORDS if inside or each & ARTICLE_WORDS else NOISE_WORDS
                named |= bool(each & away)
                spared |= bool(each & ARTICLE_WORDS) and not each & away
            noise = 2 if hard else int(tag == "form" or (named and not spared))
            article = int(tag in CONTAINERS and not noise and bool(ARTICLE_NAMES.intersection(names)))
            if words:
                label = f"{tag}.{'.'.join(sorted(words))}"
        else:
            noise = 2 if hard else int(tag == "form")
        if tag in ("html", "body", "article", "main"):
            noise, article = 0, 2 * (tag in ARTICLE)
        is_block = tag in BLOCKS
        now_inside = max(inside, article)
        node = self._node(self.stack[self.open_blocks[-1]].node, label, now_inside, article) if is_block else above.node
        level = max(above.noise, 2 * bool(noise) if now_inside else noise)
        self.stack.append(_Open(tag, node, now_inside, above.named or bool(noise), level, is_block))
        self.open_tags[tag] += 1
        if is_block:
            self.open_blocks.append(len(self.stack) - 1)
        self.skip += tag in RAW

    def _pop(self) -> None:
        top = self.stack[-1]
        if top.block:
            self._flush()
            self.open_blocks.pop()
            if top.shown:
                node = self.nodes[top.node]
                node[3] = _joined(node[3], top.digest)
                above = self.stack[self.open_blocks[-1]]
                above.digest, above.shown = _joined(_joined(above.digest, node[0]), top.digest), True
        self.skip -= top.tag in RAW
        self.open_tags[top.tag] -= 1
        self.stack.pop()

    def _pop_to(self, place: int) -> None:
        self._flush()
        while len(self.stack) > place:
            self._pop()

    def _close_sibling(self, tag: str) -> None:
        """An open item ends where its next sibling begins, unless a list or table was opened in it."""
        for place in reversed(self.open_blocks[1:]):
            open_tag = self.stack[place].tag
            if open_tag == tag:
                return self._pop_to(place)
            if open_tag in ("ul", "ol", "table", "tr", "dl", "div", "article", "body"):
                return None

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID and self.stack[-1].tag == tag and tag in ("svg", "math", "path"):
            self._pop()

    def handle_endtag(self, tag: str) -> None:
        if self.open_tags[tag]:
            while self.stack[-1].tag != tag:
                self._pop()
            self._pop()

    def handle_data(self, data: str) -> None:
        if not self.skip:
            self.parts.append(data)

    def close(self) -> None:
        super().close()
        self._flush()
        while len(self.stack) > 1:
            self._pop()


def parse(html: str | None, host: str = "") -> Page:
    """The page as blocks and nodes; null is an empty page."""
    page = Page(host)
    page.feed(html or "")
    page.close()
    return page


def article(blocks: list) -> list:
    """The blocks that are the article, so far as tags and classes tell.

    Where a tag marks it, that is the text. Where only a class name does, it has to hold more text
    than all unmarked blocks. What a form or a class encloses is an article if the page has no other
    and less text outside.
    """

    def size(some: list) -> int:
        return sum(len(b[3]) for b in some)

    clean = [b for b in blocks if not b[1]]
    if not any(b[2] for b in clean):
        wrapped = [b for b in blocks if b[1] < 2 and b[2]]
        return wrapped if size(wrapped) > size(clean) else clean
    if any(b[2] == 2 for b in clean):
        return [b for b in clean if b[2]]
    marked = [b for b in clean if b[2]]
    return marked if 2 * size(marked) > size(clean) else clean


def host(url: Column) -> Column:
    """The host in lower case, '' where there is none."""
    return F.lower(F.coalesce(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)", 1), F.lit("")))


PARSED = (
    "page_id long, url string, page long, site long, nodes array<struct<key:long,parent:int,kind:int,shown:long>>, "
    "blocks array<struct<node:int,content:long,heading:boolean,classed:boolean,text:string>>, article long"
)


def parsed_pages(pages: DataFrame) -> DataFrame:
    """Rows of PARSED: the nodes of each page, and the blocks that tags and classes leave of it.

    ``site`` and the nodes are null and empty for pages without a host, which are never judged by repetition.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = TaskContext.get().partitionId() << 40
        for batch in A.blocks(batches, "html"):
            sites, nodes, node_bounds, blocks, block_bounds, articles = [], [], [0], [], [0], []
            for name, html in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist(), strict=True):
                page = parse(html, name)
                kept = article(page.blocks)
                if name:
                    nodes += [(_signed(n[0]), n[1], n[2], _signed(n[3]) if n[3] else None) for n in page.nodes]
                digest = 0
                for node, _, _, text, heading, classed in kept:
                    words = _digest(text)
                    digest = _joined(digest, words)
                    key = page.nodes[node][0] if node >= 0 else page.root
                    blocks.append((node if name else -1, _signed(_joined(key ^ 0x5BF03635, words)), heading, classed, text))
                sites.append(_signed(page.root) if name else None)
                articles.append(_signed(digest) if kept else None)
                node_bounds.append(len(nodes))
                block_bounds.append(len(blocks))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("page_id"), batch.column("url"), pa.array(range(at, at + batch.num_rows), pa.int64()), pa.array(sites, pa.int64()),
                    _structs(nodes, node_bounds, [("key", pa.int64()), ("parent", pa.int32()), ("kind", pa.int32()), ("shown", pa.int64())]),
                    _structs(blocks, block_bounds, [("node", pa.int32()), ("content", pa.int64()), ("heading", pa.bool_()), ("classed", pa.bool_()), ("text", pa.string())]),
                    pa.array(articles, pa.int64()),
                ],
                ["page_id", "url", "page", "site", "nodes", "blocks", "article"],
            )
            at += batch.num_rows

    return pages.select("page_id", "url", "host", "html").mapInArrow(run, PARSED)


def _structs(rows: list[tuple], bounds: list[int], fields: list[tuple]) -> pa.ListArray:
    columns = list(zip(*rows, strict=True)) or [()] * len(fields)
    arrays = [pa.array(column, kind) for column, (_, kind) in zip(columns, fields, strict=True)]
    return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.StructArray.from_arrays(arrays, [name for name, _ in fields]))


def style_tree(parsed: DataFrame) -> DataFrame:
    """site, node, pages, importance: the merged tree of each host.

    Importance is the entropy of a node's contents over the pages that have it, divided by the
    logarithm of their number: 0 where all show the same, 1 where no two do.
    """
    counts = (
        parsed.where("site is not null").select("site", F.explode("nodes").alias("n")).where("n.shown is not null")
        .groupBy("site", F.col("n.key").alias("node"), F.col("n.shown").alias("shown")).agg(F.count(F.lit(1)).alias("n"))
    )
    total = F.sum("n")
    entropy = F.log(total) - F.sum(F.col("n") * F.log("n")) / total
    return counts.groupBy("site", "node").agg(
        total.alias("pages"), (F.when(total > 1, entropy / F.log(total)).otherwise(F.lit(1.0))).alias("importance")
    )


def repeated_blocks(parsed: DataFrame, min_pages: int = MIN_PAGES, importance: float = IMPORTANCE) -> DataFrame:
    """node: blocks of one wording (content nodes) that nearly all articles of a host show.

    Pages with the same article count once, so a copied article is no notice of its host. Headings are never asked for.
    """
    known = parsed.where("site is not null and article is not null")
    # The site itself stands for all its articles.
    contents = F.array_append(F.transform(F.filter("blocks", lambda b: ~b["heading"]), lambda b: b["content"]), F.col("site"))
    found = known.select("site", "article", F.explode(F.array_distinct(contents)).alias("node"))
    counts = durable(
        found.distinct().groupBy("site", "node").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_pages),
        "content-nodes",
    )
    articles = counts.where("node = site").select("site", F.col("n").alias("articles"))
    often = counts.where("node <> site").join(articles, "site")
    return often.where(F.col("n") > (1 - importance) * F.col("articles")).select("node")


def cut_text(nodes: list[dict], blocks: list[dict], low: set[int]) -> str:
    """The text of a page without branches and blocks of low importance.

    An article, what encloses it, and plain tags inside it are kept as branches even if pages repeat them:
    copied articles are text all the same. A repeated block inside an article goes if a class marks it or if
    nothing but such blocks and headings lies between it and the article's beginning or end.
    """
    gone: list[bool] = []
    for n in nodes:  # parents come first
        above = gone[n["parent"]] if n["parent"] >= 0 else False
        gone.append(n["kind"] != ARTICLE_TOP and (above or (n["kind"] == CUT and n["key"] in low)))
    left = [b for b in blocks if b["node"] < 0 or not gone[b["node"]]]
    repeated = [not b["heading"] and b["content"] in low for b in left]
    drop = {k for k, b in enumerate(left) if repeated[k] and b["classed"]}
    for way in (range(len(left)), range(len(left) - 1, -1, -1)):
        for k in way:
            if repeated[k]:
                drop.add(k)
            elif not left[k]["heading"]:
                break
    return "\n".join(b["text"] for k, b in enumerate(left) if k not in drop)


def extract_text(
    pages: DataFrame, min_pages: int = MIN_PAGES, importance: float = IMPORTANCE, id_col: str = "page_id",
    url_col: str = "url", html_col: str = "html", broadcast_nodes: int = BROADCAST_NODES,
) -> DataFrame:
    """One row per page: page_id, url, text.

    Character references are decoded, white space in a block is one blank, blocks are joined by one
    line feed. A null or empty html gives ''; so does a page that is noise throughout. Pages without
    a host form one site of their own, never judged by repetition. Repeated rows count as pages.
    Very long and deeply nested pages take time in proportion to their length. Empty tables and other columns do no harm.
    """
    spark = pages.sparkSession
    ship_package(spark)
    named = pages.select(
        F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"),
        host(F.col(url_col)).alias("host"),
    )
    parsed = durable(parsed_pages(named), "parsed-pages")
    tree = style_tree(parsed).where((F.col("pages") >= min_pages) & (F.col("importance") < importance)).select("node")
    low = durable(tree.unionByName(repeated_blocks(parsed, min_pages, importance)).distinct(), "low-nodes")
    schema = "page_id long, url string, text string"
    names = ["page_id", "url", "text"]
    columns = ["page_id", "url", "nodes", "blocks"]

    def cut(batches: Iterator[pa.RecordBatch], low_of) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [
                cut_text(nodes or [], blocks or [], low)
                for nodes, blocks, low in zip(batch.column("nodes").to_pylist(), batch.column("blocks").to_pylist(), low_of(batch), strict=True)
            ]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string())], names)

    if low.count() <= broadcast_nodes:  # its size is known, and so small that every worker holds it
        found = low.toPandas()["node"].to_numpy(np.int64)
        held = spark.sparkContext.broadcast(frozenset(found.tolist()))
        return parsed.select(*columns).mapInArrow(lambda batches: cut(batches, lambda batch: itertools.repeat(held.value, batch.num_rows)), schema)

    # A node of a large host is asked for by many pages: its pages are dealt to several parts.
    salt = F.pmod(F.col("page"), F.lit(SALTS)).cast("int")
    keys = F.array_distinct(F.concat(F.transform("nodes", lambda n: n["key"]), F.transform("blocks", lambda b: b["content"])))
    asked = parsed.where("site is not null").select("page", salt.alias("salt"), F.explode(keys).alias("node"))
    spread = low.select("node", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    of_page = asked.join(spread, ["node", "salt"], "left_semi").groupBy("page").agg(F.collect_set("node").alias("low"))
    joined = parsed.join(of_page, "page", "left").select(*columns, "low")
    return joined.mapInArrow(lambda batches: cut(batches, lambda batch: [set(x or ()) for x in batch.column("low").to_pylist()]), schema)
