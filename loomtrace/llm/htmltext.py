"""Main text of pages by a site style tree.

The DOMs of a host's pages are merged by style path (tags and classes from the root down).  Two entropies over the
host's distinct pages say how important a style node is by itself: that of its presentations (the child sequences seen)
and that of its contents (a block seen on k of m pages has entropy log_m k; important nodes hold blocks of few pages).
On a page, a node without elements below it is as important as its contents, every other one by its presentations and,
the fewer children it has the more, by the mean importance of these.  A branch is noise when it and every branch
below it are of low importance; such branches are cut whole, as are those whose tag or role is never article text.  What
is left of the article, or of the body where none is marked, is the text.  Class and id words are weaker: a branch they
name is kept after all where it holds the page's only article, or important text that is most of the page's.

Parsing and cutting take time in proportion to the page, nested or malformed as it may be.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from urllib.parse import urlsplit

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from .common import cut, fits_broadcast, free_name, in_batches

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>\x00]*)", re.S)
#: The rest of a tag: with values in quotes, and for pages whose quotes don't pair up.
REST, PLAIN_REST = re.compile(r"""((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>"""), re.compile(r"([^>]*+)>")
ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""")
RAW = {"script", "style", "noscript", "template", "iframe", "textarea", "title", "xmp", "noembed", "noframes"}
RAW_END = {t: re.compile(rf"</{t}(?=[\s/>])[^>]*(?:>|\Z)", re.I) for t in RAW}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "label", "mark", "q", "ruby", "rt", "rp", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"}
CLOSES_P = {"address", "article", "aside", "blockquote", "details", "div", "dl", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "menu", "nav", "ol", "p", "pre", "section", "table", "ul"}
CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "thead": {"tr", "td", "th"}, "tbody": {"thead", "tr", "td", "th"}, "tfoot": {"tbody", "tr", "td", "th"}}
SCOPE = {"ul", "ol", "dl", "table", "div", "article", "section", "main", "body", "html", "nav", "aside", "footer", "header", "form", "blockquote", "td", "th"}
#: Tags, roles and class or id words that name something other than article text.
NOISE_TAGS = {"nav", "header", "footer", "aside", "form", "menu", "button", "select", "input", "dialog", "svg", "canvas", "audio", "video", "object", "embed", "map", "head", *RAW}
NOISE_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "alertdialog", "menu", "menubar", "toolbar", "form"}
NOISE_WORDS = set("ad ads advert adverts advertisement advertisements advertising adsense adbox banner breadcrumb breadcrumbs comment comments commentlist cookie cookies consent copyright disclaimer discussion disqus footer gdpr header login masthead menu modal nav navbar navigation newsletter notice notices overlay pager pagination popup promo promotion related replies reply respond share sharing sidebar signup skip social sponsor sponsored subscribe subscription toolbar topbar widget widgets".split())
MAIN_TAGS = {"article", "main"}
#: Words of NOISE_WORDS for matter beside an article, even where that matter is marked as an article itself.
BESIDE = set("ad ads advert adverts advertisement advertisements advertising adsense adbox comment comments commentlist cookie cookies consent discussion disqus gdpr promo promotion related replies reply respond sponsor sponsored".split())
#: What makes an element noise: a word, a word of BESIDE, or its tag, role or style, which nothing overrules.
NAMED, ASIDE, HARD = 1, 2, 3
#: A branch below this importance, on a host with this many distinct pages at least, is noise; weight of children.
LEAST, PAGES, CHILDREN = 0.2, 8, 0.9
#: Style nodes of low importance that are sent to every task at most; beyond it, each page is joined with its own.
BROADCAST_PATHS = 500_000


class Node:
    __slots__ = ("children", "main", "noise", "path", "tag")

    def __init__(self, tag: str, path: int, noise: int, main: bool):
        self.tag, self.path, self.noise, self.main = tag, path, noise, main
        self.children: list[Node | str] = []


def _element(parent: Node, tag: str, raw: str) -> Node:
    attributes = {}
    if raw.strip():
        for k, v in ATTRIBUTE.findall(raw):
            attributes.setdefault(k.lower(), html.unescape(v.strip("\"'")))
    style = f"{attributes.get('class', '')} {attributes.get('id', '')}".lower()
    named = set(re.split(r"[^a-z]+", style)) & NOISE_WORDS if style != " " else ()
    hard = bool(tag in NOISE_TAGS or attributes.get("role", "").lower() in NOISE_ROLES or "hidden" in attributes or attributes.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none", attributes.get("style", "")))
    noise = HARD if hard else 0 if not named else ASIDE if named & BESIDE else NAMED
    if tag in ("body", "html") or (tag in MAIN_TAGS and not named & {"comment", "comments", "reply", "related", "ad", "ads", "promo", "sponsored"} if named else tag in MAIN_TAGS):
        noise = 0
    if tag == "header" and parent.main and not named:
        noise = 0  # an article's own heading
    # numbers in an id tell elements of a page apart, in a class they tell styles apart
    words_ = "" if style == " " else "." + ".".join(sorted([*attributes.get("class", "").lower().split(), *re.split(r"[^a-z]+", attributes.get("id", "").lower())]))
    return Node(tag, _hash(f"{parent.path}/{tag}{words_}"), noise, parent.main or (tag in MAIN_TAGS and not noise))


def parse(page: str) -> Node:
    """A DOM, with the end tags that authors leave out; anything that isn't markup is text."""
    root = Node("#", 0, 0, False)
    stack, at, quotes = [root], 0, True
    open_ = Counter()

    def leave(k: int) -> None:
        for x in stack[k:]:
            open_[x.tag] -= 1
        del stack[k:]

    while (m := TOKEN.search(page, at)) is not None:
        if m.start() > at:
            stack[-1].children.append(page[at : m.start()])
        at = m.end()
        if m[2] is None:
            if m[0].startswith("<![CDATA["):
                stack[-1].children.append(html.escape(m[0][9:-3]))
            continue
        rest = REST.match(page, at) if quotes else None
        if rest is None:
            # from the first tag on whose quotes run to the end of the page, quotes say nothing
            quotes, rest = False, PLAIN_REST.match(page, at)
            if rest is None:
                at = m.start()
                break
        at, tag = rest.end(), m[2].lower()
        if m[1]:
            if open_[tag] > 0:
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k].tag == tag:
                        leave(k)
                        break
                    if tag in INLINE and stack[k].tag not in INLINE and stack[k].tag != "p":
                        break
            continue
        if tag in CLOSES_P and open_["p"] > 0:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == "p":
                    leave(k)
                    break
                if stack[k].tag in SCOPE:
                    break
        if tag in CLOSED_BY and any(open_[x] > 0 for x in CLOSED_BY[tag]):
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag in CLOSED_BY[tag]:
                    leave(k)
                    if tag not in ("tr", "tbody", "tfoot", "thead"):
                        break
                elif stack[k].tag in SCOPE and not (tag in ("tr", "tbody", "tfoot", "thead") and stack[k].tag in ("td", "th")):
                    break
        closed = rest[1].endswith("/")
        node = _element(stack[-1], tag, rest[1].removesuffix("/"))
        stack[-1].children.append(node)
        if tag in RAW:
            end = RAW_END[tag].search(page, at)
            at = end.end() if end else len(page)
        elif tag not in VOID and not (closed and tag not in INLINE | CLOSES_P):
            stack.append(node)
            open_[tag] += 1
    if at < len(page):
        stack[-1].children.append(page[at:])
    return root


def blocks(root: Node) -> list[tuple[Node, tuple[Node, ...], str]]:
    """Text blocks in page order as (innermost block element, elements above it that words name as noise, text with
    markup decoded); none below an element that is noise by its tag, role or style."""
    out: list[tuple[Node, tuple[Node, ...], str]] = []
    held: list[str] = []
    owner: list = [root, ()]

    def flush(node: Node, named: tuple[Node, ...] | None) -> None:
        if held and owner[1] is not None and (text := " ".join(html.unescape("".join(held)).split())):
            out.append((owner[0], owner[1], text))
        held.clear()
        owner[:] = node, named

    todo: list[tuple] = [(root, (), 0, root)]
    while todo:
        node, named, k, block = todo.pop()
        if k < len(node.children):
            todo.append((node, named, k + 1, block))
            child = node.children[k]
            if isinstance(child, str):
                held.append(child)
            elif child.tag == "br":
                held.append("\n")
            elif child.tag in INLINE and not child.noise:
                todo.append((child, named, 0, block))
            else:
                below = None if named is None or child.noise == HARD else (*named, child) if child.noise else named
                flush(child, below)
                todo.append((child, below, 0, child))
        elif node is block and todo:
            above = todo[-1]
            flush(above[3], above[1])
    flush(root, ())
    return out


def host_of(url: str | None) -> str:
    try:
        return (urlsplit(url or "").hostname or "").lower()
    except ValueError:
        return ""


def _hash(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text) - (1 << 63)


def _styles(node: Node) -> Iterator[tuple[int, str]]:
    todo = [node]
    while todo:
        x = todo.pop()
        kids = [c for c in x.children if isinstance(c, Node)]
        yield x.path, " ".join(dict.fromkeys(c.tag for c in kids))
        todo += kids


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What each distinct page of a batch adds to its host's tree.  kind 0 is a presentation, 1 a content."""
    for batch in batches:
        pages = {(host_of(u), p) for u, p in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) if p}
        hosts: list[str] = []
        rows: list[tuple[int, int, int, int]] = []
        for host, page in pages:
            root, whole = parse(page), _hash(page)
            mine = {(path, 0, _hash(style), whole) for path, style in _styles(root)}
            mine |= {(node.path, 1, _hash(text), whole) for node, _, text in blocks(root)}
            hosts += [host] * len(mine)
            rows += mine
        yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), *(pa.array([x[i] for x in rows], pa.int64()) for i in range(4))], ["host", "path", "kind", "feature", "page"])


def site_style_tree(pages: DataFrame, *, url: str = "url", html_: str = "html") -> DataFrame:
    """``host, path, presentation, content, pages`` of every style node, m being the pages that have it.

    Content importance is 1 minus the mean, over the node's distinct contents, of log_m of the pages with that content,
    and 0 without any; presentation importance is the entropy, base m, of its child sequences, and 1 on a single page.
    Copies of a page on one host, told apart by a hash of the html, are one page.
    """
    return _importance(_features(pages, url, html_))


def _features(pages: DataFrame, url: str, html_: str) -> DataFrame:
    """``host, path, kind, feature, page``: what each page shows at each style node."""
    return in_batches(pages.select(F.col(url).alias("u"), F.col(html_).alias("h")), _merge, "host string, path bigint, kind bigint, feature bigint, page bigint", rows=512)


def _importance(features: DataFrame) -> DataFrame:
    counts = features.groupBy("host", "path", "kind", "feature").agg(F.countDistinct("page").alias("k"))
    k, style = F.col("k"), F.col("kind") == 0
    sums = counts.groupBy("host", "path").agg(F.sum(F.when(style, k)).alias("m"), F.sum(F.when(style, k * F.ln(k))).alias("style"), F.count(F.when(~style, k)).alias("n"), F.sum(F.when(~style, F.ln(k))).alias("content"))
    m = F.greatest(F.coalesce("m", F.lit(1)), F.lit(2))
    content = F.when(F.coalesce("n", F.lit(0)) > 0, 1 - F.col("content") / F.col("n") / F.ln(m)).otherwise(0.0)
    shown = F.when(F.col("m") > 1, (F.ln("m") - F.col("style") / F.col("m")) / F.ln("m")).otherwise(1.0)
    return sums.select("host", "path", shown.alias("presentation"), content.alias("content"), F.coalesce("m", F.lit(0)).alias("pages"))


def _kept(found: list[tuple[Node, tuple[Node, ...], str]], important: list[bool]) -> list[bool]:
    """Which blocks of a page are text, where class and id words alone decide only what nothing else does.

    Without an article of its own, a page has those below merely named wrappers.  In the article, or in the page where
    none is marked, a named branch is main text if its important text exceeds all else that is kept.
    """
    freed: set[Node] = set()
    pool = [node.main and all(x.main or x.noise == NAMED for x in named) for node, named, _ in found]
    if not any(p and not named for p, (_, named, _) in zip(pool, found, strict=True)):
        freed = {x for p, (_, named, _) in zip(pool, found, strict=True) if p for x in named if not x.main}
    if not any(pool):
        pool = [True] * len(found)
    while True:
        free = [p and freed.issuperset(named) for p, (_, named, _) in zip(pool, found, strict=True)]
        kept, branches = 0, {}
        for p, (_, named, text), weighs in zip(pool, found, important, strict=True):
            closed = [x for x in named if x not in freed]
            if not p or not weighs:
                continue
            if not closed:
                kept += len(text)
            elif all(x.noise == NAMED for x in closed) or not any(free):
                branches[closed[0]] = branches.get(closed[0], 0) + len(text)
        best = max(branches, key=branches.get, default=None)
        if best is None or branches[best] <= kept:
            return free
        freed.add(best)


def noise_of(root: Node, tree: dict[int, tuple[float, float]]) -> set[Node]:
    """The nodes of a page that lie in branches of low importance.  ``tree`` has the presentation and content importance
    of the host's style nodes of which one at least is low; all others count as important."""
    order, todo = [], [root]
    while todo:
        node = todo.pop()
        order.append(node)
        todo += [x for x in node.children if isinstance(x, Node)]
    own: dict[Node, float] = {}
    most: dict[Node, float] = {}
    for node in reversed(order):
        shown, content = tree.get(node.path, (1.0, 1.0))
        below = [x for x in node.children if isinstance(x, Node)]
        # inline elements are part of their block's contents
        blocks_ = [x for x in below if x.tag not in INLINE and x.tag not in VOID]
        if blocks_:
            weight = CHILDREN ** len(blocks_)
            own[node] = (1 - weight) * shown + weight * sum(own[x] for x in blocks_) / len(blocks_)
            if any(isinstance(x, str) and not x.isspace() for x in node.children):
                own[node] = max(own[node], content)
        else:
            own[node] = content
        most[node] = max([own[node], *(most[x] for x in blocks_)])
    out: set[Node] = set()
    for node in order:
        if most[node] < LEAST or node in out:
            out.add(node)
            out.update(x for x in node.children if isinstance(x, Node))
    return out


def text_of(page: str, tree: dict[int, tuple[float, float]]) -> str:
    """The main text of a page on a host with the style nodes ``tree``, see ``noise_of``."""
    root = parse(page)
    found = blocks(root)
    cut_off = noise_of(root, tree) if tree else set()
    important = [node not in cut_off for node, _, _ in found]
    chosen = [(node, text, weighs) for (node, _, text), weighs, kept in zip(found, important, _kept(found, important), strict=True) if kept]
    if any(node.main for node, _, _ in chosen):
        chosen = [x for x in chosen if x[0].main]
    left = [text for _, text, weighs in chosen if weighs]
    return " ".join(left or [text for _, text, _ in chosen])


def extract(pages: DataFrame, *, url: str = "url", html_: str = "html") -> tuple[DataFrame, str]:
    """The pages with one struct column added, and its name: ``text`` (empty if none).

    Null and empty html give an empty text.  Pages without a host share the host ''.  A branch is only cut where
    something of the page is left.  Rows are kept, repeated ones too; other columns pass through whatever their names.
    """
    features = _features(pages, url, html_)
    low = cut(_importance(features).where((F.least("presentation", "content") < LEAST) & (F.col("pages") >= PAGES)).select("host", "path", "presentation", "content"))
    name = free_name(pages, "main")
    at_url, at_html = pages.columns.index(url), pages.columns.index(html_)
    schema = StructType([*pages.schema.fields, StructField(name, StructType([StructField("text", StringType())]))])
    if fits_broadcast(low, 64, 64 * BROADCAST_PATHS):
        tree: dict[str, dict[int, tuple[float, float]]] = {}
        for r in low.toLocalIterator():
            tree.setdefault(r.host, {})[r.path] = (r.presentation, r.content)
        shared = pages.sparkSession.sparkContext.broadcast(tree)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                out = [text_of(p, shared.value.get(host_of(u), {})) if p else "" for u, p in zip(batch.column(at_url).to_pylist(), batch.column(at_html).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.StructArray.from_arrays([pa.array(out, pa.string())], ["text"])], [*batch.schema.names, name])

        return in_batches(pages, run, schema, rows=512), name

    # too many for every task: each distinct page gets those of its own style nodes
    own = features.select("host", "path", "page").distinct().join(low, ["host", "path"]).groupBy("host", "page").agg(F.collect_list(F.struct("path", "presentation", "content")).alias("tree"))
    host, page = free_name(pages, "host"), free_name(pages, "page")

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            urls, htmls = batch.column(at_url).to_pylist(), batch.column(at_html).to_pylist()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([host_of(u) for u in urls], pa.string()), pa.array([_hash(h or "") for h in htmls], pa.int64())], [*batch.schema.names, host, page])

    keyed = in_batches(pages, keys, StructType([*pages.schema.fields, StructField(host, StringType()), StructField(page, LongType())]), rows=512)
    branches = free_name(keyed, "tree")
    joined = keyed.join(own.withColumnsRenamed({"host": host, "page": page, "tree": branches}), [host, page], "left").select(*(F.col(f"`{c}`") for c in pages.columns), branches)

    def cut_pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [text_of(p, {x["path"]: (x["presentation"], x["content"]) for x in n or ()}) if p else "" for p, n in zip(batch.column(at_html).to_pylist(), batch.column(len(batch.columns) - 1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.StructArray.from_arrays([pa.array(out, pa.string())], ["text"])], [*batch.schema.names[:-1], name])

    return in_batches(joined, cut_pages, schema, rows=512), name
