"""Main text of web pages by wrapper induction over the pages of a host."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallygrid.llm.common import by_batch, small_batches, stored

#: A text in one slot of a wrapper is template if so many different pages of the host have it there, and this share of them.
LEAST_PAGES, TEMPLATE_SHARE = 5, 0.6
#: Page structures aligned into one wrapper; a host with more gets several wrappers.
STRUCTURES = 512
#: Wrappers of at most so many slots and texts together are sent to every task; larger ones are joined.
BROADCAST_ENTRIES = 1_000_000

# Element names and conventional class names of the web.
RAW = {"script", "style", "noscript", "template", "textarea", "title", "iframe", "svg", "object", "canvas"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCK = set(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer "
    "form h1 h2 h3 h4 h5 h6 head header hgroup html legend li main menu nav ol optgroup option p pre search section select "
    "summary table tbody td tfoot th thead tr ul".split()
)
CHROME_TAGS = set("aside button dialog fieldset footer form head header menu nav option search select".split())
CHROME_ROLES = set("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search".split())
CHROME_WORDS = set(
    "ad ads adv advert advertisement advertising adsense banner breadcrumb breadcrumbs byline captcha comment comments "
    "consent cookie cookies disqus feedback footer form gdpr header login masthead menu modal nav navbar navigation "
    "newsletter notice overlay pager pagination popup promo promoted recommended related replies reply respond search "
    "share sharing sidebar signup skip social sponsor sponsored subscribe tags toc toolbar topbar widget widgets".split()
)
ENDS_PARAGRAPH = BLOCK - {"body", "html", "head"}
SIBLINGS = {"li": {"ul", "ol", "menu", "dir"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"}}

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)",
    re.S,
)
_ATTRIBUTE = re.compile(r"([^\s=/\"']+)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


class Node:
    """An element of the page, runs of like siblings being one node."""

    __slots__ = ("label", "children", "at")

    def __init__(self, label: str):
        self.label, self.children, self.at = label, [], 0

    def child(self, label: str) -> Node:
        if not self.children or self.children[-1].label != label:
            self.children.append(Node(label))
        return self.children[-1]

    def written(self) -> str:
        parts: list[str] = []
        todo: list[Node | str] = [self]
        while todo:
            x = todo.pop()
            if isinstance(x, str):
                parts.append(x)
                continue
            parts.append(x.label)
            if x.children:
                todo.append(")")
                for i, c in enumerate(reversed(x.children)):
                    todo += ["," if i else "", c]
                parts.append("(")
        return "".join(parts)

    def numbered(self) -> None:
        todo, at = [self], 0
        while todo:
            x = todo.pop()
            x.at, at = at, at + 1
            todo += reversed(x.children)


def _attributes(source: str) -> dict[str, str]:
    found = {}
    for m in _ATTRIBUTE.finditer(source):
        found.setdefault(m[1].lower(), m[2] or m[3] or m[4] or "")
    return found


def _is_chrome(tag: str, own: dict[str, str], in_article: bool) -> bool:
    if tag == "header" and in_article:
        return False
    if tag in CHROME_TAGS or own.get("role", "").lower() in CHROME_ROLES or "hidden" in own or own.get("aria-hidden") == "true":
        return True
    if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", own.get("style", "")):
        return True
    names = f"{own.get('class', '')} {own.get('id', '')}"
    return tag not in ("html", "body", "article", "main") and any(w.lower() in CHROME_WORDS for w in _WORD.findall(names)) or (
        tag == "article" and any(w.lower() in ("comment", "comments", "reply", "related", "promo", "sponsored") for w in _WORD.findall(names))
    )


def parsed(source: str) -> tuple[str, list[tuple[int, int, int, bool, str]]]:
    """The page's structure as text, and its blocks (node, article, holder, chrome, text) in page order.

    ``article`` numbers the article or main element around the block (0: none), ``holder`` the element that holds it.
    Unclosed and stray tags are borne; an end inside a comment or script ends the page.
    """
    root = Node("")
    # tag, node, chrome, article, holder number, number
    stack: list[tuple[str, Node, bool, int, int]] = [("", root, False, 0, 0)]
    blocks: list[tuple[Node, int, int, bool, str]] = []
    words: list[str] = []
    count, at, link = 0, 0, 0
    linked = 0

    def flush() -> None:
        nonlocal words, linked
        text = " ".join("".join(words).split())
        words, seen_links = [], linked
        linked = 0
        if text:
            tag, node, chrome, article, holder = stack[-1]
            all_links = not article and seen_links >= 0.8 * len(text)
            blocks.append((node, article, holder, chrome or all_links, text))

    size = len(source)
    while at < size:
        m = _TOKEN.search(source, at)
        if m is None:
            words.append(html.unescape(source[at:]))
            break
        if m.start() > at:
            text = html.unescape(source[at : m.start()])
            words.append(text)
            linked += len(text) if link else 0
        at = max(m.end(), at + 1)
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if m[1]:
            if tag == "a":
                link = max(0, link - 1)
            if tag in BLOCK:
                flush()
                depth = next((i for i in range(len(stack) - 1, 0, -1) if stack[i][0] == tag), 0)
                if depth:
                    del stack[depth:]
            continue
        if tag in RAW:
            if not m[3].rstrip().endswith("/"):
                end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(source, at)
                at = end.end() if end else size
            words.append(" ")
            continue
        if tag == "br":
            words.append(" ")
        if tag == "a":
            link += 1
        if tag in VOID or tag not in BLOCK:
            continue
        flush()
        if tag in ENDS_PARAGRAPH and stack[-1][0] == "p":
            stack.pop()
        if tag in SIBLINGS:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] in SIBLINGS[tag]:
                    break
                if stack[i][0] == tag or {stack[i][0], tag} in ({"dt", "dd"}, {"td", "th"}):
                    del stack[i:]
                    break
        own = _attributes(m[3]) if m[3].strip() else {}
        _, parent, chrome, article, _ = stack[-1]
        count += 1
        chrome = chrome or _is_chrome(tag, own, bool(article))
        body = tag in ("article", "main") or own.get("role") == "main" or own.get("itemprop") == "articleBody"
        label = ".".join([tag, *sorted(own.get("class", "").split()), *([f"#{own['id']}"] if own.get("id") else [])])
        label = re.sub(r"[(),\d\s]+", "", label)
        inner = count if body and not chrome and (tag != "main" or not article) else article
        holder = count if tag not in ("p", "li", "td", "th", "tr", "tbody", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote", "pre", "ul", "ol") else stack[-1][4]
        stack.append((tag, parent.child(label), chrome, inner, holder))
    flush()
    root.numbered()
    return root.written(), [(node.at, article, holder, chrome, text) for node, article, holder, chrome, text in blocks]


def read_structure(text: str) -> Node:
    """The tree written by :func:`parsed`."""
    root = here = Node("")
    above: list[Node] = []
    name = ""
    for c in text:
        if c in "(,)":
            if name or c == "(":
                here = Node(name) if above else root
                if above:
                    above[-1].children.append(here)
                name = ""
            if c == "(":
                above.append(here)
            elif c == ")":
                here = above.pop()
        else:
            name += c
    root.numbered()
    return root


def _table(a: Node, b: Node, sizes: dict[tuple[int, int], int]) -> list[list[int]]:
    """Sizes of the best matchings of the first i children of ``a`` with the first j of ``b``."""
    best = [[0] * (len(b.children) + 1) for _ in range(len(a.children) + 1)]
    for i, c in enumerate(a.children, 1):
        for j, d in enumerate(b.children, 1):
            n = sizes.get((id(c), id(d)), 0)
            best[i][j] = max(best[i - 1][j], best[i][j - 1], best[i - 1][j - 1] + n if n else 0)
    return best


def matching(a: Node, b: Node) -> tuple[int, list[tuple[Node, Node]]]:
    """Simple tree matching: the largest set of node pairs with equal labels that keeps parents and sibling order.

    Sizes are worked out from the leaves up, the pairs then read from the root down; no recursion, so depth is no limit.
    """
    if a.label != b.label:
        return 0, []
    sizes: dict[tuple[int, int], int] = {}
    todo = [(a, b, False)]
    while todo:
        x, y, ready = todo.pop()
        if ready:
            sizes[id(x), id(y)] = _table(x, y, sizes)[-1][-1] + 1
            continue
        todo.append((x, y, True))
        todo += [(c, d, False) for c in x.children for d in y.children if c.label == d.label]
    pairs, at = [(a, b)], 0
    while at < len(pairs):
        x, y = pairs[at]
        at += 1
        i, j = len(x.children), len(y.children)
        best = _table(x, y, sizes)
        while i and j:
            if best[i][j] == best[i - 1][j]:
                i -= 1
            elif best[i][j] == best[i][j - 1]:
                j -= 1
            else:
                i, j = i - 1, j - 1
                pairs.append((x.children[i], y.children[j]))
    return sizes[id(a), id(b)], pairs


def induced(structures: list[str]) -> list[list[int]]:
    """Aligns page structures into one growing wrapper; for each structure, the wrapper's slot of every node."""
    wrapper, slots, free = Node(""), [], 1
    for text in structures:
        page = read_structure(text)
        meets = {id(p): w for w, p in matching(wrapper, page)[1]}
        own: list[int] = []

        todo = [(page, wrapper)]
        while todo:
            p, w = todo.pop()
            own.append(w.at)
            after, below = 0, []
            for child in p.children:
                met = meets.get(id(child))
                if met is None:
                    met = Node(child.label)
                    met.at, free = free, free + 1
                    w.children.insert(after, met)
                after = next(i for i, c in enumerate(w.children) if c is met) + 1
                below.append((child, met))
            todo += reversed(below)
        slots.append(own)
    return slots


def _chosen(blocks: list[dict], template: set[tuple[int, str]]) -> list[str]:
    """Texts of the main part, in page order.

    All that stand in article or main elements, however many there are; on a page without any, all that is not chrome.
    Template texts go, unless nothing else is there.
    """
    real = [b for b in blocks if not b["chrome"]]
    main = [b for b in real if b["article"]] or real
    fresh = [b for b in main if (b["node"], b["text"]) not in template]
    return [b["text"] for b in fresh or main]


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, url, text, n_chars) for each page.

    Pages of a host are aligned by simple tree matching; a slot whose text is the same on most of them is template, the
    others hold content. Menus, headers, footers, side bars, notices, adverts, forms and comments are told by element,
    role and class name as well, since a page can be the only one of its host. Structures are aligned once each, however
    many pages have them, and pages are counted by Spark, so a host with a third of all pages is no larger task. Null
    html counts as empty and gives an empty text; a null or odd url counts as host ''; repeated pages count once in a
    wrapper and all stay; other columns are not read.
    """
    types = {c: pages.schema[c].dataType.simpleString() for c in (id_col, url_col)}
    block = "node int, article int, holder int, chrome boolean, text string"
    fields = [f.split()[0] for f in block.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for part in small_batches(batch):
                found = [parsed(t or "") for t in part.column(2).to_pylist()]
                yield {
                    id_col: part.column(0),
                    url_col: part.column(1),
                    "structure": [s for s, _ in found],
                    "blocks": [[dict(zip(fields, b, strict=True)) for b in blocks] for _, blocks in found],
                }

    schema = f"`{id_col}` {types[id_col]}, `{url_col}` {types[url_col]}, structure string, "
    schema += f"blocks array<struct<{', '.join(f.replace(' ', ':') for f in block.split(', '))}>>"
    host = F.coalesce(F.lower(F.regexp_extract(F.col(url_col), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@]*@)?([^/:?#]+)", 1)), F.lit(""))
    read = by_batch(pages.select(id_col, url_col, html_col), schema, run).withColumn("host", host)
    read = stored(read.withColumn("s", F.xxhash64("structure")), "pages")

    kinds = read.groupBy("host", "s").agg(F.min("structure").alias("structure"))
    wide = kinds.groupBy("host").agg(F.ceil(F.count("*") / STRUCTURES).alias("wrappers"))
    kinds = kinds.join(wide, "host").withColumn("wrapper", F.pmod("s", "wrappers"))

    def align(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["structure", "s"])
        return pd.DataFrame({"host": group["host"], "s": group["s"], "wrapper": group["wrapper"], "slots": induced(group["structure"].tolist())})

    aligned = stored(
        kinds.groupBy("host", "wrapper").applyInPandas(align, "host string, s long, wrapper long, slots array<int>"), "slots"
    )
    hashed = F.array_distinct(F.transform("blocks", lambda b: F.struct(b["node"].alias("node"), F.xxhash64(b["text"]).alias("h"))))
    texts = read.select("host", "s", F.xxhash64(F.col("blocks.text")).alias("page"), hashed.alias("hashed"))
    texts = texts.groupBy("host", "s", "page").agg(F.any_value("hashed").alias("hashed"))
    texts = texts.select("host", "s", F.explode("hashed").alias("b"))
    slot = F.col("slots")[F.col("b.node")].alias("slot")
    counts = texts.groupBy("host", "s", "b").agg(F.count("*").alias("n"))
    by_text = counts.join(aligned, ["host", "s"]).groupBy("host", "wrapper", slot, F.col("b.h").alias("h")).agg(F.sum("n").alias("n"))
    pages_of = read.select("host", "s", F.xxhash64(F.col("blocks.text")).alias("page"), F.array_distinct("blocks.node").alias("nodes"))
    pages_of = pages_of.groupBy("host", "s", "nodes", "page").agg(F.lit(1).alias("one")).groupBy("host", "s", "nodes").agg(F.count("*").alias("n"))
    by_slot = pages_of.select("host", "s", F.explode("nodes").alias("node"), "n").join(aligned, ["host", "s"])
    by_slot = by_slot.groupBy("host", "wrapper", F.col("slots")[F.col("node")].alias("slot")).agg(F.sum("n").alias("pages"))
    fixed = by_text.join(by_slot, ["host", "wrapper", "slot"])
    fixed = fixed.where((F.col("n") >= LEAST_PAGES) & (F.col("n") >= TEMPLATE_SHARE * F.col("pages")))
    # few: a slot has at most one text with more than half of its pages
    fixed = fixed.groupBy("host", "wrapper").agg(F.collect_set(F.struct("slot", "h")).alias("fixed"))
    template = aligned.join(fixed, ["host", "wrapper"]).select("host", "s", "slots", "fixed")
    template = stored(template, "template")
    entries = template.agg(F.sum(F.size("slots") + F.size("fixed") + 4)).first()[0] or 0
    if entries <= BROADCAST_ENTRIES:
        template = F.broadcast(template)
    marked = read.join(template, ["host", "s"], "left").withColumn(
        "blocks",
        F.transform(
            "blocks",
            lambda b: b.withField(
                "fixed",
                F.coalesce(
                    F.array_contains(
                        F.col("fixed"), F.struct(F.col("slots")[b["node"]].alias("slot"), F.xxhash64(b["text"]).alias("h"))
                    ),
                    F.lit(False),
                ),
            ),
        ),
    )

    def choose(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for part in small_batches(batch):
                texts = []
                for blocks in part.column(2).to_pylist():
                    template = {(b["node"], b["text"]) for b in blocks if b["fixed"]}
                    texts.append("\n".join(_chosen(blocks, template)))
                yield {id_col: part.column(0), url_col: part.column(1), "text": texts, "n_chars": [len(t) for t in texts]}

    schema = f"`{id_col}` {types[id_col]}, `{url_col}` {types[url_col]}, text string, n_chars long"
    return by_batch(marked.select(id_col, url_col, "blocks"), schema, choose)
