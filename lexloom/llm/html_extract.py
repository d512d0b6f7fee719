"""Main-text extraction by site style trees (Yi, Liu and Li, "Eliminating Noisy Information in Web
Pages for Data Mining", 2003).

The DOMs of a host's pages are merged: an element of the merged tree is a path of (style, position),
a style being the sequence of an element's children. An element that m pages share has
  presentation importance: the entropy (base m) of its styles among these pages;
  content importance, for text: one minus the mean entropy (base m) of its sentences over pages, so
  that a sentence that every page repeats counts nothing and one of a single page counts fully;
and composite importance from its own and its children's. An element is noise if it and all below it
are of low importance; such branches are removed from each page, the rest is its text. What
only one page has is important by definition.

Pages are never gathered by host: each emits hashes of its own elements, which are counted by element;
only elements that several pages share are gathered to compute composite importance.
"""

from __future__ import annotations

import html as _html
import re
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.llm import _common as c

#: Production parameters: importance below which a branch is removed; damping of deeper importance.
THRESHOLD, GAMMA = 0.7, 0.9
#: Bytes of removed-branch keys up to which they are broadcast to the pages; beyond, pages are shuffled by host.
BROADCAST_BYTES = 32 << 20
_TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)"""
    r"""|<(?P<raw>script|style|noscript|template|textarea)(?![a-zA-Z0-9])(?:[^>"']++|"[^"]*+"|'[^']*+'|["'])*+>.*?(?:</(?P=raw)\b[^>]*>|\Z)"""
    r"""|<(/?)([a-zA-Z][a-zA-Z0-9]*)((?:[^>"']++|"[^"]*+"|'[^']*+'|["'])*+)>|[^<]++|<""",
    re.S | re.I,
)
_CLASS = re.compile(r"""(?i)(?<![\w-])(class|id)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""")
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_CLOSES = {"p": frozenset(["p"]), "li": frozenset(["li"]), "tr": frozenset(["tr", "td", "th"]), "td": frozenset(["td", "th"]), "th": frozenset(["td", "th"]), "option": frozenset(["option"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"])}
_SCOPE = frozenset("table ul ol dl div article section nav body footer header main aside td th".split())
_BLOCK = frozenset("p div article section nav footer header main aside h1 h2 h3 h4 h5 h6 li ul ol dl dt dd table tr blockquote pre figure figcaption form body html title head".split())
_M = 0xFFFFFFFFFFFFFFFF


class Node:
    __slots__ = ("tag", "name", "children", "text", "key", "style", "up")

    def __init__(self, tag: str, name: str, text: str | None = None):
        self.tag, self.name, self.text, self.children, self.up = tag, name, text, [], 0


def _tag(name: str, attrs: str) -> tuple[str, str, bool]:
    """(tag with its classes, name, whether it stays open) of a start tag."""
    name = name.lower()
    tag = name
    if "=" in attrs and name not in _VOID:
        tag += "".join(f".{v.strip(chr(34) + chr(39))}" for _, v in _CLASS.findall(attrs))
    return tag, name, name not in _VOID and not attrs.endswith("/")


def parse(source: str, seen: dict[str, tuple[str, str, bool]] | None = None) -> Node:
    """A lenient tree. Comments, declarations, scripts and styles are left out; p, li, table cells and
    the like close their open siblings; a stray end tag is ignored; what is open at the end is closed.
    ``seen`` keeps start tags from page to page."""
    seen = {} if seen is None else seen
    root = Node("#root", "#root")
    stack = [root]
    for m in _TOKEN.finditer(source):
        s = m.group()
        if s[0] != "<" or s == "<":
            s = (_html.unescape(s) if "&" in s else s).strip()
            if s:
                stack[-1].children.append(Node("#text", "#text", s))
            continue
        last = m.lastindex
        if last is None or m.group("raw"):
            continue
        if m.group(2):
            name = m.group(3).lower()
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].name == name:
                    del stack[k:]
                    break
            continue
        kind = seen.get(s)
        if kind is None:
            if len(seen) > 20_000:
                seen.clear()
            kind = seen[s] = _tag(m.group(3), m.group(4))
        tag, name, stays = kind
        closes = _CLOSES.get(name)
        if closes:
            for k in range(len(stack) - 1, 0, -1):
                other = stack[k].name
                if other in closes:
                    del stack[k:]
                    break
                if other in _SCOPE:
                    break
        node = Node(tag, name)
        stack[-1].children.append(node)
        if stays:
            stack.append(node)
    return root


def _hash(*parts: int) -> int:
    h = 0xCBF29CE484222325
    for p in parts:
        h = ((h ^ p) * 0x9E3779B97F4A7C15) & _M
        h ^= h >> 29
    return h


def label(root: Node, host: int) -> list[Node]:
    """Give every node its key in the host's merged tree, its parent's key and its style; parents come first."""
    root.key = _hash(host, 1)
    out, todo = [], [root]
    while todo:
        e = todo.pop()
        out.append(e)
        children = e.children
        if not children:
            e.style = 0
            continue
        e.style = crc32(" ".join([x.tag for x in children]).encode())
        inner = _hash(e.key, e.style)
        # _hash(inner, place) with its first step taken once
        first = ((0xCBF29CE484222325 ^ inner) * 0x9E3779B97F4A7C15) & _M
        first ^= first >> 29
        key = e.key
        for i, x in enumerate(children, 2):
            h = ((first ^ i) * 0x9E3779B97F4A7C15) & _M
            x.key = h ^ (h >> 29)
            x.up = key
        todo.extend(reversed(children))
    return out


def sentences(text: str) -> set[int]:
    """Hashes of what stands between full stops, exclamation and question marks and line ends."""
    parts = text.lower().replace("\n", ".").replace("!", ".").replace("?", ".").split(".")
    return {crc32(s.encode()) for s in map(str.strip, parts) if s}


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _stat_batches(batches):
    """Rows (host, key, parent, style, tag is text, value, pages) counted within the batch."""
    for batch in batches:
        nodes, feats, seen = {}, {}, {}
        for host, source, w in zip(batch.column("hkey").to_pylist(), batch.column("html").to_pylist(), batch.column("w").to_pylist()):
            if w == 0:
                continue
            for e in label(parse(source, seen), host & _M):
                k = (host, e.key, e.up, e.style)
                nodes[k] = nodes.get(k, 0) + w
                if e.text is not None:
                    for f in sentences(e.text):
                        feats[e.key, f] = feats.get((e.key, f), 0) + w
        rows = [(_signed(k), h, _signed(p), s, n) for (h, k, p, s), n in nodes.items()] + [(_signed(k), None, None, f, n) for (k, f), n in feats.items()]
        cols = list(zip(*rows)) if rows else [[]] * 5
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64()))], ["key", "host", "parent", "value", "n"])


def composite(nodes: pd.DataFrame, threshold: float = THRESHOLD) -> pd.DataFrame:
    """(key, parent, importance, noise) of the shared elements of one host. ``nodes`` has a row for each element and
    style: key, parent, pages, content (NULL but for text), style, count. Children are found by
    their keys, which follow from the parent's key, its style and the position."""
    pages = dict(zip(nodes["key"], nodes["pages"]))
    parent = dict(zip(nodes["key"], nodes["parent"]))
    content = {k: x for k, x in zip(nodes["key"], nodes["content"]) if x == x and x is not None}
    styles: dict[int, dict[int, int]] = {}
    for k, s, n in zip(nodes["key"], nodes["style"], nodes["count"]):
        styles.setdefault(k, {})[s] = n
    value: dict[int, float] = {}
    roots = [k for k, p in parent.items() if p not in pages]
    order, todo = [], list(roots)
    children: dict[int, list[tuple[int, int]]] = {}
    below: dict[int, list[int]] = {}
    for k, p in parent.items():
        below.setdefault(p, []).append(k)
    for p, ks in below.items():
        if p not in styles:
            continue
        want = set(ks)
        for s, n in styles[p].items():
            if n < 2:
                continue
            inner, i = _hash(p & _M, s), 0
            while True:
                k = _signed(_hash(inner, i + 2))
                if k not in want:
                    break
                children.setdefault(p, []).append((s, k))
                i += 1
    while todo:
        e = todo.pop()
        order.append(e)
        todo.extend(k for _, k in children.get(e, []))
    noise: dict[int, bool] = {}
    for e in reversed(order):
        m = pages[e]
        if e in content:
            value[e] = content[e]
            noise[e] = value[e] < threshold
            continue
        mine = styles[e]
        own = -sum(n / m * np.log(n / m) for n in mine.values()) / np.log(m)
        if list(mine) == [0]:
            value[e], noise[e] = 0.0, True  # no children: nothing to keep
            continue
        kids: dict[int, list[float]] = {}
        for s, k in children.get(e, []):
            kids.setdefault(s, []).append(value[k])
        deep = sum(n / m * (float(np.mean(kids[s])) if s in kids else (1.0 if s else 0.0)) for s, n in mine.items())
        g = GAMMA ** len(mine)
        value[e] = (1 - g) * own + g * deep
        noise[e] = value[e] < threshold and all(s in kids or not s for s in mine) and all(noise[k] for _, k in children.get(e, []))
    return pd.DataFrame({"key": list(value), "parent": [parent[k] for k in value], "importance": list(value.values()), "noise": [noise[k] for k in value]})


def _host_columns(pages: DataFrame) -> DataFrame:
    """(page_id, host, hkey, html, url); a page whose URL has no host is a site of its own."""
    host = F.lower(F.regexp_extract(F.coalesce(pages["url"].cast("string"), F.lit("")), r"^\s*(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]+)", 1))
    html = F.coalesce(pages["html"].cast("string"), F.lit(""))
    return pages.select(pages["page_id"].cast("bigint").alias("page_id"), F.when(host != "", host).alias("host"), F.when(host != "", F.xxhash64(host)).otherwise(F.xxhash64(F.lit("page"), pages["page_id"].cast("string"), html)).alias("hkey"), html.alias("html"), pages["url"].cast("string").alias("url"))


def _weighted(spark: SparkSession, sites: DataFrame) -> DataFrame:
    """(hkey, html, w) of ``sites``: w is 1, but where several pages of a host have the same visible text (white space aside) it is so for one
    of them only, that of the least hash, and 0 for the others; w is shared among repeats of that row. So copies
    say nothing about the site, and no page is shuffled to find that out unless most have copies."""
    mark = r"(?s)<(?:(?=[sSnNtT!])(?:!--.*?(?:-->|\z)|(?i:(script|style|noscript|template|textarea))\b[^>]*+>.*?(?:</(?i:\1)\b[^>]*+>|\z))|[^>]*+>)"
    text = F.regexp_replace("html", mark, "")
    for space in " \n\t\r":
        text = F.replace(text, F.lit(space), F.lit(""))
    seen = F.xxhash64("hkey", text)
    rows = sites.select("hkey", "html", seen.alias("seen"), F.xxhash64("page_id", "url", "html").alias("row"))
    each = rows.groupBy("seen", "row").agg(F.count("*").alias("m"))
    copied = each.groupBy("seen").agg(F.min(F.struct("row", "m")).alias("first"), F.sum("m").alias("all")).where("`all` > 1")
    copied = c.materialize(spark, copied.select(F.col("seen").alias("__lx_s"), F.col("first.row").alias("__lx_r"), F.col("first.m").alias("__lx_m")))
    side = F.broadcast(copied) if copied.count() <= c.BROADCAST_IDS else copied
    w = F.when(F.isnull("__lx_s"), 1.0).when(F.col("row") == F.col("__lx_r"), 1.0 / F.col("__lx_m")).otherwise(0.0)
    return rows.join(side, F.col("seen") == F.col("__lx_s"), "left").select("hkey", "html", w.alias("w"))


def importance(spark: SparkSession, sites: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(host, key, parent, importance, noise) of the elements that two or more pages of a host share."""
    stats = _weighted(spark, sites).mapInArrow(_stat_batches, "key bigint, host bigint, parent bigint, value bigint, n double")
    stats = stats.groupBy("key", "value", F.isnull("host").alias("feature")).agg(F.round(F.sum("n")).cast("bigint").alias("n"), F.min("host").alias("host"), F.min("parent").alias("parent"))
    x = F.col("n")
    node, feature = ~F.col("feature"), F.col("feature")
    per_key = stats.groupBy("key").agg(
        F.sum(F.when(node, x)).alias("pages"), F.min("host").alias("host"), F.min("parent").alias("parent"),
        F.collect_list(F.when(node, F.struct(F.col("value").alias("style"), x.alias("count")))).alias("styles"),
        F.sum(F.when(feature, x)).alias("seen"), F.sum(F.when(feature, x * F.log(x.cast("double")))).alias("nlogn"),
    ).where("pages >= 2")
    # a sentence of n pages, evenly: entropy log_m(n); weighted by occurrence
    shared = per_key.select("host", "key", "parent", "pages", (1 - F.col("nlogn") / F.col("seen") / F.log(F.col("pages").cast("double"))).alias("content"), F.explode("styles").alias("s"))
    shared = shared.select("host", "key", "parent", "pages", "content", F.col("s.style").alias("style"), F.col("s.count").alias("count"))

    def per_host(pdf: pd.DataFrame) -> pd.DataFrame:
        out = composite(pdf, threshold)
        out["host"] = pdf["host"].iloc[0]
        return out[["host", "key", "parent", "importance", "noise"]]

    return shared.groupBy("host").applyInPandas(per_host, "host bigint, key bigint, parent bigint, importance double, noise boolean")


def text_of(root: Node, drop: set[int] | None) -> tuple[str, int]:
    """The text outside head and dropped branches, one line a block, and the number of branches dropped."""
    out, line, gone = [], [], 0

    def flush():
        if line:
            out.append(" ".join(line))
            line.clear()

    todo: list[tuple[Node, bool]] = [(root, False)]
    while todo:
        e, leave = todo.pop()
        tag = e.name
        if leave:
            flush()
            continue
        if tag == "head":
            continue
        if drop and e.key in drop:
            gone += 1
            continue
        if e.text is not None:
            line.append(" ".join(e.text.split()))
            continue
        if tag in _BLOCK or tag == "br":
            flush()
            todo.append((e, True))
        todo.extend((x, False) for x in reversed(e.children))
    flush()
    return "\n".join(out), gone


def _extract_batches(batches):
    for batch in batches:
        text, gone, seen = [], [], {}
        for hkey, source, drop in zip(batch.column("hkey").to_pylist(), batch.column("html").to_pylist(), batch.column("drop").to_pylist()):
            root = parse(source, seen)
            if drop:
                label(root, hkey & _M)
            t, n = text_of(root, {k & _M for k in drop} if drop else None)
            text.append(t)
            gone.append(n)
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("host"), pa.array(text, pa.string()), pa.array(gone, pa.int64())], ["page_id", "host", "text", "removed"])


def extract(spark: SparkSession, pages: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(page_id, host, text, removed) of every row of ``pages``; removed counts the branches taken out.

    A NULL or empty html has the text ''; long pages are read whole. A page whose URL is NULL or has no host is a
    site of its own, from which nothing is removed. Pages of a host with the same visible text, whatever their
    URLs and ids, and repeated rows count as one page, and each row gets its text. Copies that differ in a word count
    as two pages. A branch whose importance is the threshold exactly stays. A NULL page_id stays NULL; an empty table
    gives no rows; other columns, whatever their names, are ignored.
    """
    sites = _host_columns(pages)
    known = c.materialize(spark, importance(spark, sites, threshold).where("noise"))
    # only the top of each branch: its parent is not removed itself
    tops = known.join(known.select(F.col("key").alias("parent")), "parent", "left_anti")
    drops = c.materialize(spark, tops.groupBy("host").agg(F.collect_list("key").alias("drop")).select(F.col("host").alias("__lx_h"), "drop"))
    size = drops.agg(F.sum(F.size("drop") * 8 + 24)).first()[0] or 0
    side = F.broadcast(drops) if size <= BROADCAST_BYTES else drops
    return sites.join(side, sites["hkey"] == F.col("__lx_h"), "left").select("page_id", "host", "hkey", "html", "drop").mapInArrow(_extract_batches, "page_id bigint, host string, text string, removed bigint")
