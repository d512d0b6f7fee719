"""Operators over tables of pages (title, namespace, redirect, text).

``with_parsed`` runs the parser once per page, Arrow batch by batch; everything else
reads its fields, so that one plan has one Python step however many outputs it gives.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from lexloom.functions import arrow
from lexloom.functions import metrics as M
from lexloom.functions import wikitext as W
from lexloom.operators import parser, render

RUN = "struct<text:string,bold:boolean,italic:boolean,link:int,target:string>"
FIELDS = {
    "text": "string",
    "markdown": "string",
    # the Markdown normal form as JSON
    "normal": "string",
    "links": "array<struct<block:int,link:int,target:string,label:string,external:boolean>>",
    "sections": "array<struct<level:int,heading:string,text:string>>",
    "diagnostics": "array<struct<code:string,severity:string,start:bigint,end:bigint,message:string>>",
    "blocks": "array<struct<kind:string,level:int,ordered:boolean,start:bigint,end:bigint,source:string"
    f",runs:array<{RUN}>,items:array<struct<depth:int,ordered:boolean,runs:array<{RUN}>>>,lines:array<array<{RUN}>>,rows:array<array<array<{RUN}>>>>>",
}


class _List:
    """A list column that grows by entries; ``None`` is a NULL entry. Its elements are counted by what holds them."""

    def __init__(self):
        self.at, self.null = [0], []

    def close(self, n: int, null: bool = False) -> None:
        self.at.append(n)
        self.null.append(null)

    def array(self, values: pa.Array) -> pa.Array:
        mask = pa.array(self.null, pa.bool_()) if any(self.null) else None
        return pa.ListArray.from_arrays(pa.array(self.at, pa.int32()), values, mask=mask)


class _Runs(_List):
    """Lists of styled runs out of inline nodes; the runs of one link share a number, a bare link has one of text ''."""

    def __init__(self):
        super().__init__()
        self.text, self.bold, self.italic, self.link, self.target = [], [], [], [], []
        self.links = 0

    def add(self, nodes: list[tuple] | None) -> None:
        self.links = 0
        self._walk(nodes or (), False, False, None, None)
        self.close(len(self.text), nodes is None)

    def _walk(self, nodes, bold: bool, italic: bool, link: int | None, target: str | None) -> None:
        for n in nodes:
            kind = n[0]
            if kind == "text":
                self.text.append(n[1])
                self.bold.append(bold)
                self.italic.append(italic)
                self.link.append(link)
                self.target.append(target)
            elif kind == "bold":
                self._walk(n[1], True, italic, link, target)
            elif kind == "italic":
                self._walk(n[1], bold, True, link, target)
            elif kind == "link":
                self.links += 1
                self._walk(n[2] or [("text", "")], bold, italic, self.links, n[1])

    def column(self) -> pa.Array:
        parts = (pa.array(self.text, pa.string()), pa.array(self.bold, pa.bool_()), pa.array(self.italic, pa.bool_()), pa.array(self.link, pa.int32()), pa.array(self.target, pa.string()))
        return self.array(pa.StructArray.from_arrays(parts, ["text", "bold", "italic", "link", "target"]))


def _items(node: tuple):
    """(depth, ordered, inline nodes) of each item of a list, in reading order."""
    todo = [(1, node[1], iter(node[2]))]
    while todo:
        depth, ordered, rest = todo[-1]
        item = next(rest, None)
        if item is None:
            todo.pop()
            continue
        yield depth, ordered, [n for n in item if n[0] != "list"]
        todo += [(depth + 1, n[1], iter(n[2])) for n in reversed(item) if n[0] == "list"]


def _blocks(pages: list) -> pa.Array:
    kinds, levels, ordered, starts, ends, sources = [], [], [], [], [], []
    page, runs = _List(), _Runs()
    items, depths, turns, item_runs = _List(), [], [], _Runs()
    lines, line_runs = _List(), _Runs()
    rows, cells, cell_runs = _List(), _List(), _Runs()
    for p in pages:
        for n, (start, end) in zip(p.nodes, p.spans):
            kind = n[0]
            kinds.append(kind)
            starts.append(start)
            ends.append(end)
            levels.append(n[1] if kind == "heading" else None)
            ordered.append(n[1] if kind == "list" else None)
            sources.append(n[1] if kind == "unsupported" else None)
            runs.add(n[2] if kind == "heading" else n[1] if kind == "paragraph" else None)
            if kind == "list":
                for depth, turn, inner in _items(n):
                    depths.append(depth)
                    turns.append(turn)
                    item_runs.add(inner)
            elif kind == "preformatted":
                for line in n[1]:
                    line_runs.add(line)
            elif kind == "table":
                for row in n[1]:
                    for cell in row:
                        cell_runs.add(cell)
                    cells.close(len(cell_runs.null))
            items.close(len(depths), kind != "list")
            lines.close(len(line_runs.null), kind != "preformatted")
            rows.close(len(cells.null), kind != "table")
        page.close(len(kinds))
    item = pa.StructArray.from_arrays([pa.array(depths, pa.int32()), pa.array(turns, pa.bool_()), item_runs.column()], ["depth", "ordered", "runs"])
    parts = {
        "kind": pa.array(kinds, pa.string()), "level": pa.array(levels, pa.int32()), "ordered": pa.array(ordered, pa.bool_()), "start": pa.array(starts, pa.int64()), "end": pa.array(ends, pa.int64()),
        "source": pa.array(sources, pa.string()), "runs": runs.column(), "items": items.array(item), "lines": lines.array(line_runs.column()), "rows": rows.array(cells.array(cell_runs.column())),
    }
    return page.array(pa.StructArray.from_arrays(list(parts.values()), list(parts)))


def _links(nodes: list[tuple], out: list[tuple], block: int, count: list[int]) -> None:
    """(block, number, target, label) of every link, an outer one before those in its label."""
    for n in nodes:
        kind = n[0]
        if kind == "link":
            label: list[str] = []
            render._inline_text(n[2], label)
            out.append((block, count[0], n[1], "".join(label)))
            count[0] += 1
            _links(n[2], out, block, count)
        elif kind in ("bold", "italic"):
            _links(n[1], out, block, count)


def _block_links(node: tuple, block: int, out: list[tuple]) -> None:
    kind, count = node[0], [0]
    if kind == "heading":
        parts = [node[2]]
    elif kind == "paragraph":
        parts = [node[1]]
    elif kind == "list":
        parts = (inner for _, _, inner in _items(node))
    elif kind == "preformatted":
        parts = node[1]
    elif kind == "table":
        parts = (cell for row in node[1] for cell in row)
    else:
        parts = ()
    for inner in parts:
        _links(inner, out, block, count)


def _structs(per_page: list[list[tuple]], names: tuple[str, ...], kinds: tuple[pa.DataType, ...]) -> pa.Array:
    """A list of structs for each page, out of tuples."""
    page, flat = _List(), []
    for rows in per_page:
        flat += rows
        page.close(len(flat))
    columns = list(zip(*flat)) if flat else [()] * len(names)
    return page.array(pa.StructArray.from_arrays([pa.array(x, k) for x, k in zip(columns, kinds)], list(names)))


def _all_links(pages: list) -> pa.Array:
    per_page = []
    for p in pages:
        out: list[tuple] = []
        for block, n in enumerate(p.nodes):
            _block_links(n, block, out)
        per_page.append([(*x, _EXTERNAL.match(x[2]) is not None) for x in out])
    return _structs(per_page, ("block", "link", "target", "label", "external"), (pa.int32(), pa.int32(), pa.string(), pa.string(), pa.bool_()))


_EXTERNAL = re.compile(r"(?:https?:|ftp:|mailto:|)//|mailto:")
_DIAGNOSTIC = (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string())
#: A column of each field, straight from the parsed pages of a batch.
_MAKE = {
    "text": lambda ps: pa.array([render.plain(p.nodes) for p in ps], pa.string()),
    "markdown": lambda ps: pa.array([render.markdown(p.nodes) for p in ps], pa.string()),
    "normal": lambda ps: pa.array([json.dumps(render.normal_form(p.nodes), ensure_ascii=False) for p in ps], pa.string()),
    "sections": lambda ps: _structs([render.sections(p.nodes) for p in ps], ("level", "heading", "text"), (pa.int32(), pa.string(), pa.string())),
    "diagnostics": lambda ps: _structs([p.diagnostics for p in ps], ("code", "severity", "start", "end", "message"), _DIAGNOSTIC),
    "links": _all_links,
    "blocks": _blocks,
}


def parse_udf(fields: Iterable[str]):
    """The function of :func:`parse_column`, which may be registered for SQL."""
    fields = tuple(fields)
    if not fields or set(fields) - set(FIELDS):
        raise ValueError(f"fields must be some of {', '.join(FIELDS)}")

    def some(texts: list) -> pa.Array:
        pages = [parser.parse(t or "") for t in texts]
        return pa.StructArray.from_arrays([_MAKE[f](pages) for f in fields], list(fields))

    def run(column: pa.Array) -> pa.Array:
        return arrow.over_slices(some, column)

    # declared so that no rule of the optimizer copies the call into a filter, where a page would be parsed again
    return arrow_udf(run, f"struct<{','.join(f'{f}:{FIELDS[f]}' for f in fields)}>").asNondeterministic()


def parse_column(text: Column, fields: Iterable[str] = ("text", "diagnostics")) -> Column:
    """A struct of the chosen ``FIELDS`` of each page from one parse; a NULL text is an empty page."""
    return parse_udf(fields)(text)


def with_parsed(pages: DataFrame, fields: Iterable[str] = ("text", "diagnostics"), text_col: str = "text", to: str = "parsed") -> DataFrame:
    return pages.withColumn(to, parse_column(F.col(text_col), fields))


def articles(pages: DataFrame) -> DataFrame:
    """Main-namespace pages that are no redirects."""
    return pages.where(W.is_article(F.col("namespace"), F.col("redirect")))


# ---------------------------------------------------------------- diagnostics


def has_severity(diagnostics: Column, severity: str) -> Column:
    return F.exists(diagnostics, lambda d: d["severity"] == severity)


def has_unsupported(diagnostics: Column) -> Column:
    return F.exists(diagnostics, lambda d: d["severity"] != "warning")


def has_table(blocks: Column) -> Column:
    return F.exists(blocks, lambda b: b["kind"] == "table")


def fails(diagnostics: Column, on: str) -> Column:
    """Whether a page fails a gate: ``warning`` for any diagnostic, ``unsupported`` for one that is more than a warning."""
    if on not in ("warning", "unsupported"):
        raise ValueError("on must be 'warning' or 'unsupported'")
    return F.size(diagnostics) > 0 if on == "warning" else has_unsupported(diagnostics)


def _percent(n: Column, total: Column) -> Column:
    return F.when(total == 0, F.lit(0.0)).otherwise(100.0 * n / total)


def stats(extracted: DataFrame, text: str = "text", diagnostics: str | None = "diagnostics") -> DataFrame:
    """One row: pages, clean and clean_pct; with diagnostics also the (overlapping) tiers zero_diag, warned, unsupported."""
    cols = [F.count("*").alias("pages"), F.count_if(W.looks_clean(F.col(text))).alias("clean")]
    if diagnostics:
        d = F.col(diagnostics)
        cols += [F.count_if(F.size(d) == 0).alias("zero_diag"), F.count_if(has_severity(d, "warning")).alias("warned"), F.count_if(has_unsupported(d)).alias("unsupported")]
    out = extracted.agg(*cols)
    for name in ["clean"] + (["zero_diag"] if diagnostics else []):
        out = out.withColumn(f"{name}_pct", _percent(F.col(name), F.col("pages")))
    return out


def diagnostics_of(extracted: DataFrame, *keys: str, diagnostics: str = "diagnostics") -> DataFrame:
    """A row for each diagnostic, with the key columns."""
    return extracted.select(*keys, F.posexplode(diagnostics).alias("ord", "d")).select(*keys, "ord", "d.code", "d.severity", "d.start", "d.end", "d.message")


def diagnostic_tally(extracted: DataFrame, diagnostics: str = "diagnostics") -> DataFrame:
    """(code, occurrences, pages) of what is unsupported, most pages first."""
    per_page = extracted.select(F.explode(F.aggregate(diagnostics, F.create_map().cast("map<string,int>"), _count_code)).alias("code", "n"))
    return per_page.groupBy("code").agg(F.sum("n").alias("occurrences"), F.count("*").alias("pages")).orderBy(F.desc("pages"), "code")


def coverage(extracted: DataFrame, diagnostics: str = "diagnostics") -> DataFrame:
    """One row: cases, those without any diagnostic (passing) and their share in per cent."""
    return extracted.agg(F.count("*").alias("cases"), F.count_if(F.size(diagnostics) == 0).alias("passing")).withColumn("passing_pct", _percent(F.col("passing"), F.col("cases")))


def code_histogram(extracted: DataFrame, diagnostics: str = "diagnostics") -> DataFrame:
    """(code, severity, occurrences, cases) of every code, warnings too, most cases first."""
    kinds = F.array_distinct(F.transform(diagnostics, lambda d: F.struct(d["code"].alias("code"), d["severity"].alias("severity"))))
    count = lambda k: F.size(F.filter(diagnostics, lambda d: (d["code"] == k["code"]) & (d["severity"] == k["severity"])))
    per_page = extracted.select(F.explode(F.transform(kinds, lambda k: F.struct(k["code"].alias("code"), k["severity"].alias("severity"), count(k).alias("n")))).alias("x"))
    return per_page.groupBy("x.code", "x.severity").agg(F.sum("x.n").alias("occurrences"), F.count("*").alias("cases")).orderBy(F.desc("cases"), "code")


def passing(extracted: DataFrame, key: str = "name", diagnostics: str = "diagnostics") -> DataFrame:
    """The distinct names without any diagnostic: what :func:`ratchet` compares with its baseline."""
    return extracted.where(F.size(diagnostics) == 0).select(key).distinct()


def residual_tally(texts: DataFrame, text: str = "text") -> DataFrame:
    """(mark, pages): in how many texts each bracket pair of wikitext is left."""
    row = texts.agg(*[F.count_if(F.col(text).contains(m)).alias(m) for m in W.RESIDUALS])
    return row.select(F.explode(F.array(*[F.struct(F.lit(m).alias("mark"), F.col(f"`{m}`").alias("pages")) for m in W.RESIDUALS])).alias("x")).select("x.*")


def _count_code(m: Column, d: Column) -> Column:
    code = d["code"]
    rest = F.map_filter(m, lambda k, _: k != code)
    return F.when(d["severity"] == "warning", m).otherwise(F.map_concat(rest, F.create_map(code, F.coalesce(F.try_element_at(m, code), F.lit(0)) + 1)))


def sole_code_pages(extracted: DataFrame, code: str = "U-TABLE", diagnostics: str = "diagnostics") -> DataFrame:
    """Pages whose only unsupported code is ``code``."""
    codes = F.array_distinct(F.transform(F.filter(diagnostics, lambda d: d["severity"] != "warning"), lambda d: d["code"]))
    return extracted.where(codes == F.array(F.lit(code)))


# ---------------------------------------------------------------- tables of parts


def sections_of(parsed: DataFrame, *keys: str, sections: str = "sections") -> DataFrame:
    """A row for each section: the table that retrieval chunks come from."""
    return parsed.select(*keys, F.posexplode(sections).alias("ord", "s")).select(*keys, "ord", "s.level", "s.heading", "s.text")


def block_runs(b: Column) -> Column:
    """All runs of a block, in reading order."""
    none = F.array().cast(f"array<{RUN}>")
    parts = [b["runs"], F.flatten(F.transform(b["items"], lambda x: x["runs"])), F.flatten(b["lines"]), F.flatten(F.flatten(b["rows"]))]
    return F.concat(*[F.coalesce(p, none) for p in parts])


def links_of(parsed: DataFrame, *keys: str, links: str = "links") -> DataFrame:
    """(keys, block, link, target, label, external): the link graph, a row for each link of each page. Narrow: a page's links
    come from its own row, so that pages may share a key."""
    return parsed.select(*keys, F.explode(links).alias("__l")).select(*keys, "__l.block", "__l.link", "__l.target", "__l.label", "__l.external")


# ---------------------------------------------------------------- agreement


def agreement(pairs: DataFrame, text: str = "text", truth: str = "truth", unsupported: Column | None = None, table: Column | None = None) -> DataFrame:
    """``pairs`` plus precision, coverage, word_precision, faithful and bucket."""
    t, u = F.coalesce(F.col(text), F.lit("")), F.coalesce(F.col(truth), F.lit(""))
    sets = pairs.withColumn("__s", F.struct(M.hash_sets(t).alias("t"), M.hash_sets(u).alias("u")))
    sets = sets.withColumn("__s", F.struct(F.col("__s.t.shingles").alias("a"), F.col("__s.u.shingles").alias("b"), F.col("__s.t.words").alias("c"), F.col("__s.u.words").alias("d")))
    s = F.col("__s")
    out = sets.withColumns({"precision": M.share(s["a"], s["b"]), "coverage": M.share(s["b"], s["a"]), "word_precision": M.share(s["c"], s["d"])}).drop("__s")
    no = F.lit(False)
    out = out.withColumn("faithful", M.is_faithful(F.col("precision"), F.col("word_precision"), no if table is None else table))
    return out.withColumn("bucket", M.bucket(no if unsupported is None else unsupported, F.col("faithful")))


def diff(pairs: DataFrame, wikitext: str = "wikitext", truth: str = "truth") -> DataFrame:
    """``pairs`` of pages and reference texts, parsed and judged: plus text, diagnostics, has_table and the columns of
    :func:`agreement`. :func:`report` and :func:`lowest` sum it up."""
    p = with_parsed(pairs, ("text", "diagnostics", "blocks"), wikitext, "__p")
    p = p.withColumns({"text": F.col("__p.text"), "diagnostics": F.col("__p.diagnostics"), "has_table": has_table(F.col("__p.blocks"))}).drop("__p")
    return agreement(p, "text", truth, has_unsupported(F.col("diagnostics")), F.col("has_table"))


def report(judged: DataFrame, text: str = "text") -> DataFrame:
    """One row over judged pages: buckets with their percentages, mean scores, faithful and empty outputs."""
    n = F.count("*")
    buckets = [x for b in ("faithful", "divergent", "reported") for x in (F.count_if(F.col("bucket") == b).alias(f"{b}_pages"), F.coalesce(100.0 * F.count_if(F.col("bucket") == b) / F.nullif(n, F.lit(0)), F.lit(0.0)).alias(f"{b}_pct"))]
    means = [F.avg(c).alias(f"mean_{c}") for c in ("precision", "word_precision", "coverage")]
    return judged.agg(n.alias("pages"), *buckets, *means, F.count_if("faithful").alias("faithful_text"), F.count_if(F.trim(F.coalesce(F.col(text), F.lit(""))) == "").alias("empty_output"))


def lowest(judged: DataFrame, key: str, k: int = 10) -> DataFrame:
    """The k pages of least precision."""
    return judged.orderBy("precision", key).limit(k)


def ratchet(baseline: DataFrame, current: DataFrame, key: str = "name") -> DataFrame:
    """(name, change): names that the baseline has and the current run lost (regressed), and the other way round (added)."""
    a, b = baseline.select(key), current.select(key)
    lost, won = a.subtract(b).withColumn("change", F.lit("regressed")), b.subtract(a).withColumn("change", F.lit("added"))
    return lost.union(won)
