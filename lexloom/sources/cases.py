"""Small sources of the test tooling: parser cases, name lists, page and truth pairs, title samples, prose of HTML."""

from __future__ import annotations

from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from lexloom.operators.parser import lines
from lexloom.operators.strip import WS

_HEADS = frozenset(("test", "end", "wikitext", "wikitext/edited", "options", "metadata", "config"))
_PROSE = frozenset("p h1 h2 h3 h4 h5 h6 li dd dt caption th td blockquote figcaption".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset("address article aside blockquote div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol pre section table ul".split())
_CLOSES = {"li": ("li",), "dd": ("dd", "dt"), "dt": ("dd", "dt"), "td": ("td", "th"), "th": ("td", "th"), "tr": ("tr", "td", "th"), "p": ("p",)}


def parse_cases(text: str) -> list[dict]:
    """(name, wikitext, html) of each ``!! test`` to ``!! end``; only known heads count, html before html/php before html/parsoid."""
    out, parts, at = [], None, ""
    for line in lines(text):
        head = line[2:].strip(WS) if line.startswith("!!") else None
        if head is not None and head not in _HEADS and not head.startswith("html"):
            head = None
        if head == "test":
            parts, at = {}, "name"
        elif parts is None:
            continue
        elif head == "end":
            got = {k: "\n".join(v).rstrip("\n") for k, v in parts.items()}
            html = next((got[k] for k in ("html", "html/php", "html/parsoid") if k in got), None)
            out.append({"name": got.get("name", "").strip(WS), "wikitext": got.get("wikitext", ""), "html": html})
            parts = None
        elif head is not None:
            at = head
            parts.setdefault(at, [])
        else:
            parts.setdefault(at, []).append(line)
    return out


_CASE = "array<struct<name:string,wikitext:string,html:string>>"


def _cases(column: pa.Array) -> pa.Array:
    kind = pa.list_(pa.struct([("name", pa.string()), ("wikitext", pa.string()), ("html", pa.string())]))
    return pa.array([parse_cases(t or "") for t in column.to_pylist()], kind)


def cases_of(files: DataFrame, column: str = "value") -> DataFrame:
    """A row for each case of a column that holds whole files."""
    return files.select(F.explode(arrow_udf(_cases, _CASE)(F.col(column))).alias("c")).select("c.*")


def read_cases(spark: SparkSession, path: str) -> DataFrame:
    return cases_of(spark.read.text(path, wholetext=True))


def wikitexts_of(cases: DataFrame) -> DataFrame:
    """The non-empty bodies of cases."""
    return cases.where("wikitext <> ''").select("wikitext")


def read_names(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """Names, one a line, without blank lines and those that begin with #."""
    rows = spark.read.text(path).select(F.trim("value").alias("name")).where("name <> '' and not startswith(name, '#')")
    return rows if limit is None else rows.limit(limit)


def read_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """(slug, wikitext, truth) of ``<slug>.wikitext`` and ``<slug>.truth.txt``; a page without its truth is an error."""

    def files(ending: str, to: str) -> DataFrame:
        name = F.regexp_replace(F.element_at(F.split(F.input_file_name(), "/"), -1), ending.replace(".", r"\.") + "$", "")
        return spark.read.option("pathGlobFilter", "*" + ending).text(folder, wholetext=True).select(name.alias("slug"), F.col("value").alias(to))

    both = files(".wikitext", "wikitext").join(files(".truth.txt", "__t"), "slug", "left")
    missing = F.raise_error(F.concat(F.lit("no truth for page "), F.col("slug"))).cast("string")
    return both.select("slug", "wikitext", F.coalesce("__t", missing).alias("truth"))


def random_titles(json: Column) -> Column:
    """Titles of an answer ``{"query": {"random": [{"title": …}]}}``; another shape is an error."""
    got = F.from_json(json, "query struct<random:array<struct<title:string>>>")["query"]["random"]
    titles = F.filter(F.transform(got, lambda x: x["title"]), lambda t: t.isNotNull())
    return F.coalesce(titles, F.raise_error(F.lit("no titles in the answer")).cast("array<string>"))


def sample_titles(titles: DataFrame, n: int, seed: int = 0, column: str = "title") -> DataFrame:
    """n distinct titles by a hash with the seed, in order of the alphabet: a top-n, not a sort of all."""
    key = F.md5(F.concat(F.lit(f"{seed} "), F.col(column)))
    return titles.select(column).distinct().orderBy(key, column).limit(n).orderBy(column)


# ---------------------------------------------------------------- prose of HTML


class _Prose(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, int | None]] = []
        self.out: list[list[str]] = []

    def handle_starttag(self, tag, attrs):
        closes = _CLOSES.get(tag, ("p",) if tag in _BLOCK else None)
        if closes and self.stack and self.stack[-1][0] in closes:
            self.stack.pop()
        if tag in _VOID:
            return
        slot = None
        if tag in _PROSE:
            slot = len(self.out)
            self.out.append([])
        self.stack.append((tag, slot))

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        for k in range(len(self.stack) - 1, -1, -1):
            if self.stack[k][0] == tag:
                del self.stack[k:]
                return

    def handle_data(self, data):
        for _, slot in self.stack:
            if slot is not None:
                self.out[slot].append(data)


def html_prose(html: str) -> str:
    """The whole text of every prose element, one a line; a nested one is there twice."""
    p = _Prose()
    p.feed(html)
    p.close()
    return "".join("".join(x) + "\n" for x in p.out)


def html_to_text(html: Column) -> Column:
    def run(column: pa.Array) -> pa.Array:
        return pa.array([html_prose(h or "") for h in column.to_pylist()], pa.string())

    return arrow_udf(run, "string")(html)
