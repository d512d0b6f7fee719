"""Rows of each output format. A sink only formats; order and files are the writer's.

Text, JSON lines and sections are one line of ``value`` a page (a text may hold line breaks itself).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.functions import wikitext as W
from lexloom.operators import pages as P

FORMATS, ENGINES = ("text", "jsonl", "sections", "markdown"), ("ast", "strip")


def check(fmt: str, engine: str, stats: bool = False, fail_on: str | None = None) -> None:
    """Raise on what cannot go together."""
    if fmt not in FORMATS or engine not in ENGINES:
        raise ValueError("unknown format or engine")
    structured = fmt in ("sections", "markdown")
    if structured and engine == "strip":
        raise ValueError(f"format {fmt} comes from the ast engine only")
    if structured and stats:
        raise ValueError("stats are about plain text: choose text or jsonl")
    if fail_on and engine == "strip":
        raise ValueError("the strip engine gives no diagnostics to fail on")


def extract(pages: DataFrame, engine: str = "ast", fmt: str = "text") -> DataFrame:
    """``pages`` plus text (or markdown, or sections) and, from the ast engine, diagnostics."""
    check(fmt, engine)
    if engine == "strip":
        return pages.withColumn("text", W.strip(F.coalesce("text", F.lit(""))))
    main = fmt if fmt in ("sections", "markdown") else "text"
    out = P.with_parsed(pages, (main, "diagnostics"), to="__p")
    return out.withColumns({main: F.col(f"__p.{main}"), "diagnostics": F.col("__p.diagnostics")}).drop("__p")


def lines_of(extracted: DataFrame, fmt: str = "text", *keep: str) -> DataFrame:
    """(keep…, value): what the format writes for each page. No diagnostics key where none were looked for."""
    has = ["diagnostics"] if "diagnostics" in extracted.columns else []
    if fmt == "text":
        value = F.col("text")
    elif fmt == "jsonl":
        value = F.to_json(F.struct("title", "text", *has))
    elif fmt == "sections":
        value = F.to_json(F.struct("title", "sections", *has))
    else:
        value = page_markdown(F.col("title"), F.col("markdown"))
    return extracted.select(*keep, value.alias("value"))


def markdown_title(title):
    """A title so that Markdown shows it literally."""
    t = W.trim_ws(F.regexp_replace(F.replace(title, F.lit("\0"), F.lit("�")), r"\p{IsWhite_Space}+", " "))
    t = W.trim_ws(F.regexp_replace(W.decode_entities(t), r"\p{IsWhite_Space}+", " "))
    t = F.regexp_replace(t, r"([\\*_\[\]`|])", r"\\$1")
    t = F.replace(F.replace(t, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    return F.regexp_replace(F.regexp_replace(t, r"\A([#>\-+=~])", r"\\$1"), r"\A([0-9]+)([.)])", r"$1\\$2")


def page_markdown(title, body):
    return F.concat(F.lit("# "), markdown_title(title), F.lit("\n"), F.when(body != "", F.concat(F.lit("\n"), body)).otherwise(""), F.lit("\n"))


def write(extracted: DataFrame, path: str, fmt: str = "text", one_file: bool = False) -> None:
    """Text files in dump order: the scan numbers pages in the order of its tasks and nothing moves them, so the files
    need no sort; ``one_file`` gathers and orders them in one task."""
    rows = lines_of(extracted, fmt, "ord")
    if one_file:
        rows = rows.repartition(1).sortWithinPartitions("ord")
    rows.select("value").write.mode("overwrite").text(path)
