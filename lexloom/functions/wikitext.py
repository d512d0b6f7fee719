"""The text passes as Column expressions: each runs in the JVM; all of them in turn are one Arrow function.

Patterns use possessive quantifiers and lazy single-character loops only, so that neither
backtracking nor the stack grows with the text.
"""

from __future__ import annotations

from functools import wraps

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from lexloom.functions import arrow
from lexloom.operators import strip as python
from lexloom.operators.strip import ENTITIES, TAG_REST

_WS = r"\p{IsWhite_Space}"
RESIDUALS = ("{{", "}}", "[[", "]]", "{|", "|}")
_SELF = r"(?<=/[ \t\n\f\r]{0,200}>)"
_COMMENTS = (
    r"(?s)<!--.*?(?:-->|\z)"
    # without any > ahead no ref closes; only a comment still drops the rest
    r"|(<(?i:ref)[ \t\n\r/][^>]*?)(?:<!--[^>]*)?\z"
    rf"|<(?i:ref)(?=[ \t\n\r>/]){TAG_REST}(?:{_SELF}|.*?(?:</(?i:ref)>|\z))"
    r"|<(?i:nowiki)>(.*?)(?:</(?i:nowiki)>|\z)"
)
_TEMPLATE = r"(?s)(.*?)(\{\{|\{\||\}\}|\|\}|\z)"
_LINK = r"(?s)(.*?)(\[\[.*?(?:\]\]|\z)|\[(?=http).*?(?:\]|\z)|\z)"
_ENTITY = r"(?s)([^&]*+)(&(?:#[xX]\+?[0-9a-fA-F]{1,8}|#\+?[0-9]{1,9}|" + "|".join(ENTITIES) + r");|&|\z)"


def _once(f):
    """A pass that reads its argument several times evaluates it once: the argument is bound as a lambda variable, where
    a composed pass would otherwise repeat all that come before it."""

    @wraps(f)
    def bound(c: Column) -> Column:
        return F.get(F.transform(F.array(c), f), F.lit(0))

    return bound


def trim_ws(c: Column) -> Column:
    """Unicode white space off both ends; a run of it is looked at once, from its first."""
    return F.regexp_replace(F.regexp_replace(c, rf"(?<!{_WS}){_WS}++\z", ""), rf"\A{_WS}++", "")


def _groups(c: Column, pattern: str) -> Column:
    """[(text before, match)] of a pattern with these two groups."""
    return F.zip_with(F.regexp_extract_all(c, F.lit(pattern), 1), F.regexp_extract_all(c, F.lit(pattern), 2), lambda t, m: F.struct(t.alias("t"), m.alias("m")))


@_once
def strip_comments_refs(c: Column) -> Column:
    """Without comments and refs; nowiki elements leave their inner text. A ref tag that never closes stays."""
    return F.when(c.contains("<"), F.regexp_replace(c, _COMMENTS, "$1$2")).otherwise(c)


@_once
def strip_templates_tables(c: Column) -> Column:
    """Only what is outside every template and table; one depth counter for both; an open one drops the rest."""
    start = F.struct(F.lit(0).alias("d"), F.lit("").alias("o"))

    def step(s: Column, x: Column) -> Column:
        opens, closes = x["m"].isin("{{", "{|"), x["m"].isin("}}", "|}")
        depth = F.when(opens, s["d"] + 1).when(closes & (s["d"] > 0), s["d"] - 1).otherwise(s["d"])
        kept = F.when(s["d"] > 0, s["o"]).when(closes, F.concat(s["o"], x["t"], x["m"])).otherwise(F.concat(s["o"], x["t"]))
        return F.struct(depth.alias("d"), kept.alias("o"))

    folded = F.aggregate(_groups(c, _TEMPLATE), start, step, lambda s: s["o"])
    return F.when(c.contains("{{") | c.contains("{|"), folded).otherwise(c)


@_once
def strip_links(c: Column) -> Column:
    """Links become their text: after the last pipe, or after an address; media, categories and bare addresses vanish."""

    def shown(x: Column) -> Column:
        m = x["m"]
        body = m.substr(F.lit(3), F.length(m) - 4)
        outer = m.substr(F.lit(2), F.length(m) - 2)
        dropped = body.rlike(rf"\A{_WS}*+(?i:file|image|category){_WS}*+(?:[:|]|\z)")
        return (
            F.when(m == "", F.lit(""))
            .when(m.startswith("[["), F.when(~m.endswith("]]") | (F.length(m) < 4) | dropped, F.lit("")).otherwise(F.substring_index(body, "|", -1)))
            .otherwise(F.when(~m.endswith("]") | ~outer.rlike(_WS), F.lit("")).otherwise(F.regexp_replace(outer, rf"(?s)\A[^{_WS}]*+{_WS}(.*)\z", "$1")))
        )

    out = F.array_join(F.transform(_groups(c, _LINK), lambda x: F.concat(x["t"], shown(x))), "")
    return F.when(c.contains("["), out).otherwise(c)


@_once
def strip_tags(c: Column) -> Column:
    """Without tags; from the first that never closes everything stays."""
    return F.when(c.contains("<"), F.regexp_replace(c, rf"(?s)<{TAG_REST}|(<.*)", "$1")).otherwise(c)


def strip_markup(c: Column) -> Column:
    """Line by line: heading signs or leading list signs, quote marks of emphasis, tags."""

    @_once
    def inner(t: Column) -> Column:
        head = (F.length(t) > 2) & t.startswith("=") & t.endswith("=")
        title = trim_ws(F.regexp_replace(F.regexp_replace(t, r"\A=++", ""), r"(?<!=)=++\z", ""))
        return F.when(head, title).otherwise(F.regexp_replace(t, r"\A[*#:; ]++", ""))

    def line(x: Column) -> Column:
        body = inner(trim_ws(x))
        for mark in ("'''''", "'''", "''"):
            body = F.replace(body, F.lit(mark), F.lit(""))
        return strip_tags(body)

    return F.array_join(F.transform(F.split(c, "\n", -1), line), "\n")


def collapse_blank_lines(c: Column) -> Column:
    """At most one empty line in a row, none at the ends."""
    x = F.regexp_replace(F.replace(c, F.lit("\r\n"), F.lit("\n")), rf"(?dm)^[{_WS}&&[^\n]]++$", "")
    return trim_ws(F.regexp_replace(x, r"\n{3,}+", "\n\n"))


@_once
def decode_entities(c: Column) -> Column:
    """Known names and numbers, once; a no-break space becomes a space; anything else stays."""
    names = F.create_map(*[F.lit(x) for k, v in ENTITIES.items() for x in (k, " " if v == 0xA0 else chr(v))])

    def one(x: Column) -> Column:
        m = x["m"]
        body = m.substr(F.lit(2), F.length(m) - 2)
        digits = F.replace(F.regexp_replace(body, "^#[xX]?", ""), F.lit("+"), F.lit(""))
        code = F.when(body.rlike("^#[xX]"), F.conv(digits, 16, 10)).otherwise(digits).try_cast("bigint")
        char = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
        valid = code.isNotNull() & (code <= 0x10FFFF) & ~code.between(0xD800, 0xDFFF) & (F.length(body) <= 10)
        number = F.when(code == 0xA0, F.lit(" ")).when(valid, char).otherwise(m)
        return F.when(F.length(m) < 2, m).when(body.startswith("#"), number).otherwise(names[body])

    out = F.array_join(F.transform(_groups(c, _ENTITY), lambda x: F.concat(x["t"], one(x))), "")
    return F.when(c.contains("&"), out).otherwise(c)


def _arrow(f):
    """A pass of :mod:`lexloom.operators.strip` over Arrow batches. All passes in turn are several times faster so than as a
    tower of Column expressions, whose lambdas are interpreted; a NULL text stays NULL."""

    def run(column: pa.Array) -> pa.Array:
        return arrow.texts(f, column, pa.string())

    return arrow_udf(run, "string").asNondeterministic()  # so that no filter evaluates it a second time


def strip_raw(c: Column) -> Column:
    """As :func:`strip`, with entities as they are."""
    return _arrow(python.strip_raw)(c)


def strip(c: Column) -> Column:
    """Clean text of wikitext, lossy: comments and refs, templates and tables, links, markup, blank lines, entities."""
    return _arrow(python.strip)(c)


def looks_clean(c: Column) -> Column:
    """No bracket pair of wikitext is left."""
    return ~c.rlike(r"\{\{|\}\}|\[\[|\]\]|\{\||\|\}")


def is_nonprose_target(c: Column) -> Column:
    return c.rlike(rf"\A{_WS}*+(?i:file|image|category){_WS}*+(?::|\z)")


def is_article(namespace: Column, redirect: Column) -> Column:
    return (namespace == 0) & ~redirect


def slugify(c: Column) -> Column:
    """A file name of a title: anything but letters and digits becomes an underscore."""
    return F.regexp_replace(c, r"[^\p{IsAlphabetic}\p{N}]", "_")
