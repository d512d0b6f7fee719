"""The functions under SQL names."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.functions import arrow_udf

from lexloom.functions import arrow
from lexloom.operators import parser, render
from lexloom.operators.pages import FIELDS, parse_udf
from lexloom.operators.strip import decode, strip


def _strings(f):
    def run(column: pa.Array) -> pa.Array:
        return arrow.texts(f, column, pa.string())

    return arrow_udf(run, "string")


def _sections():
    def run(column: pa.Array) -> pa.Array:
        from lexloom.operators.pages import _MAKE

        return arrow.over_slices(lambda ts: _MAKE["sections"]([parser.parse(t or "") for t in ts]), column)

    return arrow_udf(run, FIELDS["sections"])


def register(spark: SparkSession) -> None:
    """wiki_strip, wiki_decode, wiki_plain, wiki_markdown, wiki_href (strings) and looks_clean, for which NULL gives NULL;
    wiki_parse (a struct of all FIELDS) and wiki_sections (an array), for which NULL is an empty page."""
    from lexloom.functions.wikitext import RESIDUALS

    def clean(column: pa.Array) -> pa.Array:
        return arrow.texts(lambda t: not any(m in t for m in RESIDUALS), column, pa.bool_())

    spark.udf.register("wiki_strip", _strings(strip))
    spark.udf.register("wiki_decode", _strings(decode))
    spark.udf.register("wiki_plain", _strings(lambda t: render.plain(parser.parse(t).nodes)))
    spark.udf.register("wiki_markdown", _strings(lambda t: render.markdown(parser.parse(t).nodes)))
    spark.udf.register("wiki_href", _strings(render.md_href))
    spark.udf.register("wiki_parse", parse_udf(FIELDS))
    spark.udf.register("wiki_sections", _sections())
    spark.udf.register("looks_clean", arrow_udf(clean, "boolean"))
