"""``python -m lexloom.cli --input DUMP --output FOLDER``: extract a dump, or report its statistics."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import Observation, SparkSession
from pyspark.sql import functions as F

from lexloom.operators import pages as P
from lexloom.sources import dump, sinks


def arguments(argv: list[str] | None = None) -> argparse.Namespace:
    p = argparse.ArgumentParser(prog="lexloom")
    p.add_argument("--input", required=True, help="a dump, .xml or .xml.bz2")
    p.add_argument("--index", help="the index of a multistream dump: decodes it in parallel")
    p.add_argument("--output", help="folder for text files, or - for the standard output; needed without --stats")
    p.add_argument("--title", help="only the page of this title")
    p.add_argument("--format", choices=sinks.FORMATS, default="text")
    p.add_argument("--engine", choices=sinks.ENGINES, default="ast")
    p.add_argument("--stats", action="store_true", help="print statistics and write nothing")
    p.add_argument("--fail-on", choices=("warning", "unsupported"), help="exit with 1 if a page has such a diagnostic")
    p.add_argument("--one-file", action="store_true")
    a = p.parse_args(argv)
    try:
        sinks.check(a.format, a.engine, a.stats, a.fail_on)
    except ValueError as e:
        p.error(str(e))
    if not a.stats and not a.output:
        p.error("--output is needed without --stats")
    return a


def _print(out, fmt: str, failing) -> int:
    """Lines to the standard output in dump order, a partition at a time; the number of pages that fail."""
    n = 0
    for row in sinks.lines_of(out.withColumn("__f", failing), fmt, "__f").toLocalIterator(prefetchPartitions=True):
        print(row.value)
        n += bool(row[0])
    return n


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = arguments(argv)
    spark = spark or SparkSession.builder.appName("lexloom").getOrCreate()
    pages = dump.read_multistream(spark, a.input, a.index) if a.index else dump.read_dump(spark, a.input)
    pages = P.articles(pages)
    out = sinks.extract(pages.where(F.col("title") == a.title) if a.title is not None else pages, a.engine, a.format)
    ast = a.engine == "ast"
    d = F.col("diagnostics")
    fails = F.count_if(P.fails(d, a.fail_on)) if a.fail_on else F.count_if(F.lit(False))
    if a.stats:
        gate = out.select("text", *(["diagnostics"] if ast else [])).persist() if a.fail_on else out  # two aggregates of one parse
        s = P.stats(gate, diagnostics="diagnostics" if ast else None).first()
        print(f"pages={s.pages} clean={s.clean} ({s.clean_pct:.1f}%)" + (f" zero-diag={s.zero_diag} ({s.zero_diag_pct:.1f}%) warned={s.warned} unsupported={s.unsupported}" if ast else ""), file=sys.stderr)
        failing = gate.agg(fails).first()[0] if a.fail_on else 0
    elif a.output == "-":
        failing = _print(out, a.format, P.fails(d, a.fail_on) if a.fail_on else F.lit(False))
    elif ast:
        seen = Observation()  # counted while the pages are written, so each is parsed once
        sinks.write(out.observe(seen, F.count_if(P.has_severity(d, "warning")).alias("w"), F.count_if(P.has_unsupported(d)).alias("u"), fails.alias("f")), a.output, a.format, a.one_file)
        s = seen.get
        if s["w"] + s["u"]:
            print(f"{s['w']} pages with dropped templates, {s['u']} with unsupported markup", file=sys.stderr)
        failing = s["f"]
    else:
        sinks.write(out, a.output, a.format, a.one_file)
        failing = 0
    if failing:
        print(f"{failing} pages fail --fail-on {a.fail_on}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
