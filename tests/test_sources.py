"""Dumps, indexes, pairs and cases from files; the command line; streams."""

import bz2
import json

import pytest
from pyspark.sql import functions as F

from lexloom import cli
from lexloom.sources import cases, dump
from lexloom.streaming import pages as S


def page(title, text, ns="0", extra=""):
    return f'<page>\n<title>{title}</title>\n<ns>{ns}</ns>\n{extra}<revision><text xml:space="preserve">{text}</text></revision>\n</page>\n'


def write(path, body):
    path.write_text(f"<mediawiki>\n{body}</mediawiki>\n", encoding="utf-8")
    return str(path)


BODY = page("Earth", " lead &amp; &lt;ref&gt;c&lt;/ref&gt; &quot;q&quot; &#233;&#x41;") + page("Talk:Earth", "x", " 1 ") + page("USA", "", extra="<redirect></redirect>\n") + page("Gone", "", extra='<redirect title="x" />\n')


def test_scan(spark, tmp_path):
    rows = dump.read_dump(spark, write(tmp_path / "d.xml", BODY)).orderBy("ord").collect()
    assert [(r.title, r.namespace, r.redirect, r.text) for r in rows] == [("Earth", 0, False, ' lead & <ref>c</ref> "q" éA'), ("Talk:Earth", 1, False, "x"), ("USA", 0, True, ""), ("Gone", 0, True, "")]
    packed = tmp_path / "d.xml.bz2"
    packed.write_bytes(bz2.compress((tmp_path / "d.xml").read_bytes()))
    assert dump.read_dump(spark, str(packed)).drop("ord").collect() == dump.read_dump(spark, str(tmp_path / "d.xml")).drop("ord").collect()


@pytest.mark.parametrize("bad", [page("A", "x", "zero"), page("A", "x").replace("<ns>0</ns>", ""), page("A", "&bogus;"), page("A", "x").replace("</text>", "</text><text>y</text>"), page("A", "x").replace("</revision>", "</revision><revision><text/></revision>"), page("A", "x")[:-20]])
def test_bad_pages_fail(spark, tmp_path, bad):
    df = dump.read_dump(spark, write(tmp_path / "d.xml", page("Ok", "fine") + bad))
    with pytest.raises(Exception):
        df.where("namespace = 0 and not redirect").select("title", "text").collect()


def multistream(folder, streams=24, each=3):
    data, index, at = bz2.compress(b"<mediawiki>\n"), [], 0
    for s in range(streams):
        body = "".join(page(f"P{s}:{k}", f"text é {s} {k}") for k in range(each))
        one = bz2.compress(body.encode())
        index += [f"{len(data)}:{s * each + k}:P{s}:{k}" for k in range(each)]
        data += one
    at = len(data)
    data += bz2.compress(b"</mediawiki>\n")
    (folder / "m.xml.bz2").write_bytes(data)
    (folder / "i.txt").write_text("\n".join(index) + "\n\n")
    return str(folder / "m.xml.bz2"), str(folder / "i.txt"), at


def test_multistream(spark, tmp_path):
    path, index, _ = multistream(tmp_path)
    whole = [tuple(r) for r in dump.read_dump(spark, path).orderBy("ord").drop("ord").collect()]
    df = dump.read_multistream(spark, path, index, range_bytes=500)
    assert df.rdd.getNumPartitions() > 4
    assert [tuple(r) for r in df.orderBy("ord").drop("ord").collect()] == whole and len(whole) == 72
    raw = bytearray(open(path, "rb").read())
    raw[len(raw) // 2] ^= 0xFF
    open(path, "wb").write(raw)
    with pytest.raises(Exception):
        dump.read_multistream(spark, path, index).collect()


def test_bad_index(spark, tmp_path):
    path, index, _ = multistream(tmp_path, 2)
    for body in ("", "x:1:A\n", "99999999:1:A\n"):
        (tmp_path / "i.txt").write_text(body)
        with pytest.raises(Exception):
            dump.read_multistream(spark, path, index).collect()


def test_cases_names_pairs(spark, tmp_path):
    (tmp_path / "c.txt").write_text("!! article\nX\n!! end\n!! test\nOne\n!! wikitext\na\n!! b !! c\n\n!! html/parsoid\nno\n!! html\n<p>a</p>\n!! end\n!! test\nTwo\n!! wikitext\n!! end\n")
    got = cases.read_cases(spark, str(tmp_path / "c.txt"))
    assert [tuple(r) for r in got.collect()] == [("One", "a\n!! b !! c", "<p>a</p>"), ("Two", "", None)]
    assert [r[0] for r in cases.wikitexts_of(got).collect()] == ["a\n!! b !! c"]
    (tmp_path / "n.txt").write_text("# no\n a \n\nb\n")
    assert [r[0] for r in cases.read_names(spark, str(tmp_path / "n.txt")).collect()] == ["a", "b"]
    pairs = tmp_path / "p"
    pairs.mkdir()
    (pairs / "A_b.wikitext").write_text("'''x'''")
    (pairs / "A_b.truth.txt").write_text("x")
    assert [tuple(r) for r in cases.read_pairs(spark, str(pairs)).collect()] == [("A_b", "'''x'''", "x")]
    (pairs / "C.wikitext").write_text("y")
    with pytest.raises(Exception):
        cases.read_pairs(spark, str(pairs)).collect()
    one = spark.createDataFrame([('{"query":{"random":[{"title":"A"},{"id":1},{"title":"B"}]}}',), ], "j string")
    assert one.select(cases.random_titles(F.col("j"))).first()[0] == ["A", "B"]
    with pytest.raises(Exception):
        spark.createDataFrame([("{}",)], "j string").select(cases.random_titles(F.col("j"))).collect()


def test_html_prose():
    assert cases.html_prose("<div>no<p>a <b>b</b><ul><li>c<li>d<p>e</ul><br>x") == "a b\nc\nde\ne\n"
    assert cases.html_prose("<blockquote>q<p>r</p></blockquote>&amp;") == "qr\nr\n"


def test_sample_dump_and_cli(spark, tmp_path, capsys):
    out = str(tmp_path / "s")
    dump.write_sample_dump(spark, out, "== A ==\n\nx & {{t}} <ref>y</ref>", 10)
    assert dump.read_dump(spark, out).count() == 10
    src = write(tmp_path / "d.xml", page("A", "clean") + page("B", "warned {{t}}") + page("C", "{|\n| colspan=2 | x\n|}") + page("Talk", "{{t}}", "1"))
    assert cli.main(["--input", src, "--stats"], spark) == 0
    assert "pages=3 clean=3 (100.0%) zero-diag=1 (33.3%) warned=1 unsupported=1" in capsys.readouterr().err
    assert cli.main(["--input", src, "--output", str(tmp_path / "o"), "--format", "jsonl", "--fail-on", "unsupported"], spark) == 1
    assert "1 pages fail" in capsys.readouterr().err
    rows = [json.loads(r.value) for r in spark.read.text(str(tmp_path / "o")).collect()]
    assert sorted(r["title"] for r in rows) == ["A", "B", "C"]
    assert cli.main(["--input", src, "--output", str(tmp_path / "t"), "--engine", "strip", "--one-file"], spark) == 0
    assert [r.value for r in spark.read.text(str(tmp_path / "t")).collect()] == ["clean", "warned", ""]
    capsys.readouterr()
    assert cli.main(["--input", src, "--output", "-", "--fail-on", "unsupported"], spark) == 1
    assert capsys.readouterr().out.splitlines() == ["clean", "warned", ""]
    assert cli.main(["--input", src, "--output", "-", "--title", "B", "--format", "markdown"], spark) == 0
    assert capsys.readouterr().out == "# B\n\nwarned\n\n"
    for bad in (["--format", "sections", "--engine", "strip"], ["--format", "markdown", "--stats"], ["--engine", "strip", "--fail-on", "warning"]):
        with pytest.raises(SystemExit):
            cli.main(["--input", src, "--output", "x", *bad], spark)


def test_stream(spark, tmp_path):
    src = str(tmp_path / "in")
    spark.createDataFrame([(0, "A", 0, False, "'''x'''"), (1, "B", 1, False, "y"), (2, "C", 0, False, "{{t}} z")], S.PAGES).write.parquet(src)
    q = S.write_lines(S.extracted(S.read_pages(spark, src)), str(tmp_path / "out"), str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(json.loads(r.value)["text"] for r in spark.read.text(str(tmp_path / "out")).collect()) == ["x", "z"]
    q = S.running_stats(S.read_pages(spark, src)).writeStream.format("memory").queryName("st").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("st").first().pages == 2


def test_scratch(spark, tmp_path, monkeypatch):
    """The folder that the session names is used, one of its own for each application; tables go when they are discarded."""
    import os

    from lexloom.sources import scratch

    def session(master, named):
        context = type("C", (), {"applicationId": "app", "master": master})
        return type("S", (), {"sparkContext": context, "conf": type("F", (), {"get": staticmethod(lambda *a: named)})})()

    monkeypatch.setattr(scratch, "_FOLDERS", {})
    with pytest.raises(ValueError):
        scratch.folder(session("spark://host:7077", None))
    named = scratch.folder(session("spark://host:7077", "hdfs://shared/dir/"))
    assert named.startswith("hdfs://shared/dir/lexloom-app-") and scratch.folder(session("spark://host:7077", None)) == named

    monkeypatch.setattr(scratch, "_FOLDERS", {spark.sparkContext.applicationId: str(tmp_path)})
    df = scratch.materialize(spark, spark.range(5))
    assert df.count() == 5 and len(os.listdir(tmp_path)) == 1
    scratch.discard(df)
    scratch.discard(spark.range(1))
    assert not [x for x in os.listdir(tmp_path) if not x.startswith(".")]


def test_spread(spark, tmp_path):
    """One row group is dealt to all cores; as many as there are cores stay where they are."""
    from lexloom.sources import tables

    cores = spark.sparkContext.defaultParallelism
    spark.range(100).coalesce(1).write.parquet(str(tmp_path / "one.parquet"))
    spark.range(100).repartition(cores).write.parquet(str(tmp_path / "many.parquet"))
    one, many = (tables.read(spark, str(tmp_path), t) for t in ("one", "many"))
    assert one.rdd.getNumPartitions() == cores and one.count() == many.count() == 100
    assert "RoundRobin" in one._jdf.queryExecution().toString() and "RoundRobin" not in many._jdf.queryExecution().toString()
