"""Every operator and pipeline stage on NULLs, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lexloom.llm import ann, decontaminate, html_extract, language_id, line_dedup, near_dedup, packing, pii, quality, url_filter

SF = "/root/testdata/sf0.001"
EXTRA = "n long, v string, u int, key string, s array<int>, row string, parts string, hkey string, line string, removed_words string, group_id string, label string, keep string, piece string, window_id string, `a.b` string"
DOCS = f"doc_id long, text string, lang string, source string, n_chars long, {EXTRA}"
TAIL = (None,) * 16
WORDS = " ".join(f"word{i % 977} and some more" for i in range(30_000))
ROWS = [
    (1, None, None, None, None, *TAIL),
    (2, "", "en", "a", 0, *TAIL),
    (None, "the cat sat on the mat today", "en", "a", 28, *TAIL),
    (None, None, None, None, None, *TAIL),
    (3, WORDS, "en", "a", len(WORDS), *TAIL),
    (4, WORDS, "en", "a", len(WORDS), *TAIL),
    (5, " \n\t ", "de", "b", 4, *TAIL),
    (6, "the cat sat on the mat today", "en", "a", 28, *TAIL),
    (6, "the cat sat on the mat today", "en", "a", 28, *TAIL),
    (7, "☕" * 50_000, "xx", "c", 50_000, *TAIL),
    (8, "x", "en", "c", 1, *TAIL),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(3, 1, 0), (8, 0, 0), (8, 1, 0), (6, None, None), (None, 1, 1), (7, 0, 1), (99, 1, 0)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([(1, "the cat sat on the mat today"), (1, "the cat sat on the mat today"), (None, "x y z"), (2, None), (3, "")], "item_id long, text string")


def test_pii(spark, docs, none):
    more = docs.union(docs.where("doc_id = 8").withColumn("text", F.lit("mail a.b@example.com now")))
    got = pii.find_pii(spark, more).collect()
    assert [(r.doc_id, r.kind, r.span) for r in got] == [(8, "EMAIL", "a.b@example.com")]
    assert pii.find_pii(spark, none).count() == 0


def test_near_dedup(spark, docs, none):
    got = {(r.doc_id, r.group_id, r.group_size, r.kept) for r in near_dedup.near_groups(spark, docs).collect()}
    assert got == {(3, 3, 2, True), (4, 3, 2, False)}
    left = near_dedup.drop_near_duplicates(spark, docs)
    assert left.columns == docs.columns and left.count() == len(ROWS) - 1
    assert near_dedup.near_groups(spark, none).count() == 0 == near_dedup.drop_near_duplicates(spark, none).count()


def test_urls(spark):
    rows = [(1, None, "x"), (2, "", "x"), (None, "http://u@news.example.org:80/a?b#c", "x"), (3, "http://cheap-pills-online.example.com/buy", None), (3, "http://cheap-pills-online.example.com/buy", None), (4, "h" * 200_000, None)]
    df = spark.createDataFrame(rows, "page_id long, url string, host string").withColumn("path", F.lit(1))
    got = [(r.page_id, r.host, r.keep) for r in url_filter.filter_urls(spark, df).collect()]
    assert got[:2] == [(1, "", False), (2, "", False)] and got[2] == (None, "news.example.org", True)
    assert [g[2] for g in got[3:5]] == [False, False] and len(got) == 6
    assert url_filter.filter_urls(spark, df.where("page_id = 0")).count() == 0


def test_ann(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [0.0, 0.0]), (2, [0.0, 0.0]), (3, [3.0, 4.0]), (3, [3.0, 4.0]), (4, None), (None, [1.0, 1.0]), (5, [1.0]), (6, [nan, 0.0]), (7, [inf, 0.0]), (8, [None, 0.0]), (9, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("part", F.lit(1)).withColumn("v", F.lit("x"))
    got = {r.vec_id: (r.neighbours, r.distances) for r in ann.nearest(spark, df, k=2).collect()}
    assert got == {1: ([2, 3], [0.0, 5.0]), 2: ([1, 3], [0.0, 5.0]), 3: ([1, 2], [5.0, 5.0])}
    assert ann.nearest(spark, df.where("vec_id = 0")).count() == 0


def test_line_dedup(spark, docs, none):
    got = line_dedup.dedup_lines(spark, docs)
    assert got.columns == [c for c in docs.columns if c != "removed_words"] + ["removed_words"]
    rows = got.select("doc_id", "text", "n_chars").collect()
    assert sorted((r.doc_id or -1, len(r.text or "")) for r in rows) == sorted((r[0] or -1, len(r[1] or "")) for r in ROWS if r[0] != 4)
    assert line_dedup.dedup_lines(spark, none).count() == 0


def test_language(spark, docs, none):
    got = language_id.identify(spark, docs).collect()
    assert len(got) == len(ROWS)
    assert all(r.language is None and r.ambiguous and r.gap == 0 for r in got if r.doc_id in (1, 2, 5))
    assert language_id.identify(spark, none).count() == 0
    assert {r.language for r in language_id.identify(spark, docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {None}


def test_packing(spark, docs, none):
    got = packing.pack(spark, docs, capacity=2048).collect()
    pieces = [(p.doc_id, p.start, p.length) for w in got for p in w.pieces]
    tokens = sum(len((r[1] or "").split()) for r in ROWS)
    assert sum(p[2] for p in pieces) == tokens == sum(w.n_tokens for w in got) and all(0 < w.n_tokens <= 2048 for w in got)
    assert packing.pack(spark, none).count() == 0
    with pytest.raises(ValueError):
        packing.pack(spark, docs, capacity=0)


def test_decontamination(spark, docs, none, items):
    got = decontaminate.contaminated(spark, docs, items).collect()
    assert [tuple(r) for r in got] == [(6, 1, 1.0)]
    left = decontaminate.decontaminate(spark, docs, items)
    assert left.columns == docs.columns and left.count() == len(ROWS) - 3  # the row without an id goes too
    for d, b in ((none, items), (docs, items.where("item_id = 9"))):
        assert decontaminate.contaminated(spark, d, b).count() == 0
        assert decontaminate.decontaminate(spark, d, b).count() == d.count()


def test_html(spark):
    same = "<html><body><div class=menu>Home About</div><p>{}</p></body></html>"
    rows = [(1, "http://a.example/1", same.format("One.")), (2, "http://a.example/2", same.format("Two.")), (9, "http://c.example/2", same.format("Two.")), (9, "http://c.example/2", same.format("Two.")), (3, None, None), (None, "nohost", "<p>x<p>y & &lt;"), (4, "http://a.example/3", ""), (5, "http://b.example", "<div>" * 3000 + "deep" + "<" * 1000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit(1)).withColumn("drop", F.lit(2))
    got = html_extract.extract(spark, df).collect()
    text = {r.page_id: r.text for r in got}
    assert len(got) == 8 and text[1] == "One." and text[9] == "Home About\nTwo." and text[3] == "" and text[None] == "x\ny & <" and text[4] == "" and text[5].startswith("deep")
    assert html_extract.extract(spark, df.where("page_id = 0")).count() == 0


def test_html_copies(spark):
    page = "<html><body><div class=menu>Home About</div>{}</body></html>"
    article = page.format("<h1>Title</h1><p>First of it.</p><p>Second of it.</p><ul><li>End.</li></ul>")
    rows = [(1, "http://a.example/1", article), (2, "https://a.example/1?utm=2", article), (3, "http://a.example/3", page.format("<p>Three.</p>")), (4, "http://a.example/4", page.format("<p>Four.</p>")), (3, "http://a.example/3", page.format("<p>Three.</p>"))]
    rows += [(5, "http://b.example/1", article), (6, "http://b.example/m/1", article)]
    text = {r.page_id: r.text for r in html_extract.extract(spark, spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    body = "Title\nFirst of it.\nSecond of it.\nEnd."
    assert text[1] == text[2] and text[1].endswith(body) and text[3] == "Three." and text[4] == "Four."
    assert text[5] == text[6] and text[5].endswith(body)


def test_quality(spark, docs, none, labels):
    got = quality.classify(spark, docs, labels).collect()
    assert len(got) == len(ROWS) and all(r.label == "low" and not r.keep for r in got if r.doc_id in (1, 2))
    assert quality.classify(spark, none, labels).count() == 0
    assert all(r.label == "good" for r in quality.classify(spark, docs, labels.where("doc_id = 0")).collect() if r.doc_id not in (1, 2, None))
    assert quality.keep_good(spark, docs, labels).columns == docs.columns


@pytest.mark.parametrize("k", range(5))
def test_stages(spark, docs, none, k):
    stage = corpus_pipeline.STAGES[k][1]
    for d in (docs, none):
        out = stage(spark, d, SF)
        out.collect()
        if k < 4:
            assert out.columns == d.columns
            kept = stage(spark, d.withColumn("removed_words", F.lit("77")), SF).select("removed_words").distinct().collect()
            assert [r[0] for r in kept] in ([], ["77"])


@pytest.mark.parametrize("table", ["labels", "benchmark"])
def test_stages_without_labels_or_items(spark, docs, tmp_path, table):
    kinds = {"labels": "doc_id long, quality int, toxic int", "benchmark": "item_id long, text string"}
    spark.createDataFrame([], kinds[table]).write.parquet(f"{tmp_path}/{table}.parquet")
    k = 0 if table == "labels" else 3
    got = corpus_pipeline.STAGES[k][1](spark, docs, str(tmp_path))
    assert got.count() == (len(ROWS) - 3 if k == 0 else len(ROWS))  # texts that are NULL or empty are not good
