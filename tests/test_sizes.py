"""What larger and odder tables showed: shared folders with a scheme, pages without words, batches of any size."""

import bz2

import duckdb
import pyarrow as pa
import pytest

from lexloom.functions import arrow
from lexloom.operators import pages, parser, render, strip
from lexloom.sources import dump, scratch


def test_multistream_by_uri(spark, tmp_path):
    """A dump and its index in a folder named by a URI that is not there yet, written by several tasks and read again."""
    path = f"file://{tmp_path}/not there/d.xml.bz2"
    rows = spark.range(0, 47, numPartitions=3).selectExpr("concat('T:', id) AS title", "0 AS namespace", "false AS redirect", "concat('x é ', id) AS text")
    dump.write_multistream(rows, path, path + ".txt", 5)
    plain = f"{tmp_path}/not there/d.xml.bz2"
    raw = open(plain, "rb").read()
    assert scratch.size_of(path) == scratch.size_of(plain) == len(raw)
    assert bz2.decompress(raw).startswith(b"<mediawiki>\n<page>\n<title>T:0<") and bz2.decompress(raw).endswith(b"</page>\n</mediawiki>\n")
    index = [x.split(":", 2) for x in open(plain + ".txt", encoding="utf-8").read().splitlines()]
    assert [(int(n), title) for _, n, title in index] == [(k + 1, f"T:{k}") for k in range(47)]
    for at, _, title in index:  # each page is in the stream that its line names
        assert f"<title>{title}</title>".encode() in bz2.BZ2Decompressor().decompress(raw[int(at) :])
    assert [r.title for r in dump.read_multistream(spark, path, path + ".txt", range_bytes=100).orderBy("ord").collect()] == [f"T:{k}" for k in range(47)]


def test_file_systems():
    for path in ("/a b/c%20", "file:/a b/c%20", "file:///a b/c%20"):
        fs, inner = scratch.file_system(path)
        assert fs.type_name == "local" and inner == "/a b/c%20"


def test_multistream_index_by_uri(spark, tmp_path, monkeypatch):
    """The query finds its dump where the shared folder has a scheme."""
    from lexloom.plans.queries import QUERIES

    monkeypatch.setattr(scratch, "_FOLDERS", {spark.sparkContext.applicationId: f"file://{tmp_path}/shared"})
    got = QUERIES["multistream_index"](spark, "/root/testdata/sf0.001").first()
    assert (got.pages, got.contiguous, got.whole) == (200, True, True)


#: Documents without words: none, empty, blanks, signs only.
NO_WORDS = ((1, None), (2, ""), (3, "  \n"), (4, "!? <> [] {{ ''"), (5, "a word."))


@pytest.mark.parametrize("name", "jsonl_files parse_table_cells sections_files sql_functions strip_full strip_markup text_files text_files_strip markdown_pages parse_plain sections_exploded".split())
def test_documents_without_words(spark, tmp_path, name):
    """Queries give what their SQL says of documents without words."""
    from lexloom.plans.queries import ORACLE_SQL, QUERIES

    spark.createDataFrame(NO_WORDS, "doc_id bigint, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    got = QUERIES[name](spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    columns = ", ".join(f'"{c}"' for c in got.columns)
    want = con.execute(f"SELECT {columns} FROM ({ORACLE_SQL[name]})").fetchall()
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)


def test_line_ends_are_trimmed():
    """What the engine does where nothing follows a blank: it goes, and a reference that stands for it stays."""
    assert strip.strip("* item \nx") == "item\nx" and strip.strip("* item <u></u>\nx") == "item \nx"
    assert render.plain(parser.parse("{|\n| w \n|}").nodes) == "w" and render.plain(parser.parse("Lead&#32;").nodes) == "Lead "


def _pages() -> pa.Array:
    return pa.array([None, "", "a [[b|c]]", "é {{t}}\n\n* x\n** [http://e.example y]", "{|\n| a || b\n|}\n c\n== H ==\nz" + " w" * 40, None, "'''q'''"] * 9, pa.string())


def test_slices():
    """Every row is in one slice, in order; a slice is within the bound or one long text."""
    for column in (_pages(), _pages().slice(3, 30), pa.array([], pa.string()), pa.array([None, None], pa.string())):
        got = list(arrow.slices(column, 60))
        assert [t for x in got for t in x.to_pylist()] == column.to_pylist()
        assert all(len(x) == 1 or sum(len((t or "").encode()) for t in x.to_pylist()) <= 60 for x in got if len(column))


def test_no_batch_is_parsed_at_once(spark, monkeypatch):
    """All fields are the same however a batch is sliced, and parsed pages are held for a slice only."""
    fields = tuple(pages.FIELDS)
    run = pages.parse_udf(fields).func
    monkeypatch.setattr(arrow, "SLICE_BYTES", 1 << 20)
    whole = run(_pages())
    held = []
    text = pages._MAKE["text"]
    monkeypatch.setitem(pages._MAKE, "text", lambda ps: held.append(len(ps)) or text(ps))
    monkeypatch.setattr(arrow.slices, "__defaults__", (100,))
    cut = run(_pages())
    assert len(held) > 9 and sum(held) == len(_pages()) and max(held) < len(_pages())
    assert cut.type == whole.type and cut.to_pylist() == whole.to_pylist()
    assert arrow.texts(len, _pages(), pa.int64()).to_pylist() == [None if t is None else len(t) for t in _pages().to_pylist()]


def test_markdown_of_any_white_space_and_sign():
    """White space collapses and signs are escaped as character by character; no text is translated letter by letter."""
    assert {chr(i) for i in range(0x110000) if chr(i).isspace()} == set(strip.WS) | set(render._SEPARATORS)
    for s, want in (("", ""), (" ", " "), ("a\xa0\n b ", "a b "), ("\x1ca  b\x1f", "\x1ca b\x1f"), (" a\0", " a�"), ("\x85", " ")):
        assert render._collapse(s) == want
    assert render.escape("\\&<*_[]`|#", False, render.HEADING) == "\\\\&amp;&lt;\\*\\_\\[\\]\\`\\|\\#"
