"""Sources of pages: XML dumps, plain or bz2, and multistream dumps by their index.

Any malformed page fails the read; none is skipped. The checks sit in the columns that every
query uses (namespace and text), so that pruning cannot take them away.
"""

from __future__ import annotations

import bz2
import io
import shutil
import uuid
from collections.abc import Iterator

from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from lexloom.sources import scratch

RAW = "title string, ns string, redirect struct<_title:string>, revision array<struct<text:array<string>>>"
PAGES = "ord bigint, title string, namespace int, redirect boolean, text string"
#: Compressed bytes that one task of an indexed read decodes.
RANGE_BYTES = 32 << 20
#: Bytes that the driver holds while it appends files.
COPY_BYTES = 4 << 20


def _checked(raw: DataFrame) -> DataFrame:
    """Pages of raw XML rows; more than one text, or no readable namespace, is an error."""
    texts = F.flatten(F.transform(F.coalesce("revision", F.array().cast("array<struct<text:array<string>>>")), lambda r: F.coalesce(r["text"], F.array().cast("array<string>"))))
    ns = F.regexp_replace("ns", r"^\p{IsWhite_Space}+|\p{IsWhite_Space}+$", "").try_cast("int")
    title = F.coalesce("title", F.lit(""))
    bad_ns = F.raise_error(F.concat(F.lit("page without a readable namespace: "), title)).cast("int")
    bad_text = F.raise_error(F.concat(F.lit("page with more than one text, as a dump of full history has: "), title)).cast("string")
    return raw.select(
        "ord",
        title.alias("title"),
        F.when(F.size(texts) > 1, bad_text.cast("int")).when(ns.isNull(), bad_ns).otherwise(ns).alias("namespace"),
        F.col("redirect").isNotNull().alias("redirect"),
        F.when(F.size(texts) > 1, bad_text).otherwise(F.coalesce(F.try_element_at(texts, F.lit(1)), F.lit(""))).alias("text"),
    )


def read_dump(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Pages of ``.xml`` or ``.xml.bz2`` files, in dump order by ``ord``. One task per file: XML cannot be split,
    so a large dump should come as several files or with its index (:func:`read_multistream`)."""
    reader = spark.read.format("xml").schema(RAW).option("rowTag", "page").option("mode", "FAILFAST").option("ignoreSurroundingSpaces", "false").option("nullValue", "\u0001")
    return _checked(reader.load(path).withColumn("ord", F.monotonically_increasing_id()))


def pages_of_xml(spark: SparkSession, xml: DataFrame, column: str = "xml") -> DataFrame:
    """Pages of a column with one ``<page>`` element a row."""
    parsed = xml.select(F.monotonically_increasing_id().alias("ord"), F.from_xml(column, RAW, {"mode": "FAILFAST", "ignoreSurroundingSpaces": "false"}).alias("p"))
    return _checked(parsed.select("ord", "p.*"))


# ---------------------------------------------------------------- multistream


def offsets_of(spark: SparkSession, index_path: str) -> DataFrame:
    """The distinct stream offsets of an index (lines ``offset:page:title``, plain or bz2); a line without one is an error."""
    raw = spark.read.text(index_path).where(F.trim("value") != "").select(F.substring_index("value", ":", 1).alias("f"))
    bad = F.raise_error(F.concat(F.lit("index line without an offset: "), F.col("f"))).cast("bigint")
    n = F.when(F.col("f").rlike(r"^\+?[0-9]+$"), F.col("f").try_cast("bigint"))
    return raw.select(F.coalesce(n, bad).alias("offset")).distinct()


def multistream_ranges(spark: SparkSession, index_path: str, dump_bytes: int) -> DataFrame:
    """(start, end) of each stream: from 0, between the offsets, to the end of the dump. An empty index, or an
    offset beyond the dump, is an error."""
    offsets = offsets_of(spark, index_path)
    n, last = offsets.agg(F.count("*"), F.max("offset")).first()
    if not n:
        raise ValueError("the index has no offsets")
    if last >= dump_bytes:
        raise ValueError(f"offset {last} is beyond the dump's {dump_bytes} bytes")
    return ranges_of(offsets.union(spark.range(1).select(F.lit(0).cast("bigint"))).distinct(), dump_bytes)


def ranges_of(offsets: DataFrame, dump_bytes: int) -> DataFrame:
    from pyspark.sql import Window

    # an index is some hundred thousand offsets, one per hundred pages: a single ordered window is small
    end = F.lead("offset", 1, dump_bytes).over(Window.orderBy("offset"))
    return offsets.select(F.col("offset").alias("start"), end.alias("end"))


class _Range(InputPartition):
    def __init__(self, number: int, start: int, end: int):
        self.number, self.start, self.end = number, start, end


class MultistreamSource(DataSource):
    """``spark.read.format("wikitext_multistream")``: one task for each group of streams. Options: path, and starts,
    the stream offsets separated by commas. Rows are (ord, xml), an element ``<page>`` each."""

    @classmethod
    def name(cls) -> str:
        return "wikitext_multistream"

    def schema(self) -> str:
        return "ord bigint, xml string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"], [int(x) for x in self.options["starts"].split(",")], int(self.options.get("rangebytes", RANGE_BYTES)))


class _Reader(DataSourceReader):
    def __init__(self, path: str, starts: list[int], range_bytes: int):
        self.path, self.range_bytes = path, range_bytes
        self.starts = sorted({0, *starts})

    def partitions(self) -> list[InputPartition]:
        out, total, begin = [], scratch.size_of(self.path), 0
        for end in [*self.starts[1:], total]:
            if end - begin >= self.range_bytes or end == total:
                out.append(_Range(len(out), begin, end))
                begin = end
        return out

    def read(self, partition: _Range) -> Iterator[tuple[int, str]]:
        data = decode_range(self.path, partition.start, partition.end)
        for k, page in enumerate(split_pages(data)):
            yield (partition.number << 40) + k, page


def decode_range(path: str, start: int, end: int) -> bytes:
    """The text of the bz2 streams in a range of bytes; a damaged or cut-off stream is an error that names the range."""
    fs, inner = scratch.file_system(path)
    with fs.open_input_file(inner) as f:
        raw = f.read_at(end - start, start)
    out = io.BytesIO()
    try:
        while raw:
            one = bz2.BZ2Decompressor()
            out.write(one.decompress(raw))
            if not one.eof:
                raise EOFError("the stream ends early")
            raw = one.unused_data
    except (OSError, EOFError, ValueError) as e:
        raise ValueError(f"{path}: bytes {start} to {end} cannot be decoded: {e}") from e
    return out.getvalue()


def split_pages(data: bytes) -> Iterator[str]:
    """Each page element. Text cannot hold a literal tag, so the markers are exact; an unclosed page is an error."""
    at = 0
    while (i := data.find(b"<page", at)) >= 0:
        if data[i + 5 : i + 6] not in (b">", b" ", b"\n", b"\t", b"\r"):
            at = i + 5
            continue
        j = data.find(b"</page>", i)
        if j < 0:
            raise ValueError("a page is cut off")
        at = j + 7
        yield data[i:at].decode("utf-8")


def read_multistream(spark: SparkSession, dump_path: str, index_path: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Pages of a multistream ``.bz2`` dump, decoded in parallel by its index; the same pages as :func:`read_dump`."""
    spark.dataSource.register(MultistreamSource)
    starts = [r[0] for r in multistream_ranges(spark, index_path, scratch.size_of(dump_path)).select("start").collect()]
    raw = spark.read.format("wikitext_multistream").option("path", dump_path).option("starts", ",".join(map(str, starts))).option("rangeBytes", str(range_bytes)).load()
    parsed = raw.select("ord", F.from_xml("xml", RAW, {"mode": "FAILFAST", "ignoreSurroundingSpaces": "false"}).alias("p"))
    return _checked(parsed.select("ord", "p.*"))


# ---------------------------------------------------------------- made-up dumps


def xml_escape(c):
    return F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def page_xml(title, namespace, redirect, text):
    """A ``<page>`` element of columns."""
    target = F.when(redirect, F.lit('<redirect title="x" />')).otherwise("")
    return F.concat(F.lit("<page>\n<title>"), xml_escape(title), F.lit("</title>\n<ns>"), namespace.cast("string"), F.lit("</ns>\n"), target, F.lit('<revision>\n<text xml:space="preserve">'), xml_escape(text), F.lit("</text>\n</revision>\n</page>"))


def write_sample_dump(spark: SparkSession, path: str, text: str, copies: int, title: str = "Article") -> None:
    """A folder of dump files with ``copies`` pages of one article, each file well-formed."""
    rows = spark.range(copies).select(F.concat(F.lit(title + " "), F.col("id").cast("string")).alias("title"), F.lit(0).alias("namespace"), F.lit(False).alias("redirect"), F.lit(text).alias("text"))
    write_dump(rows, path)


def write_dump(pages: DataFrame, path: str, compression: str = "none") -> None:
    """A folder of dump files with ``pages`` (title, namespace, redirect, text), each file well-formed."""

    def wrap(batches):
        import pyarrow as pa

        kind = pa.schema([("value", pa.string())])
        yield pa.record_batch([["<mediawiki>"]], kind)
        for b in batches:
            yield pa.record_batch([b.column(0)], kind)
        yield pa.record_batch([["</mediawiki>"]], kind)

    rows = pages.select(page_xml(F.col("title"), F.col("namespace"), F.col("redirect"), F.col("text")).alias("value"))
    rows.mapInArrow(wrap, "value string").write.mode("overwrite").option("compression", compression).text(path)


def write_multistream(pages: DataFrame, dump_path: str, index_path: str, pages_a_stream: int = 100) -> None:
    """A multistream ``.bz2`` dump and its index, each one file of any file system. Tasks compress their streams into files
    of the shared folder and say how long they are; the driver appends the files, a few MB at a time, and no row of a page
    reaches it."""
    spark = pages.sparkSession
    parts, lines = scratch.new_path(spark), scratch.new_path(spark)

    def compress(batches):
        import pyarrow as pa

        fs, folder = scratch.file_system(parts)
        fs.create_dir(folder, recursive=True)
        file = f"{uuid.uuid4().hex}.bz2"  # of this attempt: only the rows of one that succeeds name theirs
        number, at, before = TaskContext.get().partitionId(), 0, 0
        rows: list[str] = []
        titles: list[str] = []

        def stream(out):
            nonlocal at, before
            packed = bz2.compress("".join(x + "\n" for x in rows).encode("utf-8"))
            out.write(packed)
            told = pa.record_batch([pa.array([number]), pa.array([file]), pa.array([at]), pa.array([at + len(packed)]), pa.array([before]), pa.array([titles], pa.list_(pa.string()))], names=["part", "file", "start", "end", "before", "titles"])
            at, before = at + len(packed), before + len(titles)
            rows.clear()
            titles.clear()
            return told

        with fs.open_output_stream(f"{folder}/{file}", compression=None) as out:
            for b in batches:
                for title, xml in zip(b.column(0), b.column(1)):  # one page at a time as a Python object
                    titles.append(title.as_py())
                    rows.append(xml.as_py())
                    if len(rows) == pages_a_stream:
                        yield stream(out)
            if rows:
                yield stream(out)

    xml = pages.select("title", page_xml(F.col("title"), F.col("namespace"), F.col("redirect"), F.col("text")).alias("x"))
    told = scratch.materialize(spark, xml.mapInArrow(compress, "part bigint, file string, start bigint, end bigint, before bigint, titles array<string>"))
    head, tail = bz2.compress(b"<mediawiki>\n"), bz2.compress(b"</mediawiki>\n")
    files = told.groupBy("part", "file").agg(F.max("end").alias("bytes"), F.sum(F.size("titles")).alias("pages")).orderBy("part").collect()
    bases, at, before = [], len(head), 0
    for f in files:
        bases.append((f.part, at, before))
        at, before = at + f.bytes, before + f.pages
    with scratch.create(dump_path) as data:
        data.write(head)
        for f in files:
            with scratch.open_file(f"{parts}/{f.file}") as part:
                shutil.copyfileobj(part, data, COPY_BYTES)
        data.write(tail)
    base = F.broadcast(spark.createDataFrame(bases, "part bigint, at bigint, pages bigint"))
    streams = told.join(base, "part").orderBy("part", "start").select((F.col("at") + F.col("start")).alias("offset"), (F.col("pages") + F.col("before") + 1).alias("first"), "titles")
    entries = streams.select("offset", "first", F.posexplode("titles").alias("k", "title"))
    entries.select(F.concat_ws(":", "offset", F.col("first") + F.col("k"), "title").alias("value")).write.text(lines)
    with scratch.create(index_path) as index:
        for name in scratch.files_of(lines):
            with scratch.open_file(name) as part:
                shutil.copyfileobj(part, index, COPY_BYTES)
    for path in (parts, lines):
        scratch.drop(spark, path)
    scratch.discard(told)
