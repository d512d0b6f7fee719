"""Pages as a stream: extraction keeps no state, statistics are one running row."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from lexloom.operators import pages as P
from lexloom.sources import sinks

PAGES = "ord bigint, title string, namespace int, redirect boolean, text string"


def read_pages(spark: SparkSession, folder: str, files_per_trigger: int = 64) -> DataFrame:
    """Parquet files of pages as they arrive."""
    return spark.readStream.schema(PAGES).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def extracted(stream: DataFrame, engine: str = "ast", fmt: str = "jsonl") -> DataFrame:
    """(title, value) of each article of the stream."""
    return sinks.lines_of(sinks.extract(P.articles(stream), engine, fmt), fmt, "title")


def running_stats(stream: DataFrame) -> DataFrame:
    """The statistics so far; for output mode ``complete``."""
    return P.stats(sinks.extract(P.articles(stream)))


def write_lines(lines: DataFrame, folder: str, checkpoint: str) -> DataStreamWriter:
    return lines.select("value").writeStream.format("text").option("path", folder).option("checkpointLocation", checkpoint).outputMode("append")


def windowed_codes(stream: DataFrame, ts: str, every: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """(window, code, n): diagnostics by event time, late pages up to the watermark."""
    codes = P.with_parsed(stream.withWatermark(ts, late), ("diagnostics",)).select(ts, F.explode("parsed.diagnostics").alias("d"))
    return codes.groupBy(F.window(ts, every), F.col("d.code").alias("code")).agg(F.count("*").alias("n"))
