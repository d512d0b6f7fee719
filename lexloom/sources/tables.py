"""Tables whose files give fewer tasks than there are cores."""

from __future__ import annotations

import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession

#: Bytes of files for each core from which a table has row groups enough and is not looked at.
BYTES_A_CORE = 128 << 20


def row_groups(files: list[str], enough: int) -> int:
    """Row groups of Parquet files, counted up to ``enough``."""
    n = 0
    for name in files:
        fs, path = pafs.FileSystem.from_uri(name)
        n += pq.read_metadata(path, filesystem=fs).num_row_groups
        if n >= enough:
            break
    return n


def spread(df: DataFrame) -> DataFrame:
    """``df``, a Parquet scan, with its rows dealt to all cores if its files have fewer row groups than there are cores, so
    that what is costly a row does not run in one task. A row group is the least that a task can read, whatever the
    split size. Large tables, and files that cannot be looked at, are left as they are: at scale nothing is shuffled."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    if int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) >= cores * BYTES_A_CORE:
        return df
    try:
        if row_groups(df.inputFiles(), cores) >= cores:
            return df
    except (OSError, ValueError, pa.ArrowException):
        return df
    return df.repartition(cores)


def read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    """A table of a folder of Parquet tables, spread over the cores."""
    return spread(spark.read.parquet(f"{folder}/{table}.parquet"))
