"""Tables and files between two steps, in the folder that all executors share."""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile
import uuid

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession

_FOLDERS: dict[str, str] = {}


def folder(spark: SparkSession) -> str:
    """This application's folder within that of ``spark.checkpoint.dir``; it is deleted when the program ends. Where the
    setting is missing, a temporary folder will do for a local master only: elsewhere executors would not share it."""
    app = spark.sparkContext.applicationId
    if app not in _FOLDERS:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named:
            _FOLDERS[app] = f"{named.rstrip('/')}/lexloom-{app}-{uuid.uuid4().hex[:8]}"
            atexit.register(_drop_quietly, spark, _FOLDERS[app])
        elif spark.sparkContext.master.startswith("local"):
            _FOLDERS[app] = tempfile.mkdtemp(prefix="lexloom-")
            atexit.register(shutil.rmtree, _FOLDERS[app], ignore_errors=True)
        else:
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return _FOLDERS[app]


def new_path(spark: SparkSession) -> str:
    return f"{folder(spark)}/{uuid.uuid4().hex}"


def file_system(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path and the path within it. A path is as Hadoop has it, plain or with a scheme (``file:/x``,
    ``file:///x``, ``hdfs://…``), and its characters are not escaped."""
    if m := re.match(r"file:(?://[^/]*)?(/.*)", path, re.S):
        return pafs.LocalFileSystem(), m.group(1)
    if re.match(r"[A-Za-z][A-Za-z0-9+.-]*://", path):
        return pafs.FileSystem.from_uri(path)
    return pafs.LocalFileSystem(), os.path.abspath(path)


def size_of(path: str) -> int:
    """Bytes of a file."""
    fs, inner = file_system(path)
    info = fs.get_file_info(inner)
    if not info.is_file:
        raise FileNotFoundError(path)
    return info.size


def open_file(path: str):
    """A file to read, as its bytes are."""
    fs, inner = file_system(path)
    return fs.open_input_stream(inner, compression=None)


def create(path: str):
    """A new file to write, in a folder that is made if need be."""
    fs, inner = file_system(path)
    fs.create_dir(os.path.dirname(inner), recursive=True)
    return fs.open_output_stream(inner, compression=None)


def files_of(path: str) -> list[str]:
    """The part files that Spark wrote into a folder, in the order of its tasks."""
    fs, inner = file_system(path)
    names = sorted(x.base_name for x in fs.get_file_info(pafs.FileSelector(inner)) if x.is_file and x.base_name.startswith("part-"))
    return [f"{path}/{x}" for x in names]


def drop(spark: SparkSession, path: str) -> None:
    """Delete a path, on whatever file system it is."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def _drop_quietly(spark: SparkSession, path: str) -> None:
    try:
        drop(spark, path)
    except Exception:  # the JVM may be gone by now; then the folder stays, as it does after a crash
        pass


def materialize(spark: SparkSession, df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it again: later jobs start from files that
    outlive any executor, and nothing upstream is computed twice."""
    path = new_path(spark)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._lexloom_path = path
    return out


def discard(df: DataFrame | None) -> None:
    """Delete the files of a table of :func:`materialize` that no later step reads; nothing else is touched."""
    path = getattr(df, "_lexloom_path", None)
    if path:
        drop(df.sparkSession, path)
