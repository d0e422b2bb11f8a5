"""Tables of the streams: what lands in a folder, and what each batch publishes."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder below the one named in spark.checkpoint.dir; a local one only where that is unset and all tasks run
    in this process."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="shelfmark-")
    return f"{base}/shelfmark/{name}-{uuid.uuid4().hex}"


def landed(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A stream of the files of a table that have landed in a folder."""
    schema = spark.read.parquet(f"{folder}/{name}.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(folder)


def batch_folder(folder: str, number: int) -> str:
    return f"{folder}/batches/{number:09d}"


def _file_system(spark: SparkSession, folder: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/batches")
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def published(spark: SparkSession, folder: str, start: DataFrame | None, before: int | None = None) -> DataFrame | None:
    """The table as the last whole batch (of those before a number) left it: a batch number's folder counts once its
    success marker is there."""
    files, path = _file_system(spark, folder)
    jvm = spark.sparkContext._jvm
    done = [s.getPath() for s in files.listStatus(path)] if files.exists(path) else []
    done = [p for p in done if files.exists(jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")) and (before is None or int(p.getName()) < before)]
    if not done:
        return start
    last = max(done, key=lambda p: p.getName())
    if start is None:
        return spark.read.parquet(last.toString())
    return spark.read.schema(start.schema).parquet(last.toString()).select(*(F.col(c) for c in start.columns))
