"""Tables between the steps of an operator, in the folder that all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_own_dirs: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; one of our own only where that is unset and all tasks run in this
    process (tests, a laptop).  On a cluster executors would not see such a folder, so there it is an error."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    context = spark.sparkContext
    if not re.fullmatch(r"local(\[.*\])?", context.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if context.applicationId not in _own_dirs:
        _own_dirs[context.applicationId] = "file://" + tempfile.mkdtemp(prefix="shelfmark-")
    return _own_dirs[context.applicationId]


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/shelfmark/{name}-{uuid.uuid4().hex}"


#: Shuffle files go as soon as the query that made them has ended.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_BATCH_ROWS, _BATCH_BYTES = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"


@contextmanager
def _settings(spark: SparkSession, **values: str) -> Iterator[None]:
    """The session's settings of these keys while a write runs; those before come back."""
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def materialize(df: DataFrame, name: str, batch_rows: int = 1000) -> DataFrame:
    """Write df as a Parquet table in the shared folder and read it back: a lost executor then never
    forces the steps before it to run again, and their results can't differ between two reads.

    The shuffle files of the steps before are removed with the write's end: the table stands for them.  Arrow batches
    of the write have few rows and bytes, as a row may hold a long text; the session's own limits come back."""
    spark = df.sparkSession
    path = new_folder(spark, name)
    with _settings(spark, **{_CLEANUP: "true", _BATCH_ROWS: str(batch_rows), _BATCH_BYTES: str(4 << 20)}):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete what materialize wrote, once nothing reads it any more."""
    for df in tables:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df.stored_at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_batches(df: DataFrame) -> DataFrame:
    """At most 1000 rows and 4 MB to an Arrow batch of the session's later queries, as a row may hold a long text.

    Results that are returned unread need this for as long as the caller has not read them; smaller limits stay."""
    conf = df.sparkSession.conf
    for key, most in ((_BATCH_ROWS, 1000), (_BATCH_BYTES, 4 << 20)):
        now = re.fullmatch("([0-9]+)b?", conf.get(key))
        if not now or not 0 < int(now[1]) <= most:
            conf.set(key, str(most))
    return df


def of_sample(key: Column, rows: int, total: int) -> Column:
    """Whether a row is of a hash fraction of about rows of total rows; the fraction is a share of 2**63, so that it is
    not empty for any number of rows."""
    return F.shiftrightunsigned(F.xxhash64(key, F.lit("sample")), 1) < F.lit(sample_bound(rows, total))


def sample_bound(rows: int, total: int) -> int:
    return (1 << 63) - 1 if rows >= total else (rows << 63) // total
