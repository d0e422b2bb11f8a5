"""Queries of the refresh streams, run over the stored tables until all that has landed is taken."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.plans.book import Book
from shelfmark.sources.catalog import FilesCatalog
from shelfmark.streaming import refresh
from shelfmark.streaming.tables import batch_folder, landed, published, scratch

BOOK = Book()


def _read(spark: SparkSession, d: str) -> DataFrame:
    return FilesCatalog(spark, d).read("events")


@BOOK.query("t1_refresh_stream", "SELECT user_id, max(ts_text) AS latest FROM (SELECT user_id, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS ts_text FROM events) GROUP BY user_id")
def refresh_stream(spark: SparkSession, d: str) -> DataFrame:
    """t2, t4: events as they land, upserted by user: the latest time wins, late rows change nothing."""
    folder = scratch(spark, "t1")
    events = landed(spark, d, "events").select("user_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("latest"))
    start = spark.createDataFrame([], events.schema)
    read = lambda: published(spark, folder, start)
    write = lambda df, number: df.write.mode("overwrite").parquet(batch_folder(folder, number))
    query = refresh.refresh_stream(events, read, write, ["user_id"], "latest", f"{folder}/checkpoint")
    query.awaitTermination()
    return published(spark, folder, start)


def _rings(spark: SparkSession, d: str) -> DataFrame:
    folder = scratch(spark, "t6")
    read = lambda number: published(spark, folder, None, number)
    write = lambda df, number: df.write.mode("overwrite").parquet(batch_folder(folder, number))
    refresh.latency_rings(landed(spark, d, "events").select("event_type", "ts", "event_id", "value"), read, write, f"{folder}/checkpoint").awaitTermination()
    start = spark.createDataFrame([], "event_type string, n long, ring array<struct<ts: timestamp_ntz, event_id: long, value: double>>")
    return published(spark, folder, start)


@BOOK.query("t6_latency_state", "SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def latency_state(spark: SparkSession, d: str) -> DataFrame:
    """The count of the state that t6_latency_estimates shows whole."""
    return _rings(spark, d).select("event_type", "n")


_LATEST = "SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS k FROM events"


@BOOK.query("t6_latency_estimates", f"SELECT event_type, count(*) AS n, round(greatest(5.0, sum(value) FILTER (k <= 10) / 10), 4) AS estimate FROM ({_LATEST}) GROUP BY event_type")
def latency_estimates(spark: SparkSession, d: str) -> DataFrame:
    """Each type's last 10 values kept as state by a stream, and the estimate over them."""
    return _rings(spark, d).select("event_type", "n", F.round(refresh.ring_estimate(F.col("ring")), 4).alias("estimate"))
