"""Refresh as a stream: landed site tuples and documents upserted batch by batch, and latencies kept as state."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from shelfmark.operators.refresh import upsert


def refresh_stream(incoming: DataFrame, read: Callable[[], DataFrame], write: Callable[[DataFrame, int], None], keys: list[str], newer: str, checkpoint: str) -> StreamingQuery:
    """Upsert every micro-batch into a stored table: later times win, late and repeated rows change nothing.

    write gets the batch number and must publish under it, so that a batch that runs again replaces its own result."""

    def merge(batch: DataFrame, number: int) -> None:
        write(upsert(read(), batch, keys, newer), number)

    return incoming.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest_values(batch: DataFrame, bucket: str, order: list[str], value: str, last: int) -> DataFrame:
    """(bucket, n, ring): how many rows each bucket has, and its latest rows. Both are cut down before the shuffle."""
    row = F.struct(*order, F.col(value).cast("double").alias("value"))
    rank = F.row_number().over(Window.partitionBy(bucket).orderBy(*(F.desc(c) for c in (*order, value))))
    rings = batch.withColumn("_rank", rank).where(F.col("_rank") <= last).groupBy(bucket).agg(F.lit(0).cast("long").alias("n"), F.collect_list(row).alias("ring"))
    return batch.groupBy(bucket).agg(F.count("*").alias("n")).withColumn("ring", F.array().cast(rings.schema["ring"].dataType)).unionByName(rings)


def latency_rings(log: DataFrame, read: Callable[[int], DataFrame | None], write: Callable[[DataFrame, int], None], checkpoint: str, bucket: str = "event_type", order: tuple[str, ...] = ("ts", "event_id"), value: str = "value", last: int = 10) -> StreamingQuery:
    """(bucket, n, ring): each bucket's number of rows and latest rows, in descending order, kept as a stored state.

    read gets the batch number and returns the state that the batches before it left, None at first; write must publish
    under the number, so that a batch that runs again replaces its own result and counts nothing twice."""

    def merge(batch: DataFrame, number: int) -> None:
        told, stored = latest_values(batch, bucket, list(order), value, last), read(number)
        told = told if stored is None else told.unionByName(stored)
        ring = F.slice(F.sort_array(F.flatten(F.collect_list("ring")), asc=False), 1, last)
        write(told.groupBy(bucket).agg(F.sum("n").alias("n"), ring.alias("ring")), number)

    return log.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def ring_estimate(ring: Column, last: int = 10) -> Column:
    """The sum of the latest values over last, 5 at least."""
    return F.greatest(F.lit(5.0), F.aggregate(ring, F.lit(0.0), lambda a, x: a + F.coalesce(x["value"], F.lit(0.0))) / last)


def requests_by_window(log: DataFrame, width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Requests and mean value in windows of event time, closed by a watermark."""
    timed = log.withColumn("ts", F.col("ts").cast("timestamp"))
    timed = timed.withWatermark("ts", late) if log.isStreaming else timed
    return timed.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean_value")).select(F.col("w.start").cast("timestamp_ntz").alias("w_start"), "event_type", "n", "mean_value")
