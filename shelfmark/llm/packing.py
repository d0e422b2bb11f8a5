"""Hierarchical residual packing of tokenized documents into sequences of bounded length.

Texts are cut only where they are longer than a sequence; pieces that fill a sequence are sequences of their own.  The
rest are dealt to partitions of about ``leaf_rows`` items, each packed by best fit, longest first.  Nearly full bins
are done, and so is every bin with which not even the least open bin would fit: no later round could join it.  The
other underfull bins go on as items to a round with as few partitions as their number needs, and so on up the tree
until one partition is left.  From the second round on, bins are dealt by the space that they lack or fill, so that a
small bin meets the large ones that it fits.  A round over several partitions that joins no bin ends the tree, or one
that joins less than ``least_gain`` of them where the caller asks for that.

Rows: a null text packs as the empty text (its end token alone); repeated rows are packed each; equal lengths are
taken in the order of (doc_id, piece, start); a text of any length is read whole; further columns are ignored; an
empty table gives an empty table.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import bpe, class_table, vocabulary_path
from .shared import bounded_batches, materialize, table
from .textcols import slices, utf8

PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(df: DataFrame, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """Token pieces of all texts, each text followed by end_id.  Of a text longer than capacity all pieces but the
    first are full."""
    path, classes = path or vocabulary_path(), class_table()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = bpe(path, classes)
        for batch in slices(batches, "text"):
            ids, ends = coder.encode_batch(*utf8(batch.column("text")))
            docs = batch.column("id").to_pylist()
            out: list[tuple] = []
            little, tail = memoryview(ids.astype("<u4").tobytes()), end_id.to_bytes(4, "little")
            for doc, a, b in zip(docs, ends[:-1].tolist(), ends[1:].tolist()):
                n = b - a + 1
                body = little[4 * a : 4 * b]
                first = n if n <= capacity else n % capacity or capacity
                for k, start in enumerate([0, *range(first, n, capacity)]):
                    size = first if k == 0 else capacity
                    crc = zlib.crc32(body[4 * start : 4 * (start + size)])
                    out.append((doc, k, start, size, zlib.crc32(tail, crc) if start + size == n else crc))
            cols = list(zip(*out))
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return bounded_batches(df).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, PIECE)


def best_fit(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each item: longest first, each into the fullest bin that has room.

    Bins are kept by their free space; one bit for each amount of free space in use finds the least that is enough."""
    order = np.argsort(-sizes, kind="stable")
    bins, offsets = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64)
    free: list[list[int]] = [[] for _ in range(capacity + 1)]
    used, n = 0, 0
    for item, size in zip(order.tolist(), sizes[order].tolist()):
        enough = used >> size
        if enough:
            room = size + (enough & -enough).bit_length() - 1
            b = free[room].pop()
            if not free[room]:
                used ^= 1 << room
        else:
            room, b, n = capacity, n, n + 1
        bins[item], offsets[item] = b, capacity - room
        left = room - size
        if left:
            free[left].append(b)
            used |= 1 << left
    return bins, offsets


def pack(items: DataFrame, capacity: int = 2048, nearly: float = 0.98, leaf_rows: int = 50_000, least_gain: float = 0.0) -> DataFrame:
    """items (doc_id, piece, start, length, ids_crc32) with sequence_id and offset.

    least_gain: a round over several partitions that joins no more than this share of the open bins is the last one; 0,
    the default, goes on for as long as any bin is joined."""
    items = materialize(items, "pieces")
    schema = PIECE + ", sequence_id long, offset long, fill long, done boolean"
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "fill", "done"]
    placed = names[:7]
    full = items.where(F.col("length") == capacity).withColumns({"sequence_id": F.monotonically_increasing_id(), "offset": F.lit(0).cast("long")})
    open_items = items.where(F.col("length") < capacity).withColumns({"sequence_id": F.lit(None).cast("long"), "offset": F.lit(0).cast("long"), "fill": F.col("length")})
    finished = [full]
    level, count = 1, open_items.count()

    def round_of(level: int, last: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            rows = pa.Table.from_batches(batches) if (batches := list(batches)) else None
            if rows is None or not rows.num_rows:
                return
            # The order of rows after a shuffle may differ when a task runs again; this one may not
            rows = rows.sort_by([("sequence_id", "ascending"), ("offset", "ascending"), ("doc_id", "ascending"), ("piece", "ascending"), ("start", "ascending"), ("ids_crc32", "ascending")])
            size = rows.column("length").to_numpy()
            if level == 1:
                item, total = np.arange(len(size)), size
            else:
                _, item = np.unique(rows.column("sequence_id").to_numpy(), return_inverse=True)
                total = np.bincount(item, size).astype(np.int64)
            bins, offsets = best_fit(total, capacity)
            fill = np.bincount(bins, total)
            sequence = (np.int64(level) << 54) + (np.int64(TaskContext.get().partitionId()) << 30) + bins
            done = np.full(len(fill), True) if last else fill >= nearly * capacity
            moved = rows.column("offset").to_numpy() + offsets[item]
            cols = [*(rows.column(c) for c in names[:5]), pa.array(sequence[item]), pa.array(moved), pa.array(fill[bins][item].astype(np.int64)), pa.array(done[bins][item])]
            yield from pa.table(cols, names).to_batches(max_chunksize=50_000)

        return run

    while count:
        parts = -(-count // leaf_rows)
        open_items = open_items.select(*placed, "fill")
        if level == 1:
            dealt = open_items.withColumn("_row", F.monotonically_increasing_id()).repartition(parts, "_row")  # repeated rows part, too
        else:
            lacked = F.least("fill", F.lit(capacity) - F.col("fill"))
            dealt = open_items.repartitionByRange(parts, lacked, F.xxhash64("sequence_id")) if parts > 1 else open_items.repartition(1)
        after = materialize(dealt.select(*placed).mapInArrow(round_of(level, parts == 1), schema), f"pack-{level}")
        if parts == 1:
            finished.append(after)
            break
        least = after.where("not done").agg(F.min("fill")).first()[0] or 0
        ends = F.col("done") | (F.col("fill") + least > capacity)
        bins = after.groupBy("sequence_id").agg(F.first("fill").alias("fill"), F.first("done").alias("done")).agg(F.count("*").alias("n"), F.count_if(~ends).alias("left")).first()
        stop = level > 1 and count - bins.n <= least_gain * count
        finished.append(after if stop else after.where(ends))
        open_items = after.where(~ends)
        level, count = level + 1, 0 if stop else bins.left
    out = finished[0].select(*placed)
    for df in finished[1:]:
        out = out.unionByName(df.select(*placed))
    return out


def op5_residual_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(pieces(table(spark, sf_dir, "documents")))


QUERIES = {"op5_residual_packing": op5_residual_packing}
ORACLES: dict[str, str] = {}
