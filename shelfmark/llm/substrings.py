"""Removal of repeated word sequences by super-k-mer partitioning.

A window is 13 consecutive words of one document.  Its minimiser is the least hash of its word pairs; consecutive
windows with one minimiser travel as one packed string to the minimiser's bucket.  There each distinct string is cut
into its windows, sorting brings equal windows together, and a window's first document is the smallest doc_id among
them.  A window that starts in a document with a smaller doc_id is removed from the later ones.

Three things keep buckets small: a mapper sends each distinct string once, with its smallest and largest doc_id; the
number of buckets follows the size of the texts; and the windows of a bucket that is still too large are strings of
their own, which Spark groups with a map-side combination of their smallest and largest doc_id, so that a window that
stands nearly everywhere reaches its group once from each mapper.  Which buckets are too large is told to the mappers
by a table of MARKS bits, whatever the number of buckets; a bucket that shares a large one's bit is treated like it,
which changes no result.  The verdict on a string concerns its first document (a bit for each window) and all other
documents alike (every window), so it goes back by a join on the string's hash, which Spark can split where a string
is very frequent.

Rows: a null text has no words; a null doc_id is kept whole and is no earlier document; rows of one doc_id are told
apart by a 64-bit hash of their texts and are not earlier than one another; repeated rows (equal in doc_id and text)
get equal results; texts of any length are read whole; other columns are kept (but for the operator's own names); an
empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import bounded_batches, materialize, table
from .textcols import joined_words, mix, slices, utf8, word_bounds, word_hashes

WINDOW = 13
MOST_WINDOWS = 62  # of a packed string: their bits fit in a long
BUCKET_WINDOWS = 250_000
MARKS = 1 << 16  # bits that tell mappers which buckets are too large


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    out, have = x, 1
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[:-step], out[step:])
        have += step
    return out


class _Strings:
    """Super-k-mers of a run of documents: row, pos (first window's place in its document), n (windows), bucket, alone
    (a single window of a bucket marked in hot), and the word range of each."""

    def __init__(self, column: pa.Array, buckets: int, hot: np.ndarray):
        data, offsets = utf8(column)
        self.data = data
        self.starts, self.ends, self.first = word_bounds(data, offsets)
        per_row = np.maximum(np.diff(self.first) - (WINDOW - 1), 0)
        self.n_windows = int(per_row.sum())
        if not self.n_windows:
            self.row = self.pos = self.n = self.bucket = self.at = np.zeros(0, np.int64)
            self.alone = np.zeros(0, bool)
            return
        row = np.repeat(np.arange(len(per_row)), per_row)
        heads = np.cumsum(per_row) - per_row
        pos = np.arange(self.n_windows) - heads[row]
        at = self.first[row] + pos
        h = word_hashes(data, self.starts, self.ends)
        pairs = mix(h[:-1] * np.uint64(3) + h[1:])
        least = _sliding_min(pairs, WINDOW - 1)[at]
        bucket = (mix(least) % np.uint64(buckets)).astype(np.int64)
        cut = np.empty(self.n_windows, bool)
        cut[0] = True
        cut[1:] = (least[1:] != least[:-1]) | (row[1:] != row[:-1])
        alone = hot[bucket & (len(hot) - 1)]
        cut |= alone
        cut[1:] |= alone[:-1]
        begin = np.flatnonzero(cut)
        run = np.arange(self.n_windows) - np.repeat(begin, np.diff(np.r_[begin, self.n_windows]))
        cut |= run % MOST_WINDOWS == 0
        begin = np.flatnonzero(cut)
        self.row, self.pos, self.at, self.bucket, self.alone = row[begin], pos[begin], at[begin], bucket[begin], alone[begin]
        self.n = np.diff(np.r_[begin, self.n_windows])

    def keep(self, those: np.ndarray) -> None:
        """Only those strings from now on."""
        self.row, self.pos, self.at, self.bucket, self.n = (x[those] for x in (self.row, self.pos, self.at, self.bucket, self.n))

    def packed(self) -> list[bytes]:
        """Each super-k-mer's words, joined by one space."""
        joined, begins = joined_words(self.data, self.starts, self.ends)
        whole = joined.tobytes()
        return [whole[a : b - 1] for a, b in zip(begins[self.at].tolist(), begins[self.at + self.n + WINDOW - 1].tolist())]


def _ids(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("_sk_doc").to_numpy(zero_copy_only=False)


def _loads(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.zeros(1, bool)
        for batch in slices(batches, "_sk_text", 4 << 20):
            s = _Strings(batch.column("_sk_text"), buckets, none)
            where, back = np.unique(s.bucket, return_inverse=True)
            yield pa.RecordBatch.from_arrays([pa.array(where, pa.int64()), pa.array(np.bincount(back, s.n, len(where)).astype(np.int64))], ["bucket", "n"])

    return run


def _send(buckets: int, hot: np.ndarray):
    """(bucket, packed): a mapper's distinct strings for a bucket, with their smallest and largest doc_id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=1)
        for batch in slices(batches, "_sk_text", 4 << 20):
            s = _Strings(batch.column("_sk_text"), buckets, hot)
            s.keep(~s.alone)
            if not len(s.n):
                continue
            coded = pa.array(s.packed(), pa.large_binary()).dictionary_encode()
            code, doc = coded.indices.to_numpy(), _ids(batch)[s.row]
            order = np.lexsort((doc, code))
            head = np.flatnonzero(np.r_[True, np.diff(code[order]) != 0])
            tail = np.r_[head[1:], len(order)] - 1
            low, high, bucket = doc[order[head]], doc[order[tail]], s.bucket[order[head]]
            body, offsets = utf8(coded.dictionary)
            to = np.argsort(bucket, kind="stable")
            cuts = np.flatnonzero(np.r_[True, np.diff(bucket[to]) != 0, True])
            whole, lengths, blobs = body.tobytes(), np.diff(offsets).astype(np.int32), []
            begins = offsets[:-1].tolist()
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                own = to[a:b]
                texts = [whole[begins[k] : begins[k] + n] for k, n in zip(own.tolist(), lengths[own].tolist())]
                blobs.append(press.compress(struct.pack("<I", len(own)) + low[own].tobytes() + high[own].tobytes() + lengths[own].tobytes() + b"".join(texts)))
            yield pa.RecordBatch.from_arrays([pa.array(bucket[to[cuts[:-1]]], pa.int64()), pa.array(blobs, pa.binary())], ["bucket", "packed"])

    return run


def _windows(buckets: int, hot: np.ndarray):
    """(bucket, window, low, high): a slice's distinct windows of the buckets that are too large."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "_sk_text", 4 << 20):
            s = _Strings(batch.column("_sk_text"), buckets, hot)
            s.keep(s.alone)
            if not len(s.n):
                continue
            coded = pa.array(s.packed(), pa.large_binary()).dictionary_encode()
            code, doc, n = coded.indices.to_numpy(), _ids(batch)[s.row], len(coded.dictionary)
            low, high, bucket = np.full(n, np.iinfo(np.int64).max), np.full(n, np.iinfo(np.int64).min), np.empty(n, np.int64)
            np.minimum.at(low, code, doc)
            np.maximum.at(high, code, doc)
            bucket[code] = s.bucket
            cols = [pa.array(bucket), coded.dictionary.cast(pa.binary()), pa.array(low), pa.array(high)]
            yield pa.RecordBatch.from_arrays(cols, ["bucket", "window", "low", "high"])

    return run


def _window_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The verdict on windows that later documents hold too: their first document keeps them."""
    for batch in batches:
        h = np.fromiter(map(xxhash.xxh3_64_intdigest, batch.column("window").to_pylist()), np.uint64, batch.num_rows).view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column("bucket"), pa.array(h), batch.column("low"), pa.array(np.zeros(len(h), np.int64))], ["bucket", "h", "first", "mask"])


def _unpack(blobs: list[bytes]) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    low, high, lengths, bodies = [], [], [], []
    for blob in blobs:
        raw = zstandard.ZstdDecompressor().decompress(blob)
        (n,) = struct.unpack_from("<I", raw)
        low.append(np.frombuffer(raw, np.int64, n, 4))
        high.append(np.frombuffer(raw, np.int64, n, 4 + 8 * n))
        lengths.append(np.frombuffer(raw, np.int32, n, 4 + 16 * n))
        bodies.append(raw[4 + 20 * n :])
    offsets = np.r_[0, np.cumsum(np.concatenate(lengths), dtype=np.int64)]
    strings = pa.Array.from_buffers(pa.large_string(), len(offsets) - 1, [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(b"".join(bodies))])
    return strings, np.concatenate(low), np.concatenate(high)


def _same_windows(ids: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, heads): windows of word ids sorted so that equal ones are together, and where each run of them begins.
    They are sorted by hash; neighbours of one hash are compared word by word."""
    h = np.zeros(max(0, len(ids) - WINDOW + 1), np.uint64)
    spread = mix(ids.astype(np.uint64) + np.uint64(1))
    for k in range(WINDOW):
        h = h * np.uint64(0xD6E8FEB86659FD93) + spread[k : k + len(h)]
    key = mix(h[starts])
    order = np.argsort(key, kind="stable")
    view = np.lib.stride_tricks.sliding_window_view(ids, WINDOW)
    alike = np.flatnonzero(key[order[1:]] == key[order[:-1]])
    equal = (view[starts[order[alike + 1]]] == view[starts[order[alike]]]).all(1)
    if not equal.all():  # two windows share a hash: sort by the words themselves
        _, group = np.unique(view[starts], axis=0, return_inverse=True)
        order = np.argsort(group.ravel(), kind="stable")
        new = np.r_[True, np.diff(group.ravel()[order]) != 0]
    else:
        new = np.ones(len(order), bool)
        new[alike + 1] = False
    return order, np.flatnonzero(new)


def _verdicts(strings: pa.Array, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, ...]:
    """(string hash, first document, mask) of the strings of one bucket that have a repeated window; the mask has a bit
    for each window of the first document that starts in an earlier one."""
    coded = strings.dictionary_encode()
    code, distinct = coded.indices.to_numpy(), coded.dictionary
    first = np.full(len(distinct), np.iinfo(np.int64).max)
    last = np.full(len(distinct), np.iinfo(np.int64).min)
    np.minimum.at(first, code, low)
    np.maximum.at(last, code, high)
    split = pc.split_pattern(distinct, " ")
    word_at = split.offsets.to_numpy().astype(np.int64)
    ids = split.values.dictionary_encode().indices.to_numpy()
    n = np.diff(word_at) - (WINDOW - 1)
    owner = np.repeat(np.arange(len(n)), n)
    begins = np.cumsum(n) - n
    place = np.arange(int(n.sum())) - begins[owner]
    order, heads = _same_windows(ids, word_at[owner] + place)
    least = np.minimum.reduceat(first[owner[order]], heads)
    earliest = np.empty(len(order), np.int64)
    earliest[order] = np.repeat(least, np.diff(np.r_[heads, len(order)]))
    bit = np.where(earliest < first[owner], np.int64(1) << place, 0)
    mask = np.add.reduceat(bit, begins)
    told = np.flatnonzero((mask != 0) | (last > first))
    texts = distinct.take(pa.array(told)).to_pylist()
    h = np.array([xxhash.xxh3_64_intdigest(t.encode()) for t in texts], np.uint64).view(np.int64)
    return h, first[told], mask[told]


def _judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by bucket."""

    def close(bucket: int, blobs: list[bytes]) -> pa.RecordBatch:
        h, first, mask = _verdicts(*_unpack(blobs))
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(h), bucket)), pa.array(h), pa.array(first), pa.array(mask)], ["bucket", "h", "first", "mask"])

    current, blobs = None, []
    for batch in batches:
        for bucket, blob in zip(batch.column("bucket").to_pylist(), batch.column("packed").to_pylist()):
            if bucket != current and blobs:
                yield close(current, blobs)
                blobs = []
            current = bucket
            blobs.append(blob)
    if blobs:
        yield close(current, blobs)


def _occurrences(buckets: int, hot: np.ndarray):
    """(bucket, h, doc, rid, at): where each string stands; rid is the text's hash, and at packs pos and n."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "_sk_text", 4 << 20):
            s = _Strings(batch.column("_sk_text"), buckets, hot)
            h = np.fromiter(map(xxhash.xxh3_64_intdigest, s.packed()) if len(s.n) else (), np.uint64, len(s.n)).view(np.int64)
            cols = (s.bucket, h, _ids(batch)[s.row], batch.column("_sk_rid").to_numpy()[s.row], s.pos << 6 | s.n)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["bucket", "h", "doc", "rid", "at"])

    return run


def _text_hash(text_col: str):
    """What tells rows of one doc_id apart."""
    return F.xxhash64(F.col(text_col).cast("string")).alias("_sk_rid")


def _hot_marks(heavy: DataFrame, buckets: int) -> np.ndarray:
    """Which buckets are too large, by the lowest bits of their numbers: MARKS bits at most."""
    marks = np.zeros(min(MARKS, buckets), bool)
    found = heavy.select(F.col("bucket").bitwiseAND(len(marks) - 1).alias("mark")).distinct().collect()
    marks[[r.mark for r in found]] = True
    return marks


def repeated_windows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bucket_windows: int = BUCKET_WINDOWS) -> DataFrame:
    """(_sk_doc, _sk_rid, hits): for each document with windows to remove, (pos, mask) of runs of windows."""
    rows = docs.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).cast("long").alias("_sk_doc"), _text_hash(text_col), F.col(text_col).cast("string").alias("_sk_text"))
    size = rows.agg(F.sum(F.octet_length("_sk_text"))).first()[0] or 0
    # about one word in six bytes
    buckets = max(16, 1 << int(size / 6 / bucket_windows).bit_length())
    bounded_batches(rows)
    loads = rows.select("_sk_text").mapInArrow(_loads(buckets), "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    hot = _hot_marks(loads.where(F.col("n") > 4 * bucket_windows), buckets)
    told = rows.select("_sk_doc", "_sk_text")
    sent = told.mapInArrow(_send(buckets, hot), "bucket long, packed binary")
    verdict = "bucket long, h long, first long, mask long"
    judged = sent.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_judge, verdict)
    if hot.any():
        single = told.mapInArrow(_windows(buckets, hot), "bucket long, window binary, low long, high long")
        single = single.groupBy("bucket", "window").agg(F.min("low").alias("low"), F.max("high").alias("high")).where("high > low")
        judged = judged.unionByName(single.mapInArrow(_window_hashes, verdict))
    judged = materialize(judged, "verdicts")  # the packed strings are done with
    placed = rows.mapInArrow(_occurrences(buckets, hot), "bucket long, h long, doc long, rid long, at long")
    every = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("at").bitwiseAND(63).cast("int")) - 1
    found = placed.join(judged, ["bucket", "h"]).select(
        "doc", "rid", F.shiftright("at", 6).cast("int").alias("pos"), F.when(F.col("doc") == F.col("first"), F.col("mask")).otherwise(every).alias("mask")
    )
    # a repeated row finds the same hits again: a set, as they would be joined back to each of its copies
    return found.where("mask != 0").groupBy(F.col("doc").alias("_sk_doc"), F.col("rid").alias("_sk_rid")).agg(F.collect_set(F.struct("pos", "mask")).alias("_sk_hits"))


def _removed(hits: pa.Array, first: np.ndarray, words: int) -> np.ndarray:
    """Which words a hit window covers."""
    ends = hits.offsets.to_numpy().astype(np.int64)
    flat = hits.values.slice(ends[0], ends[-1] - ends[0])
    ends = ends - ends[0]
    row = np.repeat(np.arange(len(ends) - 1), np.diff(ends))
    step = np.zeros(words + 1, np.int64)
    if len(row):
        bits = np.unpackbits(flat.field("mask").to_numpy().view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        hit, bit = np.nonzero(bits)
        at = first[row[hit]] + flat.field("pos").to_numpy()[hit] + bit
        step += np.bincount(at, minlength=words + 1)[: words + 1]
        step -= np.bincount(at + WINDOW, minlength=words + 1)[: words + 1]
    return np.cumsum(step[:-1]) > 0


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bucket_windows: int = BUCKET_WINDOWS) -> DataFrame:
    """docs with its text's repeated windows removed (then the kept words joined by one space; a text that keeps all
    words stays as it is), and n_words, n_removed and kept_sha256 of the kept words."""
    own = ["n_words", "n_removed", "kept_sha256"]
    kept = [c for c in docs.columns if c not in own]
    hits = repeated_windows(docs, id_col, text_col, bucket_windows)
    rows = docs.select(*kept, F.col(id_col).cast("long").alias("_sk_doc"), _text_hash(text_col))
    joined = rows.join(hits, ["_sk_doc", "_sk_rid"], "left").withColumn("_sk_hits", F.coalesce("_sk_hits", F.array().cast("array<struct<pos:int,mask:long>>"))).drop("_sk_doc", "_sk_rid")
    schema = docs.select(*(F.col(c).cast("string").alias(c) if c == text_col else F.col(c) for c in kept)).schema
    for name, kind in zip(own, ("long", "long", "string")):
        schema = schema.add(name, kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text_col):
            column = batch.column(text_col)
            data, offsets = utf8(column)
            starts, ends, first = word_bounds(data, offsets)
            removed = _removed(batch.column("_sk_hits"), first, len(starts))
            body, begins = joined_words(data, starts[~removed], ends[~removed])
            gone = np.r_[0, np.cumsum(removed)][first]
            left = begins[first - gone].tolist()
            whole, n_gone = body.tobytes(), np.diff(gone)
            texts = [whole[a : max(a, b - 1)] for a, b in zip(left[:-1], left[1:])]
            old = column.to_pylist()
            new = pa.array([t.decode() if k else o for t, o, k in zip(texts, old, n_gone.tolist())], pa.string())
            cols = [new if c == text_col else batch.column(c) for c in kept]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(np.diff(first), pa.int64()), pa.array(n_gone, pa.int64()), pa.array([hashlib.sha256(t).hexdigest() for t in texts])], [*kept, *own])

    return joined.select(*(F.col(c).cast("string").alias(c) if c == text_col else F.col(c) for c in kept), "_sk_hits").mapInArrow(run, schema)


def op1_substring_superkmer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicate(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_words", "n_removed", "kept_sha256")


QUERIES = {"op1_substring_superkmer": op1_substring_superkmer}
ORACLES = {
    "op1_substring_superkmer": f"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
windows AS (SELECT doc_id, i, array_to_string(w[i:i + {WINDOW - 1}], ' ') AS k FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - {WINDOW - 1})) AS i FROM d)),
later AS (SELECT doc_id, i FROM windows QUALIFY min(doc_id) OVER (PARTITION BY k) < doc_id),
gone AS (SELECT DISTINCT doc_id, i + j AS p FROM later, range({WINDOW}) AS t(j)),
words AS (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS p FROM d),
kept AS (SELECT doc_id, count(gone.p) AS n_removed, coalesce(string_agg(x, ' ' ORDER BY p) FILTER (gone.p IS NULL), '') AS body FROM words LEFT JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(body, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)"""
}
