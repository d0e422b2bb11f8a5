"""Near-duplicate documents by DartMinHash signatures, banding and exact verification.

Signatures: every element of a weighted set owns the region [0, weight) x [0, inf) of (weight, rank).  Darts fall on it
at unit density, at places that a hash of the element alone decides, and each dart has a coordinate.  A signature keeps
the dart of least rank in every coordinate; two sets agree in a coordinate with the probability of their weighted
Jaccard similarity.  Ranks are looked at in slabs from 0 on, only until all coordinates are taken, so a set of many
elements throws about one dart each instead of one for every coordinate.

Classes: equal texts are one node.  Nodes that agree in all rows of a band meet in a bucket; in a bucket, signatures
that agree in too few coordinates to reach the threshold (by more than five standard deviations) are told apart, and
what still hangs together over all buckets is a cluster.  Each cluster's texts are then compared exactly, by the
number of shingles that they share, and the classes are the connected components of the links.  Buckets and clusters
too large for a task, in rows or in bytes of text, are compared block by block, all blocks with all, so no link is
dropped.  Texts are equal when their SHA-256 digests are.

A link is a weighted Jaccard similarity of at least 0.8 between five-word shingles, each weighted by how often it
stands in its text (``weights="ones"``: between sets of shingles).  A text of one to four words is one shingle.

Rows: texts that are null or have no word are in no class but their own (class_id is their doc_id); rows of equal text
share a class, repeated rows too, and only one of them takes part in comparisons; a null doc_id never names a class
unless all of its rows have none (then class_id is null); words are compared as they are; texts of any length are read
whole, and one longer than a block is a block of its own; other columns than id and text are not read and can't clash;
an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .graph import components
from .shared import bounded_batches, discard, materialize, table
from .textcols import binary_array, mix, slices, utf8, word_bounds, word_hashes

SHINGLE, BANDS, ROWS = 5, 32, 5
COORDINATES = BANDS * ROWS
#: Cumulative probabilities of a Poisson count of mean 1, of up to 12.
_POISSON = np.cumsum(np.exp(-1) / np.cumprod([1, *range(1, 13)]))
_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)


def dart_signatures(elements: np.ndarray, weights: np.ndarray | None, rows: np.ndarray, n: int, coordinates: int = COORDINATES) -> np.ndarray:
    """(n, coordinates) bytes: fingerprints of the least-ranked darts.  elements: hashes of the elements of set rows[i],
    rows ascending; weights: positive, None for ones.  Sets without an element give zeros."""
    best = np.full(n * coordinates, _EMPTY, np.uint64)
    if weights is not None:  # layers of height one; only the last may be cut
        layers = np.ceil(weights).astype(np.int64)
        of = np.repeat(np.arange(len(layers)), layers)
        layer = np.arange(len(of)) - np.repeat(np.cumsum(layers) - layers, layers)
        elements, rows = mix(elements[of] + layer.astype(np.uint64) * np.uint64(0x9FB21C651E98DF25)), rows[of]
        part = np.minimum(weights[of] - layer, 1.0)
        weights = None if (part == 1).all() else weights
    open_rows, first, last = np.bincount(rows, minlength=n) > 0, 0, 1
    while len(elements) and last < 1 << 16:
        # enough sets at a time that the darts stay few
        for a in range(0, len(elements), max(1, (1 << 18) // (last - first))):
            chunk = slice(a, a + max(1, (1 << 18) // (last - first)))
            e, r = elements[chunk], rows[chunk]
            unit = np.tile(np.arange(first, last, dtype=np.uint64), len(e))
            seed = mix(np.repeat(e, last - first) ^ (unit + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93))
            many = np.searchsorted(_POISSON, (seed >> np.uint64(11)) / float(1 << 53))
            of = np.repeat(np.arange(len(seed)), many)
            number = np.arange(len(of)) - np.repeat(np.cumsum(many) - many, many)
            dart = mix(seed[of] + (number.astype(np.uint64) + np.uint64(1)) * np.uint64(0xA0761D6478BD642F))
            low = dart & np.uint64(0xFFFFFFFF)
            slot = r[of // (last - first)] * coordinates + (low * np.uint64(coordinates) >> np.uint64(32)).astype(np.int64)
            drawn = mix(dart ^ np.uint64(0xE7037ED1A0B428DB))
            rank = unit[of] << np.uint64(40) | drawn >> np.uint64(24)
            packed = rank << np.uint64(8) | dart >> np.uint64(56)
            if weights is not None:
                inside = (mix(dart + np.uint64(0x8EBC6AF09C88C6E3)) >> np.uint64(11)) / float(1 << 53) < part[chunk][of // (last - first)]
                slot, packed = slot[inside], packed[inside]
            np.minimum.at(best, slot, packed)
        taken = (best.reshape(n, coordinates) != _EMPTY).all(1)
        open_rows &= ~taken
        left = open_rows[rows]
        elements, rows = elements[left], rows[left]
        if weights is not None:
            part = part[left]
        first, last = last, 2 * last + 1
    return np.where(best == _EMPTY, np.uint64(0), best).astype(np.uint8).reshape(n, coordinates)


def shingle_hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, rows): of all shingles, in the order of the texts."""
    data, offsets = utf8(column)
    starts, ends, first = word_bounds(data, offsets)
    words = np.diff(first)
    h = word_hashes(data, starts, ends)
    per = np.where(words > SHINGLE, words - SHINGLE + 1, np.minimum(words, 1))
    rows = np.repeat(np.arange(len(per)), per)
    at = first[rows] + np.arange(len(rows)) - (np.cumsum(per) - per)[rows]
    out = np.zeros(len(rows), np.uint64)
    for k in range(SHINGLE):
        there = at + k < first[rows + 1]
        out = mix(out * np.uint64(31) + np.where(there, h[np.minimum(at + k, len(h) - 1)], np.uint64(k))) if len(rows) else out
    return out, rows


def _counted(elements: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct elements of each row, and how often they are there."""
    order = np.lexsort((elements, rows))
    e, r = elements[order], rows[order]
    head = np.flatnonzero(np.r_[True, (e[1:] != e[:-1]) | (r[1:] != r[:-1])]) if len(e) else np.zeros(0, np.int64)
    return e[head], r[head], np.diff(np.r_[head, len(e)])


def signatures(df: DataFrame, weights: str = "counts") -> DataFrame:
    """df (id, key, text) to (id, key, sig, bytes): sig is null for texts without a word, bytes is the text's length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            elements, rows = shingle_hashes(batch.column("text"))
            told = np.bincount(rows, minlength=batch.num_rows) > 0
            counts = None
            if weights == "counts":
                elements, rows, counts = _counted(elements, rows)
            sig = dart_signatures(elements, counts, rows, batch.num_rows)
            sigs = pa.array([s.tobytes() if ok else None for s, ok in zip(sig, told.tolist())], pa.binary())
            size = pa.array(np.diff(utf8(batch.column("text"))[1]))
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("key"), sigs, size], ["id", "key", "sig", "bytes"])

    return bounded_batches(df).select("id", "key", "text").mapInArrow(run, "id long, key binary, sig binary, bytes long")


def _spread(n: int, near) -> list[tuple[int, int]]:
    """Edges that join the connected components of a relation over 0..n-1.  near(i, those): which of those are related
    to i.  A member that is joined already is never compared with again, so a close group takes one comparison each."""
    left, edges = np.arange(n), []
    while len(left):
        queue, left = [int(left[0])], left[1:]
        while queue and len(left):
            i = queue.pop()
            hit = near(i, left)
            found = left[hit]
            left = left[~hit]
            edges += [(i, int(j)) for j in found]
            queue += found.tolist()
    return edges


def _blocked(df: DataFrame, blocks: Column, by: str) -> DataFrame:
    """df's rows with part: a group of several blocks is dealt to them, and each row goes to every pair of blocks that
    holds its own; so every two members meet."""
    own = F.pmod(F.xxhash64(by), blocks)
    pairs = F.transform(F.sequence(F.lit(0).cast("long"), blocks - 1), lambda j: F.least(own, j) * blocks + F.greatest(own, j))
    return df.withColumn("part", F.explode(F.when(blocks <= 1, F.array(F.lit(0).cast("long"))).otherwise(pairs)))


def _grouped(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Runs of rows with equal keys, of batches sorted by them."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        values = [batch.column(k).to_numpy() for k in keys]
        cut = np.zeros(batch.num_rows, bool)
        for v in values:
            cut[1:] |= v[1:] != v[:-1]
        begins = [0, *np.flatnonzero(cut).tolist(), batch.num_rows]
        for a, b in zip(begins[:-1], begins[1:]):
            if a == b:
                continue
            key = tuple(int(v[a]) for v in values)
            if key != last and held:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = key
    if held:
        yield pa.Table.from_batches(held)


def _edges_batch(edges: list[tuple[int, int]], ids: np.ndarray) -> pa.RecordBatch:
    pairs = ids[np.array(edges, np.int64).reshape(-1, 2)]
    return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])


def _alike(least: int):
    """Edges of each bucket's clusters: signatures that agree in least coordinates or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _grouped(batches, ["bucket", "part"]):
            sig = np.stack([np.frombuffer(s, np.uint8) for s in group.column("sig").to_pylist()])
            if edges := _spread(len(sig), lambda i, those: (sig[those] == sig[i]).sum(1) >= least):
                yield _edges_batch(edges, group.column("node").to_numpy())

    return run


def shingle_codes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(codes, rows): whole numbers that are equal exactly for equal shingles of these texts."""
    data, offsets = utf8(column)
    starts, ends, first = word_bounds(data, offsets)
    ids = binary_array(data, starts, ends).dictionary_encode().indices.to_numpy().astype(np.int64) + 1
    words = np.diff(first)
    per = np.where(words > SHINGLE, words - SHINGLE + 1, np.minimum(words, 1))
    rows = np.repeat(np.arange(len(per)), per)
    at = first[rows] + np.arange(len(rows)) - (np.cumsum(per) - per)[rows]
    code = np.zeros(len(rows), np.int64)
    top = int(ids.max(initial=0)) + 1
    for k in range(SHINGLE):
        there = at + k < first[rows + 1]
        word = np.where(there, ids[np.minimum(at + k, max(0, len(ids) - 1))], 0) if len(ids) else code
        _, code = np.unique(code * top + word, return_inverse=True)  # numbers stay below the count of shingles
    return code, rows


def _links(similarity: float, weights: str):
    """Edges of each cluster's classes, from its texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _grouped(batches, ["cluster", "part"]):
            nodes = group.column("node").to_numpy()
            codes, rows = shingle_codes(group.column("text").cast(pa.large_string()).combine_chunks())
            codes, rows, counts = _counted(codes, rows)
            height = counts if weights == "counts" else np.ones(len(codes), np.int64)
            total = np.bincount(rows, height, len(nodes))
            row_start = np.searchsorted(rows, np.arange(len(nodes) + 1))
            order = np.argsort(codes, kind="stable")
            holders, held = rows[order], height[order]
            code_start = np.searchsorted(codes[order], np.arange(int(codes.max(initial=0)) + 2))

            def near(i: int, those: np.ndarray) -> np.ndarray:
                own = slice(row_start[i], row_start[i + 1])
                begin, many = code_start[codes[own]], code_start[codes[own] + 1] - code_start[codes[own]]
                place = np.repeat(begin - np.cumsum(many) + many, many) + np.arange(int(many.sum()))
                shared = np.bincount(holders[place], np.minimum(held[place], np.repeat(height[own], many)), len(nodes))[those]
                return shared >= similarity * (total[i] + total[those] - shared) - 1e-9

            if edges := _spread(len(nodes), near):
                yield _edges_batch(edges, nodes)

    return run


def _text_key(text: Column) -> Column:
    return F.unhex(F.sha2(text.cast("binary"), 256))


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = 0.8, weights: str = "counts", bucket_block: int = 4096, cluster_block: int = 2048, block_bytes: int = 32 << 20) -> DataFrame:
    """(id, text_key, class_id, class_texts): of every row, the least id of its class, and how many texts the class has.

    A bucket's block has about bucket_block signatures; a cluster's about cluster_block texts, of block_bytes at most."""
    text = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), _text_key(text).alias("key"), text.alias("text"))
    told = materialize(signatures(rows, weights), "signatures")
    nodes = told.where(F.col("sig").isNotNull()).groupBy("key").agg(F.min("id").alias("id"), F.first("sig").alias("sig"), F.first("bytes").alias("bytes"))
    nodes = materialize(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")
    bands = nodes.select("node", F.explode(F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda j: F.xxhash64(j, F.substr("sig", j * ROWS + 1, F.lit(ROWS))))).alias("bucket"))
    # Buckets of the same members are looked at once
    members = F.xxhash64("node")
    full = bands.groupBy("bucket").agg(F.count("*").alias("n"), F.sum(F.shiftright(members, 24)).alias("s1"), F.sum(members.bitwiseAND((1 << 38) - 1)).alias("s2")).where("n > 1")
    full = full.groupBy("n", "s1", "s2").agg(F.min("bucket").alias("bucket")).select("bucket", "n")
    met = materialize(bands.join(full, "bucket"), "met")
    least = int(COORDINATES * similarity - 5.1 * (COORDINATES * similarity * (1 - similarity)) ** 0.5)
    parted = _blocked(met.join(nodes.select("node", "sig"), "node"), F.ceil(F.col("n") / bucket_block), "node").select("bucket", "part", "node", "sig")
    edges = parted.repartition("bucket", "part").sortWithinPartitions("bucket", "part").mapInArrow(_alike(least), "a long, b long")
    clusters = components(edges)
    discard(met)
    sized = clusters.join(nodes.select("node", "bytes"), "node")
    sized = materialize(sized.join(sized.groupBy("root").agg(F.count("*").alias("n"), F.sum("bytes").alias("all_bytes")), "root").drop("bytes"), "clusters")
    discard(clusters)
    told_of = sized.join(nodes.select("node", "key", "id"), "node")
    # of rows with equal id and text one is enough; a null id equals itself here
    texts = rows.where(F.col("text").isNotNull()).withColumnRenamed("id", "_id").withColumnRenamed("key", "_key")
    with_text = told_of.join(texts, (F.col("key") == F.col("_key")) & F.col("id").eqNullSafe(F.col("_id"))).groupBy("root", "node", "n", "all_bytes").agg(F.first("text").alias("text"))
    blocks = F.greatest(F.ceil(F.col("n") / cluster_block), F.ceil(F.col("all_bytes") / block_bytes))
    parted = _blocked(with_text, blocks, "node").select(F.col("root").alias("cluster"), "part", "node", "text")
    links = parted.repartition("cluster", "part").sortWithinPartitions("cluster", "part").mapInArrow(_links(similarity, weights), "a long, b long")
    found = components(links)
    discard(sized)
    named = nodes.select("node", "key", "id").join(found, "node", "left").withColumn("root", F.coalesce("root", "node"))
    named = materialize(named, "named")
    discard(found, nodes)
    heads = named.groupBy("root").agg(F.min("id").alias("class_id"), F.count("*").alias("class_texts"))
    by_key = named.join(heads, "root").select("key", "class_id", "class_texts")
    # rows without a word have no node
    out = told.select("id", "key", F.col("sig").isNull().alias("bare")).join(by_key, "key", "left")
    return out.select(F.col("id").alias(id_col), F.col("key").alias("text_key"), F.when(F.col("bare"), F.col("id")).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("class_texts", F.lit(1)).cast("long").alias("class_texts"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """docs without the documents whose class has one of a smaller id.  Rows of a class without any id all stay."""
    gone = classes(docs, id_col, text_col, **how).where(F.col(id_col).isNull() & F.col("class_id").isNotNull() | (F.col(id_col) != F.col("class_id")))
    gone = gone.select(F.col(id_col).alias("_gone_id"), F.col("text_key").alias("_gone_key")).distinct()
    return docs.join(gone, F.col(id_col).cast("long").eqNullSafe(F.col("_gone_id")) & _text_key(F.col(text_col).cast("string")).eqNullSafe(F.col("_gone_key")), "left_anti")


def op4_dart_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "class_texts")


QUERIES = {"op4_dart_minhash": op4_dart_minhash}
ORACLES = {
    "op4_dart_minhash": f"""
WITH RECURSIVE d AS (SELECT doc_id, text, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
t AS (SELECT text, min(doc_id) AS node, any_value(w) AS w FROM d WHERE len(w) > 0 GROUP BY text),
s AS (SELECT node, k, count(*) AS x FROM (SELECT node, array_to_string(w[i:i + {SHINGLE - 1}], ' ') AS k FROM (SELECT node, w, unnest(generate_series(1, greatest(len(w) - {SHINGLE - 1}, 1))) AS i FROM t)) GROUP BY node, k),
c AS (SELECT node, sum(x) AS n FROM s GROUP BY node),
p AS (SELECT x.node AS a, y.node AS b, sum(least(x.x, y.x)) AS m FROM s x JOIN s y ON x.k = y.k AND x.node <> y.node GROUP BY ALL),
e AS (SELECT a, b FROM p JOIN c ca ON ca.node = a JOIN c cb ON cb.node = b WHERE 10 * m >= 8 * (ca.n + cb.n - m)),
r AS (SELECT node, node AS root FROM t UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.node),
f AS (SELECT node, min(root) AS class_id FROM r GROUP BY node),
g AS (SELECT *, count(*) OVER (PARTITION BY class_id) AS class_texts FROM f)
SELECT doc_id, coalesce(class_id, doc_id) AS class_id, coalesce(class_texts, 1)::BIGINT AS class_texts FROM d LEFT JOIN t ON d.text = t.text LEFT JOIN g USING (node)"""
}
