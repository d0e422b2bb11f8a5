"""Shards of near-equal bytes by a k-d tree over document metadata.

A node that must hold k shards is cut along its widest metadata dimension (its range against the whole table's) at the
weighted median, or for odd k at the matching weighted quantile, so that both sides hold bytes in proportion to their
shards.  Each cut is found by histograms that narrow a key interval until what is left to decide is small; only
histograms of fixed size reach the driver.

Dimensions are numbers from 0 to 2**31 - 1: doc_id and size scaled from the table's own least to its greatest value,
and source and language by their place in the order of the values that the table has.  A key is the dimension's value
and, below it, a hash of the row (doc_id and text, then the row's place, which tells only equal rows apart), so ties
never stop a cut.

Rows: a null text has 8 bytes; null metadata sorts first, before every value; any 64-bit doc_id, also a negative one, is
placed by its value; a text of any length counts with its bytes and is never cut, so one longer than a shard makes its
shard longer; repeated rows are all placed; further columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import discard, materialize, table

_BITS, _ROW_BITS = 31, 11


def _stretched(value: Column, least, greatest) -> Column:
    """A number between least and greatest as one from 1 to 2**31 - 1; null as 0."""
    if least is None:
        return F.lit(0).cast("long")
    part = (value.cast("double") - F.lit(float(least))) / F.lit(max(1.0, float(greatest) - float(least)))
    return F.coalesce(F.least(F.floor(part * ((1 << _BITS) - 2)) + 1, F.lit((1 << _BITS) - 1)), F.lit(0)).cast("long")


def numbered(df: DataFrame, group: list[str], order: list[str], name: str) -> DataFrame:
    """df with the column name: gapless from 0 in each group in that order, numbered without one task for a group.
    The rows are written once (stored_at)."""
    keys = [*group, *order]
    ranged = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    ranged = materialize(ranged.withColumn("_at", F.monotonically_increasing_id()), "numbered")
    placed = ranged.withColumn("_part", F.shiftright("_at", 33))
    per = placed.groupBy(*group, "_part").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    # one row for each pair of group and partition: partitions plus groups in all
    before = F.sum("_n").over(Window.partitionBy(*group).orderBy("_part")) - F.col("_n")
    per = per.select(*group, "_part", "_first", before.alias("_base"))
    out = placed.join(per, [*group, "_part"]).withColumn(name, F.col("_base") + F.col("_at") - F.col("_first")).drop("_at", "_part", "_first", "_base")
    out.stored_at = ranged.stored_at
    return out


def _placed_values(rows: DataFrame, column: str, out: str) -> DataFrame:
    """rows with out: the place of the column's value in the order of all its values, from 1 on; null is 0."""
    ranks = numbered(rows.where(F.col(column).isNotNull()).select(column).distinct(), [], [column], "_rank")
    return rows.join(ranks, column, "left").withColumn(out, F.coalesce(F.col("_rank") + 1, F.lit(0))).drop("_rank")


def document_rows(docs: DataFrame) -> DataFrame:
    """(doc_id, size, text_crc32, tie, dimensions d0..d3): doc_id, size, source and language.  Written once."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.monotonically_increasing_id().alias("_row"),
        F.col("source").cast("string").alias("_source"),
        F.col("lang").cast("string").alias("_lang"),
    )
    first = materialize(rows, "kd-rows")
    rows = _placed_values(_placed_values(first, "_source", "_s"), "_lang", "_l")
    ends = rows.agg(*(f(c).alias(f"{f.__name__}_{c}") for c in ("doc_id", "size", "_s", "_l") for f in (F.min, F.max))).first()
    dims = [_stretched(F.col(c), ends[f"min_{c}"], ends[f"max_{c}"]).alias(f"d{k}") for k, c in enumerate(("doc_id", "size", "_s", "_l"))]
    # the row's place counts only below a hash of what the row holds
    tie = F.shiftleft(F.pmod(F.xxhash64("doc_id", "text_crc32", "size"), F.lit(1 << (_BITS - _ROW_BITS))), _ROW_BITS) + F.pmod(F.xxhash64("_row"), F.lit(1 << _ROW_BITS))
    out = materialize(rows.select("doc_id", "size", "text_crc32", tie.alias("tie"), *dims), "kd-dimensions")
    discard(first)
    return out


def _key(dim: int) -> Column:
    return F.shiftleft(F.col(f"d{dim}"), _BITS) + F.col("tie")


def _node_column(cuts: dict[int, tuple[int, int]], leaves: dict[int, int] | None = None, node: int = 1) -> Column:
    """The node of a row (a heap number: children 2n and 2n + 1), or its leaf's shard."""
    if node not in cuts:
        return F.lit(leaves[node] if leaves else node)
    dim, cut = cuts[node]
    return F.when(_key(dim) < F.lit(cut), _node_column(cuts, leaves, 2 * node)).otherwise(_node_column(cuts, leaves, 2 * node + 1))


def kd_cuts(rows: DataFrame, shards: int, dims: int, bins: int = 1 << 14, tolerance: float = 0.002) -> tuple[dict[int, tuple[int, int]], dict[int, int]]:
    """(cuts, leaves): cut key of each inner node, and each leaf's shard.  bins: of all histograms of one level together;
    tolerance: share of a shard's bytes that a cut may miss its place by."""
    share = {1: shards}
    cuts: dict[int, tuple[int, int]] = {}
    whole: dict[int, float] = {}
    while open_nodes := {n: k for n, k in share.items() if n not in cuts and k > 1}:
        placed = rows.withColumn("node", _node_column(cuts)).where(F.col("node").isin(list(open_nodes)))
        spread = placed.groupBy("node").agg(F.sum("size").alias("bytes"), *(f(f"d{d}").alias(f"{f.__name__}{d}") for d in range(dims) for f in (F.min, F.max))).collect()
        spans, targets, slack = {}, {}, {}
        for r in spread:
            n, k = r["node"], open_nodes[r["node"]]
            wide = {d: r[f"max{d}"] - r[f"min{d}"] for d in range(dims)}
            if n == 1:
                whole = {d: max(1, w) for d, w in wide.items()}
            dim = max(wide, key=lambda d: (wide[d] / whole[d], -d))
            spans[n] = [dim, r[f"min{dim}"] << _BITS, (r[f"max{dim}"] + 1) << _BITS]
            targets[n], slack[n] = r["bytes"] * (k // 2) / k, tolerance * r["bytes"] / k
        for n in open_nodes:  # empty nodes need no cut place
            if n not in spans:
                cuts[n] = (0, 0)
        of_node = {n: max(64, bins * open_nodes[n] // shards) for n in spans}
        before = dict.fromkeys(spans, 0)
        left = dict(spans)
        while left:
            key, low, step = (F.lit(None).cast("long") for _ in range(3))
            for n, (dim, lo, hi) in left.items():
                own, width = F.col("node") == n, -(-(hi - lo) // of_node[n])
                key, low, step = F.when(own, _key(dim)).otherwise(key), F.when(own, F.lit(lo)).otherwise(low), F.when(own, F.lit(width)).otherwise(step)
            keyed = placed.select("node", "size", key.alias("key"), low.alias("low"), step.alias("step"))
            in_span = F.lit(False)
            for n, (_, lo, hi) in left.items():
                in_span = in_span | ((F.col("node") == n) & (F.col("key") >= F.lit(lo)) & (F.col("key") < F.lit(hi)))
            found: dict[int, dict[int, tuple[int, int]]] = {}
            for r in keyed.where(in_span).groupBy("node", F.expr("(key - low) div step").alias("bin")).agg(F.sum("size").alias("bytes"), F.count("*").alias("n")).collect():
                found.setdefault(r["node"], {})[r["bin"]] = (r["bytes"], r["n"])
            for n, (dim, lo, hi) in list(left.items()):
                width, total = -(-(hi - lo) // of_node[n]), before[n]
                for k in sorted(found.get(n, {})):
                    weight, count = found[n][k]
                    if total + weight >= targets[n]:
                        break
                    total += weight
                else:
                    k, weight, count = of_node[n], 0, 0
                start = lo + k * width
                if width == 1 or count <= 1 or weight <= slack[n]:
                    near_end = total + weight - targets[n] < targets[n] - total
                    cuts[n] = (dim, start + width if near_end else start)
                    del left[n]
                else:
                    left[n], before[n] = [dim, start, min(hi, start + width)], total
        for n, k in open_nodes.items():
            share[2 * n], share[2 * n + 1] = k // 2, k - k // 2
    leaves = {n: i for i, n in enumerate(sorted((n for n in share if n not in cuts), key=lambda n: bin(n)[3:]))}
    return cuts, leaves


def kd_shards(rows: DataFrame, shards: int = 24, dims: int = 4) -> DataFrame:
    """rows (written, with size, tie and dimensions) with shard (int) and slot (long)."""
    cuts, leaves = kd_cuts(rows, shards, dims)
    return numbered(rows.withColumn("shard", _node_column(cuts, leaves).cast("int")), ["shard"], ["doc_id", "text_crc32", "tie"], "slot")


def op9_kd_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = kd_shards(document_rows(table(spark, sf_dir, "documents")))
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


QUERIES = {"op9_kd_shards": op9_kd_shards}
ORACLES: dict[str, str] = {}
