"""Connected components of an edge table, by alternating star operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import discard, materialize


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.shiftright(F.xxhash64("a", "b"), 16))).first())


def components(edges: DataFrame) -> DataFrame:
    """edges (a, b: longs) to (node, root): every node of an edge, and its component's least node.

    Large stars hang a node's greater neighbours on its least one, small stars the lesser ones; both together reach a
    forest of stars in rounds of the order of a component's log size.  Least neighbours are combined before the
    shuffle and written out, so that both sides of the join on a node with very many edges come from tables and Spark can
    split it.  Each round is written out, and the tables of the one before are removed; the last one stays until
    the result's reader discards the result."""
    edges = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b").distinct()
    edges = materialize(edges, "edges")
    before = None
    while (now := _mark(edges)) != before and now[0]:
        before = now
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        least = materialize(least, "least")
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = materialize(large.distinct(), "large-star")
        discard(edges, least)
        least = materialize(large.groupBy("a").agg(F.min("b").alias("m")), "least")
        small = large.join(least, "a")
        small = small.select("a", F.col("m").alias("b")).unionByName(small.where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b")))
        edges = materialize(small.distinct(), "small-star")
        discard(large, least)
    stars = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    out = stars.unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root"))).groupBy("node").agg(F.min("root").alias("root"))
    out.stored_at = edges.stored_at
    return out
