"""Browsing: sites, domains, directories, descriptions and single documents; paths by walking up a tree."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfmark.functions import match
from shelfmark.sources.catalog import FilesCatalog


def list_sites(catalog: FilesCatalog, pattern: str = "*", domains=(), limit: int = 5000) -> DataFrame:
    """Host names by glob or (regular expression), in case-insensitive order."""
    hosts = catalog.sites.where(F.lower("hostname").rlike(match.glob(pattern)) & match.in_domains(F.col("hostname"), domains))
    return hosts.orderBy(F.lower("hostname"), "site_id").limit(limit)


def list_directory(catalog: FilesCatalog, site_id: int, dir_id: int) -> DataFrame:
    """The names in one directory of a site; both filters reach the scan below the entries' aggregation."""
    return catalog.entries.where((F.col("site_id") == site_id) & (F.col("dir_id") == dir_id))


def list_domains(catalog: FilesCatalog) -> DataFrame:
    return catalog.domains.orderBy("name")


def expand_domains(domains: DataFrame, names: list[str] | None = None, depth: int = 20) -> DataFrame:
    """(name, suffix): pseudo-domains unfolded to host suffixes; a name that needs more than depth steps is an error.

    domains (name, definition) is a table of configuration; each level is one join with itself."""
    items = domains.select("name", F.explode(F.split("definition", ":")).alias("item"))
    start = items if names is None else items.where(F.col("name").isin(names))
    known = domains.select(F.col("name").alias("item"), F.col("definition"))
    level, done = start, None
    for _ in range(depth):
        inner = level.join(known, "item", "left")
        leaves = inner.where("definition is null").select("name", F.col("item").alias("suffix"))
        done = leaves if done is None else done.unionByName(leaves)
        level = inner.where("definition is not null").select("name", F.explode(F.split("definition", ":")).alias("item")).distinct()
        if level.isEmpty():
            return done.distinct()
    raise ValueError("pseudo-domains refer to themselves")


def whatis(descriptions: DataFrame, key: str, name: str = "name", text: str = "text") -> DataFrame:
    """Entries whose name or description holds the key, whatever its case."""
    return descriptions.where(match.substring(F.concat_ws(" ", name, text), key))


def carried_header(rows: DataFrame, group: str, order: str, header, value: str) -> DataFrame:
    """Each row with the value of the last header row before it (or its own, if it is one)."""
    w = Window.partitionBy(group).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn("header", F.last(F.when(header, F.col(value)), ignorenulls=True).over(w))


def _settled(df: DataFrame) -> DataFrame:
    """df written to the folder in spark.checkpoint.dir, which all executors share, and read back; where that is unset
    and all tasks run in this process, to a folder of its own."""
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="shelfmark-")
    path = f"{folder}/shelfmark/level-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def tree_paths(tree: DataFrame, most: int = 64) -> DataFrame:
    """(tree_id, node_id, path, depth) of a tree (tree_id, node_id, parent_id or null, name), level by level.

    One equi-join a level on (tree, parent), all trees together; a level without rows ends it.  Each level is stored,
    so that no task runs the joins of the levels above again."""
    level = _settled(tree.where("parent_id is null").select("tree_id", "node_id", F.concat(F.lit("/"), "name").alias("path"), F.lit(0).alias("depth")))
    done = level
    below = tree.where("parent_id is not null").select(F.col("tree_id").alias("in_tree"), F.col("node_id").alias("child"), "parent_id", "name")
    for depth in range(1, most):
        level = _settled(level.join(below, (F.col("tree_id") == F.col("in_tree")) & (F.col("node_id") == F.col("parent_id"))).select("tree_id", F.col("child").alias("node_id"), F.concat("path", F.lit("/"), "name").alias("path"), F.lit(depth).alias("depth")))
        if level.isEmpty():
            return done
        done = done.unionByName(level)
    raise ValueError(f"a path has more than {most} parts")


def preferred(hosts: DataFrame, names: DataFrame) -> DataFrame:
    """hosts (host) with the preferred name that names (name, preferred) has for it, whatever its case."""
    known = names.select(F.lower("name").alias("_name"), "preferred")
    return hosts.join(known, F.lower("host") == F.col("_name"), "left").drop("_name").withColumn("preferred", F.coalesce("preferred", "host"))


def redirected(requests: DataFrame, redirects: DataFrame) -> DataFrame:
    """requests (url) with the place that an exact redirect sends them to."""
    return requests.join(redirects.select(F.col("source").alias("url"), "target"), "url", "left").withColumn("target", F.coalesce("target", "url"))


def address_allowed(hosts: DataFrame, rules: DataFrame) -> DataFrame:
    """hosts (ip) allowed by rules (pattern, allow, rank) with * for octets: the first rule in rank order counts, this
    machine is always allowed, others without a rule are not.

    A rule has a fixed set of octets, so hosts meet rules by equality of those octets, once for each of the 16 shapes."""
    octet = lambda c, k: F.split_part(c, F.lit("."), F.lit(k + 1))
    shaped = rules.withColumn("shape", sum(F.when(octet(F.col("pattern"), k) != "*", 1 << k).otherwise(0) for k in range(4)))
    masked = lambda ip, shape: F.concat_ws(".", *(F.when(shape.bitwiseAND(1 << k) != 0, octet(ip, k)).otherwise("*") for k in range(4)))
    probes = hosts.select("ip", F.explode(F.sequence(F.lit(0), F.lit(15))).alias("shape"))
    probes = probes.withColumn("pattern", masked(F.col("ip"), F.col("shape")))
    first = probes.join(shaped.select("pattern", "shape", "allow", "rank"), ["pattern", "shape"]).groupBy("ip").agg(F.min(F.struct("rank", "allow"))["allow"].alias("allow"))
    return hosts.join(first, "ip", "left").withColumn("allowed", (F.col("ip") == "127.0.0.1") | F.coalesce("allow", F.lit(False))).drop("allow")
