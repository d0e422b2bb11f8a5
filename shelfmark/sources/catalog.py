"""The catalogs' tables as DataFrames, and the same views as SQL for the oracles.

Files catalog: names are parts, sites are suppliers, an entry is a (site, directory, name), directories are orders.
Web catalog: pages with host, path, title, excerpt, links and keywords.  Nothing is collected; every table stays a
lazy plan over its Parquet source, so that filters and columns reach the scan.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class FilesCatalog:
    """Names, sites, postings, entries and pseudo-domains of one data folder."""

    spark: SparkSession
    folder: str

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @cached_property
    def names(self) -> DataFrame:
        s = F.concat_ws("", F.lower(F.replace("p_name", F.lit(" "), F.lit("_"))), F.lit("-"), F.col("p_partkey").cast("string"), F.lit("."), F.lower("p_type"))
        return self.read("part").select("p_partkey", s.alias("s"))

    @cached_property
    def strings(self) -> DataFrame:
        return self.names.select("s").distinct()

    @cached_property
    def sites(self) -> DataFrame:
        joined = self.read("supplier").join(self.read("nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(self.read("region"), F.col("n_regionkey") == F.col("r_regionkey"))
        host = F.lower(F.concat(F.replace("s_name", F.lit("#"), F.lit("-")), F.lit("."), F.replace("n_name", F.lit("_"), F.lit("-")), F.lit("."), F.col("r_name")))
        return joined.select(F.col("s_suppkey").alias("site_id"), host.alias("hostname"), "n_name", "r_name")

    @cached_property
    def entries(self) -> DataFrame:
        return self.entries_of(self.read("lineitem"))

    def entries_of(self, items: DataFrame) -> DataFrame:
        """Entries of given line items: a snapshot of the catalog."""
        rows = items.join(self.names, F.col("l_partkey") == F.col("p_partkey"))
        rows = rows.groupBy(F.col("l_suppkey").alias("site_id"), F.col("l_orderkey").alias("dir_id"), "s").agg(F.max("l_extendedprice").alias("size"), F.max("l_shipdate").alias("mtime"))
        return rows.withColumn("path", F.concat(F.lit("/"), F.col("dir_id").cast("string"), F.lit("/"), F.col("s")))

    @cached_property
    def postings(self) -> DataFrame:
        rows = self.read("lineitem").join(self.names, F.col("l_partkey") == F.col("p_partkey"))
        return rows.select("s", F.col("l_suppkey").alias("site_id")).distinct()

    @cached_property
    def domains(self) -> DataFrame:
        """(name, definition): a region's pseudo-domain as a colon list of its nations' host suffixes, and ``world`` as
        the list of all regions' pseudo-domains."""
        nations = self.read("nation").join(self.read("region"), F.col("n_regionkey") == F.col("r_regionkey"))
        item = F.lower(F.concat(F.replace("n_name", F.lit("_"), F.lit("-")), F.lit("."), F.col("r_name")))
        by_region = nations.groupBy(F.lower("r_name").alias("name")).agg(F.array_join(F.array_sort(F.collect_set(item)), ":").alias("definition"))
        world = by_region.agg(F.lit("world").alias("name"), F.array_join(F.array_sort(F.collect_list("name")), ":").alias("definition"))
        return by_region.unionByName(world)


FILES_SQL = {
    "f_name": "SELECT p_partkey, lower(replace(p_name,' ','_'))||'-'||p_partkey||'.'||lower(p_type) AS s FROM part",
    "f_strings": "SELECT DISTINCT s FROM f_name",
    "f_sites": "SELECT s_suppkey AS site_id, lower(replace(s_name,'#','-')||'.'||replace(n_name,'_','-')||'.'||r_name) AS hostname, n_name, r_name FROM supplier JOIN nation ON s_nationkey=n_nationkey JOIN region ON n_regionkey=r_regionkey",
    "f_entries": "SELECT l_suppkey AS site_id, l_orderkey AS dir_id, s, max(l_extendedprice) AS size, max(l_shipdate) AS mtime, '/'||l_orderkey||'/'||s AS path FROM lineitem JOIN f_name ON l_partkey=p_partkey GROUP BY l_suppkey, l_orderkey, s",
    "f_postings": "SELECT DISTINCT s, site_id FROM f_entries",
    "f_region": "SELECT lower(r_name) AS name, string_agg(DISTINCT lower(replace(n_name,'_','-')||'.'||r_name), ':' ORDER BY lower(replace(n_name,'_','-')||'.'||r_name)) AS definition FROM nation JOIN region ON n_regionkey=r_regionkey GROUP BY r_name",
    "f_domains": "SELECT * FROM f_region UNION ALL SELECT 'world', string_agg(name, ':' ORDER BY name) FROM f_region",
}


def files_sql(body: str) -> str:
    """body over the files catalog's views."""
    return "WITH RECURSIVE " + ", ".join(f"{k} AS ({v})" for k, v in FILES_SQL.items()) + " " + body
