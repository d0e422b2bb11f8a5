"""A host table over the suppliers, for the queries that need addresses, states and times; the same as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.sources.catalog import FilesCatalog, files_sql

#: A host's address, state, times and catalogs follow from its number.
HOSTS_SQL = """, hosts AS (SELECT site_id, hostname AS host, '10.' || (site_id % 4) || '.' || ((site_id // 256) % 256) || '.' || (site_id % 256) AS ip,
    CASE site_id % 7 WHEN 0 THEN 'disabled' WHEN 1 THEN 'deleted' ELSE 'active' END AS status,
    TIMESTAMP '2024-01-01 00:00:00' + to_hours(site_id) AS retrieve_time, TIMESTAMP '2024-01-02 00:00:00' + to_hours(site_id) AS update_time,
    site_id % 4 AS fail_count, site_id % 5 = 0 AS force,
    CASE WHEN site_id % 2 = 0 THEN ['anonftp', 'webindex'] ELSE ['anonftp'] END AS access_methods FROM f_sites)"""


def hosts_sql(body: str, more: str = "") -> str:
    return files_sql("").rstrip() + HOSTS_SQL + more + " " + body


def hosts(catalog: FilesCatalog) -> DataFrame:
    k = F.col("site_id")
    hours = lambda start: F.to_timestamp_ntz(F.lit(start)) + F.make_dt_interval(F.lit(0), k.cast("int"))
    ip = F.concat_ws(".", F.lit("10"), *((x.cast("int").cast("string")) for x in (k % 4, F.floor(k / 256) % 256, k % 256)))
    return catalog.sites.select(
        "site_id",
        F.col("hostname").alias("host"),
        ip.alias("ip"),
        F.when(k % 7 == 0, "disabled").when(k % 7 == 1, "deleted").otherwise("active").alias("status"),
        hours("2024-01-01 00:00:00").alias("retrieve_time"),
        hours("2024-01-02 00:00:00").alias("update_time"),
        (k % 4).alias("fail_count"),
        (k % 5 == 0).alias("force"),
        F.when(k % 2 == 0, F.array(F.lit("anonftp"), F.lit("webindex"))).otherwise(F.array(F.lit("anonftp"))).alias("access_methods"),
    )
