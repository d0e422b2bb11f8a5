"""Statistics of catalogs, query-log estimates, chunking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfmark.functions.scalars import url_host


def files_by_site(entries: DataFrame) -> DataFrame:
    """Files, directories, bytes and names of each site, and of all together (site_id null).

    Directories and names have a rollup each over their own distinct pairs, as one rollup with two distinct counts
    unfolds each entry into six rows that a task holds at once.  The rollups have a row a site and meet by it."""
    of_all = F.grouping_id().alias("_all")
    out = entries.rollup("site_id").agg(of_all, F.count("*").alias("files"), F.round(F.sum("size"), 2).alias("bytes"))
    for column, name in (("dir_id", "dirs"), ("s", "names")):
        pairs = entries.select("site_id", column).distinct()
        found = pairs.rollup("site_id").agg(of_all, F.countDistinct(column).alias(name)).withColumnsRenamed({"site_id": "_site", "_all": "_of"})
        out = out.join(found, (F.col("_all") == F.col("_of")) & F.col("site_id").eqNullSafe(F.col("_site"))).drop("_site", "_of")
    return out.select("site_id", "files", "dirs", "bytes", "names")


def length_histogram(strings: DataFrame) -> DataFrame:
    return strings.groupBy(F.length("s").alias("length")).agg(F.count("*").alias("n"))


def latency_estimate(log: DataFrame, bucket: str, value: str, order: list[str], last: int = 10, least: float = 5.0) -> DataFrame:
    """log with estimate: the mean of a bucket's last values, or their sum over last while there are fewer; never
    below least."""
    w = Window.partitionBy(bucket).orderBy(*order).rowsBetween(-(last - 1), 0)
    return log.withColumn("estimate", F.greatest(F.lit(least), F.sum(value).over(w) / last))


def chunks(rows: DataFrame, group: str, order: list[str], text: str, size: int) -> DataFrame:
    """rows with chunk: the number of the piece of at most about size characters that a row falls into."""
    before = F.sum(F.length(text) + 1).over(Window.partitionBy(group).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.length(text) - 1
    return rows.withColumn("chunk", F.floor(before / size))


def changed_headings(rows: DataFrame, column: str, order: list[str], group: list[str]) -> DataFrame:
    """rows with heading: whether the column differs from that of the row before in its group."""
    return rows.withColumn("heading", ~F.lag(column).over(Window.partitionBy(*group).orderBy(*order)).eqNullSafe(F.col(column)))


def pages_by_host(pages: DataFrame, keywords: DataFrame) -> DataFrame:
    """URLs, indexed URLs, their keywords and bytes, of each host and of all together (hostname null).

    A page is indexed if it has keywords: (page_id, key), once each."""
    keys = keywords.groupBy("page_id").agg(F.count("*").alias("keys"))
    told = pages.select("page_id", url_host(F.col("url")).alias("hostname"), F.octet_length("html").alias("size")).join(keys, "page_id", "left")
    indexed = F.when(F.col("keys").isNotNull(), F.col("size"))
    return told.rollup("hostname").agg(F.count("*").alias("urls"), F.count("keys").alias("indexed_urls"), F.coalesce(F.sum("keys"), F.lit(0)).alias("keywords"), F.coalesce(F.sum(indexed), F.lit(0)).alias("bytes"))


def dictionary(keywords: DataFrame) -> DataFrame:
    """Keyword records, different keywords, and the bytes of the latter as stored, each with its end."""
    keys = keywords.groupBy("key").agg(F.count("*").alias("n"))
    return keys.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("records"), F.count("*").alias("unique_keywords"), F.coalesce(F.sum(F.octet_length("key") + 1), F.lit(0)).alias("bytes"))


def request_cost(kind: Column, costs: dict[str, int], pages_before: Column, other: int = 1) -> Column:
    """A request's place in the queue: its type's cost, and more for each page that it skips."""
    base = F.lit(other)
    for name, cost in costs.items():
        base = F.when(kind == name, cost).otherwise(base)
    return (base * (1 + pages_before)).cast("long")
