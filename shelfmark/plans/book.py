"""A book of named queries: each a function of (spark, folder), most with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.sources.catalog import files_sql

Query = Callable[[SparkSession, str], DataFrame]


@dataclass
class Book:
    queries: dict[str, Query] = field(default_factory=dict)
    oracles: dict[str, str] = field(default_factory=dict)

    def query(self, name: str, sql: str | None = None) -> Callable[[Query], Query]:
        def put(f: Query) -> Query:
            if name in self.queries:
                raise ValueError(f"two queries named {name}")
            self.queries[name] = f
            if sql:
                self.oracles[name] = sql
            return f

        return put

    def files(self, name: str, sql: str) -> Callable[[Query], Query]:
        """A query whose SQL reads the files catalog's views."""
        return self.query(name, files_sql(sql))


#: Times are shown as text, in one form on both sides.
SHOWN_TIME = "yyyy-MM-dd HH:mm:ss"
SQL_TIME = "'%Y-%m-%d %H:%M:%S'"


def shown(hits: DataFrame, *more: str) -> DataFrame:
    """The columns of a search result."""
    return hits.select("s", "hostname", "path", "size", F.date_format("mtime", SHOWN_TIME).alias("mtime"), *more)


RESULT_SQL = f"SELECT s, hostname, path, size, strftime(mtime, {SQL_TIME}) AS mtime FROM f_entries JOIN f_sites USING (site_id)"
