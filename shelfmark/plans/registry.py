"""Every query of the library with its SQL oracle, by name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from shelfmark.plans import searches, streams, tables, upkeep, values, webtext
from shelfmark.plans.book import Query

BOOKS = [searches.BOOK, webtext.BOOK, upkeep.BOOK, values.BOOK, tables.BOOK, streams.BOOK]


def queries() -> dict[str, Query]:
    return {k: f for book in BOOKS for k, f in book.queries.items()}


def oracles() -> dict[str, str]:
    return {k: sql for book in BOOKS for k, sql in book.oracles.items()}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A substring search with domain and path filters and all three caps."""
    return searches.whole_search(spark, sf_dir)
