"""Result formats: one line of text for each row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from shelfmark.functions.scalars import compact_time


def _whole(c: str) -> Column:
    return F.col(c).cast("long").cast("string")


def verbose() -> Column:
    return F.concat(F.lit("Host "), F.col("hostname"), F.lit("    Location: "), F.regexp_replace("path", "/[^/]*$", ""), F.lit("      FILE    "), _whole("size"), F.lit(" "), F.date_format("mtime", "yyyy-MM-dd HH:mm"), F.lit("  "), F.col("s"))


def terse() -> Column:
    return F.concat(F.col("hostname"), F.lit(" "), _whole("size"), F.lit(" "), F.date_format("mtime", "yyyy-MM-dd"), F.lit(" "), F.col("path"))


def machine() -> Column:
    return F.concat(compact_time(F.col("mtime")), F.lit("Z "), _whole("size"), F.lit(" "), F.col("hostname"), F.lit(" "), F.col("path"))


def url() -> Column:
    return F.concat(F.lit("ftp://"), F.col("hostname"), F.col("path"))


def key_values() -> Column:
    return F.concat(F.lit("STRING="), F.col("s"), F.lit("\nSITE="), F.col("hostname"), F.lit("\nPATH="), F.col("path"), F.lit("\nSIZE="), _whole("size"), F.lit("\nDATE="), compact_time(F.col("mtime")))


#: Formats by name.
FORMATS = {"verbose": verbose, "terse": terse, "machine": machine, "url": url, "key_values": key_values}
