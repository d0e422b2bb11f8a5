"""Directory listings of Unix, VMS and Novell servers as tables of entries.

A listing is a table (site_id, line_no, line).  Lines are classified and cut by expressions; the directory that a line
stands in is the last header before it, a window over the site's lines.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfmark.functions import scalars as sc

COLUMNS = ["site_id", "line_no", "dir", "name", "is_dir", "is_link", "size", "mtime", "perms"]

UNIX_ENTRY = r"^([-dlbcps])([-rwxtslST]{9})\S*\s+(\d+)\s+(\S+)\s+(?:(\S+)\s+)?(\d+)\s+([A-Z][a-z]{2})\s+(\d{1,2})\s+(\d{4}|\d{1,2}:\d{2})\s+(.+)$"
UNIX_HEADER = r"^(\S.*):$"
UNIX_SELF = r"\s\.\.?(?: -> |$)"
UNIX_NOISE = r"^(total\s+\d+|.*: (?:Permission denied|No such file or directory)|\s*)$"
VMS_ENTRY = r"^(\S+;\d+)\s+(\d+)(?:/\d+)?\s+(\d{1,2})-([A-Za-z]{3})-(\d{4})\s+(\d{1,2}:\d{2})(?::\d{2})?\s+\[([^\]]*)\]\s+(\([^)]*\))"
VMS_HEADER = r"^(?:\S+:)?\[([^\]]+)\]\s*$"
NOVELL_ENTRY = r"^([-d])\s*(\[[-RWCEMFAS ]*\])\s+(\S+)\s+(\d+)\s+([A-Z][a-z]{2})\s+(\d{1,2})\s+(\d{4}|\d{1,2}:\d{2})\s+(.+)$"


def _dirs(lines: DataFrame, header: str, path=lambda found: found) -> DataFrame:
    """lines with dir: the path of the last header, whose first group is never empty."""
    w = Window.partitionBy("site_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    told = lines.withColumn("_head", F.regexp_extract("line", header, 1))
    return told.withColumn("dir", F.coalesce(F.last(F.when(F.col("_head") != "", path(F.col("_head"))), ignorenulls=True).over(w), F.lit(""))).drop("_head")


def _cut(lines: DataFrame, entry: str, groups: str) -> tuple[DataFrame, Callable[[int], Column]]:
    """The lines that are entries, and their fields by place: the groups (digits, 0 for the tenth), by one match of a line.

    No field but the last can hold a line end, so line ends part them."""
    refs = "\n".join(f"${int(g) or 10}" for g in groups)
    told = lines.where(F.col("line").rlike(entry)).withColumn("_cut", F.split(F.regexp_replace("line", entry, refs), "\n", len(groups)))
    return told, lambda k: F.get("_cut", F.lit(k))


def cleaned(lines: DataFrame) -> DataFrame:
    """Unix lines without errors, totals and blanks, with fused fields (links grown into permissions) parted."""
    fixed = F.regexp_replace("line", r"^([-dlbcps][-rwxtslST]{9})(\d)", "$1 $2")
    return lines.where(~F.col("line").rlike(UNIX_NOISE)).withColumn("line", fixed)


def unix(lines: DataFrame, as_of: Column) -> DataFrame:
    """ls -lR: devices and sockets are left out, a link's target is cut off its name.

    What is left out is told by the line, as filters on fields are moved below the fields and cut the line anew: the
    kind is its first letter, and only a line with UNIX_SELF can be that of . or .. (the name decides)."""
    told = _dirs(cleaned(lines), UNIX_HEADER, lambda found: F.regexp_replace(found, r"^\./?", ""))
    told, part = _cut(told.where(F.substr("line", F.lit(1), F.lit(1)).isin("-", "d", "l")), UNIX_ENTRY, "1267890")
    kind = part(0)
    name = F.when(kind == "l", F.regexp_replace(part(6), " -> .*$", "")).otherwise(part(6))
    told = told.where(~(F.col("line").rlike(UNIX_SELF) & name.isin(".", "..")))
    return told.select("site_id", "line_no", "dir", name.alias("name"), (kind == "d").alias("is_dir"), (kind == "l").alias("is_link"), part(2).cast("long").alias("size"), sc.listing_date(part(3), part(4), part(5), as_of).alias("mtime"), sc.perms_bits(part(1)).alias("perms"))


def vms(lines: DataFrame) -> DataFrame:
    """name;version, size, date, owner, permissions; a long name's fields stand on the next line."""
    w = Window.partitionBy("site_id").orderBy("line_no")
    alone = F.col("line").rlike(r"^\S+;\d+\s*$")
    joined = lines.withColumn("line", F.when(alone, F.concat(F.trim("line"), F.lit(" "), F.trim(F.lead("line").over(w)))).otherwise(F.col("line")))
    told = _dirs(joined, VMS_HEADER, lambda found: F.replace(found, F.lit("."), F.lit("/")))
    told, part = _cut(told, VMS_ENTRY + r"(?s:.*)", "1234568")
    bare = F.regexp_replace(part(0), ";.*$", "")
    is_dir = F.upper(bare).endswith(".DIR")
    clock = lambda k: F.split_part(part(5), F.lit(":"), F.lit(k)).cast("int")
    stamp = sc.listing_date(part(3), part(2), part(4), F.current_timestamp()) + F.make_dt_interval(hours=clock(1), mins=clock(2))
    return told.select("site_id", "line_no", "dir", F.when(is_dir, F.regexp_replace(bare, r"(?i)\.DIR$", "")).otherwise(bare).alias("name"), is_dir.alias("is_dir"), F.lit(False).alias("is_link"), part(1).cast("long").alias("size"), stamp.alias("mtime"), sc.vms_perms_bits(part(6)).alias("perms"))


def novell(lines: DataFrame, as_of: Column) -> DataFrame:
    told, part = _cut(_dirs(lines, UNIX_HEADER), NOVELL_ENTRY, "1245678")
    is_dir = part(0) == "d"
    return told.select("site_id", "line_no", "dir", part(6).alias("name"), is_dir.alias("is_dir"), F.lit(False).alias("is_link"), part(2).cast("long").alias("size"), sc.listing_date(part(3), part(4), part(5), as_of).alias("mtime"), sc.novell_perms_bits(part(1), is_dir).alias("perms"))


#: Parsers by server system; more can be added.
PARSERS = {"unix": unix, "vms": lambda lines, as_of: vms(lines), "novell": novell}


def faults(lines: DataFrame, entries: DataFrame, budget: int = 20) -> DataFrame:
    """(site_id, bad, accepted): lines that are neither entry, header nor noise; a listing with more than budget of
    them is not accepted."""
    odd = cleaned(lines).where(~F.col("line").rlike(UNIX_HEADER)).join(entries.select("site_id", "line_no"), ["site_id", "line_no"], "left_anti")
    odd = odd.where(~F.col("line").rlike("^[bcps]"))
    return lines.select("site_id").distinct().join(odd.groupBy("site_id").agg(F.count("*").alias("bad")), "site_id", "left").select("site_id", F.coalesce("bad", F.lit(0)).alias("bad"), (F.coalesce("bad", F.lit(0)) <= budget).alias("accepted"))


def with_parents(entries: DataFrame) -> DataFrame:
    """entries with parent_line: the line of the directory that an entry stands in, null at the top."""
    own = F.when(F.col("dir") == "", F.col("name")).otherwise(F.concat("dir", F.lit("/"), "name"))
    dirs = entries.where("is_dir").select("site_id", own.alias("dir"), F.col("line_no").alias("parent_line"))
    return entries.join(dirs, ["site_id", "dir"], "left")
