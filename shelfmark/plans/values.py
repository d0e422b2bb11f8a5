"""Queries of scalar functions, of listing sources and of record headers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.functions import match
from shelfmark.functions import scalars as sc
from shelfmark.plans.book import SHOWN_TIME, SQL_TIME, Book
from shelfmark.plans.hosts import hosts, hosts_sql
from shelfmark.plans.markup import decoded
from shelfmark.sources import config, listings
from shelfmark.sources.catalog import FilesCatalog

BOOK = Book()

_A, _U = sc.ACCENTED, sc.UNACCENTED


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return FilesCatalog(spark, d).read(name)


# Text


@BOOK.query("f1_case_and_trim", "SELECT p_partkey, lower(p_name) AS lo, upper(p_name) AS up, trim('  ' || p_name || ' ') AS tr FROM part")
def case_and_trim(spark: SparkSession, d: str) -> DataFrame:
    name = F.col("p_name")
    return _table(spark, d, "part").select("p_partkey", F.lower(name).alias("lo"), F.upper(name).alias("up"), F.trim(F.concat(F.lit("  "), name, F.lit(" "))).alias("tr"))


@BOOK.query("f2_accent_fold", f"SELECT doc_id, md5(lower(translate(text, '{_A}', '{_U}'))) AS folded FROM documents")
def accent_fold(spark: SparkSession, d: str) -> DataFrame:
    """f3: what the accent- and case-insensitive mode compares."""
    return _table(spark, d, "documents").select("doc_id", F.md5(sc.fold(F.col("text"), "ciai")).alias("folded"))


@BOOK.query("f4_split", "SELECT s_suppkey, split_part(s_name, '#', 1) AS a, split_part(s_name, '#', 2) AS b, len(string_split(s_name, '0'))::INTEGER AS n FROM supplier")
def split(spark: SparkSession, d: str) -> DataFrame:
    name = F.col("s_name")
    return _table(spark, d, "supplier").select("s_suppkey", F.split_part(name, F.lit("#"), F.lit(1)).alias("a"), F.split_part(name, F.lit("#"), F.lit(2)).alias("b"), F.size(F.split(name, "0")).alias("n"))


@BOOK.query("f5_suffix_compare", hosts_sql("SELECT host, host LIKE '%.asia' AS hit FROM hosts"))
def suffix_compare(spark: SparkSession, d: str) -> DataFrame:
    return hosts(FilesCatalog(spark, d)).select("host", sc.ends_with_reversed(F.col("host"), F.lit(".asia")).alias("hit"))


@BOOK.query("f6_insert_delete", "SELECT p_partkey, substr(p_name, 1, 2) || '-' || substr(p_name, 3) AS ins, substr(p_name, 1, 1) || substr(p_name, 3) AS del FROM part")
def insert_delete(spark: SparkSession, d: str) -> DataFrame:
    return _table(spark, d, "part").select("p_partkey", sc.insert_char(F.col("p_name"), 3, "-").alias("ins"), sc.delete_char(F.col("p_name"), 2).alias("del"))


@BOOK.query("f7_position", "SELECT p_partkey, strpos(lower(p_name), 'ring')::INTEGER AS at FROM part")
def position(spark: SparkSession, d: str) -> DataFrame:
    return _table(spark, d, "part").select("p_partkey", F.instr(F.lower("p_name"), "ring").alias("at"))


@BOOK.query("f8_url_escapes", "SELECT page_id, url_encode(url) AS enc, url_decode(url_encode(url)) AS dec, 'a b c' AS plus FROM pages")
def url_escapes(spark: SparkSession, d: str) -> DataFrame:
    return _table(spark, d, "pages").select("page_id", F.url_encode("url").alias("enc"), F.url_decode(F.url_encode("url")).alias("dec"), sc.unplus(F.lit("a+b+c")).alias("plus"))


@BOOK.query("f9_quotes", """SELECT event_id, '"' || replace(replace(props, '\\', '\\\\'), '"', '\\"') || '"' AS quoted, props AS back FROM events""")
def quotes(spark: SparkSession, d: str) -> DataFrame:
    quoted = sc.escape_quotes(F.col("props"))
    return _table(spark, d, "events").select("event_id", quoted.alias("quoted"), sc.unescape_quotes(quoted).alias("back"))


@BOOK.query("f12_entities", f"SELECT page_id, md5({decoded('html')}) AS decoded FROM pages")
def entities(spark: SparkSession, d: str) -> DataFrame:
    return _table(spark, d, "pages").select("page_id", F.md5(sc.decode_entities(F.col("html"))).alias("decoded"))


@BOOK.query("f22_path_parts", "SELECT page_id, regexp_extract(url, '([^/]*)$', 1) AS base, regexp_replace(url, '/[^/]*$', '') AS dir FROM pages")
def path_parts(spark: SparkSession, d: str) -> DataFrame:
    """f25 as well."""
    return _table(spark, d, "pages").select("page_id", sc.basename(F.col("url")).alias("base"), sc.dirname(F.col("url")).alias("dir"))


@BOOK.query("f23_substitution", "SELECT p_partkey, 'find ' || p_brand || ' of ' || p_type || ' for $5' AS line FROM part")
def substitution(spark: SparkSession, d: str) -> DataFrame:
    line = F.replace(sc.substitute(F.lit("find $brand of $kind for $5"), {"kind": "KIND"}), F.lit("$brand"), F.col("p_brand"))
    return _table(spark, d, "part").select("p_partkey", F.replace(line, F.lit("KIND"), F.col("p_type")).alias("line"))


@BOOK.query("f24_tokens", """SELECT p_partkey, len(regexp_extract_all('find "' || p_name || '" ' || p_type, '"[^"]*"|[^\\s"]+'))::INTEGER AS n, p_name AS phrase FROM part""")
def tokens(spark: SparkSession, d: str) -> DataFrame:
    found = sc.tokens(F.concat(F.lit('find "'), F.col("p_name"), F.lit('" '), F.col("p_type")))
    return _table(spark, d, "part").select("p_partkey", F.size(found).alias("n"), F.get(found, 1).alias("phrase"))


@BOOK.query("f26_same_items", "SELECT p_partkey, list_sort(string_split(p_name, ' ')) = list_sort(['ring', 'small']) AS same FROM part")
def same_items(spark: SparkSession, d: str) -> DataFrame:
    return _table(spark, d, "part").select("p_partkey", sc.same_items(F.split("p_name", " "), F.array(F.lit("small"), F.lit("ring"))).alias("same"))


# Permissions, times, addresses


_BITS = " || ".join(f"CASE WHEN p & {1 << (8 - i)} <> 0 THEN '{'rwx'[i % 3]}' ELSE '-' END" for i in range(9))


@BOOK.query("f16_vms_dates", "SELECT event_id, strftime(ts, '%d-%b-%Y %H:%M') AS shown FROM events")
def vms_dates(spark: SparkSession, d: str) -> DataFrame:
    return _table(spark, d, "events").select("event_id", sc.vms_time(F.col("ts")).alias("shown"))


@BOOK.query("f13_permissions", f"SELECT l_orderkey, p, {_BITS} AS shown, p AS back FROM (SELECT DISTINCT l_orderkey, (l_orderkey % 512)::INTEGER AS p FROM lineitem)")
def permissions(spark: SparkSession, d: str) -> DataFrame:
    """f14: bits to text and back."""
    told = _table(spark, d, "lineitem").select("l_orderkey", (F.col("l_orderkey") % 512).cast("int").alias("p")).distinct()
    told = told.withColumn("shown", sc.perms_text(F.col("p")))
    return told.withColumn("back", sc.perms_bits(F.concat(F.lit("-"), F.col("shown"))))


@BOOK.query("f15_listing_dates", f"SELECT event_id, strftime(TRY(make_timestamp(CASE WHEN month(ts) > 1 THEN 2023 ELSE 2024 END, month(ts), day(ts), hour(ts), minute(ts), 0)), {SQL_TIME}) AS recent, strftime(date_trunc('day', ts), {SQL_TIME}) AS dated FROM events")
def listing_dates(spark: SparkSession, d: str) -> DataFrame:
    """Month, day and a clock time or a year, as of January 2024."""
    ts = F.col("ts")
    as_of = F.to_timestamp_ntz(F.lit("2024-01-15 00:00:00"))
    part = lambda p: F.date_format(ts, p)
    told = _table(spark, d, "events")
    recent, dated = (sc.listing_date(part("MMM"), part("d"), last, as_of) for last in (part("HH:mm"), part("yyyy")))
    return told.select("event_id", F.date_format(recent, SHOWN_TIME).alias("recent"), F.date_format(dated, SHOWN_TIME).alias("dated"))


@BOOK.query("f17_compact_times", "SELECT event_id, strftime(ts, '%Y%m%d%H%M%S') AS compact, strftime(date_trunc('second', ts), " + SQL_TIME + ") AS back FROM events")
def compact_times(spark: SparkSession, d: str) -> DataFrame:
    compact = sc.compact_time(F.col("ts"))
    return _table(spark, d, "events").select("event_id", compact.alias("compact"), F.date_format(sc.parse_compact(compact), SHOWN_TIME).alias("back"))


@BOOK.query("f18_http_dates", f"SELECT event_id, strftime(date_trunc('second', ts), {SQL_TIME}) AS rfc1123, strftime(date_trunc('second', ts), {SQL_TIME}) AS asctime FROM events")
def http_dates(spark: SparkSession, d: str) -> DataFrame:
    shown = lambda p: F.date_format(sc.http_date(F.date_format("ts", p)), SHOWN_TIME)
    return _table(spark, d, "events").select("event_id", shown("EEE, dd MMM yyyy HH:mm:ss 'GMT'").alias("rfc1123"), shown("EEE MMM d HH:mm:ss yyyy").alias("asctime"))


@BOOK.query("f19_epoch", "SELECT event_id, floor(epoch(ts))::BIGINT AS seconds FROM events")
def epoch(spark: SparkSession, d: str) -> DataFrame:
    return _table(spark, d, "events").select("event_id", F.unix_timestamp(F.col("ts").cast("timestamp")).alias("seconds"))


@BOOK.query("f20_addresses", "SELECT user_id, (user_id * 65537) % 4294967296 AS n, ((n >> 24) & 255) || '.' || ((n >> 16) & 255) || '.' || ((n >> 8) & 255) || '.' || (n & 255) AS ip, n AS back FROM (SELECT DISTINCT user_id FROM events)")
def dotted(spark: SparkSession, d: str) -> DataFrame:
    told = _table(spark, d, "events").select("user_id").distinct().withColumn("n", F.col("user_id") * 65537 % 4294967296)
    return told.withColumn("ip", sc.dotted(F.col("n"))).withColumn("back", sc.ip_number(F.col("ip")))


@BOOK.query("f21_access_ports", "SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN 21 ELSE (8000 + s_suppkey % 100)::INTEGER END AS port FROM supplier")
def access_ports(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("s_suppkey")
    command = F.concat(F.lit("anonftp:/pub:"), F.when(k % 3 == 0, "").otherwise((8000 + k % 100).cast("string")))
    return _table(spark, d, "supplier").select("s_suppkey", sc.access_port(command, 21).alias("port"))


@BOOK.query("f27_status_names", "SELECT o_orderkey, CASE o_orderstatus WHEN 'O' THEN 'active' WHEN 'F' THEN 'disabled' ELSE 'unknown' END AS status FROM orders")
def status_names(spark: SparkSession, d: str) -> DataFrame:
    return _table(spark, d, "orders").select("o_orderkey", sc.named(F.col("o_orderstatus"), {"O": "active", "F": "disabled"}).alias("status"))


@BOOK.query("p23_valid_keywords", "SELECT p_partkey, length(p_name || p_type) <= 50 AND len(regexp_extract_all(p_name, '[^\\x00-\\x7F]')) * 4 <= length(p_name) AS valid FROM part")
def valid_keywords(spark: SparkSession, d: str) -> DataFrame:
    return _table(spark, d, "part").select("p_partkey", match.valid_keyword(F.concat("p_name", "p_type")).alias("valid"))


# Listings: the catalog's entries written as each system's listing, and read back


def _listed(spark: SparkSession, d: str) -> DataFrame:
    """(site_id, line_no, dir_id, s, size, mtime) in the order of a listing."""
    from pyspark.sql import Window

    entries = FilesCatalog(spark, d).entries
    w = Window.partitionBy("site_id").orderBy("dir_id", "s")
    return entries.select("site_id", "dir_id", "s", F.col("size").cast("long").alias("size"), "mtime", (F.row_number().over(w) * 2).alias("line_no"))


def _lines(listed: DataFrame, header, entry) -> DataFrame:
    """The entries' lines, and one before the first of each directory."""
    from pyspark.sql import Window

    before = F.lag(F.struct("dir_id")).over(Window.partitionBy("site_id").orderBy("dir_id", "s"))
    own = F.struct("line_no", "line")
    head = F.struct((F.col("line_no") - 1).alias("line_no"), header.alias("line"))
    told = listed.withColumn("line", entry).withColumn("starts", ~before.eqNullSafe(F.struct("dir_id")))
    return told.select("site_id", F.explode(F.when(F.col("starts"), F.array(head, own)).otherwise(F.array(own))).alias("x")).select("site_id", "x.*")


_READ_BACK = "SELECT site_id, dir_id::VARCHAR AS dir, s AS name, trunc(size)::BIGINT AS size, strftime({}, '%Y-%m-%d %H:%M') AS mtime, {} AS perms FROM f_entries"


def _read(entries: DataFrame) -> DataFrame:
    return entries.select("site_id", "dir", "name", "size", F.date_format("mtime", "yyyy-MM-dd HH:mm").alias("mtime"), "perms")


@BOOK.files("s12_unix_listing", _READ_BACK.format("date_trunc('day', mtime)", "420"))
def unix_listing(spark: SparkSession, d: str) -> DataFrame:
    """s15, s16, s17, x9."""
    listed = _listed(spark, d)
    entry = F.concat(F.lit("-rw-r--r--   1 ftp ftp "), F.col("size").cast("string"), F.lit(" "), F.date_format("mtime", "MMM d yyyy"), F.lit(" "), F.col("s"))
    lines = _lines(listed, F.concat(F.lit("./"), F.col("dir_id").cast("string"), F.lit(":")), entry)
    return _read(listings.PARSERS["unix"](lines, F.to_timestamp_ntz(F.lit("2024-06-01 00:00:00"))))


@BOOK.files("s13_vms_listing", _READ_BACK.format("date_trunc('minute', mtime)", "(15 * 4096 + 15 * 256 + 10 * 16)"))
def vms_listing(spark: SparkSession, d: str) -> DataFrame:
    listed = _listed(spark, d)
    entry = F.concat(F.col("s"), F.lit(";1  "), F.col("size").cast("string"), F.lit("  "), F.date_format("mtime", "d-MMM-yyyy HH:mm"), F.lit("  [1,4]  (RWED,RWED,RE,)"))
    return _read(listings.PARSERS["vms"](_lines(listed, F.concat(F.lit("["), F.col("dir_id").cast("string"), F.lit("]")), entry), None))


@BOOK.files("s14_novell_listing", _READ_BACK.format("date_trunc('day', mtime)", "292"))
def novell_listing(spark: SparkSession, d: str) -> DataFrame:
    listed = _listed(spark, d)
    entry = F.concat(F.lit("- [R----F--] supervisor "), F.col("size").cast("string"), F.lit(" "), F.date_format("mtime", "MMM dd yyyy"), F.lit(" "), F.col("s"))
    return _read(listings.PARSERS["novell"](_lines(listed, F.concat(F.col("dir_id").cast("string"), F.lit(":")), entry), F.to_timestamp_ntz(F.lit("2024-06-01 00:00:00"))))


@BOOK.query("s25_headers", hosts_sql(f"SELECT host, strftime(retrieve_time, {SQL_TIME}) AS retrieved, site_id AS no_recs, status FROM hosts"))
def headers(spark: SparkSession, d: str) -> DataFrame:
    """Headers written as text and read back."""
    told = hosts(FilesCatalog(spark, d))
    value = {"primary_hostname": F.col("host"), "retrieve_time": F.col("retrieve_time").cast("timestamp"), "no_recs": F.col("site_id"), "status": F.col("status")}
    struct = F.struct(*(value.get(k, F.lit(None)).cast(t).alias(k) for k, t in config.HEADER.items()))
    back = config.read_headers(config.write_headers(told.select(struct.alias("header"))).select("text"))
    h = F.col("header")
    return back.select(h["primary_hostname"].alias("host"), F.date_format(h["retrieve_time"], SHOWN_TIME).alias("retrieved"), h["no_recs"].alias("no_recs"), h["status"].alias("status"))


# Shapes of image maps


@BOOK.query("p33_shapes", "SELECT event_id, value BETWEEN 10 AND 50 AND user_id BETWEEN 5 AND 60 AS rect, (value - 30) * (value - 30) + (user_id - 30) * (user_id - 30) <= 400 AS circle, value >= 0 AND user_id > 0 AND value < 60 - user_id AS triangle FROM events")
def shapes(spark: SparkSession, d: str) -> DataFrame:
    x, y = F.col("value"), F.col("user_id").cast("double")
    told = _table(spark, d, "events")
    triangle = sc.in_polygon(x, y, [(0.0, 0.0), (60.0, 0.0), (0.0, 60.0)])
    return told.select("event_id", sc.in_rectangle(x, y, (10, 5, 50, 60)).alias("rect"), sc.in_circle(x, y, (30, 30), 20).alias("circle"), (triangle & (y > 0)).alias("triangle"))
