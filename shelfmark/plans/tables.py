"""Queries of stored tables: keyed access, dumps, host names, lookups, robots files, gopher menus, cursors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shelfmark.functions import match
from shelfmark.functions import scalars as sc
from shelfmark.operators import browse, refresh, web
from shelfmark.operators import search as find
from shelfmark.plans import boolean
from shelfmark.plans.book import Book, shown
from shelfmark.plans.hosts import hosts, hosts_sql
from shelfmark.sources import config
from shelfmark.sources.catalog import FilesCatalog, files_sql
from shelfmark.streaming.tables import scratch

BOOK = Book()


def _read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return FilesCatalog(spark, d).read(name)


def _hosts(spark: SparkSession, d: str) -> DataFrame:
    return hosts(FilesCatalog(spark, d))


# Keyed tables


@BOOK.query("s10_put_and_delete", "SELECT c_custkey, c_name, c_acctbal + CASE WHEN c_mktsegment = 'BUILDING' THEN 1 ELSE 0 END AS c_acctbal FROM customer WHERE c_mktsegment <> 'MACHINERY'")
def put_and_delete(spark: SparkSession, d: str) -> DataFrame:
    """One segment's rows put anew, one segment's keys deleted."""
    stored = _read(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal", "c_mktsegment")
    put = stored.where("c_mktsegment = 'BUILDING'").withColumn("c_acctbal", F.col("c_acctbal") + 1)
    kept = refresh.delete_sites(refresh.upsert(stored, put, ["c_custkey"]), stored.where("c_mktsegment = 'MACHINERY'"), "c_custkey")
    return kept.select("c_custkey", "c_name", "c_acctbal")


@BOOK.query("s11_host_names", hosts_sql("SELECT host FROM hosts ORDER BY lower(host)"))
def host_names(spark: SparkSession, d: str) -> DataFrame:
    """o6: every host, in case-insensitive order."""
    return _hosts(spark, d).orderBy(F.lower("host")).select("host")


@BOOK.query("s30_dump_and_restore", hosts_sql("SELECT host, ip, status, fail_count FROM hosts"))
def dump_and_restore(spark: SparkSession, d: str) -> DataFrame:
    """The host table written as text and read back."""
    told = _hosts(spark, d).select("host", "ip", "status", "fail_count")
    folder = scratch(spark, "dump")
    told.write.option("sep", "\t").csv(folder)
    return spark.read.schema(told.schema).option("sep", "\t").csv(folder)


@BOOK.query("s36_key_range", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey BETWEEN 100 AND 5000 ORDER BY o_orderkey")
def key_range(spark: SparkSession, d: str) -> DataFrame:
    """A range of keys in order; the bounds reach the scan."""
    return _read(spark, d, "orders").where(F.col("o_orderkey").between(100, 5000)).orderBy("o_orderkey").select("o_orderkey", "o_totalprice")


@BOOK.query("e1_dictionary", files_sql("SELECT s, count(*) AS entries FROM f_entries GROUP BY s"))
def dictionary(spark: SparkSession, d: str) -> DataFrame:
    """s5: entries that hold a name's hash instead of the name, joined back to the dictionary."""
    c = FilesCatalog(spark, d)
    coded = c.entries.select(F.xxhash64("s").alias("string_id"))
    names = c.strings.select(F.xxhash64("s").alias("string_id"), "s")
    return coded.groupBy("string_id").agg(F.count("*").alias("entries")).join(names, "string_id").select("s", "entries")


@BOOK.query("e5_hosts_upsert", hosts_sql("SELECT host, CASE WHEN status = 'disabled' THEN 'active' ELSE status END AS status, CASE WHEN status = 'disabled' THEN 0 ELSE fail_count END AS fail_count FROM hosts UNION ALL SELECT 'new.' || host, 'active', 0 FROM hosts WHERE force"))
def hosts_upsert(spark: SparkSession, d: str) -> DataFrame:
    """e7: disabled hosts come back with clean records, and new hosts join."""
    told = _hosts(spark, d).select("host", "status", "fail_count", "force")
    clean = lambda df: df.withColumns({"status": F.lit("active"), "fail_count": F.lit(0).cast("long")})
    back = clean(told.where("status = 'disabled'"))
    new = clean(told.where("force").withColumn("host", F.concat(F.lit("new."), "host")))
    return refresh.upsert(told, back.unionByName(new), ["host"]).select("host", "status", "fail_count")


# Host lookups


@BOOK.query("j20_preferred_names", hosts_sql("SELECT host, CASE WHEN force THEN 'ftp.' || host ELSE host END AS preferred FROM hosts"))
def preferred_names(spark: SparkSession, d: str) -> DataFrame:
    """x14, x15: a preferred name by the host's name, whatever its case; else the name itself."""
    told = _hosts(spark, d)
    preferred = told.where("force").select(F.upper("host").alias("name"), F.concat(F.lit("ftp."), "host").alias("preferred"))
    return browse.preferred(told.select("host"), preferred)


@BOOK.query("p30_networks", hosts_sql("SELECT host, ip LIKE '10.2.%' OR ip = '10.1.0.1' AS allowed FROM hosts"))
def networks(spark: SparkSession, d: str) -> DataFrame:
    """A host is allowed by its address or by its network."""
    ip = F.col("ip")
    return _hosts(spark, d).select("host", (ip.isin("10.1.0.1") | F.substring_index(ip, ".", 2).isin("10.2")).alias("allowed"))


@BOOK.query("x1_domain_file", "SELECT 'north' AS name, unnest(['nation-1.europe', 'nation-2.asia', 'fr']) AS suffix UNION ALL SELECT 'south', 'fr'")
def domain_file(spark: SparkSession, d: str) -> DataFrame:
    """q7: pseudo-domains loaded from text and unfolded."""
    return browse.expand_domains(config.domain_table(spark, "# two\nnorth nation-1.europe:nation-2.asia:south \\\n the north\nsouth fr the south\n"))


@BOOK.query("s23_robots", r"SELECT DISTINCT h AS hostname, a AS agent, '/en/9' AS prefix FROM (SELECT lower(regexp_extract(url, '^[a-z]+://([^/:?#]*)', 1)) AS h FROM pages), (VALUES ('*'), ('crawler')) AS t(a)")
def robots(spark: SparkSession, d: str) -> DataFrame:
    """A robots file for every host of the pages, parsed: two agents in a row share a rule."""
    files = _read(spark, d, "pages").select(sc.url_host(F.col("url")).alias("hostname")).distinct()
    return web.robots(files.withColumn("text", F.lit("# all\nUser-agent: *\nUser-Agent: crawler # ours\nDisallow: /en/9\nDisallow:\n")))


# Pages and words


@BOOK.query("p24_stop_words", "SELECT doc_id, count(*) FILTER (w IN ('the', 'and', 'of', 'to', 'in')) AS stopped FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS w FROM documents) GROUP BY doc_id")
def stop_words(spark: SparkSession, d: str) -> DataFrame:
    words = F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))
    told = _read(spark, d, "documents").select("doc_id", words.alias("w")).where(F.size("w") > 0)
    return told.select("doc_id", F.size(F.filter("w", lambda w: w.isin("the", "and", "of", "to", "in"))).cast("long").alias("stopped"))


@BOOK.query("o9_urls_in_order", "SELECT lower(url) AS url FROM pages ORDER BY 1")
def urls_in_order(spark: SparkSession, d: str) -> DataFrame:
    return _read(spark, d, "pages").select(F.lower("url").alias("url")).orderBy("url")


@BOOK.query("o13_extern_limit", r"SELECT DISTINCT lower(regexp_extract(url, '^[a-z]+://([^/:?#]*)', 1)) AS hostname FROM pages ORDER BY 1 LIMIT 25")
def extern_limit(spark: SparkSession, d: str) -> DataFrame:
    """At most so many new sites a run."""
    return _read(spark, d, "pages").select(sc.url_host(F.col("url")).alias("hostname")).distinct().orderBy("hostname").limit(25)


@BOOK.query("b9_documents_of_words", r"SELECT w AS word, count(DISTINCT doc_id) AS docs FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+(?:-[\p{L}\p{N}]+)*')) AS key FROM documents), (VALUES ('the'), ('der'), ('que')) AS t(w) WHERE starts_with(key, w) AND length(key) <= 50 AND len(regexp_extract_all(key, '[^\x00-\x7F]')) * 4 <= length(key) GROUP BY w")
def documents_of_words(spark: SparkSession, d: str) -> DataFrame:
    """Documents of each of several words, in one pass over the words."""
    words = web.keywords(_read(spark, d, "documents"), "doc_id", F.col("text"), stop_words=())
    told = words.select("doc_id", F.explode(F.filter(F.array(*(F.lit(w) for w in ("the", "der", "que"))), lambda w: F.startswith(F.col("key"), w))).alias("word"))
    return told.groupBy("word").agg(F.countDistinct("doc_id").alias("docs"))


# Sets of names


@BOOK.query("b5_boolean_strings", files_sql("SELECT s FROM f_strings WHERE (contains(s, 'hot') AND contains(s, 'ring') AND NOT contains(s, 'promo')) OR contains(s, 'old_gear')"))
def boolean_strings(spark: SparkSession, d: str) -> DataFrame:
    """b1, b4, b14: a parsed request as one filter; names alone."""
    return find.boolean_strings(FilesCatalog(spark, d).strings, boolean.parse("Ring HOT not promo OR old_gear"))


@BOOK.query("b12_concatenated", files_sql("SELECT s, count(*) AS n FROM (SELECT s FROM f_strings WHERE contains(s, 'red') UNION ALL SELECT s FROM f_strings WHERE contains(s, 'ring')) GROUP BY s"))
def concatenated(spark: SparkSession, d: str) -> DataFrame:
    """a18, a19: two selections one behind the other, then each name once, with how often it came."""
    strings = FilesCatalog(spark, d).strings
    having = lambda w: strings.where(match.substring(F.col("s"), w))
    return having("red").unionAll(having("ring")).groupBy("s").agg(F.count("*").alias("n"))


@BOOK.query("o16_cursor_text", files_sql("SELECT s, hostname, path, size, strftime(mtime, '%Y-%m-%d %H:%M:%S') AS mtime FROM f_entries JOIN f_sites USING (site_id) WHERE contains(s, 'hot_ring') AND (s, site_id, dir_id) > (SELECT (s, site_id, dir_id) FROM f_entries WHERE contains(s, 'hot_ring') ORDER BY s, site_id, dir_id LIMIT 1) ORDER BY s, f_entries.site_id, dir_id LIMIT 20"))
def cursor_text(spark: SparkSession, d: str) -> DataFrame:
    """A cursor kept as text: the page behind the first hit."""
    c = FilesCatalog(spark, d)
    hits = find.search(c, find.Request("hot_ring"))
    first = find.after(hits, None, 1).first()
    return shown(find.after(hits, find.cursor_of(first) if first else None, 20))


# Menus of linked sites


@BOOK.query("j23_menus", "SELECT m.c_custkey AS menu, i.o_orderkey AS item, '/' || m.c_name || '/' || i.o_orderpriority AS title FROM customer m JOIN orders i ON i.o_custkey = m.c_custkey")
def menus(spark: SparkSession, d: str) -> DataFrame:
    """q4, x23: menu items by their menu, a join on the key instead of a chain of records."""
    menu, item = _read(spark, d, "customer"), _read(spark, d, "orders")
    joined = item.join(menu, F.col("o_custkey") == F.col("c_custkey"))
    return joined.select(F.col("c_custkey").alias("menu"), F.col("o_orderkey").alias("item"), F.concat(F.lit("/"), "c_name", F.lit("/"), "o_orderpriority").alias("title"))


@BOOK.query("j7_ancestors", "WITH RECURSIVE t AS (SELECT p_partkey AS node, CASE WHEN p_partkey = 0 THEN NULL ELSE (p_partkey - 1) // 4 END AS parent FROM part), w AS (SELECT node, parent FROM t WHERE parent IS NOT NULL UNION ALL SELECT w.node, t.parent FROM w JOIN t ON t.node = w.parent WHERE t.parent IS NOT NULL) SELECT node AS node_id, count(*) AS ancestors FROM w GROUP BY node")
def ancestors(spark: SparkSession, d: str) -> DataFrame:
    """How many directories stand above each entry of a tree."""
    key = F.col("p_partkey")
    tree = _read(spark, d, "part").select(F.lit(0).alias("tree_id"), key.alias("node_id"), F.when(key > 0, F.floor((key - 1) / 4)).alias("parent_id"), key.cast("string").alias("name"))
    return browse.tree_paths(tree).where("depth > 0").select("node_id", F.col("depth").cast("long").alias("ancestors"))


@BOOK.query("x9_clean_listing", "SELECT o_orderkey, '-rw-r--r-- 1' || (o_orderkey % 9)::VARCHAR || ' ftp' AS line FROM orders WHERE o_orderstatus <> 'P'")
def clean_listing(spark: SparkSession, d: str) -> DataFrame:
    """Lines with link counts grown into the permissions parted; totals (here: orders in process) dropped."""
    from shelfmark.sources import listings

    key = F.col("o_orderkey")
    line = F.when(F.col("o_orderstatus") == "P", F.concat(F.lit("total "), key.cast("string"))).otherwise(F.concat(F.lit("-rw-r--r--1"), (key % 9).cast("string"), F.lit(" ftp")))
    return listings.cleaned(_read(spark, d, "orders").select("o_orderkey", line.alias("line")))


@BOOK.query("a12_last_index", hosts_sql("SELECT host, catalog, idx FROM (SELECT host, c AS catalog, row_number() OVER (PARTITION BY host ORDER BY c)::INTEGER AS idx FROM (SELECT host, unnest(access_methods) AS c FROM hosts)) QUALIFY idx = max(idx) OVER (PARTITION BY host)"))
def last_index(spark: SparkSession, d: str) -> DataFrame:
    """The last of a host's numbered catalogs."""
    told = _hosts(spark, d).select("host", F.explode("access_methods").alias("catalog"))
    told = told.withColumn("idx", F.row_number().over(Window.partitionBy("host").orderBy("catalog")))
    best = told.groupBy("host").agg(F.max(F.struct("idx", "catalog")).alias("best"))
    return best.select("host", F.col("best.catalog").alias("catalog"), F.col("best.idx").alias("idx"))
