"""Queries for refreshing and checking catalogs: snapshots, upserts, hosts, exchange, statistics, consistency."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.operators import browse, refresh, stats, web
from shelfmark.plans.book import SHOWN_TIME, SQL_TIME, Book
from shelfmark.plans.hosts import hosts, hosts_sql
from shelfmark.plans.markup import HOST
from shelfmark.plans.webtext import D_WORDS, W_WORDS
from shelfmark.sources import config
from shelfmark.sources.catalog import FilesCatalog

BOOK = Book()


def _stamp(text: str) -> Column:
    return F.to_timestamp_ntz(F.lit(text))


def _hosts(spark: SparkSession, d: str) -> DataFrame:
    return hosts(FilesCatalog(spark, d))


# Two snapshots of the files catalog: entries of the line items without flag A, and of those without flag N


def _snapshots(c: FilesCatalog) -> tuple[DataFrame, DataFrame]:
    items = c.read("lineitem")
    return c.entries_of(items.where("l_returnflag != 'A'")), c.entries_of(items.where("l_returnflag != 'N'"))


_SNAP = "".join(f", {name} AS (SELECT l_suppkey AS site_id, l_orderkey AS dir_id, s, max(l_extendedprice) AS size FROM lineitem JOIN f_name ON l_partkey = p_partkey WHERE l_returnflag <> '{flag}' GROUP BY ALL)" for name, flag in (("o", "A"), ("n", "N")))


@BOOK.query("j16_snapshot_diff", hosts_sql("SELECT change, count(*) AS n FROM (SELECT CASE WHEN o.s IS NULL THEN 'added' WHEN n.s IS NULL THEN 'removed' WHEN o.size = n.size THEN 'same' ELSE 'changed' END AS change FROM o FULL OUTER JOIN n ON o.site_id = n.site_id AND o.dir_id = n.dir_id AND o.s = n.s) GROUP BY change", _SNAP))
def snapshot_diff(spark: SparkSession, d: str) -> DataFrame:
    old, new = _snapshots(FilesCatalog(spark, d))
    return refresh.diff(old, new, ["site_id", "dir_id", "s"], ["size"]).groupBy("change").agg(F.count("*").alias("n"))


@BOOK.query("e2_replace_sites", hosts_sql("SELECT site_id, count(*) AS n, round(sum(size), 2) AS bytes FROM (SELECT site_id, size FROM o WHERE site_id NOT IN (SELECT site_id FROM hosts WHERE force) UNION ALL SELECT site_id, size FROM n WHERE site_id IN (SELECT site_id FROM hosts WHERE force)) GROUP BY site_id", _SNAP))
def replace_sites(spark: SparkSession, d: str) -> DataFrame:
    """The sites whose update is forced, from the new snapshot."""
    c = FilesCatalog(spark, d)
    old, new = _snapshots(c)
    return refresh.replace_sites(old, new.join(hosts(c).where("force").select("site_id"), "site_id", "left_semi"), sites=hosts(c).where("force")).groupBy("site_id").agg(F.count("*").alias("n"), F.round(F.sum("size"), 2).alias("bytes"))


@BOOK.query("e3_delete_sites", hosts_sql("SELECT site_id, count(*) AS n FROM f_entries WHERE site_id NOT IN (SELECT site_id FROM hosts WHERE status = 'deleted') GROUP BY site_id"))
def delete_sites(spark: SparkSession, d: str) -> DataFrame:
    c = FilesCatalog(spark, d)
    return refresh.delete_sites(c.entries, hosts(c).where("status = 'deleted'")).groupBy("site_id").agg(F.count("*").alias("n"))


@BOOK.query("a17_new_strings", hosts_sql("SELECT DISTINCT s FROM f_strings WHERE s NOT IN (SELECT s FROM o JOIN hosts USING (site_id) WHERE status = 'disabled')", _SNAP))
def new_strings(spark: SparkSession, d: str) -> DataFrame:
    c = FilesCatalog(spark, d)
    return refresh.new_strings(c.names, _snapshots(c)[0].join(hosts(c).where("status = 'disabled'").select("site_id"), "site_id", "left_semi").select("s").distinct())


@BOOK.query("a7_posting_lists", hosts_sql("SELECT s, string_agg(site_id, ',' ORDER BY site_id) AS sites FROM f_postings GROUP BY s"))
def posting_lists(spark: SparkSession, d: str) -> DataFrame:
    postings = FilesCatalog(spark, d).postings
    return postings.groupBy("s").agg(F.array_join(F.array_sort(F.collect_set("site_id")), ",").alias("sites"))


@BOOK.query("e4_postings_upsert", hosts_sql("SELECT s, site_id FROM o UNION SELECT s, site_id FROM n", _SNAP))
def postings_upsert(spark: SparkSession, d: str) -> DataFrame:
    old, new = (x.select("s", "site_id").distinct() for x in _snapshots(FilesCatalog(spark, d)))
    return refresh.upsert(old, new, ["s", "site_id"])


@BOOK.query("e22_missing_postings", hosts_sql("SELECT s, site_id FROM f_postings EXCEPT SELECT s, site_id FROM o", _SNAP))
def missing_postings(spark: SparkSession, d: str) -> DataFrame:
    c = FilesCatalog(spark, d)
    return refresh.missing_postings(c.entries, _snapshots(c)[0].select("s", "site_id").distinct())


# Documents and hosts by time


_J18 = "WITH st AS (SELECT doc_id, n_chars, doc_id % 10 AS rdate FROM documents WHERE source <> 'src7'), inc AS (SELECT doc_id, n_chars + 1 AS n_chars, doc_id % 7 AS rdate FROM documents WHERE lang IS NULL OR lang <> 'en')"


@BOOK.query("j18_partial_update", f"{_J18} SELECT coalesce(inc.doc_id, st.doc_id) AS doc_id, CASE WHEN st.doc_id IS NULL OR inc.rdate > st.rdate THEN inc.n_chars ELSE st.n_chars END AS n_chars FROM st FULL OUTER JOIN inc ON st.doc_id = inc.doc_id")
def partial_update(spark: SparkSession, d: str) -> DataFrame:
    """e16, t2, t3: an incoming document replaces a stored one only if its time is later."""
    docs = FilesCatalog(spark, d).read("documents")
    stored = docs.where("source != 'src7'").select("doc_id", "n_chars", (F.col("doc_id") % 10).alias("rdate"))
    incoming = docs.where("lang is null or lang != 'en'").select("doc_id", (F.col("n_chars") + 1).alias("n_chars"), (F.col("doc_id") % 7).alias("rdate"))
    return refresh.upsert(stored, incoming, ["doc_id"], "rdate").select("doc_id", "n_chars")


@BOOK.query("e15_reused_documents", f"{_J18} SELECT st.doc_id FROM st JOIN inc ON st.doc_id = inc.doc_id WHERE inc.rdate <= st.rdate")
def reused_documents(spark: SparkSession, d: str) -> DataFrame:
    """p21: documents not modified since the stored copy keep it."""
    docs = FilesCatalog(spark, d).read("documents")
    stored = docs.where("source != 'src7'").select("doc_id", (F.col("doc_id") % 10).alias("stored"))
    incoming = docs.where("lang is null or lang != 'en'").select("doc_id", (F.col("doc_id") % 7).alias("offered"))
    return stored.join(incoming, "doc_id").where("offered <= stored").select("doc_id")


@BOOK.query("j17_wanted_tuples", hosts_sql("SELECT host, 'anonftp' AS catalog FROM hosts WHERE force OR (site_id % 2 = 0 AND status NOT IN ('disabled', 'deleted'))"))
def wanted_tuples(spark: SparkSession, d: str) -> DataFrame:
    """Offers for all hosts; the local table lacks those that are forced, and has later times for odd numbers."""
    told = _hosts(spark, d).withColumn("catalog", F.lit("anonftp"))
    shift = F.make_dt_interval(F.when(F.col("site_id") % 2 == 0, -1).otherwise(1))
    local = told.where("not force").withColumn("retrieve_time", F.col("retrieve_time") + shift)
    return refresh.wanted_tuples(told.select("host", "catalog", "retrieve_time"), local).select("host", "catalog")


@BOOK.query("q11_changed_sites", hosts_sql(f"SELECT host, unnest(access_methods) AS catalog, strftime(retrieve_time, {SQL_TIME}) AS retrieved FROM hosts WHERE retrieve_time > TIMESTAMP '2024-01-02 12:00:00' OR force"))
def changed_sites(spark: SparkSession, d: str) -> DataFrame:
    """j11, p27: catalogs retrieved after a time, a row for each access method."""
    found = refresh.changed_since(_hosts(spark, d), _stamp("2024-01-02 12:00:00"))
    return found.select("host", "catalog", F.date_format("retrieve_time", SHOWN_TIME).alias("retrieved"))


@BOOK.query("o8_by_retrieve_time", hosts_sql("SELECT host FROM hosts ORDER BY retrieve_time DESC, host LIMIT 30"))
def by_retrieve_time(spark: SparkSession, d: str) -> DataFrame:
    """o12: thirty sites for a session, the latest first."""
    return _hosts(spark, d).orderBy(F.desc("retrieve_time"), "host").limit(30).select("host")


@BOOK.query("a11_latest", hosts_sql(f"SELECT status, strftime(max(retrieve_time), {SQL_TIME}) AS latest, max(site_id) AS last_id FROM hosts GROUP BY status"))
def latest(spark: SparkSession, d: str) -> DataFrame:
    """a12 as well: the last number of a group."""
    return _hosts(spark, d).groupBy("status").agg(F.date_format(F.max("retrieve_time"), SHOWN_TIME).alias("latest"), F.max("site_id").alias("last_id"))


@BOOK.query("a14_failures", hosts_sql("SELECT host, c AS fail_count, CASE WHEN c > 2 AND tried AND NOT ok THEN 'deleted' ELSE status END AS status FROM (SELECT *, CASE WHEN NOT tried THEN fail_count WHEN ok THEN 0 ELSE fail_count + 1 END AS c FROM (SELECT *, status <> 'disabled' AS tried, force AS ok FROM hosts))"))
def failures(spark: SparkSession, d: str) -> DataFrame:
    told = _hosts(spark, d)
    tried = told.where("status != 'disabled'").select("host", F.col("force").alias("ok"))
    return refresh.failures(told, tried).select("host", F.col("fail_count").cast("long").alias("fail_count"), "status")


@BOOK.query("e20_due", hosts_sql("SELECT host FROM hosts WHERE status = 'active' AND update_time < TIMESTAMP '2024-01-09 00:00:00' - INTERVAL 5 DAY"))
def due(spark: SparkSession, d: str) -> DataFrame:
    """p28: only active hosts."""
    return refresh.due(_hosts(spark, d), _stamp("2024-01-09 00:00:00"), 5).select("host")


@BOOK.query("e6_host_faults", hosts_sql("SELECT host, CASE WHEN ip IS NULL THEN 'no_address' WHEN port NOT BETWEEN 1 AND 65535 THEN 'bad_port' WHEN known AND moved THEN 'address_changed' WHEN known THEN 'already_known' ELSE 'ok' END AS status FROM (SELECT host, CASE WHEN site_id % 13 = 0 THEN NULL ELSE ip END AS ip, CASE WHEN site_id % 17 = 0 THEN 0 ELSE 21 END AS port, status = 'active' AS known, force AS moved FROM hosts)"))
def host_faults(spark: SparkSession, d: str) -> DataFrame:
    told = _hosts(spark, d)
    k = F.col("site_id")
    asked = told.select("host", F.when(k % 13 != 0, F.col("ip")).alias("ip"), F.when(k % 17 == 0, 0).otherwise(21).alias("port"))
    known = told.where("status = 'active'").select("host", F.when(F.col("force"), "10.9.9.9").otherwise(F.col("ip")).alias("ip"))
    return refresh.host_faults(asked, known).select("host", "status")


@BOOK.query("e8_changed_records", hosts_sql("SELECT host FROM hosts WHERE site_id % 4 = 1 OR status = 'deleted'"))
def changed_records(spark: SparkSession, d: str) -> DataFrame:
    """e9, x13: records that differ from a copy in which every fourth has another count and none is deleted."""
    told = _hosts(spark, d).select("host", "fail_count", "status")
    other = _hosts(spark, d).select("host", F.when(F.col("site_id") % 4 == 1, F.lit(9)).otherwise(F.col("fail_count")).cast("long").alias("fail_count"), F.when(F.col("status") == "deleted", "active").otherwise(F.col("status")).alias("status"))
    return refresh.diff(told, other, ["host"], ["fail_count", "status"]).where("change = 'changed'").select("host")


@BOOK.query("j10_active_results", hosts_sql("SELECT s, host, ip FROM f_postings JOIN hosts USING (site_id) WHERE contains(s, 'ring-1') AND status = 'active'"))
def active_results(spark: SparkSession, d: str) -> DataFrame:
    c = FilesCatalog(spark, d)
    return c.postings.where("s like '%ring-1%'").join(hosts(c).where("status = 'active'"), "site_id").select("s", "host", "ip")


@BOOK.query("p29_addresses", hosts_sql("SELECT ip, CASE WHEN ip LIKE '10.1.%' THEN ip LIKE '10.1.%.5' OR ip LIKE '10.1.%.9' ELSE ip LIKE '10.%' AND NOT ip LIKE '10.2.%' END AS allowed FROM (SELECT DISTINCT ip FROM hosts)"))
def addresses(spark: SparkSession, d: str) -> DataFrame:
    """j21: the first of these rules that fits."""
    rules = spark.createDataFrame([("10.1.*.5", True, 1), ("10.1.*.9", True, 2), ("10.1.*.*", False, 3), ("10.2.*.*", False, 4), ("10.*.*.*", True, 5)], "pattern string, allow boolean, rank int")
    return browse.address_allowed(_hosts(spark, d).select("ip").distinct(), rules)


@BOOK.query("x4_offers_catalog", hosts_sql("SELECT host FROM hosts WHERE list_contains(access_methods, 'webindex')"))
def offers_catalog(spark: SparkSession, d: str) -> DataFrame:
    """x3: whatever the name's case."""
    return _hosts(spark, d).where(F.exists("access_methods", lambda x: F.lower(x) == "webindex")).select("host")


@BOOK.query("o4_domain_order", hosts_sql("SELECT hostname, CASE WHEN hostname LIKE '%.asia' THEN -2 WHEN hostname LIKE '%.nation-3.europe' THEN -1 WHEN hostname LIKE '%.europe' THEN 1 ELSE 0 END::BIGINT AS tier FROM f_sites"))
def domain_order(spark: SparkSession, d: str) -> DataFrame:
    """x2, o5: a site's place by the order of domains, those behind the star last."""
    order = config.domain_order(spark, "asia\nnation-3.europe\n*\neurope\n")
    return config.with_tier(FilesCatalog(spark, d).sites, order).select("hostname", F.col("tier").cast("long").alias("tier"))


# Statistics and consistency


@BOOK.query("a8_files_by_site", hosts_sql("SELECT site_id, count(*) AS files, count(DISTINCT dir_id) AS dirs, round(sum(size), 2) AS bytes, count(DISTINCT s) AS names FROM f_entries GROUP BY ROLLUP (site_id)"))
def files_by_site(spark: SparkSession, d: str) -> DataFrame:
    """q14, a10, a16, a23."""
    return stats.files_by_site(FilesCatalog(spark, d).entries)


@BOOK.query("a9_web_statistics", f"WITH k AS (SELECT page_id, count(*) AS keys FROM ({W_WORDS}) GROUP BY page_id) SELECT {HOST.format('url')} AS hostname, count(*) AS urls, count(keys) AS indexed_urls, coalesce(sum(keys), 0)::BIGINT AS keywords, coalesce(sum(CASE WHEN keys IS NOT NULL THEN strlen(html) END), 0)::BIGINT AS bytes FROM pages LEFT JOIN k USING (page_id) GROUP BY ROLLUP (1)")
def web_statistics(spark: SparkSession, d: str) -> DataFrame:
    """q14 as well."""
    pages = FilesCatalog(spark, d).read("pages")
    return stats.pages_by_host(pages, web.keywords(pages, "page_id", web.plain_text(F.col("html"))))


@BOOK.query("a9_dictionary", f"SELECT coalesce(sum(n), 0)::BIGINT AS records, count(*) AS unique_keywords, coalesce(sum(strlen(key) + 1), 0)::BIGINT AS bytes FROM (SELECT key, count(*) AS n FROM ({W_WORDS}) GROUP BY key)")
def dictionary(spark: SparkSession, d: str) -> DataFrame:
    pages = FilesCatalog(spark, d).read("pages")
    return stats.dictionary(web.keywords(pages, "page_id", web.plain_text(F.col("html"))))


@BOOK.query("a13_record_counts", hosts_sql("SELECT site_id, count(*) AS n, count(o.s) AS stored, count(*) = count(o.s) AS agrees FROM f_entries LEFT JOIN o USING (site_id, dir_id, s) GROUP BY site_id", _SNAP))
def record_counts(spark: SparkSession, d: str) -> DataFrame:
    """Records of a site against those of a stored snapshot."""
    c = FilesCatalog(spark, d)
    return refresh.record_counts(c.entries, _snapshots(c)[0])


@BOOK.query("a21_length_histogram", hosts_sql("SELECT length(s)::INTEGER AS length, count(*) AS n FROM f_strings GROUP BY 1"))
def length_histogram(spark: SparkSession, d: str) -> DataFrame:
    return stats.length_histogram(FilesCatalog(spark, d).strings)


@BOOK.query("x16_dictionary_size", hosts_sql("SELECT count(*) AS n, sum(strlen(s) + 1)::BIGINT AS bytes FROM f_strings"))
def dictionary_size(spark: SparkSession, d: str) -> DataFrame:
    return FilesCatalog(spark, d).strings.agg(F.count("*").alias("n"), F.sum(F.octet_length("s") + 1).alias("bytes"))


_FAULTS = {"entry_without_string": "SELECT count(*) FROM f_entries WHERE contains(s, 'ring-5')", "entry_without_posting": "SELECT count(*) FROM f_entries WHERE (s, site_id) NOT IN (SELECT (s, site_id) FROM o)", "posting_without_entry": "SELECT 0", "posting_without_string": "SELECT count(DISTINCT (s, site_id)) FROM o WHERE contains(s, 'ring-5')", "entry_without_site": "SELECT 0"}


@BOOK.query("j19_integrity", hosts_sql(" UNION ALL ".join(f"SELECT '{k}' AS fault, ({v}) AS n" for k, v in _FAULTS.items()), _SNAP))
def integrity(spark: SparkSession, d: str) -> DataFrame:
    """q15, x30: over a dictionary that lacks some names, and the postings of another snapshot."""
    c = FilesCatalog(spark, d)
    return refresh.integrity(c.strings.where("s not like '%ring-5%'"), _snapshots(c)[0].select("s", "site_id").distinct(), c.entries, c.sites)


@BOOK.query("a15_latency_estimate", "SELECT event_id, round(greatest(5.0, sum(value) OVER (PARTITION BY event_type ORDER BY ts, event_id ROWS 9 PRECEDING) / 10), 4) AS estimate FROM events")
def latency_estimate(spark: SparkSession, d: str) -> DataFrame:
    """w8, n35."""
    told = stats.latency_estimate(FilesCatalog(spark, d).read("events"), "event_type", "value", ["ts", "event_id"])
    return told.select("event_id", F.round("estimate", 4).alias("estimate"))


@BOOK.query("o18_request_priority", "SELECT event_id, (CASE event_type WHEN 'error' THEN 4 WHEN 'view' THEN 2 ELSE 1 END * (1 + user_id // 100))::BIGINT AS cost FROM events")
def request_priority(spark: SparkSession, d: str) -> DataFrame:
    costs = {"error": 4, "view": 2}
    return FilesCatalog(spark, d).read("events").select("event_id", stats.request_cost(F.col("event_type"), costs, F.floor(F.col("user_id") / 100)).alias("cost"))


@BOOK.query("w9_chunks", "SELECT conv_id, turn, (sum(length(text) + 1) OVER (PARTITION BY conv_id ORDER BY turn) - length(text) - 1)::BIGINT // 1000 AS chunk FROM conversations")
def chunks(spark: SparkSession, d: str) -> DataFrame:
    """s34: messages cut into pieces of about 1000 characters."""
    return stats.chunks(FilesCatalog(spark, d).read("conversations"), "conv_id", ["turn"], "text", 1000).select("conv_id", "turn", "chunk")


@BOOK.query("x5_partial_send", f"WITH k AS ({D_WORDS}) SELECT (SELECT count(*) FROM documents) + (SELECT count(*) FROM k WHERE doc_id % 10 > 5) AS records, (SELECT count(*) FROM documents WHERE doc_id % 10 >= 5) AS excerpts")
def partial_send(spark: SparkSession, d: str) -> DataFrame:
    """x6 as well: keywords of documents later than the time, excerpts from the time on."""
    docs = FilesCatalog(spark, d).read("documents")
    dated = docs.select("doc_id", (F.col("doc_id") % 10).alias("rdate"))
    return refresh.partial_send(dated, web.keywords(docs, "doc_id", F.col("text")), dated, F.lit(5))


@BOOK.query("e9_host_status", hosts_sql("SELECT host, CASE WHEN status = 'deleted' OR site_id % 3 = 0 THEN 'deleted' WHEN site_id % 3 = 1 THEN 'active' ELSE 'inactive' END AS status FROM hosts"))
def host_status(spark: SparkSession, d: str) -> DataFrame:
    """x13: hosts activated, inactivated and deleted."""
    told = _hosts(spark, d)
    k = F.col("site_id") % 3
    return refresh.with_status(told, told.select("host", F.when(k == 0, "delete").when(k == 1, "activate").otherwise("inactivate").alias("command"))).select("host", "status")


@BOOK.query("x11_needing_work", hosts_sql("SELECT * FROM (SELECT host, CASE WHEN status = 'deleted' THEN 'remove' WHEN status = 'disabled' THEN NULL WHEN force THEN 'forced' WHEN fail_count > 2 THEN 'failing' WHEN update_time < TIMESTAMP '2024-01-04 00:00:00' THEN 'due' END AS work FROM hosts) WHERE work IS NOT NULL"))
def needing_work(spark: SparkSession, d: str) -> DataFrame:
    return refresh.needing_work(_hosts(spark, d), _stamp("2024-01-09 00:00:00"), 5)


@BOOK.query("q15_repaired_postings", hosts_sql("SELECT DISTINCT s, site_id FROM f_entries", _SNAP))
def repaired_postings(spark: SparkSession, d: str) -> DataFrame:
    """The postings of an older snapshot, as the entries need them."""
    c = FilesCatalog(spark, d)
    return refresh.repaired_postings(c.entries, _snapshots(c)[0].select("s", "site_id"))


@BOOK.query("x23_surrogates", hosts_sql("SELECT n_name, dense_rank() OVER (ORDER BY n_name)::INTEGER AS id FROM nation"))
def surrogates(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    names = FilesCatalog(spark, d).read("nation").select("n_name").distinct()  # a dimension table of fixed size
    return names.select("n_name", F.dense_rank().over(Window.orderBy("n_name")).alias("id"))


@BOOK.query("t5_requests_by_window", f"SELECT strftime(date_trunc('day', ts), {SQL_TIME}) AS w, event_type, count(*) AS n, round(avg(value), 6) AS mean_value FROM events GROUP BY 1, 2")
def requests_by_window(spark: SparkSession, d: str) -> DataFrame:
    from shelfmark.streaming import refresh as streaming

    told = streaming.requests_by_window(FilesCatalog(spark, d).read("events"))
    return told.select(F.date_format("w_start", SHOWN_TIME).alias("w"), "event_type", "n", "mean_value")
