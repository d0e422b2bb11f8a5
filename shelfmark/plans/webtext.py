"""Queries over the web catalog: pages, links, keywords and their weights, boolean documents, URL rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.functions import match, porter
from shelfmark.functions import scalars as sc
from shelfmark.operators import search as find
from shelfmark.operators import web
from shelfmark.plans import boolean
from shelfmark.plans.book import Book
from shelfmark.plans.markup import HOST, LINKS, TARGETS, decoded
from shelfmark.sources.catalog import FilesCatalog

BOOK = Book()

_STOP = ", ".join(f"'{w}'" for w in web.STOP_WORDS)
_HOST = r"lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/:?#]*)', 1))"
_PATH = r"CASE WHEN regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)', 1) = '' THEN '/' ELSE regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)', 1) END"


def _plain(sql: str) -> str:
    return decoded(f"regexp_replace(regexp_replace({sql}, '(?s)<!--.*?-->', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g')")


def _collapsed(sql: str) -> str:
    return f"trim(regexp_replace({sql}, '[ \\t\\r\\n\\f]+', ' ', 'g'))"


_TITLE = f"substr({_collapsed(decoded("regexp_extract(html, '(?is)<title>(.*?)</title>', 1)"))}, 1, 127)"
_EXCERPT = f"substr({_collapsed(_plain("regexp_replace(html, '(?is)^.*?</title>', '')"))}, 1, 511)"


def _words(table: str, doc: str, text: str) -> str:
    return f"SELECT {doc}, key, count(*) AS num FROM (SELECT {doc}, unnest(regexp_extract_all(lower({text}), '[\\p{{L}}\\p{{N}}]+(?:-[\\p{{L}}\\p{{N}}]+)*')) AS key FROM {table}) WHERE length(key) <= 50 AND len(regexp_extract_all(key, '[^\\x00-\\x7F]')) * 4 <= length(key) AND key NOT IN ({_STOP}) GROUP BY {doc}, key"


D_WORDS, W_WORDS = _words("documents", "doc_id", "text"), _words("pages", "page_id", _plain("html"))


def _pages(spark: SparkSession, d: str) -> DataFrame:
    return FilesCatalog(spark, d).read("pages")


def _doc_words(spark: SparkSession, d: str) -> DataFrame:
    return web.keywords(FilesCatalog(spark, d).read("documents"), "doc_id", F.col("text"))


# Pages and links


@BOOK.query("s24_links", f"SELECT page_id, href FROM ({LINKS})")
def links(spark: SparkSession, d: str) -> DataFrame:
    return web.links(_pages(spark, d))


@BOOK.query("e11_title", f"SELECT page_id, {_TITLE} AS title FROM pages")
def title(spark: SparkSession, d: str) -> DataFrame:
    return _pages(spark, d).select("page_id", web.title(F.col("html")).alias("title"))


@BOOK.query("e12_excerpt", f"SELECT page_id, {_EXCERPT} AS excerpt FROM pages")
def excerpt(spark: SparkSession, d: str) -> DataFrame:
    return _pages(spark, d).select("page_id", web.excerpt(F.col("html")).alias("excerpt"))


@BOOK.query("e14_url_tree", f"WITH u AS (SELECT {_HOST} AS hostname, CASE WHEN url LIKE 'https:%' THEN 443 ELSE 80 END AS port, {_PATH} AS path FROM pages), p AS (SELECT hostname, port, string_split(path, '/') AS parts FROM u) SELECT DISTINCT hostname, port, array_to_string(parts[1:i], '/') || '/' AS path, 'dir' AS kind FROM (SELECT hostname, port, parts, unnest(generate_series(1, len(parts) - 1)) AS i FROM p) UNION SELECT hostname, port, path, 'doc' FROM u WHERE NOT path LIKE '%/'")
def url_tree(spark: SparkSession, d: str) -> DataFrame:
    return web.url_tree(_pages(spark, d))


@BOOK.query("e17_external_hosts", f"SELECT DISTINCT hostname FROM (SELECT {HOST.format('target')} AS hostname FROM ({TARGETS})) WHERE hostname <> '' AND hostname NOT IN (SELECT {_HOST} FROM pages WHERE url LIKE 'https:%')")
def external_hosts(spark: SparkSession, d: str) -> DataFrame:
    """Hosts that links lead to and that are no site yet (here: those of https pages are)."""
    pages = _pages(spark, d)
    linked = web.joined_links(pages).select(sc.url_host(F.col("target")).alias("hostname"))
    return web.external_hosts(linked, pages.where("url like 'https:%'").select(sc.url_host(F.col("url")).alias("hostname")))


@BOOK.query("s22_frontier", f"SELECT DISTINCT target AS url FROM ({TARGETS}) WHERE target NOT IN (SELECT url FROM pages WHERE url LIKE 'https:%')")
def frontier(spark: SparkSession, d: str) -> DataFrame:
    """What the pages' links lead to and was not visited yet (here: https pages were)."""
    pages = _pages(spark, d)
    return web.frontier(web.joined_links(pages).select(F.col("target").alias("url")), pages.where("url like 'https:%'"))


# Rules on URLs and documents


@BOOK.query("p17_url_rules", f"SELECT page_id FROM (SELECT page_id, {_PATH} AS path, {_HOST} AS host FROM pages) WHERE NOT contains(path, '/cgi-bin/') AND starts_with(path, '/en/') AND NOT (host LIKE 'blog.%' AND starts_with(path, '/en/9'))")
def url_rules(spark: SparkSession, d: str) -> DataFrame:
    """Within the root, no scripts, nothing that a host's robots rules exclude (here: blogs exclude /en/9)."""
    told = _pages(spark, d).select("page_id", sc.url_path(F.col("url")).alias("path"), sc.url_host(F.col("url")).alias("hostname"))
    rules = told.select("hostname").distinct().where("hostname like 'blog.%'").select("hostname", F.lit("crawler").alias("agent"), F.lit("/en/9").alias("prefix"))
    return web.permitted(told, web.allowed(rules, "crawler"), "/en/").select("page_id")


@BOOK.query("p18_size_limit", "SELECT page_id FROM pages WHERE strlen(html) <= 4000")
def size_limit(spark: SparkSession, d: str) -> DataFrame:
    return _pages(spark, d).where(F.octet_length("html") <= 4000).select("page_id")


@BOOK.query("p19_media_types", "SELECT page_id FROM (SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'text/html; charset=utf-8' WHEN 1 THEN 'image/png' WHEN 2 THEN 'text/plain' ELSE 'application/octet-stream' END AS t FROM pages) WHERE t LIKE 'www/%' OR t LIKE 'text/html%' OR t LIKE 'text/plain%'")
def media_types(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("page_id") % 4
    kind = F.when(k == 0, "text/html; charset=utf-8").when(k == 1, "image/png").when(k == 2, "text/plain").otherwise("application/octet-stream")
    return _pages(spark, d).where(web.indexable_type(kind)).select("page_id")


@BOOK.query("p20_suffixes", f"SELECT page_id FROM pages WHERE {_PATH} LIKE '%.html' OR {_PATH} LIKE '%/'")
def suffixes(spark: SparkSession, d: str) -> DataFrame:
    return _pages(spark, d).where(web.has_suffix(sc.url_path(F.col("url")), (".html", "/"))).select("page_id")


@BOOK.query("p22_same_site", f"SELECT page_id FROM pages WHERE {_HOST} = 'spam-farm.example.org' AND url LIKE 'https:%'")
def same_site(spark: SparkSession, d: str) -> DataFrame:
    url = F.col("url")
    return _pages(spark, d).where((sc.url_host(url) == "spam-farm.example.org") & (sc.url_port(url) == 443)).select("page_id")


@BOOK.query("p32_indexed", f"WITH w AS (SELECT DISTINCT page_id FROM ({W_WORDS}) WHERE starts_with(key, 'the')) SELECT p.page_id, CASE WHEN w.page_id IS NOT NULL THEN 'indexed' WHEN strlen(html) = 0 THEN 'not_indexed' ELSE 'unindexable' END AS state FROM pages p LEFT JOIN w ON p.page_id = w.page_id")
def indexed(spark: SparkSession, d: str) -> DataFrame:
    """Whether a page has keywords (here: of a prefix), by one left join."""
    pages = _pages(spark, d)
    having = web.keywords(pages, "page_id", web.plain_text(F.col("html"))).where("key like 'the%'").select("page_id").distinct().withColumn("has", F.lit(True))
    state = F.when(F.col("has"), "indexed").when(F.octet_length("html") == 0, "not_indexed").otherwise("unindexable")
    return pages.join(having, "page_id", "left").select("page_id", state.alias("state"))


# Keywords


@BOOK.query("e10_page_keywords", W_WORDS)
def page_keywords(spark: SparkSession, d: str) -> DataFrame:
    return web.keywords(_pages(spark, d), "page_id", web.plain_text(F.col("html")))


@BOOK.query("a1_keyword_counts", D_WORDS)
def keyword_counts(spark: SparkSession, d: str) -> DataFrame:
    """p23, p24: without stop words and odd words."""
    return _doc_words(spark, d)


@BOOK.query("a2_keyword_totals", f"SELECT doc_id, sum(num)::BIGINT AS total FROM ({D_WORDS}) GROUP BY doc_id")
def keyword_totals(spark: SparkSession, d: str) -> DataFrame:
    return _doc_words(spark, d).groupBy("doc_id").agg(F.sum("num").alias("total"))


@BOOK.query("a5_document_frequency", f"SELECT key, count(*) AS docs FROM ({D_WORDS}) GROUP BY key")
def document_frequency(spark: SparkSession, d: str) -> DataFrame:
    return _doc_words(spark, d).groupBy("key").agg(F.count("*").alias("docs"))


@BOOK.query("a6_documents", f"SELECT count(DISTINCT doc_id) AS n FROM ({D_WORDS})")
def documents(spark: SparkSession, d: str) -> DataFrame:
    return _doc_words(spark, d).agg(F.countDistinct("doc_id").alias("n"))


_WEIGHTS = f"WITH c AS ({D_WORDS}), t AS (SELECT *, sum(num) OVER (PARTITION BY doc_id) AS total FROM c), f AS (SELECT key, count(*) AS docs FROM c GROUP BY key), n AS (SELECT count(DISTINCT doc_id) AS n FROM c) SELECT doc_id, key, round(CASE WHEN n < 10 THEN num / total ELSE num / total * log10(n / docs) END, 6) AS weight FROM t JOIN f USING (key), n"


def _weighted(spark: SparkSession, d: str, stem: Column | None = None) -> DataFrame:
    docs = FilesCatalog(spark, d).read("documents").select("doc_id", "text")
    return web.weights(web.postings(docs, "doc_id", F.col("text")), "doc_id", stem, n_docs=web.count_indexed(docs, "doc_id", F.col("text")))


@BOOK.query("a4_weights", _WEIGHTS)
def weights(spark: SparkSession, d: str) -> DataFrame:
    return _weighted(spark, d).select("doc_id", "key", F.round("weight", 6).alias("weight"))


@BOOK.query("w3_top_keywords", f"SELECT doc_id, key, weight FROM ({_WEIGHTS}) QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY weight DESC, key) <= 500")
def top_keywords(spark: SparkSession, d: str) -> DataFrame:
    docs = FilesCatalog(spark, d).read("documents").select("doc_id", "text")
    lists, n_docs = web.posting_lists(docs, "doc_id", F.col("text")), web.count_indexed(docs, "doc_id", F.col("text"))
    return web.top_posted(lists, "doc_id", n_docs, 500).select("doc_id", "key", "weight")


@BOOK.query("a3_stem_sums")
def stem_sums(spark: SparkSession, d: str) -> DataFrame:
    """e13: stems by Porter's rules; tests hold them against published pairs."""
    return _weighted(spark, d, porter.stem_column(F.col("key"))).select("doc_id", "key", "stem", "stem_sum", F.round("weight", 6).alias("weight"))


@BOOK.query("a20_keyword_lists", f"SELECT doc_id, string_agg(key, ' ' ORDER BY key) AS keys FROM ({D_WORDS}) GROUP BY doc_id")
def keyword_lists(spark: SparkSession, d: str) -> DataFrame:
    """q2: a document's keywords as one text."""
    return web.keyword_lists(_doc_words(spark, d), "doc_id")


# Boolean requests on documents


_B7 = f"WITH w AS ({D_WORDS}), h AS (SELECT doc_id, max(starts_with(key, 'the')::INT) AS t, max(starts_with(key, 'ing')::INT) AS i, max(starts_with(key, 'und')::INT) AS u, max(starts_with(key, 'der')::INT) AS e FROM w GROUP BY doc_id)"


@BOOK.query("b7_boolean_documents", f"{_B7} SELECT doc_id FROM h WHERE (t = 1 AND i = 1 AND u = 0) OR (e = 1 AND u = 1)")
def boolean_documents(spark: SparkSession, d: str) -> DataFrame:
    return find.boolean_documents(_doc_words(spark, d), boolean.parse("the AND ing NOT und OR der und"), "doc_id")


@BOOK.query("j13_documents_and", f"{_B7} SELECT doc_id FROM h WHERE t = 1 AND i = 1")
def documents_and(spark: SparkSession, d: str) -> DataFrame:
    words = _doc_words(spark, d)
    of = lambda w: words.where(F.col("key").startswith(w)).select("doc_id").distinct()
    return of("the").join(of("ing"), "doc_id", "left_semi")


@BOOK.query("j14_documents_not", f"{_B7} SELECT doc_id FROM h WHERE e = 1 AND t = 0")
def documents_not(spark: SparkSession, d: str) -> DataFrame:
    words = _doc_words(spark, d)
    of = lambda w: words.where(F.col("key").startswith(w)).select("doc_id").distinct()
    return of("der").join(of("the"), "doc_id", "left_anti")


@BOOK.query("b11_documents_or", f"{_B7} SELECT doc_id FROM h WHERE e = 1 OR t = 1")
def documents_or(spark: SparkSession, d: str) -> DataFrame:
    words = _doc_words(spark, d)
    return words.where(F.col("key").startswith("der")).select("doc_id").union(words.where(F.col("key").startswith("the")).select("doc_id")).distinct()


@BOOK.query("b10_boolean_results", f"{_B7} SELECT doc_id, source, lang, n_chars FROM h JOIN documents USING (doc_id) WHERE t = 1 AND e = 1")
def boolean_results(spark: SparkSession, d: str) -> DataFrame:
    hits = find.boolean_documents(_doc_words(spark, d), boolean.parse("the der"), "doc_id")
    return FilesCatalog(spark, d).read("documents").join(hits, "doc_id", "left_semi").select("doc_id", "source", "lang", "n_chars")


@BOOK.query("q8_find_text", "SELECT doc_id FROM documents WHERE contains(lower(text), 'license')")
def find_text(spark: SparkSession, d: str) -> DataFrame:
    return FilesCatalog(spark, d).read("documents").where(match.substring(F.col("text"), "License")).select("doc_id")


# URLs as values


@BOOK.query("f10_url_parts", f"SELECT page_id, {_HOST} AS host, CASE WHEN url LIKE 'https:%' THEN 443 ELSE 80 END AS port, {_PATH} AS path FROM pages")
def url_parts(spark: SparkSession, d: str) -> DataFrame:
    url = F.col("url")
    return _pages(spark, d).select("page_id", sc.url_host(url).alias("host"), sc.url_port(url).alias("port"), sc.url_path(url).alias("path"))


@BOOK.query("f10_canonical_url", f"SELECT page_id, regexp_extract(url, '^([a-z]+)://', 1) || '://' || {_HOST} || {_PATH} || regexp_extract(url, '^[^?#]*(\\?[^#]*)', 1) AS url FROM pages")
def canonical_url(spark: SparkSession, d: str) -> DataFrame:
    return _pages(spark, d).select("page_id", sc.canonical_url(F.col("url")).alias("url"))


@BOOK.query("f11_joined_links", TARGETS)
def joined_links(spark: SparkSession, d: str) -> DataFrame:
    return web.joined_links(_pages(spark, d))


@BOOK.query("f11_all_links")
def all_links(spark: SparkSession, d: str) -> DataFrame:
    """As f11_joined_links; tests hold it against urllib, for dot segments and base elements are not in the SQL."""
    return web.joined_links(_pages(spark, d))


@BOOK.query("x17_redirects", "SELECT p.url, coalesce(r.target, p.url) AS target FROM pages p LEFT JOIN (SELECT url AS source, replace(url, 'http:', 'https:') AS target FROM pages WHERE url LIKE 'http:%') r ON p.url = r.source")
def redirects(spark: SparkSession, d: str) -> DataFrame:
    from shelfmark.operators import browse

    pages = _pages(spark, d)
    table = pages.where("url like 'http:%'").select(F.col("url").alias("source"), F.replace("url", F.lit("http:"), F.lit("https:")).alias("target"))
    return browse.redirected(pages.select("url"), table)
