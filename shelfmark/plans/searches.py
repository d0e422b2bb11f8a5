"""Queries over the files catalog: selection of names, filters, caps, orders, pages, boolean names, browsing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shelfmark.functions import match
from shelfmark.operators import browse, formats, stats
from shelfmark.operators import search as find
from shelfmark.plans import boolean
from shelfmark.plans.book import RESULT_SQL, Book, shown
from shelfmark.sources.catalog import FilesCatalog, files_sql

BOOK = Book()
ALL_SQL = f"{RESULT_SQL} WHERE "
ORDER_SQL = " ORDER BY s, site_id, dir_id"


def _hits(spark: SparkSession, d: str, key: str, kind: str, **more) -> DataFrame:
    return shown(find.search(FilesCatalog(spark, d), find.Request(key, kind, **more)))


def _found(catalog: FilesCatalog, key: str, kind: str = "substring_ci") -> DataFrame:
    return find.search(catalog, find.Request(key, kind))


# Selection of names


@BOOK.files("p1_exact", ALL_SQL + "s = 'red_widget-1.economy'")
def exact(spark: SparkSession, d: str) -> DataFrame:
    return _hits(spark, d, "red_widget-1.economy", "exact")


@BOOK.files("p2_substring", ALL_SQL + "contains(s, 'bolt-1')")
def substring(spark: SparkSession, d: str) -> DataFrame:
    return _hits(spark, d, "Bolt-1", "substring_ci")


@BOOK.files("p3_prefix", ALL_SQL + "starts_with(s, 'small_r')")
def prefix(spark: SparkSession, d: str) -> DataFrame:
    return _hits(spark, d, "small_r", "prefix")


@BOOK.files("p4_regex", ALL_SQL + "regexp_matches(s, '^(red|blue)_b[a-z]*-[0-9]*7\\.')")
def regex(spark: SparkSession, d: str) -> DataFrame:
    return _hits(spark, d, r"^(red|blue)_b[a-z]*-[[:digit:]]*7\.", "regex")


_A, _U = "ÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖØÙÚÛÜÝàáâãäåçèéêëìíîïñòóôõöøùúûüýÿ", "AAAAAACEEEEIIIINOOOOOOUUUUYaaaaaaceeeeiiiinoooooouuuuyy"


@BOOK.query("p5_case_accent", f"SELECT page_id, contains(html, 'Ére') AS csas, contains(lower(html), 'ére') AS cias, contains(translate(html, '{_A}', '{_U}'), 'Ere') AS csai, contains(lower(translate(html, '{_A}', '{_U}')), 'ere') AS ciai FROM pages")
def case_accent(spark: SparkSession, d: str) -> DataFrame:
    pages = FilesCatalog(spark, d).read("pages")
    return pages.select("page_id", *(match.substring(F.col("html"), "Ére", m).alias(m) for m in ("csas", "cias", "csai", "ciai")))


@BOOK.files("p6_exact_else_substring", "SELECT s, 1 AS tier FROM f_strings WHERE contains(s, 'bolt') AND NOT EXISTS (FROM f_strings WHERE s = 'bolt') UNION ALL SELECT s, 0 FROM f_strings WHERE s = 'bolt'")
def exact_else(spark: SparkSession, d: str) -> DataFrame:
    return match.tiered(FilesCatalog(spark, d).strings, ("exact", "substring_ci"), "bolt").select("s", "tier")


_LETTERS = {"=": 0, "R": 1, "r": 1, "X": 1, "x": 1, "C": 1, "c": 1, "K": 1, "k": 1, "S": 1, "s": 1, "Z": 1, "z": 1, "n": 0}


@BOOK.files("p7_search_types", "SELECT letter, CASE WHEN partial = 1 THEN (SELECT count(*) FROM f_strings WHERE contains(s, 'gear')) ELSE (SELECT count(*) FROM f_strings WHERE s = 'gear') END AS n FROM (VALUES " + ", ".join(f"('{k}', {v})" for k, v in _LETTERS.items()) + ") AS t(letter, partial)")
def search_types(spark: SparkSession, d: str) -> DataFrame:
    strings = FilesCatalog(spark, d).strings
    counted = [match.tiered(strings, kinds, "gear").agg(F.count("*").alias("n")).select(F.lit(letter).alias("letter"), "n") for letter, (kinds, _) in match.TYPES.items()]
    out = counted[0]
    for c in counted[1:]:
        out = out.unionByName(c)
    return out


@BOOK.files("p8_names_only", "SELECT s FROM f_strings WHERE contains(s, 'gizmo') ORDER BY s LIMIT 100")
def names_only(spark: SparkSession, d: str) -> DataFrame:
    return find.find(FilesCatalog(spark, d), "Z", find.Request("GIZMO"))


@BOOK.files("p9_regex_to_substring", ALL_SQL + "contains(s, 'anvil-2')")
def regex_to_substring(spark: SparkSession, d: str) -> DataFrame:
    return _hits(spark, d, ".*anvil-2.*", "regex")


@BOOK.files("p10_case_pairs", "SELECT s FROM f_strings WHERE contains(s, 'plate-3')")
def case_pairs(spark: SparkSession, d: str) -> DataFrame:
    key = match.case_pairs("[pP][lL][aA][tT][eE]-3")
    return FilesCatalog(spark, d).strings.where(match.substring(F.col("s"), key))


# Filters on sites and paths


@BOOK.files("p12_domains", ALL_SQL + "contains(s, 'ring-1') AND (hostname LIKE '%.asia' OR hostname LIKE '%.nation-1.america')")
def domains(spark: SparkSession, d: str) -> DataFrame:
    return _hits(spark, d, "ring-1", "substring_ci", domains=("asia", "nation-1.america"))


@BOOK.files("p13_top_domain", "SELECT hostname FROM f_sites WHERE split_part(hostname, '.', 3) IN ('europe', 'africa')")
def top_domain(spark: SparkSession, d: str) -> DataFrame:
    return FilesCatalog(spark, d).sites.where(match.in_top_domain(F.col("hostname"), ("europe", "africa"))).select("hostname")


@BOOK.files("p14_paths", ALL_SQL + "contains(s, 'widget-1') AND (contains(path, '/12') OR contains(path, '99')) AND NOT contains(path, '7/')")
def paths(spark: SparkSession, d: str) -> DataFrame:
    return _hits(spark, d, "widget-1", "substring_ci", include=("/12", "99"), exclude="7/")


@BOOK.files("p14_paths_and", ALL_SQL + "contains(s, 'widget-1') AND contains(path, '/1') AND contains(path, '5')")
def paths_and(spark: SparkSession, d: str) -> DataFrame:
    return _hits(spark, d, "widget-1", "substring_ci", include=("/1", "5"), every_path=True)


@BOOK.files("p15_path_components", ALL_SQL + "len(list_filter(string_split(path, '/'), lambda x: contains(x, '123') OR contains(x, 'gear-77'))) > 0")
def path_components(spark: SparkSession, d: str) -> DataFrame:
    c = FilesCatalog(spark, d)
    return shown(find.results(c, c.strings, path=match.component_accepted(F.col("path"), ("123", "gear-77"))))


@BOOK.files("p16_kinds", "SELECT kind, count(*) AS n FROM (SELECT DISTINCT site_id, dir_id, 'dir' AS kind FROM f_entries UNION ALL SELECT site_id, dir_id, 'file' FROM f_entries) GROUP BY kind")
def kinds(spark: SparkSession, d: str) -> DataFrame:
    entries = FilesCatalog(spark, d).entries
    dirs = entries.select("site_id", "dir_id").distinct().select("*", F.lit("dir").alias("kind"))
    return dirs.unionByName(entries.select("site_id", "dir_id", F.lit("file").alias("kind"))).groupBy("kind").agg(F.count("*").alias("n"))


@BOOK.files("p25_list_sites", "SELECT site_id, hostname FROM f_sites WHERE hostname GLOB 'supplier-00000001?.nation-*' ORDER BY lower(hostname), site_id LIMIT 5000")
def list_sites(spark: SparkSession, d: str) -> DataFrame:
    """q5, x26, o6: host names by a pattern, in case-insensitive order."""
    return browse.list_sites(FilesCatalog(spark, d), "supplier-00000001?.nation-*").select("site_id", "hostname")


@BOOK.files("p26_attributes", "SELECT s, size FROM f_entries WHERE s = 'red_widget-1.economy'")
def attributes(spark: SparkSession, d: str) -> DataFrame:
    return _found(FilesCatalog(spark, d), "red_widget-1.economy", "exact").select("s", "size")


# Joins that make up a search


@BOOK.files("j1_strings_postings", "SELECT s, count(*) AS sites FROM f_strings JOIN f_postings USING (s) WHERE contains(s, 'ring') GROUP BY s")
def strings_postings(spark: SparkSession, d: str) -> DataFrame:
    c = FilesCatalog(spark, d)
    return c.strings.where(match.substring(F.col("s"), "ring")).join(c.postings, "s").groupBy("s").agg(F.count("*").alias("sites"))


@BOOK.files("j2_postings_sites", "SELECT s, hostname FROM f_postings JOIN f_sites USING (site_id) WHERE contains(s, 'plate-1')")
def postings_sites(spark: SparkSession, d: str) -> DataFrame:
    c = FilesCatalog(spark, d)
    return c.postings.where(match.substring(F.col("s"), "plate-1")).join(c.sites, "site_id").select("s", "hostname")


@BOOK.files("j3_entries", "SELECT s, site_id, count(*) AS n, max(size) AS largest FROM f_postings JOIN f_entries USING (s, site_id) WHERE contains(s, 'bolt-2') GROUP BY s, site_id")
def posting_entries(spark: SparkSession, d: str) -> DataFrame:
    c = FilesCatalog(spark, d)
    wanted = c.postings.where(match.substring(F.col("s"), "bolt-2"))
    return wanted.join(c.entries, ["s", "site_id"]).groupBy("s", "site_id").agg(F.count("*").alias("n"), F.max("size").alias("largest"))


@BOOK.files("j8_directory_by_path", ALL_SQL + "path LIKE '/1/%'")
def directory_by_path(spark: SparkSession, d: str) -> DataFrame:
    c = FilesCatalog(spark, d)
    return shown(c.entries.where(F.col("path").startswith("/1/")).join(c.sites, "site_id"))


@BOOK.files("j9_list_directory", "SELECT s, size FROM f_entries WHERE site_id = 7 AND dir_id = (SELECT min(dir_id) FROM f_entries WHERE site_id = 7)")
def list_directory(spark: SparkSession, d: str) -> DataFrame:
    c = FilesCatalog(spark, d)
    first = c.read("lineitem").where("l_suppkey = 7").agg(F.min("l_orderkey").alias("dir_id"))
    return c.entries.where("site_id = 7").join(first, "dir_id").select("s", "size")


# Caps, tiers and headings: windows


@BOOK.files("w1_hits_per_match", f"SELECT s, hostname, path FROM (SELECT *, row_number() OVER (PARTITION BY s ORDER BY site_id, dir_id) AS r FROM f_entries JOIN f_sites USING (site_id) WHERE contains(s, 'ring-1')) WHERE r <= 3")
def hits_per_match(spark: SparkSession, d: str) -> DataFrame:
    return _hits(spark, d, "ring-1", "substring_ci", per_match=3).select("s", "hostname", "path")


@BOOK.files("w2_max_matches", ALL_SQL + "s IN (SELECT DISTINCT s FROM f_entries WHERE contains(s, 'bolt') ORDER BY s LIMIT 5)")
def max_matches(spark: SparkSession, d: str) -> DataFrame:
    return _hits(spark, d, "bolt", "substring_ci", matches=5)


@BOOK.files("w4_headings", "SELECT s, hostname, path, lag(hostname) OVER (PARTITION BY s ORDER BY hostname, path) IS DISTINCT FROM hostname AS heading FROM f_entries JOIN f_sites USING (site_id) WHERE contains(s, 'gear-1')")
def headings(spark: SparkSession, d: str) -> DataFrame:
    hits = shown(_with_sites(FilesCatalog(spark, d), "gear-1"))
    return stats.changed_headings(hits, "hostname", ["hostname", "path"], ["s"]).select("s", "hostname", "path", "heading")


def _with_sites(c: FilesCatalog, key: str) -> DataFrame:
    return find.results(c, c.strings.where(match.substring(F.col("s"), key)))


@BOOK.files("w7_fallback_tier", "SELECT s FROM (SELECT s, CASE WHEN s = 'old_ring' THEN 0 WHEN contains(s, 'old_ring') THEN 1 END AS tier FROM f_strings) QUALIFY tier = min(tier) OVER ()")
def fallback_tier(spark: SparkSession, d: str) -> DataFrame:
    return match.tiered(FilesCatalog(spark, d).strings, ("exact", "substring_cs"), "old_ring").select("s")


# Orders, limits, pages


def _sorted(name: str, order: str) -> None:
    @BOOK.files(f"o1_sort_{name}", f"SELECT s, hostname, path, size FROM f_entries JOIN f_sites USING (site_id) WHERE contains(s, 'bolt-1') ORDER BY {order}, s, site_id, dir_id LIMIT 50")
    def query(spark: SparkSession, d: str) -> DataFrame:
        return find.sorted_results(_found(FilesCatalog(spark, d), "bolt-1"), name).limit(50).select("s", "hostname", "path", "size")


for _name, _order in (("filename", "s"), ("hostname", "hostname"), ("size", "size DESC"), ("rsize", "size"), ("time", "mtime DESC")):
    _sorted(_name, _order)


@BOOK.files("o2_host_then_path", "SELECT hostname, path FROM f_entries JOIN f_sites USING (site_id) WHERE contains(s, 'ring-2') ORDER BY hostname, path, s LIMIT 40")
def host_then_path(spark: SparkSession, d: str) -> DataFrame:
    return _found(FilesCatalog(spark, d), "ring-2").orderBy("hostname", "path", "s").limit(40).select("hostname", "path")


@BOOK.files("o3_newest_first", "SELECT hostname, path FROM f_entries JOIN f_sites USING (site_id) WHERE contains(s, 'ring-2') ORDER BY mtime DESC NULLS LAST, hostname, path LIMIT 40")
def newest_first(spark: SparkSession, d: str) -> DataFrame:
    return _found(FilesCatalog(spark, d), "ring-2").orderBy(F.desc_nulls_last("mtime"), "hostname", "path").limit(40).select("hostname", "path")


@BOOK.files("o7_domains_by_name", "SELECT name, definition FROM f_domains ORDER BY name")
def domains_by_name(spark: SparkSession, d: str) -> DataFrame:
    return browse.list_domains(FilesCatalog(spark, d))


@BOOK.files("o11_limit", ALL_SQL + "contains(s, 'widget')" + ORDER_SQL + " LIMIT 200")
def limit(spark: SparkSession, d: str) -> DataFrame:
    return _hits(spark, d, "widget", "substring_ci", hits=200)


@BOOK.files("o14_resume", "SELECT s, hostname, path FROM f_entries JOIN f_sites USING (site_id) WHERE contains(s, 'gizmo')" + ORDER_SQL + " LIMIT 30 OFFSET 30")
def resume(spark: SparkSession, d: str) -> DataFrame:
    """The second page: the cursor is the first page's last row, at most one page on the driver."""
    hits = _found(FilesCatalog(spark, d), "gizmo")
    first = find.after(hits, None, 30).collect()
    return find.after(hits, find.cursor_of(first[-1]) if first else None, 30).select("s", "hostname", "path")


@BOOK.files("o15_resume_boolean", "SELECT s FROM f_strings WHERE contains(s, 'red') AND contains(s, 'bolt') ORDER BY s LIMIT 10 OFFSET 10")
def resume_boolean(spark: SparkSession, d: str) -> DataFrame:
    hits = find.boolean_strings(FilesCatalog(spark, d).strings, boolean.parse("red bolt"))
    first = find.after(hits, None, 10, ["s"]).collect()
    return find.after(hits, find.cursor_of(first[-1], ["s"]) if first else None, 10, ["s"])


@BOOK.files("o17_more_strings", "SELECT s FROM f_strings WHERE contains(s, 'plate') ORDER BY s LIMIT 25 OFFSET 10")
def more_strings(spark: SparkSession, d: str) -> DataFrame:
    return FilesCatalog(spark, d).strings.where(match.substring(F.col("s"), "plate")).orderBy("s").offset(10).limit(25)


# Boolean requests on names, and sets of names


@BOOK.files("b6_boolean_names", ALL_SQL + "(contains(s, 'red') AND contains(s, 'bolt') AND NOT contains(s, 'economy')) OR (contains(s, 'small_ring') AND contains(s, '-1'))")
def boolean_names(spark: SparkSession, d: str) -> DataFrame:
    c = FilesCatalog(spark, d)
    return shown(find.results(c, find.boolean_strings(c.strings, boolean.parse("red AND bolt not economy or small_ring -1"))))


@BOOK.files("b3_name_sets", "(SELECT s, 'and' AS op FROM f_strings WHERE contains(s, 'red') AND contains(s, 'gear')) UNION ALL (SELECT s, 'or' FROM f_strings WHERE contains(s, 'hot_gear') OR contains(s, 'hot_ring')) UNION ALL (SELECT s, 'not' FROM f_strings WHERE contains(s, 'old_') AND NOT contains(s, 'ring'))")
def name_sets(spark: SparkSession, d: str) -> DataFrame:
    strings = FilesCatalog(spark, d).strings
    having = lambda w: strings.where(match.substring(F.col("s"), w))
    both = having("red").join(having("gear"), "s", "left_semi")
    either = having("hot_gear").union(having("hot_ring")).distinct()
    without = having("old_").join(having("ring"), "s", "left_anti")
    tag = lambda df, op: df.select("s", F.lit(op).alias("op"))
    return tag(both, "and").unionByName(tag(either, "or")).unionByName(tag(without, "not"))


@BOOK.files("b8_site_pruning", "SELECT site_id FROM f_postings WHERE contains(s, 'red_bolt') INTERSECT SELECT site_id FROM f_postings WHERE contains(s, 'old_ring')")
def site_pruning(spark: SparkSession, d: str) -> DataFrame:
    """j12: sites that hold names of both words, before any entry is read."""
    postings = FilesCatalog(spark, d).postings
    of = lambda w: postings.where(match.substring(F.col("s"), w)).select("site_id").distinct()
    return of("red_bolt").join(of("old_ring"), "site_id", "left_semi")


@BOOK.files("j12_site_sets", "(SELECT 'minus' AS op, site_id FROM (SELECT site_id FROM f_postings WHERE contains(s, 'red_bolt') EXCEPT SELECT site_id FROM f_postings WHERE contains(s, 'old_ring'))) UNION ALL (SELECT 'union', site_id FROM (SELECT site_id FROM f_postings WHERE contains(s, 'red_bolt') UNION SELECT site_id FROM f_postings WHERE contains(s, 'old_ring')))")
def site_sets(spark: SparkSession, d: str) -> DataFrame:
    postings = FilesCatalog(spark, d).postings
    of = lambda w: postings.where(match.substring(F.col("s"), w)).select("site_id").distinct()
    a, b = of("red_bolt"), of("old_ring")
    return a.join(b, "site_id", "left_anti").select(F.lit("minus").alias("op"), "site_id").unionByName(a.union(b).distinct().select(F.lit("union").alias("op"), "site_id"))


@BOOK.files("b15_catalog_fan_out", "SELECT 'files' AS catalog, s AS hit FROM f_strings WHERE contains(s, 'the') UNION ALL SELECT 'web', url FROM pages WHERE contains(lower(url), 'the')")
def catalog_fan_out(spark: SparkSession, d: str) -> DataFrame:
    c = FilesCatalog(spark, d)
    names = c.strings.where(match.substring(F.col("s"), "the")).select(F.lit("files").alias("catalog"), F.col("s").alias("hit"))
    urls = c.read("pages").where(match.substring(F.col("url"), "the")).select(F.lit("web").alias("catalog"), F.col("url").alias("hit"))
    return names.unionByName(urls)


# Whole requests


@BOOK.files("q1_search", f"SELECT s, hostname, path FROM (SELECT *, row_number() OVER (PARTITION BY s ORDER BY site_id, dir_id) AS r FROM f_entries JOIN f_sites USING (site_id) WHERE s IN (SELECT DISTINCT s FROM f_entries JOIN f_sites USING (site_id) WHERE contains(s, 'ring') AND (hostname LIKE '%.asia' OR hostname LIKE '%.europe') AND contains(path, '1') ORDER BY s LIMIT 100) AND (hostname LIKE '%.asia' OR hostname LIKE '%.europe') AND contains(path, '1')) WHERE r <= 20 ORDER BY s, site_id, dir_id LIMIT 200")
def whole_search(spark: SparkSession, d: str) -> DataFrame:
    return _hits(spark, d, "ring", "substring_ci", domains=("asia", "europe"), include=("1",), hits=200, matches=100, per_match=20).select("s", "hostname", "path")


@BOOK.files("q3_match", f"SELECT s, hostname, path FROM (SELECT *, row_number() OVER (PARTITION BY s ORDER BY site_id, dir_id) AS r FROM f_entries JOIN f_sites USING (site_id) WHERE s IN (SELECT DISTINCT s FROM f_entries WHERE contains(s, 'cold') OR contains(s, 'anvil') ORDER BY s LIMIT 100) AND regexp_matches(s, 'cold|anvil')) WHERE r <= 20 ORDER BY s, site_id, dir_id LIMIT 100")
def directory_match(spark: SparkSession, d: str) -> DataFrame:
    return shown(find.find(FilesCatalog(spark, d), "r", find.Request("cold|anvil"))).select("s", "hostname", "path")


@BOOK.files("q10_whatis", "SELECT s AS name, c_mktsegment AS text FROM f_name JOIN customer ON p_partkey = c_custkey WHERE contains(lower(s || ' ' || c_mktsegment), 'auto')")
def whatis(spark: SparkSession, d: str) -> DataFrame:
    c = FilesCatalog(spark, d)
    described = c.names.join(c.read("customer"), F.col("p_partkey") == F.col("c_custkey")).select(F.col("s").alias("name"), F.col("c_mktsegment").alias("text"))
    return browse.whatis(described, "AUTO")


@BOOK.query("q9_get_document", "SELECT doc_id, source, lang, n_chars FROM documents WHERE doc_id = 42")
def get_document(spark: SparkSession, d: str) -> DataFrame:
    return FilesCatalog(spark, d).read("documents").where("doc_id = 42").select("doc_id", "source", "lang", "n_chars")


# Pseudo-domains and trees: recursion


_EXPAND = ", unfolded AS (SELECT name, unnest(string_split(definition, ':')) AS item, 1 AS depth FROM f_domains UNION SELECT u.name, unnest(string_split(f.definition, ':')), depth + 1 FROM unfolded u JOIN f_domains f ON f.name = u.item WHERE depth < 20)"


@BOOK.query("j15_pseudo_domains", files_sql("").rstrip() + _EXPAND + " SELECT DISTINCT name, item AS suffix FROM unfolded WHERE item NOT IN (SELECT name FROM f_domains)")
def pseudo_domains(spark: SparkSession, d: str) -> DataFrame:
    return browse.expand_domains(FilesCatalog(spark, d).domains)


@BOOK.files("j22_suffix_join", "SELECT name, hostname FROM f_region JOIN f_sites ON len(list_filter(string_split(definition, ':'), lambda x: hostname = x OR hostname LIKE '%.' || x)) > 0")
def suffix_join(spark: SparkSession, d: str) -> DataFrame:
    """Hosts of each pseudo-domain of a region: hosts are unfolded into their suffixes and meet domains by equality."""
    c = FilesCatalog(spark, d)
    atoms = browse.expand_domains(c.domains).where("name != 'world'")
    return match.host_suffixes(c.sites, "hostname").join(atoms, "suffix").select("name", "hostname").distinct()


@BOOK.query("j6_paths_by_parents", "WITH RECURSIVE t AS (SELECT p_partkey AS node, CASE WHEN p_partkey = 0 THEN NULL ELSE (p_partkey - 1) // 4 END AS parent, p_partkey::VARCHAR AS name FROM part), w AS (SELECT node, '/' || name AS path, 0 AS depth FROM t WHERE parent IS NULL UNION ALL SELECT t.node, w.path || '/' || t.name, depth + 1 FROM w JOIN t ON t.parent = w.node) SELECT node AS node_id, path, depth FROM w")
def paths_by_parents(spark: SparkSession, d: str) -> DataFrame:
    """Paths by walking up a tree of parts, four below each."""
    key = F.col("p_partkey")
    tree = FilesCatalog(spark, d).read("part").select(F.lit(0).alias("tree_id"), key.alias("node_id"), F.when(key > 0, F.floor((key - 1) / 4)).alias("parent_id"), key.cast("string").alias("name"))
    return browse.tree_paths(tree).select("node_id", "path", "depth")


_ALPHA = "SELECT p_partkey, CASE WHEN p_partkey % 10 = 0 THEN 'dir' ELSE 'file' END AS kind, p_name, p_size // 10 AS site FROM part"


@BOOK.query("j5_previous_header", f"SELECT p_partkey, last_value(CASE WHEN kind = 'dir' THEN p_name END IGNORE NULLS) OVER (PARTITION BY site ORDER BY p_partkey ROWS UNBOUNDED PRECEDING) AS header FROM ({_ALPHA})")
def previous_header(spark: SparkSession, d: str) -> DataFrame:
    """j4, j5, w5: each record with the last directory record before it."""
    parts = FilesCatalog(spark, d).read("part").withColumn("site", F.floor(F.col("p_size") / 10))
    return browse.carried_header(parts, "site", "p_partkey", F.col("p_partkey") % 10 == 0, "p_name").select("p_partkey", "header")


@BOOK.query("w6_next_record", f"SELECT p_partkey, lead(kind) OVER (PARTITION BY site ORDER BY p_partkey) AS next_kind FROM ({_ALPHA})")
def next_record(spark: SparkSession, d: str) -> DataFrame:
    kind = F.when(F.col("p_partkey") % 10 == 0, "dir").otherwise("file")
    w = Window.partitionBy(F.floor(F.col("p_size") / 10)).orderBy("p_partkey")
    return FilesCatalog(spark, d).read("part").select("p_partkey", F.lead(kind).over(w).alias("next_kind"))


# Formats


def _format(name: str, sql: str) -> None:
    @BOOK.files(f"s31_{name}", f"SELECT {sql} AS line FROM f_entries JOIN f_sites USING (site_id) WHERE contains(s, 'ring-1')")
    def query(spark: SparkSession, d: str) -> DataFrame:
        return _with_sites(FilesCatalog(spark, d), "ring-1").select(formats.FORMATS[name]().alias("line"))


_SIZE = "trunc(size)::BIGINT::VARCHAR"
for _name, _sql in {
    "verbose": f"'Host ' || hostname || '    Location: ' || '/' || dir_id || '      FILE    ' || {_SIZE} || ' ' || strftime(mtime, '%Y-%m-%d %H:%M') || '  ' || s",
    "terse": f"hostname || ' ' || {_SIZE} || ' ' || strftime(mtime, '%Y-%m-%d') || ' ' || path",
    "machine": f"strftime(mtime, '%Y%m%d%H%M%S') || 'Z ' || {_SIZE} || ' ' || hostname || ' ' || path",
    "url": "'ftp://' || hostname || path",
    "key_values": f"'STRING=' || s || chr(10) || 'SITE=' || hostname || chr(10) || 'PATH=' || path || chr(10) || 'SIZE=' || {_SIZE} || chr(10) || 'DATE=' || strftime(mtime, '%Y%m%d%H%M%S')",
}.items():
    _format(_name, _sql)


# Index points

_IS_WORD = "regexp_matches(s[{}], '[\\p{{L}}\\p{{N}}]')"


@BOOK.files("u1_word_points", f"SELECT s, unnest(list_filter(range(length(s)), lambda i: {_IS_WORD.format('i + 1')} AND (i = 0 OR NOT {_IS_WORD.format('i')}))) AS start FROM f_strings")
def word_points(spark: SparkSession, d: str) -> DataFrame:
    return find.index_points(FilesCatalog(spark, d).strings, words=True)


@BOOK.files("u1_found_at_words", "SELECT s FROM f_strings WHERE regexp_matches(s, '(^|[^\\p{L}\\p{N}])an')")
def found_at_words(spark: SparkSession, d: str) -> DataFrame:
    return find.found_at(find.index_points(FilesCatalog(spark, d).strings, words=True), "an")


@BOOK.files("u1_found_at_characters", "SELECT s FROM f_strings WHERE contains(s, 'an')")
def found_at_characters(spark: SparkSession, d: str) -> DataFrame:
    return find.found_at(find.index_points(FilesCatalog(spark, d).strings), "an")
