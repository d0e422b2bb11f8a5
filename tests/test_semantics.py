"""Small hand-written cases of the rules that need a decision."""

from __future__ import annotations

import datetime as dt
import math
import random
import re
from functools import partial

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from shelfmark.functions import match, porter
from shelfmark.functions import scalars as sc
from shelfmark.operators import browse, refresh, stats, web
from shelfmark.operators import search as find
from shelfmark.plans import boolean, registry
from shelfmark.plans.boolean import Group
from shelfmark.sources import config, listings
from shelfmark.sources.catalog import FilesCatalog

SF = "/root/testdata/sf0.001"


def column(df, c):
    return [r[0] for r in df.select(c).collect()]


def strings(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "s string")


# Matching


def test_case_and_accent_modes(spark):
    df = strings(spark, "École", "ecole", "école", "ECOLE", None)
    got = {m: sorted(x for x in column(df.where(match.exact(F.col("s"), "école", m)), "s")) for m in sc.MODES}
    assert got == {"csas": ["école"], "cias": ["École", "école"], "csai": ["ecole", "école"], "ciai": ["ECOLE", "ecole", "École", "école"]}


def test_empty_key_selects_nothing(spark):
    df = strings(spark, "", "a")
    for kind in ("exact", "substring_cs", "substring_ci", "prefix", "regex"):
        assert df.where(match.predicate(F.col("s"), kind, "")).count() == 0


def test_regex_rewrites():
    assert match.simplify(".*abc.*") == ("substring", "abc")
    assert match.simplify("^abc") == ("regex", "^abc")
    assert match.simplify(r"a\.*") == ("regex", r"a\.*")
    assert match.case_pairs("[aA][bB]-1") == "ab-1"
    assert match.case_pairs("aB") is None and match.case_pairs("[ab]") is None


def test_posix_classes(spark):
    df = strings(spark, "a1", "ab")
    assert column(df.where(match.regex(F.col("s"), "[[:digit:]]")), "s") == ["a1"]


def test_matching_against_python(spark):
    random.seed(5)
    words = ["".join(random.choices("abAB.", k=random.randint(0, 6))) for _ in range(300)]
    df = strings(spark, *words)
    for key in ("a", "ab", "B.", "bAb"):
        assert sorted(column(df.where(match.substring(F.col("s"), key, "csas")), "s")) == sorted(w for w in words if key in w)
        assert sorted(column(df.where(match.prefix(F.col("s"), key)), "s")) == sorted(w for w in words if w.lower().startswith(key.lower()))
    for pattern in ("^a+", "b.a", "(ab|BA)$"):
        assert sorted(column(df.where(match.regex(F.col("s"), pattern)), "s")) == sorted(w for w in words if re.search(pattern, w))


def test_domains_end_at_a_label(spark):
    df = strings(spark, "a.uni.ca", "xuni.ca", "uni.ca", "ca")
    assert column(df.where(match.in_domains(F.col("s"), ["Uni.ca"])), "s") == ["a.uni.ca", "uni.ca"]
    assert df.where(match.in_domains(F.col("s"), [])).count() == df.where(match.in_domains(F.col("s"), ["*"])).count() == 4


def test_paths(spark):
    df = strings(spark, "/pub/gnu/x", "/pub/old/x", "/gnu/old")
    keep = lambda **k: column(df.where(match.path_accepted(F.col("s"), **k)), "s")
    assert keep(include=("gnu", "old"), every=True) == ["/gnu/old"]
    assert keep(include=("gnu",), exclude="old") == ["/pub/gnu/x"]
    assert len(keep(include=("",))) == len(keep()) == 3


# Boolean requests


def test_boolean_parse():
    assert boolean.parse("a AND bcd not e or f") == [Group(("bcd", "a"), ("e",)), Group(("f",), ())]
    assert boolean.parse('"not this" x') == [Group(("not this", "x"), ())]
    assert boolean.parse("not a or b") == [Group(("b",), ())]
    assert boolean.parse("") == [] and not boolean.is_boolean("word") and boolean.is_boolean("a b")


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from(["a", "bb", "ccc", "and", "or", "not"]), max_size=9))
def test_boolean_groups_have_a_positive_word(words):
    for g in boolean.parse(" ".join(words)):
        assert g.all and len(set(g.all)) == len(g.all)


def test_boolean_documents(spark):
    keys = spark.createDataFrame([(1, "apple"), (1, "pear"), (2, "apple"), (3, "apples"), (3, "fig")], "doc long, key string")
    of = lambda q: sorted(column(find.boolean_documents(keys, boolean.parse(q), "doc"), "doc"))
    assert of("apple pear") == [1] and of("apple not pear") == [2, 3] and of("pear or fig") == [1, 3] and of("not pear") == []


# Caps, pages


def test_pages_are_the_whole(spark):
    catalog = FilesCatalog(spark, SF)
    hits = find.search(catalog, find.Request("ring")).cache()
    whole = [(r.s, r.site_id, r.dir_id) for r in hits.orderBy(*find.ORDER).collect()]
    cursor, pages = None, []
    while rows := find.after(hits, cursor, 100).collect():
        pages += [(r.s, r.site_id, r.dir_id) for r in rows]
        cursor = find.cursor_of(rows[-1])
        if len(pages) >= 400:
            break
    assert pages == whole[: len(pages)] and len(pages) > 200


def test_caps_are_hard_and_clamped(spark):
    catalog = FilesCatalog(spark, SF)
    hits = find.search(catalog, find.Request("bolt", per_match=2, matches=3, hits=5)).collect()
    assert len(hits) <= 5 and len({r.s for r in hits}) <= 3
    with pytest.warns(UserWarning):
        assert find.Request("x", hits=10**6).clamped().hits == 10_000
    assert find.Request("x").clamped().per_match == 20


# Trees, domains, addresses


@pytest.mark.parametrize("most", [0, 100_000])
@pytest.mark.parametrize("caps", [(3, 2, None), (3, 2, 4), (50, 2, None), (3, 50, None), (3, None, 5), (None, 2, 5), (1, 1, 1)])
def test_caps_in_one_pass_or_two(spark, monkeypatch, most, caps):
    """Both ways of capping against a loop; names of one hit, of many, and repeated in no order."""
    monkeypatch.setattr(find, "MOST_TAKEN", most)
    rows = [(s, site, site % 3) for s, n in (("d", 1), ("a", 4), ("c", 2), ("b", 7), ("É", 1)) for site in range(n)]
    random.Random(3).shuffle(rows)
    matches, per_match, limit = caps
    expected = []
    for s in sorted({r[0] for r in rows}, key=str.encode)[:matches]:
        expected += sorted(r for r in rows if r[0] == s)[:per_match]
    hits = spark.createDataFrame(rows, "s string, site_id long, dir_id long")
    found = [tuple(r) for r in find.capped(hits, matches, per_match, limit).collect()]
    assert sorted(found) == sorted(expected[:limit])


def test_capped_search_reads_the_postings_once(spark):
    catalog = FilesCatalog(spark, SF)
    path = F.col("path")
    one = find.results(catalog, catalog.strings, path=path != "")
    scans = lambda df: df._jdf.queryExecution().optimizedPlan().toString().count("Relation [")
    assert scans(find.capped(one, 10, 5, 20)) == scans(one) > 0


def test_listing_lines_are_cut_by_one_match(spark):
    """Entries are read once, and a line's fields come from one match, not one for each use."""
    for name in ("s12_unix_listing", "s13_vms_listing", "s14_novell_listing"):
        plan = registry.queries()[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("l_orderkey") and plan.count("Relation") == 2 and plan.count("regexp_extract(") <= 1


def test_listing_filters_do_not_cut_lines_anew(spark):
    """Of the filters, only that of . and .. needs a name, and only for lines that can have it."""
    plan = registry.queries()["s12_unix_listing"](spark, SF)._jdf.queryExecution().optimizedPlan().toString().replace("\n", " ")
    below = plan[plan.index(" Filter ") :]
    assert "substr" in below and not re.search(r"split\(regexp_replace[^A-Z]*\[0\] IN", below)
    assert re.search(r"NOT RLIKE\(line#\d+, \\s\\\.\\\.\?\(\?: -> \|\$\)\) OR NOT", below) or re.search(r"NOT \(RLIKE\(line#\d+, \\s", below)


def test_listing_leaves_out_a_directory_and_the_one_above(spark):
    names = [".", "..", "...", ". x", "a .", "a ..", ". -> x", ".. -> y", "b -> .", "a . -> x", ".a", "a.", " .", ".. "]
    text = "\n".join(f"{k}rw-r--r-- 1 ftp 7 Mar 4 2001 {n}" for k in "-ldcbp" for n in names)
    got = [(r.is_dir, r.is_link, r.name) for r in listings.unix(lines(spark, text), as_of()).orderBy("line_no").collect()]
    cut = lambda k, n: n.lstrip().split(" -> ")[0] if k == "l" else n.lstrip()
    assert got == [(k == "d", k == "l", cut(k, n)) for k in "-ld" for n in names if cut(k, n) not in (".", "..")]


def test_listing_fields_with_odd_characters(spark):
    unix_lines = lines(spark, "./a:\n-rw-r--r-- 1 ftp 7 Mar 4 2001 x  y\u0001 -> $1 \\n\nlrwxrwxrwx 1 o g 3 Mar 4 2001 l -> t -> u")
    got = {r.name: (r.dir, r.size, r.is_link) for r in listings.unix(unix_lines, as_of()).collect()}
    assert got == {"x  y\u0001 -> $1 \\n": ("a", 7, False), "l": ("a", 3, True)}
    vms_lines = lines(spark, "D:[A.B]\nX.Y;1  5/9  4-MAR-2001 10:20:30  [1,4]  (RWED,R)  more (x)")
    assert [(r.dir, r.name, r.size, r.perms) for r in listings.vms(vms_lines).collect()] == [("A/B", "X.Y", 5, 0xF800)]
    perms = spark.createDataFrame([("(rwed,,re,w)",), ("",), (None,), ("(R,R,R,R,R)",)], "t string")
    assert [r[0] for r in perms.select(sc.vms_perms_bits(F.col("t"))).collect()] == [0xF0A4, 0, 0, 0x8888]


def test_tree_paths(spark):
    tree = spark.createDataFrame([(1, 0, None, "a"), (1, 1, 0, "b"), (1, 2, 1, "c"), (2, 0, None, "z")], "tree_id int, node_id int, parent_id int, name string")
    assert sorted((r.tree_id, r.path, r.depth) for r in browse.tree_paths(tree).collect()) == [(1, "/a", 0), (1, "/a/b", 1), (1, "/a/b/c", 2), (2, "/z", 0)]


def test_tree_paths_join_no_level_twice(spark):
    plan = registry.queries()["j6_paths_by_parents"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Union" in plan


def test_files_by_site_over_nulls_and_without_unfolding_entries(spark):
    rows = [(1, 1, "a", 1.5), (1, 1, "b", 2.0), (1, None, "a", None), (2, 1, "a", 4.0), (None, 2, None, 8.0), (3, None, None, None)]
    entries = spark.createDataFrame(rows, "site_id int, dir_id int, s string, size double")
    got = sorted((tuple(r) for r in stats.files_by_site(entries).collect()), key=repr)
    assert got == sorted([(1, 3, 1, 3.5, 2), (2, 1, 1, 4.0, 1), (3, 1, 0, None, 0), (None, 1, 1, 8.0, 0), (None, 6, 2, 15.5, 2)], key=repr)
    assert stats.files_by_site(entries.limit(0)).count() == entries.limit(0).rollup("site_id").count().count()
    plan = stats.files_by_site(entries)._jdf.queryExecution().optimizedPlan().toString()
    assert not [x for x in plan.splitlines() if "Expand" in x and "dir_id" in x and "s#" in x.replace("dirs#", "")]


def test_pseudo_domains(spark):
    table = config.domain_table(spark, "world europe:asia all of it\neurope fr:de \\\n two\n# none\nasia jp one\n")
    assert sorted((r.name, r.suffix) for r in browse.expand_domains(table, ["world"]).collect()) == [("world", "de"), ("world", "fr"), ("world", "jp")]
    for text in ("a b\nb a\n", "a x\na y\n"):
        with pytest.raises(ValueError):
            config.domain_table(spark, text)
    loop = spark.createDataFrame([("a", "b"), ("b", "a")], "name string, definition string")
    with pytest.raises(ValueError):
        browse.expand_domains(loop)


def test_domain_tiers(spark):
    sites = spark.createDataFrame([(1, "x.uni.ca"), (2, "y.fr"), (3, "z.com"), (4, "q.ca")], "site_id int, hostname string")
    with_star = config.with_tier(sites, config.domain_order(spark, "uni.ca\nca\n*\ncom\n"))
    assert {r.site_id: r.tier for r in with_star.collect()} == {1: -2, 2: 0, 3: 1, 4: -1}
    without = config.with_tier(sites, config.domain_order(spark, "ca\nfr\n"))
    assert {r.site_id: r.tier for r in without.collect()} == {1: -2, 2: -1, 3: 0, 4: -2}


def test_addresses(spark):
    hosts = spark.createDataFrame([("1.2.3.4",), ("1.2.9.9",), ("9.9.9.9",), ("127.0.0.1",)], "ip string")
    rules = spark.createDataFrame([("1.2.3.*", False, 1), ("1.2.*.*", True, 2)], "pattern string, allow boolean, rank int")
    assert {r.ip: r.allowed for r in browse.address_allowed(hosts, rules).collect()} == {"1.2.3.4": False, "1.2.9.9": True, "9.9.9.9": False, "127.0.0.1": True}


# Listings


def lines(spark, text):
    return spark.createDataFrame([(1, k, line) for k, line in enumerate(text.split("\n"))], "site_id int, line_no int, line string")


def as_of():
    return F.to_timestamp_ntz(F.lit("1996-03-10 00:00:00"))


def test_unix_listing(spark):
    got = listings.unix(lines(spark, """total 3
drwxr-xr-x  2 root  wheel  512 Jan  5 12:30 pub
lrwxrwxrwx  1 root  wheel    7 Dec  1 09:15 latest -> pub/one
brw-r-----  1 root  wheel  4, 0 Jan 1 1995 disk
./pub: Permission denied

./pub:
-rw-r--r--1 ftp  1024 Nov 30 1995 one file
-rwsr-xr-x  1 ftp  77 Mar 11 1994 tool"""), as_of())  # fmt: skip
    rows = {r.name: r for r in got.collect()}
    assert set(rows) == {"pub", "latest", "one file", "tool"}
    assert rows["pub"].is_dir and rows["pub"].dir == "" and rows["pub"].mtime == dt.datetime(1996, 1, 5, 12, 30)
    assert rows["latest"].is_link and rows["latest"].mtime == dt.datetime(1995, 12, 1, 9, 15)
    assert rows["one file"].dir == "pub" and rows["one file"].size == 1024 and rows["one file"].perms == 0o644
    assert rows["tool"].perms == 0o755 and rows["tool"].mtime == dt.datetime(1994, 3, 11)
    parents = {r.name: r.parent_line for r in listings.with_parents(got).collect()}
    assert parents["one file"] == rows["pub"].line_no and parents["pub"] is None


def test_listing_faults(spark):
    text = lines(spark, "what is this\n-rw-r--r--  1 ftp  77 Mar 11 1994 tool\n" + "\n".join(["odd"] * 20))
    got = listings.faults(text, listings.unix(text, as_of())).first()
    assert got.bad == 21 and not got.accepted


def test_vms_listing(spark):
    got = listings.vms(lines(spark, """DISK:[ANON.PUB]
AVERYLONGNAME_FOR_A_FILE.TXT;2
      12/15   5-JAN-1996 12:30  [1,4]  (RWED,RWED,RE,)
SUB.DIR;1  1  2-FEB-1995 00:01  [1,4]  (RWE,RWE,RE,RE)"""))  # fmt: skip
    rows = {r.name: r for r in got.collect()}
    assert rows["AVERYLONGNAME_FOR_A_FILE.TXT"].dir == "ANON/PUB" and rows["AVERYLONGNAME_FOR_A_FILE.TXT"].size == 12
    assert rows["AVERYLONGNAME_FOR_A_FILE.TXT"].perms == 0xFFA0 and rows["SUB"].is_dir and rows["SUB"].mtime == dt.datetime(1995, 2, 2, 0, 1)


def test_novell_listing(spark):
    got = listings.novell(lines(spark, "d [RWCEMFA] guest 512 Jan 5 12:30 pub\n- [R----F--] guest 9 Nov 30 1995 a b"), as_of())
    rows = {r.name: r for r in got.collect()}
    assert rows["pub"].is_dir and rows["pub"].perms == 0o777 and rows["a b"].perms == 0o444


# Web text


def test_page_parts(spark):
    html = "<html><!-- <title>no</title> --><title> A  &amp;\nB </title><body>One-two <b>caf&eacute;</b> 3</body>"
    row = spark.createDataFrame([(1, html), (2, "no title"), (3, None)], "page_id int, html string")
    got = {r.page_id: r for r in row.select("page_id", web.title(F.col("html")).alias("t"), web.excerpt(F.col("html")).alias("e")).collect()}
    assert got[2].t == "" and got[2].e == "no title" and got[3].e is None
    keys = {r.key for r in web.keywords(row, "page_id", web.plain_text(F.col("html"))).collect()}
    assert {"one-two", "café", "3"} <= keys and "body" not in keys
    long = spark.createDataFrame([(1, "<title>" + "x" * 200 + "</title>" + "y" * 600)], "page_id int, html string")
    r = long.select(F.length(web.title(F.col("html"))), F.length(web.excerpt(F.col("html")))).first()
    assert tuple(r) == (127, 511)


def test_robots(spark):
    files = spark.createDataFrame([("h", "User-agent: *\nDisallow: /all\n\nUser-agent: me # mine\nUser-agent: you\nDisallow: /me\nDisallow:\n")], "hostname string, text string")
    rules = web.robots(files)
    assert sorted(tuple(r) for r in rules.collect()) == [("h", "*", "/all"), ("h", "me", "/me"), ("h", "you", "/me")]
    assert [tuple(r) for r in web.allowed(rules, "me").collect()] == [("h", "/me")]
    assert [tuple(r) for r in web.allowed(rules, "other").collect()] == [("h", "/all")]
    urls = spark.createDataFrame([("h", "/me/x"), ("h", "/ok"), ("g", "/me/x"), ("g", "/cgi-bin/a")], "hostname string, path string")
    assert sorted(tuple(r) for r in web.permitted(urls, web.allowed(rules, "me")).collect()) == [("g", "/me/x"), ("h", "/ok")]


def test_stems():
    published = {"caresses": "caress", "ponies": "poni", "cats": "cat", "agreed": "agre", "plastered": "plaster", "motoring": "motor", "hopping": "hop", "filing": "file", "happy": "happi", "relational": "relat", "conditional": "condit", "vietnamization": "vietnam", "triplicate": "triplic", "hopeful": "hope", "goodness": "good", "revival": "reviv", "adjustment": "adjust", "adoption": "adopt", "probate": "probat", "rate": "rate", "controll": "control", "roll": "roll", "sky": "sky"}
    assert {w: porter.stem(w) for w in published} == published


def test_stems_are_found_once_for_each_row_and_kept_by_the_worker(spark):
    plan = registry.queries()["a3_stem_sums"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1
    porter._kept_stem.cache_clear()
    for _ in range(3):  # three batches
        assert porter._stems(pa.array(["running", None, "running", "of"])).to_pylist() == ["run", None, "run", "of"]
    assert porter._kept_stem.cache_info().misses == 2


@pytest.mark.parametrize("name", ["a3_stem_sums", "a4_weights", "w3_top_keywords"])
def test_weights_split_the_texts_once(spark, name):
    plan = registry.queries()[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate explode") == 1


@pytest.mark.parametrize("name", ["a3_stem_sums", "a4_weights", "w3_top_keywords"])
def test_weights_deal_postings_and_not_words(spark, name):
    """Rows are dealt by keyword as postings, unfolded behind it, totals come with them, and ranks sort once."""
    df = registry.queries()[name](spark, SF)
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    above, below = plan.split("Generate explode(postings")
    assert "MapInArrow" in below and ("RepartitionByExpression [stem" if name == "a3_stem_sums" else "windowspecdefinition(key") in below
    assert df._jdf.queryExecution().executedPlan().toString().count("WindowGroupLimit") <= 1


def test_postings_against_the_pattern(spark, monkeypatch):
    texts = ["Cat cat- -CAT e-mail--e-mail cat_dog", "\u00c4pfel-mus \u00e4 na\u00efve\u00a0caf\u00e9 \u0130x x\u00b2", None, "", "the of", "a\u0000b c\u2028d\u0085e\x1ff", "x" * 51 + " " + "y" * 50, "\U0001d4b3word word\U0001f600word 7 \u0663abc"]
    df = spark.createDataFrame(list(enumerate(texts)) + [(0, "cat more"), (3, "late")], "doc int, text string")
    words = df.select("doc", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(web.WORD), F.lit(0))).alias("key"))
    words = words.where(match.valid_keyword(F.col("key")) & ~F.col("key").isin(list(web.STOP_WORDS))).groupBy("doc", "key").agg(F.count("*").alias("num"))
    expected = sorted(tuple(r) for r in words.collect())
    assert sorted(tuple(r) for r in web.keywords(df, "doc", F.col("text")).collect()) == expected and ("e-mail" in {k for _, k, _ in expected})
    posted = [(r.key, p.doc, p.total, p.num) for r in web.postings(df, "doc", F.col("text")).collect() for p in r.postings]
    total = lambda doc: sum(n for d, _, n in expected if d == doc)
    assert sorted((d, k, n) for k, d, _, n in posted) == expected and all(t == total(d) for _, d, t, _ in posted)
    batch = pa.RecordBatch.from_arrays([pa.array(range(5)), pa.array([["b a b"], ["a"], [], ["the"], ["c", "a"]])], ["doc", "texts"])
    monkeypatch.setattr(web, "POSTED_ROWS", 2)
    rows = [(r["key"], [tuple(p.values()) for p in r["postings"]]) for b in web._posted(frozenset(["the"]), iter([batch])) for r in b.to_pylist()]
    assert rows == [("b", [(0, 3, 2)]), ("a", [(0, 3, 1), (1, 1, 1)]), ("c", [(4, 2, 1)]), ("a", [(4, 2, 1)])]


def test_top_keywords_deal_no_row_for_each_document_and_keyword(spark):
    df = registry.queries()["w3_top_keywords"](spark, SF)
    above, below = df._jdf.queryExecution().executedPlan().toString().split("Generate explode(postings")
    assert "Exchange" not in above and "Sort" not in above and below.count("MapInArrow") == 3
    assert re.search(r"Sort \[part#\d+L ASC[^\n]*\n[^\n]*Project", below.split("MapInArrow")[1]) and "Sort [doc_id" in below  # parts come whole


@pytest.mark.parametrize("least", [10, 1000])
def test_top_posted_against_top_keywords(spark, request, least):
    batch = "spark.sql.execution.arrow.maxRecordsPerBatch"
    request.addfinalizer(partial(spark.conf.set, batch, spark.conf.get(batch)))
    spark.conf.set(batch, 5)  # parts of five documents; rows of a part come in several batches
    texts = [(f"d{i % 37}", " ".join(f"k{(i * 7 + j * j) % 53}{'é' * (j % 3 == 0)}longer" for j in range(i % 29)) or None) for i in range(90)] + [(None, "a cat kept"), (None, "cat"), ("of", "of the")]
    df = spark.createDataFrame(texts, "doc string, text string")
    n_docs = web.count_indexed(df, "doc", F.col("text"))
    weights = web.weights(web.postings(df, "doc", F.col("text")), "doc", least_sites=least, n_docs=n_docs).withColumn("weight", F.round("weight", 6))
    lists = web.posting_lists(df, "doc", F.col("text"))
    assert lists.select("part").distinct().count() >= 8 and lists.select("part", F.explode("docs").alias("doc")).distinct().groupBy("doc").count().where("count > 1").isEmpty()
    for n in (1, 4, 500):
        expected = web.top_keywords(weights, "doc", n).select("doc", "key", "weight").collect()
        got = web.top_posted(lists, "doc", n_docs, n, least).select("doc", "key", "weight").collect()
        assert sorted(map(repr, got)) == sorted(map(repr, expected)) and len(got) > 30


def test_millionths_are_as_rounded_by_spark(spark):
    rng = np.random.default_rng(1)
    halves = [float(f"{k}.{d:06}5") for k in (0, 1, 12) for d in rng.integers(0, 10**6, 300)]
    x = np.array([0.0, 1 / 128, 3 / 128, 1.5e-6, 2.5e-6, 4.5e-7, 5e-7, -1 / 128, *halves, *np.nextafter(halves, 9), *np.nextafter(halves, 0), *rng.random(300)])
    rounded = [r.y for r in spark.createDataFrame([(float(v),) for v in x], "x double").select(F.round("x", 6).alias("y")).collect()]
    assert (web._millionths(x) / 1e6).tolist() == rounded


def test_keywords_of_a_list_are_those_one_by_one():
    words = ["the", "cat", "x" * 50, "x" * 51, "é", "éabc", "éab", "é" * 13 + "a" * 37, "é" * 12 + "a" * 38, "é" * 13 + "a" * 39, "\U0001d4b3word", "и", "e-mail", "\x7fabc", ""]
    for stops in (frozenset(), frozenset(["the", "éabc"])):
        assert web._are_keywords(pa.array(words), stops).tolist() == [web._is_keyword(w, stops) for w in words]


def test_weights_of_stems_against_plain_sums(spark):
    rows = [(d, k, n) for d in range(12) for k, n in (("run", 1 + d), ("running", 2), ("cat", 3), (f"only{d}", 1)) if d % 3 or k != "cat"]
    counts = spark.createDataFrame(rows, "doc int, key string, num long")
    got = {(r.doc, r.key): (r.stem, r.stem_sum, r.stem_docs, round(r.weight, 6)) for r in web.weights(counts, "doc", porter.stem_column(F.col("key"))).collect()}
    for d, k, _ in rows:
        alike = [(e, n) for e, j, n in rows if porter.stem(j) == porter.stem(k)]
        own, total, docs = sum(n for e, n in alike if e == d), sum(n for e, _, n in rows if e == d), len({e for e, _ in alike})
        assert got[d, k] == (porter.stem(k), own, docs, round(own / total * math.log10(12 / docs), 6))
    assert len(got) == len(rows)


def test_indexed_documents_are_those_with_a_keyword(spark):
    texts = ["the of", "", None, "The cat", "ééé", "éabc", "x" * 51, "x" * 50, "the-of", "-the", "cat-", "of ... 7", "THE\u0301 a", "\u0130a", "wizards", "и", "the cat-" + "y" * 60, "a" + "b" * 60 + " c"]
    df = spark.createDataFrame(list(enumerate(texts)) + [(3, "twice")], "doc int, text string")
    for stops in (web.STOP_WORDS, ("cat", "c"), ()):
        expected = web.keywords(df, "doc", F.col("text"), stops).select("doc").distinct().count()
        assert web.count_indexed(df, "doc", F.col("text"), stops).first().n_docs == expected


def test_urls(spark):
    df = strings(spark, "HTTP://User@Ex.COM:80/a//b/../c/./d?q=1#f")
    r = df.select(sc.canonical_url(F.col("s")).alias("u"), sc.resolve_path(F.lit("/a//b/../c/./d/..")).alias("p"), sc.join_url(F.lit("http://x/a/b"), F.lit("../c?d")).alias("j")).first()
    assert r.u == "http://ex.com/a//b/../c/./d?q=1" and r.p == "/a/c/" and r.j == "http://x/c?d"


# Refresh


def test_delete_undoes_insert(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "site_id int, s string")
    new = spark.createDataFrame([(3, "c")], "site_id int, s string")
    assert sorted(map(tuple, refresh.delete_sites(refresh.replace_sites(old, new), new).collect())) == sorted(map(tuple, old.collect()))


def test_upsert_keeps_the_later(spark):
    stored = spark.createDataFrame([(1, 5, "x"), (2, 5, "x")], "k int, t int, v string")
    incoming = spark.createDataFrame([(1, 5, "y"), (2, 6, "y"), (3, 1, "y")], "k int, t int, v string")
    got = sorted(map(tuple, refresh.upsert(stored, incoming, ["k"], "t").collect()))
    assert got == [(1, 5, "x"), (2, 6, "y"), (3, 1, "y")]
    assert sorted(map(tuple, refresh.upsert(stored, incoming, ["k"], "t", strictly=False).collect()))[0] == (1, 5, "y")


def test_failures(spark):
    hosts = spark.createDataFrame([("a", 2, "active"), ("b", 2, "active"), ("c", 9, "active")], "host string, fail_count int, status string")
    tried = spark.createDataFrame([("a", False), ("b", True)], "host string, ok boolean")
    assert sorted(map(tuple, refresh.failures(hosts, tried).collect())) == [("a", 3, "deleted"), ("b", 0, "active"), ("c", 9, "active")]


def test_loaded_catalog_is_consistent(spark):
    c = FilesCatalog(spark, SF)
    assert all(r.n == 0 for r in refresh.integrity(c.strings, c.postings, c.entries, c.sites).collect())


def test_catalog_configuration():
    got = config.catalogs("# all\nfiles files ftp /data R X\nweb web http \\\n /web\n")
    assert set(got) == {"files", "web"} and got["web"].folder == "/web"
    with pytest.raises(PermissionError):
        got["files"].check("R")
    got["files"].check("S")
    with pytest.raises(ValueError):
        config.catalogs("a nothing x /y\n")


def test_latency_state_keeps_the_latest_rows(spark, tmp_path):
    """Buckets larger than an Arrow batch, in any order, over two batches; a batch that runs again counts once."""
    from shelfmark.streaming import refresh as streams
    from shelfmark.streaming.tables import batch_folder, published

    rows = [("a" if k % 3 else None, k, float(k)) for k in range(900)]
    random.Random(1).shuffle(rows)
    schema = "event_type string, event_id long, value double"
    for part in (rows[:450], rows[450:]):
        spark.createDataFrame(part, schema).withColumn("ts", F.lit("2024-01-01").cast("timestamp_ntz")).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    log = spark.readStream.schema(schema + ", ts timestamp_ntz").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    folder = f"file://{tmp_path}/state"

    def write(df, number):
        for _ in range(2):
            df.write.mode("overwrite").parquet(batch_folder(folder, number))

    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4")
    try:
        streams.latency_rings(log, lambda number: published(spark, folder, None, number), write, f"{tmp_path}/checkpoint").awaitTermination()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    got = {r.event_type: (r.n, [x.event_id for x in r.ring], r.e) for r in published(spark, folder, None).withColumn("e", streams.ring_estimate(F.col("ring"))).collect()}
    for key, n in (("a", 600), (None, 300)):
        last = sorted((k for t, k, _ in rows if t == key), reverse=True)[:10]
        assert got[key] == (n, last, sum(last) / 10)
    assert published(spark, folder, None, 0) is None and published(spark, folder, None, 1).agg(F.sum("n")).first()[0] == 450


def test_every_link_is_joined(spark):
    """Against urllib, but for fragments, which lead into the same page."""
    from html import unescape
    from urllib.parse import urldefrag, urljoin

    from shelfmark.plans import registry

    links = ["/a", "/für", "/the,", "b", "b/", "../c", "../../../c", "./d?x=1&amp;y=2", "?q=1", "", "#f", "#f?g", "g#h?i", "/x/../y/.", "..", ".", "//other.org/p?q#r", "https://Other.org/a/../b#c", "mailto:a@b.c", "/p?u=/../v#w"]
    bases = ["http://h.example/dir/sub/page.html?old=1#top", "https://h.example:8080/", "http://h.example"]
    rows = [(k, b, "".join(f'<a href="{x}">t</a>' for x in links)) for k, b in enumerate(bases)]
    got = web.joined_links(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    want = lambda b, x: urldefrag(urljoin(b, unescape(x)))[0]
    rooted = lambda u: u + "/" if re.fullmatch(r"https?://[^/?]*", u) else u.replace("example?", "example/?")
    assert len(got) == len(links) * len(bases)
    assert {(r.page_id, r.href): r.target for r in got} == {(k, x): rooted(want(b, x)) for k, b in enumerate(bases) for x in links}

    pages = {r.page_id: r for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    found = [(p.page_id, m) for p in pages.values() for m in re.findall(r'(?i)<(?:a|area|frame)\s[^>]*?(?:href|src)="([^"]*)"', p.html)]
    told = registry.queries()["f11_all_links"](spark, SF).collect()
    assert any(not re.fullmatch("/[A-Za-z]+", x) for _, x in found)
    assert sorted((r.page_id, r.href, r.target) for r in told) == sorted((k, x, rooted(want(pages[k].url, x))) for k, x in found)


def test_entities_are_decoded_once(spark):
    """Against the standard library, but for the hard space, references without a semicolon and numbers of no character."""
    from html import unescape

    texts = ["", "plain", "&#233;&#xE9;&eacute;", "&amp;lt; &amp;#233;", "&#128512;&#x1F600;x", "&&amp;& a&b; &unknown; &;", "&Eacute;&thorn;&apos;&alpha;&rarr;", "a\n&quot;b&quot;\n", "x" * 5000 + "&euro;" * 5000]
    rows = [(k, x) for k, x in enumerate(texts)] + [(100, None), (101, "&#0;&#xD800;&#1114112;&#99999999;"), (102, "a&nbsp;b")]
    df = spark.createDataFrame(rows, "k int, s string").select("k", sc.decode_entities(F.col("s")).alias("s"))
    got = {r.k: r.s for r in df.collect()}
    assert {k: got[k] for k in range(len(texts))} == {k: unescape(x) for k, x in enumerate(texts)}
    assert got[100] is None and got[101] == rows[-2][1] and got[102] == "a b"


def test_links_in_any_quotes_and_base_elements(spark):
    html = """<BASE target=_top href='/docs/'><a class=x href = 'one'>1</a><A HREF=two.html>2</A><area data-href="no" href= "three#f"><frame src=four><a name="href">5</a><a title="a"href="six">6</a>"""
    rows = [(1, "http://h.example/x/y", html), (2, "http://h.example/x/y", "<a href=one>1</a>"), (3, "http://h.example/x/y", None), (4, "http://h.example/x/y", '<base href="http://o.example/z/"><a href="one&amp;two">')]
    got = web.joined_links(spark.createDataFrame(rows, "page_id int, url string, html string")).collect()
    assert sorted((r.page_id, r.href, r.target) for r in got) == [
        (1, "four", "http://h.example/docs/four"), (1, "one", "http://h.example/docs/one"), (1, "six", "http://h.example/docs/six"), (1, "three#f", "http://h.example/docs/three"),
        (1, "two.html", "http://h.example/docs/two.html"), (2, "one", "http://h.example/x/one"), (4, "one&amp;two", "http://o.example/z/one&two"),
    ]


def test_upsert_gives_one_row_a_key(spark):
    """Repeated and null keys on either side, and null times."""
    from shelfmark.operators import refresh

    schema = "k long, at long, v string"
    stored = spark.createDataFrame([(1, 5, "s1"), (2, 5, "s2"), (2, 3, "old"), (None, 5, "sn"), (4, None, "s4")], schema)
    incoming = spark.createDataFrame([(1, 6, "a"), (1, 7, "b"), (1, 7, "a"), (2, 5, "same"), (None, 9, "n1"), (None, 8, "n2"), (3, 1, "new"), (3, 1, "new"), (4, 1, "timed")], schema)
    got = lambda *how, **more: {r.k: (r["at"], r.v) for r in refresh.upsert(stored, incoming, ["k"], *how, **more).collect()}
    later = {1: (7, "b"), 2: (5, "s2"), None: (9, "n1"), 3: (1, "new"), 4: (1, "timed")}
    assert got("at") == later and refresh.upsert(stored, incoming, ["k"], "at").count() == 5
    assert got("at", strictly=False) == later | {2: (5, "same")}
    assert got() == {1: (7, "b"), 2: (5, "same"), None: (9, "n1"), 3: (1, "new"), 4: (1, "timed")}
    assert refresh.upsert(refresh.upsert(stored, incoming, ["k"], "at"), incoming, ["k"], "at").count() == 5


def test_hosts_change_status_and_need_work(spark):
    from pyspark.sql import functions as F

    from shelfmark.operators import refresh

    hosts = spark.createDataFrame([("a", "active"), ("b", "inactive"), ("c", "deleted"), ("d", "active")], "host string, status string")
    told = spark.createDataFrame([("a", "inactivate"), ("b", "activate"), ("c", "activate"), ("d", "delete")], "host string, command string")
    assert {r.host: r.status for r in refresh.with_status(hosts, told).collect()} == {"a": "inactive", "b": "active", "c": "deleted", "d": "deleted"}
    rows = [("a", "active", True, 0, "2024-01-01"), ("b", "active", False, 3, "2024-01-01"), ("c", "active", False, 0, "2024-01-01"), ("d", "active", False, 0, "2024-01-30"), ("e", "deleted", True, 9, "2024-01-30"), ("f", "disabled", True, 9, "2024-01-01")]
    df = spark.createDataFrame(rows, "host string, status string, force boolean, fail_count int, t string").withColumn("update_time", F.to_timestamp_ntz("t"))
    work = {r.host: r.work for r in refresh.needing_work(df, F.to_timestamp_ntz(F.lit("2024-01-31 00:00:00")), 10).collect()}
    assert work == {"a": "forced", "b": "failing", "c": "due", "e": "remove"}


def test_a_partial_send_keeps_keywords_of_newer_documents_only(spark):
    from pyspark.sql import functions as F

    from shelfmark.operators import refresh

    docs = spark.createDataFrame([(1, 4), (2, 5), (3, 6)], "doc_id long, rdate long")
    keys = spark.createDataFrame([(1, "x"), (2, "x"), (2, "y"), (3, "x"), (3, "z")], "doc_id long, key string")
    assert refresh.partial_send(docs, keys, docs, F.lit(5)).first()[:] == (3 + 2, 2)


def test_postings_are_repaired(spark):
    from shelfmark.operators import refresh

    entries = spark.createDataFrame([("a", 1), ("a", 1), ("b", 2)], "s string, site_id long")
    postings = spark.createDataFrame([("a", 1), ("z", 9)], "s string, site_id long")
    assert sorted(map(tuple, refresh.repaired_postings(entries, postings).collect())) == [("a", 1), ("b", 2)]


def test_index_points_of_odd_names(spark):
    names = ["", "a", "--", "-a--bc1", "É x\U0001d7d8", "word" * 500 + ".end"]
    told = strings(spark, *names, None)
    for words in (False, True):
        found = {(r.s, r.start) for r in find.index_points(told, words).collect()}
        assert found == {(s, i) for s in names for i in range(len(s)) if not words or (s[i].isalnum() and (i == 0 or not s[i - 1].isalnum()))}
    assert column(find.found_at(find.index_points(told, words=True), "x"), "s") == ["É x\U0001d7d8"]
