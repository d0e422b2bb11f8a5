"""The web catalog: links, titles, excerpts, keywords and their weights, from a table of pages."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from decimal import ROUND_HALF_UP, Decimal
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, ShortType, StructField, StructType

from shelfmark.functions import scalars as sc

COMMENT, TAG = r"(?s)<!--.*?-->", r"(?s)<[^>]*>"
WORD = r"[\p{L}\p{N}]+(?:-[\p{L}\p{N}]+)*"

#: English function words that are no keywords (this library's own short list; any list can be passed instead).
STOP_WORDS = ("a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "has", "he", "in", "is", "it", "its", "of", "on", "or", "that", "the", "this", "to", "was", "were", "will", "with")


def plain_text(html: Column) -> Column:
    """Without comments and tags (script text stays), entities decoded."""
    return sc.decode_entities(F.regexp_replace(F.regexp_replace(html, COMMENT, " "), TAG, " "))


def collapsed(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"[ \t\r\n\f]+", " "))


def title(html: Column) -> Column:
    """At most 127 characters, white space collapsed."""
    return F.substr(collapsed(sc.decode_entities(F.regexp_extract(html, r"(?is)<title>(.*?)</title>", 1))), F.lit(1), F.lit(127))


def excerpt(html: Column) -> Column:
    """At most 511 characters of the text behind the title, if there is one."""
    return F.substr(collapsed(plain_text(F.regexp_replace(html, r"(?is)^.*?</title>", ""))), F.lit(1), F.lit(511))


def documents(pages: DataFrame) -> DataFrame:
    return pages.select("page_id", "url", sc.url_host(F.col("url")).alias("hostname"), sc.url_port(F.col("url")).alias("port"), sc.url_path(F.col("url")).alias("path"), title(F.col("html")).alias("title"), excerpt(F.col("html")).alias("excerpt"))


_ATTRIBUTE = r"""\s(?:[^>]*?[\s"'])?{}\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)"""
HREF = "(?i)<(?:a|area|frame)" + _ATTRIBUTE.format("(?:href|src)")
BASE = "(?i)<base" + _ATTRIBUTE.format("href")
QUOTES = """^["']|["']$"""


def hrefs(html: Column) -> Column:
    """Targets of anchors, areas and frames, as written, in quotes of either kind or in none."""
    return F.transform(F.regexp_extract_all(html, F.lit(HREF), F.lit(1)), lambda x: F.regexp_replace(x, QUOTES, ""))


def base_url(url: Column, html: Column) -> Column:
    """What a page's links are seen from: its base element's address, else its own."""
    given = F.trim(sc.decode_entities(F.regexp_replace(F.regexp_extract(html, BASE, 1), QUOTES, "")))
    return F.when(given != "", sc.join_url(url, given)).otherwise(url)


def links(pages: DataFrame) -> DataFrame:
    """(page_id, href), a row for each link."""
    return pages.select("page_id", F.explode(hrefs(F.col("html"))).alias("href"))


def joined_links(pages: DataFrame) -> DataFrame:
    """(page_id, href, target): every link as written, and its URL seen from the page."""
    told = pages.select("page_id", base_url(F.col("url"), F.col("html")).alias("base"), F.explode(hrefs(F.col("html"))).alias("href"))
    return told.select("page_id", "href", sc.join_url(F.col("base"), F.trim(sc.decode_entities(F.col("href")))).alias("target"))


def external_hosts(linked: DataFrame, sites: DataFrame) -> DataFrame:
    """Host names that are linked to and are no site yet."""
    return linked.where("hostname != ''").select("hostname").distinct().join(sites.select("hostname"), "hostname", "left_anti")


#: Types of documents whose text is indexed.
INDEXABLE = ("www/", "text/html", "text/plain")


def indexable_type(kind: Column) -> Column:
    out = F.lit(False)
    for start in INDEXABLE:
        out = out | F.lower(kind).startswith(start)
    return out


def has_suffix(path: Column, suffixes) -> Column:
    out = F.lit(False)
    for end in suffixes:
        out = out | path.endswith(end)
    return out


def permitted(urls: DataFrame, prefixes: DataFrame, root: str = "/") -> DataFrame:
    """urls (hostname, path) below the root, of no script, and without those that a host's prefixes exclude.

    A path is unfolded into the prefixes of the lengths that rules have, so that the anti-join is an equality."""
    inside = urls.where(F.col("path").startswith(root) & ~F.col("path").contains("/cgi-bin/"))
    rules = prefixes.select("hostname", F.col("prefix").alias("_prefix")).distinct()
    sizes = rules.groupBy("hostname").agg(F.collect_set(F.length("_prefix")).alias("_sizes"))
    told = inside.join(sizes, "hostname", "left").withColumn("_prefixes", F.transform("_sizes", lambda n: F.substr("path", F.lit(1), n)))
    barred = told.select("hostname", "path", F.explode("_prefixes").alias("_prefix")).join(rules, ["hostname", "_prefix"], "left_semi")
    return inside.join(barred.select("hostname", "path").distinct(), ["hostname", "path"], "left_anti")


def keyword_lists(counts: DataFrame, doc: str) -> DataFrame:
    """(doc, keys): a document's keywords as one text, in order."""
    return counts.groupBy(doc).agg(F.array_join(F.array_sort(F.collect_list("key")), " ").alias("keys"))


#: WORD for Python, where \w is letters, numbers and the underscore; and ASCII characters that no word has, as blanks.
_WORD = re.compile(r"[^\W_]+(?:-[^\W_]+)*")
_PARTED = bytes(c if c > 127 or chr(c).isalnum() or chr(c) == "-" else 32 for c in range(256))
#: Documents that a row of postings is of at most (their places are 16 bits), and about how many of their words a task holds at once.
POSTED_ROWS, POSTED_WORDS = 8192, 1 << 21


def _is_keyword(word: str, stops: frozenset[str]) -> bool:
    """As match.valid_keyword, and no stop word."""
    return word not in stops and len(word) <= 50 and (word.isascii() or sum(c > "\x7f" for c in word) * 4 <= len(word))


def _are_keywords(words: pa.Array, stops: frozenset[str]) -> np.ndarray:
    """_is_keyword of each."""
    ascii, stop, size = (x.to_numpy(zero_copy_only=False) for x in (pc.string_is_ascii(words), pc.is_in(words, pa.array(sorted(stops), words.type)), pc.utf8_length(words)))
    out = ~stop & (size <= 50)
    odd = pc.count_substring_regex(words.filter(pa.array(~ascii)), r"[^\x00-\x7f]").to_numpy(zero_copy_only=False)
    out[~ascii] &= odd * 4 <= size[~ascii]
    return out


def _word_counts(texts: list[bytes]) -> Counter:
    """How often each word stands in the texts: blanks part most, and the pattern is for what has other signs."""
    found = Counter()
    for text in texts:
        found.update(text.translate(_PARTED).decode().split())
    for piece in [k for k in found if not k.isalnum()]:
        n = found.pop(piece)
        for word in _WORD.findall(piece):
            found[word] = found.get(word, 0) + n
    return found


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[int], pa.DictionaryArray, np.ndarray]]:
    """Slices of (doc, lower-case texts): how many words each document has, its words and how often each stands there."""
    for batch in batches:
        start, n, sizes, words, nums = 0, 0, [], [], []
        for end, texts in enumerate(batch.column(1).cast(pa.list_(pa.binary())), 1):
            found = _word_counts(texts.as_py())
            words.append(pa.array(list(found), pa.string()))
            nums.append(np.fromiter(found.values(), np.int64, len(found)))
            sizes.append(len(found))
            n += len(found)
            if end == batch.num_rows or len(sizes) == POSTED_ROWS or n >= POSTED_WORDS:
                yield batch.slice(start, end - start), sizes, pa.concat_arrays(words).dictionary_encode(), np.concatenate(nums)
                start, n, sizes, words, nums = end, 0, [], [], []


def _posted(stops: frozenset[str], batches: Iterator[pa.RecordBatch], apart: bool = False) -> Iterator[pa.RecordBatch]:
    """(key, postings), or (part, docs, key, at, nums), of slices of (doc, lower-case texts); part is a slice's first doc."""
    for part, sizes, coded, num in _counted(batches):
        key, code = coded.dictionary, coded.indices.to_numpy()
        kept = _are_keywords(key, stops)
        doc = np.repeat(np.arange(part.num_rows), sizes)
        code, doc, num = (x[kept[code]] for x in (code, doc, num))
        total = np.zeros(part.num_rows, np.int64)
        np.add.at(total, doc, num)
        by_key, count = np.argsort(code, kind="stable"), np.bincount(code, minlength=len(kept))[kept]
        doc, num, key = doc[by_key], num[by_key], key.filter(pa.array(kept))
        ends = pa.array(np.concatenate([[0], np.cumsum(count)]).astype(np.int32))
        if not apart:
            posting = pa.StructArray.from_arrays([part.column(0).take(pa.array(doc)), pa.array(total[doc]), pa.array(num)], [part.schema.field(0).name, "total", "num"])
            yield pa.RecordBatch.from_arrays([key, pa.ListArray.from_arrays(ends, posting)], ["key", "postings"])
        elif len(key):
            first = part.column(0).take(pa.array(np.zeros(len(key), np.int64)))
            docs = pa.ListArray.from_arrays(pa.array([0] + [part.num_rows] * len(key), pa.int32()), part.column(0))
            at, nums = (pa.ListArray.from_arrays(ends, pa.array(x)) for x in (doc.astype(np.int16), num.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([first, docs, key, at, nums], ["part", "docs", "key", "at", "nums"])


def _having(stops: frozenset[str], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc) of each (doc, lower-case text) with a keyword; a text is read up to its first, and a null is known to have one."""
    for batch in batches:
        for start in range(0, batch.num_rows, POSTED_ROWS):
            part = batch.slice(start, POSTED_ROWS)
            has = [text is None or any(_is_keyword(m.group(), stops) for m in _WORD.finditer(text)) for text in part.column(1).to_pylist()]
            yield part.select([0]).filter(pa.array(has, pa.bool_()))


def _texts(texts: DataFrame, doc: str, text: Column) -> DataFrame:
    """(doc, lower-case texts), one row for each document, dealt by document."""
    return by_document(texts.select(doc, F.lower(text).alias("texts")), doc).groupBy(doc).agg(F.collect_list("texts").alias("texts"))


def postings(texts: DataFrame, doc: str, text: Column, stop_words=STOP_WORDS) -> DataFrame:
    """(key, postings of doc, total, num): how often a keyword stands in some documents, and how many each has in all.

    Words are counted where the texts are: a row leaves for each keyword of up to POSTED_ROWS documents, not for each
    word.  A document and a key meet once; a key has several rows."""
    posting = StructType([texts.schema[doc], *StructType.fromDDL("total long, num long")])
    return _texts(texts, doc, text).mapInArrow(partial(_posted, frozenset(stop_words)), StructType().add("key", "string").add("postings", ArrayType(posting)))


def posting_lists(texts: DataFrame, doc: str, text: Column, stop_words=STOP_WORDS) -> DataFrame:
    """(part, place, docs, key, at, nums): postings that take less room, with all keywords of a document in one part.

    at are places in the part's docs, which stand on one of its rows.  Documents are in order before they are cut into
    parts, so that a task that is run again makes the same ones; place is the partition that a part is made in."""
    kind = texts.schema[doc].dataType
    made = StructType().add("part", kind).add("docs", ArrayType(kind)).add("key", "string").add("at", ArrayType(ShortType())).add("nums", ArrayType(IntegerType()))
    told = _texts(texts, doc, text).sortWithinPartitions(doc).mapInArrow(partial(_posted, frozenset(stop_words), apart=True), made)
    return told.withColumn("place", F.spark_partition_id())


def _unposted(posted: DataFrame) -> DataFrame:
    """A row for each posting, beside what else there is."""
    rest = [c for c in posted.columns if c != "postings"]
    return posted.select(*rest, F.explode("postings").alias("_posting")).select(*rest, "_posting.*")


def keywords(texts: DataFrame, doc: str, text: Column, stop_words=STOP_WORDS) -> DataFrame:
    """(doc, key, num): how often each keyword stands in a text, in lower case, without stop words and odd words."""
    return _unposted(postings(texts, doc, text, stop_words)).select(doc, "key", "num")


def by_document(texts: DataFrame, doc: str) -> DataFrame:
    """texts dealt by document, so that counting and totals of a document need no further shuffle.

    The number of parts is the session's and stays: a part's rows grow a hundredfold when texts become words."""
    return texts.repartition(int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")), doc)


def count_indexed(texts: DataFrame, doc: str, text: Column, stop_words=STOP_WORDS) -> DataFrame:
    """(n_docs), one row: how many documents have a keyword.

    Only texts go to Python that have no plain word, longer than all stop words, between blanks."""
    least = max(map(len, stop_words), default=0) + 1
    plain = F.rlike(text, F.lit(rf"(?:^|[ \n])[A-Za-z]{{{least},50}}(?:[ \n.,]|$)")) if least <= 50 else F.lit(False)
    told = texts.where(text.isNotNull()).select(doc, F.when(~plain, F.lower(text)).alias("text"))
    return told.mapInArrow(partial(_having, frozenset(stop_words)), StructType([texts.schema[doc]])).agg(F.countDistinct(doc).alias("n_docs"))


def weights(counts: DataFrame, doc: str, stem: Column | None = None, least_sites: int = 10, n_docs: DataFrame | None = None) -> DataFrame:
    """counts (doc, key, num), a key once for a document, with weight: the stem's share of the document's keywords,
    times the logarithm of how rare the stem is; the share alone while there are fewer than least_sites documents.

    Counts can be given as postings, which are dealt by stem before they become a row for each document.  They are read
    once; n_docs is one row, counted from counts where none is given."""
    posted = "postings" in counts.columns
    size = (_unposted(counts) if posted else counts).agg(F.countDistinct(doc).alias("n_docs")) if n_docs is None else n_docs
    told = counts if posted else counts.withColumn("total", F.sum("num").over(Window.partitionBy(doc)))
    if stem is None:
        docs = F.size("postings") if posted else F.lit(1)
        told = told.withColumn("stem_docs", F.sum(docs).over(Window.partitionBy("key")))
        told = (_unposted(told) if posted else told).select("*", F.col("key").alias("stem"), F.col("num").alias("stem_sum"))
    else:
        told = told.withColumn("stem", stem).repartition("stem")
        of_stem = Window.partitionBy("stem", doc).orderBy("key")
        told = (_unposted(told) if posted else told).withColumn("_first", (F.row_number().over(of_stem) == 1).cast("int"))
        told = told.withColumn("stem_sum", F.sum("num").over(of_stem.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
        told = told.withColumn("stem_docs", F.sum("_first").over(Window.partitionBy("stem"))).drop("_first")
    out = told.crossJoin(F.broadcast(size))  # one row
    share = F.col("stem_sum") / F.col("total")
    return out.withColumn("weight", F.when(F.col("n_docs") < least_sites, share).otherwise(share * F.log10(F.col("n_docs") / F.col("stem_docs"))))


def _millionths(x: np.ndarray) -> np.ndarray:
    """x in millionths, rounded as Spark's round(x, 6): halves of the decimal form go up."""
    big = np.abs(x) * 1e6
    out = np.floor(big + 0.5)
    for i in np.flatnonzero(np.abs(big - np.floor(big) - 0.5) < 1e-6):
        out[i] = Decimal(repr(float(abs(x[i])))).scaleb(6).to_integral_value(ROUND_HALF_UP)
    return np.copysign(out, x)


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of equal first columns, which come one after the other, as one batch each."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        code = batch.column(0).dictionary_encode("encode").indices.to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(code)) + 1).tolist(), batch.num_rows]
        for start, end in zip(cuts, cuts[1:]):
            if held and held[0].column(0)[0].as_py() != batch.column(0)[start].as_py():
                yield pa.concat_batches(held)
                held = []
            held.append(batch.slice(start, end - start))
    if held:
        yield pa.concat_batches(held)


def _top_posted(doc: str, n: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, postings of doc, weight), a document's first n, of (part, docs, key, factor, at, nums)."""
    for batch in _parts(batches):
        docs, key, factor = batch.column(1).flatten(), batch.column(2), batch.column(3).to_numpy()
        code, num = (batch.column(i).flatten().to_numpy() for i in (4, 5))
        row = np.repeat(np.arange(len(key)), pc.list_value_length(batch.column(4)).to_numpy())
        total = np.zeros(len(docs), np.int64)
        np.add.at(total, code, num)
        weight = _millionths(num / total[code] * factor[row])
        kept = np.ones(len(row), bool)
        many = np.flatnonzero((np.bincount(code, minlength=len(docs)) > n)[code])  # the others need no rank
        if len(many):
            place = np.empty(len(key), np.int64)
            place[pc.sort_indices(key).to_numpy()] = np.arange(len(key))
            many = many[np.lexsort((place[row[many]], -weight[many], code[many]))]
            sizes = np.bincount(code[many])
            rank = np.arange(len(many)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            kept[many[rank >= n]] = False
        ends = np.concatenate([[0], np.cumsum(np.bincount(row[kept], minlength=len(key)))]).astype(np.int32)
        out = pa.StructArray.from_arrays([docs.take(pa.array(code[kept])), pa.array(weight[kept] / 1e6)], [doc, "weight"])
        yield pa.RecordBatch.from_arrays([key, pa.ListArray.from_arrays(pa.array(ends), out)], ["key", "postings"])


def top_posted(lists: DataFrame, doc: str, n_docs: DataFrame, n: int = 500, least_sites: int = 10) -> DataFrame:
    """(key, doc, weight): of posting_lists, up to n keywords for each document, as top_keywords has them of weights that
    are rounded to six places, as these are.

    Lists are dealt by keyword for the number of documents, and back to where they came from; neither is a row for each
    document and keyword.  The documents of a part are ranked together, and only those of more than n keywords."""
    told = lists.repartition("key").withColumn("stem_docs", F.sum(F.size("at")).over(Window.partitionBy("key")))
    parts = int(lists.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = told.repartitionById(parts, F.col("place")).crossJoin(F.broadcast(n_docs))  # one row
    factor = F.when(F.col("n_docs") < least_sites, 1.0).otherwise(F.log10(F.col("n_docs") / F.col("stem_docs")))
    dealt = dealt.select("part", "docs", "key", factor.alias("factor"), "at", "nums").sortWithinPartitions("part")
    posting = StructType([StructField(doc, lists.schema["part"].dataType), *StructType.fromDDL("weight double")])
    return _unposted(dealt.mapInArrow(partial(_top_posted, doc, n), StructType().add("key", "string").add("postings", ArrayType(posting))))


def top_keywords(weighted: DataFrame, doc: str, n: int = 500) -> DataFrame:
    """weighted with rank, up to n for each document.

    Rows are dealt by document before they are ranked: a task of rows dealt by keyword has few of a document's, so that
    a first cut there would sort them all and drop next to none."""
    rank = F.row_number().over(Window.partitionBy(doc).orderBy(F.round("weight", 6).desc(), "key"))
    return weighted.repartition(doc).withColumn("rank", rank).where(F.col("rank") <= n)


def url_tree(urls: DataFrame) -> DataFrame:
    """(hostname, port, path, kind): hosts' ports, every folder on the way, and the documents, once each."""
    url = F.col("url")
    told = urls.select(sc.url_host(url).alias("hostname"), sc.url_port(url).alias("port"), sc.url_path(url).alias("path"))
    parts = F.split("path", "/")
    folders = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.concat(F.array_join(F.slice(parts, F.lit(1), i), "/"), F.lit("/")))
    dirs = told.select("hostname", "port", F.explode(folders).alias("path")).select("*", F.lit("dir").alias("kind"))
    docs = told.where(~F.col("path").endswith("/")).select("hostname", "port", "path", F.lit("doc").alias("kind"))
    return dirs.unionByName(docs).distinct()


def allowed(rules: DataFrame, agent: str) -> DataFrame:
    """Of robots rules (hostname, agent, prefix): for each host those of the agent, or of * where it has none."""
    own = rules.where(F.lower("agent").isin(agent.lower(), "*"))
    best = own.groupBy("hostname").agg(F.max(F.col("agent") != "*").alias("named"))
    return own.join(best, "hostname").where((F.col("agent") != "*") == F.col("named")).select("hostname", "prefix")


def robots(files: DataFrame) -> DataFrame:
    """(hostname, agent, prefix) of robots files (hostname, text); agents in a row share the rules below them."""
    lines = files.select("hostname", F.posexplode(F.split("text", r"\r?\n")).alias("line", "raw"))
    lines = lines.select("hostname", "line", F.trim(F.regexp_replace("raw", "#.*$", "")).alias("raw")).where("raw != ''")
    lines = lines.select("hostname", "line", F.lower(F.trim(F.split_part("raw", F.lit(":"), F.lit(1)))).alias("field"), F.trim(F.regexp_replace("raw", "^[^:]*:", "")).alias("value"))
    by_line = Window.partitionBy("hostname").orderBy("line")
    starts = (F.col("field") == "user-agent") & (F.coalesce(F.lag("field").over(by_line), F.lit("")) != "user-agent")
    lines = lines.withColumn("block", F.sum(starts.cast("int")).over(by_line))
    agents = lines.where("field = 'user-agent'").select("hostname", "block", F.col("value").alias("agent"))
    rules = lines.where("field = 'disallow' and value != ''").select("hostname", "block", F.col("value").alias("prefix"))
    return agents.join(rules, ["hostname", "block"]).select("hostname", "agent", "prefix")


def frontier(found: DataFrame, visited: DataFrame) -> DataFrame:
    """URLs not visited yet, once each."""
    return found.select("url").distinct().join(visited.select("url"), "url", "left_anti")
