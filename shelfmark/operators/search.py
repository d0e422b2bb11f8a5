"""Searches over the files catalog: select strings, join postings' entries and sites, filter, cap, order, page."""

from __future__ import annotations

import base64
import json
import warnings
from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfmark.functions import match
from shelfmark.plans.boolean import Group
from shelfmark.sources.catalog import FilesCatalog

RESULT = ["s", "hostname", "path", "size", "mtime"]
#: The total order of all results: unique, as an entry is one (name, site, directory).
ORDER = ["s", "site_id", "dir_id"]

#: Greatest values of requests, and defaults: hits, strings, hits for each string (fixed values of the service).
LIMITS = {"hits": (100, 10_000), "matches": (100, 1_000), "per_match": (20, 100)}
#: Hits that one task may number; the greatest request of LIMITS asks for that many.
MOST_TAKEN = 100_000


@dataclass(frozen=True)
class Request:
    """One search.  Caps of None mean all."""

    key: str
    kind: str = "substring_ci"
    domains: Sequence[str] = ()
    include: Sequence[str] = ()
    exclude: str = ""
    every_path: bool = False
    hits: int | None = None
    matches: int | None = None
    per_match: int | None = None

    def clamped(self) -> Request:
        """Caps within the service's limits; a request beyond them is cut with a warning."""
        told = {}
        for name, (default, most) in LIMITS.items():
            asked = getattr(self, name)
            told[name] = default if asked is None else min(asked, most)
            if asked is not None and asked > most:
                warnings.warn(f"{name} is at most {most}", stacklevel=2)
        return replace(self, **told)


def results(catalog: FilesCatalog, strings: DataFrame, domains: Sequence[str] = (), path: Column | None = None) -> DataFrame:
    """Entries of the given strings on sites of the given domains.

    Sites and strings are filtered before the join and Catalyst picks its kind: a small selection is broadcast, a
    large one meets the entries by its hash."""
    sites = catalog.sites.where(match.in_domains(F.col("hostname"), domains)).select("site_id", "hostname")
    out = catalog.entries.join(strings.select("s"), "s").join(sites, "site_id")
    return out if path is None else out.where(path)


def capped(hits: DataFrame, matches: int | None = None, per_match: int | None = None, limit: int | None = None, order: Sequence[str] = ORDER) -> DataFrame:
    """The three caps: strings in string order, hits of each string, hits in all.

    With both of the first two the strings kept are among the first matches * per_match hits in string order, so one
    pass over the hits finds them, and their numbering sees no more rows than that.  Without the second, or with so many
    that one task should not hold them, the strings are found first and joined."""
    by_string = [c for c in order if c != "s"]
    if matches is not None and (per_match is None or matches * per_match > MOST_TAKEN):
        kept = hits.select("s").distinct().orderBy("s").limit(matches)
        hits, matches = hits.join(kept, "s", "left_semi"), None
    if per_match is not None:
        rank = F.row_number().over(Window.partitionBy("s").orderBy(*by_string))
        hits = hits.withColumn("_rank", rank).where(F.col("_rank") <= per_match).drop("_rank")
    if matches is not None:
        first = hits.orderBy("s", *by_string).limit(matches * per_match)
        hits = first.withColumn("_number", F.dense_rank().over(Window.orderBy("s"))).where(F.col("_number") <= matches).drop("_number")
    return hits if limit is None else hits.orderBy(*order).limit(limit)


def search(catalog: FilesCatalog, request: Request) -> DataFrame:
    """The whole simple search."""
    strings = match.tiered(catalog.strings, (request.kind,), request.key)
    path = match.path_accepted(F.col("path"), request.include, request.exclude, request.every_path)
    hits = results(catalog, strings, request.domains, path)
    return capped(hits, request.matches, request.per_match, request.hits)


def find(catalog: FilesCatalog, letter: str, request: Request) -> DataFrame:
    """A directory-service request: the letter's tests in order of preference, clamped caps, names alone if wanted."""
    kinds, names_only = match.TYPES[letter]
    request = request.clamped()
    strings = match.tiered(catalog.strings, kinds, request.key)
    if names_only:
        return strings.select("s").orderBy("s").limit(request.matches)
    path = match.path_accepted(F.col("path"), request.include, request.exclude, request.every_path)
    return capped(results(catalog, strings, request.domains, path), request.matches, request.per_match, request.hits)


def names_only(hits: DataFrame) -> DataFrame:
    return hits.select("s").distinct()


def after(hits: DataFrame, cursor: str | None, n: int, order: Sequence[str] = ORDER) -> DataFrame:
    """The next n rows behind a cursor: a keyset predicate, so no page costs more than the one before."""
    if cursor:
        hits = hits.where(F.struct(*order) > F.struct(*(F.lit(v).cast(hits.schema[c].dataType).alias(c) for c, v in zip(order, json.loads(base64.b64decode(cursor))))))
    return hits.orderBy(*order).limit(n)


def cursor_of(row, order: Sequence[str] = ORDER) -> str:
    """The text form of a place in the order."""
    return base64.b64encode(json.dumps([row[c] for c in order]).encode()).decode()


def boolean_strings(strings: DataFrame, groups: Sequence[Group], mode: str = "cias") -> DataFrame:
    """Names that hold all words of a group and none of its excluded ones, for any of the groups: one filter."""
    hit = F.lit(False)
    for g in groups:
        own = F.lit(True)
        for w in g.all:
            own = own & match.substring(F.col("s"), w, mode)
        for w in g.none:
            own = own & ~match.substring(F.col("s"), w, mode)
        hit = hit | own
    return strings.where(hit)


def boolean_documents(keywords: DataFrame, groups: Sequence[Group], doc: str) -> DataFrame:
    """Documents by their keywords: AND by counting a document's distinct words, NOT by an anti-join.

    keywords: (doc, key).  Words match by prefix.  One pass over the keywords serves all words of all groups."""
    wanted = {w.lower() for g in groups for w in (*g.all, *g.none)}
    if not wanted:
        return keywords.select(doc).distinct().limit(0)
    flags = [F.max(F.col("key").startswith(w)).alias(f"w{k}") for k, w in enumerate(sorted(wanted))]
    place = {w: f"w{k}" for k, w in enumerate(sorted(wanted))}
    any_word = F.lit(False)
    for w in wanted:
        any_word = any_word | F.col("key").startswith(w)
    docs, hit = keywords.where(any_word).groupBy(doc).agg(*flags), F.lit(False)
    for g in groups:
        own = F.lit(True)
        for w in g.all:
            own = own & F.col(place[w.lower()])
        for w in g.none:
            own = own & ~F.col(place[w.lower()])
        hit = hit | own
    return docs.where(hit).select(doc)


#: Sort orders of results; size and time put the greatest first.  A leading r turns an order round.
SORTS = {"none": [], "filename": [("s", True)], "hostname": [("hostname", True)], "size": [("size", False)], "time": [("mtime", False)]}


def sort_keys(name: str) -> list[Column]:
    turned = name.startswith("r") and name[1:] in SORTS
    keys = [F.col(c).asc() if up != turned else F.col(c).desc() for c, up in SORTS[name[1:] if turned else name]]
    return [*keys, *(F.col(c) for c in ORDER)]


def sorted_results(hits: DataFrame, name: str) -> DataFrame:
    return hits.orderBy(*sort_keys(name))


def index_points(strings: DataFrame, words: bool = False) -> DataFrame:
    """strings (s, each once) to (s, start): the places, from 0, at which a name is found: all of its characters, or
    only those where a word begins.  Empty names have none.

    A word's place is the running length of what stands before it, so long names cost no more for each character."""
    if not words:
        return strings.where("s != ''").select("s", F.explode(F.sequence(F.lit(0).cast("long"), F.char_length("s").cast("long") - 1)).alias("start"))
    parts = strings.select("s", F.posexplode(F.regexp_extract_all("s", F.lit(r"[^\p{L}\p{N}]*[\p{L}\p{N}]+"), F.lit(0))).alias("pos", "part"))
    end = F.sum(F.char_length("part")).over(Window.partitionBy("s").orderBy("pos"))
    return parts.select("s", (end - F.char_length(F.regexp_extract("part", r"[\p{L}\p{N}]+$", 0))).alias("start"))


def found_at(points: DataFrame, key: str) -> DataFrame:
    """Names that go on with the key from one of their index points."""
    return points.where(F.substr("s", (F.col("start") + 1).cast("int"), F.char_length(F.lit(key))) == key).select("s").distinct()
