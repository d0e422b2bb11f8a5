"""Refreshing a catalog: snapshot comparison, replacement, upserts, site exchange, consistency."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def diff(old: DataFrame, new: DataFrame, keys: list[str], compared: list[str]) -> DataFrame:
    """(keys, change): added, removed, changed or same, by one full outer join on the keys."""
    marked = lambda df, side: df.select(*keys, F.struct(*compared).alias(f"_{side}"))
    both = marked(old, "old").join(marked(new, "new"), keys, "full_outer")
    change = F.when(F.col("_old").isNull(), "added").when(F.col("_new").isNull(), "removed").when(F.col("_old") == F.col("_new"), "same").otherwise("changed")
    return both.select(*keys, change.alias("change"))


def newest(batch: DataFrame, keys: list[str], newer: str | None = None) -> DataFrame:
    """One row for each key, the latest (of equal times, or without times, the greatest row), by map-side combined
    maxima.  Null keys are equal."""
    rest = [c for c in batch.columns if c not in (*keys, newer)]
    order = [*([newer] if newer else []), *rest]
    if not order:
        return batch.distinct()
    best = batch.groupBy(*keys).agg(F.max(F.struct(*order)).alias("_best"))
    return best.select(*(F.col(c) if c in keys else F.col(f"_best.{c}").alias(c) for c in batch.columns))


def upsert(stored: DataFrame, incoming: DataFrame, keys: list[str], newer: str | None = None, strictly: bool = True) -> DataFrame:
    """stored with incoming rows put in by their keys; with newer, only where its time is (strictly) later.

    One row for each key comes out, whatever comes in: rows that share a key on one side are reduced to the newest
    first, a null key equals itself, and a null time is earlier than any other.  One join of both sides."""
    theirs = newest(incoming.select(*stored.columns), keys, newer)
    mine = newest(stored, keys, newer)
    sides = mine.select(F.struct(*mine.columns).alias("_mine"), *(F.col(k).alias(f"_m{i}") for i, k in enumerate(keys))), theirs.select(F.struct(*theirs.columns).alias("_theirs"), *(F.col(k).alias(f"_t{i}") for i, k in enumerate(keys)))
    same = F.lit(True)
    for i in range(len(keys)):
        same = same & F.col(f"_m{i}").eqNullSafe(F.col(f"_t{i}"))
    both = sides[0].join(sides[1], same, "full_outer")
    take = F.col("_mine").isNull()
    if newer is None:
        take = take | F.col("_theirs").isNotNull()
    else:
        new, old = F.col(f"_theirs.{newer}"), F.col(f"_mine.{newer}")
        later = (new > old) | (new.isNotNull() & old.isNull())
        take = take | F.coalesce(later if strictly else later | new.eqNullSafe(old) & F.col("_theirs").isNotNull(), F.lit(False))
    out = both.select(F.when(take, F.col("_theirs")).otherwise(F.col("_mine")).alias("_row"))
    return out.select(*(F.col(f"_row.{c}").alias(c) for c in stored.columns))


def replace_sites(stored: DataFrame, incoming: DataFrame, site: str = "site_id", sites: DataFrame | None = None) -> DataFrame:
    """All rows of the incoming sites in place of the stored ones.  sites: those that are replaced, if some of them may
    have no rows any more."""
    return delete_sites(stored, incoming if sites is None else sites, site).unionByName(incoming)


def delete_sites(stored: DataFrame, sites: DataFrame, site: str = "site_id") -> DataFrame:
    return stored.join(sites.select(site).distinct(), site, "left_anti")


def new_strings(names: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Names that the dictionary does not have yet."""
    return names.select("s").distinct().join(dictionary.select("s"), "s", "left_anti")


def wanted_tuples(tuples: DataFrame, local: DataFrame) -> DataFrame:
    """Offered (host, catalog, retrieve_time) that are new here, or newer and neither disabled nor deleted."""
    mine = local.select("host", "catalog", F.col("retrieve_time").alias("_mine"), "status")
    both = tuples.join(mine, ["host", "catalog"], "left")
    wanted = F.col("_mine").isNull() | ((F.col("retrieve_time") > F.col("_mine")) & ~F.col("status").isin("disabled", "deleted"))
    return both.where(wanted).select(*tuples.columns)


def changed_since(hosts: DataFrame, since: Column, earlier: bool = False) -> DataFrame:
    """Catalogs retrieved after (or before) a time, and those forced; a row for each access method."""
    told = hosts.withColumn("catalog", F.explode("access_methods"))
    when = F.col("retrieve_time") < since if earlier else F.col("retrieve_time") > since
    return told.where(when | F.col("force")).drop("access_methods")


def due(hosts: DataFrame, as_of: Column, every_days: int) -> DataFrame:
    """Active hosts whose last update is older than every_days."""
    return hosts.where((F.col("status") == "active") & (F.col("update_time") < as_of - F.make_dt_interval(F.lit(every_days))))


def failures(hosts: DataFrame, failed: DataFrame, most: int = 2) -> DataFrame:
    """hosts (host, fail_count, status) with a failure more, or none after a success; over most, to be deleted.

    failed: (host, ok) of the hosts that were tried."""
    both = hosts.join(failed, "host", "left")
    count = F.when(F.col("ok").isNull(), F.col("fail_count")).when(F.col("ok"), 0).otherwise(F.col("fail_count") + 1)
    both = both.withColumn("fail_count", count)
    return both.withColumn("status", F.when((F.col("fail_count") > most) & (F.col("ok") == F.lit(False)), "deleted").otherwise(F.col("status"))).drop("ok")


def integrity(strings: DataFrame, postings: DataFrame, entries: DataFrame, sites: DataFrame) -> DataFrame:
    """(fault, n): what refers to something that is not there.

    Entries are counted by (s, site_id) and met with the postings in one outer join, and their strings and sites are
    looked up once: each table is read once."""
    counted = entries.groupBy("s", "site_id").agg(F.count("*").alias("n"))
    told = counted.join(postings.select("s", "site_id").distinct().withColumn("posted", F.lit(True)), ["s", "site_id"], "full_outer")
    told = told.join(strings.select("s").distinct().withColumn("known", F.lit(True)), "s", "left").join(sites.select("site_id").distinct().withColumn("placed", F.lit(True)), "site_id", "left")
    n, posted = F.coalesce("n", F.lit(0)), F.col("posted").isNotNull()
    faults = {
        "entry_without_string": F.sum(F.when(F.col("known").isNull(), n)),
        "entry_without_posting": F.sum(F.when(~posted, n)),
        "posting_without_entry": F.count_if(posted & (n == 0)),
        "posting_without_string": F.count_if(posted & F.col("known").isNull()),
        "entry_without_site": F.sum(F.when(F.col("placed").isNull(), n)),
    }
    one = told.agg(*(F.coalesce(c, F.lit(0)).cast("long").alias(k) for k, c in faults.items()))
    return one.select(F.inline(F.array(*(F.struct(F.lit(k).alias("fault"), F.col(k).alias("n")) for k in faults))))


def repaired_postings(entries: DataFrame, postings: DataFrame) -> DataFrame:
    """Postings as the entries need them: those that are missing added, those that no entry has left out."""
    needed = entries.select("s", "site_id").distinct()
    return postings.select("s", "site_id").distinct().join(needed, ["s", "site_id"], "left_semi").unionByName(missing_postings(entries, postings))


def with_status(hosts: DataFrame, told: DataFrame) -> DataFrame:
    """hosts with the status that told (host, command) asks for: activate, inactivate or delete.  A deleted host can't be
    activated or inactivated any more; a host that told does not name stays as it is."""
    both = hosts.join(told.select("host", "command"), "host", "left")
    gone = F.col("status") == "deleted"
    status = F.when(F.col("command") == "delete", "deleted").when(gone, "deleted").when(F.col("command") == "activate", "active").when(F.col("command") == "inactivate", "inactive").otherwise(F.col("status"))
    return both.withColumn("status", status).select(*hosts.columns)


def needing_work(hosts: DataFrame, as_of: Column, every_days: int, most_failures: int = 2) -> DataFrame:
    """(host, work): for each host that the catalog's keeper must look at, the first reason."""
    late = F.col("update_time") < as_of - F.make_dt_interval(F.lit(every_days))
    work = F.when(F.col("status") == "deleted", "remove").when(F.col("status") == "disabled", None).when(F.col("force"), "forced").when(F.col("fail_count") > most_failures, "failing").when(late, "due")
    return hosts.select("host", work.alias("work")).where("work is not null")


def partial_send(documents: DataFrame, keywords: DataFrame, excerpts: DataFrame, since: Column) -> DataFrame:
    """(records, excerpts): what a partial exchange sends.  Of documents changed after the time, and only of those, the
    keywords go too, all other document records go alone; excerpts go from that very time on."""
    newer = documents.where(F.col("rdate") > since).select("doc_id")
    own = keywords.join(newer, "doc_id", "left_semi").agg(F.count("*").alias("keys"))
    records = documents.agg(F.count("*").alias("docs")).crossJoin(own)  # one row each
    sent = excerpts.agg(F.count_if(F.col("rdate") >= since).alias("excerpts"))
    return records.crossJoin(sent).select((F.col("docs") + F.col("keys")).alias("records"), "excerpts")


def missing_postings(entries: DataFrame, postings: DataFrame) -> DataFrame:
    return entries.select("s", "site_id").distinct().join(postings, ["s", "site_id"], "left_anti")


def host_faults(hosts: DataFrame, known: DataFrame) -> DataFrame:
    """hosts (host, ip, port) with a status: the first rule that they break, or ok."""
    by_ip = known.select("ip", F.col("host").alias("_holder")).groupBy("ip").agg(F.min("_holder").alias("_holder"))
    by_name = known.select("host", F.col("ip").alias("_known_ip"))
    both = hosts.join(by_ip, "ip", "left").join(by_name, "host", "left")
    status = (
        F.when(F.col("host").isNull() | (F.col("host") == ""), "no_name")
        .when(F.col("ip").isNull(), "no_address")
        .when(~F.col("port").between(1, 65535), "bad_port")
        .when(F.col("_known_ip").isNotNull() & (F.col("_known_ip") != F.col("ip")), "address_changed")
        .when(F.col("_known_ip").isNotNull(), "already_known")
        .when(F.col("_holder").isNotNull(), "address_in_use")
        .otherwise("ok")
    )
    return both.select(*hosts.columns, status.alias("status"))


def record_counts(entries: DataFrame, stored: DataFrame, site: str = "site_id") -> DataFrame:
    """(site, n, stored, agrees): a site's records here and in the stored table, each counted before they meet."""
    n, m = entries.groupBy(site).agg(F.count("*").alias("n")), stored.groupBy(site).agg(F.count("*").alias("stored"))
    both = n.join(m, site, "left").withColumn("stored", F.coalesce("stored", F.lit(0)))
    return both.withColumn("agrees", F.col("n") == F.col("stored"))
