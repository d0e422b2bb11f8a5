"""Configuration text: catalogs, pseudo-domains, domain order, template schemas, record headers."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def logical_lines(text: str) -> list[str]:
    """Lines without comments and blanks; a backslash at the end goes on with the next line."""
    out, held = [], ""
    for line in text.split("\n"):
        line = line.split("#")[0].rstrip()
        if line.endswith("\\"):
            held += line[:-1] + " "
            continue
        if (held + line).strip():
            out.append((held + line).strip())
        held = ""
    return out + ([held.strip()] if held.strip() else [])


@dataclass(frozen=True)
class Catalog:
    name: str
    kind: str
    access: str = ""
    folder: str = ""
    disabled: frozenset = field(default_factory=frozenset)

    def check(self, letter: str) -> None:
        """Raise if the catalog does not offer a type of search."""
        if letter in self.disabled:
            raise PermissionError(f"catalog {self.name} does not offer searches of type {letter}")


KINDS = ("files", "web", "gopher", "template", "freetext")


def catalogs(text: str) -> dict[str, Catalog]:
    """name kind access folder [letters of disabled searches], a line each."""
    out = {}
    for line in logical_lines(text):
        name, kind, access, folder, *disabled = line.split()
        if kind not in KINDS or name in out:
            raise ValueError(f"catalog {name}: unknown kind or repeated name")
        out[name] = Catalog(name, kind, access, folder, frozenset("".join(disabled)))
    return out


def domain_table(spark: SparkSession, text: str) -> DataFrame:
    """(name, definition, description) of name:list:description lines; a repeated name or a loop fails the whole load."""
    rows = []
    for line in logical_lines(text):
        name, rest = line.split(None, 1)
        items, _, described = rest.partition(" ")
        rows.append((name.lower(), items.lower(), described.strip()))
    held = {n: d.split(":") for n, d, _ in rows}
    if len(held) < len(rows):
        raise ValueError("a pseudo-domain is defined twice")

    def walk(name: str, above: tuple) -> None:
        if name in above:
            raise ValueError(f"pseudo-domain {name} refers to itself")
        for item in held.get(name, []):
            walk(item, (*above, name))

    for name in held:
        walk(name, ())
    return spark.createDataFrame(rows, "name string, definition string, description string")


def domain_order(spark: SparkSession, text: str) -> DataFrame:
    """(domain, tier) of an order file: a domain's line less the line of *, so that domains behind it come last."""
    lines = logical_lines(text)
    middle = lines.index("*") if "*" in lines else len(lines)
    return spark.createDataFrame([(d.lower(), i - middle) for i, d in enumerate(lines) if d != "*"], "domain string, tier int")


def with_tier(sites: DataFrame, order: DataFrame, host: str = "hostname") -> DataFrame:
    """sites with the least tier of the domains that they end in, 0 for none.  A host is unfolded into its suffixes, so
    the match is an equality and no pair of host and domain is tried in vain."""
    parts = F.split(F.lower(host), r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    found = sites.select("site_id", F.explode(suffixes).alias("domain")).join(order, "domain").groupBy("site_id").agg(F.min("tier").alias("tier"))
    return sites.join(found, "site_id", "left").withColumn("tier", F.coalesce("tier", F.lit(0)))


def template_schema(text: str) -> T.StructType:
    """A schema of attribute lines: name, then indexed or plain, then a label."""
    out = T.StructType()
    for line in logical_lines(text):
        name, index, *label = line.split()
        out.add(name, T.StringType(), True, {"indexed": index == "indexed", "label": " ".join(label)})
    return out


#: Fields of a record header and their types.
HEADER = {"primary_hostname": "string", "catalog": "string", "source_hostname": "string", "port": "int", "ip": "string", "retrieve_time": "timestamp", "parse_time": "timestamp", "no_recs": "long", "status": "string"}


def read_headers(texts: DataFrame, column: str = "text") -> DataFrame:
    """texts with header: a struct of the fields between @header_begin and @header_end; absent fields are null."""
    body = F.regexp_extract(column, r"(?s)@header_begin\s*\n(.*?)@header_end", 1)
    pairs = F.transform(F.filter(F.split(body, "\n"), lambda x: x.rlike(r"^\w+\s+\S")), lambda x: F.struct(F.regexp_extract(x, r"^(\w+)", 1).alias("k"), F.trim(F.regexp_replace(x, r"^\w+\s+", "")).alias("v")))
    fields = F.map_from_entries(pairs)
    typed = lambda k, t: F.try_to_timestamp(F.try_element_at(fields, F.lit(k)), F.lit("yyyyMMddHHmmss")) if t == "timestamp" else F.try_element_at(fields, F.lit(k)).cast(t)
    return texts.withColumn("header", F.struct(*(typed(k, t).alias(k) for k, t in HEADER.items())))


def write_headers(headers: DataFrame, column: str = "header") -> DataFrame:
    """The text of a header, without its null fields."""
    value = lambda k, t: F.date_format(F.col(f"{column}.{k}"), "yyyyMMddHHmmss") if t == "timestamp" else F.col(f"{column}.{k}").cast("string")
    lines = [F.concat(F.lit(k + " "), value(k, t), F.lit("\n")) for k, t in HEADER.items()]
    return headers.withColumn("text", F.concat(F.lit("@header_begin\n"), F.concat_ws("", *lines), F.lit("@header_end\n")))
