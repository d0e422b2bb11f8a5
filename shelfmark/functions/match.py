"""String selection: predicates over a column of names, and the rewrites made before a plan is built."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scalars import fold, fold_text

META = set(".^$*+?()[]{}|\\")


def exact(c: Column, key: str, mode: str = "csas") -> Column:
    return _keyed(c, key, mode, lambda x, k: x == k)


def substring(c: Column, key: str, mode: str = "cias") -> Column:
    return _keyed(c, key, mode, lambda x, k: x.contains(k))


def prefix(c: Column, key: str, mode: str = "cias") -> Column:
    return _keyed(c, key, mode, lambda x, k: x.startswith(k))


def regex(c: Column, pattern: str, ignore_case: bool = False) -> Column:
    """Case counts unless ignore_case is set; an empty pattern selects nothing."""
    return c.rlike(("(?i)" if ignore_case else "") + posix_classes(pattern)) if pattern else F.lit(False)


def _keyed(c: Column, key: str, mode: str, test) -> Column:
    """An empty key selects nothing."""
    return test(fold(c, mode), F.lit(fold_text(key, mode))) if key else F.lit(False)


def posix_classes(pattern: str) -> str:
    """POSIX bracket classes in the form that Java's expressions know."""
    return re.sub(r"\[:(alpha|digit|alnum|upper|lower|space|punct|xdigit):\]", lambda m: {"xdigit": r"\p{XDigit}"}.get(m[1], rf"\p{{{m[1].capitalize()}}}"), pattern)


def simplify(pattern: str) -> tuple[str, str]:
    """('regex', pattern) or ('substring', key): a pattern without leading and trailing .*; plain text is a substring."""
    while pattern.startswith(".*"):
        pattern = pattern[2:]
    while pattern.endswith(".*") and not pattern.endswith("\\.*"):
        pattern = pattern[:-2]
    return ("regex", pattern) if META & set(pattern) else ("substring", pattern)


def case_pairs(pattern: str) -> str | None:
    """The key of a pattern made of letter pairs such as [aA], escapes and caseless characters: it is the same as a
    case-insensitive substring.  None for all other patterns, bare letters among them, where case would count."""
    out, at = "", 0
    while at < len(pattern):
        if m := re.match(r"\[(.)(.)\]", pattern[at:]):
            if m[1].lower() != m[2].lower() or m[1] == m[2]:
                return None
            out, at = out + m[1].lower(), at + 4
        elif pattern[at] == "\\" and at + 1 < len(pattern) and not pattern[at + 1].isalnum():
            out, at = out + pattern[at + 1], at + 2
        elif pattern[at] in META or pattern[at].lower() != pattern[at].upper():
            return None
        else:
            out, at = out + pattern[at], at + 1
    return out or None


def glob(pattern: str) -> str:
    """Host patterns: * and ? are wildcards, a pattern in parentheses is a regular expression as it is."""
    if pattern.startswith("(") and pattern.endswith(")"):
        return pattern[1:-1]
    return "^" + "".join({"*": ".*", "?": "."}.get(ch, re.escape(ch)) for ch in pattern) + "$"


#: Search types by letter: the tests in order of preference, and whether only names are wanted.
TYPES = {
    "=": (("exact",), False), "R": (("regex",), False), "r": (("exact", "regex"), False), "X": (("regex",), True), "x": (("exact", "regex"), True),
    "C": (("substring_cs",), False), "c": (("exact", "substring_cs"), False), "K": (("substring_cs",), True), "k": (("exact", "substring_cs"), True),
    "S": (("substring_ci",), False), "s": (("exact", "substring_ci"), False), "Z": (("substring_ci",), True), "z": (("exact", "substring_ci"), True), "n": (("exact",), True),
}


def predicate(c: Column, kind: str, key: str) -> Column:
    if kind == "regex":
        kind, key = simplify(key)
        kind = "substring_cs" if kind == "substring" else kind
    return {"exact": lambda: exact(c, key), "regex": lambda: regex(c, key), "substring_cs": lambda: substring(c, key, "csas"), "substring_ci": lambda: substring(c, key, "cias"), "prefix": lambda: prefix(c, key)}[kind]()


def tiered(strings: DataFrame, kinds: Sequence[str], key: str, column: str = "s") -> DataFrame:
    """Strings of the first kind of test that selects any: exact, else the fallback."""
    tests = [predicate(F.col(column), k, key) for k in kinds]
    tier = F.when(tests[0], 0)
    for k, t in enumerate(tests[1:], 1):
        tier = tier.when(t, k)
    hits = strings.withColumn("tier", tier).where(F.col("tier").isNotNull())
    if len(tests) == 1:
        return hits
    best = hits.agg(F.min("tier").alias("tier"))  # one row
    return hits.join(F.broadcast(best), "tier")


def in_domains(host: Column, domains: Sequence[str]) -> Column:
    """No domain and * accept every host; else the host is a domain or ends in a dot and one."""
    if not domains or "*" in domains:
        return F.lit(True)
    host, out = F.lower(host), F.lit(False)
    for d in domains:
        out = out | (host == d.lower()) | host.endswith("." + d.lower())
    return out


def in_top_domain(host: Column, domains: Sequence[str]) -> Column:
    return F.substring_index(host, ".", -1).isin(list(domains))


def path_accepted(path: Column, include: Sequence[str] = (), exclude: str = "", every: bool = False) -> Column:
    """The excluded text wins; then any (or every) included one; an empty one accepts all."""
    out = F.lit(bool(not include or "" in include)) if not every else F.lit(True)
    for text in include:
        hit = path.contains(text) if text else F.lit(True)
        out = (out & hit) if every else (out | hit)
    return out & ~path.contains(exclude) if exclude else out


def component_accepted(path: Column, texts: Sequence[str]) -> Column:
    """A component of the path holds one of the texts."""
    return F.exists(F.split(path, "/"), lambda x: F.lit(False) if not texts else _any(x, texts))


def _any(x: Column, texts: Sequence[str]) -> Column:
    out = x.contains(texts[0])
    for t in texts[1:]:
        out = out | x.contains(t)
    return out


def valid_keyword(word: Column) -> Column:
    """At most 50 characters, and at most a quarter of them outside ASCII."""
    ascii_only = F.octet_length(word) == F.length(word)  # spares most words the pattern
    return (F.length(word) <= 50) & (ascii_only | (F.regexp_count(word, F.lit(r"[^\x00-\x7F]")) * 4 <= F.length(word)))


def host_suffixes(sites: DataFrame, host: str = "hostname") -> DataFrame:
    """sites with suffix: a row for each whole-label suffix of a host, so that domains are met by equality."""
    parts = F.split(F.lower(host), r"\.")
    every = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    return sites.withColumn("suffix", F.explode(every))
