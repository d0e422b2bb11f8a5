"""SQL of page texts: entities, links and what they lead to."""

from __future__ import annotations

from shelfmark.functions import scalars as sc
from shelfmark.operators import web


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_KNOWN = "MAP {" + ", ".join(f"{quoted(name)}: {quoted(ch)}" for name, ch in sc.ENTITIES.items()) + "}"
_NUMBER = "CASE WHEN regexp_matches(x, '^&#[xX]') THEN TRY_CAST('0x' || regexp_extract(x, '([0-9a-fA-F]+);', 1) AS BIGINT) ELSE TRY_CAST(regexp_extract(x, '([0-9]+);', 1) AS BIGINT) END"
_REFERENCE = f"CASE WHEN {_NUMBER} BETWEEN 1 AND 1114111 AND NOT {_NUMBER} BETWEEN 55296 AND 57343 THEN chr(({_NUMBER})::INTEGER) ELSE x END"


def decoded(sql: str) -> str:
    """A text with its entities as characters."""
    piece = f"CASE WHEN starts_with(x, '&#') THEN {_REFERENCE} WHEN starts_with(x, '&') THEN coalesce(map_extract({_KNOWN}, x)[1], x) ELSE x END"
    return f"array_to_string([{piece} for x in regexp_extract_all({sql}, {quoted(sc.ENTITY_PIECES)})], '')"


HOST = "lower(regexp_extract({}, '^[A-Za-z][A-Za-z0-9+.-]*://([^/:?#]*)', 1))"

#: (page_id, url, href), a row for each link.
LINKS = f"SELECT page_id, url, regexp_replace(raw, {quoted(web.QUOTES)}, '', 'g') AS href FROM (SELECT page_id, url, unnest(regexp_extract_all(html, {quoted(web.HREF)}, 1)) AS raw FROM pages)"

#: (page_id, href, target) of pages without base elements and links without dot segments.
TARGETS = f"""SELECT page_id, href, CASE WHEN regexp_matches(h, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN h WHEN starts_with(h, '//') THEN regexp_extract(url, '^[^:]*:') || h
WHEN starts_with(h, '/') THEN regexp_extract(url, '^([A-Za-z]+://[^/?#]*)', 1) || h ELSE regexp_extract(url, '^([A-Za-z]+://[^/?#]*/?[^?#]*/)', 1) || h END AS target
FROM (SELECT page_id, url, href, regexp_replace(trim({decoded("href")}), '#.*$', '') AS h FROM ({LINKS}))"""
