"""Scalar functions of the catalog engine, as Column expressions (kept inside code generation)."""

from __future__ import annotations

from html.entities import name2codepoint

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Latin-1 letters and what accent-insensitive matching takes them for (fixed values of this library).
ACCENTED = "ÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖØÙÚÛÜÝàáâãäåçèéêëìíîïñòóôõöøùúûüýÿ"
UNACCENTED = "AAAAAACEEEEIIIINOOOOOOUUUUYaaaaaaceeeeiiiinoooooouuuuyy"

#: Case and accent modes: i for insensitive, s for sensitive.
MODES = ("ciai", "cias", "csai", "csas")


def fold(c: Column, mode: str) -> Column:
    """c as a mode compares it."""
    if mode not in MODES:
        raise ValueError(f"mode is one of {MODES}")
    c = F.translate(c, ACCENTED, UNACCENTED) if mode.endswith("ai") else c
    return F.lower(c) if mode.startswith("ci") else c


def fold_text(s: str, mode: str) -> str:
    """The same for a key that the driver holds."""
    s = s.translate(str.maketrans(ACCENTED, UNACCENTED)) if mode.endswith("ai") else s
    return s.lower() if mode.startswith("ci") else s


def ends_with_reversed(c: Column, suffix: Column) -> Column:
    """Suffix comparison from right to left."""
    return F.startswith(F.reverse(c), F.reverse(suffix))


def insert_char(c: Column, at: int, ch: str) -> Column:
    """ch put before the at-th character (from 1)."""
    return F.overlay(c, F.lit(ch), F.lit(at), F.lit(0))


def delete_char(c: Column, at: int) -> Column:
    return F.overlay(c, F.lit(""), F.lit(at), F.lit(1))


def unplus(c: Column) -> Column:
    """Form decoding: plus signs to spaces, then percent escapes."""
    return F.url_decode(c)


def escape_quotes(c: Column) -> Column:
    """A string in double quotes, with quotes and backslashes escaped."""
    return F.concat(F.lit('"'), F.regexp_replace(c, r'(["\\])', r"\\$1"), F.lit('"'))


def unescape_quotes(c: Column) -> Column:
    inner = F.regexp_replace(F.regexp_replace(c, r'^"', ""), r'"$', "")
    return F.when(c.rlike(r'^".*"$'), F.regexp_replace(inner, r"\\(.)", "$1")).otherwise(c)


def url_host(url: Column) -> Column:
    """The host in lower case, without user and port."""
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]*)", 1))


def url_port(url: Column) -> Column:
    """The port given, else the scheme's."""
    given = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?[^/:?#]*:([0-9]+)", 1)
    default = F.when(F.lower(url).startswith("https:"), 443).when(F.lower(url).startswith("http:"), 80).when(F.lower(url).startswith("ftp:"), 21).when(F.lower(url).startswith("gopher:"), 70)
    return F.when(given != "", given.cast("int")).otherwise(default)


def url_path(url: Column) -> Column:
    """The path without query and fragment; a slash if there is none."""
    path = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)", 1)
    return F.when(path == "", "/").otherwise(path)


def canonical_url(url: Column) -> Column:
    """Scheme and host in lower case, no default port, no fragment, slash as the least path."""
    scheme = F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1))
    port = url_port(url)
    default = ((scheme == "http") & (port == 80)) | ((scheme == "https") & (port == 443)) | ((scheme == "ftp") & (port == 21)) | ((scheme == "gopher") & (port == 70))
    query = F.regexp_extract(url, r"^[^?#]*(\?[^#]*)", 1)
    return F.concat(scheme, F.lit("://"), url_host(url), F.when(default | port.isNull(), "").otherwise(F.concat(F.lit(":"), port.cast("string"))), url_path(url), query)


def clean_path(path: Column) -> Column:
    """Runs of slashes collapse and the fragment goes."""
    return F.regexp_replace(F.regexp_replace(path, "#.*$", ""), "/{2,}", "/")


def resolve_path(path: Column) -> Column:
    """Dot segments resolved, from left to right over the path's parts."""
    parts = F.split(clean_path(path), "/")
    kept = F.aggregate(
        F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))),
        F.array().cast("array<string>"),
        lambda a, p: F.when(p == ".", a).when(p == "..", F.slice(a, F.lit(1), F.greatest(F.size(a) - 1, F.lit(0)))).otherwise(F.concat(a, F.array(p))),
    )
    tail = F.when(path.rlike(r"/\.{1,2}$"), F.lit("/")).otherwise(F.lit(""))
    out = F.concat(F.lit("/"), F.array_join(kept, "/"), tail)
    return F.regexp_replace(out, "/{2,}", "/")


def join_url(base: Column, link: Column) -> Column:
    """A link seen from a base URL, without its fragment: absolute, of the same scheme, host-relative, relative to the
    base's folder, a query alone, or the base itself."""
    link = F.regexp_replace(link, "(?s)#.*$", "")
    root = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    folder = F.regexp_replace(url_path(base), "[^/]*$", "")
    bare = F.regexp_replace(link, r"(?s)\?.*$", "")
    query = F.regexp_extract(F.when(link == "", base).otherwise(link), r"^[^?#]*(\?[^#]*)", 1)
    path = F.when(bare.startswith("/"), bare).when(bare == "", url_path(base)).otherwise(F.concat(folder, bare))
    told = F.when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), link).when(link.startswith("//"), F.concat(F.regexp_extract(base, "^[^:]*:", 0), link))
    return told.otherwise(F.concat(root, resolve_path(path), query))


#: Named entities of HTML text and their characters: those of HTML 4, the apostrophe's; a hard space counts as a space.
ENTITIES = {f"&{name};": chr(code) for name, code in name2codepoint.items()} | {"&apos;": "'", "&nbsp;": " "}

#: A text in pieces: references, the text between them, ampersands of no reference.
ENTITY_PIECES = r"&#[0-9]{1,7};|&#[xX][0-9a-fA-F]{1,6};|&[A-Za-z][A-Za-z0-9]{0,31};|[^&]+|&"


def code_point(n: Column) -> Column:
    """The character of a Unicode number; null for those of no character."""
    valid = n.between(1, 0x10FFFF) & ~n.between(0xD800, 0xDFFF)
    return F.when(valid, F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32"))


def decode_entities(c: Column) -> Column:
    """Named, decimal and hexadecimal entities to characters, each once; unknown ones stay as written."""
    known = F.create_map(*(F.lit(x) for pair in ENTITIES.items() for x in pair))

    def told(piece: Column) -> Column:
        number = F.when(piece.rlike("^&#[xX]"), F.conv(F.regexp_extract(piece, "([0-9a-fA-F]+);", 1), 16, 10)).otherwise(F.regexp_extract(piece, "([0-9]+);", 1))
        return F.when(piece.startswith("&#"), F.coalesce(code_point(number.try_cast("long")), piece)).when(piece.startswith("&"), F.coalesce(F.try_element_at(known, piece), piece)).otherwise(piece)

    return F.array_join(F.transform(F.regexp_extract_all(c, F.lit(ENTITY_PIECES), F.lit(0)), told), "")


def perms_text(perms: Column, is_dir: Column | None = None) -> Column:
    """Nine permission bits as rwxr-xr-x, with d or - before them if is_dir is given."""
    marks = [F.when(perms.bitwiseAND(1 << (8 - i)) != 0, "rwx"[i % 3]).otherwise("-") for i in range(9)]
    head = [] if is_dir is None else [F.when(is_dir, "d").otherwise("-")]
    return F.concat(*head, *marks)


def perms_bits(text: Column) -> Column:
    """The last nine characters of a Unix permission field; any of r w x t s l S T sets its bit."""
    nine = F.substr(text, F.length(text) - 8, F.lit(9))
    return F.conv(F.translate(nine, "rwxtslST-", "111111110"), 2, 10).cast("int")


def vms_perms_bits(text: Column) -> Column:
    """(RWED,RWED,RE,) as four nibbles: system, owner, group, world."""
    classes = F.coalesce(F.split(F.upper(F.regexp_replace(text, "[()\\s]", "")), ","), F.array().cast("array<string>"))
    four = F.slice(F.concat(classes, F.array_repeat(F.lit(""), 4)), 1, 4)
    nibble = lambda c: sum(F.when(c.contains(x), 1 << (3 - k)).otherwise(0) for k, x in enumerate("RWED"))
    return sum(nibble(F.get(four, F.lit(i))) * 16 ** (3 - i) for i in range(4))


def novell_perms_bits(text: Column, is_dir: Column) -> Column:
    """[RWCEMFA]: R reads, W writes, C does both, F lets a directory be entered; for all three classes alike."""
    has = lambda ch: F.upper(text).contains(ch)
    one = F.when(has("R") | has("C"), 4).otherwise(0) + F.when(has("W") | has("C"), 2).otherwise(0) + F.when(has("F") & is_dir, 1).otherwise(0)
    return one * 64 + one * 8 + one


def listing_date(month: Column, day: Column, time_or_year: Column, as_of: Column) -> Column:
    """Month name, day, and a year or HH:MM; with HH:MM the year is as_of's, or the one before for a later month."""
    number = F.ceil(F.position(F.lower(F.substr(month, F.lit(1), F.lit(3))), F.lit("janfebmaraprmayjunjulaugsepoctnovdec")) / 3).cast("int")
    clock = time_or_year.contains(":")
    year = F.when(clock, F.year(as_of) - F.when(number > F.month(as_of), 1).otherwise(0)).otherwise(time_or_year.try_cast("int"))
    hour, minute = (F.when(clock, F.split_part(time_or_year, F.lit(":"), F.lit(i)).try_cast("int")).otherwise(0) for i in (1, 2))
    return F.try_make_timestamp(year, number, day.try_cast("int"), hour, minute, F.lit(0))


def compact_time(ts: Column) -> Column:
    return F.date_format(ts, "yyyyMMddHHmmss")


def vms_time(ts: Column) -> Column:
    """Day, month's name, year and time, as VMS listings show them."""
    return F.date_format(ts, "dd-MMM-yyyy HH:mm")


def parse_compact(text: Column) -> Column:
    return F.try_to_timestamp(text, F.lit("yyyyMMddHHmmss"))


def http_date(text: Column) -> Column:
    """RFC 1123, RFC 850 and asctime dates."""
    bare = F.regexp_replace(text, r"^[A-Za-z]+,?\s+", "")
    forms = ["d MMM yyyy HH:mm:ss 'GMT'", "d-MMM-yy HH:mm:ss 'GMT'", "MMM d HH:mm:ss yyyy"]
    return F.coalesce(*(F.try_to_timestamp(F.regexp_replace(bare, r"\s+", " "), F.lit(p)) for p in forms))


def dotted(ip: Column) -> Column:
    return F.concat_ws(".", *(F.shiftright(ip, 8 * k).bitwiseAND(255).cast("string") for k in (3, 2, 1, 0)))


def ip_number(text: Column) -> Column:
    return sum(F.split_part(text, F.lit("."), F.lit(k + 1)).cast("long") * (1 << (8 * (3 - k))) for k in range(4))


def access_port(command: Column, default: int) -> Column:
    """The third colon field of an access command, else the catalog's port."""
    field = F.split_part(command, F.lit(":"), F.lit(3))
    return F.coalesce(F.when(field != "", field).try_cast("int"), F.lit(default))


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def dirname(path: Column) -> Column:
    return F.regexp_replace(path, "/[^/]*$", "")


def same_items(a: Column, b: Column) -> Column:
    """Arrays equal but for order."""
    return F.array_sort(a) == F.array_sort(b)


def substitute(c: Column, values: dict[str, str]) -> Column:
    """$name variables replaced by their values, longest name first."""
    for name in sorted(values, key=len, reverse=True):
        c = F.replace(c, F.lit("$" + name), F.lit(values[name]))
    return c


def tokens(c: Column) -> Column:
    """Words, and double-quoted phrases as one word without their quotes."""
    return F.transform(F.regexp_extract_all(c, F.lit(r'"[^"]*"|[^\s"]+'), F.lit(0)), lambda t: F.regexp_replace(t, '"', ""))


def named(c: Column, names: dict[str, str], other: str = "unknown") -> Column:
    """A code's name."""
    out = F.lit(other)
    for code, name in names.items():
        out = F.when(c == code, name).otherwise(out)
    return out


def in_rectangle(x: Column, y: Column, box: tuple) -> Column:
    """Within (left, top, right, bottom), borders included."""
    return x.between(box[0], box[2]) & y.between(box[1], box[3])


def in_circle(x: Column, y: Column, centre: tuple, radius: float) -> Column:
    dx, dy = x - centre[0], y - centre[1]
    return dx * dx + dy * dy <= radius * radius


def in_polygon(x: Column, y: Column, corners: list[tuple[float, float]]) -> Column:
    """Whether a ray from the point crosses an odd number of sides."""
    odd = F.lit(False)
    for (ax, ay), (bx, by) in zip(corners, [*corners[1:], corners[0]]):
        if ay == by:
            continue
        crosses = (F.lit(ay) > y) != (F.lit(by) > y)
        odd = odd != (crosses & (x < (bx - ax) * (y - ay) / (by - ay) + ax))
    return odd
