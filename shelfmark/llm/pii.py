"""Format-preserving pseudonyms for personal data, in DataFrame functions only.

Values that pass their format's own test (check digits, calendar, octet ranges, number plan) are replaced by a keyed
permutation of the format: a Feistel network over the value's positions, each position with its own radix, so that a
card number becomes another number with valid check digit, a date another date written alike, an address another
address.  The permutation depends on the key and the format alone, so equal values get equal pseudonyms in all
documents, and no two values of a format get the same one: where a format is a part of what its positions can hold
(dates with one-digit days, numbers outside a number plan), the permutation is applied until it is back in that part.
Values that fail their test stay as they are.  A permutation may leave a value where it is, mostly a short one; it
counts as replaced.

There is no key by default: who knows the key can undo the pseudonyms.  The registered query and the pipeline take it
from the session's setting KEY_SETTING; where that is unset they draw a random one for the application.

Formats: payment card numbers (Luhn), IBANs (mod 97), dates in digits (1890-01-01 to 2100-04-09; a month-first date is
one that is none day-first), US social security numbers, telephone numbers (a number of the North American plan becomes
another of that plan; of others country code, length and a first digit that is not zero are kept), IPv4 addresses, the local part of e-mail addresses, and values of any length assigned to password,
token, secret or key names, also where these end a longer name (db_password).  One table gives patterns and one gives permutations; nothing is collected, joined or shuffled.

Rows: a null text stays null; repeated rows get equal pseudonyms; texts of any length are searched whole; other
columns are kept (text, n_pseudonyms and pii_kinds are the operator's own names); an empty table gives an empty table.

A value is looked for at every place where its format can start, also inside a candidate that fails its test.  Of valid
values that overlap the leftmost counts, and at one place the first format in the order of PATTERNS.  Telephone
numbers, which have no check digits, are looked for last, in what the other formats leave.
"""

from __future__ import annotations

import secrets

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import table

ROUNDS, WALK = 8, 200
KEY_SETTING = "spark.shelfmark.pseudonym.key"
FIRST_DAY, DAY_HIGH, DAY_LOW = "1890-01-01", 300, 256

#: Lengths of account numbers by country, as the public IBAN registry has them (fixed values).
IBAN_LENGTHS = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BR": 29, "BY": 28, "CH": 21, "CR": 22, "CY": 28, "CZ": 24, "DE": 22,
    "DK": 18, "DO": 28, "EE": 20, "EG": 29, "ES": 24, "FI": 18, "FO": 18, "FR": 27, "GB": 22, "GE": 22, "GI": 23, "GL": 18, "GR": 27, "GT": 28, "HR": 21, "HU": 28,
    "IE": 22, "IL": 23, "IQ": 23, "IS": 26, "IT": 27, "JO": 30, "KW": 30, "KZ": 20, "LB": 28, "LC": 32, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "MC": 27, "MD": 24,
    "ME": 22, "MK": 19, "MR": 27, "MT": 31, "MU": 30, "NL": 18, "NO": 15, "PK": 24, "PL": 28, "PS": 29, "PT": 25, "QA": 29, "RO": 24, "RS": 22, "SA": 24, "SC": 31,
    "SE": 24, "SI": 19, "SK": 24, "SM": 27, "ST": 25, "SV": 28, "TL": 23, "TN": 24, "TR": 26, "UA": 29, "VA": 22, "VG": 24, "XK": 20,
}
_BY_LENGTH = {n: "|".join(c for c, m in IBAN_LENGTHS.items() if m == n) for n in sorted(set(IBAN_LENGTHS.values()))}
#: What a telephone number's next group may not be the start of: an address or a date behind the number.
_NO_PHONE = r"(?!(?:[0-9]{1,3}\.){3}[0-9]|[0-9]{4}[-/][0-9]{2}[-/][0-9]|[0-9]{1,2}[./][0-9]{1,2}[./][0-9]{4}|[0-9]{3}-[0-9]{2}-[0-9]{4})"
#: A telephone number has at most 15 digits, country code included (E.164).
_PHONE_DIGITS = r"(?<=\+" + r"[ .()-]{0,2}[0-9]" * 8 + r"(?:[ .()-]{0,2}[0-9])?" * 7 + ")"
#: Country codes as E.164 assigns them: no code is the start of another (fixed values).
_COUNTRY = r"1|7|2(?:[07]|[1-689][0-9])|3(?:[0-469]|[578][0-9])|4(?:[013-9]|2[0-9])|5(?:[1-8]|[09][0-9])|6(?:[0-6]|[7-9][0-9])|8(?:[1246]|[035789][0-9])|9(?:[0-58]|[679][0-9])"
_NAMES = r"(?:password|passwd|pwd|passphrase|token|secret|api[_-]?key|access[_-]?key)"
#: Local parts have any length; a host name has at most 127 labels of at most 63 characters (RFC 1035).
_EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){0,125}\.[A-Za-z]{2,63}"
#: Formats and their patterns, in order of preference.
PATTERNS = {
    "email": _EMAIL,
    "secret": rf"(?i:(?<![A-Za-z0-9]){_NAMES}[\"']?\s{{0,3}}[=:]\s{{0,3}}[\"']?)(?!{_EMAIL})(?=[_+/.~-]*[A-Za-z0-9])[A-Za-z0-9_+/.~-]++",
    "iban": r"(?<![A-Za-z0-9])(?:" + "|".join(f"(?:{c})[0-9]{{2}}(?: ?[A-Z0-9]){{{n - 4}}}" for n, c in _BY_LENGTH.items()) + ")(?![A-Za-z0-9])",
    "date": r"(?<![0-9./-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{4}/[0-9]{2}/[0-9]{2}|[0-9]{1,2}\.[0-9]{1,2}\.[0-9]{4}|[0-9]{1,2}/[0-9]{1,2}/[0-9]{4})(?![0-9]|[./-][0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9]|-[0-9])",
    "phone": r"(?<![0-9+])\+1[ .-]?(?:\([0-9]{3}\)|[0-9]{3})[ .-]?[0-9]{3}[ .-]?[0-9]{4}(?![0-9])|(?<![0-9+])\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)|[0-9]{1,4})(?:[ .-]?" + _NO_PHONE + r"[0-9]{2,4}){2,4}(?![0-9])" + _PHONE_DIGITS + r"|(?<![0-9(])\([0-9]{3}\) ?[0-9]{3}-[0-9]{4}(?![0-9])|(?<![0-9-])[0-9]{3}-[0-9]{3}-[0-9]{4}(?![0-9]|-[0-9])",
    "ipv4": r"(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9]|\.[0-9])",
    "card": r"(?<![0-9])(?!(?<=(?<![0-9+])\+)[0-9]{13,15}(?![0-9]))(?:[0-9]{13,19}|[0-9]{4}(?<a>[ -])[0-9]{4}\k<a>[0-9]{4}\k<a>[0-9]{1,7}|[0-9]{4}(?<b>[ -])[0-9]{6}\k<b>[0-9]{4,5})(?![0-9])",
}
#: All formats but telephone numbers.  At one place no two that can fail their tests match, so one candidate a place is enough.
TESTED = "|".join(f"(?:{p})" for k, p in PATTERNS.items() if k != "phone")
#: Stands for a value already found; texts may hold it too.
_FOUND = "\ue000"


_drawn_keys: dict[str, str] = {}


def session_key(spark: SparkSession) -> str:
    """The key set for the session, else a random one that lives as long as the application."""
    return spark.conf.get(KEY_SETTING, None) or _drawn_keys.setdefault(spark.sparkContext.applicationId, secrets.token_hex(32))


def _let(value: Column, body) -> Column:
    """body(value), with value computed once."""
    return F.transform(F.array(value), body)[0]


def _chars(s: Column) -> Column:
    return F.split(s, "")


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def _ints(s: Column) -> Column:
    return F.transform(_chars(s), lambda c: c.cast("long"))


def permuted(values: Column, radix: Column, key: str, kind: str) -> Column:
    """The keyed permutation of an array of longs, each below its radix.

    A Feistel network: each round adds to one half of the positions, modulo their radices, numbers drawn by a keyed
    hash from the other half."""

    def one_round(v: Column, r: Column, n: Column, rounds: Column) -> Column:
        half = F.floor(n / 2).cast("int")
        left = rounds % 2 == 0
        other = F.when(left, F.slice(v, half + 1, n - half)).otherwise(F.slice(v, F.lit(1), half))
        seed = F.concat_ws("|", F.lit(key), F.lit(kind), n.cast("string"), rounds.cast("string"), F.array_join(F.transform(other, lambda x: x.cast("string")), ","))
        low, size = F.when(left, F.lit(0)).otherwise(half), F.when(left, half).otherwise(n - half)
        # 24 bits a position, 21 positions a hash
        blocks = F.transform(F.sequence(F.lit(0), F.floor(size / 21).cast("int")), lambda b: F.sha2(F.concat_ws("|", seed, b.cast("string")), 512))
        return _let(blocks, lambda h: F.transform(v, lambda x, i: F.when((i >= low) & (i < low + size), (x + F.conv(F.substr(F.get(h, F.floor((i - low) / 21).cast("int")), (i - low) % 21 * 6 + 1, F.lit(6)), 16, 10).cast("long")) % F.get(r, i)).otherwise(x)))

    return _let(radix, lambda r: F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), values, lambda v, k: one_round(v, r, F.size(r), k)))


def _walked(value: Column, step, ok) -> Column:
    """step(value), and step again until ok holds: a permutation of what is ok, if step is one of all values.

    WALK steps at most; with a fifth of all values ok, as in the narrowest format here, one value in 10**19 needs more."""
    start = F.struct(value.alias("v"), F.lit(False).alias("done"))
    again = lambda a: _let(step(a["v"]), lambda x: F.struct(x.alias("v"), ok(x).alias("done")))
    return F.aggregate(F.sequence(F.lit(1), F.lit(WALK)), start, lambda a, _: F.when(a["done"], a).otherwise(again(a)), lambda a: a["v"])


def _fill(template: Column, digits: Column) -> Column:
    """template with its digits replaced, in order, by those of the string digits."""
    put = F.transform(F.sequence(F.lit(1), F.length(template)), lambda i: F.when(F.substr(template, i, F.lit(1)).rlike("[0-9]"), F.substr(digits, F.length(_digits(F.substr(template, F.lit(1), i))), F.lit(1))).otherwise(F.substr(template, i, F.lit(1))))
    return F.array_join(put, "")


def _permuted_digits(digits: Column, key: str, kind: str) -> Column:
    moved = permuted(_ints(digits), F.transform(_chars(digits), lambda _: F.lit(10).cast("long")), key, kind)
    return F.array_join(F.transform(moved, lambda x: x.cast("string")), "")


def luhn_sum(digits: Column) -> Column:
    """Luhn sum of a digit string, its last digit being the check digit."""
    doubled = F.transform(F.reverse(_ints(digits)), lambda d, i: F.when(i % 2 == 1, F.when(d > 4, 2 * d - 9).otherwise(2 * d)).otherwise(d))
    return F.aggregate(doubled, F.lit(0).cast("long"), lambda a, d: a + d)


def _card(m: Column, key: str) -> Column:
    """First digit kept, the check digit made anew, the rest permuted."""
    d = _digits(m)
    n = F.length(d)
    payload = F.concat(F.substr(d, F.lit(1), F.lit(1)), _permuted_digits(F.substr(d, F.lit(2), n - 2), key, "card"))
    new = _let(payload, lambda p: F.concat(p, F.pmod(-luhn_sum(F.concat(p, F.lit("0"))), F.lit(10)).cast("string")))
    return F.when((luhn_sum(d) % 10 == 0) & (d.rlike("[1-9]")), _fill(m, new))


def _mod97(s: Column) -> Column:
    """ISO 7064 remainder of an IBAN without spaces."""
    turned = F.concat(F.substr(s, F.lit(5), F.length(s)), F.substr(s, F.lit(1), F.lit(4)))
    number = F.transform(_chars(turned), lambda c: F.when(c.rlike("[0-9]"), c.cast("long")).otherwise((F.ascii(c) - 55).cast("long")))
    return F.aggregate(number, F.lit(0).cast("long"), lambda a, x: F.when(x < 10, a * 10 + x).otherwise(a * 100 + x) % 97)


def _iban(m: Column, key: str) -> Column:
    """Country and letters kept, the digits behind them permuted, the check digits made anew."""
    s = F.replace(m, F.lit(" "), F.lit(""))
    body = F.substr(s, F.lit(5), F.length(s))
    moved = _fill(body, _permuted_digits(_digits(body), key, "iban"))
    country = F.substr(s, F.lit(1), F.lit(2))
    new = _let(moved, lambda b: F.concat(country, F.lpad((98 - _mod97(F.concat(country, F.lit("00"), b))).cast("string"), 2, "0"), b))
    return F.when((_mod97(s) == 1) & body.rlike("[0-9]{2}"), _let(new, lambda b: _fill(m, _digits(b))))


def _day_number(n: Column, key: str) -> Column:
    """The permuted number of a day's number from FIRST_DAY on."""
    radix = F.array(F.lit(DAY_HIGH).cast("long"), F.lit(DAY_LOW).cast("long"))
    return _let(permuted(F.array(F.floor(n / DAY_LOW).cast("long"), n % DAY_LOW), radix, key, "date"), lambda v: v[0] * DAY_LOW + v[1])


def _day_at(n: Column) -> Column:
    return F.date_add(F.lit(FIRST_DAY).cast("date"), n.cast("int"))


def _days(day: Column, key: str) -> Column:
    """The permuted date of a date in range."""
    return _let(_day_number(F.datediff(day, F.lit(FIRST_DAY).cast("date")).cast("long"), key), _day_at)


def _date(m: Column, key: str) -> Column:
    """Year first; or day, month, year (with slashes and no such day, month, day, year).  Fields of one digit become
    fields of one digit, so that the length stays."""
    part = lambda p, i: F.regexp_extract(m, p, i)
    big, small = r"^([0-9]{4})[-/]([0-9]{2})[-/]([0-9]{2})$", r"^([0-9]{1,2})[./]([0-9]{1,2})[./]([0-9]{4})$"
    day_of = lambda y, mo, d: F.try_to_timestamp(F.concat_ws("-", y, F.lpad(mo, 2, "0"), F.lpad(d, 2, "0")), F.lit("yyyy-MM-dd")).cast("date")
    year_first = m.rlike(big)
    european = day_of(part(small, 3), part(small, 2), part(small, 1))
    american = F.when(m.contains("/"), day_of(part(small, 3), part(small, 1), part(small, 2)))
    turned = ~year_first & european.isNull()
    day = F.when(year_first, day_of(part(big, 1), part(big, 2), part(big, 3))).otherwise(F.coalesce(european, american))
    short = [F.length(part(small, i)) == 1 for i in (1, 2)]
    fields = lambda d: (F.when(turned, F.month(d)).otherwise(F.dayofmonth(d)), F.when(turned, F.dayofmonth(d)).otherwise(F.month(d)))

    def fits(n: Column) -> Column:
        one, two = fields(_day_at(n))
        return year_first | ((~short[0] | (one < 10)) & (~short[1] | (two < 10)) & (~turned | (two > 12)))

    def written(d: Column) -> Column:
        shown = [F.when(s, f.cast("string")).otherwise(F.lpad(f.cast("string"), 2, "0")) for s, f in zip(short, fields(d))]
        mark = F.when(m.contains("."), ".").otherwise("/")
        other = F.concat(shown[0], mark, shown[1], mark, F.date_format(d, "yyyy"))
        return F.when(year_first & m.contains("-"), F.date_format(d, "yyyy-MM-dd")).when(year_first, F.date_format(d, "yyyy/MM/dd")).otherwise(other)

    number = F.datediff(day, F.lit(FIRST_DAY).cast("date")).cast("long")
    moved = lambda n: _let(_walked(n, lambda x: _day_number(x, key), fits), lambda x: written(_day_at(x)))
    return _let(number, lambda n: F.when(n.between(0, DAY_HIGH * DAY_LOW - 1), moved(n)))


def _ssn(m: Column, key: str) -> Column:
    """Areas 001 to 899 but 666, groups 01 to 99, serials 0001 to 9999."""
    area, group, serial = (F.substr(m, F.lit(a), F.lit(n)).cast("long") for a, n in ((1, 3), (5, 2), (8, 4)))
    valid = area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0)
    values = F.array(F.when(area > 666, area - 2).otherwise(area - 1), group - 1, serial - 1)
    moved = permuted(values, F.array(*(F.lit(x).cast("long") for x in (898, 99, 9999))), key, "ssn")
    new = _let(moved, lambda v: F.concat_ws("-", F.lpad(F.when(v[0] >= 665, v[0] + 2).otherwise(v[0] + 1).cast("string"), 3, "0"), F.lpad((v[1] + 1).cast("string"), 2, "0"), F.lpad((v[2] + 1).cast("string"), 4, "0")))
    return F.when(valid, new)


#: Area and exchange codes of the North American plan: no 0 or 1 first, no 9 in the middle of an area code, no N11.
_PLAN = r"^[2-9](?!11)[0-8][0-9][2-9](?!11)[0-9][0-9][0-9]{4}$"


def _plan_number(d: Column, key: str) -> Column:
    """Ten digits of the plan as others of the plan: 8 x 89 areas, 8 x 99 exchanges, 10000 lines."""
    code = lambda at, block: _let(F.substr(d, F.lit(at), F.lit(3)).cast("long"), lambda c: (F.floor(c / 100) - 2) * block + c % 100 - F.when(c % 100 > 11, 1).otherwise(0))
    shown = lambda v, block: _let(v % block, lambda i: ((F.floor(v / block) + 2) * 100 + i + F.when(i >= 11, 1).otherwise(0)).cast("string"))
    values = F.array(*(x.cast("long") for x in (code(1, 89), code(4, 99), F.substr(d, F.lit(7), F.lit(4)))))
    moved = permuted(values, F.array(*(F.lit(x).cast("long") for x in (8 * 89, 8 * 99, 10_000))), key, "plan")
    return _let(moved, lambda v: F.concat(shown(v[0], 89), shown(v[1], 99), F.lpad(v[2].cast("string"), 4, "0")))


def _other_number(d: Column, key: str) -> Column:
    """Digits whose first one stays zero, or not zero."""
    first = F.substr(d, F.lit(1), F.lit(1)) != "0"
    least = lambda i: F.when((i == 0) & first, 1).otherwise(0)
    radix = F.transform(_chars(d), lambda _, i: F.when(i > 0, 10).when(first, 9).otherwise(1).cast("long"))
    moved = permuted(F.transform(_ints(d), lambda x, i: x - least(i)), radix, key, "phone")
    return _let(moved, lambda v: F.array_join(F.transform(v, lambda x, i: (x + least(i)).cast("string")), ""))


def _phone(m: Column, key: str) -> Column:
    """Country code kept; subscriber digits (7 to 14) permuted."""
    head = F.regexp_extract(m, rf"^(\+(?:{_COUNTRY}|[0-9]{{1,3}}))", 1)
    rest = F.substr(m, F.length(head) + 1, F.length(m))
    d = _digits(rest)
    american = head.isin("", "+1") & (F.length(d) == 10)
    outside = lambda x: _walked(x, lambda y: _permuted_digits(y, key, "phone"), lambda y: ~y.rlike(_PLAN))
    new = lambda x: F.when(american & x.rlike(_PLAN), _plan_number(x, key)).when(american, outside(x)).otherwise(_other_number(x, key))
    return F.when(F.length(d).between(7, 14), F.concat(head, _fill(rest, _let(d, new))))


def _ipv4(m: Column, key: str) -> Column:
    octets = F.transform(F.split(m, r"\."), lambda x: x.cast("long"))
    moved = permuted(octets, F.transform(octets, lambda _: F.lit(256).cast("long")), key, "ipv4")
    return F.when(F.forall(octets, lambda x: x < 256), F.array_join(F.transform(moved, lambda x: x.cast("string")), "."))


#: A character is permuted among those of its own kind, so that hexadecimal stays that and no other text becomes it.
_KINDS = ("0123456789", "abcdef", "ghijklmnopqrstuvwxyz", "ABCDEF", "GHIJKLMNOPQRSTUVWXYZ")


def _permuted_text(s: Column, key: str, kind: str) -> Column:
    """Digits become digits, and letters letters of their case and kind; other characters stay."""

    def alphabet(c: Column) -> Column:
        out = c
        for letters in _KINDS:
            out = F.when(c.between(letters[0], letters[-1]), F.lit(letters)).otherwise(out)
        return out

    chars = _chars(s)
    values = F.transform(chars, lambda c: (F.position(c, alphabet(c)) - 1).cast("long"))
    radix = F.transform(chars, lambda c: F.length(alphabet(c)).cast("long"))
    return _let(permuted(values, radix, key, kind), lambda v: F.array_join(F.transform(chars, lambda c, i: F.substr(alphabet(c), (F.get(v, i) + 1).cast("int"), F.lit(1))), ""))


def _email(m: Column, key: str) -> Column:
    return F.concat(_permuted_text(F.substring_index(m, "@", 1), key, "email"), F.lit("@"), F.substring_index(m, "@", -1))


def _secret(m: Column, key: str) -> Column:
    value = F.regexp_extract(m, r"[A-Za-z0-9_+/.~-]+$", 0)
    return F.concat(F.substr(m, F.lit(1), F.length(m) - F.length(value)), _permuted_text(value, key, "secret"))


_REPLACE = {"email": _email, "secret": _secret, "iban": _iban, "date": _date, "ssn": _ssn, "phone": _phone, "ipv4": _ipv4, "card": _card}


def pseudonym(match: Column, key: str) -> Column:
    """(kind, new) of one match; new is null if it fails its format's test."""
    out = None
    for kind, pattern in PATTERNS.items():
        is_kind, made = match.rlike(f"^(?:{pattern})$"), F.struct(F.lit(kind).alias("kind"), _REPLACE[kind](match, key).alias("new"))
        out = F.when(is_kind, made) if out is None else out.when(is_kind, made)
    return out.otherwise(F.struct(F.lit(None).cast("string").alias("kind"), F.lit(None).cast("string").alias("new")))


def _covers(made: Column, pieces: Column) -> Column:
    """For each piece how many of its first characters belong to a value that is replaced: below 0 if that value starts
    there, above 0 if it started in a piece before, 0 if there is none.

    One walk from left to right. It appends within blocks of about the root of the number of pieces, so that a text of
    very many candidates is not copied once for each."""
    steps = F.transform(made, lambda m, i: F.struct(m["p"]["new"].isNotNull().alias("ok"), F.length(m["old"]).alias("size"), F.length(F.get(pieces, i + 1)).alias("room")))

    def step(state: Column, x: Column) -> Column:
        taken = (state["left"] == 0) & x["ok"]
        cover = F.when(taken, x["size"]).otherwise(state["left"])
        return F.struct(F.greatest(cover - x["room"], F.lit(0)).alias("left"), F.concat(state["out"], F.array(F.when(taken, -cover).otherwise(cover))).alias("out"))

    def block(state: Column, xs: Column) -> Column:
        walked = F.aggregate(xs, F.struct(state["left"].alias("left"), F.array().cast("array<int>").alias("out")), step)
        return _let(walked, lambda w: F.struct(w["left"].alias("left"), F.concat(state["out"], F.array(w["out"])).alias("out")))

    def walk(xs: Column) -> Column:
        n = F.ceil(F.sqrt(F.size(xs))).cast("int")
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(xs) - 1) / n).cast("int")), lambda b: F.slice(xs, b * n + 1, n))
        start = F.struct(F.lit(0).alias("left"), F.array().cast("array<array<int>>").alias("out"))
        return F.concat(F.array(F.lit(0)), F.flatten(F.aggregate(blocks, start, block, lambda s: s["out"])))

    return F.when(F.size(made) > 0, _let(steps, walk)).otherwise(F.array(F.lit(0)))


def _woven(gaps: Column, values: Column) -> Column:
    """gaps with a value behind each but the last."""
    return F.array_join(F.transform(gaps, lambda g, i: F.concat(g, F.coalesce(F.get(values, i), F.lit("")))), "")


def pseudonymize(df: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """df with its text's personal data replaced, and n_pseudonyms and pii_kinds (sorted, distinct) of what was."""
    if not key:
        raise ValueError("pseudonyms need a secret key")
    text = F.col(text_col)
    # a blank before the text, so that each piece but the first starts with a candidate
    padded = F.when(text.rlike("[0-9@=:]"), F.concat(F.lit(" "), text))
    told = df.withColumn("_made", F.transform(F.regexp_extract_all(padded, F.lit(f"(?=({TESTED}))"), F.lit(1)), lambda m: F.struct(pseudonym(m, key).alias("p"), m.alias("old"))))
    told = told.withColumn("_pieces", F.split(padded, f"(?={TESTED})", -1))
    told = told.withColumn("_covers", _covers(F.col("_made"), F.col("_pieces")))
    # what is replaced becomes a mark; _back has what each mark stands for
    cover = lambda i: F.get(F.col("_covers"), i)
    tail = lambda p, i: F.substr(p, F.abs(cover(i)) + 1, F.length(p))
    marks = lambda s: F.length(s) - F.length(F.replace(s, F.lit(_FOUND), F.lit("")))
    own = lambda i: F.when(cover(i) < 0, F.array(F.get(F.col("_made"), i - 1)["p"])).otherwise(F.array())
    mark = F.struct(F.lit(None).cast("string").alias("kind"), F.lit(_FOUND).alias("new"))
    told = told.withColumns({
        "_text": F.array_join(F.transform("_pieces", lambda p, i: F.concat(F.when(cover(i) < 0, _FOUND).otherwise(""), tail(p, i))), ""),
        "_back": F.flatten(F.transform("_pieces", lambda p, i: F.concat(own(i), F.array_repeat(mark, marks(tail(p, i)))))),
    })
    told = told.withColumn("_phones", F.transform(F.regexp_extract_all("_text", F.lit(PATTERNS["phone"]), F.lit(0)), lambda m: F.struct(m.alias("old"), _phone(m, key).alias("new"))))
    told = told.withColumn("_text", _woven(F.split("_text", PATTERNS["phone"], -1), F.transform("_phones", lambda x: F.coalesce(x["new"], x["old"]))))
    told = told.withColumn("_text", _woven(F.split("_text", _FOUND, -1), F.transform("_back", lambda x: x["new"])))
    phones = F.transform(F.filter("_phones", lambda x: x["new"].isNotNull()), lambda _: F.lit("phone"))
    kinds = F.concat(F.filter(F.transform("_back", lambda x: x["kind"]), lambda k: k.isNotNull()), phones)
    told = told.withColumn("_kinds", F.coalesce(kinds, F.array().cast("array<string>")))
    new = F.when(F.size("_kinds") > 0, F.substr("_text", F.lit(2), F.length("_text"))).otherwise(text)
    told = told.withColumns({text_col: new, "n_pseudonyms": F.size("_kinds"), "pii_kinds": F.array_sort(F.array_distinct("_kinds"))})
    return told.drop("_made", "_pieces", "_covers", "_text", "_back", "_phones", "_kinds")


def op2_pii_feistel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonymize(table(spark, sf_dir, "documents").select("doc_id", "text"), session_key(spark)).select("doc_id", "text", "n_pseudonyms", F.array_join("pii_kinds", ",").alias("pii_kinds"))


QUERIES = {"op2_pii_feistel": op2_pii_feistel}
ORACLES: dict[str, str] = {}
