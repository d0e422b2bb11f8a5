"""Pseudonyms in plain Python: candidates at every place, formats' tests, and the keyed permutations."""

import datetime
import hashlib

import regex

from shelfmark.llm.pii import IBAN_LENGTHS

EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){0,125}\.[A-Za-z]{2,63}"
NAMES = r"(?i:password|passwd|pwd|passphrase|token|secret|api[_-]?key|access[_-]?key)"
IBAN = "|".join(f"{c}[0-9]{{2}}(?: ?[A-Z0-9]){{{n - 4}}}" for c, n in IBAN_LENGTHS.items())
FORMATS = {
    "email": EMAIL,
    "secret": rf"(?<![A-Za-z0-9]){NAMES}[\"']?[ \t\n\v\f\r]{{0,3}}[=:][ \t\n\v\f\r]{{0,3}}[\"']?(?!{EMAIL})(?=[_+/.~-]*[A-Za-z0-9])[A-Za-z0-9_+/.~-]++",
    "iban": rf"(?<![A-Za-z0-9])(?:{IBAN})(?![A-Za-z0-9])",
    "date": r"(?<![0-9./-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{4}/[0-9]{2}/[0-9]{2}|[0-9]{1,2}\.[0-9]{1,2}\.[0-9]{4}|[0-9]{1,2}/[0-9]{1,2}/[0-9]{4})(?![0-9]|[./-][0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9]|-[0-9])",
    "ipv4": r"(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9]|\.[0-9])",
    "card": r"(?<![0-9])(?!(?<=(?<![0-9+])\+)[0-9]{13,15}(?![0-9]))(?:[0-9]{13,19}|[0-9]{4} [0-9]{4} [0-9]{4} [0-9]{1,7}|[0-9]{4}-[0-9]{4}-[0-9]{4}-[0-9]{1,7}|[0-9]{4} [0-9]{6} [0-9]{4,5}|[0-9]{4}-[0-9]{6}-[0-9]{4,5})(?![0-9])",
}
RULES = {k: regex.compile(p, regex.ASCII) for k, p in FORMATS.items()}
OTHER_VALUE = r"(?!(?:[0-9]{1,3}\.){3}[0-9]|[0-9]{4}[-/][0-9]{2}[-/][0-9]|[0-9]{1,2}[./][0-9]{1,2}[./][0-9]{4}|[0-9]{3}-[0-9]{2}-[0-9]{4})"
FIFTEEN = r"(?<=\+(?:[ .()-]{0,2}[0-9]){8,15})"
PHONE = regex.compile(
    r"(?<![0-9+])\+1[ .-]?(?:\([0-9]{3}\)|[0-9]{3})[ .-]?[0-9]{3}[ .-]?[0-9]{4}(?![0-9])"
    rf"|(?<![0-9+])\+[0-9]{{1,3}}[ .-]?(?:\([0-9]{{1,4}}\)|[0-9]{{1,4}})(?:[ .-]?{OTHER_VALUE}[0-9]{{2,4}}){{2,4}}(?![0-9]){FIFTEEN}"
    r"|(?<![0-9(])\([0-9]{3}\) ?[0-9]{3}-[0-9]{4}(?![0-9])|(?<![0-9-])[0-9]{3}-[0-9]{3}-[0-9]{4}(?![0-9]|-[0-9])"
)
COUNTRY = regex.compile(r"\+(?:1|7|2(?:[07]|[1-689][0-9])|3(?:[0-469]|[578][0-9])|4(?:[013-9]|2[0-9])|5(?:[1-8]|[09][0-9])|6(?:[0-6]|[7-9][0-9])|8(?:[1246]|[035789][0-9])|9(?:[0-58]|[679][0-9])|[0-9]{1,3})")
FIRST, DAYS = datetime.date(1890, 1, 1), 300 * 256


def permuted(values, radix, key, kind):
    """Eight Feistel rounds over the halves of the positions; each position adds modulo its own radix."""
    v, n = list(values), len(values)
    for k in range(8):
        mine, theirs = (range(n // 2), v[n // 2 :]) if k % 2 == 0 else (range(n // 2, n), v[: n // 2])
        seed = "|".join([key, kind, str(n), str(k), ",".join(map(str, theirs))])
        for j, at in enumerate(mine):
            digest = hashlib.sha512(f"{seed}|{j // 21}".encode()).hexdigest()
            v[at] = (v[at] + int(digest[j % 21 * 6 : j % 21 * 6 + 6], 16)) % radix[at]
    return v


def digits_of(s):
    return "".join(c for c in s if c in "0123456789")


def permuted_digits(d, key, kind):
    return "".join(map(str, permuted([int(c) for c in d], [10] * len(d), key, kind)))


def fill(template, digits):
    left = iter(digits)
    return "".join(next(left) if c in "0123456789" else c for c in template)


def luhn(d):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d)))


def card(m, key):
    d = digits_of(m)
    if luhn(d) % 10 or not d.strip("0"):
        return None
    payload = d[0] + permuted_digits(d[1:-1], key, "card")
    return fill(m, payload + str(-luhn(payload + "0") % 10))


def mod97(s):
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97


def iban(m, key):
    s = m.replace(" ", "")
    if mod97(s) != 1 or not regex.search("[0-9]{2}", s[4:]):
        return None
    body = fill(s[4:], permuted_digits(digits_of(s[4:]), key, "iban"))
    return fill(m, f"{98 - mod97(s[:2] + '00' + body):02d}" + digits_of(body))


def date(m, key):
    parts = regex.split(r"[./-]", m)
    year_first, turned = len(parts[0]) == 4, False
    try:
        if year_first:
            day = datetime.date(*map(int, parts))
        else:
            try:
                day = datetime.date(int(parts[2]), int(parts[1]), int(parts[0]))
            except ValueError:
                if "/" not in m:
                    return None
                day, turned = datetime.date(int(parts[2]), int(parts[0]), int(parts[1])), True
    except ValueError:
        return None
    n = (day - FIRST).days
    if not 0 <= n < DAYS:
        return None
    while True:
        high, low = permuted([n // 256, n % 256], [300, 256], key, "date")
        n = high * 256 + low
        day = FIRST + datetime.timedelta(n)
        if year_first:
            return day.strftime("%Y-%m-%d" if "-" in m else "%Y/%m/%d")
        fields = (day.month, day.day) if turned else (day.day, day.month)
        if all(len(p) == 2 or f < 10 for p, f in zip(parts, fields)) and (not turned or day.day > 12):
            return ("." if "." in m else "/").join([*(str(f) if len(p) == 1 else f"{f:02d}" for p, f in zip(parts, fields)), str(day.year)])


def ssn(m, key):
    area, group, serial = map(int, m.split("-"))
    if not (1 <= area <= 899 and area != 666 and group and serial):
        return None
    a, g, s = permuted([area - 2 if area > 666 else area - 1, group - 1, serial - 1], [898, 99, 9999], key, "ssn")
    return f"{a + 2 if a >= 665 else a + 1:03d}-{g + 1:02d}-{s + 1:04d}"


def ipv4(m, key):
    octets = list(map(int, m.split(".")))
    return ".".join(map(str, permuted(octets, [256] * 4, key, "ipv4"))) if max(octets) < 256 else None


def in_plan(d):
    area, exchange = d[:3], d[3:6]
    return area[0] >= "2" and area[1] != "9" and area[1:] != "11" and exchange[0] >= "2" and exchange[1:] != "11"


AREAS = [f"{k:03d}" for k in range(200, 1000) if k // 10 % 10 != 9 and k % 100 != 11]
EXCHANGES = [f"{k:03d}" for k in range(200, 1000) if k % 100 != 11]


def phone(m, key):
    head = (COUNTRY.match(m) or [""])[0]
    d = digits_of(m[len(head) :])
    if not 7 <= len(d) <= 14:
        return None
    if head in ("", "+1") and len(d) == 10:
        if in_plan(d):
            a, e, line = permuted([AREAS.index(d[:3]), EXCHANGES.index(d[3:6]), int(d[6:])], [len(AREAS), len(EXCHANGES), 10000], key, "plan")
            new = f"{AREAS[a]}{EXCHANGES[e]}{line:04d}"
        else:
            new = permuted_digits(d, key, "phone")
            while in_plan(new):
                new = permuted_digits(new, key, "phone")
    else:
        least = int(d[0] != "0")
        first, *rest = permuted([int(d[0]) - least, *map(int, d[1:])], [9 if least else 1] + [10] * (len(d) - 1), key, "phone")
        new = "".join(map(str, [first + least, *rest]))
    return head + fill(m[len(head) :], new)


def text(s, key, kind):
    kinds = ["0123456789", "abcdef", "ghijklmnopqrstuvwxyz", "ABCDEF", "GHIJKLMNOPQRSTUVWXYZ"]
    own = [next((a for a in kinds if c in a), c) for c in s]
    return "".join(a[v] for a, v in zip(own, permuted([a.index(c) for a, c in zip(own, s)], [len(a) for a in own], key, kind)))


def email(m, key):
    local, _, host = m.partition("@")
    return f"{text(local, key, 'email')}@{host}"


def secret(m, key):
    value = regex.search(r"[A-Za-z0-9_+/.~-]+$", m)[0]
    return m[: len(m) - len(value)] + text(value, key, "secret")


MADE = {"email": email, "secret": secret, "iban": iban, "date": date, "ssn": ssn, "ipv4": ipv4, "card": card}


def pseudonymized(s, key):
    """(text, number of pseudonyms, kinds)."""
    if s is None:
        return None, 0, []
    spans = sorted((m.start(), order, m.end(), kind) for order, (kind, rule) in enumerate(RULES.items()) for m in rule.finditer(s, overlapped=True))
    pieces, kinds, at, seen = [], [], 0, set()
    for start, _, end, kind in spans:
        if start < at or start in seen:  # of the formats at one place the first counts, whether it passes or not
            continue
        seen.add(start)
        new = MADE[kind](s[start:end], key)
        if new is not None:
            pieces += [(s[at:start], None), (s[start:end], new)]
            kinds.append(kind)
            at = end
    pieces.append((s[at:], None))
    # telephone numbers in what is left, where a found value stands for one character
    shown, back = "", {}
    for old, new in pieces:
        if new is None:
            shown += old
        else:
            back[len(shown)] = new
            shown += ""
    out, at = "", 0
    restored = lambda a, b: "".join(back.get(i, shown[i]) for i in range(a, b))
    for m in PHONE.finditer(shown):
        new = phone(m[0], key)
        kinds += ["phone"] * (new is not None)
        out += restored(at, m.start()) + (m[0] if new is None else new)
        at = m.end()
    return out + restored(at, len(shown)), len(kinds), sorted(set(kinds))
