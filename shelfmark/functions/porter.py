"""Porter's suffix stripping (1980), for the stems of keywords."""

from __future__ import annotations

from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

_VOWEL = "aeiou"


_LETTERS = str.maketrans({chr(c): "v" if chr(c) in _VOWEL else "c" for c in range(ord("a"), ord("z") + 1)})


def _kinds(word: str) -> str:
    """c or v for each letter; y is a vowel after a consonant."""
    if "y" not in word:
        return word.translate(_LETTERS)
    out = ""
    for i, ch in enumerate(word):
        out += "v" if ch in _VOWEL or (ch == "y" and i and out[-1] == "c") else "c"
    return out


def _measure(stem: str) -> int:
    return _kinds(stem).count("vc")


def _double(stem: str) -> bool:
    return len(stem) > 1 and stem[-1] == stem[-2] and _kinds(stem)[-1] == "c"


def _short(stem: str) -> bool:
    return _kinds(stem)[-3:] == "cvc" and stem[-1] not in "wxy"


#: Rules of steps 2, 3 and 4 of the published algorithm: suffix and replacement (fixed values).
_STEP2 = {"ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "abli": "able", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble"}
_STEP3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
_STEP4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")


def _longest(word: str, suffixes: tuple[str, ...]) -> str | None:
    if not word.endswith(suffixes):
        return None
    return max((s for s in suffixes if word.endswith(s)), key=len)


def stem(word: str) -> str:
    if len(word) < 3 or not word.isascii() or not word.isalpha():
        return word
    w = word.lower()
    if w.endswith("sses") or w.endswith("ies"):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    if w.endswith("eed"):
        w = w[:-1] if _measure(w[:-3]) > 0 else w
    else:
        for suffix in ("ed", "ing"):
            if w.endswith(suffix):
                if "v" in _kinds(w[: -len(suffix)]):
                    w = w[: -len(suffix)]
                    if w.endswith(("at", "bl", "iz")):
                        w += "e"
                    elif _double(w) and w[-1] not in "lsz":
                        w = w[:-1]
                    elif _measure(w) == 1 and _short(w):
                        w += "e"
                break
    if w.endswith("y") and "v" in _kinds(w[:-1]):
        w = w[:-1] + "i"
    for rules in (_STEP2, _STEP3):
        if (s := _longest(w, tuple(rules))) and _measure(w[: -len(s)]) > 0:
            w = w[: -len(s)] + rules[s]
    if (s := _longest(w, _STEP4)) and _measure(w[: -len(s)]) > 1 and (s != "ion" or w[:-3].endswith(("s", "t"))):
        w = w[: -len(s)]
    if w.endswith("e") and (_measure(w[:-1]) > 1 or (_measure(w[:-1]) == 1 and not _short(w[:-1]))):
        w = w[:-1]
    if _measure(w) > 1 and _double(w) and w.endswith("l"):
        w = w[:-1]
    return w


#: Most occurrences are of few words, so a worker keeps the stems of those it met last, over batches and tasks.
KEPT_STEMS = 1 << 17
_kept_stem = lru_cache(KEPT_STEMS)(stem)


def _stems(words: pa.Array) -> pa.Array:
    return pa.array([None if w is None else _kept_stem(w) for w in words.to_pylist()], pa.string())


def stem_column(words: Column) -> Column:
    """Stems of a column of words, frequent words once for each worker."""
    return F.arrow_udf(_stems, "string")(words)
