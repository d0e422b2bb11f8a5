"""Boolean requests: words, and/or/not and quoted phrases, as a list of OR groups."""

from __future__ import annotations

import re
from dataclasses import dataclass, field


@dataclass(frozen=True)
class Group:
    """Documents with every word of all and none of the words of none."""

    all: tuple[str, ...] = ()
    none: tuple[str, ...] = ()


@dataclass
class _Open:
    all: list[str] = field(default_factory=list)
    none: list[str] = field(default_factory=list)


def is_boolean(text: str) -> bool:
    """A request of one token is no boolean one."""
    return len(_tokens(text)) > 1


def _tokens(text: str) -> list[tuple[str, bool]]:
    return [(a or b, bool(a)) for a, b in re.findall(r'"([^"]*)"|(\S+)', text) if a or b]


def parse(text: str) -> list[Group]:
    """NOT binds closest, then AND, then OR; words side by side are joined by AND.  A group without a positive word
    selects nothing and is left out; so are operators without operand.  Longer words come first in a group."""
    groups, negate = [_Open()], False
    for word, quoted in _tokens(text):
        operator = None if quoted else word.lower()
        if operator == "or":
            groups.append(_Open())
            negate = False
        elif operator == "not":
            negate = not negate
        elif operator == "and":
            continue
        else:
            (groups[-1].none if negate else groups[-1].all).append(word)
            negate = False
    order = lambda words: tuple(sorted(dict.fromkeys(words), key=lambda w: (-len(w), w)))
    return [Group(order(g.all), order(g.none)) for g in groups if g.all]
