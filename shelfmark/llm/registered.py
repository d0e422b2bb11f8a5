"""The subpackage's queries and oracles, by name."""

from __future__ import annotations

from . import bpe, langid, media, neardup, packing, pii, quality, sharding, substrings, warc

MODULES = [bpe, langid, media, neardup, packing, pii, quality, sharding, substrings, warc]


def queries() -> dict:
    return {k: f for m in MODULES for k, f in m.QUERIES.items()}


def oracles() -> dict:
    return {k: f for m in MODULES for k, f in m.ORACLES.items()}
